"""Phrases, vector codes and language identification against plain versions."""

import collections
import hashlib
import inspect
import os
import re
import sys
import tracemalloc
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402

from tabsight.llm import langid, phrases, vector_codes  # noqa: E402
from tabsight.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
CLASH = ("words", "phrase", "a", "n", "part", "counts", "rank", "mass", "letters", "p", "class", "key", "code", "error")


# ------------------------------------------------------------- phrases

def plain_phrases(rows, least=10, longest=3, percent=50, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for s in range(1, longest + 1):
                f[lang].update(tuple(words[i:i + s]) for i in range(len(words) - s + 1))
    out = []
    for lang, counts in f.items():
        cand = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in cand.items():
            if any(len(h) > len(g) and 100 * b >= percent * a
                   and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in cand.items()):
                continue
            score, _, l, r = min((1000000 * a * a // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]])
                                 for k in range(1, len(g)))
            rows.append((" ".join(g), a, l, r, n[lang], score))
        rows.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i + 1, *x) for i, x in enumerate(rows[:top])]
    return out


TEXTS = [("en", "The cat sat. The cat sat, the CAT sat!\tthe cat ran\x0bthe cat"), (None, "a b c a b c: a b c"),
         ("en", None), ("en", ""), ("fr", " \t.\r\n"), ("und", "a b c d;a b"), ("en", "\xff ÿ É é É"), ("en", "x " * 300),
         ("en", "the cat sat"), ("en", "the cat sat"), (None, None), ("de", "x " * 40 + "." + " y x" * 20)]


def texts(spark, rows):
    return spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(rows)],
                                 "doc_id long, lang string, text string").withColumns({c: F.lit(3) for c in CLASH})


@pytest.mark.parametrize("size", [3, 50, 1 << 20])
def test_phrases_like_the_plain_version(spark, size):
    got = phrases.collocations(texts(spark, TEXTS * 2), least=4, size=size)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    brute.same(got.collect(), plain_phrases(TEXTS * 2, least=4))


def test_phrases_of_other_lengths_and_tops(spark):
    for longest, percent, top in ((2, 50, 3), (4, 90, 2000), (5, 10, 7)):
        got = phrases.collocations(texts(spark, TEXTS), least=3, longest=longest, percent=percent, top=top, size=64)
        brute.same(got.collect(), plain_phrases(TEXTS, 3, longest, percent, top))


def test_phrases_of_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_phrases([(r.lang, r.text) for r in docs.collect()])
    query = {name: build for name, build, _ in QUERIES}["op11_phrases"]
    brute.same(query(spark, SF).collect(), want)
    assert len(want) > 50


def test_no_phrases_in_an_empty_table(spark):
    assert phrases.collocations(texts(spark, TEXTS).filter("false")).count() == 0


def test_products_beyond_64_bits(spark):
    a, l, r = 3 * 10**12, 4 * 10**12, 5 * 10**12
    grams = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, l), ("en", "y", 1, r)],
                                  "lang string, phrase string, words int, a long")
    got = phrases.weakest_cuts(grams).collect()
    assert [(x.l, x.r, x.score) for x in got] == [(l, r, 10**6 * a * a // (l * r))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 400), max_size=300), max_size=12), st.integers(2, 12))
def test_summaries_lose_nothing_frequent(blocks, least):
    summary = phrases.Summary(sum(map(len, blocks)), least)
    for block in blocks:
        keys, counts = np.unique(np.array(block, np.uint32), return_counts=True)
        summary.add(keys, counts)
        summary.merge()  # as if every block filled the buffer
        assert len(summary.keys) <= summary.capacity
    counts = collections.Counter(x for b in blocks for x in b)
    assert summary.error < least
    assert {x for x, c in counts.items() if c >= least} <= set(summary.survivors().tolist())
    held = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
    assert all(held.get(x, 0) <= c <= held.get(x, 0) + summary.error for x, c in counts.items())


def test_packed_counts_come_back():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**32, 500, dtype=np.uint32))
    counts = rng.integers(1, 2**31, len(keys))
    for k, c in ((keys, counts), (keys[:0], counts[:0]), (keys[:1], counts[:1])):
        got = phrases.unpack_counts(phrases.pack_counts(k, c))
        assert (got[0] == k).all() and (got[1] == c).all()


def test_a_full_bit_table_keeps_counts_exact(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MAX_TABLE_BITS", phrases.MIN_BITS + 3)
    got = phrases.collocations(texts(spark, TEXTS), least=4, size=100)
    brute.same(got.collect(), plain_phrases(TEXTS, least=4))


def test_long_text_in_slices():
    raw = ("ab cd. " * 40 + "é" * 30 + " " + "q" * 90 + ", z").encode()
    for size in (1, 5, 16, 64, 1 << 20):
        parts = list(phrases._slices(raw, size))
        assert b"".join(parts) == raw
        assert [w for p in parts for w in phrases.pieces_of(p)] == phrases.pieces_of(raw)


def test_phrases_cross_the_jvm_packed(spark, monkeypatch):
    """Rows of single phrases in Spark's hash maps filled the executors at 6 GB."""
    plans, cut = [], phrases.cut_lineage
    monkeypatch.setattr(phrases, "cut_lineage",
                        lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    phrases.frequent_phrases(texts(spark, TEXTS), least=4)
    assert len(plans) == 2
    assert all("MapInArrow" in p and "Aggregate" not in p for p in plans)


def test_memory_of_a_chunk_where_all_passes():
    """Python's memory follows the tokens of a chunk, not what passes the table."""
    rng = np.random.default_rng(3)
    n = 1 << 17
    batch = pa.RecordBatch.from_pydict({
        "lang": ["en"], "text": [" ".join(f"word{x}" for x in rng.integers(0, 20000, n).tolist())]})
    shared = types.SimpleNamespace(value=np.full(1 << 12, 255, np.uint8))
    args = (shared, 3, n, 5)[:len(inspect.signature(phrases._exact).parameters)]
    run = phrases._exact(*args)
    tracemalloc.start()
    assert sum(b.num_rows for b in run(iter([batch]))) > 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 350 * n


def test_sums_of_packed_phrases(monkeypatch):
    monkeypatch.setattr(phrases, "SUM_BYTES", 40)
    rng = np.random.default_rng(2)
    names = [f"{lang}\xff{w}".encode("latin-1") for lang in ("en", "", "zz z") for w in ("a", "a b", "a\x00 b", "x y z")]
    want, sums = collections.Counter(), phrases.Sums()
    for size in (3, 0, 12, 1, 7):
        keys = [names[i] for i in rng.permutation(len(names))[:size]]
        counts = rng.integers(1, 2**32, size)
        want.update(dict(zip(keys, counts.tolist())))
        lengths = np.array([len(k) for k in keys], np.int64)
        sums.add(*phrases.unpack_phrases(phrases.pack_phrases(lengths, counts, b"".join(keys))))
    least = sorted(want.values())[2]
    got = [r for b in sums.rows(least) for r in zip(*(b.column(c).to_pylist() for c in ("lang", "phrase", "words", "a")))]
    split = {k: k.decode("latin-1").split("\xff") for k in want}
    assert sorted(got) == sorted((*split[k], len(split[k][1].split(" ")), a) for k, a in want.items() if a >= least)
    assert list(phrases.Sums().rows(0)) == []


def test_summaries_with_counters_to_spare_make_no_error():
    blocks = [np.arange(i, 900 + i, dtype=np.uint32) for i in range(0, 90, 9)]
    plain, roomy = phrases.Summary(9000, 10), phrases.Summary(9000, 10, 1 << 10)
    for b in blocks:
        for s in (plain, roomy):
            s.add(b, np.full(len(b), 2**31 if s is roomy and b[0] == 0 else 1))
            s.merge()
    assert plain.error > 0 and roomy.error == 0
    held = dict(zip(roomy.keys.tolist(), roomy.counts.tolist()))
    assert (held[0], held[89], held[500], held[980]) == (2**31, 2**31 + 9, 2**31 + 9, 1)


# -------------------------------------------------------- vector codes

def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(x * 4096)) for x in v], label))
    if not kept:
        return []
    step = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    kept = [(i, v + [0] * (step * parts - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = [[v[p * step:(p + 1) * step] for p in range(parts)] for _, v, _ in kept]
    books = [[v[p * step:(p + 1) * step] for _, v, _ in first] for p in range(parts)]

    def nearest(part, book):
        d = [sum((x - y) ** 2 for x, y in zip(part, e)) for e in book]
        return min(range(len(d)), key=lambda k: (d[k], k)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            mine = collections.defaultdict(list)
            for c in cut:
                mine[nearest(c[p], books[p])[0]].append(c[p])
            books[p] = [[sum(x) // len(mine[k]) for x in zip(*mine[k])] if k in mine else e
                        for k, e in enumerate(books[p])]
    out, by_label = [], collections.Counter()
    for (i, _, label), c in zip(kept, cut):
        got = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for k, _ in got), sum(d for _, d in got), label))
        by_label[label] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, error, by_label[label], sha) for i, code, error, label in out]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int") \
        .withColumns({c: F.lit(7) for c in (*CLASH, "label_error", "x", "v", "ids", "payload")})


def vector_rows(n=230, width=16, seed=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (5, width))
    rows = [(int(i), (middle[i % 5] + rng.normal(0, 0.05 if i % 3 else 0.4, width)).tolist(), i % 4 or None)
            for i in range(n)]
    bad = [(900, None, 1), (901, [1.0, None] * (width // 2), 1), (902, [float("nan")] * width, 2),
           (903, [float("-inf")] + [0.0] * (width - 1), 2), (904, [-0.00001] * width, None), (None, rows[3][1], 1)]
    return rows + bad + rows[:40] + [(1000 + i, rows[7][1], 9) for i in range(60)]


@pytest.mark.parametrize("block, leaf, spread", [(4096, 24, 1), (37, 3, 5), (64, 200, 3)])
def test_codes_like_the_plain_version(spark, block, leaf, spread):
    rows = vector_rows()
    got = vector_codes.compress(vectors(spark, rows).repartition(spread), block=block, leaf=leaf)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    brute.same(got.collect(), plain_codes(rows))


def test_codes_of_odd_tables(spark):
    few = vector_rows(9, 5, 6)[:9]
    uneven = [(i, v[:i % 4], label) for i, v, label in few]
    blank = [(1, [], 2), (2, [], None)]
    for rows in (few, uneven, blank, [(5, [0.25] * 16, None)] * 40):
        brute.same(vector_codes.compress(vectors(spark, rows)).collect(), plain_codes(rows))
    assert vector_codes.compress(vectors(spark, few).filter("false")).collect() == []
    with pytest.raises(Exception, match="would not be exact"):
        vector_codes.compress(vectors(spark, [(1, [1e9] * 8, 1)])).collect()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 160), st.integers(1, 5), st.integers(1, 40), st.integers(1, 30), st.integers(0, 10**6))
def test_walks_agree_with_all_distances(n, width, reach, leaf, seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-reach, reach + 1, (n, width))
    entries = np.concatenate([points[rng.integers(0, n, 5)], rng.integers(-reach, reach + 1, (6, width))])
    tree = vector_codes.build(points, leaf)
    assert sorted(tree.order.tolist()) == list(range(n))
    tree = vector_codes.Tree.of(tree.arrays())
    want = ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert vector_codes.assigned(tree, points, entries).tolist() == want.tolist()
    total, count, _ = vector_codes.totals(tree, points, entries)
    assert count.tolist() == np.bincount(want, minlength=len(entries)).tolist()
    assert all((total[k] == points[want == k].sum(axis=0)).all() for k in range(len(entries)))


def test_balls_cover_their_points_and_spare_distances():
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.integers(-30, 31, (400, 6)) + c for c in rng.integers(-3000, 3000, (8, 6))])
    tree = vector_codes.build(points)
    for a, b, c, r, t in zip(tree.begin, tree.end, tree.centre, tree.radius, tree.total):
        mine = points[tree.order[a:b]]
        assert (mine.sum(axis=0) == t).all() and np.sqrt(((mine - c) ** 2).sum(axis=1)).max() <= r * (1 + 1e-12)
    computed = vector_codes.totals(tree, points, points[::200])[2]
    assert computed < len(points) * 16 / 4


def test_large_numbers_are_exact():
    points = np.array([[2**27 - 1, -(2**27)], [2**27 - 2, 5]])
    entries = np.array([[-(2**27), 2**27 - 1], [2**27 - 3, 4]])
    want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, e)) for e in entries] for p in points]
    assert vector_codes.squared(points, entries).tolist() == want


# ------------------------------------------------- language identification

def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    query = {name: build for name, build, _ in QUERIES}["op13_language_id"]
    got = {r.doc_id: r for r in query(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= got[r.doc_id].score <= 1
    held = [r for r in rows if got[r.doc_id].held_out]
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held)
    assert len(held) > 200 and right >= 0.98 * len(held)


def test_language_gradient():
    rng = np.random.default_rng(3)
    params = langid.initial(3, (2, 3), 4)
    rows, target = rng.integers(0, 257, (6, 20)), np.array([0, 1, 2, 0, 1, 2])

    def loss(ps):
        p = langid.softmax(langid.forward(ps, rows)[2])
        return -np.log(p[np.arange(6), target]).mean()

    for k, g in enumerate(langid.gradients(params, rows, target)):
        for i in [*np.flatnonzero(g.ravel())[:4], *rng.choice(g.size, 3)]:
            up, down = [x.copy() for x in params], [x.copy() for x in params]
            up[k].ravel()[i] += 1e-6
            down[k].ravel()[i] -= 1e-6
            assert (loss(up) - loss(down)) / 2e-6 == pytest.approx(g.ravel()[i], rel=1e-3, abs=1e-7)


def test_added_tables_give_the_same_network():
    rng = np.random.default_rng(5)
    for widths in ((2, 3, 4), (1, 5)):
        params = langid.initial(4, widths, 3)
        rows = rng.integers(0, 257, (7, 40))
        want = np.log(langid.softmax(langid.forward(params, rows)[2]))
        assert langid.Scorer(params).log_probability(rows) == pytest.approx(want, abs=1e-4)


def test_windows_cover_every_byte():
    offsets = np.cumsum([0, 0, 1, 9, 10, 11, 57, 0])
    text, start, size = langid.cut(offsets, 10, 7)
    runs = {(int(s) + k) for s, n in zip(start, size) for k in range(n - 3)}  # where four bytes stand in one window
    for a, b in zip(offsets, offsets[1:]):
        assert set(range(a, b - 3)) <= runs
    assert (start + size <= offsets[1:][text]).all() and sorted(set(text.tolist())) == [1, 2, 3, 4, 5]


def test_languages_of_odd_rows(spark):
    german, english = "der Hund und die Katze ßä ", "the dog and the cat whether "
    rows = [(i, (german if i % 2 else english) * (1 + i % 5), "de" if i % 2 else "en") for i in range(120)]
    rows += [(500, None, "en"), (501, "", "de"), (502, "12 34 ... \n", None), (None, german, None), (503, german * 4000, None),
             (504, "日本語", None), (505, "a", None), (3, german, "de"), (3, german, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in CLASH})
    languages, params = langid.train(docs, filters=4)
    assert languages == ["de", "en"]
    got = langid.identify(docs, languages, params).collect()
    assert got[0].__fields__ == ["doc_id", "held_out", "lang_pred", "score"] and len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i in range(120):
        assert all(r.lang_pred == ("de" if i % 2 else "en") for r in by[i])
    assert [(by[i][0].lang_pred, by[i][0].score) for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert by[None][0].lang_pred == by[503][0].lang_pred == "de" and not by[None][0].held_out
    assert len(by[3]) == 3 and len(set(by[3])) <= 2 and all(0 < by[i][0].score <= 1 for i in (504, 505))
    again = langid.train(docs.repartition(7), filters=4)[1]
    assert all((a == b).all() for a, b in zip(params, again))  # one model, whatever the layout
    # the language of held-out rows and of the rows to be predicted plays no part
    blind = docs.withColumn("lang", F.when(~langid.held_out(F.col("doc_id")), F.col("lang")))
    assert all((a == b).all() for a, b in zip(params, langid.train(blind, filters=4)[1]))
    brute.same(langid.identify(blind.withColumn("lang", F.lit("zz")), languages, params).collect(), got)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    got = langid.identify(docs, *langid.train(docs)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2
    assert langid.identify(docs.filter("false"), *langid.train(docs)).count() == 0
