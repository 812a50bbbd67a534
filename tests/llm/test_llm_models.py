"""Toxicity, language-model scores and mixing: held-out accuracy, gradients,
and exact edge cases."""

import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402

from tabsight.llm import lm, mixing, toxicity  # noqa: E402

SF = "/root/testdata/sf0.01"


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(7) for c in ("toxic", "quality", "score", "codes", "rate", "domain", "word", "count")})


def test_automaton_against_edit_distance():
    r = random.Random(1)
    terms = list(dict.fromkeys("".join(r.choice("abcé") for _ in range(r.randint(3, 13))) for _ in range(30)))
    machine = toxicity.Automaton(terms)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 15))) for _ in range(1500)] + \
        [t[:-1] for t in terms] + [t + "x" for t in terms] + terms
    _, codes, start, length, _, _ = toxicity.words_in(words)
    edits, _ = machine.match(codes, start, length)
    want = [min((brute.levenshtein(w, t) for t in terms if brute.levenshtein(w, t) <= toxicity.allowed_edits(t)),
                default=-1) for w in words if w]
    assert edits.tolist() == want
    again = toxicity.Model(terms, [1.0] * len(terms))
    again.automaton.match(codes, start, length)
    restored = toxicity.Model.restore(again.state())
    assert restored.automaton.match(codes, start, length)[0].tolist() == want


def made_up(spark, quoted=False):
    rng = np.random.default_rng(4)
    plain = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(700):
        words = rng.choice(plain, 40).tolist()
        toxic = int(i % 5 == 0)
        if toxic:
            bad = rng.choice(["worthless", "idiotic", "scumbags"])
            if i % 10 == 0:  # a typing error
                k = int(rng.integers(1, len(bad) - 1))
                bad = bad[:k] + "x" + bad[k + 1:]
            words[int(rng.integers(40))] = bad
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), \
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_automaton_of_mixed_scripts():
    r = random.Random(4)
    letters = ["абвгдж", "日本語文字", "abcé", "αβγabc", "가나다"]
    terms = list(dict.fromkeys("".join(r.choice(kind) for _ in range(r.randint(2, 13))) for kind in letters for _ in range(8)))
    machine = toxicity.Automaton(terms)
    words = ["".join(r.choice(kind) for _ in range(r.randint(1, 14))) for kind in [*letters, "абвzé", "слово日"] for _ in range(150)]
    words += terms + [t[1:] for t in terms] + [t + "ж" for t in terms] + [t[:2] + "日" + t[3:] for t in terms]
    words = [w for w in words if w]
    _, codes, start, length, _, _ = toxicity.words_in(words)
    edits, _ = machine.match(codes, start, length)
    want = [min((brute.levenshtein(w, t) for t in terms if brute.levenshtein(w, t) <= toxicity.allowed_edits(t)),
                default=-1) for w in words]
    assert edits.tolist() == want


def test_a_clean_russian_text_under_a_russian_lexicon(spark):
    r = random.Random(6)
    plain = ["добрый", "вечер", "город", "книга", "слово", "карты", "зелёный", "вода", "письмо", "окно"]
    rows, labels = [], []
    for i in range(400):
        words = [r.choice(plain) for _ in range(30)]
        if i % 2:
            words[r.randrange(30)] = r.choice(["глупец", "мерзавец", "дрянь"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    asked = spark.createDataFrame([(1, "доброе утро друзья"), (2, "hello 日本語日本"), (3, " ".join(plain)), (4, "ты глупец и дряни")],
                                  "doc_id long, text string")
    got = {x.doc_id: x.predicted for x in toxicity.score(asked, model).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1}


def test_quotations_are_paired_in_the_window():
    for before, after, want in [
            ('he said "you ', '" to me', True), ('a 5" board and ', " more", False), ('"one" ', ' and "two"', False),
            ("„ein ", "“ Wort", True), ("“so ", "” he", True), ("„zu“ ", "“", False), ("« le ", " »", True),
            ("» das ", "«", True), ("plain ", '"then"', False), ("”late ", "”", False), ("", "", False)]:
        assert toxicity.quoted(before, after) is want, (before, after)
    model = toxicity.Model(["dreck"], [3.0])
    far = 'a 5" board ' + "word " * 20 + "dreck here"
    quoted = {text: [m[4] for m in model.matches([text])[0]] for text in (far, 'they said "you dreck there" today', "dreck", 'x "dreck"')}
    assert list(quoted.values()) == [[False], [True], [False], [True]]


def test_toxicity_held_out(spark):
    docs, labels = made_up(spark)
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id")
    held = [(r.toxic, r.predicted) for r in got.filter("held_out").collect()]
    right = sum(t == p for t, p in held) / len(held)
    assert len(held) > 100 and right >= 0.97
    # labels of held-out rows change nothing
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score(docs, toxicity.train(docs, other))
    assert sorted((r.doc_id, r.score) for r in again.collect()) == sorted((r.doc_id, r.score) for r in got.collect())


def test_toxicity_edges(spark):
    docs, labels = made_up(spark)
    model = toxicity.train(docs, labels)
    d = table(spark, brute.EDGE)
    got = toxicity.score(d, model).collect()
    assert len(got) == len(brute.EDGE) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert toxicity.score(d.filter("false"), model).count() == 0
    none = toxicity.train(docs, labels.filter("false"))
    assert {r.score for r in toxicity.score(d, none).collect()} == {0.0}


@pytest.mark.parametrize("partitions", [1, 8, 32])
def test_pseudo_likelihood_learns_order(spark, partitions):
    cycle = [f"c{i}" for i in range(12)]
    rng = np.random.default_rng(2)
    ordered = [(i, " ".join(cycle[(i + k) % 12] for k in range(120))) for i in range(150)]
    mixed = [(1000, " ".join(rng.choice(cycle, 120).tolist()))]
    got = {r.doc_id: r for r in lm.pseudo_likelihood(table(spark, ordered + mixed).repartition(partitions),
                                                     stride=2, rounds=6).collect()}
    known = np.mean([got[i].per_token for i in range(150)])
    assert known > -0.7 and got[1000].per_token < known - 1


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 3000)  # several shards
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = [sorted((r.doc_id, r.n_tokens, round(r.log_likelihood, 2)) for r in
                  lm.pseudo_likelihood(docs.repartition(n, F.col("doc_id") % (n + 1)), 500).collect()) for n in (1, 8, 32)]
    assert len(got[0]) == docs.count() and got[0] == got[1] == got[2]


def test_word_probabilities_add_up(spark):
    rows = [(1, "a a a b b c d e f g h"), (2, "a b c z y x")]
    counts = {r.word: r["count"] for r in lm.word_counts(table(spark, rows)).collect()}
    for size, top, shared in ((9, 2, 3), (9, 2, None), (4, 1, 2), (50, 0, 1)):
        known = lm.vocabulary(spark.createDataFrame(list(counts.items()), "word string, count long"), size, top, shared)
        placed = lm.layout(known)
        total: dict[int, float] = {}
        for w, n in counts.items():
            memo = lm._Words(placed)
            code = memo.codes[memo[w.encode()]]
            p = np.exp(placed["prior"][code])
            if w.encode() not in placed["codes"]:
                p *= n / np.exp(placed["mass"][code])
            k = int(placed["classes"][code])
            total[k] = total.get(k, 0.0) + p
        assert all(v == pytest.approx(1.0) for v in total.values())


def test_rare_words_share_buckets_of_a_listed_words_size(spark):
    counts = [(f"w{i}", 1) for i in range(3000)] + [("often", 3000)]
    known = lm.vocabulary(spark.createDataFrame(counts, "word string, count long"), 600, 0)
    left = np.array(known["left"])
    assert set(known["words"]) == {b"often"} and left.sum() == 3000
    assert 300 <= left.size <= 330 and left.max() < 40  # about one token in 600 a bucket
    assert left.shape[1] <= left.shape[0] + 2  # as many classes as codes of a class


def test_every_position_trains(monkeypatch):
    texts = [np.full(1 + i % 5, i % 7, np.uint16).tobytes() for i in range(90)]  # all shorter than 16 tokens
    batch = pa.RecordBatch.from_pydict({"shard": pa.array([0] * 40 + [1] * 50, pa.int64()),
                                        "codes": pa.array(texts, pa.binary())})
    used = []

    def keep(params, moments, flat, places, *rest):
        mine = flat[places.start:places.stop:places.step]
        used.append(mine[mine < 7])
        return len(used[-1])

    monkeypatch.setattr(lm, "train_step", keep)
    known = {"prior": np.zeros(7), "top": 2, "shared": 1}
    shared = type("Shared", (), {"value": known})
    state = type("Shared", (), {"value": (lm.initial(known), lm.initial(known))})
    for r in range(lm.ROUNDS):
        out = list(lm._train(state, r, lm.WINDOW, lm.STRIDE, lm.RATE, 16, shared)(iter([batch])))
        assert len(out) == 2
    assert sum(map(len, used)) == sum(len(t) // 2 for t in texts)
    assert sorted(np.concatenate(used).tolist()) == sorted(np.frombuffer(b"".join(texts), np.uint16).tolist())


@pytest.mark.parametrize("partitions", [1, 8])
def test_learns_order_with_the_production_parameters(spark, partitions):
    rng = np.random.default_rng(3)
    cycle = [f"c{i}" for i in range(12)]
    rows = [(i, " ".join(cycle[(i + k) % 12] for k in range(120))) for i in range(600)]
    rows.append((1000, " ".join(rng.choice(cycle, 120).tolist())))
    got = {r.doc_id: r for r in lm.pseudo_likelihood(table(spark, rows).repartition(partitions)).collect()}
    known = np.mean([got[i].per_token for i in range(600)])
    print("known", known, "mixed", got[1000].per_token)
    assert known > -0.7 and got[1000].per_token < known - 1


def test_word_network_gradient_and_total():
    known = lm.layout({"words": {b"a": (0, 0.0), b"b": (1, np.log(0.5)), b"c": (1, np.log(0.2)), b"d": (2, np.log(0.9))},
                       "top": 1, "shared": 2, "tokens": [10.0, 10.0], "left": [3.0, 1.0]})
    assert known["codes"] == {b"a": 0, b"b": 2, b"c": 3, b"d": 5} and known["bounds"] == [1, 4, 6]
    r = np.random.default_rng(1)
    params = [p + r.standard_normal(p.shape) * 0.3 for p in lm.initial(known, 2, 4)]
    texts = [np.array(t, np.uint16).tobytes() for t in ([0, 2, 3, 5, 4, 1, 0], [3, 3, 5])]
    flat, place, _ = lm._padded(texts, 2, 6)
    chosen = range(3, len(flat) - 2, 2)  # with paddings among them
    tokens = np.array([x for x in chosen if x in set(place.tolist())])
    loss = lambda ps: -lm.log_probability(ps, flat, tokens, 2, known).mean()
    moments = [np.full_like(p, 1e-6) for p in params]
    before = [m.copy() for m in moments]
    assert lm.train_step([p.copy() for p in params], moments, flat, chosen, 2, 0.0, known) == len(tokens) < len(chosen)
    for k, p in enumerate(params):
        g2 = (moments[k] - before[k]).ravel()
        for i in r.choice(p.size, min(p.size, 6), replace=False):
            up, down = [x.copy() for x in params], [x.copy() for x in params]
            up[k].ravel()[i] += 1e-5
            down[k].ravel()[i] -= 1e-5
            slope = (loss(up) - loss(down)) / 2e-5
            assert slope * slope == pytest.approx(g2[i], rel=1e-2, abs=1e-10)
    # the codes at one place have the probability 1 together
    every = []
    for code in range(6):
        other = flat.copy()
        other[place[2]] = code
        every.append(lm.log_probability(params, other, place[2:3], 2, known)[0])
    assert np.exp(every).sum() == pytest.approx(1.0)


def test_words_of_one_class_are_told_apart(spark):
    cycle = [f"w{i:03}" for i in range(200)]  # the first 48 are classes of their own
    rows = [(i, " ".join(cycle[(7 * i + k) % 200] for k in range(200))) for i in range(1200)]
    swap = {}
    for k in range(lm.SHARED):
        same = [w for w in cycle[lm.TOP:] if lm.shared_class(w.encode(), 0, lm.SHARED) == k]
        swap.update(zip(same, same[1:] + same[:1]))
    rows.append((5000, " ".join(swap.get(w, w) for w in cycle)))  # the same classes in the same order
    got = {r.doc_id: r.per_token for r in lm.pseudo_likelihood(table(spark, rows)).collect()}
    print("known", got[0], "swapped", got[5000])
    assert got[5000] < got[0] - 1


def test_unlisted_words_keep_their_counts(spark):
    rows = [(1, "a a a a a a common common"), (2, "a a a a seldom"), (3, "a a a a common"), (4, None), (4, "a common x")]
    docs = table(spark, rows)
    known = lm.vocabulary(lm.word_counts(docs), 3, 1, 1)  # only "a" is listed
    assert set(known["words"]) == {b"a"}
    encoded = lm.encode(docs, spark.sparkContext.broadcast(lm.layout(known)), 2, 4)
    ids = {r.rid: r.doc_id for r in encoded.filter("part is null").collect()}
    got = {}
    for r in lm.rare_mass(encoded).collect():
        got[ids[r.rid]] = got.get(ids[r.rid], 0) + r.mass
    assert got == pytest.approx({1: 2 * np.log(4), 2: 0.0, 3: np.log(4), 4: np.log(4)})
    # which words are listed doesn't change what an untrained network gives
    none, every = (sorted((r.doc_id, r.n_tokens, r.log_likelihood) for r in
                          lm.pseudo_likelihood(docs, size, 1, 1, rounds=0).collect()) for size in (3, 1000))
    assert [x[:2] for x in none] == [x[:2] for x in every] == [(1, 8), (2, 5), (3, 5), (4, 0), (4, 3)]
    assert [x[2] for x in none] == pytest.approx([x[2] for x in every])


def test_model_edges(spark):
    d = table(spark, brute.EDGE)
    got = lm.pseudo_likelihood(d).collect()
    assert len(got) == len(brute.EDGE)
    assert all((r.n_tokens == 0) == (r.per_token is None) for r in got)
    assert lm.pseudo_likelihood(d.filter("false")).count() == 0
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 0, 1), (6, None, 0)], "doc_id long, quality int, toxic int")
    mixed = mixing.mix(d, labels)
    assert mixed.count() == len(brute.EDGE) and mixed.filter("rate is null or rate < 0").count() == 0
    assert {r.rate for r in mixing.mix(d, labels.filter("false")).collect()} == {1.0}
    assert mixing.mix(d.filter("false"), labels).count() == 0


def test_mixing_meets_targets(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = mixing.mix(docs, labels)
    names = [c for c in got.columns if c.startswith("p_")]
    row = got.agg(F.sum(F.col("n_tokens")).alias("all"), *[F.sum(F.col("rate") * F.col("n_tokens") * F.col(c)).alias(c) for c in names]).first()
    for c in names:
        assert row[c] / row["all"] == pytest.approx(mixing.TARGETS[c[2:]], rel=5e-3)
    posterior = got.join(labels, "doc_id").select(*names, F.concat(
        F.lit("p_q"), F.col("quality"), F.lit("t"), F.col("toxic")).alias("truth")).collect()
    right = sum(max(names, key=lambda c: r[c]) == r.truth for r in posterior) / len(posterior)
    assert right > 0.9


def test_rates_against_plain_projected_gradient(spark):
    rng = np.random.default_rng(8)
    p = rng.dirichlet([0.4, 0.4, 0.4], 60)
    n = rng.integers(1, 50, 60)
    targets = np.array([0.2, 0.5, 0.3])
    members = spark.createDataFrame([(i, int(n[i]), p[i].tolist(), 1.0, 1.0) for i in range(60)], mixing._SCHEMA)
    rated, reached = mixing.fit_rates(members, targets, max_steps=40, tolerance=0.0, history_size=7)
    got = np.array([r.rate for r in sorted(rated.collect(), key=lambda r: r.doc_id)])
    wanted = targets * n.sum()
    moment = (p * n[:, None]).T @ p
    whiten = np.linalg.inv(moment)
    rate = before = np.ones(60)
    for k in range(40):
        y = rate + k / (k + 3) * (rate - before)
        g = whiten @ ((y * n) @ p - wanted)
        rate, before = np.maximum(0, y - p @ g), rate
    assert np.allclose(got, rate, atol=1e-9)
    assert np.abs((got * n) @ p / wanted - 1).max() < 0.05
