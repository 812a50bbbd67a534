"""Quality rules, URL filters, secret scans and decontamination."""

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402

from tabsight.llm import decontaminate, quality, secrets, urls  # noqa: E402

SF = "/root/testdata/sf0.001"
BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
SECRET = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(7) for c in ("rid", "words", "n_words", "bucket", "kind", "start", "end", "h", "item_id")} |
        {"source": F.lit(None).cast("string"), "lang": F.lit("en")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


QUALITY = brute.EDGE + [
    (20, "\n \n x\n\nx\n x"), (21, "a b c " * 40 + "\na b\na b\n"), (22, "#*$%&|<> " * 60),
    (23, " ".join(f"v{i}" for i in range(80)) + "\nv1 v2 v3"), (24, "é ü " * 100)]


def test_base_counts(spark, docs, rows):
    brute.same(quality.base_counts(docs).select(*BASE).collect(), brute.base_counts(rows))
    brute.same(quality.base_counts(table(spark, QUALITY)).select(*BASE).collect(), brute.base_counts(QUALITY))


def test_quality_verdict_by_hand(spark):
    """The log ratio of hashed 1- and 2-grams, from counts made in Python."""
    import math
    good = [(i, " ".join(f"g{(i * 7 + k) % 90}" for k in range(70))) for i in range(20)]
    junk = [(i, " ".join(f"j{(i * 5 + k * k) % 90}" for k in range(70))) for i in range(20, 30)]
    d = table(spark, good + junk)
    trusted = spark.createDataFrame([(i,) for i in range(0, 20, 2)] + [(None,), (0,)], "doc_id long")
    buckets = 512
    got = {r.doc_id: r for r in quality.judge(d, trusted, buckets=buckets).collect()}
    grams = sorted({g for _, t in good + junk for w in [t.split()]
                    for g in [(x, None) for x in w] + list(zip(w, w[1:]))}, key=str)
    frame = spark.createDataFrame(grams, "a string, b string").select(
        "a", "b", F.when(F.col("b").isNull(), F.pmod(F.xxhash64("a"), F.lit(buckets)))
        .otherwise(F.pmod(F.xxhash64("a", "b"), F.lit(buckets)) + buckets).alias("k"))
    where = {(r.a, r.b): r.k for r in frame.collect()}
    raw, target = [0] * (2 * buckets), [0] * (2 * buckets)
    of = {}
    for i, t in good + junk:
        w = t.split()
        of[i] = [where[g] for g in [(x, None) for x in w] + list(zip(w, w[1:]))]
        for k in of[i]:
            raw[k] += 1
            target[k] += i < 20 and i % 2 == 0
    sums = [(sum(raw[o * buckets:(o + 1) * buckets]), sum(target[o * buckets:(o + 1) * buckets])) for o in (0, 1)]
    for i, ks in of.items():
        llr = [math.log((target[k] + 1) / (sums[k // buckets][1] + buckets)) -
               math.log((raw[k] + 1) / (sums[k // buckets][0] + buckets)) for k in ks]
        assert got[i].score == pytest.approx(sum(llr) / len(llr), abs=1e-5)
        assert got[i].kept == (not got[i].base_failed and got[i].score >= quality.THRESHOLD)
    assert all(got[i].kept for i in range(20)) and not any(got[i].kept for i in range(20, 30))


def test_quality_edges(spark):
    d = table(spark, QUALITY)
    none = spark.createDataFrame([], "doc_id long")
    assert quality.judge(d, none).count() == len(QUALITY)
    assert quality.judge(d.filter("false"), none).count() == 0
    kept = quality.drop_rejected(d, spark.createDataFrame([(23,)], "doc_id long"))
    assert kept.columns == d.columns


def test_every_trusted_document_counts(spark):
    """However many ids are trusted, none of their documents is left out."""
    d = table(spark, [(i, f"w{i} common") for i in range(40)] + [(None, "w0 common"), (3, "w3 common")])
    few = spark.createDataFrame([(i,) for i in range(40)], "doc_id long")
    many = spark.range(60_000).select(F.col("id").alias("doc_id"))
    want = sorted(map(tuple, quality.bucket_weights(d, few, buckets=256).collect()))
    assert sorted(map(tuple, quality.bucket_weights(d, many, buckets=256).collect())) == want


URLS = [
    (1, "http://A.Example.NET/en/1?x#y"), (2, "https://net/"), (3, "https://x.net"), (4, "http://net"),
    (5, "http://example.com/de/"), (6, "http://aexample.com/de/1"), (7, "HTTP://WWW.ÄB.org/fr/x"),
    (8, None), (9, ""), (10, "no scheme"), (11, "ftp://spam-a.example.org/en/7.html?u=1"),
    (12, "http://www.spam-a.example.org/en/7/"), (13, "http://h:80/p"), (None, "a://b://c/d"),
    (14, "http://m.spam-a.example.org/en/7"), (15, "http://other.example.org/en/7"), (1, "http://A.Example.NET/en/1?x#y"),
    (16, "x://example.net/en"), (17, "x://sub.example.net/en/"), (18, "http://q.com#/a://b"), (19, "://h\n/p")]


def by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return rest[:cut].translate(brute.LOWER), tail[:end]


def test_urls(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "block", "b0")})
    listed = urls.listed_hosts(pages.filter("page_id = 11"), r"(^|\.)spam")
    got = urls.judge(pages, listed, max_blocks=1).collect()
    assert len(got) == len(URLS)
    brute.same([(r.page_id, r.host, r.path) for r in got], [(i, *by_hand(u)) for i, u in URLS])
    verdict = {r.page_id: (r.rule, r.verdict) for r in got}
    assert verdict[1] == ("example.net/en/", "allow") and verdict[2] == ("net/", "block")
    assert verdict[3] == (None, "allow") and verdict[4] == (None, "allow")
    assert verdict[5] == ("example.com/de/", "block") and verdict[6] == (None, "allow")
    assert verdict[7] == ("org/fr/", "allow") and verdict[16] == ("net/", "block")
    assert [verdict[k][1] for k in (11, 12, 14, 15)] == ["block", "block", "block", "allow"]
    assert verdict[8] == verdict[9] == verdict[10] == (None, "allow")
    empty = listed.filter("false")
    assert all(r.verdict == "allow" for r in urls.judge(pages, empty).filter("rule is null").collect())
    assert urls.judge(pages.filter("false"), listed).count() == 0


def test_bloom_has_no_false_negative(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h/"), F.col("id")).alias("canonical"))
    blocks = urls.bloom_blocks(listed, 64)
    asked = spark.range(6000).select(F.concat(F.lit("h/"), F.col("id")).alias("canonical"), "id")
    got = urls.probe(asked, blocks, 64, broadcast=True).groupBy(F.col("id") < 3000, "possible").count().collect()
    counts = {(r[0], r[1]): r[2] for r in got}
    assert counts[(True, True)] == 3000 and counts.get((False, True), 0) < 1500


SECRETS = brute.EDGE + [
    (30, 'token=secret: "abcdefgh12" token: a password=12345678 Secret="é'),
    (31, "é AKIA12345678901234 " + "a1" * 20 + " ghp_Abcdef0123456789abcdef012345"),
    (31, "é AKIA12345678901234 " + "a1" * 20 + " ghp_Abcdef0123456789abcdef012345"),
    (None, "api_key = 12345678"), (32, 'secret=token: 12345678 PASSWD:"aaaaaaaaa'),
    (33, "AKIA" * 3 + "AKIAAKIAX AKIA1234567890123"), (34, "x" * 5000 + "ApiKey='" + "0f" * 30),
    (35, "ABCDEF0123456789ABCDEF0123456789 plain")]


def test_secrets(spark, docs, rows):
    brute.same(secrets.scan(docs).select(*SECRET).collect(), brute.base_secrets(rows))
    got = secrets.scan(table(spark, SECRETS))
    brute.same(got.select(*SECRET).collect(), brute.base_secrets(SECRETS))
    spans = {r.doc_id: r.spans for r in got.collect()}
    assert spans[31].endswith(",owned:62:94") and spans[1] == ""
    assert secrets.scan(table(spark, SECRETS).filter("false")).count() == 0


def test_ownership_separates_examples(spark):
    rows = [(i, f"see password=example12345 and token=own{i:09d}", f"owner{i}", "en") for i in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string") \
        .withColumn("n_chars", F.length("text").cast("long"))
    found = secrets.find_secrets(d).collect()
    assert {(r.owners, r.live) for r in found} == {(10, False), (1, True)}
    masked = secrets.mask(d)
    assert masked.columns == d.columns
    for r in masked.collect():
        assert r.text == "see password=example12345 and [SECRET]" and r.n_chars == len(r.text)


def test_decontamination(spark, docs, rows):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, decontaminate.normalise(r.text.encode())) for r in bench.collect()]
    texts = [(i, decontaminate.normalise(t.encode())) for i, t in rows]
    exact = {(i, k) for i, t in texts for k, item in items if item in t}
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(docs, bench).collect()}
    assert exact and exact <= set(got)
    assert {p for p, e in got.items() if e == 0} == exact
    # edited items, against the full dynamic programme
    rnd = random.Random(5)
    made = []
    for n in range(40):
        item = bytearray(rnd.choice(items)[1])
        for _ in range(rnd.randint(0, int(0.12 * len(item)))):
            p, how = rnd.randrange(len(item)), rnd.random()
            if how < 0.4:
                item[p:p + 1] = rnd.choice("abcxyz").encode()
            elif how < 0.7:
                del item[p]
            else:
                item[p:p] = rnd.choice("abcxyz").encode()
        made.append((n, (texts[n][1][:150] + b" " + bytes(item) + b" tail").decode("utf-8", "ignore")))
    made += [(100, None), (101, ""), (None, items[0][1].decode()), (None, "clean"), (102, items[0][1].decode().upper())]
    d = table(spark, made)
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(d, bench).collect()}
    want = {}
    for i, t in made:
        t = decontaminate.normalise((t or "").encode())
        for k, item in items:
            budget = decontaminate.edit_budget(len(item))
            if len(t) >= len(item) - budget and any(item[x:x + 10] in t for x in range(len(item) - 9)):
                e = brute.substring_distance(item, t)
                if e <= budget:
                    want[i, k] = e
    assert got == want and (None, items[0][0]) in got
    kept = decontaminate.drop_contaminated(d, bench)
    assert kept.columns == d.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert (None, "clean") in left and all((i, t) not in left for i, t in made if any(i == a for a, _ in want) and i is not None)
    assert decontaminate.contaminated(d.filter("false"), bench).count() == 0
    assert decontaminate.contaminated(d, bench.filter("false")).count() == 0


def test_short_and_long_items(spark):
    long_item = " ".join(f"lw{i * i}" for i in range(300))
    bench = spark.createDataFrame([(1, "tiny"), (2, long_item), (3, None), (4, "")], "item_id long, text string")
    d = table(spark, [(1, "a tiny word"), (2, "tinyish"), (3, "pre " + long_item[300:1400] + " post"), (4, "none")])
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, bench).collect()} == {(1, 1), (3, 2)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, bench, block_bytes=1000).collect()} == {(1, 1), (3, 2)}
