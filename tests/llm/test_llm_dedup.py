"""Repeated passages, repeated windows and near-duplicates against brute force."""

import os
import random
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402

from tabsight.llm import bytesops as B  # noqa: E402
from tabsight.llm import components, simhash, substring_dedup, suffix_dedup  # noqa: E402

DOCS = "/root/testdata/sf0.001/documents.parquet"
OP3 = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
OP4 = ["doc_id", "n_words", "n_removed", "kept_sha256"]
OP9 = ["doc_id", "fingerprint", "component_id"]


def table(spark, rows):
    """Edge rows with columns whose names the operators use inside."""
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(7) for c in ("rid", "uid", "fp", "words", "spans", "bucket", "a", "b", "root")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(DOCS)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_repeated_bytes(docs, rows):
    brute.same(suffix_dedup.remove_repeats(docs).select(*OP3).collect(), brute.repeated_bytes(rows))


def test_repeated_windows(docs, rows):
    brute.same(substring_dedup.remove_repeated_windows(docs).select(*OP4).collect(), brute.repeated_words(rows))


def test_near_duplicates(docs, rows):
    brute.same(simhash.near_duplicates(docs).select(*OP9).collect(), brute.near_groups(rows))


def test_edge_rows(spark):
    d = table(spark, brute.EDGE)
    brute.same(suffix_dedup.remove_repeats(d).select(*OP3).collect(), brute.repeated_bytes(brute.EDGE))
    brute.same(substring_dedup.remove_repeated_windows(d).select(*OP4).collect(), brute.repeated_words(brute.EDGE))
    brute.same(simhash.near_duplicates(d).select(*OP9).collect(), brute.near_groups(brute.EDGE))


def test_empty_tables(spark):
    d = table(spark, brute.EDGE).filter("false")
    assert suffix_dedup.remove_repeats(d).count() == 0
    assert substring_dedup.remove_repeated_windows(d).count() == 0
    assert simhash.near_duplicates(d).count() == 0
    assert simhash.drop_near_duplicates(d).count() == 0


def test_long_text_crosses_chunks(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400_000)]
    text = " ".join(words)
    part = text[1_048_000:1_049_200]  # lies on the border of two chunks of bytes
    rows = [(1, text), (2, "start " + part + " end")]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(table(spark, rows)).collect()}
    assert (got[1].n_removed, got[1].n_spans) == (1200, 1)
    whole = [w for w in part.split(" ")[1:-1]]
    got = {r.doc_id: r for r in substring_dedup.remove_repeated_windows(table(spark, rows)).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == len(whole)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=120), min_size=1, max_size=12), st.integers(0, 3))
def test_suffix_groups(texts, rounds):
    data = np.frombuffer("".join(texts).encode() + b"a" * 24, dtype=np.uint8)
    start = np.arange(len(data) - 24)
    bucket = data[start].astype(np.int64)
    got = suffix_dedup.repeated_suffixes(data, start, bucket, 24, rounds)
    strings = [bytes(data[s:s + 24]) for s in start]
    assert got.tolist() == [strings.count(x) > 1 for x in strings]


def test_first_difference():
    data = np.frombuffer(b"abcdefghijkXabcdefghijkYabcdefghijkX" + b"\0" * 8, dtype=np.uint8)
    words = B.unaligned_words(data)
    got = B.first_difference(words, np.array([0, 0, 3]), np.array([12, 24, 15]), np.array([12, 12, 5]))
    assert got.tolist() == [11, 12, 5]


def test_ball_sizes():
    assert len(simhash.ball(32, 1)) == 33 and len(simhash.ball(16, 2)) == 1 + 16 + 120


def test_links_find_every_pair(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-2**63, 2**63 - 1, 30)
    prints = set(base.tolist())
    for f in base.tolist():
        for _ in range(4):
            g = f & (2**64 - 1)
            for b in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                g ^= 1 << b
            prints.add(g - 2**64 if g >= 2**63 else g)
    df = spark.createDataFrame([(f,) for f in prints], "fp long")
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    for segments in (2, 3, 4):
        got = [(r.a, r.b) for r in simhash.links(df, 3, segments).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_of_a_long_chain(spark):
    rng = np.random.default_rng(9)
    nodes = rng.permutation(300).tolist()
    edges = [(nodes[i], nodes[i + 1]) for i in range(299) if i != 150]
    got = {r.node: r.root for r in components.components(
        spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    want = {n: min(nodes[:151]) for n in nodes[:151]} | {n: min(nodes[151:]) for n in nodes[151:]}
    assert got == want


def test_one_of_each_group_stays(spark):
    d = table(spark, brute.EDGE)
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns
    groups = brute.near_groups(brute.EDGE)
    ids = [r.doc_id for r in kept.collect()]
    named = {g[2] for g in groups if g[2] is not None}
    assert sorted(i for i in ids if i is not None) == sorted(named)


def test_an_id_given_twice_does_not_merge_groups(spark):
    r = random.Random(11)
    a, b = (" ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(80)) for _ in range(2))
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b)], "doc_id long, text string")
    got = simhash.drop_near_duplicates(docs).collect()
    assert sorted((x.doc_id, x.text) for x in got) == sorted([(1, a), (1, b)])
