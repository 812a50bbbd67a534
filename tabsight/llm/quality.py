"""Quality rules in Spark expressions only.

Base rules count words, symbols, repeated lines and repeated word windows of
each text.  The verdict on what passes them is a hashed n-gram log-likelihood
ratio: word 1- and 2-grams are hashed into a fixed number of buckets, one
smoothed multinomial is counted over the trusted target (documents labelled
as good), one over the whole raw corpus, and a text scores the mean log ratio
of its n-grams.  Log ratios are rounded to whole micro-nats, so sums are exact
in any order and the threshold decides alike on every run.

Both multinomials count whole tables: the trusted one every trusted document,
the raw one the corpus.  Only the bucket table (``2 * buckets`` rows) is always
broadcast; trusted ids meet their documents by one exchange of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, SPACES, cut_lineage, row_key, text_rows, whole_rows, words_of

BUCKETS = 1 << 14
SMOOTHING = 1.0
THRESHOLD = -0.25
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
WINDOW = 3
_MICRO = 1_000_000


def _repeated_words(rows: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` from ``words``: window hashes are sorted with
    their positions, equal neighbours mark positions, covered words are added
    up over the gaps between marked positions (each step n log n)."""
    w, n = F.col("words"), F.col("n_words")
    windows = F.arrays_zip(*[F.slice(w, i + 1, F.greatest(n - (WINDOW - 1), F.lit(0))).alias(f"g{i}")
                             for i in range(WINDOW)]) \
        .cast("array<struct<" + ",".join(f"g{i}:string" for i in range(WINDOW)) + ">>")
    rows = rows.withColumn("win", F.transform(windows, lambda x: F.xxhash64(*[x[f"g{i}"] for i in range(WINDOW)])))
    repeats = F.size(F.array_distinct("win")) < F.size("win")
    rows = rows.withColumn("placed", F.when(repeats, F.sort_array(
        F.transform("win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    placed = F.col("placed")
    marked = F.transform(placed, lambda o, k: F.when(
        (F.get(placed, k - 1)["h"] == o["h"]) | (F.get(placed, k + 1)["h"] == o["h"]), o["i"]))
    rows = rows.withColumn("marked", F.sort_array(F.array_compact(marked)))
    m = F.col("marked")
    gaps = F.transform(m, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(m, k + 1) - v, F.lit(WINDOW))))
    return rows.withColumn("n_repeat_words", F.coalesce(
        F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))) \
        .drop("win", "placed", "marked")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, rid, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed; one row for every row of ``docs``.

    The counts (some numbers a row) are checkpointed: a condition on one of
    them would otherwise be pushed below the projections that build it, and
    its nested array expressions evaluated anew for every element."""
    rows = text_rows(docs).withColumn("rid", row_key()).withColumn("words", words_of(F.col("text"))) \
        .withColumn("n_words", F.size("words"))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{SPACES}]")))
    rows = rows.select(
        "doc_id", "rid", "words", "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    rows = _repeated_words(rows).drop("words")
    n = F.col("n_words").cast("long")
    return cut_lineage(rows.withColumn("n_words", n).withColumn(
        "base_failed", (n < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > MAX_REPEAT_PCT * n)))


def _grams(rows: DataFrame, *keep: str, buckets: int) -> DataFrame:
    """One row per 1-gram and 2-gram: its bucket (2-grams in the upper half)."""
    w = F.col("words")
    pairs = F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))).alias("b")) \
        .cast("array<struct<a:string,b:string>>")
    each = rows.select(*keep, F.explode(pairs).alias("g"))
    one = F.pmod(F.xxhash64("g.a"), F.lit(buckets)).cast("int")
    two = F.when(F.col("g.b").isNotNull(), (F.pmod(F.xxhash64("g.a", "g.b"), F.lit(buckets)) + buckets).cast("int"))
    return each.select(*keep, F.explode(F.array(one, two)).alias("bucket")).filter("bucket is not null")


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS,
                   smoothing: float = SMOOTHING) -> DataFrame:
    """``bucket, weight``: micro-nats of log P(bucket | target) / P(bucket | raw).

    ``trusted`` holds the ``doc_id`` of the target documents (nulls and
    repeats are ignored); all of them are counted."""
    good = trusted.select(F.col("doc_id").cast("long").alias("_id")).filter("_id is not null")
    rows = text_rows(docs)
    # ids are hashed in their partition's task, which neither sorts texts nor sends all ids to every task
    target = rows.join(good.hint("shuffle_hash"), rows.doc_id == good["_id"], "left_semi")
    # a trusted document is counted on both sides
    sides = [_grams(side.select(words_of(F.col("text")).alias("words")), buckets=buckets)
             .select("bucket", F.lit(n).cast("long").alias("good")) for n, side in enumerate((rows, target))]
    counted = sides[0].unionByName(sides[1]).groupBy("bucket") \
        .agg(F.sum(1 - F.col("good")).alias("raw"), F.sum("good").alias("target")) \
        .withColumn("order", F.floor(F.col("bucket") / buckets))
    totals = counted.groupBy("order").agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    space = smoothing * buckets
    llr: Column = F.log((F.col("target") + smoothing) / (F.col("all_target") + space)) - \
        F.log((F.col("raw") + smoothing) / (F.col("all_raw") + space))
    return counted.join(totals, "order").select("bucket", F.round(llr * _MICRO).cast("long").alias("weight"))


def gram_scores(docs: DataFrame, weights: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, rid, total, n``: summed weights (micro-nats) and n-grams.

    ``weights`` has at most ``2 * buckets`` rows of twelve bytes, hence the
    broadcast.  Rows repeated as a whole are added up together, which leaves
    the mean as it is."""
    rows = text_rows(docs).withColumn("rid", row_key()) \
        .select("doc_id", "rid", words_of(F.col("text")).alias("words"))
    grams = _grams(rows, "doc_id", "rid", buckets=buckets)
    return grams.join(F.broadcast(weights), "bucket").groupBy("doc_id", "rid") \
        .agg(F.sum("weight").alias("total"), F.count("*").alias("n"))


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD,
          buckets: int = BUCKETS) -> DataFrame:
    """Base counts, ``base_failed``, ``score`` (mean log ratio in nats) and
    ``kept`` for every row of ``docs``.

    Null and empty texts have no words, fail the base rules and have a null
    score.  Null ids are judged like others (they are never trusted).
    Repeated rows are judged alike.  Without trusted rows every bucket weighs
    the same constant per order and the threshold applies to that.  Other
    columns are ignored.
    """
    scores = gram_scores(docs, bucket_weights(docs, trusted, buckets), buckets) \
        .select(F.col("doc_id").alias("_d"), F.col("rid").alias("_r"), "total", "n")
    joined = base_counts(docs).join(
        scores, (F.col("rid") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    passes = F.col("total") >= F.lit(round(threshold * _MICRO)).cast("long") * F.col("n")
    return joined.select(
        "doc_id", "rid", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(passes, F.lit(False))).alias("kept"),
        (F.col("total") / F.col("n") / _MICRO).alias("score"))


def drop_rejected(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD,
                  buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` (all columns) that :func:`judge` keeps."""
    good = judge(docs, trusted, threshold, buckets).filter("kept") \
        .select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_d"), F.col("rid").alias("_r")).distinct()
    return whole_rows(docs).join(good, (F.col("key_id") == F.col("_d")) & (F.col("key_rid") == F.col("_r")),
                                 "left_semi").select("row.*")
