"""SimHash near-duplicates with multi-index hashing.

*Fingerprints* come from the JVM: word shingles (repeats included) are
exploded, hashed with XXH64 and added up, two bit counters to a long, with
map-side combining.

*Search.*  With ``distance`` = r and ``segments`` = m, two fingerprints within
r bits agree on some segment up to ``r // m`` bits.  Distinct fingerprints are
listed once per segment (the tables); each also enumerates the ball of that
radius around its own segment and fetches what the tables hold there.  Whole
distances are verified on the fetched pairs.  Copies share a fingerprint and
never meet as pairs.

*Groups* are connected components of the links; links go between distinct
fingerprints, and rows join them by fingerprint (a skewed join AQE can split).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, cut_lineage, row_key, text_rows, whole_rows, words_of
from .components import components

SHINGLE = 3
DISTANCE = 3
SEGMENTS = 2
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LANES = 0x0000000100000001


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def shingles_of(words: Column, size: int) -> Column:
    """Word shingles as structs; a shorter text is one shingle, no word none."""
    n = F.size(words)
    parts = [F.slice(words, i + 1, F.greatest(n - (size - 1), F.lit(0))) for i in range(size)]
    names = [f"w{i}" for i in range(size)]
    full = F.arrays_zip(*[p.alias(x) for p, x in zip(parts, names)])
    whole = F.array(F.struct(F.nullif(F.array_join(words, " "), F.lit("")).alias("w0"),
                             *[F.lit(None).cast("string").alias(x) for x in names[1:]]))
    return F.when(n >= size, full).otherwise(whole)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, rid, fp`` (a signed long), one row for every row of ``docs``."""
    names = [f"w{i}" for i in range(shingle)]
    rows = text_rows(docs).withColumn("rid", row_key()) \
        .withColumn("uid", F.monotonically_increasing_id()) \
        .withColumn("words", words_of(F.translate("text", _UPPER, _UPPER.lower())))
    fields = [F.col(f"s.{x}") for x in names] if shingle > 1 else [F.col("s.w0")]
    # arrays_zip names its fields by position when columns are expressions
    each = rows.select("uid", "doc_id", "rid", F.explode(shingles_of(F.col("words"), shingle)
                       .cast("array<struct<" + ",".join(f"{x}:string" for x in names) + ">>")).alias("s"))
    hashed = each.select("uid", "doc_id", "rid", F.when(
        F.col("s.w0").isNotNull(), F.xxhash64(F.concat_ws(" ", *fields))).alias("h"))
    sums = hashed.groupBy("uid", "doc_id", "rid").agg(
        F.count("h").alias("n"),
        *[F.sum(F.shiftright("h", j).bitwiseAND(F.lit(_LANES))).alias(f"c{j}") for j in range(32)])
    bits = []
    for j in range(32):
        low = F.col(f"c{j}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"c{j}", 32)
        bits.append(F.when(low * 2 > F.col("n"), F.lit(1 << j)).otherwise(F.lit(0)).cast("long"))
        bits.append(F.when(high * 2 > F.col("n"), F.lit(_signed(1 << (j + 32)))).otherwise(F.lit(0)).cast("long"))
    fp = bits[0]
    for b in bits[1:]:
        fp = fp.bitwiseOR(b)
    return sums.select("doc_id", "rid", fp.alias("fp"))


def _segment_bounds(segments: int) -> list[tuple[int, int]]:
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def ball(bits: int, radius: int) -> list[int]:
    """Masks of up to ``radius`` set bits among the lowest ``bits``."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def links(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """``a, b``: pairs of distinct fingerprints (a < b) within ``distance``."""
    radius = distance // segments
    bounds = _segment_bounds(segments)
    fps = prints.select("fp").distinct()

    def value(k: int) -> Column:
        lo, hi = bounds[k]
        part = F.shiftrightunsigned("fp", lo)
        return part if hi == 64 else part.bitwiseAND(F.lit((1 << (hi - lo)) - 1))

    table = fps.select("fp", F.posexplode(F.array(*[value(k) for k in range(segments)])).alias("k", "v"))
    masks = [(k, m) for k in range(segments) for m in ball(bounds[k][1] - bounds[k][0], radius)]
    near = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), value(k).bitwiseXOR(F.lit(_signed(m))).alias("v"))
        for k, m in masks])).alias("p")).select(F.col("fp").alias("a"), "p.k", "p.v")
    pairs = near.join(table.withColumnRenamed("fp", "b"), ["k", "v"]).filter("a < b")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    # a pair that agrees well enough on an earlier segment was fetched there already
    first = F.lit(True)
    for k, (lo, hi) in enumerate(bounds[:-1]):
        part = F.shiftrightunsigned(diff, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        first = first & ((F.col("k") <= k) | (F.bit_count(part) > radius))
    return pairs.filter((F.bit_count(diff) <= distance) & first).select("a", "b")


def groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE,
           segments: int = SEGMENTS) -> DataFrame:
    """``doc_id, rid, fp, root, component_id, in_group`` for every row of ``docs``.

    ``root`` is a fingerprint that tells the component from all others,
    ``component_id`` the smallest id reachable over links.  Texts without
    words (null and empty ones too) have fingerprint zero and link like any
    other.  Rows with a null id are grouped by their text but never name a
    group (a group of only such rows has a null id).  Repeated rows are equal
    fingerprints.  Empty tables give an empty result.
    """
    prints = cut_lineage(fingerprints(docs, shingle))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    roots = components(links(prints, distance, segments), "a", "b")
    placed = nodes.join(roots, nodes.fp == roots.node, "left") \
        .select("fp", F.coalesce("root", "fp").alias("root"), "least", "rows")
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"),
                                       F.sum("rows").alias("in_group")) \
        .withColumnRenamed("root", "_root")
    of_print = placed.join(names, F.col("root") == F.col("_root")) \
        .select(F.col("fp").alias("_fp"), "root", "component_id", "in_group")
    return prints.join(of_print, F.col("fp") == F.col("_fp")) \
        .select("doc_id", "rid", "fp", "root", "component_id", "in_group")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE,
                    segments: int = SEGMENTS) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row for every row of ``docs``."""
    return groups(docs, shingle, distance, segments).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "in_group")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE,
                         segments: int = SEGMENTS) -> DataFrame:
    """The rows of ``docs`` (all columns) less all but one row of each group.

    The row with the smallest id stays (a null id only where no other is
    there; then, or where an id repeats, the row with the smallest key of its
    content), and one of rows repeated as a whole.
    """
    found = groups(docs, shingle, distance, segments)
    last = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("d"), F.col("rid").alias("r"))
    # component_id may be null, and an id given twice may name two components
    chosen = found.groupBy("root").agg(F.min(last).alias("x")) \
        .select(F.coalesce("x.d", F.lit(NO_ID)).alias("_d"), F.col("x.r").alias("_r"))
    kept = whole_rows(docs).join(chosen, (F.col("key_id") == F.col("_d")) & (F.col("key_rid") == F.col("_r")),
                                 "left_semi")
    return kept.dropDuplicates(["key_id", "key_rid"]).select("row.*")
