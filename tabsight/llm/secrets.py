"""Secret scans in Spark expressions only.

Candidates are regular-expression matches with their code-point positions: a
text is split at its matches, and running sums over the lengths of pieces and
matches give each start (a window over the few match rows of a text, never
over texts).  Every candidate's value is hashed, and the corpus counts the
distinct repositories and owners that hold it.  A value found under many
owners is a copied example; one that keeps to one owner looks live.  Generic
tokens are added as spans only if they look live by that measure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, row_key, whole_rows

#: Kind, pattern, the shortest length that counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = [("assign", ASSIGN, 8), ("access", r"AKIA[A-Z0-9]+", 16), ("hex", r"[0-9a-f]+", 32)]
#: Added by the ownership measure: long tokens with letters and digits.
GENERIC = ("owned", r"[A-Za-z0-9+/_-]{24,}={0,2}", 24)
KINDS = ["assign", "access", "hex", "owned"]
EXAMPLE_OWNERS = 8
MASK = "[SECRET]"


def _matches(rows: DataFrame, kind: str, pattern: str, least: int) -> DataFrame:
    """(key columns, kind, start, end, value) of one pattern."""
    # a run shorter than the least length needs no row, except where its consumption matters (assign)
    finder = pattern if kind == "assign" else pattern.replace("]+", f"]{{{least - 4 if kind == 'access' else least},}}")
    found = rows.filter(F.col("text").rlike(finder))
    parts = F.arrays_zip(F.split("text", finder, -1).alias("piece"),
                         F.regexp_extract_all("text", F.lit(finder), F.lit(0)).alias("hit")) \
        .cast("array<struct<piece:string,hit:string>>")
    each = found.select("doc_id", "rid", "owner", "repository", F.posexplode(parts).alias("k", "x")) \
        .filter("x.hit is not null") \
        .select("doc_id", "rid", "owner", "repository", "k", F.length("x.piece").alias("gap"),
                F.col("x.hit").alias("hit"), F.length("x.hit").alias("n"))
    order = Window.partitionBy("doc_id", "rid", "owner", "repository", "copy").orderBy("k")
    # rows repeated as a whole give equal matches: keep one set of them
    once = each.dropDuplicates(["doc_id", "rid", "owner", "repository", "k"]).withColumn("copy", F.lit(0))
    value = F.regexp_extract("hit", pattern, 2) if kind == "assign" else F.col("hit")
    placed = once.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(order)) \
        .select("doc_id", "rid", "owner", "repository", F.lit(kind).alias("kind"),
                (F.col("end") - F.col("n")).alias("start"), "end", value.alias("value"))
    return placed.filter(F.length("value") >= least)


def candidates(docs: DataFrame, owner: str, repository: Column) -> DataFrame:
    """All base matches and generic tokens, one row each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
                       F.coalesce(repository.cast("string"), F.lit("")).alias("repository")) \
        .withColumn("rid", row_key())
    out = None
    for kind, pattern, least in [*PATTERNS, GENERIC]:
        got = _matches(rows, kind, pattern, least)
        if kind == GENERIC[0]:
            got = got.filter(F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]"))
        out = got if out is None else out.unionByName(got)
    return out


def ownership(found: DataFrame) -> DataFrame:
    """``h, owners, repositories`` of every candidate value, counted in two
    combining steps so that a value held everywhere stays small."""
    pairs = found.groupBy("h", "owner", "repository").agg(F.lit(1).alias("one"))
    per_owner = pairs.groupBy("h", "owner").agg(F.count("*").alias("r"))
    return per_owner.groupBy("h").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"))


def find_secrets(docs: DataFrame, owner: str = "source", repository: Column | None = None,
                 example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Spans ``doc_id, rid, kind, start, end, owners, repositories, live``.

    ``live`` is false where the value is held by ``example_owners`` owners or
    more.  Generic tokens appear only where exactly one owner holds them and
    they touch no base span."""
    repository = F.concat_ws("/", F.col(owner), F.col("lang")) if repository is None else repository
    found = candidates(docs, owner, repository).withColumn("h", F.xxhash64("value", F.length("value")))
    held = ownership(found).withColumnRenamed("h", "_h")
    spans = found.join(held, F.col("h") == F.col("_h")) \
        .withColumn("live", F.col("owners") < example_owners)
    spans = spans.groupBy("doc_id", "rid", "kind", "start", "end") \
        .agg(F.max("owners").alias("owners"), F.max("repositories").alias("repositories"),
             F.max("live").alias("live"))
    base = F.col("kind") != GENERIC[0]
    by = Window.partitionBy("doc_id", "rid").orderBy("start", "end", "kind")
    before = F.max(F.when(base, F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(by.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & \
        (F.coalesce(after, F.lit(2**31 - 1)) >= F.col("end"))
    return spans.withColumn("free", free) \
        .filter(base | (F.col("free") & (F.col("owners") == 1))).drop("free")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["o"] + 1), x["s"], x["e"])), ",")


def _per_document(spans: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    return spans.withColumn("o", order).groupBy("doc_id", "rid").agg(
        *[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in KINDS],
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sort_array(F.collect_list(F.struct(F.col("start").alias("s"), "o", F.col("end").alias("e"), "live"))).alias("all"))


def scan(docs: DataFrame, owner: str = "source", repository: Column | None = None,
         example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_assign, n_access, n_hex, base_sha256,
    spans, n_owned, n_live, live_spans``.

    Null and empty texts have no spans (empty strings, the digest of the empty
    string).  A null id, owner or language counts as its own (empty) value.
    Rows repeated as a whole are equal results.  Empty tables give an empty
    result; other columns are ignored.
    """
    per = _per_document(find_secrets(docs, owner, repository, example_owners)) \
        .withColumnsRenamed({"doc_id": "_d", "rid": "_r"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")) \
        .select("doc_id", row_key().alias("rid"))
    joined = rows.join(per, (F.col("rid") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    every = F.coalesce("all", F.array().cast("array<struct<s:bigint,o:int,e:bigint,live:boolean>>"))
    joined = joined.withColumn("all", every)
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id", *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(F.filter("all", lambda x: x["o"] < 3)), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"),
        F.coalesce("n_owned", zero).alias("n_owned"), F.coalesce("n_live", zero).alias("n_live"),
        _joined(F.filter("all", lambda x: x["live"])).alias("live_spans"))


def mask(docs: DataFrame, owner: str = "source", repository: Column | None = None,
         example_owners: int = EXAMPLE_OWNERS, label: str = MASK) -> DataFrame:
    """``docs`` with every live-looking span replaced by ``label``.

    All rows and columns stay; ``n_chars``, if there, is counted anew where a
    text changed.  Overlapping spans are replaced once, from the first start
    to the last end."""
    spans = find_secrets(docs, owner, repository, example_owners).filter("live")
    per = spans.groupBy("doc_id", "rid").agg(F.sort_array(F.collect_list(F.struct(
        F.col("start").cast("int").alias("s"), F.col("end").cast("int").alias("e")))).alias("__spans")) \
        .select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_d"), F.col("rid").alias("_r"), "__spans")
    joined = whole_rows(docs).join(per, (F.col("key_rid") == F.col("_r")) & (F.col("key_id") == F.col("_d")), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    old = F.col("row.text")

    def step(a, x):
        fresh = x["s"] >= a["at"]
        gap = F.substring(old, a["at"] + 1, x["s"] - a["at"])
        return F.struct(F.when(fresh, F.concat(a["out"], gap, F.lit(label))).otherwise(a["out"]).alias("out"),
                        F.greatest(a["at"], x["e"]).alias("at"))

    cut = F.aggregate("__spans", start, step, lambda a: F.concat(
        a["out"], F.substring(old, a["at"] + 1, F.length(old))))
    changed = F.col("__spans").isNotNull()
    out = joined.withColumn("__text", F.when(changed, cut).otherwise(old))
    cols = []
    for c, kind in docs.dtypes:
        value = F.col("row").getField(c)
        if c == "text":
            value = F.col("__text")
        elif c == "n_chars":
            value = F.when(changed, F.length("__text")).otherwise(value).cast(kind)
        cols.append(value.alias(c))
    return out.select(*cols)
