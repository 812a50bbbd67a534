"""Column roles, business domain and analysis suggestions over a catalog.

The reference looks at one table; here the same rules run over a catalog of
many tables at once -- a DataFrame ``(table, column, ordinal, dtype, family,
...)`` -- so a warehouse of thousands of tables is classified by one job.
Facts that need data (distinct and missing counts) are computed by Spark over
the full tables.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from ..functions.scalars import ref

from ..functions.scalars import DATETIME, NUMBER, TEXT, family_of
from . import stats as S

# Keywords that score a business domain when a column name
# contains them, per domain, in declaration order (ties go to the earlier
# domain).
DOMAIN_KEYWORDS = {
    "sales": ["sale", "revenue", "customer", "product", "order", "transaction", "price", "discount"],
    "marketing": ["campaign", "cost", "conversion", "click", "impression", "lead", "channel", "ad",
                  "segment"],
    "operations": ["inventory", "supply", "demand", "logistics", "shipping", "warehouse",
                   "production", "capacity"],
    "finance": ["profit", "loss", "expense", "budget", "cost", "revenue", "account", "balance",
                "payment"],
    "hr": ["employee", "salary", "performance", "department", "hire", "attrition", "training",
           "recruitment"],
    "customer_service": ["ticket", "issue", "resolution", "satisfaction", "support", "feedback",
                         "complaint", "response"],
}

# A column whose name contains one of these is an entity column.
ENTITY_KEYWORDS = ["id", "name", "code", "key", "number"]

CATALOG_SCHEMA = "table string, column string, ordinal int, dtype string, family string"


def column_catalog(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, column, ordinal, dtype, family) from the schemas (no job)."""
    rows = [(t, f.name, i, f.dataType.simpleString(), family_of(f.dataType))
            for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def table_rows(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows): one count per table, which Parquet answers from its footers."""
    out = None
    for t, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def catalog_with_rows(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The catalog with each table's row count; no column is read."""
    return column_catalog(spark, tables).join(table_rows(spark, tables), "table", "left")


def catalog_facts(spark: SparkSession, tables: Mapping[str, DataFrame],
                  approx: bool = False) -> DataFrame:
    """The catalog plus rows, missing and distinct counts read from the data.

    One aggregate pass per table for rows and missing values, and one exchange
    per column type for the distinct counts of all tables.  The result has one
    row per catalog column (metadata-sized), so it is checkpointed once:
    classification, domain scoring and suggestions then read it without
    re-scanning the tables.
    """
    from ..functions.aggregates import count_missing
    from ..functions.scalars import is_missing, nan_to_null

    from .profile import long_text_columns

    facts, plain, hashed, numbers = None, [], [], []
    for t, df in tables.items():
        cols = list(df.columns)
        # long texts are counted hash-first (see stats.unique_counts)
        long = [] if approx else long_text_columns(
            df, [c for c in cols if family_of(df.schema[c].dataType) == TEXT])
        wide = df.agg(F.count(F.lit(1)).alias("rows"),
                      *[count_missing(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)],
                      *[F.approx_count_distinct(nan_to_null(df, c)).alias(f"u{i}") for i, c in enumerate(cols)
                        if approx])
        none = F.lit(None).cast("bigint")
        entries = [F.struct(F.lit(t).alias("table"), F.lit(c).alias("column"),
                            F.col("rows").alias("rows"), F.col(f"m{i}").cast("bigint").alias("missing"),
                            (F.col(f"u{i}").cast("bigint") if approx else none).alias("_u"))
                   for i, c in enumerate(cols)]
        part = wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
        facts = part if facts is None else facts.unionByName(part)
        mine = {c: len(numbers) + i for i, c in enumerate(cols)}
        numbers += [(n, t, c) for c, n in mine.items()]
        if not approx and len(long) < len(cols):
            plain.append((df, {c: n for c, n in mine.items() if c not in long}))
        if long:
            hashed.append(S.unique_counts(df, long, hash_texts=long)
                          .select(F.lit(t).alias("table"), "column", F.col("n_unique").alias("n")))
    found = None
    if plain:
        names = spark.createDataFrame(numbers, "cid int, table string, column string")
        found = names.join(S.distinct_counts(plain), "cid").select("table", "column", "n")
    for part in hashed:
        found = part if found is None else found.unionByName(part)
    if found is None:
        facts = facts.withColumnRenamed("_u", "n_unique")
    else:
        facts = facts.join(found, ["table", "column"], "left").select(
            "table", "column", "rows", "missing", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_unique"))
    out = column_catalog(spark, tables).join(facts, ["table", "column"], "left")
    return out.checkpoint(eager=True)


def classify_columns(catalog: DataFrame) -> DataFrame:
    """Roles: metric (number), dimension (text), time (datetime), entity (name
    contains an entity keyword).  ``role`` is the main role of the column."""
    name = F.lower(F.col("column"))
    entity = F.lit(False)
    for k in ENTITY_KEYWORDS:
        entity = entity | name.contains(k)
    fam = F.col("family")
    return catalog.select(
        "*",
        (fam == NUMBER).alias("is_metric"), (fam == TEXT).alias("is_dimension"),
        (fam == DATETIME).alias("is_time"), entity.alias("is_entity"),
        F.when(fam == DATETIME, "time").when(fam == NUMBER, "metric")
         .when(fam == TEXT, "dimension").otherwise("other").alias("role"))


def _keyword_table(spark: SparkSession) -> DataFrame:
    rows = [(d, i, k) for i, (d, ks) in enumerate(DOMAIN_KEYWORDS.items()) for k in ks]
    return spark.createDataFrame(rows, "domain string, domain_ordinal int, keyword string")


def detect_domain(catalog: DataFrame, purpose: str | None = None) -> DataFrame:
    """(table, domain, score) -- best keyword score per table, else unknown.

    Every (column, domain, keyword) hit scores one point.  The keyword table is
    a fixed list of about fifty words, broadcast to the catalog.  A domain
    named in ``purpose`` overrides the score.
    """
    spark = catalog.sparkSession
    kw = F.broadcast(_keyword_table(spark))
    hits = catalog.join(kw, F.lower(catalog["column"]).contains(kw["keyword"]), "inner")
    scores = hits.groupBy("table", "domain", "domain_ordinal").agg(F.count(F.lit(1)).alias("score"))
    best = scores.groupBy("table").agg(
        F.min(F.struct((-F.col("score")).alias("neg"), F.col("domain_ordinal").alias("o"),
                       F.col("domain").alias("d"))).alias("b"))
    out = catalog.select("table").distinct().join(best, "table", "left").select(
        "table", F.coalesce(F.col("b.d"), F.lit("unknown")).alias("domain"),
        F.coalesce(-F.col("b.neg"), F.lit(0)).cast("bigint").alias("score"))
    if purpose:
        text = purpose.lower()
        named = next((d for d in DOMAIN_KEYWORDS if d in text), None)
        if named:
            out = out.withColumn("domain", F.lit(named))
    return out


def suggest_analyses(roles: DataFrame, domains: DataFrame, series_metrics: int = 3,
                     breakdown_metrics: int = 2, correlated: int = 5, distributions: int = 3,
                     grouped_metrics: int = 2, grouped_dimensions: int = 2) -> DataFrame:
    """Analysis suggestions per table from the column roles and the domain.

    (table, seq, analysis, metrics, dimensions, aggregation): descriptive;
    time_series (the first ``series_metrics`` metrics over the first time
    column); breakdown by each of the first two dimensions (the first
    ``breakdown_metrics`` metrics); correlation (the first ``correlated``
    numbers); distribution (the first ``distributions``); pareto (sales tables
    with product and revenue columns); comparison (marketing tables with
    campaign and conversion columns); grouping (the first ``grouped_metrics``
    metrics by the first ``grouped_dimensions`` dimensions, mean).  The
    arguments say how many columns a *suggestion* names (fixed values of the
    rule by default); running an analysis takes any number.
    """
    def names(flag):
        return F.transform(F.sort_array(F.collect_list(F.when(ref(flag), F.struct("ordinal", "column")))),
                           lambda s: s["column"])

    def named(word):
        return F.try_element_at(F.filter(F.sort_array(F.collect_list(F.struct("ordinal", "column"))),
                                         lambda s: F.lower(s["column"]) == word), F.lit(1))["column"]

    per = roles.groupBy("table").agg(
        names("is_metric").alias("m"), names("is_dimension").alias("dm"), names("is_time").alias("tm"),
        named("product").alias("product"), named("revenue").alias("revenue"),
        named("campaign").alias("campaign"), named("conversion").alias("conversion"))
    per = per.join(domains.select("table", "domain"), "table", "left")
    m, dm, tm = F.col("m"), F.col("dm"), F.col("tm")
    has_m = F.size(m) > 0
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")

    def item(seq, name, keep, metrics, dims, agg=none):
        return F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("analysis"), keep.alias("keep"),
                        metrics.cast("array<string>").alias("metrics"),
                        dims.cast("array<string>").alias("dimensions"), agg.alias("aggregation"))

    items = F.array(
        item(0, "descriptive", has_m, m, empty),
        item(1, "time_series", has_m & (F.size(tm) > 0), F.slice(m, 1, series_metrics), F.slice(tm, 1, 1)),
        item(2, "breakdown", has_m & (F.size(dm) > 0), F.slice(m, 1, breakdown_metrics), F.slice(dm, 1, 1)),
        item(3, "breakdown", has_m & (F.size(dm) > 1), F.slice(m, 1, breakdown_metrics), F.slice(dm, 2, 1)),
        item(4, "correlation", F.size(m) >= 2, F.slice(m, 1, correlated), empty),
        item(5, "distribution", has_m, F.slice(m, 1, distributions), empty),
        item(6, "pareto", (F.col("domain") == "sales") & F.col("product").isNotNull()
             & F.col("revenue").isNotNull(), F.array(F.col("revenue")), F.array(F.col("product"))),
        item(7, "comparison", (F.col("domain") == "marketing") & F.col("campaign").isNotNull()
             & F.col("conversion").isNotNull(), F.array(F.col("conversion")), F.array(F.col("campaign"))),
        item(8, "grouping", has_m & (F.size(dm) > 0), F.slice(m, 1, grouped_metrics), F.slice(dm, 1, grouped_dimensions),
             F.lit("mean")),
    )
    return (per.select("table", F.explode(items).alias("s")).where(F.col("s.keep"))
            .select("table", "s.seq", "s.analysis", "s.metrics", "s.dimensions", "s.aggregation"))


# ------------------------------------------------------------- dispatch

def run_analysis(df: DataFrame, config: dict) -> dict:
    """Run one suggested analysis: {"type", "data": DataFrame | None, ...}.

    Every metric and dimension of the config is used: grouping, pareto and
    comparison of several metrics come in long form, with a ``metric`` column.
    Unknown types return no data, like the reference.
    """
    from . import series as SE
    from . import correlation as C
    from . import grouped as G
    from . import timeseries as TS

    typ = config.get("type")
    metrics = list(config.get("metrics") or [])
    dims = list(config.get("dimensions") or [])
    params = config.get("parameters") or {}
    out = {"type": typ, "data": None}
    if typ == "descriptive":
        out.update(data=S.descriptive(df, metrics), box=S.box_stats(df, metrics))
    elif typ == "time_series":
        res = TS.time_series(df, dims[0], metrics, params.get("frequency", "auto"))
        out.update(res)
    elif typ == "correlation":
        corr = C.correlation(df, metrics)
        out.update(data=corr, top=C.top_correlations(corr))
    elif typ == "breakdown":
        data = G.breakdown(df, dims[0], metrics)
        out.update(data=data, extremes=G.extremes(data, dims[0], metrics))
    elif typ == "distribution":
        out.update(data=S.describe(df, metrics), shape=S.distribution(df, metrics),
                   histograms={m: SE.histogram(df, m) for m in metrics})
    elif typ == "grouping":
        agg = params.get("aggregation", "mean")
        if len(dims) == 2 and len(metrics) == 1:
            out["data"] = G.pivot_aggregate(df, dims[0], dims[1], metrics[0], agg)
        elif len(dims) == 2:
            out["data"] = G.pivot_metrics(df, dims[0], dims[1], metrics, agg)
        elif len(dims) > 2:
            out["data"] = G.group_aggregate(df, dims, metrics, agg)
        else:
            out["data"] = G.group_aggregate(df, dims[:1], metrics, agg)
    elif typ == "pareto":
        if len(metrics) == 1:
            p = G.pareto(df, dims[0], metrics[0])
            out.update(data=p, summary=G.pareto_summary(p))
        else:
            each = {m: G.pareto(df, dims[0], m).withColumnRenamed(m, "value") for m in metrics}
            out.update(data=G.per_metric(metrics, each.get),
                       summary=G.per_metric(metrics, lambda m: G.pareto_summary(each[m])))
    elif typ == "comparison":
        out["data"] = G.comparison(df, dims[0], metrics[0]) if len(metrics) == 1 \
            else G.comparison_metrics(df, dims[0], metrics)
    return out
