"""The end-to-end flow on one table: load, profile, prepare, understand, analyse.

Each step returns DataFrames (or small dicts of them); only the bounded step
and analysis lists come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from .functions.scalars import ref

from .operators import catalog as K
from .operators import prepare as R
from .operators import profile as P
from .sources import csv as CSV
from .sources import sampling as SMP


def load_csv(spark: SparkSession, path: str, sample: int | None = None,
             key: Sequence[str] | None = None) -> DataFrame:
    """Read a header CSV (pandas missing tokens, inferred types); optionally
    keep a reproducible sample of ``sample`` rows ordered by a hash of ``key``
    (all columns when no key is given)."""
    df = CSV.read_csv(spark, path)
    if sample:
        df = SMP.sample_rows(df, sample, list(key) if key else df.columns)
    return df


def profile_dataset(df: DataFrame, extra_suggestions: Sequence[dict] | None = None) -> dict:
    """{"profile", "issues", "suggestions"} for one table."""
    prof = P.profile(df)
    return {"profile": prof,
            "issues": P.quality_issues(df, prof),
            "suggestions": P.suggest_preprocessing(prof, extra_suggestions)}


def prepare(df: DataFrame, suggestions_or_steps) -> DataFrame:
    """Apply suggested steps (a suggestions DataFrame or a list of step dicts)."""
    steps = (P.to_steps(suggestions_or_steps) if isinstance(suggestions_or_steps, DataFrame)
             else list(suggestions_or_steps))
    return R.apply_pipeline(df, steps)


def business_context(df: DataFrame, purpose: str | None = None, name: str = "dataset") -> dict:
    """Roles of the columns and the domain of the table.

    {"roles": DataFrame, "domain": str, "key_metrics", "dimensions",
    "time_columns", "entity_columns"} -- the lists are column names (bounded
    by the schema).
    """
    spark = df.sparkSession
    cat = K.column_catalog(spark, {name: df})
    roles = K.classify_columns(cat)
    domain = K.detect_domain(cat, purpose).first()["domain"]
    rows = roles.orderBy("ordinal").collect()
    return {
        "roles": roles, "domain": domain,
        "key_metrics": [r["column"] for r in rows if r["is_metric"]],
        "dimensions": [r["column"] for r in rows if r["is_dimension"]],
        "time_columns": [r["column"] for r in rows if r["is_time"]],
        "entity_columns": [r["column"] for r in rows if r["is_entity"]],
    }


def suggest_analyses(df: DataFrame, purpose: str | None = None, name: str = "dataset") -> list[dict]:
    """Analysis configs for the table, ready for ``run_analysis``."""
    spark = df.sparkSession
    cat = K.column_catalog(spark, {name: df})
    sugg = K.suggest_analyses(K.classify_columns(cat), K.detect_domain(cat, purpose))
    configs = []
    for r in sugg.orderBy("seq").collect():
        cfg = {"type": r["analysis"], "metrics": list(r["metrics"]),
               "dimensions": list(r["dimensions"])}
        if r["aggregation"]:
            cfg["parameters"] = {"aggregation": r["aggregation"]}
        if r["analysis"] == "time_series":
            cfg["parameters"] = {"frequency": "auto"}
        configs.append(cfg)
    return configs


def run_analyses(df: DataFrame, configs: Sequence[dict]) -> list[dict]:
    """Run every config; each result holds lazy DataFrames."""
    return [K.run_analysis(df, c) for c in configs]


def first_rows(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    return SMP.preview(df, order_by, n)


def numeric_text_to_number(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Convert text columns flagged as numbers (``inconsistent_type``)."""
    from .functions.scalars import to_numeric
    return df.select(*[to_numeric(ref(c)).alias(c) if c in cols else ref(c)
                       for c in df.columns])
