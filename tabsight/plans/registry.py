"""Collects every registered query.

A query is ``(name, build, sql)``: ``build(spark, sf_dir) -> DataFrame`` and
the DuckDB oracle ``sql`` (``None`` where no SQL equivalent exists).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def all_queries() -> list[Query]:
    from . import (q_catalog, q_filters, q_grouped, q_prepare, q_profile, q_sources, q_stats,
                   q_time)
    out: list[Query] = []
    for mod in (q_grouped, q_stats, q_profile, q_prepare, q_time, q_catalog, q_filters, q_sources):
        out.extend(mod.QUERIES)
    names = [q.name for q in out]
    dupes = {n for n in names if names.count(n) > 1}
    if dupes:
        raise RuntimeError(f"duplicate query names: {sorted(dupes)}")
    return out
