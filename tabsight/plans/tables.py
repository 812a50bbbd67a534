"""Loading the driver tables and deriving the masked inputs used by queries.

Masks keep every row: they only blank values (``NULL``) or re-type a column,
so the work of every query grows with the table.  The same expression is
written in Spark and in the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ----- lineitem with missing values, numbers stored as text and a constant

def lineitem_dirty(spark: SparkSession, sf_dir: str, masks=(7, 4, 11),
                   with_shipdate: bool = False) -> DataFrame:
    """lineitem with values blanked in a fixed pattern (all rows kept)."""
    m_discount, m_tax, m_flag = masks
    li = load(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
        F.when(F.col("l_orderkey") % m_discount == 0, F.lit(None)).otherwise(F.col("l_discount"))
        .alias("l_discount"),
        F.when(F.col("l_orderkey") % m_tax == 0, F.lit(None)).otherwise(F.col("l_tax")).alias("l_tax"),
        "l_extendedprice",
        F.when(F.col("l_orderkey") % m_flag == 0, F.lit(None)).otherwise(F.col("l_returnflag"))
        .alias("l_returnflag"),
        "l_linestatus",
        F.when(F.col("l_linenumber") == 1, F.lit("x"))
        .otherwise(F.col("l_linenumber").cast("string")).alias("l_linenumber_text"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate_text"),
        *(["l_shipdate"] if with_shipdate else []),
    )


def lineitem_dirty_sql(masks=(7, 4, 11), with_shipdate: bool = False) -> str:
    m_discount, m_tax, m_flag = masks
    sql = LINEITEM_DIRTY_SQL
    if with_shipdate:
        sql = sql.replace("as l_shipdate_text\nfrom", "as l_shipdate_text, l_shipdate\nfrom")
    return sql.replace("% 7 ", f"% {m_discount} ").replace(
        "% 4 ", f"% {m_tax} ").replace("% 11 ", f"% {m_flag} ")


LINEITEM_DIRTY_SQL = """
select l_orderkey, l_partkey, l_linenumber, l_quantity,
       case when l_orderkey % 7 = 0 then null else l_discount end as l_discount,
       case when l_orderkey % 4 = 0 then null else l_tax end as l_tax,
       l_extendedprice,
       case when l_orderkey % 11 = 0 then null else l_returnflag end as l_returnflag,
       l_linestatus,
       case when l_linenumber = 1 then 'x' else cast(l_linenumber as varchar) end as l_linenumber_text,
       strftime(l_shipdate, '%Y-%m-%d') as l_shipdate_text
from lineitem
"""
