"""Domain detection, roles and suggestions on small hand-made schemas."""

from pyspark.sql import functions as F

from tabsight.operators import catalog as K
from tabsight.operators import stats as S


def frames(spark):
    return {
        "sales": spark.createDataFrame([], "order_id bigint, order_date timestamp_ntz, customer string, "
                                           "product string, revenue double, price double, discount double"),
        "marketing": spark.createDataFrame([], "campaign string, channel string, segment string, click bigint, "
                                               "impression bigint, cost double, conversion double"),
        "operations": spark.createDataFrame([], "warehouse string, inventory bigint, demand bigint, "
                                                "shipping double, capacity bigint"),
        "finance": spark.createDataFrame([], "account string, profit double, loss double, expense double, "
                                             "budget double, balance double"),
        "hr": spark.createDataFrame([], "employee_id bigint, department string, salary double, "
                                        "performance double, hire_date timestamp_ntz"),
        "customer_service": spark.createDataFrame([], "ticket_id bigint, issue string, resolution double, "
                                                      "satisfaction double, response double"),
        "plain": spark.createDataFrame([], "a bigint, b string"),
    }


def test_detect_domain(spark):
    cat = K.column_catalog(spark, frames(spark))
    got = {r["table"]: r["domain"] for r in K.detect_domain(cat).collect()}
    assert got == {"sales": "sales", "marketing": "marketing", "operations": "operations",
                   "finance": "finance", "hr": "hr", "customer_service": "customer_service",
                   "plain": "unknown"}


def test_purpose_overrides_score(spark):
    cat = K.column_catalog(spark, {"sales": frames(spark)["sales"]})
    assert K.detect_domain(cat, "a finance ledger").first()["domain"] == "finance"


def test_roles_and_entities(spark):
    cat = K.classify_columns(K.column_catalog(spark, {"hr": frames(spark)["hr"]}))
    roles = {r["column"]: (r["role"], r["is_entity"]) for r in cat.collect()}
    assert roles["employee_id"] == ("metric", True)
    assert roles["department"] == ("dimension", False)
    assert roles["hire_date"] == ("time", False)


def test_suggestions_for_sales_and_marketing(spark):
    fr = frames(spark)
    cat = K.column_catalog(spark, {"sales": fr["sales"], "marketing": fr["marketing"]})
    sugg = K.suggest_analyses(K.classify_columns(cat), K.detect_domain(cat)).collect()
    by = {(r["table"], r["seq"]): r for r in sugg}
    assert by[("sales", 6)]["analysis"] == "pareto"
    assert by[("sales", 6)]["metrics"] == ["revenue"] and by[("sales", 6)]["dimensions"] == ["product"]
    assert by[("sales", 1)]["dimensions"] == ["order_date"]
    assert by[("sales", 1)]["metrics"] == ["order_id", "revenue", "price"]
    assert by[("marketing", 7)]["analysis"] == "comparison"
    assert by[("marketing", 8)]["dimensions"] == ["campaign", "channel"]
    assert ("marketing", 1) not in by  # no time column


def test_catalog_facts_with_long_texts(spark):
    from conftest import SF_SMALL
    from tabsight.plans.tables import load
    docs = load(spark, SF_SMALL, "documents")
    facts = {r["column"]: r["n_unique"] for r in K.catalog_facts(spark, {"documents": docs}).collect()}
    exact = docs.agg(*[F.count_distinct(c).alias(c) for c in docs.columns]).first().asDict()
    assert facts == exact


def test_run_analysis_dispatch(spark):
    from conftest import SF_SMALL
    from tabsight.plans.tables import load
    orders = load(spark, SF_SMALL, "orders")
    par = K.run_analysis(orders, {"type": "pareto", "metrics": ["o_totalprice"], "dimensions": ["o_custkey"]})
    assert par["data"].count() == orders.select("o_custkey").distinct().count()
    assert par["summary"].first()["total_items"] == par["data"].count()
    cmp_ = K.run_analysis(orders, {"type": "comparison", "metrics": ["o_totalprice"],
                                   "dimensions": ["o_orderpriority"]})
    assert cmp_["data"].count() == 5
    one = K.run_analysis(orders, {"type": "grouping", "metrics": ["o_totalprice"],
                                  "dimensions": ["o_orderstatus"], "parameters": {"aggregation": "median"}})
    assert one["data"].count() == 3
    assert K.run_analysis(orders, {"type": "no_such_analysis"})["data"] is None


def test_distinct_counts_of_many_types_and_tables(spark):
    """Columns of one type share a narrow exchange; each keeps its own count."""
    one = spark.createDataFrame(
        [(1, 1, 0.0, "x", [1.0], True, None), (2, 1, -0.0, "x", [1.0], False, None), (1, 2, float("nan"), "y", [2.0], True, None),
         (None, 3, 1.5, None, None, None, None)],
        "a long, b int, `c.d` double, s string, e array<float>, f boolean, g string")
    two = spark.createDataFrame([(5, "x"), (5, "z"), (1, "x")], "a long, s string").withColumn("t", F.lit("2024-01-05").cast("date"))
    facts = {(r["table"], r["column"]): r["n_unique"] for r in K.catalog_facts(spark, {"one": one, "two": two}).collect()}
    assert facts == {("one", "a"): 2, ("one", "b"): 3, ("one", "c.d"): 2, ("one", "s"): 2, ("one", "e"): 2,
                     ("one", "f"): 2, ("one", "g"): 0, ("two", "a"): 2, ("two", "s"): 2, ("two", "t"): 1}
    counts = S.distinct_counts([(one, {"a": 0, "b": 1}), (two, {"a": 2})])
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
    assert {r["cid"]: r["n"] for r in counts.collect()} == {0: 2, 1: 3, 2: 2}
