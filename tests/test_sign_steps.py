"""Queries on the signs over a table in one Parquet row group: many tasks, no method too long to compile, the rows of the SQL twin."""
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenscan.functions import arrays as A
from lumenscan.plans import driver_rule_queries  # noqa: F401  registers the queries
from lumenscan.plans.driver_queries import QUERIES
from lumenscan.plans.driver_tables import ROWS_PER_TASK
from test_queries import canon

LONGEST = 8000      # bytes: the JVM only interprets methods above
INTERPRETED = re.compile(r"filter\(array\(CASE WHEN")     # array_compact over conditions: Spark interprets them on every row
NAMES = ["sort_key", "override_and_second_opinion", "card_labels", "collagen_verdict", "readable_words", "explanation", "check_rows"]


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    path, con = tmp_path_factory.mktemp("signs"), duckdb.connect()
    con.sql(f"create table customer as select i::BIGINT as c_custkey from range(1, {2 * ROWS_PER_TASK} + 1) t(i)")
    con.sql(f"copy customer to '{path}/customer.parquet' (format parquet, row_group_size 1000000)")
    return str(path), con


@pytest.mark.parametrize("name", NAMES)
def test_tasks_methods_and_rows(spark, table, name):
    path, con = table
    fn, sql = QUERIES[name]
    df = fn(spark, path)
    assert df.rdd.getNumPartitions() >= 2
    debug = getattr(getattr(spark._jvm, "org.apache.spark.sql.execution.debug.package$"), "MODULE$")
    stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) <= LONGEST
    rel = con.sql(sql)
    assert canon(tuple(r) for r in df.select(*rel.columns).collect()) == canon(rel.fetchall())


@pytest.mark.parametrize("name", NAMES)
def test_lists_of_conditions_are_compiled(spark, table, name):
    plan = QUERIES[name][0](spark, table[0])._jdf.queryExecution().optimizedPlan().toString()
    assert len(INTERPRETED.findall(plan)) <= 3      # the short list of the soft tier, written out three times


def test_listed_keeps_what_holds_in_order(spark):
    d = spark.createDataFrame([(1, True, False), (2, None, True), (3, True, True), (4, False, None)], "k int, a boolean, b boolean")
    items = [(F.col("a"), F.lit("x")), (F.col("b"), F.lit("y")), (F.col("a"), F.lit("x"))]
    got = {r["k"]: (r["v"], r["none"]) for r in d.select("k", A.listed(items, "string").alias("v"), A.listed([], "string").alias("none")).collect()}
    assert got == {1: (["x", "x"], []), 2: (["y"], []), 3: (["x", "y", "x"], []), 4: ([], [])}
