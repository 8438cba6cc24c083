"""Rule queries on a table whose rows stand in one Parquet row group."""
import duckdb
from pyspark.sql import functions as F

from lumenscan.plans import driver_rule_queries as RQ
from lumenscan.plans.driver_queries import QUERIES
from lumenscan.plans.driver_tables import ROWS_PER_TASK


def test_tasks_stay_small_and_results_equal(spark, tmp_path):
    n = 3 * ROWS_PER_TASK
    con = duckdb.connect()
    con.sql(f"create table customer as select i::BIGINT as c_custkey from range(1, {n} + 1) t(i)")
    con.sql(f"copy customer to '{tmp_path}/customer.parquet' (format parquet, row_group_size 1000000)")
    rows = RQ.signed(spark, str(tmp_path)).select("k").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in rows) == n
    assert max(r["count"] for r in rows) <= 1.2 * ROWS_PER_TASK
    fn, sql = QUERIES["collagen_verdict"]
    rel = con.sql(sql)
    assert sorted(tuple(r) for r in fn(spark, str(tmp_path)).select(*rel.columns).collect()) == sorted(rel.fetchall())
