"""The result log as a bucketed table: a micro-batch reads only the buckets of its own keys, and a replayed batch writes nothing.

Layout: ``bucket=B/batch=NAME-ID`` with B a hash of the result key. ``append``

* returns at once if the batch left its marker (it was written to the end);
* otherwise reads, of the log, the folders of the buckets that the batch has (at most `buckets` numbers, which become a partition
  filter), without what an earlier attempt of the same batch may have left;
* writes what is new into the batch's own folders, replacing those of an earlier attempt, and leaves the marker.

So an attempt that dies anywhere is repeated with the same result. ``append_once`` does the same for rows without keys (the
quarantine). ``compact`` joins the many small folders of old batches into one per bucket.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenscan.operators.matching import broadcast_if_small

BUCKETS = 1024


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _marker(path: str, name: str, batch_id: int) -> str:
    return f"{path}/_batches/{name}/{batch_id}"


def is_written(spark: SparkSession, path: str, name: str, batch_id: int) -> bool:
    fs, p = _fs(spark, _marker(path, name, batch_id))
    return fs.exists(p)


def _mark(spark: SparkSession, path: str, name: str, batch_id: int) -> None:
    fs, p = _fs(spark, _marker(path, name, batch_id))
    fs.create(p, True).close()


@dataclass
class ResultLog:
    path: str
    key: str = "result_key"
    buckets: int = BUCKETS

    def read(self, spark: SparkSession) -> DataFrame | None:
        """All results with their bucket and batch; None before the first."""
        fs, p = _fs(spark, self.path)
        if not fs.exists(p) or not any(s.getPath().getName().startswith("bucket=") for s in fs.listStatus(p)):
            return None
        return spark.read.option("basePath", self.path).parquet(f"{self.path}/bucket=*")

    def bucketed(self, records: DataFrame) -> DataFrame:
        return records.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def known(self, new: DataFrame, batch: str) -> DataFrame | None:
        """Keys of `new` (bucketed) that other batches have logged; only the buckets of `new` are read."""
        log = self.read(new.sparkSession)
        if log is None:
            return None
        mine = [r.bucket for r in new.select("bucket").distinct().collect()]      # at most `buckets` numbers
        there = log.where(F.col("bucket").isin(mine) & (F.col("batch") != batch))
        return there.join(broadcast_if_small(new.select(self.key)), self.key, "left_semi").select(self.key).distinct()

    def append(self, records: DataFrame, name: str, batch_id: int) -> bool:
        """Log what no other batch has logged; False if this batch is already written."""
        spark, batch = records.sparkSession, f"{name}-{batch_id}"
        if is_written(spark, self.path, name, batch_id):
            return False
        new = self.bucketed(records.dropDuplicates([self.key])).persist()
        try:
            known = self.known(new, batch)
            fresh = new if known is None else new.join(broadcast_if_small(known), self.key, "left_anti")
            _overwrite(fresh.withColumn("batch", F.lit(batch)), self.path, ["bucket", "batch"])
        finally:
            new.unpersist()
        _mark(spark, self.path, name, batch_id)
        return True

    def compact(self, spark: SparkSession, into: str) -> None:
        """A copy of the log at `into` with one folder per bucket and the markers of all batches."""
        log = self.read(spark)
        if log is not None:
            _overwrite(log.withColumn("batch", F.lit("compacted")).repartition("bucket"), into, ["bucket", "batch"])
        fs, p = _fs(spark, f"{self.path}/_batches")
        if fs.exists(p):
            there, target = _fs(spark, f"{into}/_batches")
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, there, target, False, spark._jsc.hadoopConfiguration())


def _overwrite(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_once(df: DataFrame, path: str, name: str, batch_id: int) -> bool:
    """Rows without keys: a batch replaces what an earlier attempt of it wrote, and writes nothing once it is done."""
    spark = df.sparkSession
    if is_written(spark, path, name, batch_id):
        return False
    _overwrite(df.withColumn("batch", F.lit(f"{name}-{batch_id}")), path, ["batch"])
    _mark(spark, path, name, batch_id)
    return True


def batch_rows(spark: SparkSession, path: str, name: str, batch_id: int, schema: T.StructType) -> DataFrame | None:
    """What `append_once` wrote of a batch; None if it had no rows."""
    folder = f"{path}/batch={name}-{batch_id}"
    fs, p = _fs(spark, folder)
    return spark.read.schema(schema).parquet(folder) if fs.exists(p) else None


# ------------------------------------------------------------------------------------------------ rescoring an archive
def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, mode: str = "overwrite") -> None:
    """A table whose files hold whole hash buckets of `key`, sorted: joins on the key with a table of as many buckets move nothing."""
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def not_logged(spark: SparkSession, scans: str, log: str, key: str, configuration: str) -> DataFrame:
    """Scans of a bucketed table that have no result under this configuration in a log bucketed alike. Neither side is shuffled."""
    done = spark.table(log).where(F.col("configuration") == configuration).select(key)
    return spark.table(scans).hint("merge").join(done.hint("merge"), key, "left_anti")
