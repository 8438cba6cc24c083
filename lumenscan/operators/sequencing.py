"""Order-dependent operators that stay parallel inside one key.

A window function over a key runs in one task per key, so a key that holds a third of all rows would hold a third of
the job. Here a key is cut into ordered buckets (a day, a value range). Each (key, bucket) is processed on its own and
the little that crosses buckets (a count, a last value) is carried by a window over one summary row per bucket.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenscan.sources.shared import checkpoint_root


def row_numbers(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str = "rank") -> DataFrame:
    """1-based row number per key in ``order``; ``bucket`` must not decrease along that order."""
    df = df.withColumn("_b", bucket)
    local = df.withColumn(out, F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order)))
    sizes = df.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(
        W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    on = [local[k].eqNullSafe(before[k]) for k in [*keys, "_b"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = local.join(before, cond, "inner").select(local["*"], before["_before"])
    return joined.withColumn(out, (F.col(out) + F.col("_before")).cast("bigint")).drop("_b", "_before")


def held(df: DataFrame) -> DataFrame:
    """``df`` written once to the cluster's checkpoint folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def positions(df: DataFrame, order: list[Column], keys: list[str] = (), out: str = "rank") -> DataFrame:
    """1-based position in ``order`` within each of ``keys`` (over all rows without keys).

    Rows are dealt by ranges of (keys, order) that Spark takes from the data, so neither a large key nor many equal or unknown
    values meet in one task; what crosses tasks is one count per task. The sorted rows are written once, because the ranges
    must be the same when they are counted and when they are numbered.
    """
    by = [F.col(k) for k in keys] + list(order)
    place = F.monotonically_increasing_id()
    rows = held(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", place))
    task, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(task.alias("_t")).agg(F.count("*").alias("_n"))
    before = counts.select("_t", F.coalesce(F.sum("_n").over(W.orderBy("_t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_t", task).join(F.broadcast(before), "_t").withColumn(out, F.col("_before") + within + 1)      # one row per task
    if keys:
        first = rows.groupBy(*keys).agg(F.min(out).alias("_first")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first")
        same = [rows[k].eqNullSafe(first[f"_k{i}"]) for i, k in enumerate(keys)]
        rows = rows.join(first, reduce(lambda a, b: a & b, same)).withColumn(out, F.col(out) - F.col("_first") + 1)
        rows = rows.drop("_first", *[f"_k{i}" for i in range(len(keys))])
    return rows.drop("_t", "_at", "_before")


def change_counts(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: str,
                  out: str = "revision") -> DataFrame:
    """1-based count of value changes so far per key in ``order`` (the first row of a key is revision 1)."""
    df = df.withColumn("_b", bucket).withColumn("_o", F.struct(*order))
    w = W.partitionBy(*keys, "_b").orderBy("_o")
    prev = F.lag(value).over(w)
    first = F.row_number().over(w) == 1
    local = df.withColumn("_chg", F.when(first, 0).when(F.col(value).eqNullSafe(prev), 0).otherwise(1))
    local = local.withColumn("_run", F.sum("_chg").over(w.rowsBetween(W.unboundedPreceding, 0)))
    ends = local.groupBy(*keys, "_b").agg(F.min_by(F.struct(F.col(value).alias("v")), "_o").alias("_first"),
                                          F.max_by(F.struct(F.col(value).alias("v")), "_o").alias("_last"),
                                          F.sum("_chg").alias("_inside"))
    wb = W.partitionBy(*keys).orderBy("_b")
    before = F.lag("_last").over(wb)
    ends = ends.withColumn("_start", F.when(before.isNull(), 1)
                           .when(F.col("_first")["v"].eqNullSafe(before["v"]), 0).otherwise(1))
    ends = ends.withColumn("_base", F.sum("_start").over(wb.rowsBetween(W.unboundedPreceding, 0))
                           + F.coalesce(F.sum("_inside").over(wb.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    cond = local["_b"].eqNullSafe(ends["_b"])
    for k in keys:
        cond = cond & local[k].eqNullSafe(ends[k])
    joined = local.join(ends, cond).select(local["*"], ends["_base"])
    return (joined.withColumn(out, (F.col("_base") + F.col("_run")).cast("bigint"))
            .drop("_b", "_o", "_chg", "_run", "_base"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, salts: int = 32) -> DataFrame:
    """The first k rows of each key. Every key is cut into ``salts`` parts that are reduced to k rows each before the
    final pass, so the last task of a key sees at most salts x k rows."""
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not unhashable(df, c)]), F.lit(salts))
    part = df.withColumn("_salt", spread)
    part = (part.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order)))
            .where(F.col("_r") <= k).drop("_salt"))
    return (part.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
            .where(F.col("_r") <= k).drop("_r"))


def unhashable(df: DataFrame, name: str) -> bool:
    return "map<" in df.schema[name].dataType.simpleString()
