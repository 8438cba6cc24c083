"""The driver's tables seen as scans, arrivals, units and parameters."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.schema import as_scans

JOINS = (370.0, 393.0)
START = 350.0
ROWS_PER_TASK = 8192     # of rows on which the rules compute long

# long(vec_id, label, ch, wl, r) over the whole embeddings table
LONG = """src AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS e, unnest(range(len(embedding)))::INT AS ch FROM embeddings),
L AS (SELECT vec_id, label, ch, 350e0 + ch AS wl, abs(e) + 0.05e0 AS r FROM src)"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """The same rows in tasks of about `rows` rows. A Parquet row group is read by one task, and a million narrow rows are one row
    group of a few MB: what computes long on every row would run on one core, and its longest task would grow with the table."""
    tasks = -(-df.count() // rows)
    return df.repartition(tasks) if tasks > 1 else df


def spectra(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding as a 64-channel scan: wl = 350 + ch, R = |x| + 0.05, detector joins after channels 20 and 43."""
    e = table(spark, sf, "embeddings")
    r = F.transform("embedding", lambda x: F.abs(x.cast("double")) + 0.05)
    return as_scans(e, r, F.col("vec_id"), START, 1.0, JOINS, keep=["vec_id", "label"]).drop("scan_id")


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def q6(sql: str) -> str:
    return f"round({sql}, 6) + 0e0"


def lit(x: float) -> str:
    """A number DuckDB reads as DOUBLE, not as DECIMAL."""
    s = repr(float(x))
    return s if "e" in s else s + "e0"


def values(rows, name: str, cols: str) -> str:
    body = ", ".join("(" + ", ".join(lit(v) if isinstance(v, float) else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"{name}({cols}) AS (VALUES {body})"
