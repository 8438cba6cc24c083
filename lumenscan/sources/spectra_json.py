"""Spectra tables kept as JSON documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.functions import numeric as N
from lumenscan.rulebook import STANDARD_CLASS
from lumenscan.schema import SPECTRA_JSON


def read_spectra_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per spectrum. The schema is given, and a malformed document fails the job rather than turning null.
    An empty or non-finite spectrum keeps its row with a ``reject_reason``."""
    docs = spark.read.schema(SPECTRA_JSON).option("multiLine", True).option("mode", "FAILFAST").json(path)
    s = docs.select(F.explode("spectra").alias("s"))
    bad = F.coalesce((F.size("s.values") < 1) | F.exists("s.values", lambda x: ~N.is_finite(x)), F.lit(True))
    return s.select(
        F.col("s.name").alias("scan_id"), F.col("s.source").alias("source"), F.col("s.wl_start_nm").alias("wl_start"),
        F.col("s.wl_step_nm").alias("wl_step"), F.size("s.values").alias("n"),
        F.coalesce("s.scan_context.splices_nm", F.lit([1000.0, 1800.0])).alias("joins_nm"),
        F.coalesce("s.scan_context.instrument_class", F.lit(STANDARD_CLASS)).alias("class"), F.col("s.scan_context.serial").alias("serial"),
        F.col("s.sha256").alias("declared_sha256"), F.when(~bad, F.col("s.values")).alias("r"),
        F.when(bad, F.lit("must be a non-empty finite vector")).alias("reject_reason"))
