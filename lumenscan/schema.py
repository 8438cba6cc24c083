"""Table schemas."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCANS = T.StructType([
    T.StructField("scan_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("class", T.StringType()),
    T.StructField("class_source", T.StringType()), T.StructField("serial", T.LongType()), T.StructField("wl_start", T.DoubleType()),
    T.StructField("wl_step", T.DoubleType()), T.StructField("n", T.IntegerType()), T.StructField("joins_nm", T.ArrayType(T.DoubleType())),
    T.StructField("r", T.ArrayType(T.DoubleType()))])

SPECTRA_JSON = T.StructType([T.StructField("format", T.StringType()), T.StructField("spectra", T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("scan_context", T.StructType([T.StructField("splices_nm", T.ArrayType(T.DoubleType())),
                                                T.StructField("instrument_class", T.StringType()), T.StructField("serial", T.LongType())])),
    T.StructField("quantity", T.StringType()), T.StructField("wl_start_nm", T.DoubleType()), T.StructField("wl_step_nm", T.DoubleType()),
    T.StructField("sha256", T.StringType()), T.StructField("values", T.ArrayType(T.DoubleType()))])))])


def as_scans(df: DataFrame, r: Column, scan_id: Column, wl_start: float = 350.0, wl_step: float = 1.0, joins=(1000.0, 1800.0),
             cls: Column | None = None, serial: Column | None = None, keep: list[str] = ()) -> DataFrame:
    """Any table with an array of values as a table of scans. ``n`` is stored, so later jobs that need only the layout
    never read the spectra."""
    return df.select(*keep, scan_id.alias("scan_id"), F.lit(float(wl_start)).alias("wl_start"), F.lit(float(wl_step)).alias("wl_step"),
                     F.size(r).alias("n"), F.lit([float(j) for j in joins]).alias("joins_nm"),
                     (cls if cls is not None else F.lit(None).cast("string")).alias("class"),
                     (serial if serial is not None else F.lit(None).cast("bigint")).alias("serial"), r.alias("r"))
