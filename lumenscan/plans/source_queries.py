"""Queries of the scan-file source: every document becomes a scan file whose header, samples and damage follow from its text; the
files are written by the source, then read by it. Importing this module adds to ``driver_queries.QUERIES``."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.plans.driver_queries import query
from lumenscan.plans.driver_tables import q6, r6, table
from lumenscan.sources import scan_source as SS
from lumenscan.sources.shared import shared_folder

CHANNELS = 40
FOLDER_FILES = 10_000     # a folder is listed at once

FILES = f"""f AS (SELECT doc_id, length(coalesce(text, '')) AS k, CASE WHEN length(coalesce(text, '')) % 13 = 0 THEN 'xyz' WHEN doc_id % 4 = 2 THEN 'as7' WHEN doc_id % 4 = 3 THEN 'ASD' ELSE 'as8' END AS magic FROM documents),
g AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'short_header' WHEN k % 17 = 0 THEN 'unknown_format' WHEN k % 11 = 0 THEN 'truncated_samples' END AS error_code,
      CASE WHEN magic = 'xyz' THEN 'unrecognised' WHEN k % 7 = 0 THEN 'incomplete' WHEN k % 17 = 0 THEN 'unrecognised' WHEN k % 11 = 0 THEN 'incomplete' ELSE 'complete' END AS state FROM f)"""


def scan_folder(spark, sf) -> str:
    """The documents as scan files in a new shared folder. A length that 7 divides cuts the file in its header, 17 gives it an
    unknown data format, 11 cuts it in its samples, 13 gives it another signature."""
    SS.register(spark)
    k, ch = F.length(F.coalesce("text", F.lit(""))), F.sequence(F.lit(0), F.lit(CHANNELS - 1))
    d = table(spark, sf, "documents").select("doc_id", k.alias("k"))
    n_folders = max(1, -(-d.count() // FOLDER_FILES))
    magic = F.when(F.col("k") % 13 == 0, "xyz").when(F.col("doc_id") % 4 == 2, "as7").when(F.col("doc_id") % 4 == 3, "ASD").otherwise("as8")
    dn, white = F.transform(ch, lambda i: ((F.col("k") + 7 * i) % 997 + 1).cast("double")), F.transform(ch, lambda i: (i + 1000).cast("double"))
    d = d.select(F.concat(F.pmod(F.xxhash64("doc_id"), F.lit(n_folders)), F.lit("/d"), F.col("doc_id"), F.lit(".asd")).alias("name"), magic.alias("magic"), (F.col("doc_id") % 60000 + 1).alias("serial"), F.lit(350.0).alias("wl_start"), F.lit(1.0).alias("wl_step"),
                 F.when(F.col("k") % 17 == 0, 9).otherwise(2).alias("data_format"), F.when(magic == "ASD", F.zip_with(dn, white, lambda x, y: x / y)).otherwise(dn).alias("sample"), white.alias("reference"),
                 F.when(F.col("k") % 7 == 0, F.col("k") % 180 + 300).when((F.col("k") % 11 == 0) & (F.col("k") % 17 != 0), F.lit(584)).alias("keep"))
    folder = shared_folder(spark)
    SS.encoded(d).write.format("scan_files").mode("append").save(folder)
    return folder


def doc_of(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.regexp_extract("path", r"/d(-?\d+)\.asd$", 1).cast("bigint"))


@query("scan_source", f"""WITH {FILES}, c AS (SELECT doc_id, sum(((k + 7 * ch) % 997 + 1)::DOUBLE / (1000 + ch)) AS total FROM g, (SELECT unnest(range({CHANNELS})) AS ch) GROUP BY doc_id)
SELECT doc_id, magic, CASE WHEN k % 7 <> 0 THEN doc_id % 60000 + 1 END AS serial, error_code, state, CASE WHEN error_code IS NULL THEN {q6('total')} END AS total FROM g JOIN c USING (doc_id)""")
def _scan_source(spark, sf):
    d = doc_of(spark.read.format("scan_files").load(scan_folder(spark, sf)))
    r = F.coalesce("stored_r", F.zip_with("sample_dn", "reference_dn", lambda x, y: x / y))
    return d.select("doc_id", "magic", "serial", "error_code", F.col("shape.state").alias("state"), r6(F.aggregate(r, F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("scan_source_headers", f"WITH {FILES} SELECT doc_id, magic, CASE WHEN k % 7 <> 0 THEN {CHANNELS} END AS n, CASE WHEN k % 7 <> 0 THEN 350e0 END AS wl_start, error_code FROM g")
def _scan_headers(spark, sf):
    d = doc_of(spark.read.format("scan_files").option("columns", "header").load(scan_folder(spark, sf)))
    return d.select("doc_id", "magic", "n", "wl_start", "error_code")


@query("scan_source_stream", f"WITH {FILES} SELECT doc_id, error_code, state, (SELECT count(*) FROM g) AS last_seq, 1 AS times FROM g")
def _scan_stream(spark, sf):
    source, out = scan_folder(spark, sf), shared_folder(spark)
    s = spark.readStream.format("scan_files").option("indexLocation", f"{out}/index").load(source)
    q = (doc_of(s).select("doc_id", "arrival_seq", "error_code", "shape").writeStream.format("parquet").option("path", f"{out}/rows")
         .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    last = rows.agg(F.max("arrival_seq")).first()[0]
    return rows.groupBy("doc_id").agg(F.first("error_code").alias("error_code"), F.first("shape.state").alias("state"), F.count("*").alias("times"), F.lit(last).cast("bigint").alias("last_seq"))
