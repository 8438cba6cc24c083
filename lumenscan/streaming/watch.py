"""Scoring scan files as they arrive.

The file source sees each path once. A file rewritten in place under the same name is therefore not read again by the
stream: write every scan under a new name, or run ``rescan`` on a schedule, which compares (path, content) with what
is already logged and picks up rewrites and files that were incomplete before.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.operators.matching import broadcast_if_small
from lumenscan.operators.sequencing import change_counts
from lumenscan.sources import export as X
from lumenscan.sources.scan_files import candidate, decode, file_shape, interpret, scan_content
from lumenscan.functions.text import file_name
from lumenscan.sources.scan_files import MAX_FILE_BYTES

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_scans(spark: SparkSession, path: str, include_existing: bool = True, since=None, recursive: bool = True, max_files: int | None = None) -> DataFrame:
    """New scan files of a folder as a stream of raw files with ``file_sha256`` and ``shape``. Existing files are left
    out by their modification time."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", str(recursive).lower())
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    df = reader.load(path)
    df = df.where(candidate(file_name(F.col("path"))))
    if not include_existing:
        if since is None:
            raise ValueError("give the time to watch from when existing files are left out")
        df = df.where(F.col("modificationTime") > F.lit(since))
    large = F.struct(F.lit("unrecognised").alias("state"), F.lit(f"larger than {MAX_FILE_BYTES >> 20} MiB").alias("reason"))
    shape = F.when(F.col("length") > MAX_FILE_BYTES, large).otherwise(file_shape(F.col("content")))
    return df.withColumns({"file_sha256": F.sha2("content", 256), "shape": shape})


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complete or unrecognised files, incomplete files). Incomplete ones are retried by the next ``rescan``."""
    state = F.col("shape.state")
    return df.where(state != "incomplete"), df.where(state == "incomplete").select(
        "path", "modificationTime", "length", "file_sha256", F.col("shape.reason").alias("reason"))


def dedupe_arrivals(df: DataFrame, delay: str = "1 day", time: str = "modificationTime") -> DataFrame:
    """The same bytes at the same path are delivered once. State is kept for ``delay`` only: a watermark is needed
    because a stream without one would remember every file for ever."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(["path", "file_sha256"])


def same_content(arrivals: DataFrame, log: DataFrame) -> DataFrame:
    """``same_content_as``: the first logged path that holds the same bytes elsewhere."""
    known = log.groupBy(F.col("input_sha256").alias("file_sha256")).agg(F.min_by("path", F.struct("logged_at", "path")).alias("_first"))
    joined = arrivals.join(known, "file_sha256", "left")
    return joined.withColumn("same_content_as", F.when(F.col("_first") != F.col("path"), F.col("_first"))).drop("_first")


def with_revisions(arrivals: DataFrame, time: str = "modificationTime", bucket: Column | None = None) -> DataFrame:
    """``revision`` per path: how many times its content has changed so far. Each (path, day) is handled on its own."""
    return change_counts(arrivals, ["path"], bucket if bucket is not None else F.to_date(time), [F.col(time), F.col("file_sha256")], "file_sha256")


def tracked_revisions(arrivals: DataFrame, time: str = "modificationTime") -> DataFrame:
    """The same as a stream: one counter and the last content hash per path in the state store."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, frames, state):
        last, revision = state.get if state.exists else (None, 0)
        rows = []
        for pdf in frames:
            for sha, t in sorted(zip(pdf["file_sha256"], pdf[time]), key=lambda p: p[1]):
                revision += sha != last
                last = sha
                rows.append((key[0], sha, t, revision))
        state.update((last, int(revision)))
        yield pd.DataFrame(rows, columns=["path", "file_sha256", time, "revision"])

    return arrivals.select("path", "file_sha256", time).groupBy("path").applyInPandasWithState(
        update, f"path string, file_sha256 string, {time} timestamp, revision bigint", "sha string, revision bigint", "append", GroupStateTimeout.NoTimeout)


def score_files(files: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Raw files to scored rows: the batch transform, whatever delivered the files."""
    scans = interpret(decode(files.select("path", "modificationTime", "length", "file_sha256", "content")))
    scans = scans.withColumn("input_sha256", F.col("file_sha256"))
    return score(scans)


def log_batch(files: DataFrame, score, log_path: str, engine: str, dependencies: dict[str, str], reason: str, quarantine_path: str | None = None) -> None:
    """Score one batch of files and append what the log does not hold yet."""
    spark = files.sparkSession
    good, bad = quarantine(files)
    records = X.log_records(score_files(good, score), engine, dependencies, reason)
    X.append_results(records, log_path, read_log(spark, log_path))
    if quarantine_path:
        bad.write.mode("append").parquet(quarantine_path)


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The result log, or None before its first write."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p) or not any(s.getPath().getName().startswith("log_date=") for s in fs.listStatus(p)):
        return None
    return spark.read.parquet(path)


def score_stream(source: DataFrame, score: Callable[[DataFrame], DataFrame], log_path: str, checkpoint: str, engine: str = "lumenscan", dependencies: dict[str, str] | None = None,
                 quarantine_path: str | None = None, available_now: bool = True, interval: str = "30 seconds"):
    """Start scoring a stream of files into the log. A batch that is replayed after a failure adds nothing, because
    its result keys are already in the log."""
    def batch(df: DataFrame, _id: int) -> None:
        log_batch(df, score, log_path, engine, dependencies or {}, "arrival", quarantine_path)
    writer = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def rescan(spark: SparkSession, path: str, score: Callable[[DataFrame], DataFrame], log_path: str, engine: str = "lumenscan", dependencies: dict[str, str] | None = None, recursive: bool = True) -> None:
    """Scheduled batch: files whose (path, content) the log does not hold, including rewrites in place and files that
    were incomplete before."""
    files = scan_content(spark, path, recursive).withColumns({"file_sha256": F.sha2("content", 256), "shape": file_shape(F.col("content"))})
    log = read_log(spark, log_path)
    if log is not None:
        # decide on narrow rows first; the file bytes then meet only the (usually short) list of paths to score
        seen = log.select("path", F.col("input_sha256").alias("file_sha256")).distinct()
        todo = files.select("path", "file_sha256").join(seen, ["path", "file_sha256"], "left_anti").select("path")
        files = files.join(broadcast_if_small(todo), "path", "left_semi")
    log_batch(files, score, log_path, engine, dependencies or {}, "arrival")


def rescore(spark: SparkSession, scans: DataFrame, score: Callable[[DataFrame], DataFrame], log_path: str, engine: str = "lumenscan", dependencies: dict[str, str] | None = None) -> None:
    """Score a whole table again under a new configuration; only results with a new key are appended."""
    records = X.log_records(score(scans), engine, dependencies or {}, "reanalysis")
    X.append_results(records, log_path, read_log(spark, log_path))


def result_revisions(log: DataFrame) -> DataFrame:
    """``revision`` of each logged result of a (path, content), in the order they were logged."""
    from lumenscan.operators.sequencing import row_numbers
    return row_numbers(log, ["path", "input_sha256"], F.col("log_date"), [F.col("logged_at"), F.col("result_key")], "revision")
