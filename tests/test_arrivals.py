import json
import os
import time

import pytest
from pyspark.sql import functions as F

from lumenscan.sources import scan_source as SS
from lumenscan.streaming import arrivals as AR
from lumenscan.streaming.result_log import ResultLog, append_once, batch_rows, is_written, not_logged, save_bucketed
from conftest import spectrum
from test_sources import scan_bytes, simple_score


def until(query, done, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        assert query.exception() is None, query.exception()
        if done():
            return
        time.sleep(0.5)
    raise AssertionError("not in time")


def test_files_are_settled_retried_given_up_and_scored_once(spark, tmp_path):
    SS.register(spark)
    src = tmp_path / "in"
    src.mkdir()

    def put(name, data, age=100):
        (src / f".{name}").write_bytes(data)
        os.utime(src / f".{name}", (time.time() - age, time.time() - age))
        os.rename(src / f".{name}", src / name)

    log = ResultLog(str(tmp_path / "log"), buckets=8)
    patience = AR.Patience(settle_ms=300, max_backoff_ms=1000, give_up_ms=20_000)

    def start():
        files = spark.readStream.format("scan_files").schema(AR.ARRIVAL).option("indexLocation", str(tmp_path / "index")).load(str(src))
        return AR.score_arrivals(files, simple_score, log, str(tmp_path / "ck"), patience, interval="0 seconds")

    def logged():
        rows = log.read(spark)
        return [] if rows is None else [(json.loads(r.result)["file"], r.input_sha256) for r in rows.collect()]

    full = scan_bytes(spectrum(9))
    for i in range(3):
        put(f"s{i}.asd", scan_bytes(spectrum(i)))
    put("late.asd", full[:9000])
    put("never.asd", full[:5000])
    put("odd.asd", b"PK" * 400)
    q = start()
    try:
        until(q, lambda: len(logged()) == 4)
        put("late.asd", full)                          # both the folder and the timer will see it
        put("young.asd", scan_bytes(spectrum(5)), 0)   # too fresh at first
        until(q, lambda: {n for n, _ in logged()} >= {"late.asd", "young.asd"})
        until(q, lambda: os.path.isdir(tmp_path / "log" / "_quarantine") and any(n.startswith("batch=") for n in os.listdir(tmp_path / "log" / "_quarantine")))
    finally:
        q.stop()
    # after a restart a rewritten file is its path's second revision
    put("s1.asd", scan_bytes(spectrum(7)), 50)
    q = start()
    try:
        until(q, lambda: len(logged()) == 7)
        time.sleep(3)
    finally:
        q.stop()
    names = sorted(n for n, _ in logged())
    assert names == ["late.asd", "odd.asd", "s0.asd", "s1.asd", "s1.asd", "s2.asd", "young.asd"]
    sent = spark.read.parquet(str(tmp_path / "log" / "_deliveries")).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.outcome, r.revision) for r in sent) == sorted(
        [("late.asd", "delivered", 1), ("never.asd", "gave_up", None), ("odd.asd", "delivered", 1), ("s0.asd", "delivered", 1), ("s1.asd", "delivered", 1), ("s1.asd", "delivered", 2), ("s2.asd", "delivered", 1), ("young.asd", "delivered", 1)])
    lost = spark.read.parquet(str(tmp_path / "log" / "_quarantine")).collect()
    assert [(r.path.rsplit("/", 1)[1], r.reason) for r in lost] == [("never.asd", "spectrum block incomplete")] and lost[0].tries >= 1


def test_stream_equals_batch_with_equal_times_and_a_restart(spark, tmp_path):
    shas = "aabbaacbbb"
    rows = [(f"p{i % 3}", i + 1, shas[(i * 7) % 10], 100) for i in range(60)]
    df = spark.createDataFrame(rows, "path string, arrival_seq long, file_sha256 string, length long").withColumns(
        {"modificationTime": F.timestamp_seconds(F.lit(1000)), "shape": F.struct(F.lit("complete").alias("state"), F.lit(None).cast("string").alias("reason"))})
    for k in range(3):
        df.where(F.col("arrival_seq") % 3 == k % 3).where("arrival_seq <= 30").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(last):
        s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = AR.track(s).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").start()
        try:
            until(q, lambda: any(p.get("batchId", -1) >= 0 and p["sources"][0]["endOffset"] and p["sources"][0]["endOffset"]["logOffset"] >= last for p in map(json.loads, (x.json for x in q.recentProgress))))
        finally:
            q.stop()

    run(0)
    df.where("arrival_seq > 30").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(1)
    got = sorted((r.path, r.arrival_seq, r.file_sha256, r.revision) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    for bucket in (7, 1_000_000):
        assert got == sorted((r.path, r.arrival_seq, r.file_sha256, r.revision) for r in AR.revisions(df, bucket).collect())
    assert max(r[3] for r in got) > 5


def records(spark, lo, hi, word="x"):
    return spark.range(lo, hi).select(F.sha2(F.col("id").cast("string"), 256).alias("result_key"), F.col("id"), F.lit(word).alias("result"))


def test_log_adds_each_key_once_and_a_replay_writes_nothing(spark, tmp_path):
    log = ResultLog(str(tmp_path / "log"), buckets=16)
    assert log.read(spark) is None
    assert log.append(records(spark, 0, 30), "q", 0) and log.append(records(spark, 20, 50), "q", 1)
    assert log.read(spark).count() == 50 and {r.batch: r["count"] for r in log.read(spark).groupBy("batch").count().collect()} == {"q-0": 30, "q-1": 20}
    before = sorted(os.listdir(tmp_path / "log" / "bucket=0"))
    assert not log.append(records(spark, 100, 200), "q", 1) and log.read(spark).count() == 50 and sorted(os.listdir(tmp_path / "log" / "bucket=0")) == before
    # an attempt that died before its marker: its rows are replaced, not doubled
    os.remove(tmp_path / "log" / "_batches" / "q" / "1")
    assert log.append(records(spark, 20, 50, "again"), "q", 1) and log.read(spark).count() == 50 and log.read(spark).where("result = 'again'").count() == 20
    log.compact(spark, str(tmp_path / "two"))
    two = ResultLog(str(tmp_path / "two"), buckets=16)
    assert two.read(spark).count() == 50 and is_written(spark, two.path, "q", 1) and not two.append(records(spark, 0, 99), "q", 0)
    assert append_once(records(spark, 0, 3), str(tmp_path / "bad"), "q", 0) and not append_once(records(spark, 0, 9), str(tmp_path / "bad"), "q", 0)
    assert batch_rows(spark, str(tmp_path / "bad"), "q", 0, records(spark, 0, 1).schema).count() == 3 and batch_rows(spark, str(tmp_path / "bad"), "q", 9, records(spark, 0, 1).schema) is None


def test_a_batch_reads_its_own_buckets_only(spark, tmp_path):
    log = ResultLog(str(tmp_path / "log"), buckets=64)
    log.append(records(spark, 0, 2000), "q", 0)
    new = log.bucketed(records(spark, 0, 2)).persist()
    known = log.known(new, "q-1")
    mine = {r.bucket for r in new.collect()}
    plan = known._jdf.queryExecution().executedPlan().toString()
    filters = [x for x in plan.splitlines() if "PartitionFilters" in x and "bucket" in x]
    assert 1 <= len(mine) <= 2 and known.count() == 2
    # the log's folders are filtered by exactly these buckets before any file is opened
    assert len(filters) == 1 and all(str(b) in filters[0].split("PartitionFilters")[1] for b in mine)
    new.unpersist()


def test_rescoring_moves_no_scan(spark):
    spark.sql("DROP TABLE IF EXISTS scans_b")
    spark.sql("DROP TABLE IF EXISTS log_b")
    try:
        save_bucketed(spark.range(500).select(F.concat(F.lit("p"), "id").alias("path"), F.array_repeat(F.lit(1.0), 50).alias("r")), "scans_b", "path", 4)
        save_bucketed(spark.range(0, 500, 2).select(F.concat(F.lit("p"), "id").alias("path"), F.lit("c1").alias("configuration")), "log_b", "path", 4)
        todo = not_logged(spark, "scans_b", "log_b", "path", "c1")
        assert todo.count() == 250 and not_logged(spark, "scans_b", "log_b", "path", "c2").count() == 500
        plan = todo._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
    finally:
        spark.sql("DROP TABLE IF EXISTS scans_b")
        spark.sql("DROP TABLE IF EXISTS log_b")
