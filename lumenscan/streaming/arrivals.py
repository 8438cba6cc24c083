"""Arrivals of scan files as a stateful stream: settle, retry what is incomplete, give up, number revisions, deliver once.

    files = spark.readStream.format("scan_files").option("indexLocation", ...).schema(ARRIVAL).load(folder)
    track(files, Patience())      # path, arrival_seq, outcome, state, reason, file_sha256, revision, tries, length

One key is one path. Its state holds what was delivered last (hash and revision; forgotten after ``ttl_ms`` without an arrival) and,
while a file is incomplete or too fresh, what is pending. A timer looks at the pending file again, by the byte ranges that tell its
shape, after ``settle_ms``, then at doubling intervals up to ``max_backoff_ms``; after ``give_up_ms`` the file is given up with the
last reason. The same bytes at the same path are delivered once, whether the folder or a timer saw them first. A file that was
given up starts anew when the folder shows it with another length or time.

``revisions`` is the same numbering as a batch job over arrivals in the order of their ``arrival_seq``, which is unique, so equal
times change nothing.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from lumenscan.operators.sequencing import change_counts
from lumenscan.sources import export as X
from lumenscan.sources import scan_source as SS
from lumenscan.sources.scan_files import interpret
from lumenscan.streaming.result_log import ResultLog, append_once, batch_rows

ARRIVAL = T.StructType([f for f in SS.FULL.fields if f.name in ("path", "modificationTime", "length", "arrival_seq", "file_sha256", "shape", "error_code")])
OUT = "path string, arrival_seq bigint, outcome string, state string, reason string, file_sha256 string, revision bigint, tries bigint, length bigint"
_NAMES = [f.split()[0] for f in OUT.split(", ")]


@dataclass(frozen=True)
class Patience:
    """How long to wait for a file, in milliseconds."""
    settle_ms: int = 2_000
    max_backoff_ms: int = 60_000
    give_up_ms: int = 900_000
    ttl_ms: int = 30 * 86_400_000


def look(path: str) -> tuple[str, str | None, int, str | None]:
    """(state, reason, length, hash if the file is whole) of a file as it is now."""
    fs, _ = SS.opened(path)
    try:
        with fs.open_input_file(path) as f:
            size = f.size()
            if size > SS.SF.MAX_FILE_BYTES:
                return "unrecognised", f"larger than {SS.SF.MAX_FILE_BYTES >> 20} MiB", size, None
            state, reason = SS.shape_of(lambda off, n: f.read_at(n, off), size)
            return state, reason, size, None if state == "incomplete" else hashlib.sha256(f.read_at(size, 0)).hexdigest()
    except OSError:
        return "incomplete", "cannot be opened", 0, None


class Arrivals(StatefulProcessor):
    def __init__(self, patience: Patience) -> None:
        self.patience = patience

    def init(self, handle) -> None:
        self.handle = handle
        ttl = self.patience.ttl_ms or None
        self.delivered = handle.getValueState("delivered", "sha string, revision bigint", ttlDurationMs=ttl)
        self.pending = handle.getValueState("pending", "seq bigint, since_ms bigint, tries bigint, sha string, due_ms bigint", ttlDurationMs=ttl)

    def _deliver(self, path, seq, state, reason, sha, tries, length):
        """A row for bytes that were not the last ones delivered from this path."""
        last, revision = self.delivered.get() if self.delivered.exists() else (None, 0)
        # bytes without a hash (too large to read) are told apart by their length
        sha_ = sha or f"length {length}"
        if sha_ == last:
            self.delivered.update((last, revision))      # an arrival: the time to live starts again
            return []
        self.delivered.update((sha_, revision + 1))
        return [(path, seq, "delivered", state, reason, sha, revision + 1, tries, length)]

    def _wait(self, seq, since, tries, sha, due) -> None:
        if self.pending.exists():
            old = self.pending.get()[4]
            if old in {t for (t,) in self._timers()}:
                self.handle.deleteTimer(old)
        self.pending.update((seq, since, tries, sha, due))
        self.handle.registerTimer(due)

    def _timers(self):
        return [(t if isinstance(t, int) else t[0],) for t in self.handle.listTimers()]

    def _drop(self) -> None:
        if self.pending.exists():
            due = self.pending.get()[4]
            if due in {t for (t,) in self._timers()}:
                self.handle.deleteTimer(due)
            self.pending.clear()

    def handleInputRows(self, key, rows, timerValues):
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        got = [r for pdf in rows for r in zip(pdf["arrival_seq"], pdf["modificationTime"], pdf["length"], pdf["file_sha256"], pdf["state"], pdf["reason"])]
        for seq, time, length, sha, state, reason in sorted(got, key=lambda r: r[0]):
            seq, length = int(seq), int(length)
            fresh = now - time.timestamp() * 1000 < self.patience.settle_ms
            if state != "incomplete" and not fresh:
                self._drop()
                out += self._deliver(key[0], seq, state, reason, sha, 0, length)
            else:
                since = self.pending.get()[1] if self.pending.exists() else now
                self._wait(seq, since, 0, sha if state != "incomplete" else None, now + self.patience.settle_ms)
        yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = []
        if self.pending.exists() and self.pending.get()[4] == expiredTimerInfo.getExpiryTimeInMs():
            seq, since, tries, seen, _ = self.pending.get()
            now = timerValues.getCurrentProcessingTimeInMs()
            state, reason, length, sha = look(key[0])
            if state != "incomplete" and (sha == seen or self.patience.settle_ms == 0 or sha is None):
                self.pending.clear()
                out = self._deliver(key[0], seq, state, reason, sha, tries + 1, length)
            elif now - since >= self.patience.give_up_ms:
                self.pending.clear()
                out = [(key[0], seq, "gave_up", state, reason or "still changing", None, None, tries + 1, length)]
            else:
                # bytes that look whole are looked at once more before they count as settled
                delay = self.patience.settle_ms if state != "incomplete" else min(self.patience.settle_ms << min(tries + 1, 20), self.patience.max_backoff_ms)
                due = now + max(delay, 1)
                self.pending.update((seq, since, tries + 1, sha, due))
                self.handle.registerTimer(due)
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def use_state_store(spark) -> None:
    """State variables and timers need a state store with column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def track(files: DataFrame, patience: Patience = Patience()) -> DataFrame:
    """Deliveries and given-up files of a stream with the columns of ``ARRIVAL``."""
    use_state_store(files.sparkSession)
    rows = files.select("path", "arrival_seq", "modificationTime", "length", "file_sha256", F.col("shape.state").alias("state"), F.col("shape.reason").alias("reason"))
    return rows.groupBy("path").transformWithStateInPandas(Arrivals(patience), OUT, "Append", "ProcessingTime")


def revisions(arrivals: DataFrame, bucket_rows: int = 1_000_000) -> DataFrame:
    """The batch twin: arrivals whose content differs from that of the arrival before at the same path, with ``revision``.

    A path's arrivals are taken in buckets of the sequence, so a path that arrives very often is no single task.
    """
    counted = change_counts(arrivals.where(F.col("shape.state") != "incomplete"), ["path"], F.floor(F.col("arrival_seq") / bucket_rows), [F.col("arrival_seq")], "file_sha256")
    first = counted.groupBy("path", "revision").agg(F.min_by(F.struct("arrival_seq", "file_sha256", "length"), "arrival_seq").alias("r"))
    return first.select("path", "r.arrival_seq", "r.file_sha256", "r.length", F.col("revision").cast("bigint"))


def score_arrivals(files: DataFrame, score: Callable[[DataFrame], DataFrame], log: ResultLog, checkpoint: str, patience: Patience = Patience(), name: str = "arrivals", engine: str = "lumenscan",
                   dependencies: dict[str, str] | None = None, interval: str = "5 seconds"):
    """Start scoring arrivals into the log; files that were given up go to its quarantine.

    A batch's deliveries are written first and read back, so the stateful pass runs once however often the batch is tried, and
    the files' bytes are read by the tasks that score them. Deliveries, results and quarantine each skip a batch that they have.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        append_once(df, f"{log.path}/_deliveries", name, batch_id)
        rows = batch_rows(df.sparkSession, f"{log.path}/_deliveries", name, batch_id, df.schema)
        if rows is None:
            return
        scans = interpret(SS.read_paths(rows.where("outcome = 'delivered'"))).withColumn("input_sha256", F.col("file_sha256"))
        log.append(X.log_records(score(scans), engine, dependencies or {}), name, batch_id)
        append_once(rows.where("outcome = 'gave_up'").select("path", "arrival_seq", "reason", "tries", "length"), f"{log.path}/_quarantine", name, batch_id)

    return track(files, patience).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
