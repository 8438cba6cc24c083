import os
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenscan.sources import scan_files as SF
from lumenscan.sources import scan_source as SS
from conftest import by_id, spectrum
from test_sources import scan_bytes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    SS.register(spark)
    d = tmp_path_factory.mktemp("scans")
    r = spectrum(0)
    files = {"a.asd": scan_bytes(r), "b.ASD": scan_bytes(spectrum(1), b"as7", 1, (0.0, 0.0)), "c.001": scan_bytes(spectrum(2), b"ASD"), "c.001.sco": scan_bytes(spectrum(2), b"ASD"), "cut.asd": scan_bytes(r, cut=9000), "tiny.asd": b"as8",
             "odd.asd": scan_bytes(r, fmt=9), ".hidden.asd": scan_bytes(r), "x.tmp.asd": b"", "note.txt": b"", "alone.sco": scan_bytes(spectrum(3), b"ASD"), "empty.asd": b""}
    for n, b in files.items():
        (d / n).write_bytes(b)
    (d / "deeper").mkdir()
    (d / "deeper" / "z.asd").write_bytes(scan_bytes(spectrum(4)))
    return d


def test_rows_are_those_of_the_binary_reader(spark, folder):
    one = spark.read.format("scan_files").load(str(folder))
    mine = {r.file: r for r in SF.interpret(one).collect()}
    theirs = {r.file: r for r in SF.read_scans(spark, str(folder)).collect()}
    assert set(mine) == set(theirs) | {"empty.asd"} and len(mine) == 9   # the binary reader passes over empty files
    for k, r in ((k, r) for k, r in mine.items() if k in theirs):
        for c in ("reject_reason", "serial", "joins_source", "kind", "r", "timestamps", "sample_dn", "file_sha256", "length"):
            assert getattr(r, c) == getattr(theirs[k], c), (k, c)
    codes = {r.path.rsplit("/", 1)[1]: r.error_code for r in one.select("path", "error_code").collect()}
    assert codes == {"a.asd": None, "b.ASD": None, "c.001": None, "alone.sco": None, "z.asd": None, "cut.asd": "truncated_samples", "tiny.asd": "short_header", "odd.asd": "unknown_format", "empty.asd": "short_header"}
    large = spark.read.format("scan_files").option("maxFileBytes", 20_000).load(str(folder)).where("error_code = 'too_large'")
    assert {p.path.rsplit("/", 1)[1] for p in large.collect()} == {"a.asd", "b.ASD", "z.asd", "odd.asd"}
    assert spark.read.format("scan_files").option("recursiveFileLookup", "false").load(str(folder)).count() == 8


def test_header_columns_need_the_header_bytes_only(spark, folder, monkeypatch):
    full = spark.read.format("scan_files").load(str(folder))
    head = spark.read.format("scan_files").option("columns", "header").load(str(folder))
    names = [c for c in head.columns if c != "arrival_seq"]
    assert "sample_dn" not in names and sorted(map(str, head.select(names).collect())) == sorted(map(str, full.select(names).collect()))
    asked = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

        def size(self):
            return self.f.size()

        def read_at(self, n, off):
            asked.append(n)
            return self.f.read_at(n, off)

        def read(self):
            raise AssertionError("a header needs no whole file")

    fs, _ = SS.opened(str(folder))

    class Through:
        def open_input_file(self, p):
            return Counted(fs.open_input_file(p))

    monkeypatch.setattr(SS, "opened", lambda path: (Through(), path))
    rows = SS._Rows({"path": str(folder)}, SS.HEADERS)
    entries = [SS.Entry(str(folder / n), (folder / n).stat().st_size, 0) for n in ("a.asd", "b.ASD", "cut.asd")]
    assert sum(b.num_rows for b in rows.batches(entries)) == 3 and asked == [484] * 3


def test_partitions_follow_sizes(folder):
    parts = SS.packed([SS.Entry(f"f{i}", s, 0) for i, s in enumerate([100, 200_000, 300_000, 10, 10, 900_000])], 600_000)
    assert [[e.path for e in p.value] for p in parts] == [["f0", "f1", "f2"], ["f3", "f4"], ["f5"]]
    assert [len(p.value) for p in SS.packed([SS.Entry(str(i), 1, 0) for i in range(100)], 10 * SS.OPEN_BYTES)] == [10] * 10
    assert SS.packed([], 10) == []


def test_shapes_by_ranges_equal_those_of_the_content(spark):
    full = scan_bytes(spectrum(0))
    zeros = bytearray(full)
    inside = 484 + 8 * 2151 + 20 + 4 + 8 * 2069        # 32 channels up to 2450 nm
    zeros[inside:inside + 8 * 32] = bytes(8 * 32)
    cases = {"ok": full, "short": b"a", "empty": b"", "zero": b"\0" * 600, "odd": b"PK" * 400, "head": full[:400], "block": full[:5000], "ref": full[:-10], "zeroref": full[:-17208] + b"\0" * 17208, "legacy": scan_bytes(spectrum(0), b"ASD"),
             "trailer": full + b"\0" * 100, "whole": full + b"\0" * 212, "inside": bytes(zeros), "as7": scan_bytes(spectrum(1), b"as7"), "fmt": scan_bytes(spectrum(0), fmt=7), "none": scan_bytes(spectrum(0), channels=0), "refhead": full[:484 + 8 * 2151 + 10],
             "legacyzero": scan_bytes(spectrum(0), b"ASD")[:-2000] + bytes(2000)}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "scan_id string, content binary")
    jvm = {k: (v.state, v.reason) for k, v in by_id(df.withColumn("s", SF.file_shape(F.col("content"))), "s").items()}
    mine = {k: SS.shape_of(lambda off, n, b=b: b[off:off + n], len(b)) for k, b in cases.items()}
    assert mine == jvm
    assert {k for k, v in mine.items() if v[0] == "complete"} == {"ok", "legacy", "whole", "as7"}
    assert mine["trailer"][1] == "file trailer incomplete" and mine["inside"][1].endswith("zero-filled")


def test_written_files_are_read_again(spark, folder, tmp_path):
    rows = [(f"w{i}.asd", bytearray(scan_bytes(spectrum(i)))) for i in range(5)] + [("sub/w9.asd", bytearray(scan_bytes(spectrum(9), cut=700)))]
    spark.createDataFrame(rows, "name string, content binary").repartition(3).write.format("scan_files").mode("append").save(str(tmp_path / "out"))
    got = {r.path.rsplit("/", 1)[1]: r for r in spark.read.format("scan_files").load(str(tmp_path / "out")).collect()}
    assert set(got) == {"w0.asd", "w1.asd", "w2.asd", "w3.asd", "w4.asd", "w9.asd"} and got["w9.asd"].error_code == "truncated_samples"
    assert np.allclose(np.array(got["w3.asd"].sample_dn) / np.array(got["w3.asd"].reference_dn), spectrum(3))
    assert not [n for _, _, names in os.walk(tmp_path / "out") for n in names if n.endswith(".part")]


def test_stream_numbers_arrivals_and_sees_rewrites(spark, folder, tmp_path):
    src, index, out = tmp_path / "in", tmp_path / "index", tmp_path / "out"
    src.mkdir()

    def put(name, seed, at):
        (src / name).write_bytes(scan_bytes(spectrum(seed)))
        os.utime(src / name, (at, at))

    def run():
        s = spark.readStream.format("scan_files").option("indexLocation", str(index)).option("maxFilesPerTrigger", 2).load(str(src))
        q = s.select("arrival_seq", "path", "serial", "file_sha256", "length").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    for i in range(5):
        put(f"s{i}.asd", i, 1000 + i)
    (src / "s1.asd.sco").write_bytes(b"")
    run()
    got = {(r.arrival_seq, r.path.rsplit("/", 1)[1]) for r in spark.read.parquet(str(out)).collect()}
    assert got == {(i + 1, f"s{i}.asd") for i in range(5)}
    # a restart goes on where it was; an older file that comes late, and one rewritten in place, arrive too
    put("late.asd", 7, 900)
    put("s0.asd", 8, 2000)
    run()
    run()
    rows = spark.read.parquet(str(out)).collect()
    assert sorted(r.arrival_seq for r in rows) == list(range(1, 8)) and [r.path.rsplit("/", 1)[1] for r in sorted(rows, key=lambda r: r.arrival_seq)][5:] == ["late.asd", "s0.asd"]
    assert len({r.file_sha256 for r in rows if r.path.endswith("s0.asd")}) == 2


def test_index_is_final_and_forgets_by_age(tmp_path):
    day = 86_400_000_000
    e = lambda p, t, size=1: SS.Entry(p, size, t)
    one = SS.Index(str(tmp_path / "i"))
    one.add([e("b", 5), e("a", 5), e("c", 1)], None)
    one.add([e("b", 5), e("a", 6), e("c", 1)], None)
    again = SS.Index(str(tmp_path / "i"))
    assert [(x.path, x.time_us, x.seq) for x in again.between(0, 4)] == [("c", 1, 1), ("a", 5, 2), ("b", 5, 3), ("a", 6, 4)] and again.length == 4
    assert [x.seq for x in again.between(2, 3)] == [3] and again.between(4, 4) == []
    again.add([e("a", 6), e("new", 10 * day), e("old", 3 * day)], 2 * day)
    assert again.known == {"new": (1, 10 * day)} and again.length == 5


def test_a_stream_needs_its_index(spark, folder):
    with pytest.raises(Exception, match="indexLocation"):
        spark.readStream.format("scan_files").load(str(folder)).writeStream.format("noop").option("checkpointLocation", str(folder) + f"-ck{time.time()}").start().processAllAvailable()


def test_planning_holds_files_compressed(tmp_path):
    """Of very many files, planning and the stream's index hold some bytes each, whichever folder they stand in."""
    n = 40_000
    found = lambda: (SS.Entry(f"/shared/scans/{k // 4000}/d{k}.asd", 1144, 1_700_000_000_000_000 + k * 7919 % n) for k in range(n))
    tracemalloc.start()
    try:
        parts = SS.packed(found(), SS.PARTITION_BYTES)
        held = tracemalloc.get_traced_memory()[0]
        assert held < 80 * n and sum(len(p.value) for p in parts) == n
        tracemalloc.reset_peak()
        one = SS.Index(str(tmp_path / "i"))
        one.add(found(), None)
        assert tracemalloc.get_traced_memory()[0] - held < 80 * n and one.length == n
    finally:
        tracemalloc.stop()
    assert len(one.files) == -(-n // SS.INDEX_FILE)
    again = SS.Index(str(tmp_path / "i"))
    again.add(found(), None)
    assert again.length == n and again.known == {e.path: (e.size, e.time_us) for e in found()}
    got = again.between(0, n)
    assert [e.seq for e in got] == list(range(1, n + 1)) and [(e.time_us, e.path) for e in got] == sorted((e.time_us, e.path) for e in found())


def test_rows_are_made_in_small_batches():
    whole = pa.RecordBatch.from_pydict({"k": list(range(1000))})
    parts = list(SS.sliced([whole, whole.slice(0, 0)]))
    assert max(b.num_rows for b in parts) == SS.BATCH and [k for b in parts for k in b.column("k").to_pylist()] == list(range(1000))
