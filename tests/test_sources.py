import json
import struct
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenscan.operators import quality as Q
from lumenscan.plans import validate as VD
from lumenscan.sources import export as EX
from lumenscan.sources import parameters as PR
from lumenscan.sources import scan_files as SF
from lumenscan.sources import spectra_json as SJ
from lumenscan.sources import views as VW
from lumenscan.streaming import watch as WT
from conftest import by_id, row, scans, spectrum
from tests_util import derivative
from conftest import WL

REF = np.linspace(3000, 6000, 2151)


def scan_bytes(r, magic=b"as8", serial=28404, joins=(1000.0, 1800.0), ref=REF, cut=None, channels=2151, fmt=2, dc=1):
    b = bytearray(484)
    b[0:3] = magic
    struct.pack_into("<9h", b, 160, 5, 4, 3, 2, 0, 124, 0, 0, 0)
    b[181], b[186], b[199] = dc, 1 if magic == b"ASD" else 0, fmt
    struct.pack_into("<i", b, 187, int((45000.0 - 25569) * 86400) - 7200)
    struct.pack_into("<ff", b, 191, 350.0, 1.0)
    struct.pack_into("<H", b, 204, channels)
    struct.pack_into("<H", b, 400, serial)
    struct.pack_into("<HH", b, 436, 200, 210)
    struct.pack_into("<ff", b, 444, *joins)
    if magic == b"ASD":
        return bytes(b) + np.asarray(r, "<f8").tobytes()
    head = struct.pack("<hddH", -1, 45000.0, 45000.01, 4) + b"note" if magic == b"as8" else struct.pack("<BddH", 1, 45000.0, 45000.01, 4) + b"\0" + b"note"
    out = bytes(b) + np.asarray(r * ref, "<f8").tobytes() + head + np.asarray(ref, "<f8").tobytes()
    return out if cut is None else out[:cut]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("scans")
    r = spectrum(0)
    files = {"a.asd": scan_bytes(r), "b.ASD": scan_bytes(spectrum(1), b"as7", 1, (0.0, 0.0)), "c.001": scan_bytes(spectrum(2), b"ASD"), "c.001.sco": scan_bytes(spectrum(2), b"ASD"), "cut.asd": scan_bytes(r, cut=9000), "tiny.asd": b"as8",
             "white.asd": scan_bytes(np.ones(2151)), "dark.asd": scan_bytes(r, dc=0), "other.asd": scan_bytes(r, b"xyz"), ".hidden.asd": scan_bytes(r), "~lock.asd": b"", "x.tmp.asd": b"", "note.txt": b"", "alone.sco": scan_bytes(spectrum(3), b"ASD")}
    for n, b in files.items():
        (d / n).write_bytes(b)
    sub = d / "deeper"
    sub.mkdir()
    (sub / "z.asd").write_bytes(scan_bytes(spectrum(4)))
    return d


def test_read_scans(spark, folder):
    got = {r.file: r for r in SF.read_scans(spark, str(folder)).collect()}
    assert set(got) == {"a.asd", "b.ASD", "c.001", "cut.asd", "tiny.asd", "white.asd", "dark.asd", "other.asd", "alone.sco", "z.asd"}
    assert {r.file for r in SF.read_scans(spark, str(folder), recursive=False).select("file").collect()} == set(got) - {"z.asd"}
    a = got["a.asd"]
    assert a.reject_reason is None and a.serial == 28404 and a.joins_source == "header" and np.allclose(a.r, spectrum(0), atol=1e-12) and a.kind == "sample" and (a.swir1_gain, a.swir2_gain) == (200, 210)
    assert str(a.timestamps.spectrum_local) == "2023-03-15 00:14:24" and a.timestamps.utc_offset_min == 120 and abs(a.timestamps.reference_age_s - 864) < 1e-6 and str(a.timestamps.header_local) == "2024-01-02 03:04:05"
    assert got["b.ASD"].format == "as7" and got["b.ASD"].joins_source == "default" and np.allclose(got["b.ASD"].r, spectrum(1)) and np.allclose(got["c.001"].r, spectrum(2)) and got["c.001"].sample_dn is None
    assert got["cut.asd"].reject_reason == "unsupported: truncated sample block" and got["tiny.asd"].reject_reason == "unsupported: file shorter than the header" and got["white.asd"].kind == "white_reference_save"
    assert got["dark.asd"].reject_reason == "unsupported: dark correction flag not set" and got["other.asd"].reject_reason.startswith("unsupported: file version") and got["other.asd"].r is None


def test_scan_report_keeps_every_file(spark, folder):
    rep = {r.file: r for r in Q.scan_report(SF.read_scans(spark, str(folder))).collect()}
    assert (rep["a.asd"].acceptance, rep["white.asd"].acceptance, rep["cut.asd"].acceptance) == ("accepted", "not_scored", "rejected")
    assert [c.id for c in rep["a.asd"].checks] == ["B1", "B2", "B3", "B4", "B5", "B6", "B6b", "B7", "B8"] and rep["cut.asd"].worst_outcome == "Unusable" and rep["cut.asd"].checks[1].status.reason == "the file could not be read (B1)"
    assert rep["white.asd"].checks[2].status.reason == "reference scan (not scored)" and rep["a.asd"].worst_outcome in ("Pass", "Note")


def test_large_files_keep_their_row(spark, folder, monkeypatch):
    monkeypatch.setattr(SF, "MAX_FILE_BYTES", 20_000)
    got = {r.file: r for r in SF.read_scans(spark, str(folder)).select("file", "reject_reason", "r").collect()}
    assert got["a.asd"].reject_reason == "unsupported: larger than 0 MiB" and got["a.asd"].r is None
    assert got["c.001"].reject_reason is None and "c.001.sco" not in got and "alone.sco" in got


def test_file_shapes(spark):
    full = scan_bytes(spectrum(0))
    cases = {"ok": full, "short": b"a", "zero": b"\0" * 600, "odd": b"PK" * 400, "head": full[:400], "block": full[:5000], "ref": full[:-10], "zeroref": full[:-17208] + b"\0" * 17208, "legacy": scan_bytes(spectrum(0), b"ASD")}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "scan_id string, content binary")
    got = by_id(df.withColumn("s", SF.file_shape(F.col("content"))), "s")
    assert {k: v.state for k, v in got.items()} == {"ok": "complete", "short": "incomplete", "zero": "incomplete", "odd": "unrecognised", "head": "incomplete", "block": "incomplete", "ref": "incomplete", "zeroref": "incomplete", "legacy": "complete"}


def test_spectra_json_and_hash(spark, tmp_path):
    doc = {"format": "x", "spectra": [{"name": "a", "wl_start_nm": 350.0, "wl_step_nm": 1.0, "values": [0.1, 0.2], "sha256": "z", "scan_context": {"serial": 5}}, {"name": "e", "wl_start_nm": 350.0, "wl_step_nm": 1.0, "values": []}]}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    d = SJ.read_spectra_json(spark, str(tmp_path / "s.json"))
    got = {r.scan_id: r for r in SF.with_spectrum_hash(d).collect()}
    import hashlib
    want = hashlib.sha256(SF.SPECTRUM_TAG + np.array([350.0, 351.0]).tobytes() + np.array([0.1, 0.2]).tobytes()).hexdigest()
    assert got["a"].spectrum_sha256 == want and got["a"].serial == 5 and got["a"].joins_nm == [1000.0, 1800.0] and got["e"].reject_reason and got["e"].spectrum_sha256 is None
    (tmp_path / "bad.json").write_text('{"spectra": [{"values": ["x"]}]}')
    with pytest.raises(Exception):
        SJ.read_spectra_json(spark, str(tmp_path / "bad.json")).collect()


def small_model(mid="m", version="1.0.0", **extra):
    return {"format": "lab/model", "format_version": 1, "id": mid, "version": version, "title": "t", "kind": "regression", "instrument": {"trained_on_class": "s"}, "input": {}, "preprocessing": [{"op": "absorbance", "clip_min": 1e-3}],
            "features": {"wavelengths_nm": [350.0, 352.0]}, "regression": {"coefficients": [1.0, 2.0], "offset": 0.5}, "golden": {"cases": []}, **extra}


def test_parameters_and_validation(spark, tmp_path):
    b, u = tmp_path / "bundled", tmp_path / "user"
    b.mkdir(), u.mkdir()
    x = [0.1, 0.2, 0.4]
    value = 0.5 + np.log10(1 / 0.1) + 2 * np.log10(1 / 0.4)
    cases = [{"name": f"c{i}", "spectrum_sha256": "h", "expected": {"value": float(value)}, "features": [1.0, 1.0]} for i in range(3)]
    (b / "m1.json").write_text(json.dumps(small_model()))
    (b / "m2.json").write_text(json.dumps(small_model(version="1.2.0", golden={"cases": cases})))
    (u / "t.json").write_text(json.dumps({"format": "lab/transfer", "id": "t", "version": "1.0.0", "source_class": "h", "target_class": "s", "operator": [{"op": "absorbance_affine", "gain": 0.0, "clip_min": 1e-3}], "reader_offsets": {"m": 1.0, "zz": 9.0}, "golden": {}}))
    (u / "p.json").write_text(json.dumps({"format": "lab/analysis_profile", "analysis": "zz", "id": "p", "version": "1", "parameters": {"kind": "zooms_pattern"}}))
    (u / "inf.json").write_text('{"format": "lab/model", "id": "w", "version": "1", "x": 1e999}')
    p = PR.load_params(spark, [str(b), str(u)])
    assert p.models["m"]["version"] == "1.2.0" and p.corrections[0]["id"] == "t" and p.corrections[0]["origin"] == 1 and p.profiles["zz"]["kind"] == "zooms_pattern" and len(p.errors) == 1
    assert {(r.wl, r.coef) for r in p.coefficient_table(spark).collect()} == {(350.0, 1.0), (352.0, 2.0)} and p.model_table(spark).count() == 1 and p.band_table(spark).count() == 7
    bad = {(r.file.split("/")[-1], r.rule) for r in VD.validate_params(p.documents).where("NOT ok").collect()}
    assert {("t.json", "gain"), ("t.json", "reader_offsets"), ("t.json", "cases"), ("t.json", "reader_offset_model"), ("m1.json", "cases")} <= bad and not any(f == "m2.json" for f, _ in bad)
    spectra = spark.createDataFrame([("h", 350.0, 1.0, x)], "spectrum_sha256 string, wl_start double, wl_step double, r array<double>")
    assert VD.replay_cases(spark, p.models["m"], spectra).where("problem is not null").count() == 0
    wrong = {**p.models["m"], "regression": {"coefficients": [1.0, 2.1], "offset": 0.5}}
    assert VD.replay_cases(spark, wrong, spectra).where("problem = 'out of tolerance'").count() == 3


def test_snv_rules(spark):
    m = small_model(engine_min="1.1", preprocessing=[{"op": "absorbance"}, {"op": "savgol", "window": 31, "polyorder": 3}, {"op": "snv", "blocks_nm": [[1500, 1550]]}], features={"wavelengths_nm": [1510.0, 1700.0]})
    rules = lambda doc: VD.block_snv_rules(spark.createDataFrame([("f", "model", json.dumps(doc))], "path string, format string, doc string")).collect()
    bad = lambda doc: {r.rule for r in rules(doc) if not r.ok}
    assert bad(m) == {"snv_features"}
    m["preprocessing"][2]["blocks_nm"] = [[360, 1800]]
    assert bad(m) == {"snv_edges"}
    m["instrument"]["training_splices_nm"] = [1000.0]
    m["engine_min"] = "1.0"
    assert bad(m) == {"snv_edges", "snv_joins", "snv_engine"}
    for blocks in ([], [[1550, 1500]], [[1500, 1550], [1540, 1600]]):
        m["preprocessing"][2]["blocks_nm"] = blocks
        assert bad(m) == {"snv_blocks"}
    m["preprocessing"] = [{"op": "savgol", "window": 31, "polyorder": 3, "mode": "valid"}, {"op": "crop", "range_nm": [400, 900]}, {"op": "snv", "blocks_nm": [[366, 500]]}, {"op": "absorbance"}]
    assert bad(m) == {"snv_engine", "snv_last", "snv_grid", "snv_features"}
    m["preprocessing"] = [{"op": "savgol", "window": 31, "polyorder": 3}, {"op": "resample", "to_grid": {"start_nm": 1400, "step_nm": 2, "n": 201}}, {"op": "snv", "blocks_nm": [[1400, 1800]]}]
    assert bad(m) == {"snv_engine"}


def test_views(spark):
    x = spectrum(1)
    d = VW.spectral_views(scans(spark, [row("s", x)]), 20)
    v = d.first()
    assert VW.odd_smoothing(20) == 21 and VW.odd_smoothing(9) == 11 and VW.odd_smoothing(99) == 51
    want = derivative(x, WL, 21, 3, 1e-6, -1e5)
    assert v.view_D2[5] is None and np.allclose(v.view_D2[10:-10], want[10:-10], atol=1e-7) and np.allclose(v.view_A, np.log10(1 / x)) and v.view_R_meas == v.view_R
    ref = VW.reference_views(VW.reference_table(spark, [{"label": "1%", "n": 3, "absorbance": np.log10(1 / x).tolist()}])).first()
    assert np.allclose(ref.view_R, x, atol=1e-12) and ref.label == "1%"


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1.23456789012345, float("nan"), ["a", "b"]), ("s2", None, 2.0, [])], "scan_id string, v double, w double, l array<string>").withColumn("c", F.struct(F.col("v").alias("x")))
    t = EX.export_technical(df, str(tmp_path / "csv"), "zooms")
    assert t.columns == ["scan_id", "v", "w", "l", "l.n", "c.x", "analysis"]
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert "\r\n" in text and "1.23456789012345" in text and "NaN" not in text
    m = json.loads(EX.manifest(df.withColumn("class", F.lit("std")), "zooms", {"m@1": "h"}).first().manifest)
    assert m["dependencies"] == {"m@1": "h"} and m["effective_configuration"]["instrument_class"] == "std" and m["result_revision"] == 1


def by_hand(records):
    """A CSV whose columns are the dotted keys in the order in which the rows show them."""
    import csv
    import io

    def flat(v, key):
        if isinstance(v, dict):
            return [x for k, w in v.items() for x in flat(w, f"{key}.{k}" if key else k)]
        if isinstance(v, list):
            return [(f"{key}.n", len(v))] + [x for i, w in enumerate(v) for x in flat(w, f"{key}.{i}")]
        return [(key, v)]

    rows = [dict(flat(r, "")) for r in records]
    columns = list(dict.fromkeys(k for r in rows for k in r))
    text = lambda v: "" if v is None or v != v or v in (float("inf"), float("-inf")) else str(v).lower() if isinstance(v, bool) else str(v)
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\r\n")
    w.writerow(columns)
    for r in rows:
        w.writerow([text(r.get(c)) for c in columns])
    return columns, out.getvalue()


def test_wide_export_has_the_keys_of_all_rows_in_first_seen_order(spark, tmp_path):
    keys = ["wc2045", "wc1500", "F05", "z,1", 'q"2', "late"]
    records = [{"path": f"p{i:03d}", "ok": i % 2 == 0, "v": float("nan") if i % 5 == 0 else i + 0.5, "m": {k: {"value": i * 0.25, "note": f'a "b", {j}\nc'} for j, k in enumerate(keys) if (i * 7 + j * 3) % 11 < 4 and (k != "late" or i > 90)},
                "l": [i, i + 1][:i % 3], "s": {"x": None if i % 4 else i}} for i in range(120)]
    # maps with the order of their entries kept
    schema = "path string, ok boolean, v double, m array<struct<key:string,value:struct<value:double,note:string>>>, l array<int>, s struct<x:int>, r array<double>"
    rows = [(*({**r, "m": list(r["m"].items())}).values(), [1.0]) for r in reversed(records)]
    df = spark.createDataFrame(rows, schema).repartition(7).withColumn("m", F.map_from_entries("m"))
    columns, want = by_hand(records)
    assert EX.export_wide(df, str(tmp_path / "wide"), [F.col("path")]) == columns and len(columns) > 14
    size = EX.one_file(spark, str(tmp_path / "wide"), str(tmp_path / "one.csv"))
    got = (tmp_path / "one.csv").read_bytes()
    assert size == len(got) and got == b"\xef\xbb\xbf" + want.encode()
    with pytest.raises(ValueError, match="more than 3"):
        EX.first_seen_keys(spark.createDataFrame([(1, [(str(i), "v") for i in range(4)])], "pos long, cells array<struct<key:string,value:string>>"), limit=3)


def simple_score(df):
    return Q.acquisition(df.withColumn("class", F.lit("std")).withColumn("class_source", F.lit("user"))).select(
        "path", "file", "input_sha256", "class", "class_source", "reject_reason", F.col("acquisition.B4.mean_R").alias("mean"))


def test_stream_equals_batch_and_rescan(spark, tmp_path):
    src, log, ck, qu = (tmp_path / n for n in ("in", "log", "ck", "q"))
    src.mkdir()
    for i in range(5):
        (src / f"s{i}.asd").write_bytes(scan_bytes(spectrum(i)))
    (src / "cut.asd").write_bytes(scan_bytes(spectrum(9), cut=9000))
    run = lambda: WT.score_stream(WT.stream_scans(spark, str(src), max_files=2), simple_score, str(log), str(ck), quarantine_path=str(qu)).awaitTermination()
    run()
    got = {json.loads(r.result)["file"]: json.loads(r.result)["mean"] for r in WT.read_log(spark, str(log)).collect()}
    batch = {r.file: r["mean"] for r in simple_score(SF.read_scans(spark, str(src)).withColumn("input_sha256", F.col("file_sha256"))).collect() if r.file != "cut.asd"}
    assert got == batch and len(got) == 5 and spark.read.parquet(str(qu)).count() == 1
    # a rewrite in place is not seen by the stream, the scheduled rescan picks it up; so is the completed file
    (src / "s0.asd").write_bytes(scan_bytes(spectrum(7)))
    (src / "cut.asd").write_bytes(scan_bytes(spectrum(9)))
    run()
    assert WT.read_log(spark, str(log)).count() == 5
    WT.rescan(spark, str(src), simple_score, str(log))
    WT.rescan(spark, str(src), simple_score, str(log))
    full = WT.read_log(spark, str(log))
    assert full.count() == 7 and full.where("path like '%s0.asd'").count() == 2
    rescored = lambda df: simple_score(df).withColumn("class", F.lit("hires"))
    table = SF.read_scans(spark, str(src)).withColumn("input_sha256", F.col("file_sha256"))
    WT.rescore(spark, table, rescored, str(log))
    rev = WT.result_revisions(WT.read_log(spark, str(log)))
    assert WT.read_log(spark, str(log)).count() == 13 and rev.where("revision = 2").count() == 6
    same = WT.same_content(spark.createDataFrame([("/other", rev.first().input_sha256)], "path string, file_sha256 string"), full)
    assert same.first().same_content_as.startswith("file:")


def test_streamed_dedupe_and_revisions(spark, tmp_path):
    rows = [("p", "a", 1), ("p", "a", 2), ("p", "b", 3), ("p", "a", 4), ("q", "a", 2)]
    df = spark.createDataFrame(rows, "path string, file_sha256 string, s int").withColumn("modificationTime", F.timestamp_seconds("s"))
    df.drop("s").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, file_sha256 string, modificationTime timestamp").parquet(str(tmp_path / "in"))
    for name, s in (("dd", WT.dedupe_arrivals(stream)), ("rv", WT.tracked_revisions(stream))):
        q = s.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("dd").count() == 3
    got = sorted((r.path, r.modificationTime.second, r.revision) for r in spark.table("rv").collect())
    want = sorted((r.path, r.modificationTime.second, r.revision) for r in WT.with_revisions(df.drop("s")).collect())
    assert got == want == [("p", 1, 1), ("p", 2, 1), ("p", 3, 2), ("p", 4, 3), ("q", 2, 1)]
