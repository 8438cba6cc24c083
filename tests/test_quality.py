import numpy as np
from pyspark.sql import functions as F

from lumenscan.operators import quality as Q
from lumenscan.operators import spectral as S
from conftest import WL, by_id, row, scans, spectrum


def test_acquisition_outcomes(spark):
    base = spectrum(0)
    neg, nan, dark, bright, step = base.copy(), base.copy(), base * 0.1, base.copy(), base.copy()
    neg[1000], nan[1200], bright[900] = 0.0, np.nan, 1.2
    step[1451:] *= 1.3
    rows = [row("ok", base), row("neg", neg), row("nan", nan), row("panel", np.full(2151, 1.0)), row("empty", np.full(2151, 0.02)), row("dark", dark), row("bright", bright), row("step", step),
            row("nojoin", base, joins=()), row("outside", np.where(WL < 900, -1.0, base))]
    d = Q.acquisition(scans(spark, rows))
    got = by_id(d.withColumn("u", Q.unusable()), "acquisition", "u")
    assert got["ok"][1] == [] and got["neg"][1] == ["B3"] and got["nan"][1] == ["B3"] and got["panel"][1] == ["B4"] and got["empty"][1] == ["B4"] and got["outside"][1] == []
    assert got["panel"][0].B4.reason == "white panel" and got["empty"][0].B4.reason == "empty probe"
    assert got["dark"][0].B5.outcome == "Note" and got["bright"][0].B7.outcome == "Note" and got["step"][0].B8.outcome == "Check"
    assert got["nojoin"][0].B8.outcome == "ok" and got["nojoin"][0].B8.relative_steps == [None, None] or got["nojoin"][0].B8.relative_steps is None
    assert got["ok"][0].B2.status.state == "not assessed"
    lo = np.polyval(np.polyfit(np.arange(651, 656), base[651:656], 1), 650)
    assert abs(got["ok"][0].B8.relative_steps[0] - abs(lo - base[650]) / base[651]) < 1e-12


def test_saturation_rules(spark):
    n = 60
    dn = lambda f: [float(f(i)) for i in range(n)]
    cases = {"clean": dn(lambda i: 1000 + i), "hot": dn(lambda i: 65000 if i == 20 else 1000 + i), "flat3": dn(lambda i: 2000 if 30 <= i <= 32 else 1000 + i), "flat2": dn(lambda i: 2000 if 30 <= i <= 31 else 1000 + i),
             "edge": dn(lambda i: 5000 if 19 <= i <= 21 else 1000)}
    df = spark.createDataFrame([(k, 1000.0, 1.0, [1020.0], v, dn(lambda i: 900 + i)) for k, v in cases.items()], "scan_id string, wl_start double, wl_step double, joins_nm array<double>, sample_dn array<double>, reference_dn array<double>")
    got = by_id(Q.saturation_report(df), "saturation")
    assert [got[k].outcome for k in ("clean", "hot", "flat3", "flat2")] == ["Pass", "Unusable", "Unusable", "Pass"]
    assert got["flat3"].saturated_channels == 3 and got["flat3"].first_saturated_nm == 1030.0
    # the run is cut by the join after 1020: 19-20 below, 21 above, and each side is flat at 1000 elsewhere
    assert got["edge"].outcome == "Pass"
    outside = Q.saturation_report(df.where("scan_id = 'hot'").withColumn("wl_start", F.lit(500.0)))
    assert by_id(outside, "saturation")["hot"].outcome == "Note"
    long = S.to_long(df.withColumn("r", F.col("sample_dn")))
    runs = {(r.scan_id, r.first_ch, r.n) for r in Q.flat_top_runs(long).collect()}
    assert ("flat3", 30, 3) in runs and not any(k == "flat2" for k, _, _ in runs)


def test_resolve_joins_and_kind(spark):
    ref = np.full(2151, 5000.0) + np.arange(2151)
    jump = ref.copy()
    jump[651:] *= 1.2
    jump[1436:] *= 0.8
    mk = lambda k, h, r: (k, 350.0, 1.0, [float(x) for x in h], None if r is None else [float(x) for x in r], [float(x) for x in (r if k == "white" else ref * 0.5)])
    df = spark.createDataFrame([mk("header", (1000, 1800), ref), mk("found", (0, 0), jump), mk("default", (0, 0), ref), mk("half", (1000.5, 1800), ref), mk("noref", (0, 0), None), mk("white", (1000, 1800), ref)],
                               "scan_id string, wl_start double, wl_step double, splices_header_nm array<double>, reference_dn array<double>, sample_dn array<double>")
    d = Q.classify_kind(Q.resolve_joins(df))
    got = by_id(d, "joins_nm", "joins_source", "kind")
    assert got["header"][:2] == ([1000.0, 1800.0], "header") and got["found"][:2] == ([1000.0, 1785.0], "reference_dn")
    assert got["default"][:2] == ([1000.0, 1800.0], "default") and got["half"][1] == "default" and got["noref"][1] == "default"
    assert got["white"][2] == "white_reference_save" and got["header"][2] == "sample"
    w = by_id(Q.join_warnings(d.withColumn("joins_nm", F.lit([1000.0, 1800.0])).where("scan_id = 'found'")), "join_warnings")["found"]
    assert len(w) == 1 and "header join 1800.0 nm" in w[0] and "after 1785.0 nm" in w[0]


def test_worst_outcome(spark):
    lit = lambda *v: Q.worst_outcome([F.lit(x) for x in v])
    got = spark.range(1).select(lit("ok", "Note"), lit(None, "Check"), lit("Unusable", "Note"), lit(None, None)).first()
    assert list(got) == ["Note", "Check", "Unusable", "Pass"]


def test_accept_spectrum(spark):
    df = scans(spark, [row("a", spectrum(0)), row("b", spectrum(0)[:100]), row("c", spectrum(0), joins=(1000.0, 1950.0)), row("d", spectrum(0), joins=None)])
    got = by_id(df.withColumn("x", Q.accept_spectrum(F.col("n"))), "x")
    assert got["a"] is None and got["b"] == "unsupported: wavelength grid" and got["c"].startswith("unsupported: detector joins") and got["d"].startswith("unsupported: detector joins")
