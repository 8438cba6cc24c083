"""The whole job on a handful of scans: streams, models, offsets, overrides, rejected rows kept."""
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenscan.operators import noise as Z
from lumenscan.plans.screening import Screening, predictions, score
from lumenscan.rulebook import PROFILE_COLLAGEN, STANDARD_CLASS
from conftest import WL, by_id, row, scans, spectrum
from tests_util import brute_blur, derivative

HI = "asd.labspec4.hires"


def regression(mid, lo, hi):
    w = [float(x) for x in range(lo, hi + 1)]
    b = [float(-2e3 * np.exp(-0.5 * ((x - (lo + hi) / 2) / 4) ** 2)) for x in w]
    return {"id": mid, "version": "1.0.0", "kind": "regression", "instrument": {"trained_on_class": STANDARD_CLASS}, "preprocessing": [{"op": "absorbance", "clip_min": 1e-6}, {"op": "savgol", "window": 31, "polyorder": 3, "deriv": 2}],
            "features": {"wavelengths_nm": w}, "regression": {"coefficients": b, "offset": 1.0}}


def consensus(mid):
    def part(lo, hi, c):
        return {"type": "linear", "wavelengths_nm": [float(x) for x in range(lo, hi)], "weights": [float(x) for x in np.convolve([1.0, -2.0, 1.0], np.hanning(hi - lo - 2) * c)], "offset": 0.7}
    return {"id": mid, "version": "1", "kind": "consensus", "instrument": {"trained_on_class": STANDARD_CLASS}, "preprocessing": [{"op": "absorbance", "clip_min": 1e-6}], "features": {"wavelengths_nm": []},
            "consensus": {"combine": "median", "components": [{"name": n, "id": n, "feature": part(lo, hi, c)} for n, lo, hi, c in (("wc2045", 2015, 2075, 1e3), ("wc1500", 1510, 1580, 9e2), ("F05", 2145, 2205, 1e3))]}}


SNV = {"id": "s1", "version": "1", "kind": "regression", "instrument": {"trained_on_class": STANDARD_CLASS}, "preprocessing": [{"op": "absorbance", "clip_min": 1e-6}, {"op": "savgol", "window": 31, "polyorder": 3, "deriv": 2}, {"op": "snv", "blocks_nm": [[1500, 1550]]}],
       "features": {"wavelengths_nm": [1510.0, 1520.0]}, "regression": {"coefficients": [1.0, 2.0], "offset": 9.5}}
CORRECTION = {"id": "hi2std", "version": "0.1.0", "source_class": HI, "target_class": STANDARD_CLASS, "operator": [{"op": "gaussian_blur", "sigma_nm": [1.0, 2.5, 2.5], "radius": "ceil"}, {"op": "absorbance_affine", "gain": [1.0, 1.2, 0.8], "offset": 0.0, "clip_min": 1e-6}],
              "provenance": {"visible_levels": "not_fitted"}, "reader_offsets": {"wc2045": 0.1, "ryder": -0.2}}
PROFILE = {**PROFILE_COLLAGEN, "models": [{"key": "cons3", "model_id": "cons3", "role": "verdict_input", "components": ["wc2045", "wc1500", "F05"]}, {"key": "ryder2045", "model_id": "ryder", "role": "published", "shown_for": "every_scan"},
                                          {"key": "s1_r2", "model_id": "s1", "role": "second_opinion", "shown_for": "non_native", "reads": "as_measured"}]}


@pytest.fixture(scope="module")
def run(spark):
    X = {k: spectrum(i) for i, k in enumerate(("std", "hires", "trek", "loud"))}
    X["loud"] = spectrum(3, 1e-3)
    rows = [row("std", X["std"], serial=28313), row("hires", X["hires"], cls=HI, serial=28313), row("trek", X["trek"], joins=(1000.0, 1785.0), cls="asd.trek"), row("panel", np.full(2151, 1.0)), row("short", X["std"][:500]), row("loud", X["loud"]), row("rock", 0.5 - 0.1 * np.exp(-0.5 * ((WL - 1450) / 60) ** 2))]
    E = -derivative(X["std"], WL, 31, 3, 1e-6, -1e5)
    def proto(windows):
        v = np.concatenate([E[lo - 350:hi - 349] for lo, hi in windows])
        return ((v - v.mean()) / v.std())[None, :]
    cfg = Screening(models={"cons3": consensus("cons3"), "ryder": regression("ryder", 2030, 2060), "s1": SNV}, corrections=[CORRECTION], profiles={"radiocarbon": PROFILE}, consensus_factors={"cons3": 1.1},
                    prototypes=proto([(1350, 1560), (1850, 2400)]), prototypes_truncated=proto([(1350, 1560), (1850, 2300)]))
    df = scans(spark, rows)
    return X, df, cfg, {r.scan_id: r for r in score(df, cfg).collect()}


def test_every_scan_keeps_a_row(run):
    _, df, _, got = run
    assert set(got) == {"std", "hires", "trek", "panel", "short", "loud", "rock"}
    assert (got["panel"].verdict.verdict, got["panel"].verdict.rule_step, got["panel"].m) == ("Rescan", "B4", None)
    assert (got["short"].verdict.verdict, got["short"].verdict.rule_step) == ("Unsupported", "B1") and got["short"].sort_group == 6
    assert got["rock"].verdict.verdict == "Doesn't look like bone" and got["rock"].b9.outcome == "fail" and got["std"].b9.score > 0.999


def test_streams_and_notes(run):
    _, _, _, got = run
    assert got["std"].native_reason == "native standard-resolution scan" and got["hires"].native_reason is None and got["hires"].correction_id == "hi2std" and got["trek"].correction_id is None and got["trek"].uncalibrated
    notes = {k: [n.key for n in got[k].instrument_notes] for k in got}
    assert "serial_class_mismatch" in notes["std"] and notes["hires"] == ["visible_levels_not_fitted"] and "instrument_uncalibrated" in notes["trek"]
    assert got["trek"].evidence.level is None and got["trek"].pattern.verdict is None and got["std"].evidence.level is not None
    assert got["loud"].b6b.signs_gated == ["plaster", "wax", "ester", "C1"] and got["loud"].signs.wax.status.state == "gated" and got["loud"].C1.gated
    assert "second_opinion_differs" in [n.key for n in got["hires"].verdict.notes_all] and "second_opinion_differs" not in [n.key for n in got["std"].verdict.notes_all + got["trek"].verdict.notes_all]


def test_readings_through_the_correction(run):
    X, _, cfg, got = run
    seg = np.where(WL <= 1000, 0, np.where(WL <= 1800, 1, 2))
    b = brute_blur(WL, X["hires"][None, :], (1000.0, 1800.0), sigma_nm=[1.0, 2.5, 2.5], radius="ceil")[0]
    stream = 10 ** -(np.array([1.0, 1.2, 0.8])[seg] * np.log10(1 / np.maximum(b, 1e-6)))
    E = derivative(stream, WL, 31, 3, 1e-6, -1e5)
    assert abs(got["hires"].evidence.bands["CH1728"].E - E[1376:1381].mean()) < 1e-6
    for k, r, off in (("std", X["std"], (0.0, 0.0)), ("hires", stream, (0.1, -0.2))):
        d = regression("ryder", 2030, 2060)
        want = 1.0 + derivative(r, WL, 31, 3, 1e-6, 1.0)[1680:1711] @ np.array(d["regression"]["coefficients"]) + off[1]
        assert abs(got[k].models["ryder"].value - want) < 1e-7
        a = np.log10(1 / np.maximum(r, 1e-6))
        comps = {c["name"]: 0.7 + a[np.array(c["feature"]["wavelengths_nm"], int) - 350] @ np.array(c["feature"]["weights"]) for c in consensus("c")["consensus"]["components"]}
        comps["wc2045"] += off[0]
        assert abs(got[k].m - sorted(comps.values())[1]) < 1e-7 and abs(got[k].components["wc2045"] - comps["wc2045"]) < 1e-7
    assert got["std"].m_sd == pytest.approx(1.1 * sorted(got["std"].model_sd["cons3"].component_sd.values())[1])
    assert got["hires"].signs.burnt.edge50_nm is not None and got["hires"].b6["cons3"].status.state == "assessed"


def test_predictions_agree_with_the_screening(run):
    _, df, cfg, got = run
    keep = df.where(F.col("scan_id").isin("std", "hires", "trek"))
    for r in predictions(keep, cfg, {"s1": "as_measured"}).collect():
        want = got[r.scan_id].models[r.model_id].value
        assert abs(r.value - want) < 1e-9 and (r.model_id != "s1" or r.correction_id == "none")


def test_noise_request_windows():
    assert (2220.0, 2245.0) in Z.n2_windows_for(Z.statistic_requests(__import__("lumenscan.rulebook", fromlist=["RULES"]).RULES))


def test_readable_and_technical_tables(spark, run):
    from lumenscan.sources.export import log_records, readable_table, technical_table
    _, df, cfg, got = run
    one = score(df.where("scan_id IN ('std', 'trek', 'panel')"), replace(cfg, cut_plan=True)).checkpoint()
    assert {r.scan_id: r.verdict.verdict for r in one.collect()} == {k: got[k].verdict.verdict for k in ("std", "trek", "panel")}
    st = by_id(one, "model_status")
    assert st["panel"]["cons3"].reason == "the scan is not scored" and st["panel"]["s1"].reason == "no spectrum" and st["std"]["s1"].state == "assessed"
    words = {r.scan_id: r for r in readable_table(one, {"ryder": "ryder", "s1": "s1"}).collect()}
    assert words["panel"].verdict == "Rescan" and words["panel"].collagen == "" and words["trek"].protein_bands == "Not assessed" and words["trek"].band_check.startswith("Not assessed: band evidence")
    assert words["std"].collagen == "< 0.5%" and words["std"].ryder == f"{got['std'].models['ryder'].value:.1f}%" and words["std"].serial == "28313"
    assert not set(words["std"].why.split(". ")) & set(words["std"].also_noted.split(". ")) or words["std"].also_noted == ""
    t = technical_table(one, "radiocarbon", maps={"n2": ["2000-2100"], "models": ["ryder"]})
    assert {"verdict.verdict", "evidence.S", "n2.2000-2100", "models.ryder.value", "acquisition.B4.mean_R", "verdict.notes_shown.n"} <= set(t.columns)
    row = t.where("scan_id = 'std'").first()
    assert row["n2.2000-2100"] == got["std"].n2["2000-2100"]
    log = log_records(one.withColumns({"path": F.col("scan_id"), "input_sha256": F.sha2("scan_id", 256), "class_source": F.lit("user")}), "e", {"m": "1"})
    assert log.select("result_key").distinct().count() == 3


def test_saved_references_are_listed_not_scored(run):
    _, df, cfg, got = run
    two = df.where("scan_id IN ('std', 'hires')").withColumn("kind", F.when(F.col("scan_id") == "std", F.lit("white_reference_save")).otherwise(F.lit("sample")))
    res = {r.scan_id: r.verdict for r in score(two, cfg).select("scan_id", "verdict").collect()}
    assert (res["std"].verdict, res["std"].rule_step) == ("Not scored", "B1") and res["hires"].verdict == got["hires"].verdict.verdict


def test_every_part_of_the_configuration_counts_in_the_result_key(run):
    _, _, cfg, _ = run
    base = cfg.dependencies()
    rules = {**cfg.rules, "acquisition": {**cfg.rules["acquisition"], "some_cut": 1}}
    model = next(iter(cfg.models.values()))
    changed = [replace(cfg, rules=rules), replace(cfg, profiles={}), replace(cfg, models={**cfg.models, model["id"]: {**model, "note": "x"}}), replace(cfg, bands={}), replace(cfg, target="other")]
    assert cfg.dependencies() == base == replace(cfg).dependencies()
    assert all(c.dependencies() != base for c in changed)


def far_model(mid):
    rng = np.random.default_rng(4)
    d = regression(mid, 2100, 2120)
    p = len(d["features"]["wavelengths_nm"])
    r, _ = np.linalg.qr(rng.standard_normal((p, 2)))
    return {**d, "domain": {"method": "pls_t2_q", "x_center": (1e-6 * rng.standard_normal(p)).tolist(), "t2_limit": 3.0, "q_limit": 1e-13, "levels": [{"label": "near", "below": 1.0}, {"label": "far"}],
                            "components": [{"weights_r": r[:, k].tolist(), "loadings_p": (r[:, k] * 1.1).tolist(), "score_var": 2e-11} for k in range(2)]}}


def test_domain_of_linear_models_comes_from_the_kernel_pass(spark, run):
    X, df, cfg, _ = run
    d = far_model("far")
    profile = {**PROFILE, "models": PROFILE["models"] + [{"key": "far", "model_id": "far", "role": "published", "shown_for": "every_scan"}], "domain_note_ratio_above": 3.0}
    one = replace(cfg, models={**cfg.models, "far": d}, profiles={"radiocarbon": profile})
    rows = {r.scan_id: r for r in score(df.where("scan_id IN ('std', 'loud', 'panel')"), one).select("scan_id", "model_domain", "domain_notes", "models").collect()}
    dom = d["domain"]
    R, P = (np.array([c[k] for c in dom["components"]]).T for k in ("weights_r", "loadings_p"))
    for k in ("std", "loud"):
        e = derivative(X[k], WL, 31, 3, 1e-6, 1.0)[1750:1771] - np.array(dom["x_center"])
        t = e @ R
        t2, q = (t * t / 2e-11).sum(), ((e - P @ t) ** 2).sum()
        got = rows[k].model_domain["far"]
        assert got.T2 == pytest.approx(t2, rel=1e-7) and got.Q == pytest.approx(q, rel=1e-7) and got.ratio == pytest.approx(max(t2 / 3.0, q / 1e-13), rel=1e-7)
        assert got.level == ("near" if got.ratio < 1 else "far") and rows[k].domain_notes == (["far"] if got.ratio > 3 else [])
        assert "ryder" not in rows[k].model_domain
    assert rows["loud"].domain_notes == ["far"] and rows["panel"].model_domain["far"] is None and rows["panel"].domain_notes == []


def test_noise_document_reaches_the_screening(spark, run):
    from lumenscan.sources.parameters import ParamTables, noise_parameters
    from lumenscan.plans.screening import from_parameters
    doc = {"consensus": {"cons3": {"factor": 1.1}}, "models": {"s1": {"recorded": {"terms": [{"window_nm": [2000, 2100], "gain": 2.0}]}}, "ryder": {"b6": False}, "x": {"note": "n"}}}
    assert noise_parameters(doc) == {"consensus_factors": {"cons3": 1.1}, "recorded_gains": {"s1": [{"window_nm": [2000, 2100], "gain": 2.0}]}, "no_b6": ("ryder",)}
    assert noise_parameters({}) == {"consensus_factors": {}, "recorded_gains": {}, "no_b6": ()}
    _, df, cfg, got = run
    p = ParamTables(documents=None, noise=doc)
    made = from_parameters(p, models=cfg.models, profiles=cfg.profiles)
    assert made.consensus_factors == {"cons3": 1.1} and made.no_b6 == ("ryder",) and made.models is cfg.models


def test_refused_noise(spark):
    n2 = F.create_map(F.lit("2000-2100"), F.lit(3.0))
    gains = F.create_map().cast("map<string,struct<terms:array<struct<lo:double,hi:double,gain:double>>,base:double,reason:string>>")
    df = spark.createDataFrame([("ok", 350.0, 1.0, 2151, [1000.0, 1800.0]), ("join", 350.0, 1.0, 2151, [1000.0, 2050.0]), ("short", 350.0, 1.0, 1500, [1000.0])], "scan_id string, wl_start double, wl_step double, n_ch int, joins_nm array<double>").withColumns({"n2": n2, "gains": gains})
    docs = [SNV, {**regression("logged", 2030, 2040), "output": {"y_transform": {"type": "log10"}}}]
    out = {r.scan_id: r.model_sd for r in Z.implied_sd(df, docs, recorded={"s1": [{"window_nm": [2000, 2100], "gain": 2.0}]}).collect()}
    assert out["ok"]["s1"].sd == pytest.approx(6.0) and out["ok"]["s1"].status.state == "assessed"
    assert out["join"]["s1"].sd is None and "2000-2100" in out["join"]["s1"].status.reason and out["short"]["s1"].sd is None
    assert out["ok"]["logged"].sd is None and "log10" in out["ok"]["logged"].status.reason
