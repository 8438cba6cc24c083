import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenscan.operators import noise as Z
from lumenscan.operators import readings as R
from lumenscan.operators import spectral as S
from lumenscan.rulebook import BANDS, KERNEL_E31, RULES
from conftest import WL, by_id, row, scans, spectrum
from tests_util import n2

CORR = [{"id": "hi", "operator": [{"op": "gaussian_blur", "sigma_nm": [1.0, 2.5, 2.5], "radius": "ceil"}, {"op": "absorbance_affine", "gain": [1.0, 1.1, 0.9], "offset": 0.0, "clip_min": 1e-6}]},
        {"id": "snv", "operator": [{"op": "snv", "blocks_nm": [[1500, 1600]]}]}, {"id": "near", "operator": [{"op": "absorbance_affine", "gain": 1.05, "offset": 0.0, "clip_min": 1e-6}]}]


def test_n2_matches_brute_force(spark):
    X = [spectrum(i) for i in range(3)]
    X[2][1700] = np.nan
    df = scans(spark, [row(f"s{i}", x) for i, x in enumerate(X)] + [row("flat", np.full(2151, 0.5)), row("short", X[0][:3]), row("two", [0.1, 0.2]), row("e", [])])
    wins = ((2000.0, 2100.0), (1500.0, 1600.0), (1.0, 2.0))
    got = by_id(Z.n2(df, wins), "n2")
    for i, x in enumerate(X):
        for lo, hi in wins[:2]:
            assert abs(got[f"s{i}"][f"{lo:g}-{hi:g}"] - n2(x, WL, lo, hi)) < 1e-8
    assert got["flat"]["2000-2100"] == 0.0 and got["short"]["2000-2100"] is None and got["two"]["2000-2100"] is None and got["s0"]["1-2"] is None
    long = by_id(Z.n2_long(S.to_long(df), 2000.0, 2100.0), "n2")
    assert all(abs(long[f"s{i}"] - n2(x, WL, 2000, 2100)) < 1e-8 for i, x in enumerate(X))


def test_gain_predicts_the_spread_of_noisy_readings(spark):
    """Monte Carlo: noise of the model's kind gives readings whose SD is gain x N2, with and without a correction."""
    rng = np.random.default_rng(0)
    base = 0.4 + 0.05 * np.sin(WL / 200)
    g = np.exp(-0.5 * (np.arange(-10, 11) / 1.25) ** 2)
    X = []
    for _ in range(300):
        X.append(base * 10 ** (-np.convolve(rng.standard_normal(2151 + 20), g, "valid") * 2e-5))
    f = R.band_functional("E:CH1728", KERNEL_E31, 1728.0, 2.0)
    for ops in ((), CORR[0]["operator"]):
        got, problem = Z.reading_gains([(f, 1.25)], WL, (1000.0, 1800.0), ops)
        ((_, seg, gain),) = got
        assert not problem and seg == 1
        df = scans(spark, [row(f"s{i}", x) for i, x in enumerate(X)]).withColumn("correction_id", F.lit("hi" if ops else "none"))
        got = R.kernel_pass(df, [f], corrections=CORR).select(F.stddev(F.col("readings")["E:CH1728"])).first()[0]
        noise = np.mean([n2(x, WL, 1500, 1600) for x in X])
        assert abs(got / (gain * noise) - 1) < 0.12


def test_gains_by_layout_and_reasons(spark):
    rows = [row("a", spectrum(0)), row("b", spectrum(1)), row("c", spectrum(2), joins=(1000.0, 1785.0)), row("d", spectrum(3)), row("e", spectrum(3)[:1300]), row("f", spectrum(3), joins=(1000.0, 1728.0))]
    df = scans(spark, rows).withColumn("correction_id", F.when(F.col("scan_id") == "b", "hi").when(F.col("scan_id") == "d", "snv").otherwise("none"))
    req = Z.statistic_requests(RULES) + Z.band_requests(BANDS)
    d = Z.noise_gains(df, req, CORR, n=F.col("n"))
    got = by_id(d, "gains")
    assert got["a"]["sd:CH1728"].reason is None and got["a"]["sd:CH1728"].terms[0].gain != got["b"]["sd:CH1728"].terms[0].gain
    assert got["d"]["gate:wax"].reason == "non-linear correction"
    assert got["e"]["gate:wax"].reason.startswith("not available on this instrument")
    assert "crosses the detector join at 1728 nm" in got["f"]["sd:CH1728"].reason
    sd = by_id(Z.band_sd(Z.n2(d, tuple(Z.n2_windows_for(req))), BANDS), "band_sd", "band_noise_unknown")
    assert sd["e"][0]["NH2044"] == math.inf and "NH2044" in sd["e"][1] and sd["a"][1] == []
    want = got["a"]["sd:CH1728"].terms[0].gain * n2(spectrum(0), WL, 1500, 1600)
    assert abs(sd["a"][0]["CH1728"] - want) < 1e-9
    near = Z.standard_like(Z.statistic_requests(RULES), 0.15)
    d2 = Z.noise_gains(df.withColumn("correction_id", F.when(F.col("scan_id") == "a", "near").otherwise(F.col("correction_id"))), Z.statistic_requests(RULES), CORR, n=F.col("n"))
    flags = by_id(d2.withColumn("near", near), "near")
    assert flags["a"] is True and flags["b"] is False and flags["c"] is False


def test_many_layouts_join_back(spark):
    rows = [row(f"s{i}", spectrum(0), joins=(1000.0, 1780.0 + i % 3)) for i in range(9)]
    df = scans(spark, rows).withColumn("correction_id", F.lit("none"))
    got = by_id(Z.noise_gains(df, Z.statistic_requests(RULES), n=F.col("n")), "gains")
    assert len(got) == 9 and got["s0"] == got["s3"]


def test_consensus_sd_is_factor_times_median(spark):
    comp = lambda n, lo, k: {"name": n, "id": n, "feature": {"type": "linear", "wavelengths_nm": [float(lo + i) for i in range(3)], "weights": [k, -2.0 * k, k], "offset": 0.0}}
    doc = {"id": "c", "kind": "consensus", "preprocessing": [{"op": "absorbance", "clip_min": 1e-6}], "features": {"wavelengths_nm": []}, "consensus": {"components": [comp("a", 1550, 1.0), comp("b", 2050, 5.0), comp("c", 2060, 9.0)]}}
    df = scans(spark, [row("s", spectrum(1))]).withColumn("correction_id", F.lit("none"))
    d = Z.noise_gains(Z.n2(df), Z.model_requests(doc), (), n=F.col("n"))
    v = by_id(Z.implied_sd(d, [doc], {"c": 1.3}), "model_sd")["s"]["c"]
    assert abs(v.sd - 1.3 * sorted(v.component_sd.values())[1]) < 1e-12 and v.status.state == "assessed"
    none = by_id(Z.implied_sd(d, [doc]), "model_sd")["s"]["c"]
    assert none.sd is None and none.status.reason == "no noise factor for this consensus"


def test_moment_rule():
    f = R.Functional("mean", 1e-6, ((1500.0, (0.5, 0.5)),), 0.0, ((1500.0, 1501.0),))
    got, problem = Z.reading_gains([(f, 1.25)], WL, (1000.0, 1800.0))
    assert not got and "not a second-derivative reading" in problem[0]
