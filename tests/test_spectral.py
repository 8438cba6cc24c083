import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenscan.operators import matching as M
from lumenscan.operators import spectral as S
from lumenscan.operators import weights as wt
from tests_util import brute_blur, poly_eval
from conftest import by_id, row, scans

WLS = np.arange(350.0, 550.0)
JOINS = (400.0, 480.0)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    X = np.clip(0.4 + 0.1 * rng.standard_normal((4, 200)), 0.01, None)
    df = scans(spark, [row(f"s{i}", X[i], joins=JOINS) for i in range(4)]).cache()
    return df, X


def result(df):
    return np.array([by_id(df, "r")[f"s{i}"] for i in range(4)])


def close(a, b, tol=1e-9):
    assert a.shape == b.shape and np.max(np.abs(a - b)) < tol


@pytest.mark.parametrize("mode", ["interp", "mirror", "nearest", "constant", "wrap", "zero_edges", "valid"])
def test_savgol_modes(data, mode):
    df, X = data
    W, p, d, h = 11, 3, 1, 5
    want = np.zeros_like(X)
    pad = {"mirror": "reflect", "nearest": "edge", "constant": "constant", "wrap": "wrap"}.get(mode)
    for i in range(200):
        for s in range(4):
            if pad:
                want[s, i] = poly_eval(np.pad(X[s], h, mode=pad)[i:i + W], p, d, 0.0)
            elif h <= i < 200 - h:
                want[s, i] = poly_eval(X[s, i - h:i + h + 1], p, d, 0.0)
            elif mode == "interp":
                lo = 0 if i < h else 200 - W
                want[s, i] = poly_eval(X[s, lo:lo + W], p, d, i - lo - h)
    got = result(S.savgol(df, W, p, d, mode=mode))
    close(got, want[:, h:200 - h] if mode == "valid" else want)


def test_savgol_refuses_bad_windows(spark, data):
    df, _ = data
    with pytest.raises(wt.OperatorError):
        S.savgol(df, 10, 2)
    short = scans(spark, [row("s", [0.1, 0.2], joins=JOINS), row("e", [], joins=JOINS)])
    assert by_id(S.savgol(short, 11, 2), "r", "error") == {"s": (None, "SG window longer than spectrum"), "e": (None, "SG window longer than spectrum")}


@pytest.mark.parametrize("kw", [dict(sigma_nm=[1.0, 2.0, 3.0], radius="ceil"), dict(sigma_nm=1.7), dict(fwhm_nm={"type": "piecewise_linear", "knots_nm": [350, 549], "values_nm": [2.0, 8.0]}),
                                dict(sigma_nm=2.0, segments="none"), dict(sigma_nm=[0.0, 2.0, 0.0])])
def test_gaussian_blur(data, kw):
    df, X = data
    close(result(S.gaussian_blur(df, **kw)), brute_blur(WLS, X, JOINS, **kw))


def test_blur_of_constant_is_constant(spark):
    df = scans(spark, [row("s0", np.full(60, 0.37), joins=(370.0, 390.0))])
    assert np.allclose(by_id(S.gaussian_blur(df, sigma_nm=4.0), "r")["s0"], 0.37, atol=1e-12)


def test_resample_detrend_pds(data):
    df, X = data
    t = 351.3 + 1.7 * np.arange(60)
    close(result(S.resample(df, {"start_nm": 351.3, "step_nm": 1.7, "n": 60})), np.array([np.interp(t, WLS, x) for x in X]))
    assert set(by_id(S.resample(df, {"start_nm": 340.0, "step_nm": 1.0, "n": 5}), "error").values()) == {"resample would extrapolate"}
    want = np.array([x - np.polyval(np.polyfit(WLS - 450, x, 2), WLS - 450) for x in X])
    close(result(S.detrend(df, 2)), want, 1e-8)
    B = np.random.default_rng(2).standard_normal((200, 5))
    want = np.zeros_like(X)
    for i in range(200):
        for j in range(-2, 3):
            if 0 <= i + j < 200:
                want[:, i] += X[:, i + j] * B[i, j + 2]
    close(result(S.pds_banded(df, WLS.tolist(), B.tolist(), [0.1] * 200)), want + 0.1)


def test_snv_and_blocks(spark, data):
    df, X = data
    z = lambda A: (A - A.mean(1, keepdims=True)) / A.std(1, keepdims=True)
    close(result(S.snv(df)), z(X))
    close(result(S.block_snv(df, [(355, 380), (420, 440)])), np.hstack([z(X[:, 5:31]), z(X[:, 70:91])]))
    errors = lambda blocks: set(by_id(S.block_snv(df, blocks), "error").values())
    assert errors([(390, 410)]) == {"SNV block 390-410 nm spans a detector join"}
    assert errors([(390, 391)]) == {"SNV block 390-391 nm has 2 grid points (needs >= 3)"}
    flat = scans(spark, [row("f", np.full(50, 0.5), joins=(2000.0,))])
    assert by_id(S.block_snv(flat, [(360, 380)]), "r", "error")["f"] == (None, "SNV of a flat block")
    with pytest.raises(ValueError):
        S.block_snv(df, [(355, 380), (370, 390)])


def test_msc(data):
    df, X = data
    ref = X.mean(0)
    want = np.array([(x - np.polyfit(ref, x, 1)[1]) / np.polyfit(ref, x, 1)[0] for x in X])
    close(result(S.msc(df, ref.tolist())), want, 1e-7)


def test_segment_maps(data):
    df, X = data
    seg = np.where(WLS <= 400, 0, np.where(WLS <= 480, 1, 2))
    g, o = np.array([1.0, 1.1, 0.9])[seg], np.array([0.0, 0.02, -0.01])[seg]
    close(result(S.absorbance_affine(df, [1.0, 1.1, 0.9], [0.0, 0.02, -0.01], 1e-3)), 10 ** -(g * np.log10(1 / np.maximum(X, 1e-3)) + o))
    close(result(S.affine_reflectance(df, [{"a": a, "b": b} for a, b in ((1, 0), (2, .1), (3, .2))])), np.array([1, 2, 3])[seg] * X + np.array([0, .1, .2])[seg])
    assert set(by_id(S.absorbance_affine(df, [1.0, 2.0], 0.0, 1e-3), "error").values()) == {"gain has 2 values, scan has 3 segments"}


def test_splice_correct_closes_the_steps(data):
    df, X = data
    got = result(S.splice_correct(df))
    for s in range(4):
        lo = np.polyval(np.polyfit(np.arange(51, 56), X[s, 51:56], 1), 50)
        hi = np.polyval(np.polyfit(np.arange(125, 131), X[s, 125:131], 1), 131)
        assert abs(got[s, 50] - lo) < 1e-9 and abs(got[s, 131] - hi) < 1e-9
    close(got[:, 51:131], X[:, 51:131])


def test_projection_removes_direction(data):
    df, X = data
    v = np.random.default_rng(3).standard_normal(21)
    v /= np.linalg.norm(v)
    c = np.full(21, 0.1)
    got = np.array([by_id(S.project_out(df, (360.0, 380.0), v, c, 2.0, "r", "p"), "p")[f"s{i}"] for i in range(4)]) / 2.0
    assert np.max(np.abs((got - c) @ v)) < 1e-12


def test_crop_select_and_nan(spark, data):
    df, X = data
    c = S.crop(df, 359.6, 380.2)
    assert by_id(c, "wl_start")["s0"] == 360.0 and len(by_id(c, "r")["s0"]) == 21
    assert set(by_id(S.crop(df, 900, 950), "error").values()) == {"crop leaves no points"}
    f = by_id(S.select_wavelengths(df, [350.0, 549.0]), "features")
    assert f["s1"] == [X[1, 0], X[1, -1]]
    assert by_id(S.select_wavelengths(df, [350.5]), "error")["s0"] == "wavelength not on grid"
    nan = scans(spark, [row("n", [float("nan"), -0.1, 1e-9, 0.5])])
    a = by_id(S.absorbance(nan, 1e-6), "r")["n"]
    assert np.isnan(a[0]) and abs(a[1] - 6) < 1e-12 and abs(a[2] - 6) < 1e-12


def test_long_form_round_trip(data):
    df, X = data
    long = S.to_long(df)
    assert {(r.segment, r["count"]) for r in long.where("scan_id = 's0'").groupBy("segment").count().collect()} == {(0, 51), (1, 80), (2, 69)}
    back = S.from_long(long)
    assert np.array_equal(np.array(by_id(back, "r")["s2"]), X[2]) and by_id(back, "wl_start", "wl_step")["s2"] == (350.0, 1.0)


def test_corrections_in_one_pass_equal_chains(spark, data):
    df, X = data
    docs = [{"id": "a", "operator": [{"op": "gaussian_blur", "sigma_nm": [1.0, 2.0, 1.5]}, {"op": "absorbance_affine", "gain": 1.05, "offset": 0.01, "clip_min": 1e-3}]},
            {"id": "b", "operator": [{"op": "splice_correct"}, {"op": "msc", "reference": X.mean(0).tolist()}]}, {"id": "c", "operator": [{"op": "crop", "range_nm": [360, 400]}]}]
    picks = df.withColumn("correction_id", F.element_at(F.lit(["none", "a", "b", "c"]), F.substring("scan_id", 2, 1).cast("int") + 1))
    got = by_id(M.apply_correction(picks, docs), "stream")
    assert np.array_equal(got["s0"], X[0]) and got["s3"] is None
    for k, doc in (("s1", docs[0]), ("s2", docs[1])):
        want = by_id(S.apply_chain(df.where(F.col("scan_id") == k), doc["operator"]), "r")[k]
        assert np.max(np.abs(np.array(got[k]) - np.array(want))) < 1e-9
