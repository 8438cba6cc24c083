"""Queries over the driver's tables, each with its SQL twin where SQL can say it.

``QUERIES[name] = (spark function, SQL or None)``. Every query reads whole tables.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.functions import arrays as A
from lumenscan.functions import dates as D
from lumenscan.functions import numeric as N
from lumenscan.functions import records as RC
from lumenscan.functions import text as X
from lumenscan.operators import checks as K
from lumenscan.operators import evaluate as EV
from lumenscan.operators import matching as M
from lumenscan.operators import noise as Z
from lumenscan.operators import quality as Q
from lumenscan.operators import ranking as RK
from lumenscan.operators import readings as R
from lumenscan.operators import sequencing as SQ
from lumenscan.operators import spectral as S
from lumenscan.operators import verdict as V
from lumenscan.operators import weights as wt
from lumenscan.plans.driver_tables import JOINS, LONG, START, lit, q6, r6, spectra, table, values
from lumenscan.rulebook import PROFILE_COLLAGEN, RULES
from lumenscan.sources.scan_files import drop_shadowed, with_spectrum_hash

QUERIES: dict = {}
WL = wt.grid(START, 1.0, 64)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return add


def long_out(df: DataFrame, col: str = "r", name: str = "value") -> DataFrame:
    """(vec_id, ch, value) of an array column, rounded."""
    return df.select("vec_id", F.posexplode(F.col(col)).alias("ch", "v")).where("v is not null").select("vec_id", "ch", r6(F.col("v")).alias(name))


def A_SQL(clip: float, r: str = "r") -> str:
    return f"log10(1e0 / greatest({r}, {lit(clip)}))"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join([LONG, *ctes]) + "\n"


# ------------------------------------------------------------------------------------------ elementwise, windows
@query("absorbance", with_() + f"SELECT vec_id, ch, {q6(A_SQL(1e-6))} AS value FROM L")
def _absorbance(spark, sf):
    return long_out(S.absorbance(spectra(spark, sf), 1e-6))


@query("crop", with_() + f"SELECT vec_id, ch - 10 AS ch, {q6('r')} AS value, 360e0 AS first_wl FROM L WHERE wl BETWEEN 360 AND 400.5")
def _crop(spark, sf):
    df = S.crop(spectra(spark, sf), 360.0, 400.5)
    return df.select("vec_id", "wl_start", F.posexplode("r").alias("ch", "v")).select("vec_id", "ch", r6(F.col("v")).alias("value"), F.col("wl_start").alias("first_wl"))


SEG = "CASE WHEN wl <= 370 THEN 0 WHEN wl <= 393 THEN 1 ELSE 2 END"


@query("segments", with_() + f"SELECT vec_id, {SEG} AS segment, count(*) AS n, {q6('avg(r)')} AS mean_r, {q6('min(wl)')} AS first_wl FROM L GROUP BY ALL")
def _segments(spark, sf):
    long = S.to_long(spectra(spark, sf), ["vec_id"])
    return long.groupBy("vec_id", "segment").agg(F.count("*").alias("n"), r6(F.avg("r")).alias("mean_r"), r6(F.min("wl")).alias("first_wl"))


@query("segment_ranges", with_() + f"""SELECT vec_id, {SEG} AS segment, min(ch) AS first_ch, max(ch) + 1 AS end_ch FROM L GROUP BY ALL""")
def _segment_ranges(spark, sf):
    df = S.with_segments(spectra(spark, sf)).select("vec_id", F.posexplode("segments").alias("segment", "s"))
    return df.select("vec_id", "segment", F.col("s.start").alias("first_ch"), F.col("s.end").alias("end_ch"))


@query("select_wavelengths", with_() + f"SELECT vec_id, {q6('max(r) FILTER (ch = 5)')} AS f1, {q6('max(r) FILTER (ch = 31)')} AS f2, {q6('max(r) FILTER (ch = 60)')} AS f3 FROM L GROUP BY vec_id")
def _select_wavelengths(spark, sf):
    df = S.select_wavelengths(spectra(spark, sf), [355.0, 381.0, 410.0])
    return df.select("vec_id", *[r6(F.element_at("features", i)).alias(f"f{i}") for i in (1, 2, 3)])


@query("window_mean", with_() + f"SELECT vec_id, {q6('avg(r)')} AS value FROM L WHERE wl BETWEEN 375 AND 385 GROUP BY vec_id")
def _window_mean(spark, sf):
    return R.window_mean(spectra(spark, sf), 375.0, 385.0, out="v").select("vec_id", r6(F.col("v")).alias("value"))


@query("sharp_index", with_() + f"""SELECT vec_id, {q6('avg(r) FILTER (wl BETWEEN 378 AND 382) - 0.5e0 * (avg(r) FILTER (wl BETWEEN 368 AND 372) + avg(r) FILTER (wl BETWEEN 388 AND 392))')} AS value
FROM L GROUP BY vec_id""")
def _sharp(spark, sf):
    return R.sharp(spectra(spark, sf), 380.0, 2.0, 8.0, 12.0, out="v").select("vec_id", r6(F.col("v")).alias("value"))


@query("window_max", with_() + f"SELECT vec_id, {q6('max(r)')} AS value FROM L WHERE wl BETWEEN 371 AND 393 GROUP BY vec_id")
def _window_max(spark, sf):
    return R.window_max(spectra(spark, sf), 371.0, 393.0, out="v").select("vec_id", r6(F.col("v")).alias("value"))


@query("range_stats", with_() + f"SELECT vec_id, {q6('avg(r)')} AS mean, {q6('stddev_pop(r)')} AS sd, {q6('min(r)')} AS min, {q6('max(r)')} AS max FROM L WHERE wl BETWEEN 360 AND 405 GROUP BY vec_id")
def _range_stats(spark, sf):
    df = Q.range_stats(spectra(spark, sf), 360.0, 405.0, out="s")
    return df.select("vec_id", *[r6(F.col(f"s.{k}")).alias(k) for k in ("mean", "sd", "min", "max")])


QUERIES["range_stats_long"] = (lambda spark, sf: (lambda d: d.select("vec_id", *[r6(F.col(k)).alias(k) for k in ("mean", "sd", "min", "max")]))(
    Q.range_stats_long(S.to_long(spectra(spark, sf), ["vec_id"]), 360.0, 405.0, "vec_id")), QUERIES["range_stats"][1])


@query("second_difference", with_() + f"""SELECT vec_id, ch, {q6('lag(r) OVER w - 2e0 * r + lead(r) OVER w')} AS value FROM L WINDOW w AS (PARTITION BY vec_id ORDER BY ch)""")
def _second_difference(spark, sf):
    d = S.second_difference(S.to_long(spectra(spark, sf), ["vec_id"]), "vec_id")
    return d.select("vec_id", "ch", r6(F.col("d2")).alias("value"))


# ------------------------------------------------------------------------------------------ noise
N2_SQL = with_(f"a AS (SELECT *, {A_SQL(1e-4)} AS a FROM L)",
               "d AS (SELECT vec_id, wl, lag(a) OVER w - 2e0 * a + lead(a) OVER w AS d2 FROM a WINDOW w AS (PARTITION BY vec_id ORDER BY ch))",
               "win(window_nm, lo, hi) AS (VALUES ('360-390', 360e0, 390e0), ('380-413', 380e0, 413e0))",
               "x AS (SELECT vec_id, window_nm, d2 FROM d JOIN win ON wl >= lo AND wl < hi WHERE d2 IS NOT NULL)",
               "m AS (SELECT vec_id, window_nm, median(d2) AS m FROM x GROUP BY ALL)") + f"""
SELECT vec_id, window_nm, round(1.4826e0 * 1e5 * median(abs(d2 - m)), 4) AS n2 FROM x JOIN m USING (vec_id, window_nm) GROUP BY ALL"""


@query("n2_noise", N2_SQL)
def _n2(spark, sf):
    t = Z.n2_table(spectra(spark, sf), ((360.0, 390.0), (380.0, 413.0)), key="vec_id")
    return t.select("vec_id", F.col("window").alias("window_nm"), F.round("n2", 4).alias("n2"))


@query("n2_noise_long", N2_SQL)
def _n2_long(spark, sf):
    long = S.to_long(spectra(spark, sf), ["vec_id"])
    one = lambda lo, hi: Z.n2_long(long, lo, hi, "vec_id").select("vec_id", F.lit(f"{lo:g}-{hi:g}").alias("window_nm"), F.round("n2", 4).alias("n2"))
    return one(360.0, 390.0).unionByName(one(380.0, 413.0))


# ------------------------------------------------------------------------------------------ weight operators
def weights_sql(w: wt.Weights, src: str = "r", scale: float = 1.0) -> str:
    rows = [(o, i, float(c)) for o, _, i, c in w.rows()]
    return with_(values(rows, "w", "o, ch, c")) + f"SELECT vec_id, o AS ch, {q6(f'{lit(scale)} * sum({src} * c)')} AS value FROM L JOIN w USING (ch) GROUP BY vec_id, o"


_SG = dict(window=11, polyorder=3, deriv=2)


@query("savgol", weights_sql(wt.savgol(WL, **_SG), scale=1.0))
def _savgol(spark, sf):
    return long_out(S.savgol(spectra(spark, sf), **_SG))


@query("savgol_mirror", weights_sql(wt.savgol(WL, 9, 2, 1, mode="mirror")))
def _savgol_mirror(spark, sf):
    return long_out(S.savgol(spectra(spark, sf), 9, 2, 1, mode="mirror"))


@query("savgol_long", weights_sql(wt.savgol(WL, 7, 2, 0)))
def _savgol_long(spark, sf):
    long = S.to_long(spectra(spark, sf), ["vec_id"])
    d = S.apply_weights_long(long, S.weight_table(spark, wt.savgol(WL, 7, 2, 0)), "vec_id")
    return d.select("vec_id", "ch", r6(F.col("r")).alias("value"))


_C7 = [float(x) for x in wt.savgol_weights(7, 2, 0)]


@query("moving_weighted", with_() + "SELECT vec_id, ch, " + q6(" + ".join(f"{lit(c)} * lag(r, {3 - k}) OVER w" for k, c in enumerate(_C7)))
       + " AS value FROM L WINDOW w AS (PARTITION BY vec_id ORDER BY ch)")
def _moving(spark, sf):
    d = S.moving_weighted(S.to_long(spectra(spark, sf), ["vec_id"]), _C7, "vec_id")
    return d.select("vec_id", "ch", r6(F.col("smoothed")).alias("value"))


KERNEL = {"absorbance_clip": 1e-6, "savgol": {"window": 9, "polyorder": 2, "deriv": 2, "delta": 1.0}, "scale": -10.0}
_E_W = wt.savgol(WL, 9, 2, 2)
_E_W = wt.Weights(_E_W.idx[4:-4], _E_W.w[4:-4], WL[4:-4])
E_CTE = [values([(o + 4, i, float(c)) for o, _, i, c in _E_W.rows()], "ew", "o, ch, c"),
         f"E AS (SELECT vec_id, o AS ch, 350e0 + o AS wl, -10e0 * sum({A_SQL(1e-6)} * c) AS e FROM L JOIN ew USING (ch) GROUP BY vec_id, o)"]


@query("derivative", with_(*E_CTE) + f"SELECT vec_id, ch, {q6('e')} AS value FROM E")
def _derivative(spark, sf):
    return long_out(S.derivative(spectra(spark, sf), KERNEL), "E")


_SIG = [1.0, 1.5, 2.0]
BLUR_SQL = with_(f"s AS (SELECT *, {SEG} AS seg FROM L)",
                 "p AS (SELECT a.vec_id, a.ch, b.r, exp(-0.5e0 * power((b.wl - a.wl) / (CASE a.seg WHEN 0 THEN 1e0 WHEN 1 THEN 1.5e0 ELSE 2e0 END), 2)) AS g FROM s a JOIN s b "
                 "ON a.vec_id = b.vec_id AND a.seg = b.seg AND abs(a.ch - b.ch) <= ceil(4e0 * (CASE a.seg WHEN 0 THEN 1e0 WHEN 1 THEN 1.5e0 ELSE 2e0 END)))") + f"""
SELECT vec_id, ch, {q6('sum(g * r) / sum(g)')} AS value FROM p GROUP BY vec_id, ch"""


@query("gaussian_blur", BLUR_SQL)
def _blur(spark, sf):
    return long_out(S.gaussian_blur(spectra(spark, sf), sigma_nm=_SIG, radius="ceil"))


@query("gaussian_blur_long", BLUR_SQL)
def _blur_long(spark, sf):
    w = S.weight_table(spark, wt.gaussian_blur(WL, JOINS, _SIG, radius="ceil"))
    d = S.apply_weights_long(S.to_long(spectra(spark, sf), ["vec_id"]), w, "vec_id")
    return d.select("vec_id", "ch", r6(F.col("r")).alias("value"))


@query("resample", with_("t AS (SELECT unnest(range(40))::INT AS o)") + f"""
SELECT a.vec_id, o AS ch, {q6('a.r + (b.r - a.r) * (352.5e0 + 1.5e0 * o - a.wl)')} AS value FROM t JOIN L a ON a.ch = floor(2.5e0 + 1.5e0 * o) JOIN L b ON a.vec_id = b.vec_id AND b.ch = a.ch + 1""")
def _resample(spark, sf):
    return long_out(S.resample(spectra(spark, sf), {"start_nm": 352.5, "step_nm": 1.5, "n": 40}))


_BANK = [[0.1 + 0.001 * i, 0.8, 0.1 - 0.001 * i] for i in range(64)]


@query("pds_banded", with_() + f"""SELECT a.vec_id, a.ch, {q6('sum(b.r * (CASE b.ch - a.ch WHEN -1 THEN 0.1e0 + 0.001e0 * a.ch WHEN 0 THEN 0.8e0 ELSE 0.1e0 - 0.001e0 * a.ch END)) + 0.01e0')} AS value
FROM L a JOIN L b ON a.vec_id = b.vec_id AND abs(a.ch - b.ch) <= 1 GROUP BY a.vec_id, a.ch""")
def _pds(spark, sf):
    return long_out(S.pds_banded(spectra(spark, sf), [float(w) for w in WL], _BANK, [0.01] * 64))


@query("detrend", with_("f AS (SELECT vec_id, regr_slope(r, wl) AS b, regr_intercept(r, wl) AS a FROM L GROUP BY vec_id)") + f"SELECT vec_id, ch, {q6('r - (a + b * wl)')} AS value FROM L JOIN f USING (vec_id)")
def _detrend(spark, sf):
    return long_out(S.detrend(spectra(spark, sf), 1))


# ------------------------------------------------------------------------------------------ normalisation, maps
@query("snv", with_("m AS (SELECT vec_id, avg(r) AS m, stddev_pop(r) AS s FROM L GROUP BY vec_id)") + f"SELECT vec_id, ch, {q6('(r - m) / s')} AS value FROM L JOIN m USING (vec_id)")
def _snv(spark, sf):
    return long_out(S.snv(spectra(spark, sf)))


@query("snv_block", with_("b AS (SELECT *, CASE WHEN wl BETWEEN 352 AND 368 THEN 0 WHEN wl BETWEEN 375 AND 390 THEN 1 END AS blk FROM L)",
                          "m AS (SELECT vec_id, blk, avg(r) AS m, stddev_pop(r) AS s FROM b WHERE blk IS NOT NULL GROUP BY ALL)") + f"""
SELECT vec_id, wl, {q6('(r - m) / s')} AS value FROM b JOIN m USING (vec_id, blk)""")
def _snv_block(spark, sf):
    d = S.block_snv(spectra(spark, sf), [(352.0, 368.0), (375.0, 390.0)])
    return d.select("vec_id", F.explode(F.arrays_zip("wl", "r")).alias("z")).select("vec_id", F.col("z.wl").alias("wl"), r6(F.col("z.r")).alias("value"))


_REF = [0.2 + 0.01 * i for i in range(64)]


@query("msc", with_("f AS (SELECT vec_id, regr_slope(r, 0.2e0 + 0.01e0 * ch) AS b, regr_intercept(r, 0.2e0 + 0.01e0 * ch) AS a FROM L GROUP BY vec_id)") + """
SELECT vec_id, ch, CASE WHEN abs(b) > 1e-3 THEN round((r - a) / b, 6) + 0e0 END AS value FROM L JOIN f USING (vec_id)""")
def _msc(spark, sf):
    ref = np.array(_REF)
    d = spectra(spark, sf)
    slope = A.dot(F.col("r"), [float(v) for v in (ref - ref.mean()) / ((ref - ref.mean()) @ (ref - ref.mean()))])
    d = S.msc(d.withColumn("b", slope), _REF)
    # a scan that does not follow the reference has no corrected values, but keeps its rows
    return d.select("vec_id", "b", F.posexplode("r").alias("ch", "v")).select("vec_id", "ch", F.when(F.abs("b") > 1e-3, r6(F.col("v"))).alias("value"))


_G, _O = [1.0, 1.1, 0.9], [0.0, 0.02, -0.01]
SEGV = lambda v: f"(CASE {SEG} WHEN 0 THEN {lit(v[0])} WHEN 1 THEN {lit(v[1])} ELSE {lit(v[2])} END)"


@query("absorbance_affine", with_() + f"SELECT vec_id, ch, {q6(f'power(10e0, -({SEGV(_G)} * {A_SQL(1e-3)} + {SEGV(_O)}))')} AS value FROM L")
def _affine_a(spark, sf):
    return long_out(S.absorbance_affine(spectra(spark, sf), _G, _O, 1e-3))


@query("affine_reflectance", with_() + f"SELECT vec_id, ch, {q6(f'{SEGV(_G)} * r + {SEGV(_O)}')} AS value FROM L")
def _affine_r(spark, sf):
    return long_out(S.affine_reflectance(spectra(spark, sf), [{"a": a, "b": b} for a, b in zip(_G, _O)]))


SPLICE = ["lo AS (SELECT vec_id, regr_slope(r, wl) * 370e0 + regr_intercept(r, wl) AS x FROM L WHERE wl BETWEEN 371 AND 375 GROUP BY vec_id)",
          "hi AS (SELECT vec_id, regr_slope(r, wl) * 394e0 + regr_intercept(r, wl) AS x FROM L WHERE wl BETWEEN 388 AND 393 GROUP BY vec_id)",
          "p AS (SELECT vec_id, max(r) FILTER (wl = 370) AS r370, max(r) FILTER (wl = 371) AS r371, max(r) FILTER (wl = 393) AS r393, max(r) FILTER (wl = 394) AS r394 FROM L GROUP BY vec_id)"]


@query("splice_correct", with_(*SPLICE) + f"""SELECT vec_id, ch, {q6('r + CASE WHEN wl <= 370 THEN lo.x - r370 WHEN wl > 393 THEN hi.x - r394 ELSE 0 END')} AS value
FROM L JOIN lo USING (vec_id) JOIN hi USING (vec_id) JOIN p USING (vec_id)""")
def _splice_correct(spark, sf):
    return long_out(S.splice_correct(spectra(spark, sf)))


@query("splice_steps", with_(*SPLICE) + f"SELECT vec_id, {q6('abs(lo.x - r370) / abs(r371)')} AS step1, {q6('abs(hi.x - r394) / abs(r393)')} AS step2 FROM p JOIN lo USING (vec_id) JOIN hi USING (vec_id)")
def _splice_steps(spark, sf):
    d = Q.splice_steps(spectra(spark, sf))
    return d.select("vec_id", r6(F.element_at("splice_steps", 1)).alias("step1"), r6(F.element_at("splice_steps", 2)).alias("step2"))


_V = [0.25] * 16
_CEN = [0.05 * i for i in range(16)]


@query("project_out", with_("x AS (SELECT vec_id, ch - 10 AS k, r / 2e0 AS x FROM L WHERE wl BETWEEN 360 AND 375)",
                            "t AS (SELECT vec_id, sum((x - 0.05e0 * k) * 0.25e0) AS t FROM x GROUP BY vec_id)") + f"SELECT vec_id, k AS ch, {q6('2e0 * (x - 0.25e0 * t)')} AS value FROM x JOIN t USING (vec_id)")
def _project(spark, sf):
    return long_out(S.project_out(spectra(spark, sf), (360.0, 375.0), _V, _CEN, 2.0, "r", "p"), "p")


@query("chain", with_("a AS (SELECT vec_id, ch, wl, log10(1e0 / greatest(r, 1e-3)) AS a FROM L)", values([(o, i, float(c)) for o, _, i, c in wt.savgol(WL, 7, 2, 1).rows()], "w", "o, ch, c"),
                      "g AS (SELECT vec_id, o, sum(a * c) AS v FROM a JOIN w USING (ch) GROUP BY ALL)",
                      "b AS (SELECT * FROM g WHERE 350 + o BETWEEN 375 AND 390)", "m AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS s FROM b GROUP BY vec_id)") + f"""
SELECT vec_id, o - 25 AS ch, {q6('(v - m) / s')} AS value FROM b JOIN m USING (vec_id)""")
def _chain(spark, sf):
    ops = [{"op": "absorbance", "clip_min": 1e-3}, {"op": "savgol", "window": 7, "polyorder": 2, "deriv": 1}, {"op": "snv", "ddof": 0, "blocks_nm": [[375, 390]]}]
    return long_out(S.apply_chain(spectra(spark, sf), ops))


# ------------------------------------------------------------------------------------------ readings and models
def _coef(lo: int, hi: int, phase: float) -> list[float]:
    return [float(np.round(3.0 * np.cos(0.7 * k + phase), 6)) for k in range(hi - lo + 1)]


PARTS = {"wc2045": (356, 366, 0.1, 1.2), "wc1500": (374, 386, 0.9, 1.6), "F05": (396, 408, 2.0, 0.9)}
MODEL = {"id": "demo.consensus", "version": "1.0.0", "kind": "consensus", "instrument": {"trained_on_class": "std"},
         "preprocessing": [{"op": "absorbance", "clip_min": 1e-6}], "features": {"wavelengths_nm": []},
         "consensus": {"combine": "median", "components": [
             {"name": n, "id": n, "feature": {"type": "linear", "wavelengths_nm": [float(w) for w in range(lo, hi + 1)], "weights": _coef(lo, hi, ph), "offset": off}}
             for n, (lo, hi, ph, off) in PARTS.items()]}}
FUNCTIONALS = [f for _, f in R.fold_model(MODEL)]
READINGS_CTE = [values([(n, lo + k - 350, c, off) for n, (lo, hi, ph, off) in PARTS.items() for k, c in enumerate(_coef(lo, hi, ph))], "fw", "name, ch, c, o"),
                f"rd AS (SELECT vec_id, label, name, sum({A_SQL(1e-6)} * c) + any_value(o) AS v FROM L JOIN fw USING (ch) GROUP BY ALL)",
                "cons AS (SELECT vec_id, label, median(v) AS m, max(v) FILTER (name = 'wc2045') AS a, max(v) FILTER (name = 'wc1500') AS b, max(v) FILTER (name = 'F05') AS c FROM rd GROUP BY ALL)"]
READINGS_SQL = with_(*READINGS_CTE) + f"SELECT vec_id, name, {q6('v')} AS value FROM rd"


def _named(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.element_at(F.split("name", ":"), -1).alias("name"), r6(F.col("value")).alias("value"))


@query("functionals_array", READINGS_SQL)
def _fun_array(spark, sf):
    d = R.evaluate_array(spectra(spark, sf), FUNCTIONALS)
    return _named(d.select("vec_id", F.explode("readings").alias("name", "value")))


@query("functionals_matrix", READINGS_SQL)
def _fun_matrix(spark, sf):
    d = R.kernel_pass(spectra(spark, sf), FUNCTIONALS)
    return _named(d.select("vec_id", F.explode("readings").alias("name", "value")))


@query("functionals_long", READINGS_SQL)
def _fun_long(spark, sf):
    t = R.functional_table(spark, FUNCTIONALS, START)
    return _named(R.evaluate_long(S.to_long(spectra(spark, sf), ["vec_id"]), t, "vec_id"))


def consensus(spark: SparkSession, sf: str) -> DataFrame:
    """Scans with the consensus reading ``m`` and its ``components``; built-in expressions only."""
    d = R.predict_linear(R.evaluate_array(spectra(spark, sf), FUNCTIONALS), [MODEL])
    return d.withColumns({"m": F.col("models")[MODEL["id"]]["value"], "components": F.col("models")[MODEL["id"]]["components"]})


@query("consensus_median", with_(*READINGS_CTE) + f"SELECT vec_id, {q6('m')} AS m, {q6('a')} AS wc2045, {q6('b')} AS wc1500, {q6('c')} AS f05 FROM cons")
def _consensus(spark, sf):
    d = consensus(spark, sf)
    return d.select("vec_id", r6(F.col("m")).alias("m"), *[r6(F.col("components")[k]).alias(k.lower()) for k in PARTS])


CUT = "CASE WHEN m < 0.5e0 THEN 'Unlikely' WHEN m < 3e0 THEN 'Borderline' ELSE 'Good' END"
_CUTS = PROFILE_COLLAGEN["cuts"]
RANKED = f"""SELECT vec_id, label, verdict, {q6('m')} AS m, row_number() OVER (PARTITION BY label ORDER BY g, m DESC, vec_id) AS rank
FROM (SELECT *, {CUT} AS verdict, CASE WHEN m < 0.5e0 THEN 3 WHEN m < 3e0 THEN 1 ELSE 0 END AS g FROM cons)"""


def judged(spark: SparkSession, sf: str) -> DataFrame:
    d = consensus(spark, sf)
    d = d.withColumn("verdict", V.verdict_struct(V.model_verdict(F.col("m"), _CUTS), "model_verdict"))
    return V.sort_key(d, PROFILE_COLLAGEN, S=F.col("m"))


@query("verdict_shortlist", with_(*READINGS_CTE) + f"SELECT vec_id, verdict, {q6('m')} AS m FROM (SELECT *, {CUT} AS verdict, CASE WHEN m < 0.5e0 THEN 3 WHEN m < 3e0 THEN 1 ELSE 0 END AS g FROM cons) ORDER BY g, m DESC, vec_id LIMIT 20")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Absorbance, three linear readings, their median, a verdict by two cuts, most promising first, top 20."""
    d = RK.shortlist(judged(spark, sf), 20, "vec_id")
    return d.select("vec_id", F.col("verdict.verdict").alias("verdict"), r6(F.col("m")).alias("m"))


@query("promising_rank", with_(*READINGS_CTE) + RANKED)
def _rank(spark, sf):
    few = judged(spark, sf).select("vec_id", "label", "verdict", "m", "sort_group", "sort_penalty", "sort_value")
    d = RK.promising_rank(few, "label", "vec_id")
    return d.select("vec_id", "label", F.col("verdict.verdict").alias("verdict"), r6(F.col("m")).alias("m"), "rank")


@query("verdict_counts", with_(*READINGS_CTE) + f"SELECT label, {CUT} AS verdict, count(*) AS n FROM cons GROUP BY ALL")
def _counts(spark, sf):
    d = judged(spark, sf).select("label", F.col("verdict.verdict").alias("verdict"))
    return EV.verdict_counts(d, "verdict", ["label"])


@query("models_disagree", with_(*READINGS_CTE) + f"""SELECT vec_id, (list_unique([{CUT.replace('m <', 'a <')}, {CUT.replace('m <', 'b <')}, {CUT.replace('m <', 'c <')}]) > 1 AND greatest(a, b, c) - least(a, b, c) >= 1e0) AS disagree FROM cons""")
def _disagree(spark, sf):
    return consensus(spark, sf).select("vec_id", V.models_disagree(F.col("components"), _CUTS, 1.0).alias("disagree"))


@query("reading_words", with_(*READINGS_CTE) + """SELECT vec_id, CASE WHEN m < 0.5e0 THEN '< 0.5%' WHEN m < 3e0 THEN '≈ ' || printf('%.1f', least(floor(m * 10 + 0.5) / 10, 2.9)) || '% (± 1)'
WHEN m < 6e0 THEN '≈ ' || greatest(floor(m + 0.5)::INT, 3)::VARCHAR || '%' ELSE '> 6%' END AS words FROM cons""")
def _words(spark, sf):
    return consensus(spark, sf).select("vec_id", X.format_reading(F.col("m")).alias("words"))


@query("cut_noise", with_(*READINGS_CTE) + "SELECT vec_id, CASE WHEN abs(m - 0.5e0) <= 2.6e0 * (0.01e0 + 0.05e0 * label) OR abs(m - 3e0) <= 2.6e0 * (0.01e0 + 0.05e0 * label) THEN 'Check' ELSE 'ok' END AS outcome FROM cons")
def _cut_noise(spark, sf):
    d = consensus(spark, sf)
    sd = F.lit(0.01) + F.col("label") * 0.05
    b6 = K.check_cut_noise(F.col("m"), sd, F.struct(F.lit("assessed").alias("state"), F.lit(None).cast("string").alias("reason")), F.lit(True))
    return d.select("vec_id", b6["outcome"].alias("outcome"))


@query("reader_offsets", with_(*READINGS_CTE) + f"SELECT vec_id, {q6('list_median([a + 0.25e0, b, c - 0.5e0])')} AS m FROM cons WHERE label % 2 = 0 UNION ALL SELECT vec_id, {q6('m')} FROM cons WHERE label % 2 = 1".replace("list_median(", "list_aggregate(").replace("c - 0.5e0])", "c - 0.5e0], 'median')"))
def _offsets(spark, sf):
    d = consensus(spark, sf).withColumn("correction_id", F.when(F.col("label") % 2 == 0, F.lit("unit")).otherwise(F.lit("none")))
    d = M.add_reader_offsets(d, [MODEL], [{"id": "unit", "reader_offsets": {"wc2045": 0.25, "F05": -0.5}}])
    return d.select("vec_id", r6(F.col("models")[MODEL["id"]]["value"]).alias("m"))


_DW = [float(w) for w in range(356, 364)]
_DOM = {"id": "dom", "kind": "regression", "domain": {"method": "pls_t2_q", "x_center": [0.2] * 8, "t2_limit": 2.0, "q_limit": 0.05,
        "levels": [{"label": "inside", "below": 1.0}, {"label": "near", "below": 3.0}, {"label": "outside"}],
        "components": [{"weights_r": [0.5, -0.5] * 4, "loadings_p": [0.25, -0.25] * 4, "score_var": 0.1},
                       {"weights_r": [0.5] * 8, "loadings_p": [0.2] * 8, "score_var": 0.3}]}}


@query("domain_t2q", with_("x AS (SELECT vec_id, ch - 6 AS k, r - 0.2e0 AS e FROM L WHERE wl BETWEEN 356 AND 363)",
                           "t AS (SELECT vec_id, sum(e * (CASE WHEN k % 2 = 0 THEN 0.5e0 ELSE -0.5e0 END)) AS t1, sum(e * 0.5e0) AS t2 FROM x GROUP BY vec_id)",
                           "q AS (SELECT vec_id, sum(power(e - t1 * (CASE WHEN k % 2 = 0 THEN 0.25e0 ELSE -0.25e0 END) - t2 * 0.2e0, 2)) AS q, any_value(t1 * t1 / 0.1e0 + t2 * t2 / 0.3e0) AS tt FROM x JOIN t USING (vec_id) GROUP BY vec_id)") + f"""
SELECT vec_id, {q6('tt')} AS t2, {q6('q')} AS q, {q6('greatest(tt / 2e0, q / 0.05e0)')} AS ratio, CASE WHEN greatest(tt / 2e0, q / 0.05e0) < 1 THEN 'inside' WHEN greatest(tt / 2e0, q / 0.05e0) < 3 THEN 'near' ELSE 'outside' END AS level FROM q""")
def _domain(spark, sf):
    d = R.domain_statistics(S.select_wavelengths(spectra(spark, sf), _DW), _DOM)
    return d.select("vec_id", r6(F.col("domain.T2")).alias("t2"), r6(F.col("domain.Q")).alias("q"), r6(F.col("domain.ratio")).alias("ratio"), F.col("domain.level").alias("level"))


_CLS = {"classifier": {"x_center": [0.2] * 8, "scores": [{"name": n, "coefficients": [float(np.round(np.cos(i + j), 4)) for i in range(8)], "offset": 0.05 * j} for j, n in enumerate("abc")],
                       "decision": {"type": "argmax", "labels": ["a", "b", "c"]}, "probability": "softmax"}}


@query("classifier", with_(values([(n, 6 + i, float(np.round(np.cos(i + j), 4)), 0.05 * j) for j, n in enumerate("abc") for i in range(8)], "cw", "name, ch, c, o"),
                           "s AS (SELECT vec_id, name, sum((r - 0.2e0) * c) + any_value(o) AS s FROM L JOIN cw USING (ch) GROUP BY ALL)") + f"""
SELECT vec_id, arg_max(name, s) AS label, {q6('exp(max(s)) / sum(exp(s))')} AS probability FROM s GROUP BY vec_id""")
def _classifier(spark, sf):
    d = R.classify(S.select_wavelengths(spectra(spark, sf), _DW), _CLS)
    return d.select("vec_id", F.col("class_result.label").alias("label"), r6(F.array_max("class_result.probability")).alias("probability"))


_RULE = {"rule": {"features": {"depth": {"type": "band_depth", "left_nm": [360, 364], "right_nm": [380, 384], "centre_nm": [370, 374]}, "level": {"type": "mean", "range_nm": [390, 400]},
                               "one": {"type": "value", "wavelength_nm": 405}},
                  "score": {"op": "add", "args": [{"op": "mul", "args": [{"ref": "depth"}, 2.0]}, {"op": "max", "args": [{"ref": "level"}, {"ref": "one"}]}]},
                  "levels": [{"label": "low", "below": 0.1}, {"label": "mid", "below": 0.25}, {"label": "high"}]}}


@query("rule_model", with_("k AS (SELECT vec_id, avg(r) FILTER (wl BETWEEN 360 AND 364) AS l, avg(r) FILTER (wl BETWEEN 380 AND 384) AS h, avg(r) FILTER (wl BETWEEN 370 AND 374) AS c, "
                           "avg(r) FILTER (wl BETWEEN 390 AND 400) AS m, max(r) FILTER (wl = 405) AS o FROM L GROUP BY vec_id)",
                           "v AS (SELECT vec_id, 2e0 * (c - (l + h) / 2e0) + greatest(m, o) AS v FROM k)") + f"SELECT vec_id, {q6('v')} AS value, CASE WHEN v < 0.1e0 THEN 'low' WHEN v < 0.25e0 THEN 'mid' ELSE 'high' END AS label FROM v")
def _rule(spark, sf):
    d = R.rule_model(spectra(spark, sf), _RULE)
    return d.select("vec_id", r6(F.col("rule_result.value")).alias("value"), F.col("rule_result.label").alias("label"))


_PROTO = [[float(np.round(np.cos(0.4 * k + j), 5)) for k in range(31)] for j in range(3)]


@query("prototype_score", with_(values([(j, k if k < 11 else k + 9, p) for j, row in enumerate(_PROTO) for k, p in enumerate(row)], "pr", "j, k, p"),
                                "x AS (SELECT vec_id, ch - 5 AS k, -r AS v FROM L WHERE ch BETWEEN 5 AND 15 OR ch BETWEEN 25 AND 44)",
                                "m AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS s FROM x GROUP BY vec_id)",
                                "z AS (SELECT vec_id, j, avg((v - m) / (s + 1e-12) * p) AS z FROM x JOIN m USING (vec_id) JOIN pr USING (k) GROUP BY ALL)") + f"SELECT vec_id, {q6('max(z)')} AS score FROM z GROUP BY vec_id")
def _prototype(spark, sf):
    d = R.prototype_score(spectra(spark, sf), [(355.0, 365.0), (375.0, 394.0)], _PROTO, "r")
    return d.select("vec_id", r6(F.col("score")).alias("score"))


@query("first_crossing", with_("m AS (SELECT vec_id, avg(r) AS m FROM L WHERE wl BETWEEN 395 AND 405 GROUP BY vec_id)") + """
SELECT vec_id, min(wl) FILTER (wl >= 355 AND r / m >= 1.5e0) AS edge FROM L JOIN m USING (vec_id) GROUP BY vec_id""")
def _crossing(spark, sf):
    return spectra(spark, sf).select("vec_id", R.first_crossing(F.col("r"), 355.0, 395.0, 405.0, 1.5).alias("edge"))


@query("largest_step", with_("s AS (SELECT vec_id, wl, abs(lead(r) OVER w - r) / abs(r) AS s, lead(wl) OVER w AS nxt FROM L WINDOW w AS (PARTITION BY vec_id ORDER BY ch))") + f"""
SELECT vec_id, arg_max(wl, s) AS nm, {q6('max(s)')} AS step, {q6('median(s)')} AS med FROM s WHERE wl >= 360 AND nxt <= 400 GROUP BY vec_id""")
def _largest(spark, sf):
    d = Q.largest_step(spectra(spark, sf), 360.0, 400.0, "r", "s")
    return d.select("vec_id", F.col("s.nm").alias("nm"), r6(F.col("s.step")).alias("step"), r6(F.col("s.median")).alias("med"))


@query("largest_step_long", QUERIES["largest_step"][1].replace(f", {q6('median(s)')} AS med", ""))
def _largest_long(spark, sf):
    d = Q.largest_step_long(S.to_long(spectra(spark, sf), ["vec_id"]), 360.0, 400.0, "vec_id")
    return d.select("vec_id", "nm", r6(F.col("step")).alias("step"))


_ACQ = {**RULES["acquisition"], "input_matrix": {**RULES["acquisition"]["input_matrix"], "join_windows_nm": [[365.0, 375.0], [385.0, 400.0]]}, "default_joins_nm": list(JOINS), "join_jump_min": 0.01,
        "join_jump_clear": 2.0}


@query("resolve_joins", with_("win(k, lo, hi) AS (VALUES (1, 365e0, 375e0), (2, 385e0, 400e0))",
                              "s AS (SELECT vec_id, wl, abs(lead(r) OVER w - r) / abs(r) AS s, lead(wl) OVER w AS nxt FROM L WINDOW w AS (PARTITION BY vec_id ORDER BY ch))",
                              "b AS (SELECT vec_id, k, arg_max(wl, s) AS nm, max(s) AS s, median(s) AS med FROM s JOIN win ON wl >= lo AND nxt <= hi GROUP BY ALL)",
                              "c AS (SELECT vec_id, bool_and(s >= 2e0 * med AND s >= 0.01e0) AS ok, max(nm) FILTER (k = 1) AS j1, max(nm) FILTER (k = 2) AS j2 FROM b GROUP BY vec_id)") + """
SELECT vec_id, CASE WHEN ok THEN j1 ELSE 370e0 END AS j1, CASE WHEN ok THEN j2 ELSE 393e0 END AS j2, CASE WHEN ok THEN 'reference_dn' ELSE 'default' END AS source FROM c""")
def _resolve(spark, sf):
    d = spectra(spark, sf).withColumn("splices_header_nm", F.lit([0.0, 0.0]))
    d = Q.resolve_joins(d, reference="r", rules=_ACQ)
    return d.select("vec_id", F.element_at("joins_nm", 1).alias("j1"), F.element_at("joins_nm", 2).alias("j2"), F.col("joins_source").alias("source"))


@query("flat_top_runs", with_(f"t AS (SELECT vec_id, ch, {SEG} AS segment, round(r, 1) AS r FROM L)", "m AS (SELECT *, max(r) OVER (PARTITION BY vec_id, segment) AS m FROM t)",
                              "i AS (SELECT vec_id, segment, ch, ch - row_number() OVER (PARTITION BY vec_id, segment ORDER BY ch) AS i FROM m WHERE r = m)") + """
SELECT vec_id, segment, min(ch) AS first_ch, max(ch) AS last_ch, count(*) AS n FROM i GROUP BY vec_id, segment, i HAVING count(*) >= 2""")
def _flat(spark, sf):
    long = S.to_long(spectra(spark, sf), ["vec_id"]).withColumn("r", F.round("r", 1))
    return Q.flat_top_runs(long, "vec_id", at_least=2)


@query("acquisition_checks", with_(*SPLICE, "g AS (SELECT vec_id, avg(r) AS m, stddev_pop(r) AS s, min(r) AS lo, max(r) FILTER (wl BETWEEN 371 AND 393) AS mx FROM L WHERE wl BETWEEN 355 AND 410 GROUP BY vec_id)",
                                   "w AS (SELECT vec_id, greatest(abs(lo.x - r370) / abs(r371), abs(hi.x - r394) / abs(r393)) AS w FROM p JOIN lo USING (vec_id) JOIN hi USING (vec_id))") + """
SELECT vec_id, CASE WHEN lo <= 0 THEN 'Unusable' ELSE 'ok' END AS b3, CASE WHEN (m BETWEEN 0.95 AND 1.05 AND s < 0.03) OR m < 0.03 THEN 'Unusable' ELSE 'ok' END AS b4,
 CASE WHEN m < 0.15e0 THEN 'Note' ELSE 'ok' END AS b5, CASE WHEN mx > 0.35e0 THEN 'Note' ELSE 'ok' END AS b7, CASE WHEN w > 0.9e0 THEN 'Check' WHEN w > 0.4e0 THEN 'Note' ELSE 'ok' END AS b8,
 CASE WHEN w > 0.9e0 THEN 'Check' WHEN w > 0.4e0 OR m < 0.15e0 OR mx > 0.35e0 THEN 'Note' ELSE 'Pass' END AS worst FROM g JOIN w USING (vec_id)""")
def _acquisition(spark, sf):
    rules = {**_ACQ, "integrity_range_nm": [355, 410], "B5_dark": {"mean_R_below": 0.15}, "B7_above_one": {"range_offsets_nm": [1, 0], "max_R_above": 0.35},
             "B8_splice_step": {**_ACQ["B8_splice_step"], "note_above": 0.4, "check_above": 0.9}}
    d = Q.acquisition(spectra(spark, sf), rules)
    names = ("B3", "B4", "B5", "B7", "B8")
    return d.select("vec_id", *[F.col(f"acquisition.{k}.outcome").alias(k.lower()) for k in names], Q.worst_outcome([F.col(f"acquisition.{k}.outcome") for k in names]).alias("worst"))


@query("eligibility", with_() + """SELECT vec_id, CASE WHEN max(wl) < 390 + 4 OR min(wl) > 375 - 4 THEN 'not assessed' ELSE 'assessed' END AS inside, CASE WHEN 360 - 3 <= 370 AND 368 + 3 > 370 THEN 'not assessed' ELSE 'assessed' END AS crossing,
CASE WHEN max(wl) < 411 + 4 THEN 'not assessed' ELSE 'assessed' END AS short FROM L GROUP BY vec_id""".replace("max(wl) < 390 + 4 OR min(wl) > 375 - 4", "max(wl) < 388 + 4 OR min(wl) > 376 - 4"))
def _eligibility(spark, sf):
    d = R.eligibility(spectra(spark, sf), {"inside": [(376.0, 388.0, 4)], "crossing": [(360.0, 368.0, 3)], "short": [(400.0, 411.0, 4)]})
    return d.select("vec_id", *[F.col("eligibility")[k]["state"].alias(k) for k in ("inside", "crossing", "short")])


# ------------------------------------------------------------------------------------------ band rules
_BANDS = {"CH1728": (362, 1.0, 0.05, 1), "CH1689": (366, 0.85, 0.0, 1), "CH2262": (377, 1.6, 0.1, 1), "AM2175": (383, 1.1, 0.0, 1), "NH1545c": (388, 0.6, 0.15, -1), "NH2044": (399, 1.6, 0.0, 1), "CH2284": (403, 1.14, 0.0, 1)}
BANDS64 = {b: {"centre_nm": c, "half_width_nm": 1, "weight": w, "faint_u": f, "u_sign": s} for b, (c, w, f, s) in _BANDS.items()}
RULES64 = {**RULES, "evidence_levels": {**RULES["evidence_levels"], "kernel": KERNEL, "readability": {"sd_max_u": 0.02, "unreadable_only_if_u_below": 0.1}, "thresholds_u": {"clear": 0.1, "strong": 0.4},
                                        "guard": {"window_nm": [358, 370], "max_E_below": 1.0}, "nh_type_min_u": 0.05},
           "zooms_patterns": {**RULES["zooms_patterns"], "kernel": KERNEL, "readability": {"sd_max_frac_w": 0.02, "unreadable_only_if_E_below_frac_w": 0.1},
                              "vote": {**RULES["zooms_patterns"]["vote"], "lit_if_u_above": 0.1}}}
BAND_CTE = [*E_CTE, values([(b, float(c), w, f, s) for b, (c, w, f, s) in _BANDS.items()], "bd", "band, c, w, faint, sgn"),
            "br AS (SELECT vec_id, band, any_value(w) AS w, any_value(faint) AS faint, avg(e) AS e, avg(e) * any_value(sgn) / any_value(w) AS u FROM E JOIN bd ON wl BETWEEN c - 1 AND c + 1 GROUP BY ALL)",
            "sd AS (SELECT vec_id, 0.1e0 * stddev_pop(r) AS sd FROM L GROUP BY vec_id)",
            "gd AS (SELECT vec_id, max(e) AS g FROM E WHERE wl BETWEEN 358 AND 370 GROUP BY vec_id)"]


def banded(spark: SparkSession, sf: str) -> DataFrame:
    """Scans with band readings on a small kernel and a band noise SD taken from the scan's own spread."""
    d = spectra(spark, sf)
    spec = [R.band_functional(f"E:{b}", KERNEL, float(e["centre_nm"]), 1.0) for b, e in BANDS64.items()] + [R.WindowMax("guard", KERNEL, 358.0, 370.0)]
    sd = A.sd(F.col("r")) * 0.1
    d = d.withColumn("band_sd", A.let(sd, lambda s: F.map_from_arrays(F.lit(list(BANDS64)), F.array_repeat(s, len(BANDS64)))))
    return R.spec_columns(d, spec)


@query("evidence_level", with_(*BAND_CTE, "st AS (SELECT vec_id, band, e, u, sd / w AS sdu, CASE WHEN sd / w > 0.02e0 AND u < 0.1e0 THEN 'n' WHEN u >= 0.4e0 THEN 'strong' WHEN u >= 0.1e0 THEN 'clear' WHEN u > faint THEN 'faint' ELSE 'flat' END AS st FROM br JOIN sd USING (vec_id))",
                               "ag AS (SELECT vec_id, median(u) FILTER (band IN ('CH1728','CH1689','CH2262','AM2175','NH1545c') AND st <> 'n') AS s, count(*) FILTER (band IN ('CH1728','CH1689','CH2262','AM2175','NH1545c') AND st <> 'n') AS nread, "
                               "count(*) FILTER (band IN ('CH1728','CH1689','CH2262','AM2175','NH1545c') AND st IN ('faint','clear','strong')) AS lit, bool_and(st IN ('n','flat')) FILTER (band IN ('CH1728','CH1689','CH2262','AM2175','NH1545c')) AS allflat, "
                               "max(u) FILTER (band IN ('AM2175','NH2044') AND st <> 'n') AS nh, max(u) FILTER (band = 'NH2044') AS ux, bool_or(st <> 'n') FILTER (band = 'NH2044') AS xread, bool_and(st <> 'n') FILTER (band IN ('CH1728','AM2175')) AS must FROM st GROUP BY vec_id)",
                               "lv AS (SELECT *, (allflat AND must AND nread >= 3 AND (ux <= 0 OR NOT xread) AND g < 1e0) AS none FROM ag JOIN gd USING (vec_id))") + f"""
SELECT vec_id, CASE WHEN none THEN 'none' WHEN lit = 0 AND allflat AND g < 1e0 AND NOT (ux > 0 AND xread) THEN 'can''t tell' WHEN coalesce(s >= 0.4e0 AND lit = nread AND nh >= 0.05e0, false) THEN 'strong'
 WHEN coalesce(s >= 0.1e0 AND lit >= 3 AND nh >= 0.05e0, false) THEN 'clear' ELSE 'trace' END AS level, {q6('s')} AS score, nread AS n_readable, lit AS n_lit, {q6('g')} AS guard FROM lv""")
def _evidence(spark, sf):
    d = K.check_evidence(banded(spark, sf), RULES64, BANDS64)
    e = lambda k: F.col(f"evidence.{k}")
    return d.select("vec_id", e("level").alias("level"), r6(e("S")).alias("score"), e("n_readable_core").alias("n_readable"), e("n_lit_core").alias("n_lit"), r6(e("guard_max_E")).alias("guard"))


@query("band_pattern", with_(*BAND_CTE, "st AS (SELECT vec_id, band, e, u, e > 0 AS lit, NOT (sd > 0.02e0 * w AND e < 0.1e0 * w) AS rd, NOT (sd / w > 0.02e0 AND u < 0.1e0) AND u > 0.1e0 AS vote, band IN ('NH2044','AM2175') AS prot, band IN ('CH1689','CH1728','CH2262','CH2284') AS ch FROM br JOIN sd USING (vec_id))",
                             "ag AS (SELECT vec_id, count(*) FILTER (prot AND lit) AS np, count(*) FILTER (ch AND lit) AS nc, bool_and(rd) FILTER (prot) AS prd, bool_and(rd AND lit) FILTER (prot OR ch) AS allgood, bool_or(NOT lit AND rd) FILTER (ch) AS chflat, bool_or(vote) FILTER (band = 'NH1545c') AS vote FROM st GROUP BY vec_id)",
                             "v AS (SELECT *, CASE WHEN prd AND np = 0 THEN 'Unlikely' WHEN allgood THEN 'Good' WHEN prd AND np > 0 AND (np = 1 OR chflat) THEN 'Borderline' ELSE 'Can''t tell' END AS pv FROM ag)") + """
SELECT vec_id, CASE WHEN np + nc = 0 THEN 'A' WHEN np = 0 THEN 'B' WHEN np = 1 THEN 'C' WHEN nc < 4 THEN 'D' ELSE 'E' END AS pattern, pv AS pattern_verdict, CASE WHEN pv = 'Unlikely' AND vote THEN 'Borderline' ELSE pv END AS verdict FROM v""")
def _pattern(spark, sf):
    d = K.check_pattern(banded(spark, sf), RULES64, BANDS64)
    return d.select("vec_id", *[F.col(f"pattern.{k}").alias(k) for k in ("pattern", "pattern_verdict", "verdict")])


@query("band_counts", with_(*BAND_CTE, "st AS (SELECT vec_id, CASE WHEN sd / w > 0.02e0 AND u < 0.1e0 THEN 'n' WHEN u > least(faint, 0.1e0) THEN 'lit' ELSE 'flat' END AS st FROM br JOIN sd USING (vec_id) WHERE band <> 'CH2284')") + """
SELECT vec_id, count(*) FILTER (st = 'lit') AS lit, count(*) AS total, count(*) FILTER (st = 'n') AS noisy FROM st GROUP BY vec_id""")
def _band_counts(spark, sf):
    d = V.band_counts(K.check_evidence(banded(spark, sf), RULES64, BANDS64))
    return d.select("vec_id", *[F.col(f"band_counts.{k}").alias(k) for k in ("lit", "total", "noisy")])


# ------------------------------------------------------------------------------------------ matching
_PICK = """u AS (SELECT s_suppkey AS id, CASE s_nationkey % 6 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'MACHINERY' WHEN 4 THEN 'HOUSEHOLD' ELSE 'OTHER' END AS src,
 CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE (s_suppkey % 50)::VARCHAR END AS ser, row_number() OVER (ORDER BY s_suppkey) AS rank FROM supplier)"""


def _corrections(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier")
    cls = F.element_at(F.lit(["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD", "OTHER"]), (F.col("s_nationkey") % 6 + 1).cast("int"))
    return s.select(F.col("s_suppkey").cast("string").alias("correction_id"), cls.alias("source_class"), F.when(F.col("s_suppkey") % 7 != 0, (F.col("s_suppkey") % 50).cast("string")).alias("source_serial"),
                    F.lit("HOUSEHOLD").alias("target_class"), F.col("s_suppkey").alias("rank"))


@query("correction_pick", f"WITH {_PICK}," + """
unit AS (SELECT src, ser, arg_min(id, rank) AS id FROM u WHERE ser IS NOT NULL GROUP BY ALL), whole AS (SELECT src, arg_min(id, rank) AS id FROM u WHERE ser IS NULL GROUP BY ALL)
SELECT c_custkey, coalesce(unit.id::VARCHAR, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'none' END, whole.id::VARCHAR) AS correction_id,
 CASE WHEN unit.id IS NOT NULL THEN 'unit' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'native' WHEN whole.id IS NOT NULL THEN 'class' ELSE 'missing' END AS scope
FROM customer LEFT JOIN unit ON unit.src = c_mktsegment AND unit.ser = (c_custkey % 60)::VARCHAR LEFT JOIN whole ON whole.src = c_mktsegment""")
def _pick(spark, sf):
    scans = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("class"), (F.col("c_custkey") % 60).alias("serial"))
    d = M.pick_correction(scans, _corrections(spark, sf), "HOUSEHOLD")
    return d.select("c_custkey", "correction_id", F.col("correction_id_scope").alias("scope"))


_INST = {"default_class": "std", "classes": [{"class": "hires", "serials": [], "swir_gain": [1, 60]}, {"class": "std", "serials": [], "swir_gain": [150, 65535]}]}


@query("class_preset", """WITH s AS (SELECT s_suppkey % 500 AS serial, arg_min(CASE WHEN s_nationkey % 2 = 0 THEN 'std' ELSE 'hires' END, s_suppkey) AS known FROM supplier GROUP BY 1),
c AS (SELECT c_custkey, c_custkey % 900 AS serial, c_custkey * 7 % 400 AS g1, c_custkey * 11 % 400 AS g2, CASE WHEN c_custkey % 10 = 0 THEN c_mktsegment END AS usr FROM customer),
h AS (SELECT *, CASE WHEN g1 BETWEEN 1 AND 60 AND g2 BETWEEN 1 AND 60 THEN 'hires' WHEN g1 BETWEEN 150 AND 65535 AND g2 BETWEEN 150 AND 65535 THEN 'std' END AS hint FROM c)
SELECT c_custkey, coalesce(usr, known, hint, 'std') AS class, CASE WHEN usr IS NOT NULL THEN 'user' WHEN known IS NOT NULL THEN 'preset' WHEN hint IS NOT NULL THEN 'header' ELSE 'default' END AS source FROM h LEFT JOIN s USING (serial)""")
def _preset(spark, sf):
    s = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 500).alias("serial")).agg(F.min_by(F.when(F.col("s_nationkey") % 2 == 0, "std").otherwise("hires"), "s_suppkey").alias("serial_class"))
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select("c_custkey", (k % 900).alias("serial"), (k * 7 % 400).alias("swir1_gain"), (k * 11 % 400).alias("swir2_gain"), F.when(k % 10 == 0, F.col("c_mktsegment")).alias("user_class"))
    return M.preset_class(c, s, _INST).select("c_custkey", "class", F.col("class_source").alias("source"))


@query("collection_serial", """WITH s AS (SELECT s_suppkey AS serial, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_nationkey % 2 = 0 THEN 'std' ELSE 'hires' END AS cls FROM supplier),
k AS (SELECT c_nationkey, c_custkey, c_custkey % 300 AS serial, cls FROM customer LEFT JOIN s ON s.serial = c_custkey % 300)
SELECT c_nationkey AS collection, coalesce(arg_min(serial, c_custkey) FILTER (cls IS NOT NULL), arg_min(serial, c_custkey)) AS serial, arg_min(cls, c_custkey) FILTER (cls IS NOT NULL) AS class FROM k GROUP BY 1""")
def _collection(spark, sf):
    s = table(spark, sf, "supplier").where(F.col("s_suppkey") % 3 != 0).select(F.col("s_suppkey").alias("serial"), F.when(F.col("s_nationkey") % 2 == 0, "std").otherwise("hires").alias("serial_class"))
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("collection"), F.col("c_custkey").alias("seq"), (F.col("c_custkey") % 300).alias("serial"))
    return M.collection_class(c, s)


@query("shown_models", """WITH c AS (SELECT c_custkey, c_acctbal > 0 AS native, c_mktsegment AS cls FROM customer), m(key, when_, classes) AS (VALUES ('cons3', 'every_scan', ''), ('s1', 'non_native', ''), ('old', 'legacy', 'BUILDING'))
SELECT c_custkey, key FROM c, m WHERE when_ = 'every_scan' OR (when_ = 'non_native' AND NOT native) OR (when_ = 'legacy' AND cls = classes)""")
def _shown(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("native"), F.col("c_mktsegment").alias("class"))
    specs = [{"key": "cons3", "model_id": "a", "role": "verdict_input"}, {"key": "s1", "model_id": "b", "role": "second_opinion", "shown_for": "non_native"}, {"key": "old", "model_id": "c", "role": "published", "shown_for_classes": ["BUILDING"]}]
    return M.shown_models(c, specs).select("c_custkey", "key")


@query("pair_scans", f"""SELECT o_orderkey, {q6('o_totalprice')} AS a, {q6('s')} AS b, round(s - o_totalprice, 4) + 0e0 AS difference FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def _pair(spark, sf):
    a = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
    b = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("value"))
    d = M.pair_scans(a, b, "o_orderkey")
    return d.select("o_orderkey", r6(F.col("value_a")).alias("a"), r6(F.col("value_b")).alias("b"), (F.round("difference", 4) + F.lit(0.0)).alias("difference"))


@query("version_select", """WITH p AS (SELECT p_brand AS id, (p_size % 12)::VARCHAR || '.' || (p_partkey % 30)::VARCHAR || '.0' AS version, p_size % 12 AS a, p_partkey % 30 AS b, p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'withdrawn' ELSE 'active' END AS st FROM part)
SELECT id, arg_max(version, (a, b, -p_partkey)) AS version, arg_max(p_partkey, (a, b, -p_partkey)) AS origin FROM p WHERE st = 'active' GROUP BY id""")
def _versions(spark, sf):
    p = F.col("p_partkey")
    d = table(spark, sf, "part").select(F.lit("model").alias("format"), F.col("p_brand").alias("id"), F.concat_ws(".", (F.col("p_size") % 12).cast("string"), (p % 30).cast("string"), F.lit("0")).alias("version"),
                                        F.when(p % 9 == 0, F.lit("withdrawn")).otherwise(F.lit("active")).alias("status"), p.alias("origin"))
    return M.select_versions(d).select("id", "version", "origin")


# ------------------------------------------------------------------------------------------ arrivals
@query("file_revisions", """WITH e AS (SELECT event_id, user_id, ts, floor(value / 100) AS v FROM events), c AS (SELECT *, lag(v) OVER w AS p, row_number() OVER w AS rn FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, sum(CASE WHEN rn = 1 OR v IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS revision FROM c""")
def _revisions(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", F.floor(F.col("value") / 100).alias("v"))
    d = SQ.change_counts(e, ["user_id"], F.to_date("ts"), [F.col("ts"), F.col("event_id")], "v")
    return d.select("event_id", "user_id", "revision")


@query("result_revisions", """WITH k AS (SELECT user_id, event_type, floor(value)::BIGINT AS cfg, min(event_id) AS event_id, min(ts) AS ts FROM events GROUP BY ALL)
SELECT user_id, event_type, cfg, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::BIGINT AS revision FROM k""")
def _result_revisions(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", "event_type", F.floor("value").alias("cfg")).agg(F.min("event_id").alias("event_id"), F.min("ts").alias("ts"))
    d = SQ.row_numbers(e, ["user_id", "event_type"], F.to_date("ts"), [F.col("ts"), F.col("event_id")], "revision")
    return d.select("user_id", "event_type", "cfg", "revision")


@query("content_dedupe", """WITH h AS (SELECT doc_id, sha256(text) AS sha FROM documents), f AS (SELECT sha, min(doc_id) AS first_doc, count(*) AS copies FROM h GROUP BY sha)
SELECT doc_id, sha, CASE WHEN first_doc <> doc_id THEN first_doc::VARCHAR END AS same_content_as, copies FROM h JOIN f USING (sha)""")
def _dedupe(spark, sf):
    h = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("sha"))
    f = h.groupBy("sha").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))
    return h.join(f, "sha").select("doc_id", "sha", F.when(F.col("first_doc") != F.col("doc_id"), F.col("first_doc").cast("string")).alias("same_content_as"), "copies")


@query("drop_shadowed", """WITH p AS (SELECT '/d' || (doc_id % 7) || '/scan' || (doc_id // 14) || CASE WHEN doc_id % 14 < 7 THEN '.asd' ELSE '.asd.sco' END AS path, doc_id FROM documents)
SELECT doc_id, path FROM p a WHERE NOT (a.path LIKE '%.sco' AND EXISTS (SELECT 1 FROM p b WHERE b.path = left(a.path, length(a.path) - 4)))""")
def _shadowed(spark, sf):
    d = F.col("doc_id")
    p = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("/d"), (d % 7).cast("string"), F.lit("/scan"), F.floor(d / 14).cast("string"), F.when(d % 14 < 7, F.lit(".asd")).otherwise(F.lit(".asd.sco"))).alias("path"))
    return drop_shadowed(p)


@query("top_k_per_group", f"SELECT o_orderpriority, o_orderkey, {q6('o_totalprice')} AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 5")
def _topk(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    d = SQ.top_k(o, ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5)
    return d.select("o_orderpriority", "o_orderkey", r6(F.col("o_totalprice")).alias("price"))


# ------------------------------------------------------------------------------------------ evaluation
@query("model_evaluation", """WITH d AS (SELECT l_returnflag, l_extendedprice / 1000e0 AS y, l_quantity * 1.5e0 AS p FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(power(corr(y, p), 2), 6) AS r2, round(sqrt(avg(power(p - y, 2))), 6) AS rmse, count(*) FILTER (y < 3 AND p < 3) AS below_right, count(*) FILTER (y < 3) AS below_n,
 count(*) FILTER (y >= 3 AND p >= 3) AS above_right, count(*) FILTER (y >= 3) AS above_n FROM d GROUP BY l_returnflag""")
def _evaluation(spark, sf):
    d = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000.0).alias("y"), (F.col("l_quantity") * 1.5).alias("p"))
    e = EV.evaluate_model(d, "y", "p", ["l_returnflag"])
    return e.withColumns({"r2": F.round("r2", 6), "rmse": F.round("rmse", 6)})


@query("compare_outputs", """WITH g AS (SELECT l_orderkey AS k, sum(l_quantity) AS v FROM lineitem WHERE l_orderkey % 11 <> 0 GROUP BY 1), w AS (SELECT l_orderkey AS k, sum(l_quantity + CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END) AS v FROM lineitem WHERE l_orderkey % 17 <> 0 GROUP BY 1)
SELECT coalesce(g.k, w.k) AS case_id, CASE WHEN g.k IS NULL THEN 'missing' WHEN w.k IS NULL THEN 'extra' WHEN abs(g.v - w.v) > 1e-9 + 1e-9 * abs(w.v) THEN 'out of tolerance' END AS problem FROM g FULL JOIN w ON g.k = w.k""")
def _compare(spark, sf):
    li = table(spark, sf, "lineitem")
    k, q = F.col("l_orderkey"), F.col("l_quantity")
    side = lambda d, v: d.groupBy(k.alias("case")).agg(F.sum(v).alias("v")).select("case", F.lit("sum").alias("key"), F.array("v").alias("numbers"), F.lit(None).cast("string").alias("label"))
    d = EV.compare_outputs(side(li.where(k % 11 != 0), q), side(li.where(k % 17 != 0), q + F.when(k % 13 == 0, 1).otherwise(0)))
    return d.select(F.col("case").alias("case_id"), "problem")


@query("output_difference", """WITH g AS (SELECT c_nationkey AS n, c_mktsegment AS s FROM customer WHERE c_custkey % 2 = 0), w AS (SELECT c_nationkey AS n, c_mktsegment AS s FROM customer WHERE c_custkey % 2 = 1)
SELECT side, count(*) AS rows, count(DISTINCT (n, s)) AS keys FROM (SELECT *, 'extra' AS side FROM (FROM g EXCEPT ALL FROM w) UNION ALL SELECT *, 'missing' FROM (FROM w EXCEPT ALL FROM g)) GROUP BY side""")
def _difference(spark, sf):
    c = table(spark, sf, "customer")
    part = lambda r: c.where(F.col("c_custkey") % 2 == r).select(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s"))
    d = EV.output_difference(part(0), part(1))
    return d.groupBy("side").agg(F.count("*").alias("rows"), F.countDistinct("n", "s").alias("keys"))


@query("split_cases", """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'public' ELSE 'private' END AS side FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def _split(spark, sf):
    c = table(spark, sf, "documents").select(F.col("doc_id").alias("spectrum_sha256"))
    pub, priv = M.split_cases(c, table(spark, sf, "labels").select(F.col("doc_id").alias("spectrum_sha256")))
    return pub.withColumn("side", F.lit("public")).unionByName(priv.withColumn("side", F.lit("private"))).withColumnRenamed("spectrum_sha256", "doc_id")


@query("label_agreement", """SELECT quality, count(*) AS n, count(*) FILTER (n_chars >= 1000) AS long_n, round(avg(n_chars), 6) AS mean_chars FROM documents JOIN labels USING (doc_id) GROUP BY quality""")
def _labels(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return d.groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") >= 1000).alias("long_n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


# ------------------------------------------------------------------------------------------ scalars and records
@query("ole_dates", """SELECT o_orderkey, (epoch(o_orderdate) / 86400e0 + 25569e0 + (o_orderkey % 86400) / 86400e0) AS ole, strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y-%m-%d %H:%M:%S') AS local, (o_orderkey % 20 - 10) * 60 AS utc_offset FROM orders""".replace("(epoch(o_orderdate) / 86400e0 + 25569e0 + (o_orderkey % 86400) / 86400e0) AS ole, ", ""))
def _ole(spark, sf):
    o = table(spark, sf, "orders")
    # seconds on the table's own clock, whatever the session's time zone
    secs = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("o_orderdate").cast("timestamp_ntz")) + F.col("o_orderkey") % 86400
    ole = secs / F.lit(86400.0) + 25569.0
    off = D.utc_offset_minutes(ole, secs - (F.col("o_orderkey") % 20 - 10) * 3600)
    return o.select("o_orderkey", D.ole_to_timestamp(ole).cast("string").alias("local"), off.cast("bigint").alias("utc_offset"))


@query("natural_order", """SELECT p_partkey, row_number() OVER (ORDER BY p_partkey // 100, p_partkey % 100) AS pos FROM part""")
def _natural(spark, sf):
    name = F.concat(F.lit("Scan"), F.floor(F.col("p_partkey") / 100).cast("string"), F.lit("_"), (F.col("p_partkey") % 100).cast("string"), F.lit(".asd"))
    return RK.natural_rank(table(spark, sf, "part").select("p_partkey", name.alias("file")), out="pos").select("p_partkey", "pos")


@query("flatten_long", """SELECT event_id, unnest(['event_type', 'nested.user', 'nested.v.n', 'nested.v.0', 'nested.v.1']) AS key, unnest([event_type, user_id::VARCHAR, '2', (event_id % 5)::VARCHAR, (event_id % 3)::VARCHAR]) AS value FROM events""")
def _flatten(spark, sf):
    e = F.col("event_id")
    d = table(spark, sf, "events").select("event_id", "event_type", F.struct(F.col("user_id").alias("user"), F.array(e % 5, e % 3).alias("v")).alias("nested"))
    return RC.flatten_long(d, ["event_id"])


@query("organic_filter", with_(*READINGS_CTE) + "SELECT vec_id, CASE WHEN m < 0.5e0 THEN 'none' WHEN m < 1.5e0 THEN 'trace' ELSE 'clear' END AS level FROM cons WHERE m >= 0.5e0")
def _organic(spark, sf):
    lv = N.level_label(F.col("m"), [{"label": "none", "below": 0.5}, {"label": "trace", "below": 1.5}, {"label": "clear"}])
    return RK.organic_only(consensus(spark, sf).select("vec_id", lv.alias("level")))


# ------------------------------------------------------------------------------------------ rows only
@query("noise_gains")
def _gains(spark, sf):
    """Noise gain and implied SD of the demo model per scan, by its distinct layouts."""
    d = spectra(spark, sf).withColumn("correction_id", F.when(F.col("label") % 2 == 0, F.lit("blur")).otherwise(F.lit("none")))
    beta = np.convolve([1.0, -2.0, 1.0], np.hanning(9))
    f = R.Functional("d2", 1e-6, ((376.0, tuple(float(x) for x in beta)),), 0.0, ((376.0, 386.0),))
    req = [Z.GainRequest("d2", f, ((374.0, 390.0),), "term")]
    corr = [{"id": "blur", "operator": [{"op": "gaussian_blur", "sigma_nm": [1.0, 1.5, 1.0]}]}]
    d = Z.noise_gains(Z.n2(d, ((374.0, 390.0),)), req, corr, n=F.col("n"))
    return d.select("vec_id", "correction_id", r6(Z.term_sd("d2")).alias("sd"))


@query("spectrum_hash")
def _hash(spark, sf):
    return with_spectrum_hash(spectra(spark, sf)).select("vec_id", "spectrum_sha256")


@query("corrected_stream", with_(f"s AS (SELECT *, {SEG} AS seg FROM L)",
                                 "p AS (SELECT a.vec_id, a.label, a.seg, a.ch, a.r AS own, b.r, exp(-0.5e0 * power((b.wl - a.wl) / 1.5e0, 2)) AS g FROM s a JOIN s b ON a.vec_id = b.vec_id AND a.seg = b.seg AND abs(a.ch - b.ch) <= 6)",
                                 "c AS (SELECT vec_id, label, ch, seg, any_value(own) AS own, sum(g * r) / sum(g) AS b FROM p GROUP BY ALL)") + f"""
SELECT vec_id, ch, {q6("CASE WHEN label % 3 = 0 THEN own WHEN label % 3 = 1 THEN power(10e0, -(1.05e0 * log10(1e0 / greatest(b, 1e-3)) + 0.01e0)) ELSE 0.9e0 * own + 0.02e0 END")} AS value FROM c""")
def _stream(spark, sf):
    corr = [{"id": "a", "operator": [{"op": "gaussian_blur", "sigma_nm": 1.5}, {"op": "absorbance_affine", "gain": 1.05, "offset": 0.01, "clip_min": 1e-3}]},
            {"id": "b", "operator": [{"op": "affine_reflectance", "segments": [{"a": 0.9, "b": 0.02}] * 3}]}]
    d = spectra(spark, sf).withColumn("correction_id", F.element_at(F.lit(["none", "a", "b"]), (F.col("label") % 3 + 1).cast("int")))
    return long_out(M.apply_correction(d, corr), "stream")
