"""Spectral transforms over a table of scans (one row per scan, ``r`` an array on a uniform grid).

Element-wise transforms and block normalisation are higher-order functions (JVM, no shuffle); smoothing, blur,
resampling and standardisation are weight tables evaluated per Arrow batch (``arrow.linear_pass``) or, for spectra
already in long form, by a broadcast join. A transform that does not apply to a scan sets its array to null and
writes the reason to ``error``; later transforms keep the first reason.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenscan.functions import arrays as A
from lumenscan.operators import weights as wt
from lumenscan.operators.arrow import linear_pass
from lumenscan.rulebook import WL_TOL


def _fail(df: DataFrame, bad: Column, reason, col: str) -> DataFrame:
    reason = reason if isinstance(reason, Column) else F.lit(reason)
    bad = F.coalesce(bad, F.lit(True))
    old = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    return df.withColumns({"error": F.coalesce(old, F.when(bad & F.col(col).isNotNull(), reason)),
                           col: F.when(~bad, F.col(col))})


# ---------------------------------------------------------------------------------------------- projections
def reflectance(df: DataFrame, sample: str = "sample_dn", reference: str = "reference_dn", stored: str | None = None,
                out: str = "r") -> DataFrame:
    """Sample DN over white-reference DN (null where the reference is 0), or the stored reflectance."""
    ratio = F.zip_with(F.col(sample), F.col(reference), lambda s, w: F.try_divide(s, w))
    return df.withColumn(out, F.coalesce(F.col(stored), ratio) if stored else ratio)


def crop(df: DataFrame, lo: float, hi: float, col: str = "r") -> DataFrame:
    """Keep lo <= wl <= hi; a crop that leaves no points is an error for that scan."""
    first = F.greatest(F.ceil((F.lit(lo - WL_TOL) - F.col("wl_start")) / F.col("wl_step")), F.lit(0).cast("bigint"))
    df = df.withColumns({"_first": first, "_cut": A.covered(F.col(col), lo, hi)})
    df = df.withColumns({col: F.col("_cut"), "wl_start": F.col("wl_start") + F.col("_first") * F.col("wl_step")})
    return _fail(df, F.size(F.coalesce(F.col(col), F.array().cast("array<double>"))) == 0,
                 "crop leaves no points", col).drop("_first", "_cut")


def absorbance_of(x: Column, clip: float) -> Column:
    """log10(1 / max(R, clip)) of one value; NaN stays NaN."""
    return F.log10(F.lit(1.0) / F.greatest(x, F.lit(float(clip))))


def absorbance(df: DataFrame, clip: float = 1e-3, col: str = "r", out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, F.transform(F.col(col), lambda x: absorbance_of(x, clip)))


def select_wavelengths(df: DataFrame, wls: list[float], col: str = "r", out: str = "features") -> DataFrame:
    """The values at exact grid wavelengths, in the order asked for; a wavelength off the grid is an error."""
    if "wl" in df.columns:
        pos = F.transform(F.lit([float(w) for w in wls]), lambda t: F.array_position(
            F.transform(F.col("wl"), lambda w: F.abs(w - t) <= WL_TOL), F.lit(True)))
    else:
        def place(t):
            ch = A.channel(t)
            on = (F.abs(F.col("wl_start") + ch * F.col("wl_step") - t) <= WL_TOL) & (ch >= 0) & (ch < F.size(F.col(col)))
            return F.when(on, ch + 1).otherwise(0).cast("bigint")
        pos = F.transform(F.lit([float(w) for w in wls]), place)
    df = df.withColumn("_pos", pos)
    df = df.withColumn(out, F.transform(F.col("_pos"), lambda p: F.when(
        p > 0, F.element_at(F.col(col), F.greatest(p, F.lit(1).cast("bigint")).cast("int")))))
    return _fail(df, F.exists("_pos", lambda p: p <= 0), "wavelength not on grid", out).drop("_pos")


def with_segments(df: DataFrame, col: str = "r", out: str = "segments") -> DataFrame:
    return df.withColumn(out, A.segments(F.col("joins_nm"), F.size(F.col(col))))


# ---------------------------------------------------------------------------------------------- long form
def to_long(df: DataFrame, keep: list[str] = ("scan_id",), col: str = "r") -> DataFrame:
    """(keep.., ch, wl, segment, r). Narrow: the explode stays in the partition of the scan."""
    segs = [A.segments(F.col("joins_nm"), F.size(F.col(col))).alias("_s")] if "joins_nm" in df.columns else []
    out = df.select(*keep, "wl_start", "wl_step", *segs, F.posexplode(F.col(col)).alias("ch", "r"))
    cols = [*keep, "ch", (F.col("wl_start") + F.col("ch") * F.col("wl_step")).alias("wl"),
            *([A.segment_index(F.col("ch"), F.col("_s")).alias("segment")] if segs else []), "r"]
    return out.select(*cols)


def from_long(long: DataFrame, key: str = "scan_id", value: str = "r", out: str = "r") -> DataFrame:
    """Arrays back from long form. A group is one scan, so it is bounded by the channel count."""
    g = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ch", "wl", F.col(value).alias("v")))).alias("p"))
    first, last = F.element_at("p", 1), F.element_at("p", -1)
    step = F.when(F.size("p") > 1, (last["wl"] - first["wl"]) / (F.size("p") - 1)).otherwise(1.0)
    return g.select(key, first["wl"].alias("wl_start"), step.alias("wl_step"),
                    F.transform("p", lambda s: s["v"]).alias(out))


def weight_table(spark: SparkSession, w: wt.Weights) -> DataFrame:
    return spark.createDataFrame(w.rows(), "out_ch int, out_wl double, ch int, weight double")


def apply_weights_long(long: DataFrame, table: DataFrame, key: str = "scan_id", value: str = "r") -> DataFrame:
    """A weight table over spectra in long form: broadcast join on the channel, then a partial sum per output channel.

    The table is a dimension: its size is set by the grid (channels x window), never by the number of scans.
    """
    return (long.join(F.broadcast(table), "ch")
            .groupBy(key, "out_ch", "out_wl").agg(F.sum(F.col(value) * F.col("weight")).alias(value))
            .select(key, F.col("out_ch").alias("ch"), F.col("out_wl").alias("wl"), value))


def second_difference(long: DataFrame, key: str = "scan_id", value: str = "r", out: str = "d2") -> DataFrame:
    """Second difference over channels of spectra in long form (null at both ends)."""
    w = W.partitionBy(key).orderBy("ch")
    v = F.col(value)
    return long.withColumn(out, F.lag(v).over(w) - 2.0 * v + F.lead(v).over(w))


def moving_weighted(long: DataFrame, weights: list[float], key: str = "scan_id", value: str = "r",
                    out: str = "smoothed") -> DataFrame:
    """Centred weighted window over channels in long form (null where the window leaves the scan)."""
    h = len(weights) // 2
    w = W.partitionBy(key).orderBy("ch")
    terms = [F.lag(F.col(value), h - k).over(w) * F.lit(float(c)) for k, c in enumerate(weights)]
    return long.withColumn(out, reduce(lambda a, b: a + b, terms))


# ---------------------------------------------------------------------------------------------- linear operators
def savgol(df: DataFrame, window: int, polyorder: int, deriv: int = 0, delta: float = 1.0, mode: str = "interp",
           col: str = "r") -> DataFrame:
    wt.savgol_weights(window, polyorder, deriv, delta)          # refuse bad parameters before the job starts
    return linear_pass(df, lambda wl, joins: wt.savgol(wl, window, polyorder, deriv, delta, mode), col)


def savgol_interior(arr: Column, window: int, polyorder: int, deriv: int = 0, delta: float = 1.0) -> Column:
    """Interior Savitzky-Golay values as a column expression (window // 2 channels shorter at both ends)."""
    c = F.lit([float(x) for x in wt.savgol_weights(window, polyorder, deriv, delta)])
    return F.when(F.size(arr) >= window, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(arr) - (window - 1), F.lit(1))),
        lambda i: A.dot(F.slice(arr, i, F.lit(window)), c)))


def gaussian_blur(df: DataFrame, sigma_nm=None, fwhm_nm=None, truncate: float = 4.0, radius: str = "round",
                  segments: str = "from_scan", col: str = "r") -> DataFrame:
    return linear_pass(df, lambda wl, joins: wt.gaussian_blur(wl, joins, sigma_nm, fwhm_nm, truncate, radius,
                                                              across_joins=segments == "none"), col)


def resample(df: DataFrame, to_grid, col: str = "r") -> DataFrame:
    """Onto a uniform target grid ({"start_nm", "step_nm", "n"})."""
    if "wavelengths_nm" in to_grid:
        target = np.asarray(to_grid["wavelengths_nm"], float)
        if len(target) > 2 and np.max(np.abs(np.diff(target) - (target[1] - target[0]))) > WL_TOL:
            raise ValueError("resample: the target grid must be uniform in a table of uniform scans")
    else:
        target = wt.grid(to_grid["start_nm"], to_grid["step_nm"], int(to_grid["n"]))
    return linear_pass(df, lambda wl, joins: wt.resample(wl, target), col)


def pds_banded(df: DataFrame, wavelengths_nm, B, offset=None, col: str = "r") -> DataFrame:
    return linear_pass(df, lambda wl, joins: wt.pds(wl, wavelengths_nm, B, offset), col)


def detrend(df: DataFrame, degree: int = 1, col: str = "r") -> DataFrame:
    return linear_pass(df, lambda wl, joins: wt.detrend(wl, degree), col)


def derivative(df: DataFrame, kernel: dict, col: str = "r", out: str = "E") -> DataFrame:
    """scale x SG(absorbance), null on the half-window at both ends, as one column expression."""
    sg = kernel["savgol"]
    h = sg["window"] // 2
    a = F.transform(F.col(col), lambda x: absorbance_of(x, kernel["absorbance_clip"]))
    inner = savgol_interior(F.col("_a"), sg["window"], sg["polyorder"], sg.get("deriv", 0), sg.get("delta", 1.0))
    edge = F.array_repeat(F.lit(None).cast("double"), h)
    scaled = F.transform(inner, lambda v: v * F.lit(float(kernel.get("scale", 1.0))))
    return (df.withColumn("_a", a)
            .withColumn(out, F.coalesce(F.concat(edge, scaled, edge),
                                        F.array_repeat(F.lit(None).cast("double"), F.size("_a")))).drop("_a"))


# ---------------------------------------------------------------------------------------------- normalisation
def _snv(block: Column, ddof: int) -> Column:
    stats = F.struct(A.mean(block).alias("m"), A.sd(block, ddof).alias("s"))
    return A.let(stats, lambda p: F.when((p["s"] > 0) & ~F.isnan(p["s"]),
                                         F.transform(block, lambda x: (x - p["m"]) / p["s"])))


def snv(df: DataFrame, ddof: int = 0, col: str = "r") -> DataFrame:
    """Standard normal variate over the whole grid."""
    df = df.withColumn(col, F.when(F.col(col).isNotNull(), F.coalesce(_snv(F.col(col), ddof),
                                                                      F.array().cast("array<double>"))))
    return _fail(df, F.size(F.coalesce(F.col(col), F.array().cast("array<double>"))) == 0, "SNV of a flat block", col)


def check_blocks(blocks) -> None:
    prev = -np.inf
    if not blocks:
        raise ValueError("snv blocks_nm must be a non-empty list of [lo, hi]")
    for lo, hi in blocks:
        if not (np.isfinite(lo) and np.isfinite(hi) and lo < hi):
            raise ValueError(f"snv block {lo}-{hi}: lo must be < hi")
        if lo <= prev + WL_TOL:
            raise ValueError("snv blocks must be sorted and must not overlap")
        prev = hi


def block_snv(df: DataFrame, blocks: list[tuple[float, float]], ddof: int = 0, col: str = "r") -> DataFrame:
    """SNV inside each wavelength block; the output is the blocks one after another, with their ``wl``.

    A block across one of the scan's own detector joins, one with fewer than 3 points and a flat one are errors.
    """
    check_blocks(blocks)
    empty = F.array().cast("array<double>")
    parts, grids, problem = [], [], F.lit(None).cast("string")
    for lo, hi in blocks:
        b = A.covered(F.col(col), lo, hi)
        first = F.greatest(F.ceil((F.lit(lo - WL_TOL) - F.col("wl_start")) / F.col("wl_step")),
                           F.lit(0).cast("bigint"))
        last_wl = F.col("wl_start") + (first + F.size(b) - 1) * F.col("wl_step")
        first_wl = F.col("wl_start") + first * F.col("wl_step")
        spans = (F.exists("joins_nm", lambda j: (first_wl <= j + WL_TOL) & (last_wl > j + WL_TOL))
                 if "joins_nm" in df.columns else F.lit(False))
        z = _snv(b, ddof)
        problem = F.coalesce(problem, F.when(F.size(b) < 3, F.concat(
            F.lit(f"SNV block {lo:g}-{hi:g} nm has "), F.size(b).cast("string"), F.lit(" grid points (needs >= 3)")))
            .when(F.coalesce(spans, F.lit(False)), F.lit(f"SNV block {lo:g}-{hi:g} nm spans a detector join"))
            .when(z.isNull(), F.lit("SNV of a flat block")))
        parts.append(F.coalesce(z, empty))
        grids.append(F.transform(F.sequence(F.lit(0), F.greatest(F.size(b) - 1, F.lit(0))),
                                 lambda i: first_wl + i * F.col("wl_step")))
    df = df.withColumns({"_problem": problem, "_z": F.concat(*parts), "wl": F.concat(*grids)})
    df = df.withColumns({col: F.when(F.col(col).isNotNull(), F.col("_z")), "wl_start": F.element_at("wl", 1)})
    return _fail(df, F.col("_problem").isNotNull(), F.col("_problem"), col).drop("_problem", "_z")


def msc(df: DataFrame, reference: list[float], col: str = "r") -> DataFrame:
    """Multiplicative scatter correction against a frozen reference: invert the scan's regression line on it."""
    ref = np.asarray(reference, float)
    centred = ref - ref.mean()
    x = F.col(col)
    m = A.mean(x)
    slope = A.dot(x, [float(v) for v in centred / (centred @ centred)])
    out = df.withColumns({"_m": m, "_b": F.when(F.size(x) == len(ref), slope)})
    line = F.struct((F.col("_m") - F.col("_b") * float(ref.mean())).alias("a"), F.col("_b").alias("b"))
    out = out.withColumn(col, A.let(line, lambda p: F.transform(x, lambda v: F.try_divide(v - p["a"], p["b"]))))
    return _fail(out, F.col("_b").isNull(), "MSC reference length mismatch", col).drop("_m", "_b")


# ---------------------------------------------------------------------------------------------- per-segment maps
def _segment_value(value, index: Column) -> Column:
    if isinstance(value, (int, float)):
        return F.lit(float(value))
    return F.try_element_at(F.lit([float(v) for v in value]), index + 1)


def _segment_check(df: DataFrame, values: dict, col: str) -> tuple[DataFrame, Column]:
    lists = {k: v for k, v in values.items() if not isinstance(v, (int, float))}
    df = with_segments(df, col, "_segs")
    bad, reason = F.lit(False), F.lit(None).cast("string")
    for k, v in lists.items():
        wrong = F.size("_segs") != len(v)
        reason = F.coalesce(reason, F.when(wrong, F.concat(F.lit(f"{k} has {len(v)} values, scan has "),
                                                           F.size("_segs").cast("string"), F.lit(" segments"))))
        bad = bad | wrong
    return _fail(df, bad, reason, col), F.col("_segs")


def absorbance_affine(df: DataFrame, gain, offset=0.0, clip_min: float = 1e-3, col: str = "r") -> DataFrame:
    """A' = gain * A + offset per detector segment, back in reflectance."""
    df, segs = _segment_check(df, {"gain": gain, "offset": offset}, col)
    def back(g, o, x):
        return F.pow(F.lit(10.0), -(g * absorbance_of(x, clip_min) + o))
    if isinstance(gain, (int, float)) and isinstance(offset, (int, float)):
        new = F.transform(F.col(col), lambda x: back(F.lit(float(gain)), F.lit(float(offset)), x))
    else:
        new = A.let(segs, lambda s: F.transform(F.col(col), lambda x, i: back(
            _segment_value(gain, A.segment_index(i, s)), _segment_value(offset, A.segment_index(i, s)), x)))
    return df.withColumn(col, new).drop("_segs")


def affine_reflectance(df: DataFrame, segments: list[dict], joins=None, col: str = "r") -> DataFrame:
    """R' = a R + b per detector segment (the scan's own joins, or fixed ones)."""
    kept = None
    if joins is not None:
        kept = "_joins"
        df = df.withColumns({kept: F.col("joins_nm"), "joins_nm": F.lit([float(j) for j in joins])})
    a, b = [s["a"] for s in segments], [s["b"] for s in segments]
    df, segs = _segment_check(df, {"affine_reflectance": a}, col)
    df = df.withColumn(col, A.let(segs, lambda s: F.transform(F.col(col), lambda x, i: _segment_value(
        a, A.segment_index(i, s)) * x + _segment_value(b, A.segment_index(i, s))))).drop("_segs")
    return df if kept is None else df.withColumn("joins_nm", F.col(kept)).drop(kept)


def line_weights(m: int, at: float) -> list[float]:
    """Weights that evaluate, at position ``at``, the least-squares line through m points at 0 .. m-1."""
    x = np.arange(m) - (m - 1) / 2.0
    return [float(v) for v in 1.0 / m + x * (at - (m - 1) / 2.0) / (x @ x)]


def join_channels(joins: Column) -> Column:
    """struct(i1, i2): the last channel of the lower and of the middle detector."""
    j = F.array_sort(joins)
    last_le = lambda k: (F.floor((F.try_element_at(j, F.lit(k)) - F.col("wl_start") + WL_TOL) / F.col("wl_step"))).cast("int")
    return F.when(F.size(joins) == 2, F.named_struct(F.lit("i1"), last_le(1), F.lit("i2"), last_le(2)))


def extrapolations(arr: Column, i1: Column, i2: Column, n_lo: int, n_hi: int) -> tuple[Column, Column]:
    """The SWIR1 line extrapolated one channel below its first and above its last channel."""
    return (A.dot(A.span(arr, i1 + 1, i1 + n_lo), line_weights(n_lo, -1.0)),
            A.dot(A.span(arr, i2 - n_hi + 1, i2), line_weights(n_hi, float(n_hi))))


def splice_correct(df: DataFrame, n_lo: int = 5, n_hi: int = 6, joins=None, col: str = "r") -> DataFrame:
    """Shift the outer detectors so that they meet the SWIR1 line extrapolated across each join."""
    j = F.lit([float(v) for v in joins]) if joins is not None else F.col("joins_nm")
    df = df.withColumn("_j", join_channels(j)).withColumns({"_i1": F.col("_j.i1"), "_i2": F.col("_j.i2")})
    below, above = extrapolations(F.col(col), F.col("_i1"), F.col("_i2"), n_lo, n_hi)
    df = df.withColumns({"_below": below, "_above": above})
    at = lambda i: F.try_element_at(F.col(col), i + 1)
    df = df.withColumns({"_d1": F.col("_below") - at(F.col("_i1")), "_d2": F.col("_above") - at(F.col("_i2") + 1)})
    shift = F.struct(*[F.col(f"_{k}").alias(k) for k in ("i1", "i2", "d1", "d2")])
    df = df.withColumn(col, A.let(shift, lambda p: F.transform(F.col(col), lambda x, i: x + F.when(
        i <= p["i1"], p["d1"]).when(i > p["i2"], p["d2"]).otherwise(F.lit(0.0)))))
    return _fail(df, F.col("_d1").isNull() | F.col("_d2").isNull(), "splice correction needs two joins on the grid",
                 col).drop("_j", "_i1", "_i2", "_below", "_above", "_d1", "_d2")


def project_out(df: DataFrame, window_nm, direction, centre, scale: float = 1.0, col: str = "E",
                out: str = "projected") -> DataFrame:
    """Remove one direction from a window: x' = x - v (v . (x - c)) with x = E / scale, then rescale."""
    v, c = [float(x) for x in direction], [float(x) for x in centre]
    if len(v) != len(c):
        raise ValueError("projection: direction and centre differ in length")
    x = A.window(F.col(col), float(window_nm[0]), float(window_nm[1]))
    x = F.when(F.size(x) == len(v), F.transform(x, lambda e: e / F.lit(float(scale))))
    def remove(xs):
        along = A.dot(F.zip_with(xs, F.lit(c), lambda a, b: a - b), v)
        return A.let(along, lambda t: F.zip_with(xs, F.lit(v), lambda a, d: (a - d * t) * F.lit(float(scale))))
    return df.withColumn(out, A.let(x, remove))


# ---------------------------------------------------------------------------------------------- chains
def apply_op(df: DataFrame, op: dict, col: str = "r") -> DataFrame:
    """One step of a parameter document's operator list."""
    p = {k: v for k, v in op.items() if k != "op"}
    name = op["op"]
    if name == "crop":
        return crop(df, *map(float, p["range_nm"]), col=col)
    if name == "absorbance":
        return absorbance(df, float(p.get("clip_min", 1e-3)), col)
    if name == "savgol":
        return savgol(df, int(p["window"]), int(p["polyorder"]), int(p.get("deriv", 0)), float(p.get("delta", 1.0)),
                      p.get("mode", "interp"), col)
    if name == "snv":
        blocks = p.get("blocks_nm")
        return snv(df, int(p.get("ddof", 0)), col) if blocks is None else block_snv(df, blocks, int(p.get("ddof", 0)), col)
    if name == "msc":
        return msc(df, p["reference"], col)
    if name == "detrend":
        return detrend(df, int(p.get("degree", 1)), col)
    if name == "resample":
        return resample(df, p["to_grid"], col)
    if name == "gaussian_blur":
        fwhm = p.get("fwhm_nm")
        return gaussian_blur(df, p.get("sigma_nm"), fwhm, float(p.get("truncate", 4.0)), p.get("radius", "round"),
                             p.get("segments", "from_scan"), col)
    if name == "pds_banded":
        return pds_banded(df, p["wavelengths_nm"], p["B"], p.get("offset"), col)
    if name == "affine_reflectance":
        joins = p.get("joins", "from_scan")
        return affine_reflectance(df, p["segments"], None if joins == "from_scan" else joins, col)
    if name == "absorbance_affine":
        return absorbance_affine(df, p["gain"], p.get("offset", 0.0), float(p["clip_min"]), col)
    if name == "splice_correct":
        joins = p.get("joins", "from_scan")
        return splice_correct(df, int(p.get("fit_points_lower", 5)), int(p.get("fit_points_upper", 6)),
                              None if joins == "from_scan" else joins, col)
    raise ValueError(f"unknown op {name}")


def apply_chain(df: DataFrame, ops: list[dict], col: str = "r") -> DataFrame:
    """The steps in order; the grid follows each step."""
    return reduce(lambda d, op: apply_op(d, op, col), ops, df)
