"""Noise: the robust second-difference measure of a scan, and what it means for every reading.

The gain of a reading (its SD per unit of measured noise) depends on the scan's layout and correction, not on its
values. Gains are therefore computed once per distinct (layout, correction) and joined back, however many scans
share them.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.functions import arrays as A
from lumenscan.functions import numeric as N
from lumenscan.functions import status as S
from lumenscan.operators import weights as wt
from lumenscan.operators.readings import Functional, NotLinear, fold_model, windows_functional
from lumenscan.operators.spectral import absorbance_of
from lumenscan.rulebook import KERNEL_E31, KERNEL_N17, N2_CLIP, N2_MAD_FACTOR, N2_UNITS, N2_WINDOWS, WL_TOL

# The noise model.
CORRELATION_NM = 1.25
TAPS_SD = 8.0
MOMENT_TOL = 1e-9
UNAVAILABLE = "not available on this instrument"
NOISE_UNKNOWN = "noise unknown (N2 not finite)"
KERNELS = {"signs": KERNEL_N17, "c1": KERNEL_E31}


def window_name(lo: float, hi: float) -> str:
    return f"{int(lo)}-{int(hi)}"


# ---------------------------------------------------------------------------------------------- the measure
def n2_column(arr: Column, lo: float, hi: float) -> Column:
    """1.4826 x MAD of the second differences of absorbance, centres lo <= wl < hi, in 1e-5 absorbance.

    Only the window's channels are transformed. Second differences that are not finite are left out; null when none
    is left.
    """
    s, d = F.col("wl_start"), F.col("wl_step")
    first = F.greatest(F.ceil((F.lit(float(lo)) - s) / d), F.lit(1).cast("bigint")).cast("int")
    last = F.least(F.ceil((F.lit(float(hi)) - s) / d) - 1, (F.size(arr) - 2).cast("bigint")).cast("int")
    part = F.when(last >= first, F.slice(arr, F.greatest(first, F.lit(1)), F.greatest(last - first + 3, F.lit(0))))
    a = F.transform(part, lambda x: absorbance_of(x, N2_CLIP))
    d2 = A.let(a, lambda v: F.filter(A.second_difference(v), N.is_finite))
    mad = A.let(d2, lambda v: A.let(A.median(v), lambda m: A.median(F.transform(v, lambda x: F.abs(x - m)))))
    return mad * F.lit(N2_MAD_FACTOR) * F.lit(N2_UNITS)


def n2(df: DataFrame, windows=tuple(N2_WINDOWS), col: str = "r", out: str = "n2") -> DataFrame:
    """``out``: map "lo-hi" -> N2 of the scan as measured."""
    pairs = [x for lo, hi in windows for x in (F.lit(window_name(lo, hi)), n2_column(F.col(col), lo, hi))]
    return df.withColumn(out, F.create_map(*pairs))


def n2_long(long: DataFrame, lo: float, hi: float, key: str = "scan_id", out: str = "n2") -> DataFrame:
    """The same measure for spectra in long form. Groups are scans, so a group is bounded by the channel count."""
    from pyspark.sql import Window as W
    w = W.partitionBy(key).orderBy("ch")
    a = long.withColumn("_a", absorbance_of(F.col("r"), N2_CLIP))
    d = a.withColumn("_d2", F.lag("_a").over(w) - 2.0 * F.col("_a") + F.lead("_a").over(w))
    d = d.where((F.col("wl") >= lo) & (F.col("wl") < hi) & N.is_finite(F.col("_d2")))
    centre = d.groupBy(key).agg(F.median("_d2").alias("_m"))
    return (d.join(centre, key).groupBy(key).agg(F.median(F.abs(F.col("_d2") - F.col("_m"))).alias("_mad"))
            .select(key, (F.col("_mad") * N2_MAD_FACTOR * N2_UNITS).alias(out)))


def n2_table(df: DataFrame, windows=tuple(N2_WINDOWS), col: str = "r", key: str = "scan_id") -> DataFrame:
    """(scan, window, n2): one row per scan and window."""
    return n2(df, windows, col, "_n2").select(key, F.explode("_n2").alias("window", "n2"))


def window_covered(n: Column, lo: float, hi: float) -> Column:
    """The grid holds a whole N2 window, with the neighbours its second differences read."""
    s, d = F.col("wl_start"), F.col("wl_step")
    last = s + d * (n - 1)
    first_in = s + F.ceil((F.lit(float(lo)) - s) / d) * d
    return F.coalesce((n >= 3) & (s < lo) & (last >= hi) & (first_in < hi), F.lit(False))


# ---------------------------------------------------------------------------------------------- gains
@dataclass(frozen=True)
class GainRequest:
    """One reading whose gain is wanted. ``windows``: the N2 windows to pair with its detector segments. ``mode``:
    'segments' pairs every segment it has weight in with the first window lying in it; 'band' wants exactly one
    segment, which must hold the window; 'term' wants only the segment that holds the window."""
    name: str
    functional: Functional
    windows: tuple[tuple[float, float], ...]
    mode: str = "term"
    correlation_nm: float = CORRELATION_NM
    factor: float = 1.0
    own_factors: str | None = None         # band id looked up in the correction's envelope factors


def _covariance(sd: float) -> np.ndarray:
    """Covariance of neighbouring channels at each distance: white noise seen through a Gaussian of ``sd`` channels."""
    if sd <= 0:
        return np.ones(1)
    reach = math.ceil(TAPS_SD * sd)
    taps = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sd) ** 2)
    return np.correlate(taps, taps, "full")[2 * reach:]


def _spread(weights: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """SD of each row of weights: the quadratic form of the rows with the banded covariance."""
    var = cov[0] * (weights * weights).sum(1)
    for k in range(1, min(len(cov), weights.shape[1])):
        var = var + 2.0 * cov[k] * (weights[:, :-k] * weights[:, k:]).sum(1)
    return np.sqrt(var)


def _as_measured(weights: np.ndarray, segment: np.ndarray, wl: np.ndarray, joins, operators, blurs: dict):
    """Weights on corrected absorbance as weights on measured absorbance, or the reason why there are none.

    ``segment``: the detector segment of each row. Every step is linear, so a row goes through the steps' matrices from the
    last to the first. ``blurs`` keeps a layout's blur matrices by their parameters.
    """
    count = len(wt.segment_ranges(wl, joins))
    for step in operators[::-1]:
        kind = step["op"]
        if kind == "snv":
            return "non-linear correction"
        if kind == "absorbance_affine":
            gain = np.atleast_1d(np.asarray(step["gain"], float))
            if np.ndim(step["gain"]) and len(gain) != count:
                return f"{UNAVAILABLE} (the correction's absorbance_affine gives {len(gain)} gain values; the scan has {count} segments)"
            weights = weights * np.broadcast_to(gain, count)[segment][:, None]
        elif kind == "gaussian_blur" and "sigma_nm" in step:
            mark = repr(sorted(step.items()))
            if mark not in blurs:
                try:
                    table = wt.gaussian_blur(wl, joins, step["sigma_nm"], None, float(step.get("truncate", 4.0)), step.get("radius", "round"))
                except wt.OperatorError as e:
                    return f"{UNAVAILABLE} ({e})"
                full = np.zeros((len(wl), len(wl)))
                np.add.at(full, (np.arange(len(wl))[:, None], table.idx), table.w)
                blurs[mark] = full
            weights = weights @ blurs[mark]
        else:
            lacks = " (it gives no sigma_nm)" if kind == "gaussian_blur" else ""
            return f"no noise propagation through the correction's {kind} step{lacks}"
    return weights


def reading_gains(readings: list[tuple[Functional, float]], wl: np.ndarray, joins, operators=(), blurs: dict | None = None):
    """(reading's number, segment, SD per unit N2) of each reading's part in each detector segment, and {number: problem}.

    All readings of a layout are rows of one matrix, a row for each segment they have weight in.
    """
    edge = np.array([b for _, b in wt.segment_ranges(wl, joins)])
    label = np.searchsorted(edge, np.arange(len(wl)), side="right")
    problem: dict[int, str] = {}
    rows, owner, where = [], [], []
    for i, (f, _) in enumerate(readings):
        ends = [[int(np.abs(wl - x).argmin()) for x in s] for s in f.supports]
        across = [k for k, (a, b) in enumerate(ends) if label[a] != label[b]]
        try:
            dense = f.dense(wl)
        except wt.OperatorError as e:
            problem[i] = f"{UNAVAILABLE} ({e})"
            continue
        if across:
            lo, hi = f.supports[across[0]]
            problem[i] = f"{UNAVAILABLE} ({f.name}: {lo:g}-{hi:g} nm crosses the detector join at {wl[edge[label[ends[across[0]][0]]] - 1]:g} nm)"
        elif not dense.any():
            problem[i] = f"{UNAVAILABLE} ({f.name}: no weight on the scan)"
        else:
            for s in np.unique(label[dense != 0]):
                rows.append(np.where(label == s, dense, 0.0))
                owner.append(i)
                where.append(int(s))
    if not rows:
        return [], problem
    w, owner, where = np.array(rows), np.array(owner), np.array(where)
    # moments about the middle of each row's own support: a second-derivative reading has neither a sum nor a slope
    used = w != 0
    middle = (used.argmax(1) + (len(wl) - 1 - used[:, ::-1].argmax(1))) / 2.0
    lever = w * (np.arange(len(wl))[None, :] - middle[:, None])
    bent = (np.abs(w.sum(1)) > MOMENT_TOL * np.abs(w).sum(1)) | (np.abs(lever.sum(1)) > MOMENT_TOL * np.abs(lever).sum(1))
    for i in np.unique(owner[bent]):
        problem[int(i)] = f"{readings[i][0].name} is not a second-derivative reading (the noise model does not apply)"
    w = _as_measured(w, where, wl, joins, list(operators), {} if blurs is None else blurs)
    if isinstance(w, str):
        return [], {**dict.fromkeys(range(len(readings)), w), **problem}
    out = []
    for nm in sorted({c for _, c in readings}):
        cov = _covariance(nm / (wl[1] - wl[0]))
        unit = _spread(np.array([[1.0, -2.0, 1.0]]), cov)[0]
        mine = np.array([readings[i][1] == nm and i not in problem for i in owner])
        out += [(int(i), int(s), 1e-5 * float(g) / unit) for i, s, g in zip(owner[mine], where[mine], _spread(w[mine], cov)) if g > 0]
    return out, problem


GAIN_TYPE = "map<string,struct<terms:array<struct<lo:double,hi:double,gain:double>>,base:double,reason:string>>"
_PART_TYPE = "_key string, reading string, plain boolean, gains array<struct<seg:int,gain:double>>, problem string"


def layout_key(n: Column, pick: str = "correction_id") -> Column:
    return F.concat_ws("|", F.col("wl_start").cast("string"), F.col("wl_step").cast("string"), n.cast("string"),
                       F.coalesce(F.col("joins_nm").cast("string"), F.lit("-")), F.coalesce(F.col(pick), F.lit("none")))


def noise_gains(df: DataFrame, requests: list[GainRequest], corrections: list[dict] = (), col: str = "r",
                pick: str = "correction_id", out: str = "gains", n: Column | None = None) -> DataFrame:
    """``out``: map reading -> (terms, gain as measured, reason), joined back from the distinct layouts."""
    n = F.size(F.col(col)) if n is None else n
    return attach_gains(df, gain_table(df, requests, corrections, n, pick, out), n, pick)


def attach_gains(df: DataFrame, table: DataFrame, n: Column, pick: str = "correction_id") -> DataFrame:
    """Join the gains back by layout. Spark broadcasts the table if its size in bytes allows; if not, most scans may share a
    layout, and the skew join of adaptive execution splits their partition."""
    return df.withColumn("_key", layout_key(n, pick)).join(table, "_key", "left").drop("_key")


def _plain(x: Column) -> Column:
    """A wavelength as it is written: without a trailing .0."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def _segments(n: Column) -> Column:
    """Detector segments [a, b) of a layout as channel numbers: a join belongs to the lower segment."""
    s, d = F.col("wl_start"), F.col("wl_step")
    inside = F.filter(F.coalesce("joins_nm", F.array().cast("array<double>")), lambda j: N.is_finite(j) & (j >= s) & (j < s + d * (n - 1)))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), n.cast("int")), F.transform(inside, lambda j: (F.floor((j + WL_TOL - s) / d) + 1).cast("int")))))
    return F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _holder(window: Column) -> Column:
    """Number of the segment that holds an N2 window with the neighbours its second differences read; null without one."""
    s, d, n, segs = F.col("wl_start"), F.col("wl_step"), F.col("_n"), F.col("segs")
    first, last = F.ceil((window["lo"] - s) / d), F.ceil((window["hi"] - s) / d) - 1
    hold = F.array_position(F.transform(segs, lambda g: (g["a"] <= first - 1) & (last + 1 < g["b"])), F.lit(True)) - 1
    return F.when((n >= 3) & (s < window["lo"]) & (s + d * (n - 1) >= window["hi"]) & (last >= first) & (hold >= 0), hold.cast("int"))


def gain_table(df: DataFrame, requests: list[GainRequest], corrections: list[dict], n: Column, pick: str = "correction_id",
               out: str = "gains") -> DataFrame:
    """(_key, gains): one row per distinct layout and correction.

    The numbers come from `reading_gains`, one matrix per layout; which window goes with which segment, and why a reading has
    no gain, are column rules on a row per layout and reading.
    """
    ops = {d["id"]: (d["operator"] if isinstance(d["operator"], list) else [d["operator"]]) for d in corrections}
    noise = {d["id"]: dict((d.get("provenance") or {}).get("instrument_noise") or {}) for d in corrections}
    keyed = df.withColumns({"_key": layout_key(n, pick), "_n": n})
    layouts = keyed.select("_key", "wl_start", "wl_step", "_n", "joins_nm", F.coalesce(F.col(pick), F.lit("none")).alias("_pick")).dropDuplicates(["_key"])
    fit = F.coalesce((F.col("wl_step") > 0) & (F.col("_n") >= 3), F.lit(False))
    known = (F.col("_pick") == "none") | F.col("_pick").isin(list(ops))

    def compute(frames):
        for pdf in frames:
            rows = []
            for key, start, step, size, joins, correction in pdf.itertuples(index=False):
                wl = wt.grid(float(start), float(step), int(size))
                joins = () if joins is None else tuple(map(float, joins))
                own, blurs = noise.get(correction, {}).get("correlation_nm"), {}
                for plain in (False, True):
                    nm = [(r.functional, r.correlation_nm if plain or own is None else float(own)) for r in requests]
                    got, problem = reading_gains(nm, wl, joins, () if plain else ops.get(correction, ()), blurs)
                    parts: dict[int, list] = {}
                    for i, s, g in got:
                        parts.setdefault(i, []).append({"seg": s, "gain": g})
                    rows += [(key, r.name, plain, parts.get(i, []), problem.get(i)) for i, r in enumerate(requests)]
            yield pd.DataFrame(rows, columns=["_key", "reading", "plain", "gains", "problem"])

    parts = layouts.where(fit & known).select("_key", "wl_start", "wl_step", "_n", "joins_nm", "_pick").mapInPandas(compute, _PART_TYPE)
    pairs = parts.groupBy("_key", "reading").agg(*(F.max_by(c, ~F.col("plain")).alias(c) for c in ("gains", "problem")), F.max_by("gains", "plain").alias("bare"))
    asked = [(r.name, r.mode, [(float(a), float(b)) for a, b in r.windows], float(r.factor),
              {c: float(f) for c, d in noise.items() if (f := (d.get("ch_envelope_factors") or {}).get(r.own_factors)) is not None}) for r in requests]
    asked = df.sparkSession.createDataFrame(asked, "reading string, mode string, windows array<struct<lo:double,hi:double>>, factor double, own map<string,double>")
    names = F.array(*[F.lit(r.name) for r in requests])
    every = layouts.withColumn("segs", F.when(fit, _segments(F.col("_n")))).withColumn("reading", F.explode(names))
    rows = every.join(pairs, ["_key", "reading"], "left").join(F.broadcast(asked), "reading")      # as many rows as readings
    window, reading, gains = F.get("windows", F.lit(0)), F.col("reading"), F.col("gains")
    held = _holder(window)
    of = lambda g, seg: F.get(F.filter(g, lambda x: x["seg"] == seg), F.lit(0))["gain"]
    term = lambda w, g: F.struct(w["lo"].alias("lo"), w["hi"].alias("hi"), g.alias("gain"))
    unavailable = lambda *what: F.concat(F.lit(f"{UNAVAILABLE} ("), reading, F.lit(": "), *what, F.lit(")"))
    matched = F.transform(gains, lambda g: F.struct(F.get(F.filter("windows", lambda w: _holder(w) == g["seg"]), F.lit(0)).alias("w"), g.alias("g")))
    alone = F.get(F.filter(matched, lambda x: x["w"].isNull()), F.lit(0))["g"]["seg"]
    nm = lambda i: _plain(F.col("wl_start") + F.col("wl_step") * i)
    covered = (F.col("wl_start") < window["lo"]) & (F.col("wl_start") + F.col("wl_step") * (F.col("_n") - 1) >= window["hi"])
    the_window = F.concat(_plain(window["lo"]), F.lit("-"), _plain(window["hi"]), F.lit(" nm"))
    pairing = F.col("mode") == "segments"
    reason = F.coalesce(
        F.when(~known, F.lit("unknown correction")),
        F.when(~fit, F.lit(f"{UNAVAILABLE} (the scan has fewer than 3 grid points)")),
        F.when(~pairing & held.isNull(), unavailable(F.lit("the N2 window "), the_window, F.when(covered, " is not inside one detector segment").otherwise(" is not covered by the scan"))),
        F.col("problem"),
        F.when(F.size(gains) == 0, unavailable(F.lit("no weight on the scan"))),
        F.when(pairing & alone.isNotNull(), unavailable(F.lit("no noise window in the detector segment "), nm(F.get("segs", alone)["a"]), F.lit("-"), nm(F.get("segs", alone)["b"] - 1), F.lit(" nm"))),
        F.when((F.col("mode") == "band") & (F.size(gains) != 1), unavailable(F.lit("its kernel spans more than one detector segment"))),
        F.when(~pairing & of(gains, held).isNull(), unavailable(F.lit("no weight in the detector segment of the N2 window "), the_window)))
    terms = F.when(pairing, F.transform(matched, lambda x: term(x["w"], x["g"]["gain"]))).otherwise(
        F.array(term(window, of(gains, held) * F.coalesce(F.element_at("own", F.col("_pick")), F.col("factor")))))
    rows = rows.select("_key", "reading", reason.alias("reason"), terms.alias("terms"), F.when((F.col("mode") == "term"), of(F.col("bare"), held) * F.col("factor")).alias("base"))
    good = F.col("reason").isNull()
    value = F.struct(F.when(good, F.col("terms")).alias("terms"), F.when(good, F.col("base")).alias("base"), "reason")
    return rows.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("reading", value))).cast(GAIN_TYPE).alias(out))


# ---------------------------------------------------------------------------------------------- what it means
def term_sd(name: str, n2: str = "n2", gains: str = "gains") -> Column:
    """Root sum of squares of gain x N2 over a reading's terms; null when any N2 is unknown or there is no gain."""
    terms = F.col(gains)[name]["terms"]
    win = lambda t: F.concat(t["lo"].cast("bigint").cast("string"), F.lit("-"), t["hi"].cast("bigint").cast("string"))
    squares = F.transform(terms, lambda t: F.pow(t["gain"] * N.finite(F.element_at(F.col(n2), win(t))), F.lit(2.0)))
    return F.when(F.size(terms) > 0, F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)))


def reading_sd(name: str, n2: str = "n2", gains: str = "gains") -> Column:
    """struct(sd, reason): reason says why there is no SD (null when there is one)."""
    why = F.col(gains)[name]["reason"]
    sd = term_sd(name, n2, gains)
    return F.struct(sd.alias("sd"), F.when(sd.isNull(), F.coalesce(why, F.lit(NOISE_UNKNOWN))).alias("reason"))


def model_requests(doc: dict, windows=tuple(N2_WINDOWS)) -> list[GainRequest]:
    try:
        return [GainRequest(f.name, f, tuple(windows), "segments") for _, f in fold_model(doc)]
    except NotLinear:
        return []


def implied_sd(df: DataFrame, docs: list[dict], factors: dict[str, float] | None = None, recorded: dict | None = None,
               no_b6=(), n2: str = "n2", gains: str = "gains", corrected: Column | None = None, out: str = "model_sd") -> DataFrame:
    """``out``: map model id -> struct(sd, component_sd, status, b6).

    A consensus SD is its factor times the median of its components' SDs. A model that cannot be folded has an SD only
    through recorded terms, and only for the scan as measured.
    """
    from lumenscan.operators.readings import median_of
    pairs, extra = [], []
    size = next((c for c in ("n_ch", "n") if c in df.columns), None)
    placed = bool(recorded) and size is not None and {"wl_start", "wl_step", "joins_nm"} <= set(df.columns)
    if placed:          # recorded terms hold for scans whose N2 windows lie inside one detector segment
        extra = [c for c in ("segs", "_n") if c not in df.columns]
        df = df.withColumn("_n", F.col(size)).withColumn("segs", _segments(F.col(size)))
    for doc in docs:
        comp = F.lit(None).cast("map<string,double>")
        if doc["id"] in (recorded or {}):
            terms = recorded[doc["id"]]
            sq = [F.pow(F.lit(float(t["gain"])) * N.finite(F.col(n2)[window_name(*t["window_nm"])]), F.lit(2.0)) for t in terms]
            total = sq[0]
            for x in sq[1:]:
                total = total + x
            fixed = F.coalesce(corrected, F.lit(False)) if corrected is not None else F.lit(False)
            lost = [F.when(_holder(F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))).isNull(), F.lit(f"{UNAVAILABLE} ({doc['id']}: no detector segment of the scan holds the N2 window {lo:g}-{hi:g} nm)"))
                    for lo, hi in (t["window_nm"] for t in terms)] if placed else []
            missing = F.coalesce(*lost, F.lit(None).cast("string"))
            sd = F.when(~fixed & missing.isNull(), F.sqrt(total))
            why = F.when(fixed, F.lit("non-linear model (its recorded gain holds for the scan as measured only)")).otherwise(F.coalesce(missing, F.lit(NOISE_UNKNOWN)))
        else:
            try:
                kind = ((doc.get("output") or {}).get("y_transform") or {}).get("type", "none")
                if kind != "none":      # an SD on the fitted scale is not one of the value
                    raise NotLinear(f"the response is fitted as {kind}")
                parts = fold_model(doc)
            except NotLinear as e:
                parts, why = [], F.lit(f"non-linear model ({e})")
                sd = F.lit(None).cast("double")
            if parts and doc["kind"] == "consensus":
                sds = {c: term_sd(f.name, n2, gains) for c, f in parts}
                comp = F.create_map(*[x for c, v in sds.items() for x in (F.lit(c), v)])
                factor = (factors or {}).get(doc["id"])
                reasons = F.coalesce(*[F.col(gains)[f.name]["reason"] for _, f in parts])
                if factor is None:
                    sd, why = F.lit(None).cast("double"), F.coalesce(reasons, F.lit("no noise factor for this consensus"))
                else:
                    sd, why = F.lit(float(factor)) * median_of(list(sds.values())), F.coalesce(reasons, F.lit(NOISE_UNKNOWN))
            elif parts:
                sd = term_sd(parts[0][1].name, n2, gains)
                why = F.coalesce(F.col(gains)[parts[0][1].name]["reason"], F.lit(NOISE_UNKNOWN))
        pairs += [F.lit(doc["id"]), F.struct(sd.alias("sd"), comp.alias("component_sd"),
                                             F.when(sd.isNotNull(), S.assessed()).otherwise(S.not_assessed(why)).alias("status"),
                                             F.lit(doc["id"] not in no_b6).alias("b6"))]
    return df.withColumn(out, F.create_map(*pairs)).drop(*extra)


def band_requests(bands: dict, kernel: dict = KERNEL_E31, correlation_nm: float = CORRELATION_NM) -> list[GainRequest]:
    """Gains of the plain band readings. A band's noise window is its own (``noise_window_nm``), else the window of
    its detector: 1500-1600 below 1800 nm, 2000-2100 above."""
    out = []
    for b, e in bands.items():
        lo, hi = e.get("noise_window_nm") or ((1500.0, 1600.0) if e["centre_nm"] <= 1800 else (2000.0, 2100.0))
        c, h = e["centre_nm"], e["half_width_nm"]
        out.append(GainRequest(f"sd:{b}", windows_functional(f"band {b}", kernel, [(c - h, c + h, 1.0)]),
                               ((float(lo), float(hi)),), "band", correlation_nm, float(e.get("envelope_factor", 1.0)), b))
    return out


def band_sd(df: DataFrame, bands: dict, out: str = "band_sd") -> DataFrame:
    """``out``: map band -> SD of its reading, with unknown noise as infinity (unreadable unless strong), and
    ``band_noise_unknown``: the bands whose noise is unknown."""
    sds = {b: term_sd(f"sd:{b}") for b in bands}
    pairs = [x for b, v in sds.items() for x in (F.lit(b), N.unknown_as_infinity(v))]
    unknown = F.array_compact(F.array(*[F.when(N.number(v).isNull(), F.lit(b)) for b, v in sorted(sds.items())]))
    return df.withColumns({out: F.create_map(*pairs), "band_noise_unknown": unknown})


def statistic_requests(rules: dict) -> list[GainRequest]:
    """The detector terms the noise policies read: sign gates, their fallbacks, the long-wave tail, the soft tier."""
    gate = rules["acquisition"]["B6b_signs_gate"]
    out = []

    def add(name, stat, window, corr):
        kernel = KERNELS[stat["kernel"]] if isinstance(stat["kernel"], str) else stat["kernel"]
        f = windows_functional(name, kernel, [(float(a), float(b), float(w)) for a, b, w in stat["windows"]])
        out.append(GainRequest(name, f, ((float(window[0]), float(window[1])),), "term", corr))
    for sign, e in gate["corrected"].items():
        if e is not None:
            add(f"gate:{sign}", gate["statistics"][e["statistic"]], e["n2_window_nm"], gate["correlation_nm"])
    for sign, e in gate["fallbacks"].items():
        add(f"fallback:{sign}", gate["statistics"][e["statistic"]], e["n2_window_nm"], gate["correlation_nm"])
    lw = rules["longwave"]
    add("longwave", lw["tail_statistic"], lw["n2_window_nm"], lw["correlation_nm"])
    soft = rules["signs"].get("soft_tier")
    if soft:
        add("soft", gate["statistics"]["c1"], soft["otherwise_n2_window_nm"], CORRELATION_NM)
    return out


def standard_like(requests: list[GainRequest], within: float, gains: str = "gains", pick: str = "correction_id") -> Column:
    """A correction that leaves every policy statistic's gain within a margin of its gain as measured."""
    near = []
    for r in requests:
        g = F.col(gains)[r.name]
        near.append(N.le(F.abs(F.try_divide(F.try_element_at(g["terms"], F.lit(1))["gain"], g["base"]) - 1.0), within))
    return F.col(pick).isNotNull() & (F.col(pick) != "none") & N.all_of(near)


def n2_windows_for(requests: list[GainRequest]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for w in [*N2_WINDOWS, *[w for r in requests for w in r.windows]]:
        if (float(w[0]), float(w[1])) not in out:
            out.append((float(w[0]), float(w[1])))
    return out
