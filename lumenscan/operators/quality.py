"""Acquisition quality: is this a supported, physically possible scan of the target?

Each check is a column expression on the scan's own row, so quality control is one narrow pass and unusable scans can
be split off before any heavier work.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenscan.functions import arrays as A
from lumenscan.functions import numeric as N
from lumenscan.functions import status as S
from lumenscan.operators.noise import n2, window_name
from lumenscan.operators.spectral import extrapolations, join_channels
from lumenscan.rulebook import ACQUISITION, N2_WINDOWS, WL_TOL

OUTCOME_RANK = ["Pass", "Note", "Check", "Unusable"]
NOT_SCORED = "reference scan (not scored)"


def _null(t: str) -> Column:
    return F.lit(None).cast(t)


# ---------------------------------------------------------------------------------------------- statistics
def range_stats(df: DataFrame, lo: float = 1000, hi: float = 2450, col: str = "r", out: str = "range") -> DataFrame:
    """Mean, population SD, minimum and maximum of R inside a range (non-finite results are null)."""
    x = A.covered(F.col(col), lo, hi)
    return df.withColumn(out, A.let(x, lambda v: A.let(A.mean_sd(v), lambda p: F.named_struct(
        F.lit("mean"), N.finite(p["mean"]), F.lit("sd"), N.finite(p["sd"]),
        F.lit("min"), N.finite(F.array_min(v)), F.lit("max"), N.finite(A.max_known(v)),
        F.lit("whole"), A.whole(v)))))


def range_stats_long(long: DataFrame, lo: float, hi: float, key: str = "scan_id") -> DataFrame:
    x = long.where(F.col("wl").between(lo - WL_TOL, hi + WL_TOL))
    return x.groupBy(key).agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.min("r").alias("min"), F.max("r").alias("max"))


def splice_steps(df: DataFrame, col: str = "r", n_lo: int = 5, n_hi: int = 6, out: str = "splice_steps") -> DataFrame:
    """Relative step at each of the two joins: |SWIR1 line extrapolated one channel - neighbour| / |R at the SWIR1
    edge|; null where it cannot be computed."""
    arr = F.col(col)

    def steps(j):
        i1, i2 = j["i1"], j["i2"]
        at = lambda i: F.when((i >= 0) & (i < F.size(arr)), F.try_element_at(arr, F.greatest(i, F.lit(0)) + 1))
        below, above = extrapolations(arr, i1, i2, n_lo, n_hi)
        return F.array(F.try_divide(F.abs(below - at(i1)), F.abs(at(i1 + 1))),
                       F.try_divide(F.abs(above - at(i2 + 1)), F.abs(at(i2))))
    return df.withColumn(out, F.transform(A.let(join_channels(F.col("joins_nm")), steps), N.finite))


def relative_steps(arr: Column) -> Column:
    """|x[k+1] - x[k]| / |x[k]| for k = 0 .. n-2; null where it is not finite."""
    n = F.greatest(F.size(arr) - 1, F.lit(0))
    return F.zip_with(F.slice(arr, 1, n), F.slice(arr, 2, n),
                      lambda a, b: N.finite(F.try_divide(F.abs(b - a), F.abs(a))))


def largest_step(df: DataFrame, lo: float, hi: float, col: str = "reference_dn", out: str = "largest_step") -> DataFrame:
    """struct(nm, step, median, n): the largest relative step inside a window (the first one on a tie), its position
    and the median step."""
    x = A.covered(F.col(col), lo, hi)
    first = F.greatest(F.ceil((F.lit(float(lo) - WL_TOL) - F.col("wl_start")) / F.col("wl_step")), F.lit(0).cast("bigint"))
    return df.withColumn(out, A.let(relative_steps(x), lambda s: F.struct(
        (F.col("wl_start") + (first + A.argmax(s)) * F.col("wl_step")).alias("nm"), F.array_max(s).alias("step"),
        A.median(s).alias("median"), F.size(F.filter(s, lambda v: v.isNotNull())).alias("n"))))


def largest_step_long(long: DataFrame, lo: float, hi: float, key: str = "scan_id") -> DataFrame:
    """The same over long-form spectra."""
    w = W.partitionBy(key).orderBy("ch")
    nxt = F.lead("r").over(w)
    inside = (F.col("wl") >= lo - WL_TOL) & (F.lead("wl").over(w) <= hi + WL_TOL)
    step = long.withColumn("_s", F.when(inside, F.try_divide(F.abs(nxt - F.col("r")), F.abs(F.col("r"))))).where("_s is not null")
    best = F.max_by(F.struct("wl", F.col("_s").alias("step")), F.struct(F.col("_s"), -F.col("wl")))
    return step.groupBy(key).agg(best.alias("b")).select(key, F.col("b.wl").alias("nm"), F.col("b.step").alias("step"))


# ---------------------------------------------------------------------------------------------- joins, kind
def joins_plausible(joins: Column, windows=ACQUISITION["input_matrix"]["join_windows_nm"]) -> Column:
    """One whole-nm join in each window."""
    ok = [N.ge(F.try_element_at(joins, F.lit(i + 1)), lo) & N.le(F.try_element_at(joins, F.lit(i + 1)), hi)
          & (F.try_element_at(joins, F.lit(i + 1)) == F.floor(F.try_element_at(joins, F.lit(i + 1)))) for i, (lo, hi) in enumerate(windows)]
    return F.coalesce((F.size(joins) == len(windows)) & N.all_of(ok), F.lit(False))


def joins_accepted(joins: Column, windows=ACQUISITION["input_matrix"]["join_windows_nm"]) -> Column:
    j = F.array_sort(joins)
    ok = [N.ge(F.try_element_at(j, F.lit(i + 1)), lo) & N.le(F.try_element_at(j, F.lit(i + 1)), hi) for i, (lo, hi) in enumerate(windows)]
    return F.coalesce((F.size(joins) == len(windows)) & N.all_of(ok), F.lit(False))


def resolve_joins(df: DataFrame, header: str = "splices_header_nm", reference: str = "reference_dn",
                  rules: dict = ACQUISITION) -> DataFrame:
    """``joins_nm`` and ``joins_source``: the header's joins when plausible, else the clear white-reference jumps,
    else the default pair."""
    windows = rules["input_matrix"]["join_windows_nm"]
    names = []
    for k, (lo, hi) in enumerate(windows):
        df = largest_step(df, lo, hi, reference, f"_step{k}")
        names.append(f"_step{k}")
    clear = N.all_of([F.coalesce((F.col(s)["n"] >= 3) & N.ge(F.col(s)["step"], F.col(s)["median"] * rules["join_jump_clear"])
                                 & N.ge(F.col(s)["step"], rules["join_jump_min"]), F.lit(False)) for s in names])
    found = F.col(reference).isNotNull() & clear
    plausible = joins_plausible(F.col(header), windows)
    return df.withColumns({
        "joins_nm": F.when(plausible, F.col(header)).when(found, F.array(*[F.col(s)["nm"] for s in names]))
        .otherwise(F.lit([float(j) for j in rules["default_joins_nm"]])),
        "joins_source": F.when(plausible, F.lit("header")).when(found, F.lit("reference_dn")).otherwise(F.lit("default")),
    }).drop(*names)


def join_warnings(df: DataFrame, reference: str = "reference_dn", half: int = 30, out: str = "join_warnings") -> DataFrame:
    """A warning for every header join that is not at the largest white-reference jump within +- ``half`` channels."""
    arr = F.col(reference)

    def warn(j):
        i = F.floor((j - F.col("wl_start") + WL_TOL) / F.col("wl_step")).cast("int")
        lo, hi = F.greatest(i - half, F.lit(0)), F.least(i + half, F.size(arr) - 2)
        steps = relative_steps(A.span(arr, lo, hi + 1))
        best = A.let(steps, lambda s: lo + A.argmax(s))
        wl = F.col("wl_start") + best * F.col("wl_step")
        return F.when((i >= 0) & best.isNotNull() & (best != i), F.concat(
            F.lit("splice mismatch: header join "), j.cast("string"),
            F.lit(" nm, largest white-reference DN jump after "), wl.cast("string"), F.lit(" nm")))
    return df.withColumn(out, F.array_compact(F.transform("joins_nm", warn)))


def classify_kind(df: DataFrame, sample: str = "sample_dn", reference: str = "reference_dn", out: str = "kind") -> DataFrame:
    """A white-reference save is a file whose sample block equals its white-reference block exactly. Brightness never
    decides, and dark saves are not inferred."""
    same = F.coalesce((F.size(sample) > 0) & (F.col(sample) == F.col(reference)), F.lit(False))
    return df.withColumn(out, F.when(same, F.lit("white_reference_save")).otherwise(F.lit("sample")))


def accept(df: DataFrame, rules: dict = ACQUISITION, out: str = "reject_reason") -> DataFrame:
    """``out``: the first reason a decoded file is not supported, or null."""
    m = rules["input_matrix"]
    magic, legacy = F.col("magic"), F.col("format") == "legacy"
    want = F.lit(None).cast("int")
    for k, v in m["data_type_by_magic"].items():
        want = F.when(magic == k, F.lit(v)).otherwise(want)
    g = m["grid"]
    lo, hi = m["reference_range_nm"]
    ref = A.covered(F.col("reference_dn"), lo, hi)
    bad_ref = F.exists(ref, lambda x: ~(N.is_finite(x) & N.gt(x, 0.0)))
    not_finite = lambda c: F.exists(F.col(c), lambda x: ~N.is_finite(x))
    fmt = F.col("data_format")
    off_grid = (F.col("channels") != g["n"]) | (F.abs(F.col("wl_start") - g["start_nm"]) > 1e-6) | (F.abs(F.col("wl_step") - g["step_nm"]) > 1e-6)
    reason = (F.when(~F.coalesce(magic.isin(*m["file_magic"]), F.lit(False)), F.concat(F.lit("unsupported: file version "), magic))
              .when(F.col("data_type") != want, F.when(legacy, F.lit("unsupported: not a reflectance file"))
                    .otherwise(F.lit("unsupported: not a raw (DN + white reference) file")))
              .when(F.when(legacy, ~fmt.isin(0, 2)).otherwise(fmt != 2), F.concat(F.lit("unsupported: data format "), fmt.cast("string")))
              .when(magic.isin(*m["require_dark_corrected_magic"]) & (F.col("dc_corr") == 0), F.lit("unsupported: dark correction flag not set"))
              .when(off_grid, F.lit("unsupported: wavelength grid"))
              .when(legacy & not_finite("stored_r"), F.lit("unsupported: non-finite reflectance values"))
              .when(~legacy & F.col("reference_dn").isNull(), F.lit("unsupported: no white-reference block"))
              .when(~legacy & bad_ref, F.lit("unsupported: white reference not finite and positive"))
              .when(~legacy & not_finite("sample_dn"), F.lit("unsupported: non-finite sample values"))
              .when(~joins_accepted(F.col("joins_nm"), m["join_windows_nm"]),
                    F.concat(F.lit("unsupported: detector joins "), F.to_json("joins_nm"))))
    return df.withColumn(out, reason)


def accept_spectrum(n: Column, rules: dict = ACQUISITION) -> Column:
    """The parts of the input matrix that apply to a spectrum without a file: grid and joins."""
    g = rules["input_matrix"]["grid"]
    grid_ok = F.coalesce((n == g["n"]) & (F.abs(F.col("wl_start") - g["start_nm"]) < 1e-6)
                         & (F.abs(F.col("wl_step") - g["step_nm"]) < 1e-6), F.lit(False))
    return (F.when(~grid_ok, F.lit("unsupported: wavelength grid"))
            .when(~joins_accepted(F.col("joins_nm"), rules["input_matrix"]["join_windows_nm"]),
                  F.concat(F.lit("unsupported: detector joins "), F.coalesce(F.to_json("joins_nm"), F.lit("[]")))))


# ---------------------------------------------------------------------------------------------- B2 - B8
def _check(st: Column, outcome: Column, **values: Column) -> Column:
    return F.struct(st.alias("status"), outcome.alias("outcome"), *[v.alias(k) for k, v in values.items()])


def acquisition(df: DataFrame, rules: dict = ACQUISITION, col: str = "r", dn: str | None = None, out: str = "acquisition") -> DataFrame:
    """Checks B2-B5, B7 and B8 on the scan as measured, one struct per check."""
    lo, hi = rules["integrity_range_nm"]
    arr = F.col(col)
    df = range_stats(df, lo, hi, col, "_rs")
    df = splice_steps(df, col, rules["B8_splice_step"]["fit_points_lower"], rules["B8_splice_step"]["fit_points_upper"], "_steps")
    if dn is None:
        no_dn = (F.when(F.col("format") == "legacy", F.lit("the file stores reflectance only")).otherwise(F.lit("no raw DN (spectrum input)"))
                 if "format" in df.columns else F.lit("no raw DN (spectrum input)"))
        b2 = _check(S.not_assessed(no_dn), _null("string"), max_dn=_null("double"))
    else:
        top = F.array_max(F.filter(A.covered(F.col(dn), lo, hi), lambda v: ~F.isnan(v)))
        why = (F.when(F.col("format") == "legacy", F.lit("the file stores reflectance only")).otherwise(F.lit("no raw DN (spectrum input)"))
               if "format" in df.columns else F.lit("no raw DN (spectrum input)"))
        have = F.col(dn).isNotNull()
        b2 = _check(F.when(have, S.assessed()).otherwise(S.not_assessed(why)),
                    F.when(have, F.when(N.ge(top, rules["B2_saturation"]["dn_at_least"]), F.lit("Unusable")).otherwise(F.lit("ok"))), max_dn=top)
    # any non-finite or non-positive value shows in the extremes: NaN and infinity are the largest values
    bad = ~(F.col("_rs.whole") & F.col("_rs.max").isNotNull() & N.gt(F.col("_rs.min"), rules["B3_impossible"]["r_at_most"]))
    b4 = rules["B4_panel_or_empty"]
    m, sd = F.col("_rs.mean"), F.col("_rs.sd")
    panel = N.ge(m, b4["panel_mean_range"][0]) & N.le(m, b4["panel_mean_range"][1]) & N.lt(sd, b4["panel_sd_below"])
    empty = N.lt(m, b4["empty_mean_below"])
    off = rules["B7_above_one"]["range_offsets_nm"]
    j = F.array_sort("joins_nm")
    swir1 = A.covered(arr, F.try_element_at(j, F.lit(1)) + off[0], F.try_element_at(j, F.lit(2)) + off[1])
    df = df.withColumn("_mx", A.let(A.max_known(swir1), N.finite))
    mx = F.col("_mx")
    b8 = rules["B8_splice_step"]
    worst = F.array_max(F.array_compact("_steps"))
    word = lambda c, name: F.when(c, F.lit(name)).otherwise(F.lit("ok"))
    return df.withColumn(out, F.struct(
        b2.alias("B2"),
        _check(S.assessed(), word(F.coalesce(bad, F.lit(True)), "Unusable")).alias("B3"),
        _check(S.assessed(), word(panel | empty, "Unusable"), mean_R=m, sd_R=sd,
               reason=F.when(panel, F.lit("white panel")).when(empty, F.lit("empty probe"))).alias("B4"),
        _check(S.assessed(), word(N.lt(m, rules["B5_dark"]["mean_R_below"]), "Note"), mean_R=m).alias("B5"),
        _check(S.assessed(), word(N.gt(mx, rules["B7_above_one"]["max_R_above"]), "Note"), max_R=mx).alias("B7"),
        _check(S.assessed(), F.when(N.gt(worst, b8["check_above"]), F.lit("Check")).when(N.gt(worst, b8["note_above"]), F.lit("Note"))
               .otherwise(F.lit("ok")), relative_steps=F.col("_steps")).alias("B8"),
    )).drop("_rs", "_steps", "_mx")


def unusable(acq: str = "acquisition") -> Column:
    """Names of the checks that make the scan unusable (empty array: usable)."""
    return F.array_compact(F.array(*[F.when(F.col(f"{acq}.{k}.outcome") == "Unusable", F.lit(k)) for k in ("B2", "B3", "B4")]))


# ---------------------------------------------------------------------------------------------- scan report
def saturated(arr: Column, segs: Column, dn_at_least: float, run: int = 3) -> Column:
    """One flag per channel: at or above the limit, or inside a run of at least three equal values at the positive
    maximum of its detector segment. A channel is in such a run exactly when one of the three-wide windows around it
    is all at that maximum."""
    if run != 3:
        raise ValueError("flat tops are runs of 3")

    def one(s):
        part = F.slice(arr, s["start"] + 1, s["end"] - s["start"])

        def flags(p):
            v, m = p["v"], p["m"]
            top = lambda k: F.coalesce(F.when(k >= 0, F.try_element_at(v, F.greatest(k, F.lit(0)) + 1)) == m, F.lit(False))
            in_run = lambda i: (top(i) & ((top(i - 1) & top(i - 2)) | (top(i - 1) & top(i + 1)) | (top(i + 1) & top(i + 2))))
            return F.transform(v, lambda x, i: N.ge(x, dn_at_least) | (N.finite_gt(m, 0.0) & in_run(i)))
        return A.let(F.struct(part.alias("v"), F.array_max(part).alias("m")), flags)
    return F.flatten(F.transform(segs, one))


def saturation_report(df: DataFrame, rules: dict = ACQUISITION, out: str = "saturation") -> DataFrame:
    """The scan report's saturation check, on the sample and the white reference together: Unusable inside the scored
    range, Note when only outside it."""
    lo, hi = rules["integrity_range_nm"]
    limit = rules["B2_saturation"]["dn_at_least"]
    df = df.withColumn("_segs", A.segments(F.col("joins_nm"), F.size("sample_dn")))
    flags = F.zip_with(saturated(F.col("sample_dn"), F.col("_segs"), limit), saturated(F.col("reference_dn"), F.col("_segs"), limit),
                       lambda a, b: a | b)
    df = df.withColumn("_flags", flags)
    wl = lambda i: F.col("wl_start") + i * F.col("wl_step")
    nm = F.filter(F.transform("_flags", lambda f, i: F.when(f, wl(i))), lambda v: v.isNotNull())
    df = df.withColumn("_nm", nm)
    inside = F.size(F.filter("_nm", lambda v: (v >= lo) & (v <= hi)))
    have = F.col("sample_dn").isNotNull() & F.col("reference_dn").isNotNull()
    result = _check(F.when(have, S.assessed()).otherwise(S.not_assessed("the file stores reflectance only (no raw DN)")),
                    F.when(have, F.when(inside > 0, F.lit("Unusable")).when(F.size("_nm") > 0, F.lit("Note")).otherwise(F.lit("Pass"))),
                    max_raw_dn=F.greatest(F.array_max("sample_dn"), F.array_max("reference_dn")),
                    saturated_channels=F.when(have, F.size("_nm")), saturated_scored=F.when(have, inside),
                    first_saturated_nm=F.when(have & (F.size("_nm") > 0), F.try_element_at("_nm", F.lit(1))))
    return df.withColumn(out, result).drop("_segs", "_flags", "_nm")


def flat_top_runs(long: DataFrame, key: str = "scan_id", value: str = "r", segment: str = "segment", at_least: int = 3) -> DataFrame:
    """Runs of equal consecutive maxima inside a detector segment, in long form (gaps and islands): (scan, segment,
    first_ch, last_ch, n). Partitions are scans' segments, bounded by the channel count."""
    top = long.withColumn("_m", F.max(value).over(W.partitionBy(key, segment))).where((F.col(value) == F.col("_m")) & (F.col("_m") > 0))
    island = F.col("ch") - F.row_number().over(W.partitionBy(key, segment).orderBy("ch"))
    return (top.withColumn("_i", island).groupBy(key, segment, "_i")
            .agg(F.min("ch").alias("first_ch"), F.max("ch").alias("last_ch"), F.count("*").alias("n"))
            .where(F.col("n") >= at_least).drop("_i"))


def worst_outcome(outcomes: list[Column]) -> Column:
    """The worst of some outcomes (Pass < Note < Check < Unusable); unassessed ones do not count."""
    rank = F.greatest(*[F.coalesce(F.array_position(F.lit(OUTCOME_RANK), F.initcap(F.when(o == "ok", F.lit("Pass")).otherwise(o))), F.lit(1).cast("bigint"))
                        for o in outcomes], F.lit(1).cast("bigint"))
    return F.element_at(F.lit(OUTCOME_RANK), rank.cast("int"))


def scan_report(df: DataFrame, rules: dict = ACQUISITION, col: str = "r") -> DataFrame:
    """One report row per scan: acceptance, kind, R summary, N2 windows, the nine checks in fixed order, the worst
    outcome and the warnings. Unreadable files (``reject_reason`` set) keep a row with B1 Unusable."""
    df = acquisition(saturation_report(n2(df, tuple(N2_WINDOWS), col)), rules, col)
    df = join_warnings(range_stats(df, *rules["integrity_range_nm"], col, "reflectance"))
    rejected, scored = F.col("reject_reason").isNotNull(), F.col("kind") == "sample"

    def row(cid, st, outcome):
        unread = S.not_assessed("the file could not be read (B1)")
        st = F.when(rejected, unread).when(~scored & (F.lit(cid) != "B2"), S.not_assessed(NOT_SCORED)).otherwise(st)
        oc = F.when(~rejected & (scored | (F.lit(cid) == "B2")), F.when(outcome == "ok", F.lit("Pass")).otherwise(outcome))
        return F.struct(F.lit(cid).alias("id"), st.alias("status"), oc.alias("outcome"))
    b = lambda k: F.col(f"acquisition.{k}")
    n2v = F.col("n2")[window_name(2000, 2100)]
    gate = rules["B6b_signs_gate"]["uncorrected_n2_above"]
    checks = F.array(
        F.struct(F.lit("B1").alias("id"), S.assessed().alias("status"), F.when(rejected, F.lit("Unusable")).otherwise(F.lit("Pass")).alias("outcome")),
        row("B2", F.col("saturation.status"), F.col("saturation.outcome")),
        row("B3", b("B3.status"), b("B3.outcome")), row("B4", b("B4.status"), b("B4.outcome")),
        row("B5", b("B5.status"), b("B5.outcome")),
        row("B6", S.not_assessed("the report loads no noise gains"), _null("string")),
        row("B6b", F.when(N.number(n2v).isNull(), S.not_assessed("N2(2000-2100) undefined")).otherwise(S.assessed()),
            F.when(N.number(n2v).isNull(), _null("string")).when(N.gt(n2v, gate), F.lit("Note")).otherwise(F.lit("Pass"))),
        row("B7", b("B7.status"), b("B7.outcome")), row("B8", b("B8.status"), b("B8.outcome")))
    df = df.withColumn("checks", checks)
    worst = worst_outcome([F.element_at("checks", i)["outcome"] for i in range(1, 10)])
    return df.withColumns({
        "acceptance": F.when(rejected, F.lit("rejected")).when(scored, F.lit("accepted")).otherwise(F.lit("not_scored")),
        "worst_outcome": worst, "segments": A.segments(F.col("joins_nm"), F.size(col))}).drop("acquisition", "saturation")
