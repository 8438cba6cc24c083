"""Verdicts, notes, flags and sort keys from the check results.

Every rule is one ordered ``when`` chain over structs already on the row, so the whole step is narrow. Notes are an
array of struct(key, params, provisional): the list of everything that applies is kept beside the few that are shown.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.functions import arrays as A
from lumenscan.functions import numeric as N
from lumenscan.functions.text import RULE_UNUSABLE, RULE_WORDS, note_base_key, word_map
from lumenscan.operators.matching import second_opinion_applies
from lumenscan.rulebook import PANEL_CONTRASTS, PROFILE_COLLAGEN

NOTE = "struct<key:string,params:map<string,string>,provisional:boolean>"
NOTES = f"array<{NOTE}>"
FLAG = "struct<key:string,signs:array<string>,provisional:boolean>"
RANK = {"Unlikely": 0, "Borderline": 1, "Good": 2}
CONTRAST = "struct<name:string,value:double,fires_above:double,fraction:double>"


def _text(x) -> Column:
    if isinstance(x, Column):
        return x.cast("string")
    return F.lit(None if x is None else str(x))


def note(key, provisional=None, **params) -> Column:
    kv = [v for k, p in params.items() for v in (F.lit(k), _text(p))]
    table = F.create_map(*kv) if kv else F.create_map().cast("map<string,string>")
    return F.struct((key if isinstance(key, Column) else F.lit(key)).alias("key"), table.alias("params"),
                    (F.lit(None) if provisional is None else F.when(provisional, F.lit(True))).cast("boolean").alias("provisional"))


def notes_array(items: list[tuple[Column, Column]]) -> Column:
    """The notes whose condition holds, in order."""
    return A.listed(items, NOTE)


def sign(n: str, field: str) -> Column:
    return F.col("C1")[field] if n == "C1" else F.col("signs")[n][field]


def sign_fired(n: str) -> Column:
    return F.coalesce(sign(n, "fired"), F.lit(False))


def fired_list(names: list[str]) -> Column:
    return A.listed([(sign_fired(n), F.lit(n)) for n in names], "string")


def model_value(specs: list[dict], key: str, models: str = "models") -> Column:
    """A profile model's reading by its key; null when the profile has no such model."""
    for s in specs:
        if s["key"] == key:
            return N.finite(F.col(models)[s["model_id"]]["value"])
    return F.lit(None).cast("double")


# ---------------------------------------------------------------------------------------------- model verdict
def model_verdict(m: Column, cuts: dict) -> Column:
    return (F.when(N.number(m).isNull(), F.lit(None).cast("string")).when(m < cuts["unlikely_below"], F.lit("Unlikely"))
            .when(m < cuts["good_from"], F.lit("Borderline")).otherwise(F.lit("Good")))


def models_disagree(components: Column, cuts: dict, min_span: float) -> Column:
    """All components read, in different verdict bands, and at least ``min_span`` apart."""
    v = F.map_values(components)
    whole = (F.size(v) > 0) & ~F.exists(v, lambda x: N.number(x).isNull())
    bands = F.size(F.array_distinct(F.transform(v, lambda x: model_verdict(x, cuts))))
    return F.coalesce(whole & (bands > 1) & ((F.array_max(v) - F.array_min(v)) >= min_span), F.lit(False))


# ---------------------------------------------------------------------------------------------- flags
def flags(profile: dict, provisional: Column | None = None) -> Column:
    """Contaminant and heat flags; marked provisional on an instrument without a correction."""
    f = profile["flags"]
    prov = (F.lit(None) if provisional is None else F.when(provisional, F.lit(True))).cast("boolean")
    make = lambda key, signs: (F.size(signs) > 0, F.struct(F.lit(key).alias("key"), signs.alias("signs"), prov.alias("provisional")))
    return A.listed([make("flag_contaminant", fired_list(f["contaminant"])), make("flag_burnt", fired_list(f["burnt"]))], FLAG)


def contaminant_state(profile: dict) -> dict[str, Column]:
    """Which contaminant signs were skipped and checked, and whether the contaminants count as unchecked."""
    names = profile["flags"]["contaminant"]
    state = lambda n: sign(n, "status")["state"]
    skipped = A.listed([(state(n) == "gated", F.lit(n)) for n in names], "string")
    checked = A.listed([((state(n) == "assessed") | (F.lit(n == "C1") & (state(n) == "skipped")), F.lit(n)) for n in names], "string")
    missing = N.any_of([F.coalesce(state(n) == "not assessed", F.lit(False)) for n in names if n != "C1"])
    c1_ok = F.coalesce(F.col("C1.status.state").isin("assessed", "skipped"), F.lit(False))
    unchecked = F.coalesce(F.col("b6b.gated"), F.lit(False)) | (F.size(skipped) > 0) | ~c1_ok | missing
    return {"skipped": skipped, "checked": checked, "unchecked": unchecked}


# ---------------------------------------------------------------------------------------------- notes
def common_notes(nt: dict, m: Column, provisional: Column) -> tuple[list, list]:
    """Notes of every analysis: (first, last)."""
    first, last = [], []
    if nt.get("above_bone_range_m_above") is not None:
        first.append((N.gt(m, nt["above_bone_range_m_above"]), note("above_bone_range", m=m)))
    first.append((F.col("soft.fired"), note("possible_thin_coating", provisional, components=F.array_join("soft.components", ","))))
    reason = lambda n: F.when(sign(n, "status")["state"] == "assessed", sign(n, "status")["reason"])
    last.append((F.coalesce(reason("C1").startswith("truncated"), F.lit(False)), note("c1_reduced")))
    red = A.listed([(reason(n).startswith("reduced"), F.lit(n)) for n in ("plaster", "C1")], "string")
    last.append((F.size(red) > 0, note("signs_reduced", signs=F.array_join(red, ","))))
    return first, last


def panel_columns(nt: dict, m: Column, components: Column, specs: list[dict]) -> dict[str, Column] | None:
    """C-H against N-H at two levels, and six reader contrasts against clean bone, by bins of the consensus.

    ``nt["panel"]``: readers {ch, narrow1545, raw2045 -> model key}, optional ``ch_above_nh`` (cons3_bin_edges,
    possible_above, strong_above), optional ``readers_disagree_strongly`` (cons3_bin_edges, level, min_gap, contrasts
    {name: {median, q98}}). The bin tables are dimensions of a few rows, so they become literals.
    """
    p = nt.get("panel")
    if not p:
        return None
    rd = {k: model_value(specs, v) for k, v in p["readers"].items()}
    ch, narrow, raw = rd.get("ch", F.lit(None).cast("double")), rd.get("narrow1545", F.lit(None).cast("double")), rd.get("raw2045", F.lit(None).cast("double"))
    out = {"ch": ch, "ch_gap": ch - m, "possible": F.lit(None).cast("double"), "strong": F.lit(None).cast("double")}
    level = F.lit(None).cast("string")
    if p.get("ch_above_nh"):
        c = p["ch_above_nh"]
        b = N.bin_index(m, c["cons3_bin_edges"])
        out["possible"], out["strong"] = N.pick_by_bin(b, c["possible_above"]), N.pick_by_bin(b, c["strong_above"])
        level = F.when(N.gt(out["ch_gap"], out["strong"]), F.lit("ch_above_nh_strong")).when(N.gt(out["ch_gap"], out["possible"]), F.lit("ch_above_nh_possible"))
    out["ch_note"] = level
    r = p.get("readers_disagree_strongly")
    if not r:
        return {**out, "contrasts": F.array().cast(f"array<{CONTRAST}>"), "fired": F.array().cast("array<string>")}
    comp = lambda k: components[k]
    parts = F.array(comp("wc2045"), comp("wc1500"), comp("F05"))
    spread = F.when(~F.exists(parts, lambda x: x.isNull()), F.array_max(parts) - F.array_min(parts))
    gaps = {"CH": ch - m, "CHN": m - ch, "GL": m - narrow, "SHP": comp("wc1500") - narrow, "SP3": spread, "RAW": F.abs(m - raw)}
    b = N.bin_index(m, r["cons3_bin_edges"])
    listed, fired = [], []
    for name in PANEL_CONTRASTS:
        sc = r["contrasts"].get(name)
        if sc is None:
            continue
        g, med, q = gaps[name], N.pick_by_bin(b, sc["median"]), N.pick_by_bin(b, sc["q98"])
        line = F.greatest(med + (q - med) * r["level"], F.lit(float(r.get("min_gap", 0.0))))
        listed.append(F.when(g.isNotNull(), F.struct(F.lit(name).alias("name"), g.alias("value"), line.alias("fires_above"),
                                                     F.try_divide(g - med, line - med).alias("fraction"))))
        hit = N.gt(F.try_divide(g - med, q - med), r["level"]) & N.gt(g, r.get("min_gap", 0.0))
        if name == "CH":
            hit = hit & level.isNull()
        fired.append(F.when(hit, F.lit(name)))
    return {**out, "contrasts": F.array_compact(F.array(*listed)), "fired": F.array_compact(F.array(*fired))}


def band_lit(b: str) -> Column:
    """A band lit and readable in the pattern check, or as its vote band."""
    own = F.col("pattern.bands")[b]
    vote = F.when(F.col("pattern.vote_band.id") == b, F.col("pattern.vote_band.lit") & F.col("pattern.vote_band.readable"))
    return F.coalesce(own["lit"] & own["readable"], vote, F.lit(False))


def band_line_notes(nt: dict, verdict: Column, step: Column, m: Column, specs: list[dict], contaminants: Column,
                    panel_keys: Column, bands_on: Column) -> list:
    """The band check's line where it ranks above the verdict, or the published model's line on an Unlikely verdict."""
    zb = nt.get("zooms_better")
    if not zb or not zb.get("enabled"):
        return []
    rank = word_map({k: str(v) for k, v in RANK.items()})
    zs = F.col("pattern.verdict")
    better = F.coalesce(F.element_at(rank, zs).cast("int") > F.element_at(rank, verdict).cast("int"), F.lit(False)) & bands_on
    quiet = (F.arrays_overlap(contaminants, F.lit(list(zb.get("suppressed_by_signs", [])) or [""]))
             | F.arrays_overlap(panel_keys, F.lit(list(zb.get("suppressed_by_notes", [])) or [""])))
    voted = F.col("pattern.pattern_verdict") != zs
    pr = zb.get("protein")
    lit = A.listed([(band_lit(b), F.lit(b)) for b in pr["n_type_bands"]], "string") if pr else F.array().cast("array<string>")
    firm = (N.ge(m, pr["m_at_least"]) & (F.size(lit) >= pr["n_type_lit_at_least"])) if pr else F.lit(True)
    key = (F.when(zs == "Good", F.lit("zooms_better_good"))
           .when(voted, F.when(step == "flat_bands_lead", F.lit("zooms_better_1545_flat")).otherwise(F.lit("zooms_better_1545")))
           .when(firm, F.lit("zooms_better_protein")))
    line = better & ~quiet & key.isNotNull()
    faint = better & ~quiet & key.isNull()
    out = [(line, note(key))]
    cut = zb.get("ryder_2045_at_least")
    if cut is not None:
        r = model_value(specs, zb["ryder_2045_model_key"])
        out.append((~quiet & ~line & (verdict == "Unlikely") & N.ge(r, cut), note("zooms_better_ryder", r=r, at_least=cut)))
    out.append((faint, note("zooms_faint_protein", lit=F.array_join(lit, ","), m=m)))
    return out


def _first_key(keys: Column, base: str, banned) -> Column:
    hits = F.filter(keys, lambda k: (note_base_key(k) == base) & (~k.isin(*banned) if banned else F.lit(True)))
    return F.try_element_at(hits, F.lit(1))


def shown_notes(notes: Column, nt: dict, lifted: Column) -> Column:
    """At most ``max_shown`` keys: the rule's note, the band line, one supporting note, then the quietest tier only if
    a slot is left and no band line shows. Warnings are added outside the limit."""
    warnings = nt.get("warnings", [])

    def build(keys):
        def first(names, banned=(), hidden=None):
            hits = []
            for p in names:
                one = _first_key(keys, p, banned)
                hits.append(F.when(~lifted, one) if hidden == p else one)
            return F.coalesce(*hits, F.lit(None).cast("string"))
        hide = "positive_signs" if nt.get("positive_signs_hidden_after_lift", True) else None
        rule, line = first(nt.get("precedence_rule", [])), first(nt.get("precedence_zooms", []))
        support = first(nt["precedence_supporting"], warnings, hide)
        slots = F.array_compact(F.array(rule, line, support))
        last = first(nt.get("precedence_last", []))
        shown = A.let(slots, lambda s: F.when(last.isNotNull() & (F.size(s) < nt["max_shown"]) & line.isNull(),
                                              F.concat(s, F.array(last))).otherwise(s))
        extra = A.listed([(F.array_contains(keys, w), F.lit(w)) for w in warnings], "string")
        return F.concat(F.slice(shown, 1, nt["max_shown"]), extra)
    return A.let(F.transform(notes, lambda n: n["key"]), build)


# ---------------------------------------------------------------------------------------------- verdicts
VERDICT_FIELDS = ["verdict", "rule_step", "model_verdict", "pattern", "notes_all", "notes_shown", "flags", "panel"]
PANEL = f"struct<ch:double,ch_gap:double,ch_possible_above:double,ch_strong_above:double,contrasts:array<{CONTRAST}>>"


def verdict_struct(verdict, rule_step, notes_all=None, notes_shown=None, flag_list=None, model=None, pattern=None, panel=None) -> Column:
    s = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    return F.struct(s(verdict).alias("verdict"), s(rule_step).alias("rule_step"), s(model).alias("model_verdict"), s(pattern).alias("pattern"),
                    (notes_all if notes_all is not None else F.array().cast(NOTES)).alias("notes_all"),
                    (notes_shown if notes_shown is not None else F.array().cast("array<string>")).alias("notes_shown"),
                    (flag_list if flag_list is not None else F.array().cast(f"array<{FLAG}>")).alias("flags"),
                    (panel if panel is not None else F.lit(None).cast(PANEL)).alias("panel"))


def collagen_verdict(df: DataFrame, profile: dict = PROFILE_COLLAGEN, m: str = "m", components: str = "components",
                     uncalibrated: str = "uncalibrated", out: str = "verdict") -> DataFrame:
    """Verdict of a collagen profile: the model's band, overruled by flat bands, lowered by +D, or lifted by bands on
    a scan whose contaminants were checked and clean."""
    specs = profile.get("models", [])
    mv, comps, unc = N.finite(F.col(m)), F.col(components), F.coalesce(F.col(uncalibrated), F.lit(False))
    cuts, fl, pd, lf, nt = (profile[k] for k in ("cuts", "flat_bands_lead", "plus_d", "lift", "notes"))
    level = F.col("evidence.level")
    zv = F.col("pattern.pattern_verdict")
    st = contaminant_state(profile)
    df = df.withColumn("_s", F.struct(
        model_verdict(mv, cuts).alias("V"), fired_list(profile["flags"]["contaminant"]).alias("contam"),
        *[st[k].alias(k) for k in ("skipped", "checked", "unchecked")]))
    V, contam, unchecked = F.col("_s.V"), F.col("_s.contam"), F.col("_s.unchecked")
    flat = F.lit(bool(fl["enabled"])) & ~unc & F.coalesce(level == fl["evidence_level"], F.lit(False))
    plus = F.lit(bool(pd["enabled"])) & ~unc & ~flat & F.coalesce(zv == pd["zooms_verdict"], F.lit(False)) & N.ge(mv, pd["m_at_least"])
    target = F.when(F.coalesce(zv == lf["requires_zooms_verdict"], F.lit(False)),
                    F.when(level.isin(*lf["to_good_levels"]), F.lit("Good"))
                    .when(level.isin(*lf["to_at_least_borderline_levels"]) & (V == "Unlikely"), F.lit("Borderline")).otherwise(V)).otherwise(V)
    would = ~unc & ~flat & ~plus & F.coalesce(target != V, F.lit(False))
    blockers = F.array_intersect(contam, F.lit(list(lf["blocked_by_signs"])))
    # exists, not the size of the list: with it Spark writes this step as short methods, which the JVM compiles
    blocked_c = would & F.exists(contam, lambda n: n.isin(*lf["blocked_by_signs"]))
    blocked_n = would & ~blocked_c & unchecked & F.lit(bool(lf["requires_contaminants_checked"]))
    lifted = would & ~blocked_c & ~blocked_n
    step = (F.when(flat, F.lit("flat_bands_lead")).when(plus, F.lit("plus_d"))
            .when(lifted, F.when(target == "Good", F.lit("lift_good")).otherwise(F.lit("lift_borderline")))
            .when(would, F.lit("lift_blocked")).otherwise(F.lit("model_verdict")))
    verdict = F.when(flat, F.lit(fl["verdict"])).when(plus, F.lit(pd["verdict"])).when(lifted, target).otherwise(V)
    unread = lambda word, known: F.when(V.isNull(), F.lit(word)).otherwise(known)
    df = df.withColumn("_d", F.struct(unread("Can't tell", verdict).alias("v"), unread("no_model_reading", step).alias("step"), lifted.alias("lifted"), blocked_c.alias("bc"),
                                      blocked_n.alias("bn"), blockers.alias("blockers"), flat.alias("flat"), plus.alias("plus")))
    d = lambda k: F.col("_d")[k]
    panel = panel_columns(nt, mv, comps, specs)
    if panel is None:
        panel_notes, strong, panel_rec = [], F.lit(False), None
    else:
        df = df.withColumn("_p", F.struct(*[v.alias(k) for k, v in panel.items()]))
        pc = lambda k: F.col("_p")[k]
        strong = F.size(pc("fired")) > 0
        panel_notes = [(pc("ch_note").isNotNull(), note(pc("ch_note"), ch=pc("ch"), m=mv)),
                       (strong, note("readers_disagree_strongly", contrasts=F.array_join(pc("fired"), ","), m=mv))]
        panel_rec = F.struct(pc("ch").alias("ch"), pc("ch_gap").alias("ch_gap"), pc("possible").alias("ch_possible_above"),
                             pc("strong").alias("ch_strong_above"), pc("contrasts").alias("contrasts"))
    panel_keys = F.array_distinct(F.transform(notes_array(panel_notes), lambda n: note_base_key(n["key"])))
    first, last = common_notes(nt, mv, unc)
    promising = d("v").isin("Good", "Borderline")
    ps = nt["positive_signs"]
    encouraging = (promising & (F.size(contam) == 0) & ~unchecked & ~F.coalesce(F.col("soft.fired"), F.lit(False)) & ~unc
                   & ~F.arrays_overlap(panel_keys, F.lit(list(ps.get("suppressed_by_notes", [])) or [""])))
    all_six = F.coalesce(zv == ps["all_six_zooms_verdict"], F.lit(False))
    comp_params = {k: comps[k] for k in ("wc2045", "wc1500", "F05")}
    items = [
        (d("flat"), note("flat_bands_lead", m=mv)), (d("plus"), note("plus_d", m=mv)), (d("lifted"), note(d("step"), m=mv, level=level)),
        (d("bc"), note("lift_blocked_contaminant", m=mv, level=level, signs=F.array_join(d("blockers"), ","))),
        (d("bn"), note("lift_blocked_noisy", m=mv, level=level)),
        *band_line_notes(nt, d("v"), d("step"), mv, specs, contam, panel_keys, ~unc), *first, *panel_notes,
        (promising & unchecked, note("contaminants_not_checked", skipped=F.array_join("_s.skipped", ","), checked=F.array_join("_s.checked", ","))),
        (~strong & models_disagree(comps, cuts, nt["models_disagree_min_span"]), note("models_disagree", **comp_params)),
        (encouraging & all_six, note("positive_signs_all_six")),
        (encouraging & ~all_six & level.isin(*ps["clear_levels"]) & N.ge(mv, ps["clear_min_m"]), note("positive_signs_clear")),
        (~unc & (level == nt["bands_too_noisy_level"]), note("bands_too_noisy")), *last]
    df = df.withColumns({"_n": F.when(V.isNull(), notes_array([(F.lit(True), note("no_model_reading"))])).otherwise(notes_array(items)), "_f": flags(profile, unc)})
    # No choice between whole structs, and fields that stand in columns before: else Spark computes every field, whichever are read later
    shown = F.when(V.isNull(), F.array().cast("array<string>")).otherwise(shown_notes(F.col("_n"), nt, d("lifted")))
    result = verdict_struct(d("v"), d("step"), F.col("_n"), shown, F.col("_f"), V, panel=None if panel_rec is None else F.when(V.isNotNull(), panel_rec))
    return df.withColumn(out, result).drop("_s", "_d", "_n", "_f", "_p")


def pattern_verdict(df: DataFrame, profile: dict, m: str = "m", uncalibrated: str = "uncalibrated", out: str = "verdict") -> DataFrame:
    """Verdict of a band-pattern profile."""
    unc = F.coalesce(F.col(uncalibrated), F.lit(False))
    notes = F.array().cast(NOTES)
    shown = F.array().cast("array<string>")
    if profile.get("notes"):
        first, last = common_notes(profile["notes"], N.finite(F.col(m)), unc)
        df = df.withColumn("_n", notes_array(first + last))
        notes, shown = F.col("_n"), shown_notes(F.col("_n"), profile["notes"], F.lit(False))
    return df.withColumn(out, verdict_struct(
        F.when(unc, F.lit("Can't tell")).otherwise(F.col("pattern.verdict")),
        F.when(unc, F.lit("band_evidence_not_built_in")).otherwise(F.lit("zooms_pattern")), notes, shown, flags(profile, unc),
        pattern=F.when(~unc, F.col("pattern.pattern")))).drop("_n")


def override_verdict(df: DataFrame, profile: dict, verdict: str = "verdict", uncalibrated: str = "uncalibrated") -> DataFrame:
    """A target that does not look like bone replaces the verdict (its flags stay)."""
    v = F.col(verdict)
    not_bone = F.coalesce(F.col("b9.outcome") == "fail", F.lit(False))
    return df.withColumn(verdict, F.when(not_bone, verdict_struct("Doesn't look like bone", "B9", flag_list=flags(
        profile, F.coalesce(F.col(uncalibrated), F.lit(False))))).otherwise(v))


def rejected_verdict(reason: Column, checks: Column, listed_only: Column | None = None) -> Column:
    """Verdict of a scan that is not scored: unsupported or rejected input or a saved reference (B1), or unusable by its checks."""
    listed = F.lit(False) if listed_only is None else listed_only
    return (F.when(reason.startswith("unsupported"), verdict_struct("Unsupported", "B1")).when(listed, verdict_struct("Not scored", "B1"))
            .when(reason.isNotNull(), verdict_struct("Rescan", "B1"))
            .otherwise(verdict_struct("Rescan", F.array_join(checks, "+"))))


def second_opinion(df: DataFrame, profile: dict, value: Column, m: str = "m", native: str = "native", gap: Column | None = None,
                   uncalibrated: str = "uncalibrated", verdict: str = "verdict") -> DataFrame:
    """Add the note that a second reader, on a non-native stream, differs by more than the allowed gap."""
    so = profile.get("second_opinion")
    if not so:
        return df
    limit = F.coalesce(gap, F.lit(float(so["gap_points"]))) if gap is not None else F.lit(float(so["gap_points"]))
    v = F.col(verdict)
    fire = (second_opinion_applies(so, F.col(native), F.col("class")) & ~F.coalesce(F.col(uncalibrated), F.lit(False))
            & (v["rule_step"] != "B9") & N.gt(F.abs(value - F.col(m)), limit))
    extra = notes_array([(fire, note("second_opinion_differs", s1=value, m=F.col(m)))])
    return df.withColumn(verdict, F.struct(*[(F.concat(v["notes_all"], extra) if k == "notes_all" else v[k]).alias(k) for k in VERDICT_FIELDS]))


def instrument_notes(df: DataFrame, out: str = "instrument_notes") -> DataFrame:
    """Serial listed under another class, no correction installed, visible levels not fitted, band noise unknown."""
    has = lambda c: c in df.columns
    items = []
    if has("serial_class"):
        items.append((F.col("serial_class").isNotNull() & (F.col("serial_class") != F.col("class")),
                      note("serial_class_mismatch", serial_class=F.col("serial_class"))))
    if has("uncalibrated"):
        items.append((F.col("uncalibrated"), note("instrument_uncalibrated", **{"class": F.col("class")})))
    if has("band_noise_unknown"):
        items.append((F.size("band_noise_unknown") > 0, note("band_noise_unknown", bands=F.array_join("band_noise_unknown", ","))))
    if has("visible_levels_fitted"):
        items.append((~F.col("visible_levels_fitted"), note("visible_levels_not_fitted")))
    return df.withColumn(out, notes_array(items))


# ---------------------------------------------------------------------------------------------- sorting
def sort_key(df: DataFrame, profile: dict, verdict: str = "verdict", m: str = "m", S: Column | None = None) -> DataFrame:
    """``sort_group``, ``sort_value`` and ``sort_penalty`` of a verdict; an unknown verdict goes last."""
    s = profile["sort"]
    order = s["verdict_order"]
    v = F.col(verdict)["verdict"]
    group = F.coalesce(F.nullif(F.array_position(F.lit(order), v), F.lit(0)) - 1, F.lit(len(order))).cast("int")
    S = F.col("evidence.S") if S is None else S
    value = F.lit(None).cast("double")
    for name, by in s["within"].items():
        value = F.when(v == name, F.col(m) if by == "m" else S).otherwise(value)
    signs = s.get("penalty_signs")
    if signs is None:
        penalty = F.lit(None).cast("int")
    else:
        unknown = [x for x in signs if x not in profile["flags"]["contaminant"]]
        if unknown:
            raise ValueError(f"sort.penalty_signs: {unknown} not among the profile's contaminant flag signs")
        penalty = F.exists(F.col(verdict)["flags"], lambda f: F.arrays_overlap(f["signs"], F.lit(list(signs)))).cast("int")
    return df.withColumns({"sort_group": group, "sort_value": value, "sort_penalty": penalty})


# ---------------------------------------------------------------------------------------------- explanations
def explain_verdict(df: DataFrame, m: str = "m", components: str = "components", sd: str = "m_sd", verdict: str = "verdict",
                    out: str = "explanation") -> DataFrame:
    """How a verdict was made: the rule's key and the rule in words, the component readings with their middle and spread, the C-H gap
    against its two lines, the contrast nearest its own line, and the reading's noise SD."""
    v, comps = F.col(verdict), F.col(components)
    vals = F.map_values(comps)
    whole = F.coalesce((F.size(vals) > 0) & ~F.exists(vals, lambda x: ~N.is_finite(x)), F.lit(False))
    others = F.filter(v["panel"]["contrasts"], lambda c: (c["name"] != "CH") & N.is_finite(c["fraction"]))
    nearest = F.try_element_at(F.array_sort(others, lambda a, b: F.when(a["fraction"] > b["fraction"], -1)
                                            .when(a["fraction"] < b["fraction"], 1).otherwise(0)), F.lit(1))
    gap_known = v["panel"]["ch_gap"].isNotNull() & v["panel"]["ch_possible_above"].isNotNull()
    return df.withColumn(out, F.struct(
        v["rule_step"].alias("rule_key"),
        F.coalesce(F.element_at(word_map(RULE_WORDS), v["rule_step"]), F.lit(RULE_UNUSABLE)).alias("rule"),
        F.when(whole, comps).alias("components"), F.when(whole, A.median(vals)).alias("middle"),
        F.when(whole, F.array_max(vals) - F.array_min(vals)).alias("spread"),
        F.when(gap_known, F.struct(v["panel"]["ch_gap"].alias("gap"), v["panel"]["ch_possible_above"].alias("possible_above"),
                                   v["panel"]["ch_strong_above"].alias("likely_above"))).alias("ch_gap"),
        nearest.alias("nearest_contrast"), N.finite(F.col(sd)).alias("noise_sd")))


ROW = "struct<icon:string,title:string,notice:boolean>"


def check_rows(df: DataFrame, verdict: str = "verdict", b6: Column | None = None, sd: Column | None = None, out: str = "check_rows") -> DataFrame:
    """The checks list of one scan: what is fine, what is noisy, what was flagged and what could not be checked."""
    v = F.col(verdict)
    rescan = v["verdict"] == "Rescan"
    known = ["plaster", "wax", "ester", "C1"]
    state = lambda n: sign(n, "status")["state"]
    lost = A.listed([(state(n).isin("gated", "not assessed"), F.lit(n)) for n in known], "string")
    any_fired = N.any_of([sign_fired(n) for n in [*known, "burnt"]])
    heat_lost = F.coalesce(state("burnt").isin("gated", "not assessed"), F.lit(False))
    noisy = F.coalesce(F.col("b6b.outcome") == "Note", F.lit(False))
    b6_out = b6["outcome"] if b6 is not None else F.lit(None).cast("string")
    b6_off = (b6["status"]["state"] != "assessed") if b6 is not None else F.lit(False)
    near = F.coalesce(b6_out == "Check", F.lit(False))
    row = lambda icon, title, notice: F.struct(F.lit(icon).alias("icon"), (title if isinstance(title, Column) else F.lit(title)).alias("title"), F.lit(notice).alias("notice"))
    acq = lambda k: F.col(f"acquisition.{k}.outcome")
    quiet = ~noisy & ~near & ~F.coalesce(b6_off, F.lit(False))
    loud = N.gt(sd, 0.5) if sd is not None else F.lit(False)
    items = [
        (rescan, row("noise", "Scan quality", True)), (~rescan & noisy, row("noise", "Noisy scan", True)),
        (~rescan & near, row("noise", "Noise could change the verdict", True)),
        (~rescan & ~near & ~noisy & F.coalesce(b6_off, F.lit(False)), row("info", "Scan quality", False)),
        (~rescan & quiet & loud, row("info", "Scan quality", False)), (~rescan & quiet & ~loud, row("ok", "Scan quality", False)),
        *[(sign_fired(n), row("flag", t, True)) for n, t in (("plaster", "Plaster sign"), ("wax", "Lipid sign"), ("ester", "Consolidant sign"),
                                                             ("burnt", "Heat sign"), ("C1", "Foreign-organic sign"))],
        (~rescan & (F.size(lost) > 0), row("info", F.when(F.size(lost) == len(known), F.lit("Contaminant signs not checked"))
                                           .otherwise(F.lit("Some contaminant signs not checked")), True)),
        (~rescan & (F.size(lost) == 0) & ~any_fired, row("ok", F.when(heat_lost, F.lit("No contaminant signs")).otherwise(F.lit("No contaminant or heat signs")), False)),
        (~rescan & heat_lost, row("info", "Heat sign not checked", True)),
        (~rescan & (F.col("b9.status.state") == "assessed") & (v["rule_step"] == "B9"), row("info", "Does not look like bone", True)),
        (~rescan & (F.col("b9.status.state") == "assessed") & (v["rule_step"] != "B9"), row("ok", "Looks like bone", False)),
        (F.coalesce(F.col("longwave.tail_unreliable") | F.col("longwave.tail_unreliable_c1"), F.lit(False)), row("info", "Long-wave region not used", True)),
        (acq("B8") != "ok", row("info", "Detector join step", True)), (acq("B7") == "Note", row("info", "Brighter than the white reference", True)),
        (acq("B5") == "Note", row("info", "Very dark spot", True))]
    return df.withColumn(out, A.listed(items, ROW))


def model_annotations(status: Column, domain_ratio: Column, b6_outcome: Column, sd: Column, ratio_above: float = 3.0) -> Column:
    """What must stand beside a model's number: why it is missing, an unfamiliar spectrum, noise near a cut."""
    why = F.when(status["state"] != "assessed", F.concat(F.lit("Not assessed: "), status["reason"])).otherwise(
        F.concat(F.upper(F.substring(status["reason"], 1, 1)), F.substr(status["reason"], F.lit(2))))
    pts = F.when(N.is_finite(sd), F.format_string(" (noise SD ≈ %.1f points)", sd)).otherwise(F.lit(""))
    items = [(why.isNotNull(), "assessment", why), (N.gt(domain_ratio, ratio_above), "domain", F.lit("less familiar spectrum")),
             (b6_outcome == "Check", "noise", F.concat(F.lit("Noise could carry this reading across a verdict cut"), pts, F.lit(".")))]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("kind"), t.alias("text"))) for c, k, t in items]))


def place_notes(df: DataFrame, nt: dict, verdict: str = "verdict", out: str = "placed") -> DataFrame:
    """Headline, warnings and remaining details, without losing or repeating a note."""
    v = F.col(verdict)
    warn = F.lit(list(nt.get("warnings", [])) or [""])
    keys = v["notes_all"]["key"]        # not transform: the notes, their list included, would be interpreted for every warning
    head = F.array_except(v["notes_shown"], warn)
    warnings = A.listed([(F.array_contains(keys, w), F.lit(w)) for w in nt.get("warnings", [])], "string")
    return df.withColumn(out, F.struct(
        head.alias("headline"), warnings.alias("warnings"),
        F.filter(v["notes_all"], lambda n: ~F.array_contains(head, n["key"]) & ~F.array_contains(warnings, n["key"])).alias("details")))


def card_items(df: DataFrame, words: dict[str, str], flag_words: dict[str, str], verdict: str = "verdict", placed: str = "placed", out: str = "card") -> DataFrame:
    """Labels of a verdict card in reading order: flags, warnings, then the headline notes."""
    flags = F.col(verdict)["flags"]     # read twice, so Spark makes the list before, by compiled code, and not within transform
    sign_labels = F.flatten(F.transform(flags, lambda f: F.transform(f["signs"], lambda s: F.concat(
        F.coalesce(F.element_at(word_map(flag_words), s), s), F.when(f["provisional"], F.lit(" (provisional)")).otherwise(F.lit(""))))))
    label = lambda k: F.coalesce(F.element_at(word_map(words), k), k)
    return df.withColumn(out, F.struct(
        F.concat(F.when(F.size(flags) == 0, F.array().cast("array<string>")).otherwise(sign_labels), F.transform(F.col(placed)["warnings"], label)).alias("alerts"),
        F.transform(F.col(placed)["headline"], label).alias("notes")))


# Result names in the public record.
VERDICT_KEYS = {"Good": "good", "Borderline": "borderline", "Unlikely": "unlikely", "Can't tell": "cant_tell", "Doesn't look like bone": "not_bone"}
RULE_KEYS = {"model_verdict": "model", "flat_bands_lead": "flat_bands", "plus_d": "plus_d", "lift_good": "lift_good",
             "lift_borderline": "lift_borderline", "lift_blocked": "lift_blocked", "zooms_pattern": "zooms_pattern", "B9": "not_bone",
             "no_model_reading": "no_model_reading"}
NOTE_KEYS = {"flat_bands_lead": "flat_bands", "lift_blocked_contaminant": "lift_blocked", "lift_blocked_noisy": "lift_blocked"}


def to_results(df: DataFrame, verdict: str = "verdict", keep: list[str] = ("scan_id",)) -> DataFrame:
    """The public result shape: mapped verdict, rule and note keys, level, statuses beside their values."""
    v = F.col(verdict)
    key = lambda table, c, other: F.coalesce(F.element_at(word_map(table), c), other if isinstance(other, Column) else F.lit(other))
    return df.select(
        *keep, key(VERDICT_KEYS, v["verdict"], "rescan").alias("verdict"), key(RULE_KEYS, v["rule_step"], "unusable").alias("verdict_rule"),
        F.transform(v["notes_all"], lambda n: F.struct(key(NOTE_KEYS, n["key"], n["key"]).alias("key"), n["params"].alias("params"))).alias("notes"),
        F.transform(v["notes_shown"], lambda k: key(NOTE_KEYS, k, k)).alias("notes_shown"),
        F.regexp_replace(F.coalesce(F.col("evidence.level"), F.lit("can't tell")), "can't tell", "cant_tell").alias("level"),
        F.col("evidence.status").alias("evidence_status"), F.col("evidence.S").alias("score"), F.col("pattern.pattern").alias("pattern"),
        key(VERDICT_KEYS, F.col("pattern.verdict"), "cant_tell").alias("pattern_verdict"), F.col("signs"), F.col("C1").alias("c1"),
        *[F.col(c) for c in ("sort_group", "sort_value", "sort_penalty") if c in df.columns])


def band_counts(df: DataFrame, evidence: str = "evidence", out: str = "band_counts") -> DataFrame:
    """Lit, total and too-noisy bands of a scan."""
    states = F.transform(F.map_values(F.col(f"{evidence}.bands")), lambda b: b["state"])
    count = lambda *names: F.size(F.filter(states, lambda s: s.isin(*names)))
    return df.withColumn(out, F.struct(count("faint", "trace", "clear", "strong").alias("lit"), F.size(states).alias("total"),
                                       count("can't tell").alias("noisy")))
