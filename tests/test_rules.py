"""Truth tables of the rules on hand-made readings."""
import math

import pytest
from pyspark.sql import functions as F

from lumenscan.functions import text as X
from lumenscan.operators import checks as K
from lumenscan.operators import verdict as V
from lumenscan.rulebook import BANDS, PROFILE_COLLAGEN, PROFILE_ZOOMS, RULES
from conftest import by_id

SEVEN = list(BANDS)


def band_rows(spark, cases):
    """cases: name -> (u per band, sd_u per band, guard)."""
    rows = []
    for k, (u, sd, guard) in cases.items():
        e = {f"E:{b}": u.get(b, 0.0) * BANDS[b]["weight"] * BANDS[b]["u_sign"] for b in SEVEN}
        e["guard"] = guard
        rows.append((k, e, {b: sd.get(b, 0.01) * BANDS[b]["weight"] for b in SEVEN}))
    return spark.createDataFrame(rows, "scan_id string, readings map<string,double>, band_sd map<string,double>")


ALL = lambda v: {b: v for b in SEVEN}


def test_evidence_levels(spark):
    cases = {
        "strong": (ALL(5.0), {}, 9.0), "clear": (ALL(2.0), {}, 9.0), "trace": ({**ALL(-1.0), "CH1728": 0.8}, {}, 0.5), "none": (ALL(-1.0), {}, 0.5), "guard": (ALL(-1.0), {}, 2.0),
        "noisy": (ALL(0.0), ALL(0.3), 0.5), "noisy_but_high": (ALL(2.0), ALL(0.3), 9.0), "unknown_noise": (ALL(1.0), ALL(math.inf), 0.5), "nh_flat": ({**ALL(5.0), "AM2175": 0.5, "NH2044": 0.5}, {}, 9.0),
        "one_unreadable": ({**ALL(5.0), "CH1689": 0.2}, {"CH1689": 0.5}, 9.0), "nan": ({**ALL(1.0), "CH1728": math.nan}, {}, 0.5), "n_h_lit": ({**ALL(-1.0), "NH2044": 0.2}, {}, 0.5)}
    d = K.check_evidence(band_rows(spark, cases))
    got = by_id(d, "evidence")
    want = {"strong": "strong", "clear": "clear", "trace": "trace", "none": "none", "guard": "trace", "noisy": "can't tell", "noisy_but_high": "clear", "unknown_noise": "can't tell", "nh_flat": "trace",
            "one_unreadable": "strong", "nan": None, "n_h_lit": "trace"}
    assert {k: got[k].level for k in want} == want
    assert got["nan"].status.state == "not assessed" and got["nan"].S is None
    assert got["one_unreadable"].n_readable_core == 4 and got["strong"].n_lit_core == 5 and got["strong"].S == pytest.approx(5.0)
    assert got["unknown_noise"].bands["CH1728"].sd_u is None


def test_band_pattern(spark):
    six = ["NH2044", "AM2175", "CH1689", "CH1728", "CH2262", "CH2284"]
    on = lambda *names: {b: (3.0 if b in names else -1.0) for b in SEVEN}
    cases = {"A": (on(), {}, 0.0), "B": (on("CH1728"), {}, 0.0), "C": (on("NH2044"), {}, 0.0), "D": (on("NH2044", "AM2175"), {}, 0.0), "E": (on(*six), {}, 0.0), "vote": (on("NH1545c"), {}, 0.0),
             "protein_noisy": (on(), {"NH2044": 0.5}, 0.0), "ch_noisy": (on("NH2044", "AM2175"), {b: 0.5 for b in ("CH1689", "CH1728", "CH2262", "CH2284")}, 0.0), "nan": ({**on(), "CH2284": math.nan}, {}, 0.0)}
    got = by_id(K.check_pattern(band_rows(spark, cases)), "pattern")
    assert {k: (got[k].pattern, got[k].pattern_verdict, got[k].verdict) for k in cases} == {
        "A": ("A", "Unlikely", "Unlikely"), "B": ("B", "Unlikely", "Unlikely"), "C": ("C", "Borderline", "Borderline"), "D": ("D", "Borderline", "Borderline"), "E": ("E", "Good", "Good"),
        "vote": ("A", "Unlikely", "Borderline"), "protein_noisy": ("A", "Can't tell", "Can't tell"), "ch_noisy": ("D", "Can't tell", "Can't tell"), "nan": (None, "Can't tell", "Can't tell")}
    assert got["vote"].vote_1545 and got["vote"].vote_band.lit
    off = K.bands_off(K.check_pattern(K.check_evidence(band_rows(spark, {"x": (ALL(5.0), {}, 9.0)}))).withColumn("uncalibrated", F.lit(True)))
    r = by_id(off, "evidence", "pattern")["x"]
    assert r[0].level is None and r[1].verdict is None and r[0].S is not None and r[0].status.reason == "band evidence needs this instrument built in"


SIGN = "struct<status:struct<state:string,reason:string>,fired:boolean,gated:boolean>"


def verdict_rows(spark, cases):
    base = dict(m=1.0, comps=(1.0, 1.0, 1.0), level="trace", zoom="Borderline", zoom_after=None, fired=(), gated=(), na=(), c1="assessed", soft=False, uncal=False, lit=())
    rows = []
    for k, c in cases.items():
        c = {**base, **c}
        st = lambda n: ("gated", "noise") if n in c["gated"] else ("not assessed", "non-finite reading") if n in c["na"] else ("assessed", None)
        signs = tuple((st(n), None if n in (*c["gated"], *c["na"]) else n in c["fired"], n in c["gated"]) for n in ("plaster", "wax", "ester", "burnt"))
        c1 = ((c["c1"].split(":")[0], c["c1"].split(":")[1] if ":" in c["c1"] else None), "C1" in c["fired"] if c["c1"].startswith("assessed") else None, c["c1"].startswith("gated"))
        comps = None if c["comps"] is None else dict(zip(("wc2045", "wc1500", "F05"), c["comps"]))
        bands = {b: (1.0, b in c["lit"], True) for b in ("NH2044", "AM2175")}
        rows.append((k, c["m"], comps, (("assessed", None), c["level"], 2.0), (("assessed", None), "D", c["zoom_after"] or c["zoom"], c["zoom"], bands, None), signs, c1,
                     (c["soft"], ["ester"] if c["soft"] else []), (len(c["gated"]) == 4,), c["uncal"]))
    return spark.createDataFrame(rows, f"""scan_id string, m double, components map<string,double>, evidence struct<status:struct<state:string,reason:string>,level:string,S:double>,
        pattern struct<status:struct<state:string,reason:string>,pattern:string,verdict:string,pattern_verdict:string,bands:map<string,struct<E:double,lit:boolean,readable:boolean>>,vote_band:struct<id:string,lit:boolean,readable:boolean>>,
        signs struct<plaster:{SIGN},wax:{SIGN},ester:{SIGN},burnt:{SIGN}>, C1 {SIGN}, soft struct<fired:boolean,components:array<string>>, b6b struct<gated:boolean>, uncalibrated boolean""")


CASES = {
    "no_reading": dict(m=None), "unlikely": dict(m=0.49), "borderline": dict(m=0.5), "good": dict(m=3.0), "flat": dict(m=8.0, level="none", zoom="Unlikely"), "plus_d": dict(m=3.0, zoom="Unlikely"), "plus_d_low": dict(m=2.9, zoom="Unlikely"),
    "lift_good": dict(m=0.2, level="strong", zoom="Good"), "lift_border": dict(m=0.2, level="clear", zoom="Good"), "no_lift": dict(m=1.0, level="clear", zoom="Good"), "blocked": dict(m=0.2, level="strong", zoom="Good", fired=("wax",)),
    "burnt_lift": dict(m=0.2, level="strong", zoom="Good", fired=("burnt",)), "noisy": dict(m=0.2, level="strong", zoom="Good", gated=("ester",)), "both": dict(m=0.2, level="strong", zoom="Good", fired=("wax",), gated=("ester",)),
    "c1_skipped": dict(m=0.2, level="strong", zoom="Good", c1="skipped:a specific sign fired"), "c1_off": dict(m=0.2, level="strong", zoom="Good", c1="not assessed:kernel support"), "na": dict(m=0.2, level="strong", zoom="Good", na=("plaster",)),
    "uncal": dict(m=8.0, level="none", zoom="Unlikely", uncal=True), "vote": dict(m=0.2, level="none", zoom="Unlikely", zoom_after="Borderline"), "above": dict(m=21.0, soft=True)}


def test_collagen_verdicts(spark):
    got = by_id(V.collagen_verdict(verdict_rows(spark, CASES)), "verdict")
    step = {k: (v.verdict, v.rule_step) for k, v in got.items()}
    assert step == {
        "no_reading": ("Can't tell", "no_model_reading"), "unlikely": ("Unlikely", "model_verdict"), "borderline": ("Borderline", "model_verdict"), "good": ("Good", "model_verdict"), "flat": ("Unlikely", "flat_bands_lead"),
        "plus_d": ("Borderline", "plus_d"), "plus_d_low": ("Borderline", "model_verdict"), "lift_good": ("Good", "lift_good"), "lift_border": ("Borderline", "lift_borderline"), "no_lift": ("Borderline", "model_verdict"),
        "blocked": ("Unlikely", "lift_blocked"), "burnt_lift": ("Good", "lift_good"), "noisy": ("Unlikely", "lift_blocked"), "both": ("Unlikely", "lift_blocked"), "c1_skipped": ("Good", "lift_good"), "c1_off": ("Unlikely", "lift_blocked"),
        "na": ("Unlikely", "lift_blocked"), "uncal": ("Good", "model_verdict"), "vote": ("Unlikely", "flat_bands_lead"), "above": ("Good", "model_verdict")}
    keys = lambda k: [n.key for n in got[k].notes_all]
    assert keys("both") == ["lift_blocked_contaminant"] and keys("noisy")[0] == "lift_blocked_noisy"
    assert got["lift_good"].notes_shown == ["lift_good"] and "positive_signs_all_six" in keys("lift_good")
    assert keys("vote")[:2] == ["flat_bands_lead", "zooms_better_1545_flat"] and got["vote"].notes_shown == ["flat_bands_lead", "zooms_better_1545_flat"]
    assert keys("above")[:2] == ["above_bone_range", "possible_thin_coating"] and got["above"].notes_shown == ["above_bone_range"]
    assert [f.key for f in got["burnt_lift"].flags] == ["flag_burnt"] and got["blocked"].flags[0].signs == ["wax"]
    assert "zooms_better_good" not in keys("blocked") and "zooms_better_good" in keys("noisy")


def test_band_lines_disagreement_and_panel(spark):
    cases = {"protein": dict(m=0.4, lit=("NH2044", "AM2175")), "faint": dict(m=0.1, lit=("AM2175",)), "split": dict(m=2.5, comps=(2.5, 4.0, 1.0)), "close": dict(m=2.9, comps=(2.9, 3.1, 2.8)), "missing": dict(m=2.5, comps=(2.5, None, 9.0))}
    prof = {**PROFILE_COLLAGEN, "models": [{"key": "ryder2045", "model_id": "ry", "role": "published"}, {"key": "chr", "model_id": "ch", "role": "reader"}],
            "notes": {**PROFILE_COLLAGEN["notes"], "panel": {"readers": {"ch": "chr", "raw2045": "ryder2045"}, "ch_above_nh": {"cons3_bin_edges": [1.0], "possible_above": [2.0, 1.0], "strong_above": [4.0, 3.0]},
                      "readers_disagree_strongly": {"cons3_bin_edges": [1.0], "level": 1.5, "min_gap": 0.5, "contrasts": {"RAW": {"median": [0.2, 0.2], "q98": [1.0, 1.0]}, "CH": {"median": [0.0, 0.0], "q98": [1.0, 1.0]}}}}}}
    d = verdict_rows(spark, cases).withColumn("models", F.expr("map('ry', named_struct('value', 0.36D), 'ch', named_struct('value', m + CASE WHEN scan_id = 'split' THEN 1.5D ELSE 0D END))"))
    got = by_id(V.collagen_verdict(d, prof), "verdict")
    keys = {k: [n.key for n in v.notes_all] for k, v in got.items()}
    assert keys["protein"][0] == "zooms_better_protein" and keys["faint"][:2] == ["zooms_better_ryder", "zooms_faint_protein"] and got["faint"].notes_shown == ["zooms_better_ryder"]
    assert "ch_above_nh_possible" in keys["split"] and "readers_disagree_strongly" in keys["split"] and "models_disagree" not in keys["split"]
    assert got["split"].notes_shown == ["ch_above_nh_possible", "readers_disagree_strongly"]
    assert "models_disagree" not in keys["close"] and "models_disagree" not in keys["missing"]
    assert {c.name: round(c.fraction, 3) for c in got["split"].panel.contrasts} == {"CH": 1.0, "RAW": round((2.14 - 0.2) / 1.2, 3)}
    ex = by_id(V.explain_verdict(V.collagen_verdict(d, prof).withColumn("m_sd", F.lit(0.3))), "explanation")
    assert ex["split"].middle == 2.5 and ex["split"].spread == 3.0 and ex["split"].nearest_contrast.name == "RAW" and ex["split"].ch_gap.likely_above == 3.0 and ex["missing"].components is None


def test_pattern_profile_sort_and_results(spark):
    d = V.pattern_verdict(verdict_rows(spark, {"a": {}, "u": dict(uncal=True), "p": dict(m=25.0, fired=("wax", "burnt"))}), PROFILE_ZOOMS)
    got = by_id(V.sort_key(d, PROFILE_ZOOMS), "verdict", "sort_group", "sort_value", "sort_penalty")
    assert (got["a"][0].verdict, got["a"][1:]) == ("Borderline", (1, 2.0, None)) and (got["u"][0].verdict, got["u"][0].rule_step) == ("Can't tell", "band_evidence_not_built_in")
    assert got["p"][0].notes_shown == ["above_bone_range"] and [f.key for f in got["p"][0].flags] == ["flag_contaminant", "flag_burnt"]
    c = V.sort_key(V.collagen_verdict(verdict_rows(spark, CASES | {"wax": dict(m=4.0, fired=("wax",))})), PROFILE_COLLAGEN)
    s = by_id(c, "sort_group", "sort_value", "sort_penalty")
    assert s["wax"] == (0, 4.0, 1) and s["good"] == (0, 3.0, 0) and s["flat"] == (3, 2.0, 0)
    res = by_id(V.to_results(c), "verdict", "verdict_rule", "notes_shown")
    assert res["flat"] == ("unlikely", "flat_bands", ["flat_bands"]) and res["no_reading"][0] == "cant_tell" and res["blocked"][2][0] == "lift_blocked"
    placed = by_id(V.card_items(V.place_notes(V.collagen_verdict(verdict_rows(spark, CASES)), PROFILE_COLLAGEN["notes"]), X.NOTE_WORDS, X.FLAG_WORDS), "placed", "card")
    assert placed["blocked"][1].alerts == ["Lipid sign"] and placed["lift_good"][1].notes == ["Raised to Good"]
    assert [n.key for n in placed["lift_good"][0].details] == ["positive_signs_all_six"]
    with pytest.raises(ValueError):
        V.sort_key(c, {**PROFILE_COLLAGEN, "sort": {**PROFILE_COLLAGEN["sort"], "penalty_signs": ["burnt"]}})


def sign_rows(spark, cases):
    base = {K.sharp_name(s): 0.0 for s in ([1446, 2, 8, 12], [1945, 3, 10, 15], [1766, 3, 9, 15], [1217, 3, 9, 15], [2254, 3, 9, 15], [1433, 2, 9, 13], [979, 2, 8, 12])}
    base.update({"edge50": 600.0, "R_ref": 0.5, "R_vis": 0.3, **{f"c1:{n}": 0.0 for n in (1728, 1762, 2262, 2350, 1510, 2044, 2175)}, "film:2299": 0.0, "film:2325": 0.0})
    rows = []
    for k, c in cases.items():
        gates, red = c.get("gates", {}), c.get("reduced", {})
        rows.append((k, 350.0, 1.0, c.get("n", 2151), {**base, **c.get("r", {})}, (tuple(gates.get(s) for s in ("plaster", "wax", "ester", "burnt", "C1")), (red.get("plaster"), red.get("C1"))), (c.get("tail", False), c.get("tail", False))))
    return spark.createDataFrame(rows, """scan_id string, wl_start double, wl_step double, n_ch int, readings map<string,double>,
        b6b struct<gates:struct<plaster:string,wax:string,ester:string,burnt:string,C1:string>,reduced:struct<plaster:string,C1:string>>, longwave struct<tail_unreliable:boolean,tail_unreliable_c1:boolean>""")


def test_signs_heat_and_foreign_organic(spark):
    sh = lambda *s: K.sharp_name(list(s))
    cases = {"clean": {}, "plaster": {"r": {sh(1446, 2, 8, 12): 20.0, sh(1945, 3, 10, 15): 20.0}}, "one_band": {"r": {sh(1446, 2, 8, 12): 20.0, sh(1945, 3, 10, 15): -2.0}}, "wax": {"r": {sh(1766, 3, 9, 15): 10.0, sh(1217, 3, 9, 15): 4.0}},
             "half_wax": {"r": {sh(1766, 3, 9, 15): 30.0}}, "ester": {"r": {sh(2254, 3, 9, 15): 35.0}}, "charred": {"r": {"edge50": 970.0}}, "calcined": {"r": {sh(1433, 2, 9, 13): 95.0, sh(979, 2, 8, 12): 5.0}},
             "gated": {"gates": {s: "noise in 2000-2100 nm" for s in ("plaster", "wax", "ester", "burnt", "C1")}}, "reduced": {"gates": {"plaster": "noise in 2000-2100 nm", "C1": "noise in 2000-2100 nm"}, "reduced": {"plaster": "band_1446", "C1": "swir1"},
                      "r": {sh(1446, 2, 8, 12): 10.0, "c1:1728": 20.0}}, "reduced_c1": {"gates": {"C1": "noise in 2000-2100 nm"}, "reduced": {"C1": "swir1"}, "r": {"c1:1728": 20.0}}, "nan": {"r": {sh(2254, 3, 9, 15): math.nan, "R_vis": math.nan, "c1:1728": math.nan}}, "short": {"n": 600}, "excess": {"r": {"c1:1728": 12.0}}, "film": {"r": {"film:2299": 18.0}},
             "tail": {"tail": True, "r": {"c1:1728": 11.0, "film:2299": 18.0}}}
    d = K.check_foreign_organic(K.check_signs(sign_rows(spark, cases)))
    got = by_id(d, "signs", "C1")
    fired = {k: sorted([n for n in ("plaster", "wax", "ester", "burnt") if getattr(v[0], n).fired] + (["C1"] if v[1].fired else [])) for k, v in got.items()}
    assert fired == {"clean": [], "plaster": ["plaster"], "one_band": [], "wax": ["wax"], "half_wax": [], "ester": ["ester"], "charred": ["burnt"], "calcined": ["burnt"], "gated": [], "reduced": ["plaster"], "reduced_c1": ["C1"], "nan": [], "short": [],
                     "excess": ["C1"], "film": ["C1"], "tail": []}
    assert got["wax"][1].status.state == "skipped" and got["gated"][0].wax.status.state == "gated" and got["gated"][0].wax.fired is None and got["gated"][1].gated
    assert got["reduced"][0].plaster.status.reason.startswith("reduced (1446 nm band only") and got["reduced"][1].status.state == "skipped"
    assert got["reduced_c1"][1].status.reason.startswith("reduced (below 1800 nm only") and got["reduced_c1"][1].film is None
    assert got["nan"][0].ester.fired is None and got["nan"][0].burnt.status.reason == "non-finite reading" and got["nan"][1].status.reason == "kernel support"
    assert got["short"][0].burnt.status.reason.startswith("not available on this instrument") and got["tail"][1].status.reason.startswith("truncated") and got["tail"][1].film is None
    soft = d.withColumns({"native_reason": F.lit("native"), "gains": F.expr("map('soft', named_struct('terms', CAST(NULL AS array<struct<lo:double,hi:double,gain:double>>), 'base', 0D, 'reason', CAST(NULL AS string)))"), "n2": F.expr("map('2000-2100', 1D)")})
    s = by_id(K.check_soft(soft), "soft")
    assert not s["clean"].fired and not s["wax"].fired
    weak = by_id(K.check_soft(K.check_foreign_organic(K.check_signs(sign_rows(spark, {"e": {"r": {sh(2254, 3, 9, 15): 14.0, "c1:1728": 9.0}}}))).withColumns({"native_reason": F.lit("native"), "gains": F.expr("map('soft', named_struct('terms', CAST(NULL AS array<struct<lo:double,hi:double,gain:double>>), 'base', 0D, 'reason', CAST(NULL AS string)))"), "n2": F.expr("map('x', 1D)")})), "soft")["e"]
    assert weak.fired and weak.components == ["C1", "ester"]


def gate_rows(spark, cases):
    names = [f"gate:{s}" for s in ("plaster", "wax", "ester", "C1")] + ["fallback:plaster", "fallback:C1", "longwave"]
    rows = []
    for k, c in cases.items():
        g = {n: ([(float(a), float(b), c.get("gain", {}).get(n, 1e-6))] if n not in c.get("why", {}) else None, 1.0, c.get("why", {}).get(n)) for n, (a, b) in zip(names, [(2000, 2100), (1500, 1600), (2220, 2245), (2000, 2100), (1500, 1600), (1500, 1600), (2300, 2400)])}
        rows.append((k, 350.0, 1.0, c.get("n", 2151), c.get("pick", "none"), c.get("near", False), g, {w: c.get("n2", 10.0) for w in ("2000-2100", "1500-1600", "2220-2245", "2300-2400")}, c.get("native")))
    return spark.createDataFrame(rows, "scan_id string, wl_start double, wl_step double, n_ch int, correction_id string, near boolean, gains map<string,struct<terms:array<struct<lo:double,hi:double,gain:double>>,base:double,reason:string>>, n2 map<string,double>, native_reason string")


def test_noise_gates_and_longwave(spark):
    cases = {"quiet": {}, "loud": dict(n2=61.0), "short": dict(n=1000), "corrected_quiet": dict(pick="c"), "corrected_wax": dict(pick="c", gain={"gate:wax": 1.0}), "fallback": dict(pick="c", gain={"gate:plaster": 1.0, "gate:C1": 1.0}),
             "no_fallback": dict(pick="c", gain={"gate:plaster": 1.0, "fallback:plaster": 1.0}), "nonlinear": dict(pick="c", why={"gate:ester": "non-linear correction"}), "near": dict(pick="c", near=True, n2=61.0), "unknown": dict(n2=math.nan)}
    got = by_id(K.check_gates(gate_rows(spark, cases)), "b6b")
    out = {k: (v.signs_gated, v.signs_reduced, v.gated) for k, v in got.items()}
    four = ["plaster", "wax", "ester", "C1"]
    assert out == {"quiet": ([], [], False), "loud": (four, [], True), "short": (four, [], True), "corrected_quiet": ([], [], False), "corrected_wax": (["wax"], [], False), "fallback": ([], ["plaster", "C1"], False),
                   "no_fallback": (["plaster"], [], False), "nonlinear": (["ester"], [], False), "near": (four, [], True), "unknown": ([], [], False)}
    assert got["nonlinear"].gates.ester == "not available on this instrument (non-linear correction)" and got["short"].gates.wax.startswith("not available") and got["corrected_wax"].gates.burnt is None
    lw = by_id(K.check_longwave(gate_rows(spark, {"native": dict(native="native"), "quiet": {}, "b9": dict(gain={"longwave": 0.15}), "both": dict(gain={"longwave": 1.0}), "off": dict(why={"longwave": "crosses"})})), "longwave")
    assert {k: (v.status.state, v.tail_unreliable, v.tail_unreliable_c1) for k, v in lw.items()} == {"native": ("not assessed", False, False), "quiet": ("assessed", False, False), "b9": ("assessed", True, False), "both": ("assessed", True, True), "off": ("not assessed", True, True)}


def test_gates_of_each_sign_as_measured(spark):
    gate = {**RULES["acquisition"]["B6b_signs_gate"], "uncorrected": {"plaster": {"n2_window_nm": [2000, 2100], "n2_above": 9.0}, "wax": {"n2_window_nm": [1500, 1600], "n2_above": 60.0}, "burnt": None}}
    rules = {**RULES, "acquisition": {**RULES["acquisition"], "B6b_signs_gate": gate}}
    got = by_id(K.check_gates(gate_rows(spark, {"a": {}}), rules), "b6b")["a"]
    assert got.signs_gated == ["plaster"] and got.gates.wax is None and got.gates.ester is None and got.gates.burnt is None
    assert set(K.gate_windows(rules)) == {(2000, 2100), (1500, 1600)}


def test_cut_noise(spark):
    st = F.struct(F.lit("assessed").alias("state"), F.lit(None).cast("string").alias("reason"))
    b6 = lambda v, sd, applies=True: K.check_cut_noise(F.lit(v).cast("double"), F.lit(sd).cast("double"), st, F.lit(applies))
    got = list(spark.range(1).select(b6(0.6, 0.05), b6(1.5, 0.05), b6(1.0, None), b6(None, 0.1), b6(0.5, 0.1, False)).first())
    assert [(g.status.state, g.outcome) for g in got] == [("assessed", "Check"), ("assessed", "ok"), ("not assessed", None), ("assessed", None), ("not assessed", None)]
