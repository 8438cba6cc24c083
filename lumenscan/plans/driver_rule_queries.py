"""Queries for the rule operators: readings, noise and check states are computed from the driver's tables, then the rules
run on every row. Importing this module adds to ``driver_queries.QUERIES``."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.functions import dates as D
from lumenscan.functions import numeric as N
from lumenscan.functions import records as RC
from lumenscan.functions import text as X
from lumenscan.operators import checks as K
from lumenscan.operators import matching as M
from lumenscan.operators import noise as Z
from lumenscan.operators import quality as Q
from lumenscan.operators import ranking as RK
from lumenscan.operators import spectral as S
from lumenscan.operators import verdict as V
from lumenscan.plans.driver_queries import long_out, query, with_
from lumenscan.plans.driver_tables import lit, q6, r6, spectra, spread, table
from lumenscan.rulebook import ACQUISITION, PROFILE_COLLAGEN, PROFILE_ZOOMS, RULES
from lumenscan.sources import export as EX
from lumenscan.sources import views as VW
from lumenscan.sources.scan_files import candidate_files

# ------------------------------------------------------------------------------------------ inputs and acceptance
@query("reflectance", with_() + f"SELECT vec_id, ch, {q6('(r * (1000e0 + 10e0 * ch)) / (1000e0 + 10e0 * ch)')} AS value FROM L WHERE ch <> 7")
def _reflectance(spark, sf):
    d = spectra(spark, sf).withColumns({"sample_dn": F.transform("r", lambda x, i: x * (i * 10.0 + 1000.0)), "reference_dn": F.transform("r", lambda x, i: F.when(i == 7, 0.0).otherwise(i * 10.0 + 1000.0))})
    return long_out(S.reflectance(d))


@query("scan_kind", with_() + "SELECT vec_id, CASE WHEN any_value(label) % 2 = 0 THEN 'white_reference_save' ELSE 'sample' END AS kind FROM L GROUP BY vec_id")
def _kind(spark, sf):
    d = spectra(spark, sf).withColumns({"sample_dn": F.col("r"), "reference_dn": F.transform("r", lambda x, i: x + (F.col("label") % 2) * i)})
    return Q.classify_kind(d).select("vec_id", "kind")


@query("accept", """WITH h AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'as8' WHEN 1 THEN 'as7' WHEN 2 THEN 'ASD' ELSE 'xyz' END AS magic, o_orderkey % 7 = 0 AS wrong_type, o_custkey % 5 = 0 AS wrong_fmt, o_custkey % 3 = 0 AS no_dark, o_custkey % 11 = 0 AS off_grid,
 o_totalprice - 100000e0 AS ref, o_orderkey % 13 = 0 AS off_join FROM orders)
SELECT k, CASE WHEN magic = 'xyz' THEN 'unsupported: file version xyz' WHEN wrong_type AND magic = 'ASD' THEN 'unsupported: not a reflectance file' WHEN wrong_type THEN 'unsupported: not a raw (DN + white reference) file' WHEN wrong_fmt THEN 'unsupported: data format 1'
 WHEN magic = 'as8' AND no_dark THEN 'unsupported: dark correction flag not set' WHEN off_grid THEN 'unsupported: wavelength grid' WHEN magic <> 'ASD' AND ref <= 0 THEN 'unsupported: white reference not finite and positive' WHEN off_join THEN 'unsupported: detector joins' END AS reason FROM h""")
def _accept(spark, sf):
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    magic = F.element_at(F.lit(["as8", "as7", "ASD", "xyz"]), (k % 4 + 1).cast("int"))
    right = F.when(k % 4 == 2, 1).otherwise(0)
    d = o.select(k.alias("k"), magic.alias("magic"), F.when(k % 4 == 2, F.lit("legacy")).otherwise(magic).alias("format"), F.when(k % 7 == 0, 1 - right).otherwise(right).alias("data_type"), F.when(c % 5 == 0, 1).otherwise(2).alias("data_format"),
                 F.when(c % 3 == 0, 0).otherwise(1).alias("dc_corr"), F.when(c % 11 == 0, 2).otherwise(3).alias("channels"), F.lit(1000.0).alias("wl_start"), F.lit(1.0).alias("wl_step"), F.array(F.lit(1.0), F.col("o_totalprice") - 100000.0, F.lit(2.0)).alias("reference_dn"),
                 F.lit([1.0, 2.0, 3.0]).alias("sample_dn"), F.lit([1.0, 2.0, 3.0]).alias("stored_r"), F.array(F.lit(1000.0), F.when(k % 13 == 0, 1950.0).otherwise(1800.0)).alias("joins_nm"))
    rules = {"input_matrix": {**ACQUISITION["input_matrix"], "grid": {"start_nm": 1000.0, "step_nm": 1.0, "n": 3}}}
    return Q.accept(d, rules).select("k", F.regexp_replace("reject_reason", r"(detector joins).*", "$1").alias("reason"))


@query("saturation", with_("q AS (SELECT vec_id, ch, CASE WHEN wl <= 370 THEN 0 WHEN wl <= 393 THEN 1 ELSE 2 END AS seg, wl, floor(r * 10) * 12000e0 AS dn FROM L)", "m AS (SELECT *, max(dn) OVER (PARTITION BY vec_id, seg) AS m FROM q)",
                           "i AS (SELECT *, CASE WHEN dn = m THEN ch - row_number() OVER (PARTITION BY vec_id, seg, dn = m ORDER BY ch) END AS isl FROM m)", "c AS (SELECT *, count(*) OVER (PARTITION BY vec_id, seg, dn = m, isl) AS run FROM i)") + """
SELECT vec_id, count(*) FILTER (dn >= 65000 OR (dn = m AND m > 0 AND run >= 3)) AS n, CASE WHEN count(*) FILTER ((dn >= 65000 OR (dn = m AND m > 0 AND run >= 3)) AND wl BETWEEN 360 AND 400) > 0 THEN 'Unusable' WHEN count(*) FILTER (dn >= 65000 OR (dn = m AND m > 0 AND run >= 3)) > 0 THEN 'Note' ELSE 'Pass' END AS outcome FROM c GROUP BY vec_id""")
def _saturation(spark, sf):
    d = spectra(spark, sf).withColumns({"sample_dn": F.transform("r", lambda x: F.floor(x * 10) * 12000.0), "reference_dn": F.transform("r", lambda x, i: i * 1.0)})
    d = Q.saturation_report(d, {**ACQUISITION, "integrity_range_nm": [360, 400]})
    # the reference block rises, so it has no run; only its own maximum is a single channel
    return d.select("vec_id", F.col("saturation.saturated_channels").cast("bigint").alias("n"), F.col("saturation.outcome").alias("outcome"))


@query("effective_class", """WITH c AS (SELECT c_custkey AS k, c_mktsegment AS cls, CASE c_custkey % 3 WHEN 0 THEN 'as8' WHEN 1 THEN 'as7' ELSE 'legacy' END AS fmt, CASE WHEN c_custkey % 4 = 0 THEN 1785 ELSE 1800 END AS j, CASE WHEN c_custkey % 5 = 0 THEN 'default' ELSE 'header' END AS src FROM customer)
SELECT k, CASE WHEN fmt = 'legacy' THEN 'asd.fieldspec3' WHEN fmt = 'as7' AND NOT (j = 1800 AND src <> 'default') THEN 'asd.trek' ELSE cls END AS class, CASE WHEN fmt = 'legacy' OR (fmt = 'as7' AND NOT (j = 1800 AND src <> 'default')) THEN 'file_format' ELSE 'user' END AS source FROM c""")
def _effective(spark, sf):
    k = F.col("c_custkey")
    d = table(spark, sf, "customer").select(k.alias("k"), F.col("c_mktsegment").alias("class"), F.element_at(F.lit(["as8", "as7", "legacy"]), (k % 3 + 1).cast("int")).alias("format"), F.array(F.lit(1000.0), F.when(k % 4 == 0, 1785.0).otherwise(1800.0)).alias("joins_nm"),
                                            F.when(k % 5 == 0, "default").otherwise("header").alias("joins_source"))
    return M.effective_class(d).select("k", "class", F.col("class_source").alias("source"))


_NAMES = ["a.asd", "B.ASD", "c.001", "d.sco", ".e.asd", "~f.asd", "g.tmp.asd", "h.part.sco", "i.txt", "asd", "j.12"]


@query("candidate_files", "WITH n AS (SELECT doc_id, n_chars, list_extract(['a.asd','B.ASD','c.001','d.sco','.e.asd','~f.asd','g.tmp.asd','h.part.sco','i.txt','asd','j.12'], (doc_id % 11 + 1)::INT) AS f FROM documents) SELECT doc_id, f FROM n WHERE doc_id % 11 < 4")
def _candidates(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("/x/"), F.element_at(F.lit(_NAMES), (F.col("doc_id") % 11 + 1).cast("int"))).alias("path"), F.col("n_chars").alias("length"))
    return candidate_files(d).select("doc_id", X.file_name(F.col("path")).alias("f"))


# ------------------------------------------------------------------------------------------ noise policies
def cust(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.lit(350.0).alias("wl_start"), F.lit(1.0).alias("wl_step"), F.when(F.col("c_custkey") % 50 == 0, 1000).otherwise(2151).alias("n_ch"))


_GATES = {"plaster": (3, 0.02828399202273366), "wax": (5, 2.1095118686937884), "ester": (7, 7.80219477122152), "C1": (11, 1.8171613293840232)}
TERM = "array<struct<lo:double,hi:double,gain:double>>"


def _gain(lo, hi, gain: Column, reason: Column | None = None) -> Column:
    return F.struct(F.array(F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), gain.alias("gain"))).cast(TERM).alias("terms"), F.lit(1.0).alias("base"), (reason if reason is not None else F.lit(None)).cast("string").alias("reason"))


@query("noise_gates", """WITH c AS (SELECT c_custkey AS k, abs(c_acctbal) / 100e0 AS n2, c_custkey % 2 = 0 AS cor, c_custkey % 50 = 0 AS short FROM customer),
g AS (SELECT k, s, CASE WHEN NOT cor THEN CASE WHEN short THEN 'not available' WHEN n2 > 60 THEN 'noise' END WHEN n2 * gain > cut THEN 'noise' END AS gate, cor AND NOT short AND s IN ('plaster', 'C1') AND n2 * fg <= fcut AS red FROM c,
 (VALUES ('plaster', 3 * 0.02828399202273366e0 / 100, 0.02828399202273366e0, 0.0001e0, 0.008695836931998813e0), ('wax', 5 * 2.1095118686937884e0 / 100, 2.1095118686937884e0, 0e0, 0e0), ('ester', 7 * 7.80219477122152e0 / 100, 7.80219477122152e0, 0e0, 0e0), ('C1', 11 * 1.8171613293840232e0 / 100, 1.8171613293840232e0, 0.01e0, 0.7879697644590612e0)) t(s, gain, cut, fg, fcut))
SELECT k, coalesce(string_agg(s, ',' ORDER BY list_position(['plaster','wax','ester','C1'], s)) FILTER (gate IS NOT NULL AND NOT red), '') AS gated, coalesce(string_agg(s, ',' ORDER BY list_position(['plaster','wax','ester','C1'], s)) FILTER (gate IS NOT NULL AND red), '') AS reduced FROM g GROUP BY k""".replace("cor AND NOT short AND s IN", "cor AND s IN"))
def _gates(spark, sf):
    d = cust(spark, sf)
    n2 = F.abs("bal") / 100.0
    win = {"plaster": (2000, 2100), "wax": (1500, 1600), "ester": (2220, 2245), "C1": (2000, 2100)}
    gains = [x for s, (m, cut) in _GATES.items() for x in (F.lit(f"gate:{s}"), _gain(*win[s], F.lit(m * cut / 100)))]
    gains += [F.lit("fallback:plaster"), _gain(1500, 1600, F.lit(0.0001)), F.lit("fallback:C1"), _gain(1500, 1600, F.lit(0.01))]
    d = d.withColumns({"n2": F.create_map(*[x for w in ("2000-2100", "1500-1600", "2220-2245") for x in (F.lit(w), n2)]), "gains": F.create_map(*gains), "correction_id": F.when(F.col("k") % 2 == 0, "c").otherwise("none"), "near": F.lit(False)})
    d = K.check_gates(d, RULES)
    return d.select("k", F.array_join("b6b.signs_gated", ",").alias("gated"), F.array_join("b6b.signs_reduced", ",").alias("reduced"))


@query("longwave", """WITH c AS (SELECT c_custkey AS k, c_custkey % 3 = 0 AS native, c_custkey % 17 = 0 AS why, abs(c_acctbal) / 3000e0 AS sd FROM customer)
SELECT k, CASE WHEN native OR why THEN 'not assessed' ELSE 'assessed' END AS state, NOT native AND (why OR sd > 1.2491178732534014e0) AS b9, NOT native AND (why OR sd > 2.0818631220890023e0) AS c1 FROM c""")
def _longwave(spark, sf):
    d = cust(spark, sf).withColumns({"native_reason": F.when(F.col("k") % 3 == 0, "native"), "n2": F.create_map(F.lit("2300-2400"), F.abs("bal")),
                                     "gains": F.create_map(F.lit("longwave"), _gain(2300, 2400, F.lit(1 / 3000.0), F.when(F.col("k") % 17 == 0, "x")))})
    d = K.check_longwave(d, RULES)
    return d.select("k", F.col("longwave.status.state").alias("state"), F.col("longwave.tail_unreliable").alias("b9"), F.col("longwave.tail_unreliable_c1").alias("c1"))


@query("implied_sd", f"""SELECT c_custkey AS k, {q6('1.2e0 * list_aggregate([sqrt(power(0.01e0 * c_acctbal, 2) + power(0.02e0 * c_custkey, 2)), abs(0.03e0 * c_acctbal), 0.05e0 * c_custkey], chr(109) || chr(101) || chr(100) || chr(105) || chr(97) || chr(110))')} AS sd FROM customer""".replace("chr(109) || chr(101) || chr(100) || chr(105) || chr(97) || chr(110)", "'median'"))
def _implied(spark, sf):
    comp = lambda n: {"name": n, "id": n, "feature": {"type": "linear", "wavelengths_nm": [2000.0, 2001.0, 2002.0], "weights": [1.0, -2.0, 1.0]}}
    doc = {"id": "c", "kind": "consensus", "preprocessing": [{"op": "absorbance", "clip_min": 1e-6}], "consensus": {"components": [comp("a"), comp("b"), comp("d")]}}
    two = F.struct(F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(g).alias("gain")) for lo, hi, g in ((2000.0, 2100.0, 0.01), (1500.0, 1600.0, 0.02))]).alias("terms"), F.lit(1.0).alias("base"), F.lit(None).cast("string").alias("reason"))
    d = cust(spark, sf).withColumns({"n2": F.create_map(F.lit("2000-2100"), F.col("bal"), F.lit("1500-1600"), F.col("k").cast("double")),
                                     "gains": F.create_map(F.lit("c:a"), two, F.lit("c:b"), _gain(2000, 2100, F.lit(0.03)), F.lit("c:d"), _gain(1500, 1600, F.lit(0.05)))})
    return Z.implied_sd(d, [doc], {"c": 1.2}).select("k", r6(F.col("model_sd")["c"]["sd"]).alias("sd"))


# ------------------------------------------------------------------------------------------ signs
_SH = {"p1": [1446, 2, 8, 12], "p2": [1945, 3, 10, 15], "w1": [1766, 3, 9, 15], "w2": [1217, 3, 9, 15], "es": [2254, 3, 9, 15], "h1": [1433, 2, 9, 13], "h2": [979, 2, 8, 12]}
SIGN_VALUES = {"p1": ("(k * 7 % 13) - 5", lambda k: k * 7 % 13 - 5), "p2": ("(k * 5 % 17) - 6", lambda k: k * 5 % 17 - 6), "w1": ("k * 3 % 14", lambda k: k * 3 % 14), "w2": ("k % 7", lambda k: k % 7), "es": ("k * 11 % 47", lambda k: k * 11 % 47),
               "h1": ("k * 13 % 120", lambda k: k * 13 % 120), "h2": ("k % 9", lambda k: k % 9), "edge": ("900 + k % 80", lambda k: k % 80 + 900), "vis": ("(k % 10) / 20e0", lambda k: (k % 10) / 20.0), "ch": ("(k * 3 % 29) - 10", lambda k: k * 3 % 29 - 10),
               "nh": ("k % 5", lambda k: k % 5), "film": ("k * 7 % 21", lambda k: k * 7 % 21)}
SIGN_CTE = "WITH b AS (SELECT c_custkey AS k, " + ", ".join(f"({s})::DOUBLE AS {n}" for n, (s, _) in SIGN_VALUES.items()).replace("k *", "c_custkey *").replace("(k %", "(c_custkey %").replace("(k)", "(c_custkey)").replace("+ k %", "+ c_custkey %") + """,
 c_custkey % 8 = 0 AS g_pl, c_custkey % 8 = 1 AS g_c1, c_custkey % 16 = 0 AS r_pl, c_custkey % 16 = 1 AS r_c1, c_custkey % 9 = 0 AS tail FROM customer),
s AS (SELECT *, least((p1 + 3.471468164711178e0) / 136.7924929430862e0, (p2 + 2.4107746203449807e0) / 165.2875517115569e0) AS jl, (p1 + 3.471468164711178e0) / 136.7924929430862e0 AS l1 FROM b),
f AS (SELECT *, CASE WHEN g_pl AND r_pl THEN l1 > 0.044254707664456654e0 WHEN g_pl THEN NULL ELSE jl > 0.04859387541885367e0 END AS plaster, w1 >= 10 AND w2 >= 4 AS wax, es >= 35 AS ester, edge >= 969.1812e0 OR (h1 >= 90.02670822216136e0 AND h2 >= 4.475763472609483e0 AND vis >= 0.103380825435112e0) AS burnt,
 CASE WHEN g_c1 THEN 2 * ch - (3.6137328146932295e0 + 2.368329199992467e0 * nh) WHEN tail THEN 3 * ch - (3.7984583230957534e0 + 0.6310989707028958e0 * 3 * nh) ELSE 4 * ch - (2.048979435668694e0 + 0.7237030866308519e0 * 3 * nh) END AS ex FROM s),
z AS (SELECT *, CASE WHEN g_c1 AND NOT r_c1 THEN 'gated' WHEN coalesce(plaster, false) OR wax OR ester THEN 'skipped' ELSE 'assessed' END AS c1_state FROM f),
o AS (SELECT *, CASE WHEN c1_state = 'assessed' THEN ex > CASE WHEN g_c1 THEN 10.8e0 WHEN tail THEN 7.5e0 ELSE 8e0 END OR (NOT g_c1 AND NOT tail AND film >= 17.8e0) END AS c1 FROM z)
"""


def signed(spark, sf) -> DataFrame:
    k = F.col("k")
    v = {n: fn(k).cast("double") for n, (_, fn) in SIGN_VALUES.items()}
    pairs = [x for n, sh in _SH.items() for x in (F.lit(K.sharp_name(sh)), v[n])]
    pairs += [F.lit("edge50"), v["edge"], F.lit("R_ref"), F.lit(0.5), F.lit("R_vis"), v["vis"], F.lit("film:2299"), v["film"], F.lit("film:2325"), F.lit(0.0)]
    pairs += [x for nm in RULES["c1"]["ch_bands_nm"] for x in (F.lit(f"c1:{nm}"), v["ch"])] + [x for nm in RULES["c1"]["nh_bands_nm"] for x in (F.lit(f"c1:{nm}"), v["nh"])]
    none = F.lit(None).cast("string")
    d = spread(table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))).withColumns({"wl_start": F.lit(350.0), "wl_step": F.lit(1.0), "n_ch": F.lit(2151)})
    d = d.withColumns({"readings": F.create_map(*pairs), "b6b": F.struct(
        F.struct(F.when(k % 8 == 0, "noise").alias("plaster"), none.alias("wax"), none.alias("ester"), none.alias("burnt"), F.when(k % 8 == 1, "noise").alias("C1")).alias("gates"),
        F.struct(F.when(k % 16 == 0, "band_1446").alias("plaster"), F.when(k % 16 == 1, "swir1").alias("C1")).alias("reduced"), F.lit(False).alias("gated")),
        "longwave": F.struct((k % 9 == 0).alias("tail_unreliable"), (k % 9 == 0).alias("tail_unreliable_c1")), "native_reason": F.lit("native"), "n2": F.create_map(F.lit("2000-2100"), F.lit(1.0)), "gains": F.create_map(F.lit("soft"), _gain(2000, 2100, F.lit(1.0)))})
    return K.check_soft(K.check_foreign_organic(K.check_signs(d)))


@query("contamination_signs", SIGN_CTE + f"""SELECT k, coalesce(plaster::VARCHAR, 'unknown') AS plaster, wax, ester, burnt, c1_state, coalesce(c1::VARCHAR, 'unknown') AS c1, {q6("CASE WHEN c1_state = 'assessed' THEN ex END")} AS excess FROM o""")
def _signs(spark, sf):
    d = signed(spark, sf)
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    return d.select("k", word("signs.plaster.fired").alias("plaster"), *[F.col(f"signs.{s}.fired").alias(s) for s in ("wax", "ester", "burnt")], F.col("C1.status.state").alias("c1_state"), word("C1.fired").alias("c1"), r6(F.col("C1.excess")).alias("excess"))


@query("soft_tier", SIGN_CTE + """SELECT k, NOT (coalesce(plaster, false) OR wax OR ester OR coalesce(c1, false)) AND ((c1_state = 'assessed' AND NOT g_c1 AND ex >= CASE WHEN tail THEN 6.1e0 ELSE 6.6e0 END) OR es >= 13.1e0 OR (NOT g_pl AND jl >= 0.026e0)) AS fired FROM o""")
def _soft(spark, sf):
    return signed(spark, sf).select("k", F.col("soft.fired").alias("fired"))


@query("flags", SIGN_CTE + """SELECT k, array_to_string(list_filter([CASE WHEN plaster THEN 'plaster' END, CASE WHEN wax THEN 'wax' END, CASE WHEN ester THEN 'ester' END, CASE WHEN c1 THEN 'C1' END], lambda x: x IS NOT NULL), ',') AS contaminants, burnt FROM o""")
def _flags(spark, sf):
    d = signed(spark, sf).withColumn("f", V.flags(PROFILE_COLLAGEN))
    one = lambda key: F.try_element_at(F.filter("f", lambda x: x["key"] == key), F.lit(1))["signs"]
    return d.select("k", F.coalesce(F.array_join(one("flag_contaminant"), ","), F.lit("")).alias("contaminants"), one("flag_burnt").isNotNull().alias("burnt"))


@query("bone_likeness", """SELECT c_custkey AS k, CASE WHEN (CASE WHEN c_custkey % 9 = 0 THEN c_custkey % 83 ELSE c_custkey % 97 END) / 100e0 < 0.4e0 THEN 'fail' ELSE 'pass' END AS outcome, c_custkey % 9 = 0 AS truncated FROM customer""")
def _bone(spark, sf):
    k = F.col("k")
    d = cust(spark, sf).withColumns({"longwave": F.struct((k % 9 == 0).alias("tail_unreliable")), "readings": F.create_map(F.lit("b9"), k % 97 / 100.0, F.lit("b9_truncated"), k % 83 / 100.0)})
    return K.check_bone(d).select("k", F.col("b9.outcome").alias("outcome"), F.col("b9.status.reason").isNotNull().alias("truncated"))


# ------------------------------------------------------------------------------------------ verdicts
_LEVELS = ["none", "can't tell", "strong", "clear", "trace"]
_ZOOMS = ["Unlikely", "Borderline", "Good", "Can't tell"]


def verdict_input(spark, sf) -> DataFrame:
    """Signs from ``signed``; the consensus, evidence level and pattern follow from other keys of the row."""
    d = signed(spark, sf)
    k = F.col("k")
    pick = lambda words, i: F.element_at(F.lit(words), (i + 1).cast("int"))
    zv = pick(_ZOOMS, (k * 5 + F.floor(k / 4)) % 4)
    m = (k * 17 % 61) / 10.0 - 0.55
    assessed = F.struct(F.lit("assessed").alias("state"), F.lit(None).cast("string").alias("reason"))
    return d.withColumns({
        "m": m, "components": F.create_map(F.lit("wc2045"), m + 0.3, F.lit("wc1500"), m, F.lit("F05"), m - (k % 4) * 0.4),
        "evidence": F.struct(assessed.alias("status"), pick(_LEVELS, F.floor(k / 3) % 5).alias("level"), (k % 13 / 2.0).alias("S")),
        "pattern": F.struct(assessed.alias("status"), F.lit("D").alias("pattern"), zv.alias("verdict"), zv.alias("pattern_verdict"),
                            F.create_map(F.lit("NH2044"), F.struct(F.lit(1.0).alias("E"), (k % 2 == 0).alias("lit"), F.lit(True).alias("readable")), F.lit("AM2175"), F.struct(F.lit(1.0).alias("E"), (k % 3 == 0).alias("lit"), F.lit(True).alias("readable"))).alias("bands"),
                            F.lit(None).cast("struct<id:string,lit:boolean,readable:boolean>").alias("vote_band")),
        "uncalibrated": k % 19 == 0})


VERDICT_CTE = SIGN_CTE + """, vi AS (SELECT *, (k * 17 % 61) / 10e0 - 0.55e0 AS m, list_extract(['none','can''t tell','strong','clear','trace'], ((k // 3) % 5 + 1)::INT) AS level, list_extract(['Unlikely','Borderline','Good','Can''t tell'], ((k * 5 + k // 4) % 4 + 1)::INT) AS zv, k % 19 = 0 AS unc,
 coalesce(plaster, false) OR wax OR ester OR coalesce(c1, false) AS contam, (g_pl AND NOT r_pl) OR c1_state = 'gated' AS unchecked FROM o),
v1 AS (SELECT *, CASE WHEN m < 0.5e0 THEN 'Unlikely' WHEN m < 3e0 THEN 'Borderline' ELSE 'Good' END AS v0 FROM vi),
v2 AS (SELECT *, NOT unc AND level = 'none' AS flat, NOT unc AND level <> 'none' AND zv = 'Unlikely' AND m >= 3e0 AS plusd, CASE WHEN zv = 'Good' AND level = 'strong' THEN 'Good' WHEN zv = 'Good' AND level = 'clear' AND v0 = 'Unlikely' THEN 'Borderline' ELSE v0 END AS tgt FROM v1),
v3 AS (SELECT *, NOT unc AND NOT flat AND NOT plusd AND tgt <> v0 AS would FROM v2),
vd AS (SELECT *, CASE WHEN flat THEN 'Unlikely' WHEN plusd THEN 'Borderline' WHEN would AND NOT contam AND NOT unchecked THEN tgt ELSE v0 END AS verdict,
 CASE WHEN flat THEN 'flat_bands_lead' WHEN plusd THEN 'plus_d' WHEN would AND NOT contam AND NOT unchecked THEN CASE WHEN tgt = 'Good' THEN 'lift_good' ELSE 'lift_borderline' END WHEN would THEN 'lift_blocked' ELSE 'model_verdict' END AS step FROM v3)
"""


@query("collagen_verdict", VERDICT_CTE + "SELECT k, verdict, step, v0 AS model_verdict FROM vd")
def _verdict(spark, sf):
    d = V.collagen_verdict(verdict_input(spark, sf))
    return d.select("k", F.col("verdict.verdict").alias("verdict"), F.col("verdict.rule_step").alias("step"), F.col("verdict.model_verdict").alias("model_verdict"))


@query("rule_notes", VERDICT_CTE + """SELECT k, CASE WHEN flat THEN 'flat_bands_lead' WHEN plusd THEN 'plus_d' WHEN step LIKE 'lift_g%' OR step = 'lift_borderline' THEN step WHEN would AND contam THEN 'lift_blocked_contaminant' WHEN would THEN 'lift_blocked_noisy' END AS rule_note,
 verdict IN ('Good', 'Borderline') AND unchecked AS unchecked_note, NOT unc AND level = 'can''t tell' AS noisy_note FROM vd""")
def _notes(spark, sf):
    d = V.collagen_verdict(verdict_input(spark, sf))
    keys = F.transform("verdict.notes_all", lambda n: n["key"])
    rule = F.try_element_at(F.filter(keys, lambda x: x.isin("flat_bands_lead", "plus_d", "lift_good", "lift_borderline", "lift_blocked_contaminant", "lift_blocked_noisy")), F.lit(1))
    return d.select("k", rule.alias("rule_note"), F.array_contains(keys, "contaminants_not_checked").alias("unchecked_note"), F.array_contains(keys, "bands_too_noisy").alias("noisy_note"))


@query("sort_key", VERDICT_CTE + f"""SELECT k, CASE verdict WHEN 'Good' THEN 0 WHEN 'Borderline' THEN 1 ELSE 3 END AS sort_group, {q6("CASE WHEN verdict = 'Unlikely' THEN (k % 13) / 2e0 ELSE m END")} AS sort_value, contam::INT AS sort_penalty FROM vd""")
def _sort_key(spark, sf):
    d = V.sort_key(V.collagen_verdict(verdict_input(spark, sf)), PROFILE_COLLAGEN)
    return d.select("k", "sort_group", r6(F.col("sort_value")).alias("sort_value"), "sort_penalty")


@query("override_and_second_opinion", VERDICT_CTE + """SELECT k, CASE WHEN k % 23 = 0 THEN 'Doesn''t look like bone' ELSE verdict END AS verdict, k % 23 <> 0 AND NOT unc AND k % 2 = 1 AND abs((k % 29) / 2e0 - m) > 4.1e0 AS differs FROM vd""")
def _override(spark, sf):
    d = V.collagen_verdict(verdict_input(spark, sf)).withColumns({"b9": F.struct(F.when(F.col("k") % 23 == 0, "fail").otherwise("pass").alias("outcome")), "native": F.col("k") % 2 == 0, "class": F.lit("x")})
    d = V.second_opinion(V.override_verdict(d, PROFILE_COLLAGEN), PROFILE_COLLAGEN, F.col("k") % 29 / 2.0)
    return d.select("k", F.col("verdict.verdict").alias("verdict"), F.exists("verdict.notes_all", lambda n: n["key"] == "second_opinion_differs").alias("differs"))


@query("pattern_verdict", VERDICT_CTE + "SELECT k, CASE WHEN unc THEN 'Can''t tell' ELSE zv END AS verdict, CASE WHEN unc THEN 'band_evidence_not_built_in' ELSE 'zooms_pattern' END AS step FROM vd")
def _pattern_verdict(spark, sf):
    d = V.pattern_verdict(verdict_input(spark, sf), PROFILE_ZOOMS)
    return d.select("k", F.col("verdict.verdict").alias("verdict"), F.col("verdict.rule_step").alias("step"))


_PANEL = {"readers": {"ch": "ch", "raw2045": "raw"}, "ch_above_nh": {"cons3_bin_edges": [1.0, 3.0], "possible_above": [2.0, 1.5, 1.0], "strong_above": [4.0, 3.0, 2.5]},
          "readers_disagree_strongly": {"cons3_bin_edges": [2.0], "level": 1.5, "min_gap": 0.5, "contrasts": {"RAW": {"median": [0.2, 0.4], "q98": [1.0, 1.6]}}}}


@query("panel_notes", f"""WITH c AS (SELECT c_custkey AS k, (c_custkey * 17 % 61) / 10e0 AS m, (c_custkey * 7 % 53) / 10e0 - 1.25e0 AS gap, (c_custkey * 3 % 41) / 10e0 AS raw FROM customer)
SELECT k, CASE WHEN gap > CASE WHEN m >= 3 THEN 2.5e0 WHEN m >= 1 THEN 3e0 ELSE 4e0 END THEN 'ch_above_nh_strong' WHEN gap > CASE WHEN m >= 3 THEN 1e0 WHEN m >= 1 THEN 1.5e0 ELSE 2e0 END THEN 'ch_above_nh_possible' END AS ch_note,
 (CASE WHEN m >= 2 THEN (raw - 0.4e0) / 1.2e0 ELSE (raw - 0.2e0) / 0.8e0 END) > 1.5e0 AND raw > 0.5e0 AS disagree, {q6('CASE WHEN m >= 2 THEN (raw - 0.4e0) / 1.8e0 ELSE (raw - 0.2e0) / 1.2e0 END')} AS fraction FROM c""".replace("/ 10e0 AS raw", "/ 10e0 + 0.01e0 AS raw").replace("- 1.25e0 AS gap", "- 1.255e0 AS gap"))
def _panel(spark, sf):
    k = F.col("k")
    m = (k * 17 % 61) / 10.0
    d = cust(spark, sf).select("k", m.alias("m")).withColumn("models", F.create_map(F.lit("ch"), F.struct((F.col("m") + ((k * 7 % 53) / 10.0 - 1.255)).alias("value")), F.lit("raw"), F.struct((F.col("m") + ((k * 3 % 41) / 10.0 + 0.01)).alias("value"))))
    specs = [{"key": "ch", "model_id": "ch"}, {"key": "raw", "model_id": "raw"}]
    p = V.panel_columns({"panel": _PANEL}, F.col("m"), F.create_map(F.lit("wc2045"), F.lit(None).cast("double")), specs)
    return d.select("k", p["ch_note"].alias("ch_note"), (F.size(p["fired"]) > 0).alias("disagree"), r6(F.element_at(p["contrasts"], 1)["fraction"]).alias("fraction"))


@query("public_results", VERDICT_CTE + """SELECT k, CASE verdict WHEN 'Good' THEN 'good' WHEN 'Borderline' THEN 'borderline' ELSE 'unlikely' END AS verdict, CASE step WHEN 'model_verdict' THEN 'model' WHEN 'flat_bands_lead' THEN 'flat_bands' ELSE step END AS verdict_rule, replace(level, 'can''t tell', 'cant_tell') AS level FROM vd""")
def _results(spark, sf):
    d = V.sort_key(V.collagen_verdict(verdict_input(spark, sf)), PROFILE_COLLAGEN)
    return V.to_results(d, keep=["k"]).select("k", "verdict", "verdict_rule", "level")


@query("explanation", VERDICT_CTE + f"SELECT k, {q6('list_aggregate([m + 0.3e0, m, m - (k % 4) * 0.4e0], ' + chr(39) + 'median' + chr(39) + ')')} AS middle, {q6('0.3e0 + (k % 4) * 0.4e0')} AS spread, step <> 'model_verdict' AS ruled FROM vd")
def _explain(spark, sf):
    d = V.explain_verdict(V.collagen_verdict(verdict_input(spark, sf)).withColumn("m_sd", F.lit(0.2)))
    return d.select("k", r6(F.col("explanation.middle")).alias("middle"), r6(F.col("explanation.spread")).alias("spread"), (F.col("explanation.rule_key") != "model_verdict").alias("ruled"))


@query("instrument_notes", """SELECT c_custkey AS k, (CASE WHEN c_custkey % 2 = 0 THEN 'std' ELSE 'hires' END) <> CASE WHEN c_custkey % 3 = 0 THEN 'std' ELSE 'hires' END AS mismatch, c_custkey % 7 = 0 AS uncalibrated FROM customer""")
def _inst_notes(spark, sf):
    k = F.col("k")
    d = cust(spark, sf).withColumns({"class": F.when(k % 2 == 0, "std").otherwise("hires"), "serial_class": F.when(k % 3 == 0, "std").otherwise("hires"), "uncalibrated": k % 7 == 0})
    has = lambda key: F.exists("instrument_notes", lambda n: n["key"] == key)
    return V.instrument_notes(d).select("k", has("serial_class_mismatch").alias("mismatch"), has("instrument_uncalibrated").alias("uncalibrated"))


@query("card_labels", VERDICT_CTE + """SELECT k, (CASE WHEN plaster THEN 1 ELSE 0 END + wax::INT + ester::INT + coalesce(c1, false)::INT + burnt::INT) AS n_alerts FROM vd""")
def _card(spark, sf):
    d = V.card_items(V.place_notes(V.collagen_verdict(verdict_input(spark, sf)), PROFILE_COLLAGEN["notes"]), X.NOTE_WORDS, X.FLAG_WORDS)
    return d.select("k", F.size("card.alerts").alias("n_alerts"))


@query("annotations", """SELECT c_custkey AS k, (c_custkey % 3 = 0)::INT + (c_custkey % 5 > 3)::INT + (c_custkey % 7 = 0)::INT AS n, CASE WHEN c_custkey % 7 = 0 THEN 'Noise could carry this reading across a verdict cut (noise SD ≈ ' || printf('%.1f', (c_custkey % 10) / 10e0) || ' points).' END AS noise FROM customer""")
def _annotations(spark, sf):
    k = F.col("k")
    st = F.struct(F.when(k % 3 == 0, "not assessed").otherwise("assessed").alias("state"), F.when(k % 3 == 0, "x").alias("reason"))
    d = cust(spark, sf).withColumn("a", V.model_annotations(st, (k % 5).cast("double"), F.when(k % 7 == 0, "Check"), k % 10 / 10.0))
    return d.select("k", F.size("a").alias("n"), F.try_element_at(F.filter("a", lambda x: x["kind"] == "noise"), F.lit(1))["text"].alias("noise"))


@query("check_rows", VERDICT_CTE + "SELECT k, (plaster IS NOT NULL AND plaster)::INT + wax::INT + ester::INT + coalesce(c1, false)::INT + burnt::INT AS flagged, (g_pl AND NOT r_pl) OR c1_state = 'gated' AS unchecked FROM vd")
def _check_rows(spark, sf):
    ok = F.struct(F.lit("ok").alias("outcome"))
    d = V.collagen_verdict(verdict_input(spark, sf)).withColumns({"acquisition": F.struct(ok.alias("B5"), ok.alias("B7"), ok.alias("B8")), "b9": F.struct(F.struct(F.lit("assessed").alias("state")).alias("status"), F.lit("pass").alias("outcome")),
                                                                  "b6b": F.struct(F.lit("ok").alias("outcome"), F.lit(False).alias("gated"))})
    d = V.check_rows(d)
    return d.select("k", F.size(F.filter("check_rows", lambda r: r["icon"] == "flag")).alias("flagged"), F.exists("check_rows", lambda r: r["title"].isin("Contaminant signs not checked", "Some contaminant signs not checked")).alias("unchecked"))


# ------------------------------------------------------------------------------------------ scalars on a large table
@query("scalar_functions", f"""SELECT l_orderkey, l_linenumber, {q6('CASE WHEN l_quantity <= 10 THEN 1e0 WHEN l_quantity <= 30 THEN 1e0 + (l_quantity - 10) * 0.1e0 ELSE 3e0 END')} AS piecewise, (l_quantity >= 10)::INT + (l_quantity >= 25)::INT + (l_quantity >= 40)::INT AS bin,
 CASE WHEN l_discount < 0.03e0 THEN 'low' WHEN l_discount < 0.07e0 THEN 'mid' ELSE 'high' END AS level, {q6('1e0 / (1e0 + exp(-(l_quantity - 25) / 10e0))')} AS logistic, {q6('(l_extendedprice / l_quantity - l_tax) * greatest(l_discount, 0.05e0) * 0.7777712345e0')} AS expr FROM lineitem""")
def _scalars(spark, sf):
    d = table(spark, sf, "lineitem")
    q = F.col("l_quantity")
    tree = {"op": "mul", "args": [{"op": "mul", "args": [{"op": "sub", "args": [{"op": "div", "args": [{"ref": "p"}, {"ref": "q"}]}, {"ref": "t"}]}, {"op": "max", "args": [{"ref": "d"}, 0.05]}]}, 0.7777712345]}
    return d.select("l_orderkey", "l_linenumber", r6(N.piecewise_linear(q, [10.0, 30.0], [1.0, 3.0])).alias("piecewise"), N.bin_index(q, [10.0, 25.0, 40.0]).alias("bin"),
                    N.level_label(F.col("l_discount"), [{"label": "low", "below": 0.03}, {"label": "mid", "below": 0.07}, {"label": "high"}]).alias("level"), r6(N.logistic((q - 25) / 10.0)).alias("logistic"),
                    r6(N.expression(tree, {"p": F.col("l_extendedprice"), "q": q, "t": F.col("l_tax"), "d": F.col("l_discount")})).alias("expr"))


@query("header_clock", """SELECT o_orderkey, CASE WHEN make_date(2024, 1, 1) IS NOT NULL AND o_orderkey % 31 + 1 <= day(last_day(make_date(2000 + (o_custkey % 30)::INT, (o_orderkey % 12 + 1)::INT, 1))) THEN
 strftime(make_timestamp(2000 + o_custkey % 30, o_orderkey % 12 + 1, o_orderkey % 31 + 1, o_orderkey % 24, o_orderkey % 60, (o_custkey % 60)::DOUBLE), '%Y-%m-%d %H:%M:%S') END AS local, (o_orderkey % 5000)::DOUBLE AS age FROM orders""")
def _clock(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ts = D.tm_to_timestamp(*[x.cast("int") for x in (c % 60, k % 60, k % 24, k % 31 + 1, k % 12, c % 30 + 100)])
    age = D.reference_age_seconds(F.lit(40000.0) + k % 5000 / 86400.0, F.lit(40000.0))
    return table(spark, sf, "orders").select("o_orderkey", ts.cast("string").alias("local"), F.round(age, 3).alias("age"))


@query("note_base_keys", "SELECT c_custkey AS k, list_extract(['lift', 'lift_blocked', 'positive_signs', 'zooms_better', 'ch_above_nh', 'plus_d'], (c_custkey % 6 + 1)::INT) AS base FROM customer")
def _base_keys(spark, sf):
    key = F.element_at(F.lit(["lift_good", "lift_blocked_noisy", "positive_signs_clear", "zooms_better_1545", "ch_above_nh_strong", "plus_d"]), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), X.note_base_key(key).alias("base"))


@query("names", "SELECT p_partkey, 'Scan' || p_partkey AS short, 'set ' || p_size AS folder FROM part")
def _names(spark, sf):
    path = F.concat(F.lit("/data/set "), F.col("p_size").cast("string"), F.lit("/Scan"), F.col("p_partkey").cast("string"), F.lit(".ASD"))
    return table(spark, sf, "part").select("p_partkey", X.short_name(X.file_name(path)).alias("short"), X.folder_name(X.folder(path)).alias("folder"))


@query("union_wide", """SELECT o_orderkey AS id, o_totalprice AS price, NULL::VARCHAR AS reason FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'""")
def _union(spark, sf):
    o = table(spark, sf, "orders")
    scored = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return M.union_wide([scored, o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("reason"))])


@query("technical_table", """SELECT o_orderkey AS scan_id, o_orderstatus AS "verdict.verdict", o_totalprice AS "verdict.m", '[' || o_custkey || ',' || (o_orderkey % 3) || ']' AS list, 2 AS "list.n", 'zooms' AS analysis FROM orders""")
def _technical(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("scan_id"), F.struct(F.col("o_orderstatus").alias("verdict"), F.col("o_totalprice").alias("m")).alias("verdict"), F.array("o_custkey", F.col("o_orderkey") % 3).alias("list"))
    return EX.technical_table(o, "zooms")


@query("newest_first", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, row_number() OVER (ORDER BY events.ts DESC, event_id) AS pos FROM events")
def _newest(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", F.lit(None).cast("bigint").alias("arrived_seq"))
    return RK.newest_rank(e, acquired="ts", path="event_id", out="pos").select("event_id", F.substring(F.col("ts").cast("string"), 1, 19).alias("ts"), "pos")


@query("version_bump", "SELECT p_partkey, (p_size + 1) || '.0.0' AS major, p_size || '.' || (p_partkey % 9 + 1) || '.0' AS minor, p_size || '.' || (p_partkey % 9) || '.4' AS patch FROM part")
def _bump(spark, sf):
    v = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 9).cast("string"), F.lit("3"))
    return table(spark, sf, "part").select("p_partkey", *[RC.bump(v, p).alias(p) for p in ("major", "minor", "patch")])


@query("body_hashes")
def _bodies(spark, sf):
    doc = F.to_json(F.struct(F.col("p_size").alias("b"), F.col("p_brand").alias("a"), F.col("p_partkey").cast("string").alias("version")))
    return table(spark, sf, "part").select("p_partkey", RC.body_hash(doc).alias("sha"))


@query("bands_off", VERDICT_CTE + "SELECT k, CASE WHEN NOT unc THEN level END AS level, CASE WHEN NOT unc THEN zv END AS pattern_verdict, CASE WHEN unc THEN 'not assessed' ELSE 'assessed' END AS state FROM vd")
def _bands_off(spark, sf):
    d = verdict_input(spark, sf)
    e, p = F.col("evidence"), F.col("pattern")
    d = d.withColumns({"evidence": F.struct(*[e[c].alias(c) for c in ("status", "level", "S")], F.lit(1).alias("n_readable_core"), F.lit(1).alias("n_lit_core"), F.lit(0.0).alias("guard_max_E"), F.lit(None).cast("map<string,double>").alias("bands")),
                       "pattern": F.struct(*[p[c].alias(c) for c in ("status", "pattern", "verdict", "pattern_verdict", "bands", "vote_band")], F.lit(False).alias("vote_1545"))})
    d = K.bands_off(d)
    return d.select("k", F.col("evidence.level").alias("level"), F.col("pattern.pattern_verdict").alias("pattern_verdict"), F.col("pattern.status.state").alias("state"))


@query("near_uncorrected", """SELECT c_custkey AS k, c_custkey % 4 <> 0 AND abs(1 + (c_custkey % 41 - 20) / 100e0 - 1) <= 0.15e0 + 1e-12 AS near FROM customer""")
def _near(spark, sf):
    k = F.col("k")
    req = Z.statistic_requests(RULES)
    gain = F.lit(1.0) + (k % 41 - 20) / 100.0
    d = cust(spark, sf).withColumns({"correction_id": F.when(k % 4 == 0, "none").otherwise("c"), "gains": F.create_map(*[x for r in req for x in (F.lit(r.name), _gain(2000, 2100, gain))])})
    # the margin is widened by the same last-bit allowance on both sides, so that no gain sits exactly on the cut
    return d.select("k", Z.standard_like(req, 0.15 + 1e-12).alias("near"))


@query("join_warnings", with_("s AS (SELECT vec_id, wl, ch, abs(lead(r) OVER w - r) / abs(r) AS s FROM L WINDOW w AS (PARTITION BY vec_id ORDER BY ch))",
                              "b AS (SELECT vec_id, j, arg_max(wl, s) AS pos FROM s JOIN (VALUES (370e0), (393e0)) t(j) ON wl BETWEEN j - 8 AND j + 8 GROUP BY ALL)") + "SELECT vec_id, count(*) FILTER (pos <> j) AS n FROM b GROUP BY vec_id")
def _join_warnings(spark, sf):
    d = Q.join_warnings(spectra(spark, sf), "r", half=8)
    return d.select("vec_id", F.size("join_warnings").cast("bigint").alias("n"))


@query("spectral_views", with_("v AS (SELECT vec_id, ch, r, log10(1e0 / greatest(r, 1e-6)) AS a FROM L)") + f"SELECT vec_id, count(*) AS n, {q6('sum(a)')} AS a_sum, {q6('sum(r)')} AS r_sum, 34 AS d2_read FROM v GROUP BY vec_id")
def _views(spark, sf):
    d = VW.spectral_views(spectra(spark, sf), 31)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return d.select("vec_id", F.size("view_R").cast("bigint").alias("n"), r6(add("view_A")).alias("a_sum"), r6(add("view_R_meas")).alias("r_sum"), F.size(F.array_compact("view_D2_31")).alias("d2_read"))


@query("reference_views", with_("m AS (SELECT label, ch, avg(log10(1e0 / r)) AS a FROM L GROUP BY ALL)") + f"SELECT label::VARCHAR AS label, ch, {q6('power(10e0, -a)')} AS value FROM m")
def _reference_views(spark, sf):
    long = S.to_long(spectra(spark, sf), ["label"]).groupBy("label", "ch").agg(F.avg(F.log10(F.lit(1.0) / F.col("r"))).alias("a"))
    levels = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "a"))), lambda s: s["a"]).alias("absorbance"))   # one value per channel and level
    d = VW.reference_views(levels, 31)
    return d.select(F.col("label").cast("string").alias("label"), F.posexplode("view_R").alias("ch", "v")).select("label", "ch", r6(F.col("v")).alias("value"))


@query("readable_words", VERDICT_CTE + """SELECT k, CASE verdict WHEN 'Good' THEN 'Good candidate' ELSE verdict END AS verdict, CASE WHEN m < 0.5e0 THEN '< 0.5%' WHEN m < 3e0 THEN '≈ ' || printf('%.1f', least(floor(m * 10 + 0.5) / 10, 2.9)) || '% (± 1)' WHEN m < 6e0 THEN '≈ ' || greatest(floor(m + 0.5)::INT, 3) || '%' ELSE '> 6%' END AS collagen,
 CASE zv WHEN 'Can''t tell' THEN 'Too noisy to read every collagen band' ELSE 'Protein bands resolved at 2044/2175, other bands incomplete' END AS band_check FROM vd""")
def _readable(spark, sf):
    d = V.collagen_verdict(verdict_input(spark, sf))
    p = F.col("pattern")
    d = d.withColumns({"scan_id": F.col("k"), "class": F.lit("x"), "serial": F.col("k"), "models": F.create_map(F.lit("a"), F.struct(F.col("m").alias("value"))),
                       "pattern": F.struct(*[p[c].alias(c) for c in ("status", "pattern", "verdict", "pattern_verdict", "bands", "vote_band")], F.lit(False).alias("vote_1545"))})
    return EX.readable_table(d).select(F.col("scan_id").alias("k"), "verdict", "collagen", "band_check")


@query("manifest", """SELECT c_custkey::VARCHAR AS scan_id, c_mktsegment AS class, 'zooms' AS analysis, '1' AS revision FROM customer""")
def _manifest(spark, sf):
    d = EX.manifest(table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("scan_id"), F.col("c_mktsegment").alias("class")), "zooms", {"m@1": "h"})
    j = lambda p: F.get_json_object("manifest", p)
    return d.select("scan_id", j("$.effective_configuration.instrument_class").alias("class"), j("$.effective_configuration.analysis").alias("analysis"), j("$.result_revision").alias("revision"))


@query("result_keys", """SELECT count(*) AS n, count(DISTINCT (user_id, event_type, floor(value))) AS keys FROM events""")
def _result_keys(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("path"), F.floor("value").cast("string").alias("input_sha256"), F.col("event_type").alias("class"), F.lit("user").alias("class_source"))
    rec = EX.log_records(e, "lumenscan", {"m@1": "h"})
    return rec.agg(F.count("*").alias("n"), F.countDistinct("result_key").alias("keys"))


@query("scan_report", with_("g AS (SELECT vec_id, any_value(label) AS label, avg(r) AS m, min(r) AS lo, max(r) AS hi, stddev_pop(r) AS s, max(r) FILTER (wl BETWEEN 371 AND 393) AS mx FROM L GROUP BY vec_id)") + f"""
SELECT vec_id, CASE label % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'not_scored' ELSE 'accepted' END AS acceptance, {q6('lo')} AS lo, {q6('m')} AS mean, CASE WHEN label % 3 = 0 THEN 'Unusable' WHEN label % 3 = 1 THEN 'Pass' WHEN m < 0.15e0 OR mx > 0.35e0 THEN 'Note' ELSE 'Pass' END AS worst FROM g""")
def _report(spark, sf):
    rules = {**ACQUISITION, "integrity_range_nm": [350, 413], "B5_dark": {"mean_R_below": 0.15}, "B7_above_one": {"range_offsets_nm": [1, 0], "max_R_above": 0.35}, "B8_splice_step": {**ACQUISITION["B8_splice_step"], "note_above": 1e9, "check_above": 1e9}}
    d = spectra(spark, sf).withColumns({"reject_reason": F.when(F.col("label") % 3 == 0, "unsupported: x"), "kind": F.when(F.col("label") % 3 == 1, "white_reference_save").otherwise("sample"),
                                        "sample_dn": F.transform("r", lambda x, i: i * 1.0), "reference_dn": F.transform("r", lambda x, i: i * 2.0 + 1.0)})
    d = Q.scan_report(d, rules)
    return d.select("vec_id", "acceptance", r6(F.col("reflectance.min")).alias("lo"), r6(F.col("reflectance.mean")).alias("mean"), F.col("worst_outcome").alias("worst"))
