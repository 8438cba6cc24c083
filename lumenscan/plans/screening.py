"""The whole screening job: scans in, explained verdicts out.

One narrow pass over the scans. Rejected and unusable scans keep their row but carry no spectrum into the kernel pass.
The only shuffles are the distinct layouts (tiny) and whatever order the caller asks for afterwards.
"""
from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.functions import numeric as N
from lumenscan.functions import status as S
from lumenscan.operators import checks as K
from lumenscan.operators import matching as M
from lumenscan.operators import noise as Z
from lumenscan.operators import quality as Q
from lumenscan.operators import readings as R
from lumenscan.operators import verdict as V
from lumenscan.sources.parameters import noise_parameters
from lumenscan.rulebook import BANDS, INSTRUMENTS, PROFILE_COLLAGEN, RULES, STANDARD_CLASS


@dataclass
class Screening:
    """Everything a screening depends on besides the scans."""
    models: dict[str, dict] = field(default_factory=dict)
    corrections: list[dict] = field(default_factory=list)
    profiles: dict[str, dict] = field(default_factory=lambda: {"collagen": PROFILE_COLLAGEN})
    rules: dict = field(default_factory=lambda: dict(RULES))
    bands: dict = field(default_factory=lambda: dict(BANDS))
    projections: dict = field(default_factory=dict)
    instruments: dict = field(default_factory=lambda: dict(INSTRUMENTS))
    prototypes: np.ndarray | None = None
    prototypes_truncated: np.ndarray | None = None
    consensus_factors: dict[str, float] = field(default_factory=dict)
    recorded_gains: dict = field(default_factory=dict)
    no_b6: tuple = ()
    target: str = STANDARD_CLASS
    cut_plan: bool = False                # write the readings to the checkpoint folder before the rules
    check_input: bool = True              # refuse scans outside the supported grid and join windows

    def specs(self) -> list[dict]:
        return [s for s in M.union_specs(list(self.profiles.values())) if s["model_id"] in self.models]

    def dependencies(self) -> dict[str, str]:
        """Everything a result depends on besides its scan, as content hashes: each document by name, and the tables and
        rules by what they hold. A changed cut, weight or document body gives another key."""
        out = {f"{d['id']}@{d.get('version')}": digest({k: v for k, v in d.items() if k != "origin"}) for d in [*self.models.values(), *self.corrections]}
        for name in ("profiles", "rules", "bands", "projections", "instruments", "prototypes", "prototypes_truncated", "consensus_factors", "recorded_gains", "no_b6", "target", "check_input"):
            out[name] = digest(getattr(self, name))
        return out


def from_parameters(p, **more) -> Screening:
    """A screening under loaded parameter documents (``load_params``), the noise document included."""
    noise = noise_parameters(p.noise or {})
    return Screening(**{**dict(models=p.models, corrections=p.corrections, profiles=p.profiles, rules=p.rules, bands=p.bands, projections=p.projections, instruments=p.instruments), **noise, **more})


def digest(value) -> str:
    """SHA-256 of parameters as JSON with sorted keys; arrays as lists."""
    plain = lambda v: v.tolist() if hasattr(v, "tolist") else sorted(v) if isinstance(v, (set, frozenset)) else str(v)
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=plain).encode()).hexdigest()


def cut(df: DataFrame) -> DataFrame:
    """End the plan here: the rows are written to the cluster's shared checkpoint folder and read back, so the rules are
    planned on their own and a lost executor repeats only them."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            raise ValueError("cut_plan needs spark.checkpoint.dir")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def score(scans: DataFrame, cfg: Screening) -> DataFrame:
    """Scans with every check and one verdict per profile (``verdict_<profile>``, ``sort_<profile>``)."""
    spark = scans.sparkSession
    rules, docs = cfg.rules, list(cfg.models.values())
    has = lambda c: c in scans.columns
    df = scans.withColumn("n_ch", F.col("n") if has("n") else F.size("r"))
    own = F.col("reject_reason") if has("reject_reason") else F.lit(None).cast("string")
    grid_reason = Q.accept_spectrum(F.col("n_ch"), rules["acquisition"]) if cfg.check_input else F.lit(None).cast("string")
    df = df.withColumn("reject_reason", F.coalesce(own, grid_reason))

    if has("format") and has("joins_source"):       # a decoded file: what wrote it decides its class
        df = M.effective_class(df, cfg.instruments)
    not_sample = F.coalesce(F.col("kind") != "sample", F.lit(False)) if has("kind") else F.lit(False)
    df = df.withColumn("listed_only", not_sample & F.col("reject_reason").isNull())

    # which correction, and the noise gains of its layout: keyed lookups only, no spectrum is read for them
    df = M.pick_correction(df, M.correction_table(spark, cfg.corrections), cfg.target)
    if not has("serial_class"):
        df = df.join(M.broadcast_if_small(M.serial_table(spark, cfg.instruments)), "serial", "left")
    stat_req, band_req = Z.statistic_requests(rules), Z.band_requests(cfg.bands)
    model_req = [q for d in docs for q in Z.model_requests(d)]
    requests = stat_req + band_req + model_req
    gains = Z.gain_table(df, requests, cfg.corrections, F.col("n_ch"))

    # as measured: quality and noise, in the JVM
    df = Q.acquisition(df, rules["acquisition"], "r", "sample_dn" if has("sample_dn") else None)
    df = Z.n2(df, tuple(dict.fromkeys([*map(tuple, Z.n2_windows_for(requests)), *K.gate_windows(rules)])))
    df = df.withColumn("unusable", Q.unusable())
    skip = F.col("reject_reason").isNotNull() | F.col("listed_only") | (F.size("unusable") > 0)
    df = df.withColumns({"scored": ~skip, "r": F.when(~skip, F.col("r"))})

    # one kernel pass through the picked correction
    linear, other = [], []
    for d in docs:
        try:
            R.fold_model(d)
            linear.append(d)
        except R.NotLinear:
            other.append(d)
    as_measured = {s["model_id"] for s in cfg.specs() if s.get("reads") == "as_measured"}
    spec = K.band_spec(rules, cfg.bands, cfg.projections) + K.sign_spec(rules) + K.bone_spec(cfg.prototypes, cfg.prototypes_truncated, rules)
    folded = [f for d in linear for _, f in R.fold_model(d)]
    domains = {d["id"]: x for d in linear if (x := R.domain_spec(d)) is not None}
    raw = [f for d in linear if d["id"] in as_measured for _, f in R.fold_model(d)] + [x for i, x in domains.items() if i in as_measured] + K.sign_spec(rules)
    folded += [x for i, x in domains.items() if i not in as_measured]
    unfitted = any(not M.settings_of(d)["fitted"] for d in cfg.corrections)
    raw_spec = raw if (unfitted or as_measured) else []
    df = _other_models(df, other, as_measured, cfg)
    df = R.kernel_pass(df, spec + folded, "r", "readings", raw_spec, cfg.corrections)
    if cfg.cut_plan:
        df = cut(df)
    df = Z.attach_gains(df, gains, F.col("n_ch"))         # after the pass: the gains do not travel through Python

    # models
    pairs_m, pairs_e = [], []
    for d in linear:
        src = "readings_raw" if d["id"] in as_measured else "readings"
        one = R.predict_linear(df, [d], src, "_m")
        df = one.withColumn(f"_m{len(pairs_e)}", F.col("_m")[d["id"]]).drop("_m")
        regions = R.model_regions(d)
        why = F.coalesce(F.when(~F.col("scored"), F.lit("the scan is not scored")), F.lit(None).cast("string") if d["id"] in as_measured else F.col("stream_error"),
                         *[R.eligibility_reason(F.col("n_ch"), *r) for r in regions])
        pairs_e.append(F.when(why.isNull(), S.assessed()).otherwise(S.not_assessed(why)))
    items_m, items_s = [], []
    for i, d in enumerate(linear):
        m = F.col(f"_m{i}")
        ok = pairs_e[i]["state"] == "assessed"
        items_m += [F.lit(d["id"]), F.struct(F.when(ok, m["value"]).alias("value"), F.when(ok, m["linear"]).alias("linear"), F.when(ok, m["components"]).alias("components"))]
        items_s += [F.lit(d["id"]), pairs_e[i]]
    for i, d in enumerate(other):
        p = F.col(f"_o{i}")
        items_m += [F.lit(d["id"]), F.struct(p["value"].alias("value"), p["linear"].alias("linear"), p["components"].alias("components"))]
        items_s += [F.lit(d["id"]), p["status"]]
    mtype = "map<string,struct<value:double,linear:double,components:map<string,double>>>"
    df = df.withColumns({"models": F.create_map(*items_m).cast(mtype) if items_m else F.create_map().cast(mtype),
                         "model_status": F.create_map(*items_s) if items_s else F.create_map().cast("map<string,struct<state:string,reason:string>>")})
    shape, note_above = "struct<T2:double,Q:double,ratio:double,level:string>", next(iter(cfg.profiles.values()), {}).get("domain_note_ratio_above")
    far = {d["id"]: F.when(pairs_e[i]["state"] == "assessed", R.domain_column(d, "readings_raw" if d["id"] in as_measured else "readings")) for i, d in enumerate(linear) if d["id"] in domains}
    far.update({d["id"]: F.col(f"_o{i}")["domain"] for i, d in enumerate(other) if (d.get("domain") or {}).get("method")})
    # the note stands beside a value whose spectrum is less familiar to its model than the profile allows
    noted = {m: N.gt(x["ratio"], note_above) if note_above is not None else F.lit(False) for m, x in far.items()}
    df = df.withColumns({"model_domain": F.create_map(*[x for m, v in far.items() for x in (F.lit(m), v)]).cast(f"map<string,{shape}>") if far else F.create_map().cast(f"map<string,{shape}>"),
                         "domain_notes": F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(m)) for m, v in noted.items()])).cast("array<string>")})
    df = df.drop(*[f"_m{i}" for i in range(len(linear))], *[f"_o{i}" for i in range(len(other))])
    if any(M.settings_of(d)["offsets"] for d in cfg.corrections):
        df = M.add_reader_offsets(df, docs, cfg.corrections)
    corrected = F.col("correction_id").isNotNull() & (F.col("correction_id") != "none")
    df = Z.implied_sd(df, docs, cfg.consensus_factors, cfg.recorded_gains, cfg.no_b6, corrected=corrected) if docs else df.withColumn(
        "model_sd", F.create_map().cast("map<string,struct<sd:double,component_sd:map<string,double>,status:struct<state:string,reason:string>,b6:boolean>>"))
    if docs:
        df = K.check_models_noise(df, [d["id"] for d in docs], rules)

    # what kind of stream this is
    near = Z.standard_like(stat_req, rules["acquisition"]["B6b_signs_gate"]["std_like_within"])
    fitted = M.setting_column(cfg.corrections, "fitted", True)
    df = df.withColumns({"near": F.coalesce(near, F.lit(False)), "uncalibrated": F.col("correction_id").isNull(), "visible_levels_fitted": fitted})
    native = (F.when(F.col("near"), F.lit(K.NEAR_UNCORRECTED))
              .when((F.col("class") == cfg.target) & (F.col("correction_id") == "none"), F.lit(K.NATIVE_SCAN)))
    df = df.withColumn("native_reason", native).withColumn("native", F.col("native_reason").isNotNull())

    # rules
    df = Z.band_sd(df, cfg.bands)
    df = K.check_gates(df, rules)
    df = K.check_longwave(df, rules)
    df = K.check_bone(df, rules)
    df = K.check_evidence(df, rules, cfg.bands)
    df = K.check_pattern(df, rules, cfg.bands)
    df = K.bands_off(df)
    df = K.check_signs(df, rules, heat_as_measured=~F.col("visible_levels_fitted") if unfitted else None)
    df = K.check_foreign_organic(df, rules)
    df = K.check_soft(df, rules)
    df = V.instrument_notes(df)
    for name, profile in cfg.profiles.items():
        df = _profile(df, name, profile, cfg)
    return df.drop("gains")


def _other_models(df: DataFrame, docs: list[dict], as_measured: set, cfg: Screening) -> DataFrame:
    """Models that are not one linear functional (block SNV, transforms of the response, classifiers, rules): their
    own chain on the scan's stream."""
    need_stream = [d for d in docs if d["id"] not in as_measured]
    if need_stream and cfg.corrections:
        df = M.apply_correction(df, cfg.corrections, "r", "_stream")
    elif need_stream:
        df = df.withColumn("_stream", F.col("r"))
    for i, d in enumerate(docs):
        df = _predict_kept(df, d, "r" if d["id"] in as_measured else "_stream", f"_o{i}")
    return df.drop("_stream")


def _predict_kept(df: DataFrame, doc: dict, col: str, out: str) -> DataFrame:
    """``predict`` drops scratch columns that start with an underscore; keep this job's own."""
    names = {c: f"keep{c}" for c in df.columns if c.startswith("_") and c != col}
    work = df.withColumnsRenamed(names) if names else df
    if col.startswith("_"):
        work = work.withColumnRenamed(col, "stream_in")
    work = R.predict(work, doc, "stream_in" if col.startswith("_") else col, "prediction_out")
    work = work.withColumnRenamed("prediction_out", out)
    if col.startswith("_"):
        work = work.withColumnRenamed("stream_in", col)
    return work.withColumnsRenamed({v: k for k, v in names.items()}) if names else work


def _profile(df: DataFrame, name: str, profile: dict, cfg: Screening) -> DataFrame:
    specs = [s for s in profile.get("models", []) if s["model_id"] in cfg.models]
    profile = {**profile, "models": specs}
    lead = next((s for s in specs if s["role"] == "verdict_input"), None)
    second = next((s for s in specs if s["role"] == "second_opinion"), None)
    none = lambda t: F.lit(None).cast(t)
    df = df.withColumns({
        "m": N.finite(F.col("models")[lead["model_id"]]["value"]) if lead else none("double"),
        "components": F.col("models")[lead["model_id"]]["components"] if lead else none("map<string,double>"),
        "m_sd": F.col("model_sd")[lead["model_id"]]["sd"] if lead else none("double")})
    df = (V.pattern_verdict(df, profile, out="verdict") if profile["kind"].startswith("zooms") else V.collagen_verdict(df, profile, out="verdict"))
    df = V.override_verdict(df, profile)
    if second:
        shown = M.model_shown(second, F.col("native"), F.col("class"))
        value = F.when(shown, N.finite(F.col("models")[second["model_id"]]["value"]))
        df = V.second_opinion(df, profile, value, gap=_gap(cfg))
    df = df.withColumn("verdict", F.when(F.col("scored"), F.col("verdict")).otherwise(V.rejected_verdict(F.col("reject_reason"), F.col("unusable"), F.col("listed_only"))))
    for c in ("m", "m_sd"):
        df = df.withColumn(c, F.when(F.col("scored"), F.col(c)))
    df = V.sort_key(df, profile, S=F.when(F.col("scored"), F.col("evidence.S")))
    if len(cfg.profiles) == 1:
        return df
    return (df.withColumn(f"verdict_{name}", F.col("verdict"))
            .withColumn(f"sort_{name}", F.struct("sort_group", "sort_penalty", "sort_value"))
            .drop("verdict", "sort_group", "sort_penalty", "sort_value"))


def _gap(cfg: Screening) -> Column:
    out = F.lit(None).cast("double")
    for d in cfg.corrections:
        g = M.settings_of(d)["gap"]
        if g is not None:
            out = F.when(F.col("correction_id") == d["id"], F.lit(g)).otherwise(out)
    return out


def predictions(scans: DataFrame, cfg: Screening, reads: dict[str, str] | None = None) -> DataFrame:
    """(scan, model, value, sd, correction, status): every shown model on every scan, without the rules.

    Each model has its own target class and stream policy, so it is one keyed lookup and one read per model; the
    models that share a target share the correction pick and the kernel pass.
    """
    frames = []
    groups: dict[tuple, list[dict]] = {}
    for d in cfg.models.values():
        inst = d.get("instrument", {})
        key = ("as_measured",) if (reads or {}).get(d["id"]) == "as_measured" else (inst.get("trained_on_class", cfg.target), *inst.get("also_valid_for", []))
        groups.setdefault(key, []).append(d)
    for key, docs in groups.items():
        df = scans.withColumn("n_ch", F.col("n") if "n" in scans.columns else F.size("r"))
        if key[0] == "as_measured":
            df = df.withColumns({"correction_id": F.lit("none"), "correction_id_scope": F.lit("as_measured")})
        else:
            df = M.pick_correction(df, M.correction_table(scans.sparkSession, cfg.corrections), key[0], key[1:])
        req = [q for d in docs for q in Z.model_requests(d)]
        gains = Z.gain_table(df, req, cfg.corrections, F.col("n_ch"))
        df = Z.n2(df, tuple(Z.n2_windows_for(req)))
        linear = [d for d in docs if _folds(d)]
        other = [d for d in docs if not _folds(d)]
        df = _other_models(df, other, {d["id"] for d in docs} if key[0] == "as_measured" else set(), cfg)
        df = R.kernel_pass(df, [f for d in linear for _, f in R.fold_model(d)], "r", "readings", corrections=cfg.corrections)
        df = Z.attach_gains(df, gains, F.col("n_ch"))
        df = R.predict_linear(df, linear, out="models") if linear else df.withColumn("models", F.create_map().cast("map<string,struct<value:double,linear:double,components:map<string,double>>>"))
        for i, d in enumerate(other):
            p = F.col(f"_o{i}")
            df = df.withColumn("models", F.map_concat("models", F.create_map(F.lit(d["id"]), F.struct(
                p["value"].alias("value"), p["linear"].alias("linear"), p["components"].alias("components")))))
        df = M.add_reader_offsets(df, docs, cfg.corrections)
        corrected = F.col("correction_id").isNotNull() & (F.col("correction_id") != "none")
        df = Z.implied_sd(df, docs, cfg.consensus_factors, cfg.recorded_gains, cfg.no_b6, corrected=corrected)
        rows = []
        for d in docs:
            why = F.coalesce(*[R.eligibility_reason(F.col("n_ch"), *r) for r in R.model_regions(d)], F.col("stream_error")) if d["kind"] != "rule" else F.col("stream_error")
            v = F.when(why.isNull(), F.col("models")[d["id"]]["value"])
            rows.append(F.struct(F.lit(d["id"]).alias("model_id"), v.alias("value"), F.col("model_sd")[d["id"]]["sd"].alias("sd"),
                                 F.when(why.isNull(), S.assessed()).otherwise(S.not_assessed(why)).alias("status")))
        frames.append(df.select("scan_id", F.col("correction_id"), F.explode(F.array(*rows)).alias("p")).select("scan_id", "correction_id", "p.*"))
    return M.union_wide(frames)


def _folds(doc: dict) -> bool:
    try:
        R.fold_model(doc)
        return True
    except R.NotLinear:
        return False


def analyse(scans: DataFrame, cfg: Screening, order: str | None = None) -> DataFrame:
    """``score`` for one profile, optionally in most-promising or path order."""
    if len(cfg.profiles) != 1:
        cfg = replace(cfg, profiles=dict([next(iter(cfg.profiles.items()))]))
    out = score(scans, cfg)
    if order == "promising":
        from lumenscan.operators.ranking import order_promising
        return order_promising(out, "scan_id")
    return out.orderBy("scan_id") if order == "path" else out
