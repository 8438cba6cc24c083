"""Parameter documents: models, corrections, band and noise tables, rules, profiles, instruments, reference levels.

Documents are read and selected as a table; the selected ones become small dimension tables and driver-side
dictionaries. How many there are is checked, because they are held on the driver.
"""
from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.functions.records import body_hash
from lumenscan.operators.matching import select_versions
from lumenscan.rulebook import BANDS, INSTRUMENTS, RULES

MAX_DOCUMENTS = 20_000
MAX_BYTES = 256 * 1024 * 1024
HEAD = "format string, id string, version string, status string, kind string, check string, analysis string"


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """documents(path, origin, format, id, version, status, kind, check, analysis, sha256, body_sha256, doc). The
    first path is the bundled set (origin 0), later ones are the user's."""
    parts = []
    for origin, p in enumerate(paths):
        raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(p))
        parts.append(raw.select("path", F.lit(origin).alias("origin"), F.sha2("content", 256).alias("sha256"),
                                F.decode("content", "UTF-8").alias("doc")))
    docs = parts[0]
    for d in parts[1:]:
        docs = docs.unionByName(d)
    head = F.from_json("doc", HEAD, {"mode": "PERMISSIVE"})
    return (docs.withColumn("_h", head).select("path", "origin", F.element_at(F.split("_h.format", "/"), -1).alias("format"),
                                               *[F.col(f"_h.{k}").alias(k) for k in ("id", "version", "status", "kind", "check", "analysis")],
                                               "sha256", "doc").where("format is not null"))


def with_body_hash(documents: DataFrame) -> DataFrame:
    return documents.withColumn("body_sha256", body_hash("doc"))


def parse_strict(text: str):
    """JSON with finite numbers only."""
    def refuse(c):
        raise ValueError(f"{c} in JSON")

    def number(s):
        v = float(s)
        if not math.isfinite(v):
            raise ValueError("non-finite number")
        return v
    return json.loads(text, parse_constant=refuse, parse_float=number)


@dataclass
class ParamTables:
    documents: DataFrame
    models: dict = field(default_factory=dict)
    corrections: list = field(default_factory=list)
    rules: dict = field(default_factory=lambda: dict(RULES))
    profiles: dict = field(default_factory=dict)
    bands: dict = field(default_factory=lambda: dict(BANDS))
    projections: dict = field(default_factory=dict)
    noise: dict = field(default_factory=dict)
    instruments: dict = field(default_factory=lambda: dict(INSTRUMENTS))
    reference_levels: list = field(default_factory=list)
    errors: list = field(default_factory=list)

    def model_table(self, spark: SparkSession) -> DataFrame:
        rows = [(m["id"], str(m.get("version")), m["kind"], m["instrument"].get("trained_on_class"), list(m["instrument"].get("also_valid_for", [])),
                 json.dumps(m.get("preprocessing", [])), ((m.get("output") or {}).get("y_transform") or {}).get("type", "none")) for m in self.models.values()]
        return spark.createDataFrame(rows, "model_id string, version string, kind string, trained_on_class string, also_valid_for array<string>, chain string, y_transform string")

    def coefficient_table(self, spark: SparkSession) -> DataFrame:
        """model_coef(model_id, component, wl, coef, x_center, offset)."""
        rows = []
        for m in self.models.values():
            if m["kind"] == "regression":
                r = m["regression"]
                c = r.get("x_center") or [0.0] * len(r["coefficients"])
                rows += [(m["id"], None, float(w), float(b), float(x), float(r["offset"])) for w, b, x in zip(m["features"]["wavelengths_nm"], r["coefficients"], c)]
            elif m["kind"] == "consensus":
                for comp in m["consensus"]["components"]:
                    f = comp["feature"]
                    rows += [(m["id"], comp["name"], float(w), float(b), 0.0, float(f.get("offset", 0.0))) for w, b in zip(f["wavelengths_nm"], f["weights"])]
        return spark.createDataFrame(rows, "model_id string, component string, wl double, coef double, x_center double, offset double")

    def band_table(self, spark: SparkSession) -> DataFrame:
        rows = [(b, float(e["centre_nm"]), float(e["half_width_nm"]), float(e["weight"]), float(e["faint_u"]), int(e.get("u_sign", 1)),
                 b if b in self.projections else None) for b, e in self.bands.items()]
        return spark.createDataFrame(rows, "band string, centre_nm double, half_width_nm double, weight double, faint_u double, u_sign int, projection string")


def load_params(spark: SparkSession, paths: list[str], pins: dict[str, str] | None = None) -> ParamTables:
    """Select the active documents and turn them into dimensions. A document that is not valid JSON with finite numbers
    is listed in ``errors`` and not used."""
    docs = read_documents(spark, paths)
    chosen = select_versions(docs.where(~F.col("format").isin("transfer")), pins).unionByName(docs.where(F.col("format") == "transfer"))
    size = chosen.agg(F.count("*").alias("n"), F.sum(F.length("doc")).alias("b")).first()
    if size["n"] > MAX_DOCUMENTS or (size["b"] or 0) > MAX_BYTES:
        raise ValueError(f"{size['n']} parameter documents ({size['b']} bytes) are too many to hold as parameters")
    out = ParamTables(documents=docs)
    for row in chosen.select("format", "origin", "path", "doc").collect():
        try:
            d = parse_strict(row["doc"])
        except ValueError as e:
            out.errors.append((row["path"], str(e)))
            continue
        d["origin"] = row["origin"]
        kind = row["format"]
        if kind == "model":
            out.models[d["id"]] = d
        elif kind == "transfer":
            out.corrections.append(d)
        elif kind == "engine_check":
            merged = dict(RULES.get(d["check"], {}))
            merged.update(d["parameters"])
            out.rules[d["check"]] = merged
        elif kind == "analysis_profile":
            out.profiles[d["analysis"]] = d["parameters"]
        elif kind == "bands":
            out.bands, out.projections = band_parameters(d)
        elif kind == "noise_gains":
            out.noise = d
        elif kind == "instrument":
            out.instruments = instrument_parameters(d)
        elif kind == "reference_set":
            out.reference_levels = [{"label": lv["label"], "absorbance": lv["absorbance"], "n": lv.get("n")} for lv in d["levels"]]
    gate = out.rules["acquisition"].get("B6b_signs_gate", {})
    own = gate.get("uncorrected")
    if own:         # the acquisition report shows one cut: the lowest of the signs'
        cuts = [float(e["n2_above"]) for e in own.values() if e]
        if cuts:
            gate["uncorrected_n2_above"] = min(cuts)
    for key in ("default_joins_nm", "join_jump_clear", "join_jump_min"):
        out.rules["acquisition"].setdefault(key, RULES["acquisition"][key])
    for key in ("B8_splice_step", "B2_saturation"):
        out.rules["acquisition"][key] = {**RULES["acquisition"][key], **out.rules["acquisition"][key]}
    if "charred" in out.rules["heat"] and "edge50" in out.rules["heat"]["charred"]:
        c = out.rules["heat"]["charred"]
        out.rules["heat"]["charred"] = {**c["edge50"], "edge50_at_least_nm": c["edge50_at_least_nm"]}
    soft = out.rules["signs"].get("soft_tier")
    if soft and "eligibility" in soft:
        e = soft["eligibility"]
        out.rules["signs"]["soft_tier"] = {**soft, "otherwise_n2_window_nm": e["otherwise_n2_window_nm"], "otherwise_sd_at_most": e["otherwise_sd_at_most"]}
    return out


def noise_parameters(doc: dict) -> dict:
    """What a noise document says about models: factors of consensus models, recorded terms, and models without the noise check."""
    models = doc.get("models") or {}
    return {"consensus_factors": {m: float(v["factor"]) for m, v in (doc.get("consensus") or {}).items()},
            "recorded_gains": {m: v["recorded"]["terms"] for m, v in models.items() if (v or {}).get("recorded")},
            "no_b6": tuple(sorted(m for m, v in models.items() if (v or {}).get("b6") is False))}


def band_parameters(doc: dict) -> tuple[dict, dict]:
    bands = doc["bands"]
    if isinstance(bands, list):
        bands = {b.get("id") or b.get("name"): b for b in bands}
    out, projections = {}, {}
    for b, e in bands.items():
        r = e.get("readability") or {}
        out[b] = {k: e[k] for k in ("centre_nm", "half_width_nm", "weight") if k in e}
        out[b].update(faint_u=e.get("faint_u", 0.0), u_sign=e.get("u_sign", 1))
        if r.get("noise_window_nm"):
            out[b].update(noise_window_nm=tuple(r["noise_window_nm"]), envelope_factor=r.get("envelope_factor", 1.0))
        if e.get("projection"):
            p = doc["projections"][e["projection"]]
            scale = doc["kernels"][e["kernel"]]["scale"]
            projections[b] = {"window_nm": p["window_nm"], "direction": p["direction"], "centre": p["centre"], "scale": scale}
    return out, projections


def instrument_parameters(doc: dict) -> dict:
    classes = []
    for c, v in doc["classes"].items():
        h = v.get("header_hint") or {}
        classes.append({"class": c, "display_name": v.get("display_name"), "serials": v.get("serials", []), "swir_gain": h.get("swir_gain"),
                        "file_format": h.get("file_format") or [], "unless_joins_nm": h.get("unless_joins_nm")})
    return {"default_class": doc["default_class"], "classes": classes}
