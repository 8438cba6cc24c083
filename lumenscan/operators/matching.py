"""Joins with the small tables: which class, which correction, which models apply to a scan."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.functions import numeric as N
from lumenscan.functions.records import version_parts
from lumenscan.operators.arrow import linear_pass
from lumenscan.operators.block_ops import Chain
from lumenscan.operators.weights import OperatorError
from lumenscan.rulebook import INSTRUMENTS, STANDARD_CLASS

BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only for a table counted to be small; a larger one takes the ordinary shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# ---------------------------------------------------------------------------------------------- instruments
def serial_table(spark: SparkSession, instruments: dict = INSTRUMENTS) -> DataFrame:
    listed: dict[int, str] = {}         # one row per serial: the class that lists it first
    for c in instruments["classes"]:
        for s in c["serials"]:
            listed.setdefault(int(s), c["class"])
    rows = list(listed.items())
    return spark.createDataFrame(rows, "serial bigint, serial_class string")


def gain_hint(swir1: Column, swir2: Column, instruments: dict = INSTRUMENTS) -> Column:
    """The class whose SWIR gain range holds both gains (the ranges are a handful of parameters: no join)."""
    out = F.lit(None).cast("string")
    for c in reversed(instruments["classes"]):
        if c["swir_gain"]:
            lo, hi = c["swir_gain"]
            out = F.when(swir1.between(lo, hi) & swir2.between(lo, hi), F.lit(c["class"])).otherwise(out)
    return out


def preset_class(scans: DataFrame, serials: DataFrame, instruments: dict = INSTRUMENTS, default: str | None = None) -> DataFrame:
    """``class`` and ``class_source`` per scan: the user's choice, else the listed serial, else the gains' hint."""
    out = scans.join(broadcast_if_small(serials), "serial", "left")
    hint = gain_hint(F.col("swir1_gain"), F.col("swir2_gain"), instruments) if "swir1_gain" in scans.columns else F.lit(None).cast("string")
    user = F.col("user_class") if "user_class" in scans.columns else F.lit(None).cast("string")
    base = default or instruments["default_class"]
    return out.withColumns({
        "class": F.coalesce(user, F.col("serial_class"), hint, F.lit(base)),
        "class_source": F.when(user.isNotNull(), F.lit("user")).when(F.col("serial_class").isNotNull(), F.lit("preset"))
        .when(hint.isNotNull(), F.lit("header")).otherwise(F.lit("default"))})


def effective_class(df: DataFrame, instruments: dict = INSTRUMENTS, default: str | None = None) -> DataFrame:
    """A file another instrument wrote is scored as that instrument's class, whatever the user chose.

    The file's format names the class, unless the joins found in the file are exactly the class's excluded pair.
    """
    by_format = F.lit(None).cast("string")
    for c in reversed(instruments["classes"]):
        for fmt in c["file_format"]:
            cond = F.col("format") == fmt
            if c["unless_joins_nm"] is not None:
                same = (F.col("joins_source") != "default") & (F.col("joins_nm") == F.lit([float(j) for j in c["unless_joins_nm"]]))
                cond = cond & ~F.coalesce(same, F.lit(False))
            by_format = F.when(cond, F.lit(c["class"])).otherwise(by_format)
    own = F.col("class") if "class" in df.columns else F.lit(None).cast("string")
    own = F.coalesce(own, F.lit(default or instruments["default_class"]))
    source = F.col("class_source") if "class_source" in df.columns else F.lit("user")
    return df.withColumn("_f", by_format).withColumns({
        "class": F.coalesce(F.col("_f"), own),
        "class_source": F.when(F.col("_f").isNotNull() & (F.col("_f") != own), F.lit("file_format")).otherwise(source),
    }).drop("_f")


def collection_class(scans: DataFrame, serials: DataFrame, collection: str = "collection", order: str = "seq") -> DataFrame:
    """Per collection: its first serial with a known class (else its first serial), which presets the whole set."""
    known = scans.where(F.col("serial").isNotNull()).join(broadcast_if_small(serials), "serial", "left")
    agg = known.groupBy(collection).agg(
        F.min_by(F.struct("serial", "serial_class"), F.when(F.col("serial_class").isNotNull(), F.col(order))).alias("k"),
        F.min_by("serial", order).alias("any"))
    return agg.select(collection, F.coalesce(F.col("k.serial"), F.col("any")).alias("serial"),
                      F.col("k.serial_class").alias("class"))


# ---------------------------------------------------------------------------------------------- corrections
def select_active(docs: list[dict]) -> list[dict]:
    """The newest active version of each correction id, bundled before user files, then by id."""
    def key(d):
        return [int(x) for x in str(d["version"]).split("-")[0].split(".")]
    best: dict[str, dict] = {}
    for d in docs:
        if d.get("status", "active") != "active":
            continue
        old = best.get(d["id"])
        if old is None or key(d) > key(old) or (key(d) == key(old) and d.get("origin", 0) < old.get("origin", 0)):
            best[d["id"]] = d
    return sorted(best.values(), key=lambda d: (d.get("origin", 0), d["id"]))


def correction_table(spark: SparkSession, docs: list[dict]) -> DataFrame:
    rows = [(d["id"], d["source_class"], None if d.get("source_serial") is None else str(d["source_serial"]),
             d["target_class"], i) for i, d in enumerate(select_active(docs))]
    return spark.createDataFrame(rows, "correction_id string, source_class string, source_serial string, "
                                       "target_class string, rank int")


def pick_correction(scans: DataFrame, corrections: DataFrame, target: str = STANDARD_CLASS, also_valid=(),
                    out: str = "correction_id") -> DataFrame:
    """``out``: the correction a scan is read through for a target class, 'none' for the scan as measured, or null
    when none is available. A file for the scan's own unit wins, even for the target class itself; then 'none' where
    the class is already valid; then the class-wide file. Both lookups are keyed joins on one row per key."""
    c = corrections.where(F.col("target_class") == target)
    unit = (c.where(F.col("source_serial").isNotNull()).groupBy("source_class", "source_serial")
            .agg(F.min_by("correction_id", "rank").alias("_unit")))
    whole = c.where(F.col("source_serial").isNull()).groupBy("source_class").agg(F.min_by("correction_id", "rank").alias("_whole"))
    df = scans.withColumn("_serial", F.col("serial").cast("string"))
    u, w = broadcast_if_small(unit), broadcast_if_small(whole)
    df = df.join(u, (df["class"] == u["source_class"]) & (df["_serial"] == u["source_serial"]), "left").drop("source_class", "source_serial")
    df = df.join(w, df["class"] == w["source_class"], "left").drop("source_class")
    native = F.col("class").isin(target, *also_valid)
    return df.withColumns({
        out: F.coalesce(F.col("_unit"), F.when(native, F.lit("none")), F.col("_whole")),
        f"{out}_scope": F.when(F.col("_unit").isNotNull(), F.lit("unit")).when(native, F.lit("native"))
        .when(F.col("_whole").isNotNull(), F.lit("class")).otherwise(F.lit("missing"))}).drop("_serial", "_unit", "_whole")


def pick_reader_correction(scans: DataFrame, corrections: DataFrame, model: dict, reads: str | None = None,
                           out: str = "correction_id") -> DataFrame:
    """The stream one reader reads: an 'as_measured' reader never gets a correction."""
    if reads == "as_measured":
        return scans.withColumns({out: F.lit("none"), f"{out}_scope": F.lit("as_measured")})
    inst = model["instrument"]
    return pick_correction(scans, corrections, inst["trained_on_class"], inst.get("also_valid_for", []), out)


def apply_correction(df: DataFrame, docs: list[dict], col: str = "r", out: str = "stream",
                     pick: str = "correction_id") -> DataFrame:
    """``out``: the corrected spectrum. One Arrow pass over the scans that have a correction, keyed by its id; scans
    read as measured pass by unchanged. A correction that fails, or leaves the scan's grid, gives null."""
    ops = {d["id"]: (d["operator"] if isinstance(d["operator"], list) else [d["operator"]]) for d in docs}
    df = df.withColumn(out, F.col(col))
    had_error = "error" in df.columns
    plain = F.col(pick).isNull() | (F.col(pick) == "none")
    # the correction id rides in the layout key, so every block of an Arrow batch has one correction
    names = sorted(ops)
    code = F.coalesce(F.array_position(F.lit(names or [""]), F.col(pick)), F.lit(0))
    keyed = df.withColumns({"_joins": F.col("joins_nm"),
                            "joins_nm": F.when(~plain, F.concat(F.array(code.cast("double")), F.col("joins_nm"))).otherwise(F.array(F.lit(-1.0)))})

    def build(wl, joins):
        if joins and joins[0] == -1.0:
            return Chain([], wl, ())
        if not joins or joins[0] == 0:
            raise OperatorError("unknown correction")
        chain = Chain(ops[names[int(joins[0]) - 1]], wl, joins[1:])
        if len(chain.wl) != len(wl) or abs(chain.wl - wl).max() > 1e-9:
            raise OperatorError("the correction leaves the scan's grid")
        return chain
    if not names:
        return df.withColumn(out, F.when(plain, F.col(out)))
    done = linear_pass(keyed, build, out).withColumn("joins_nm", F.col("_joins")).drop("_joins")
    return done if had_error else done.drop("error")


def settings_of(doc: dict | None) -> dict:
    """Visible levels fitted (the default), own second-opinion gap, and per-reader offsets of a correction."""
    prov = (doc or {}).get("provenance") or {}
    gap = prov.get("second_opinion_gap")
    return {"fitted": prov.get("visible_levels", "fitted") == "fitted", "gap": None if gap is None else float(gap["points"]),
            "offsets": {k: float(v) for k, v in ((doc or {}).get("reader_offsets") or {}).items()},
            "provisional": bool(doc is not None and prov.get("provisional", doc.get("provisional", True)))}


def setting_column(docs: list[dict], what: str, default, pick: str = "correction_id") -> Column:
    """One setting of the scan's correction as a column."""
    out = F.lit(default)
    for d in docs:
        v = settings_of(d)[what]
        if v != default and v is not None:
            out = F.when(F.col(pick) == d["id"], F.lit(v)).otherwise(out)
    return out


def add_reader_offsets(df: DataFrame, model_docs: list[dict], corrections: list[dict], models: str = "models",
                       pick: str = "correction_id") -> DataFrame:
    """Add a correction's per-reader offsets to the readings it makes; a consensus is the median of its components
    after their offsets."""
    pairs = []
    for m in model_docs:
        old = F.col(models)[m["id"]]
        if m.get("kind") == "consensus":
            comps = {}
            for c in m["consensus"]["components"]:
                comps[c["name"]] = old["components"][c["name"]] + _offset(corrections, c.get("id"), pick)
            touched = any(c.get("id") in settings_of(d)["offsets"] for d in corrections for c in m["consensus"]["components"])
            if touched:
                from lumenscan.operators.readings import median_of
                new = F.struct(median_of(list(comps.values())).alias("value"), old["linear"].alias("linear"),
                               F.create_map(*[x for n, v in comps.items() for x in (F.lit(n), v)]).alias("components"))
            else:
                new = old
        else:
            new = F.struct((old["value"] + _offset(corrections, m["id"], pick)).alias("value"),
                           old["linear"].alias("linear"), old["components"].alias("components"))
        pairs += [F.lit(m["id"]), new]
    return df.withColumn(models, F.create_map(*pairs)) if pairs else df


def _offset(corrections: list[dict], model_id, pick: str) -> Column:
    out = F.lit(0.0)
    for d in corrections:
        v = settings_of(d)["offsets"].get(model_id)
        if v:
            out = F.when(F.col(pick) == d["id"], F.lit(v)).otherwise(out)
    return out


# ---------------------------------------------------------------------------------------------- profiles
def model_shown(spec: dict, native: Column, cls: Column) -> Column:
    """Whether a profile's model is computed and shown for a scan."""
    if spec.get("role") == "verdict_input":
        return F.lit(True)
    when = spec.get("shown_for")
    if when is not None:
        return F.lit(True) if when == "every_scan" else ~native if when == "non_native" else F.lit(False)
    return F.coalesce(cls.isin(*spec.get("shown_for_classes", []) or [""]), F.lit(False))


def second_opinion_applies(so: dict, native: Column, cls: Column) -> Column:
    return model_shown({"shown_for": so.get("streams"), "shown_for_classes": so.get("classes", [])}, native, cls)


def shown_models(df: DataFrame, specs: list[dict], native: str = "native") -> DataFrame:
    """One row per scan and shown model (key, model_id, role)."""
    items = [F.struct(F.lit(s["key"]).alias("key"), F.lit(s["model_id"]).alias("model_id"), F.lit(s["role"]).alias("role"),
                      model_shown(s, F.col(native), F.col("class")).alias("shown")) for s in specs]
    out = df.withColumn("_m", F.explode(F.array(*items)))
    return out.where("_m.shown").select("*", "_m.key", "_m.model_id", "_m.role").drop("_m")


def union_specs(profiles: list[dict]) -> list[dict]:
    """The profiles' model lists joined; the first profile wins per key."""
    out: dict[str, dict] = {}
    for p in profiles:
        for s in p.get("models", []):
            out.setdefault(s["key"], s)
    return list(out.values())


def model_union(spark: SparkSession, profiles: list[dict]) -> DataFrame:
    """``union_specs`` as a table (position kept)."""
    rows = [(i, s["key"], s["model_id"], s["role"]) for i, s in enumerate(union_specs(profiles))]
    return spark.createDataFrame(rows, "pos int, key string, model_id string, role string")


# ---------------------------------------------------------------------------------------------- pairs and sets
def pair_scans(a: DataFrame, b: DataFrame, on: str, value: str = "value") -> DataFrame:
    """The same object measured twice: one row per pair with both readings and their difference."""
    left = a.select(on, F.col(value).alias(f"{value}_a"))
    right = b.select(on, F.col(value).alias(f"{value}_b"))
    return left.join(right, on).withColumn("difference", F.col(f"{value}_b") - F.col(f"{value}_a"))


def union_wide(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns a frame lacks are null. Column order is first-seen order."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def split_cases(cases: DataFrame, public: DataFrame, key: str = "spectrum_sha256") -> tuple[DataFrame, DataFrame]:
    """(public, private) cases by spectrum hash; a case without a hash is public."""
    hashes = public.select(key).distinct()
    known = cases.join(hashes, key, "left_semi")
    return known.unionByName(cases.where(F.col(key).isNull())), cases.where(F.col(key).isNotNull()).join(hashes, key, "left_anti")


def select_versions(df: DataFrame, pins: dict[str, str] | None = None, keys=("format", "id")) -> DataFrame:
    """Per (format, id) the pinned version, else the highest active one; bundled before user; withdrawn never.

    A keyed maximum over one ordering struct: partial aggregation on the map side, no window, no skew.
    """
    pin = F.lit(None).cast("string")
    for k, v in (pins or {}).items():
        pin = F.when(F.col("id") == k, F.lit(v)).otherwise(pin)
    live = df.where(F.coalesce(F.col("status"), F.lit("active")) == "active").withColumn("_pin", pin)
    live = live.where(F.col("_pin").isNull() | (F.col("_pin") == F.col("version"))).drop("_pin")
    rank = F.struct(version_parts(F.col("version")).alias("v"), (-F.coalesce(F.col("origin"), F.lit(0))).alias("o"))
    cols = [c for c in df.columns if c not in keys]
    best = live.groupBy(*keys).agg(F.max_by(F.struct(*cols), rank).alias("_b"))
    return best.select(*keys, *[F.col("_b")[c].alias(c) for c in cols]).select(*df.columns)
