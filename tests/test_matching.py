import pytest
from pyspark.sql import functions as F

from lumenscan.operators import evaluate as EV
from lumenscan.operators import matching as M
from lumenscan.operators import ranking as RK
from lumenscan.operators import sequencing as SQ
from conftest import by_id

STD, HI = "asd.labspec4.std", "asd.labspec4.hires"


def doc(i, src, dst=STD, serial=None, version="1.0.0", origin=0, status="active", **extra):
    return {"id": i, "version": version, "source_class": src, "target_class": dst, "source_serial": serial, "origin": origin, "status": status, "operator": [], **extra}


def test_correction_priority(spark):
    docs = [doc("wide", HI), doc("wide_user", HI, origin=1), doc("unit", HI, serial=7), doc("unit_user", HI, serial="7", origin=1), doc("own", STD, serial=9), doc("old", "trek", version="0.9.0"), doc("old", "trek", version="0.10.0", dst="other"),
            doc("gone", "fs3", status="withdrawn")]
    assert [d["version"] for d in M.select_active(docs) if d["id"] == "old"] == ["0.10.0"]
    df = spark.createDataFrame([("a", HI, None), ("b", HI, 7), ("c", HI, 8), ("d", STD, None), ("e", STD, 9), ("f", "trek", None), ("g", "fs3", None), ("h", "also", 1)], "scan_id string, class string, serial bigint")
    got = by_id(M.pick_correction(df, M.correction_table(spark, docs), STD, ["also"]), "correction_id", "correction_id_scope")
    assert got == {"a": ("wide", "class"), "b": ("unit", "unit"), "c": ("wide", "class"), "d": ("none", "native"), "e": ("own", "unit"), "f": (None, "missing"), "g": (None, "missing"), "h": ("none", "native")}
    model = {"instrument": {"trained_on_class": STD}}
    got = by_id(M.pick_reader_correction(df, M.correction_table(spark, docs), model, "as_measured"), "correction_id")
    assert set(got.values()) == {"none"}
    assert M.settings_of(doc("x", HI, provenance={"visible_levels": "not_fitted", "second_opinion_gap": {"points": 2.0, "n_scans": 20}})) == {"fitted": False, "gap": 2.0, "offsets": {}, "provisional": True}


def test_classes(spark):
    df = spark.createDataFrame([("a", 28404, 10, 10, None), ("b", 1, 10, 10, None), ("c", 1, 200, 10, None), ("d", 28404, 1, 1, "x"), ("e", None, None, None, None)], "scan_id string, serial bigint, swir1_gain int, swir2_gain int, user_class string")
    got = by_id(M.preset_class(df, M.serial_table(spark)), "class", "class_source")
    assert got == {"a": (STD, "preset"), "b": (HI, "header"), "c": (STD, "default"), "d": ("x", "user"), "e": (STD, "default")}
    f = spark.createDataFrame([("a", "as8", [1000.0, 1800.0], "header"), ("b", "as7", [1000.0, 1800.0], "header"), ("c", "as7", [1000.0, 1785.0], "reference_dn"), ("d", "as7", [1000.0, 1800.0], "default"), ("e", "legacy", [1000.0, 1800.0], "default")],
                              "scan_id string, format string, joins_nm array<double>, joins_source string").withColumn("class", F.lit(HI))
    got = by_id(M.effective_class(f), "class", "class_source")
    assert got == {"a": (HI, "user"), "b": (HI, "user"), "c": ("asd.trek", "file_format"), "d": ("asd.trek", "file_format"), "e": ("asd.fieldspec3", "file_format")}


def test_reader_offsets_and_median(spark):
    cons = {"id": "c", "kind": "consensus", "consensus": {"components": [{"name": n, "id": n} for n in "xyz"]}}
    lin = {"id": "l", "kind": "regression"}
    df = spark.createDataFrame([("a", "k"), ("b", "none")], "scan_id string, correction_id string").withColumn(
        "models", F.expr("map('c', named_struct('value', 2D, 'linear', CAST(NULL AS double), 'components', map('x', 1D, 'y', 2D, 'z', 3D)), 'l', named_struct('value', 5D, 'linear', 5D, 'components', CAST(NULL AS map<string,double>)))"))
    got = by_id(M.add_reader_offsets(df, [cons, lin], [doc("k", HI, reader_offsets={"x": 4.0, "l": -1.0})]), "models")
    assert (got["a"]["c"].value, got["a"]["l"].value, got["b"]["c"].value, got["b"]["l"].value) == (3.0, 4.0, 2.0, 5.0)


def test_versions_and_pins(spark):
    df = spark.createDataFrame([("model", "a", "1.9.0", "active", 0), ("model", "a", "1.10.0", "active", 1), ("model", "a", "1.10.0", "active", 0), ("model", "a", "2.0.0", "withdrawn", 0), ("model", "b", "1.0", None, 1), ("bands", "a", "0.1", "active", 0)],
                               "format string, id string, version string, status string, origin int")
    got = {(r.format, r.id): (r.version, r.origin) for r in M.select_versions(df).collect()}
    assert got == {("model", "a"): ("1.10.0", 0), ("model", "b"): ("1.0", 1), ("bands", "a"): ("0.1", 0)}
    assert {(r.format, r.version) for r in M.select_versions(df, {"a": "1.9.0"}).where("id = 'a'").collect()} == {("model", "1.9.0")}


def test_skewed_keys_rank_as_plain_windows(spark):
    from pyspark.sql import Window as W
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"), F.floor(F.col("id") / 97).alias("day"), F.pmod(F.hash("id"), F.lit(1000)).alias("t"),
                                  F.floor(F.pmod(F.xxhash64("id"), F.lit(3))).alias("v"))
    w = W.partitionBy("key").orderBy("day", "t", "id")
    rank = SQ.row_numbers(df, ["key"], F.col("day"), [F.col("day"), F.col("t"), F.col("id")]).join(df.select("id", F.row_number().over(w).alias("want")), "id")
    assert rank.where("rank <> want").count() == 0 and rank.count() == 3000
    prev = F.lag("v").over(w)
    chg = df.withColumn("c", F.when(prev.isNull() | (prev != F.col("v")), 1).otherwise(0)).select("id", F.sum("c").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("want"))
    rev = SQ.change_counts(df, ["key"], F.col("day"), [F.col("day"), F.col("t"), F.col("id")], "v").join(chg, "id")
    assert rev.where("revision <> want").count() == 0 and rev.count() == 3000
    top = SQ.top_k(df, ["key"], [F.col("t").desc(), F.col("id")], 4)
    want = df.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy(F.col("t").desc(), "id"))).where("r <= 4").drop("r")
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, want.collect()))


def test_promising_order(spark):
    rows = [("a", 0, 0, 5.0), ("b", 0, 1, 9.0), ("c", 0, 0, None), ("d", 1, None, 1.0), ("e", 0, 0, 5.0), ("f", 6, 0, None), ("g", 0, 0, float("nan"))]
    df = spark.createDataFrame(rows, "path string, sort_group int, sort_penalty int, sort_value double").withColumn("sort_value", F.nanvl("sort_value", F.lit(None))).withColumn("folder", F.lit("x"))
    order = [r.path for r in RK.order_promising(df).collect()]
    assert order == ["a", "e", "c", "g", "b", "d", "f"] and [r.path for r in RK.shortlist(df, 3).collect()] == order[:3]
    rank = by_id(RK.promising_rank(df), "rank", key="path")
    assert sorted(rank, key=rank.get) == order


def test_evaluation_and_comparison(spark):
    df = spark.createDataFrame([("c", 1.0, 1.5), ("c", 4.0, 3.5), ("c", 2.0, 3.2), ("v", 5.0, 5.0)], "set string, y double, p double")
    r = {x["set"]: x for x in EV.evaluate_model(df, "y", "p", ["set"]).collect()}
    assert (r["c"].n, r["c"].below_right, r["c"].below_n, r["c"].above_right, r["c"].above_n) == (3, 1, 2, 1, 1) and r["c"].rmse == pytest.approx(((0.25 + 0.25 + 1.44) / 3) ** 0.5)
    t = "case string, key string, numbers array<double>, label string"
    want = spark.createDataFrame([("1", "v", [1.0], None), ("1", "l", None, "Good"), ("2", "v", [1.0, 2.0], None), ("3", "v", [1.0], None), ("4", "v", [1.0], None), ("5", "l", None, "a")], t)
    got = spark.createDataFrame([("1", "v", [1.0 + 5e-10], None), ("1", "l", None, "Good"), ("2", "v", [1.0], None), ("3", "v", [float("nan")], None), ("4", "v", [1.1], None), ("5", "l", None, "b"), ("6", "v", [1.0], None)], t)
    problems = {(x.case, x.key): x.problem for x in EV.compare_outputs(got, want).collect()}
    assert problems == {("1", "v"): None, ("1", "l"): None, ("2", "v"): "dimension", ("3", "v"): "non-finite output", ("4", "v"): "out of tolerance", ("5", "l"): "label", ("6", "v"): "extra"}
    assert EV.compare_outputs(got.limit(0), want).where("problem = 'missing'").count() == 6
