import math
from datetime import datetime

from pyspark.sql import functions as F

from lumenscan.functions import arrays as A
from lumenscan.functions import dates as D
from lumenscan.functions import numeric as N
from lumenscan.functions import records as RC
from lumenscan.functions import status as S
from lumenscan.functions import text as X

NAN, INF = float("nan"), float("inf")


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_comparisons_ignore_nan_and_null(spark):
    v = F.lit(NAN)
    n = F.lit(None).cast("double")
    assert one(spark, N.gt(v, 1.0), N.le(v, 1.0), N.gt(n, 1.0), N.gt(F.lit(INF), 1.0), N.finite_gt(F.lit(INF), 1.0)) == [False, False, False, True, False]
    assert one(spark, N.is_finite(v), N.is_finite(F.lit(INF)), N.is_finite(n), N.is_finite(F.lit(-2.0))) == [False, False, False, True]
    assert one(spark, N.unknown_as_infinity(v), N.unknown_as_infinity(n)) == [INF, INF]


def test_levels_bins_and_lookup(spark):
    lv = [{"label": "a", "below": 1.0}, {"label": "b", "below": 2.0}, {"label": "c"}]
    assert one(spark, *[N.level_label(F.lit(x), lv) for x in (0.5, 1.0, 2.5)]) == ["a", "b", "c"]
    assert one(spark, *[N.bin_index(F.lit(x), [1.0, 2.0]) for x in (0.0, 1.0, 5.0)]) == [0, 1, 2]
    k, v = [400.0, 500.0, 700.0], [1.0, 2.0, 4.0]
    assert one(spark, *[N.piecewise_linear(F.lit(x), k, v) for x in (300.0, 450.0, 600.0, 900.0)]) == [1.0, 1.5, 3.0, 4.0]


def test_expression_tree_and_responses(spark):
    tree = {"op": "div", "args": [{"op": "sub", "args": [{"ref": "x"}, 1.0]}, {"op": "max", "args": [{"ref": "y"}, 2.0]}]}
    assert one(spark, N.expression(tree, {"x": F.lit(5.0), "y": F.lit(1.0)})) == [2.0]
    got = one(spark, *[N.inverse_response(F.lit(2.0), {"type": t, "offset": 1.0}) for t in ("none", "log10", "ln", "sqrt")])
    assert got[0] == 2.0 and got[1] == 99.0 and abs(got[2] - (math.exp(2) - 1)) < 1e-12 and got[3] == 3.0
    p = one(spark, N.softmax(F.lit([1000.0, 1001.0])), N.logistic(F.lit(0.0)))
    assert abs(sum(p[0]) - 1) < 1e-12 and p[1] == 0.5


def test_reading_words(spark):
    vals = [0.49, 0.5, 2.96, 3.0, 5.6, 6.0, -1.0, NAN]
    assert one(spark, *[X.format_reading(F.lit(v), True) for v in vals]) == ["< 0.5%", "≈ 0.5%", "≈ 2.9%", "≈ 3%", "≈ 6%", "> 6%", "< 0.5%", "–"]
    assert one(spark, X.format_model(F.lit(-0.2)), X.format_model(F.lit(12.34))) == ["< 0%", "12.3%"]


def test_names(spark):
    assert one(spark, X.short_name(F.lit("a.b.ASD")), X.file_name(F.lit("/x/y.asd")), X.folder(F.lit("/x/y.asd")), X.folder_name(F.lit("/x/set 1/"))) == ["a.b", "y.asd", "/x", "set 1"]
    names = ["Scan10.asd", "scan2.asd", "Scan002b.asd", "scan1.asd", "a", "scan"]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(X.natural_key(F.col("n")), "n")
    assert [r.n for r in df.collect()] == ["a", "scan", "scan1.asd", "scan2.asd", "Scan002b.asd", "Scan10.asd"]


def test_clocks(spark):
    ole = 45000.5 + 1 / 86400
    got = one(spark, D.ole_to_timestamp(F.lit(ole)), D.ole_to_timestamp(F.lit(1.0)), D.ole_to_timestamp(F.lit(NAN)))
    assert got == [datetime(2023, 3, 15, 12, 0, 1), None, None]
    utc = (45000.5 - 25569) * 86400 - 3600
    assert one(spark, D.utc_offset_minutes(F.lit(45000.5), F.lit(utc)), D.utc_offset_minutes(F.lit(45000.5), F.lit(utc + 300)), D.utc_offset_minutes(F.lit(45000.5), F.lit(0.0))) == [60, None, None]
    tm = lambda *v: D.tm_to_timestamp(*[F.lit(x) for x in v])
    assert one(spark, tm(5, 4, 3, 29, 1, 124), tm(0, 0, 0, 31, 1, 124), tm(0, 0, 24, 1, 0, 100)) == [datetime(2024, 2, 29, 3, 4, 5), None, None]


def test_status_round_trip(spark):
    texts = ["assessed", "assessed: truncated (x: y)", "gated: noise", "skipped: a sign fired", "not assessed: why", "odd"]
    got = one(spark, *[S.parse_status(F.lit(t)) for t in texts])
    assert [(g.state, g.reason) for g in got] == [("assessed", None), ("assessed", "truncated (x: y)"), ("gated", "noise"), ("skipped", "a sign fired"), ("not assessed", "why"), ("not assessed", "odd")]
    assert one(spark, S.status_text(S.gated("noise")), S.status_text(S.assessed())) == ["gated: noise", "assessed"]


def test_array_helpers(spark):
    a = F.lit([3.0, 1.0, 2.0, 10.0])
    assert one(spark, A.mean(a), A.median(a), A.sd(F.lit([1.0, 3.0])), A.argmax(a), A.max_known(a), A.max_known(F.lit([1.0, NAN])), A.median(F.lit([NAN]))) == [4.0, 2.5, 1.0, 3, 10.0, None, None]


def test_flatten_and_hash(spark):
    df = spark.range(1).select(F.lit(1).alias("id"), F.struct(F.lit("x").alias("a"), F.array(F.lit(5), F.lit(6)).alias("b")).alias("s"))
    assert {(r.key, r.value) for r in RC.flatten_long(df, ["id"]).collect()} == {("s.a", "x"), ("s.b.n", "2"), ("s.b.0", "5"), ("s.b.1", "6")}
    assert RC.flatten(df).columns == ["id", "s.a", "s.b", "s.b.n"]
    docs = ['{"b": 1, "a": 2, "version": "1"}', '{"a": 2, "b": 1, "version": "9", "golden": {}}']
    h = [r.h for r in spark.createDataFrame([(d,) for d in docs], "d string").select(RC.body_hash("d").alias("h")).collect()]
    assert h[0] == h[1]
    assert one(spark, *[RC.bump(F.lit("1.2.3"), p) for p in ("major", "minor", "patch")]) == ["2.0.0", "1.3.0", "1.2.4"]
