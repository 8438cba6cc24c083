"""Evaluation of models and of whole outputs against what was expected."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.functions import numeric as N


def evaluate_model(df: DataFrame, y: str, yhat: str, by: list[str] = (), cut: float = 3.0) -> DataFrame:
    """Squared Pearson correlation, RMSE and the counts right below and above a cut, per group. All are sums, so they
    combine on the map side and a large group costs no more than a small one."""
    d = F.col(yhat) - F.col(y)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.pow(F.corr(y, yhat), F.lit(2.0)).alias("r2"), F.sqrt(F.avg(d * d)).alias("rmse"),
        F.count_if((F.col(y) < cut) & (F.col(yhat) < cut)).alias("below_right"), F.count_if(F.col(y) < cut).alias("below_n"),
        F.count_if((F.col(y) >= cut) & (F.col(yhat) >= cut)).alias("above_right"), F.count_if(F.col(y) >= cut).alias("above_n"))


def verdict_counts(df: DataFrame, verdict: str = "verdict", by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by, verdict).agg(F.count("*").alias("n"))


def compare_outputs(got: DataFrame, want: DataFrame, abs_tol: float = 1e-9, rel_tol: float = 1e-9, keys=("case", "key")) -> DataFrame:
    """One row per (case, key): expected against actual values (arrays of numbers) or labels.

    ``got`` and ``want`` have the keys, ``numbers array<double>`` and ``label string``. Both sides are stacked and
    grouped once, which is a full outer join without a skewed side. ``problem`` is null where they agree.
    """
    tag = lambda df, side: df.select(*keys, F.struct("numbers", "label").alias("v"), F.lit(side).alias("side"))
    both = tag(got, "got").unionByName(tag(want, "want")).groupBy(*keys).agg(
        F.max(F.when(F.col("side") == "got", F.col("v"))).alias("g"), F.max(F.when(F.col("side") == "want", F.col("v"))).alias("w"))
    g, w = F.col("g"), F.col("w")
    err = F.zip_with(g["numbers"], w["numbers"], lambda a, b: F.abs(a - b) / (F.lit(abs_tol) + F.lit(rel_tol) * F.abs(b) + F.lit(1e-300)))
    worst = F.array_max(err)
    problem = (F.when(g.isNull(), F.lit("missing")).when(w.isNull(), F.lit("extra"))
               .when(w["label"].isNotNull(), F.when(~g["label"].eqNullSafe(w["label"]), F.lit("label")))
               .when(F.size(g["numbers"]) != F.size(w["numbers"]), F.lit("dimension"))
               .when(F.exists(g["numbers"], lambda x: ~N.is_finite(x)), F.lit("non-finite output"))
               .when(N.gt(worst, 1.0), F.lit("out of tolerance")))
    return both.select(*keys, g.alias("got"), w.alias("want"), worst.alias("error"), problem.alias("problem"))


def output_difference(got: DataFrame, want: DataFrame) -> DataFrame:
    """Rows that are only on one side, with the side; duplicates count."""
    cols = want.columns
    return (got.select(*cols).exceptAll(want).withColumn("side", F.lit("extra"))
            .unionByName(want.exceptAll(got.select(*cols)).withColumn("side", F.lit("missing"))))
