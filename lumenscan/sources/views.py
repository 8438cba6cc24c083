"""Display views of scans and of reference levels."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.operators import spectral as S
from lumenscan.rulebook import GRID, KERNEL_E31

VIEW_ORDER = ["R", "A", "D2", "D2_31", "D2_31_projected", "R_meas", "A_meas", "D2_meas"]


def odd_smoothing(window: int) -> int:
    """Chart smoothing: odd, 11 to 51."""
    w = min(max(int(window), 11), 51)
    return w if w % 2 else w + 1


def _kernel(window: int) -> dict:
    return {**KERNEL_E31, "savgol": {**KERNEL_E31["savgol"], "window": window}}


def spectral_views(scans: DataFrame, smoothing: int = 21, stream: str = "r", measured: str = "r", projections: dict | None = None) -> DataFrame:
    """R, A, second derivative at the chart smoothing and at the evidence kernel, the projected windows, and the first
    three again as measured. One array column ``view_<name>`` per view (Spark column names ignore case, so a bare R
    would replace r)."""
    w = odd_smoothing(smoothing)
    clip = KERNEL_E31["absorbance_clip"]
    df = scans.withColumn("view_R", F.col(stream))
    df = S.absorbance(df, clip, stream, "view_A")
    df = S.derivative(df, _kernel(w), stream, "view_D2")
    df = S.derivative(df, KERNEL_E31, stream, "view_D2_31")
    parts = {}
    for name, p in (projections or {}).items():
        df = S.project_out(df, p["window_nm"], p["direction"], p["centre"], p["scale"], "view_D2_31", f"_p_{name}")
        parts[name] = F.struct(F.lit(float(p["window_nm"][0])).alias("wl_start"), F.col(f"_p_{name}").alias("values"))
    df = df.withColumn("view_D2_31_projected", F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)]) if parts
                       else F.lit(None).cast("map<string,struct<wl_start:double,values:array<double>>>"))
    df = df.withColumn("view_R_meas", F.col(measured))
    df = S.absorbance(df, clip, measured, "view_A_meas")
    df = S.derivative(df, _kernel(w), measured, "view_D2_meas")
    return df.drop(*[f"_p_{k}" for k in parts])


def reference_table(spark: SparkSession, levels: list[dict]) -> DataFrame:
    rows = [(lv["label"], lv.get("n"), [float(a) for a in lv["absorbance"]]) for lv in levels]
    return spark.createDataFrame(rows, "label string, n_bones int, absorbance array<double>")


def reference_views(levels: DataFrame, smoothing: int = 21, projections: dict | None = None) -> DataFrame:
    """The same views from the mean absorbance of each reference level (R = 10^-A)."""
    scans = levels.withColumns({"wl_start": F.lit(GRID["start_nm"]), "wl_step": F.lit(GRID["step_nm"]),
                                "r": F.transform("absorbance", lambda a: F.pow(F.lit(10.0), -a))})
    return spectral_views(scans, smoothing, projections=projections).drop("r")
