import os
import sys
import tempfile

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

WL = np.arange(350.0, 2501.0)
SCHEMA = "scan_id string, wl_start double, wl_step double, n int, joins_nm array<double>, class string, serial bigint, r array<double>"


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[8]").appName("tests").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if s.conf.get("spark.checkpoint.dir", None) is None:
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    yield s


def spectrum(seed: int, noise: float = 2e-5) -> np.ndarray:
    """A bone-like reflectance curve with absorption bands and white noise."""
    rng = np.random.default_rng(seed)
    r = 0.5 + 0.2 * np.tanh((WL - 700) / 200) + 0.02 * np.sin(WL / 150 + seed)
    for c, a, w in ((1728, .01, 12), (1689, .01, 12), (2044, .015, 15), (2175, .02, 15), (2262, .02, 15), (2284, .01, 9), (1450, .05, 40), (1930, .1, 40)):
        r = r - a * (1 + 0.3 * np.sin(seed)) * np.exp(-0.5 * ((WL - c) / w) ** 2)
    return np.clip(r + noise * rng.standard_normal(len(WL)), 1e-3, None)


def row(scan_id, r, start=350.0, step=1.0, joins=(1000.0, 1800.0), cls="asd.labspec4.std", serial=None):
    r = None if r is None else [None if v is None else float(v) for v in r]
    return (scan_id, start, step, None if r is None else len(r), list(joins) if joins is not None else None, cls, serial, r)


def scans(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df, *cols, key="scan_id"):
    return {x[key]: tuple(x[c] for c in cols) if len(cols) > 1 else x[cols[0]] for x in df.select(key, *cols).collect()}
