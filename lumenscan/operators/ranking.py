"""Orders and shortlists over a collection."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.functions.text import natural_key
from lumenscan.operators.sequencing import positions


def promising_order(path: str = "path") -> list[Column]:
    """Group ascending, penalty ascending, value descending with unknown values last, then the path."""
    return [F.col("sort_group").asc(), F.coalesce(F.col("sort_penalty"), F.lit(0)).asc(), F.col("sort_value").desc_nulls_last(), F.col(path).asc()]


def order_promising(df: DataFrame, path: str = "path") -> DataFrame:
    return df.orderBy(*promising_order(path))


def shortlist(df: DataFrame, k: int, path: str = "path") -> DataFrame:
    """The k most promising scans: each task keeps k rows, so nothing is sorted as a whole."""
    return order_promising(df, path).limit(k)


def order_newest(df: DataFrame, seq: str = "arrived_seq", acquired: str = "acquired_at", path: str = "path") -> DataFrame:
    """Newest first: by arrival where the set has arrival numbers, else by acquisition time, then by file."""
    return df.orderBy(F.col(seq).desc_nulls_last(), F.col(acquired).desc_nulls_last(), F.col(path).asc())


def order_natural(df: DataFrame, name: str = "file") -> DataFrame:
    return df.orderBy(natural_key(F.col(name)), F.col(name))


def newest_rank(df: DataFrame, seq: str = "arrived_seq", acquired: str = "acquired_at", path: str = "path", out: str = "rank") -> DataFrame:
    """1-based position of every row in the order of `order_newest`."""
    return positions(df, [F.col(seq).desc_nulls_last(), F.col(acquired).desc_nulls_last(), F.col(path).asc()], out=out)


def natural_rank(df: DataFrame, name: str = "file", out: str = "rank") -> DataFrame:
    """1-based position of every row in the order of `order_natural`."""
    return positions(df.withColumn("_natural", natural_key(F.col(name))), [F.col("_natural"), F.col(name)], out=out).drop("_natural")


def promising_rank(df: DataFrame, folder: str = "folder", path: str = "path", out: str = "rank") -> DataFrame:
    """1-based rank in most-promising order over a whole folder, filters ignored; scans without a value come last of their group."""
    return positions(df, promising_order(path), [folder], out)


def organic_only(df: DataFrame, level: str = "level") -> DataFrame:
    return df.where(F.col(level).isin("trace", "clear", "strong"))


def unscored(kind: Column) -> Column:
    """Listed but not scored: white-reference saves, unreadable files, no verdict model."""
    return kind.isin("reference", "white_reference_save", "unreadable", "unscored")
