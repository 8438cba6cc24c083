"""Nested results as flat tables, JSON cells and content hashes."""
from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat_columns(schema: T.StructType, arrays: str = "json", maps: dict[str, list[str]] | None = None) -> list[Column]:
    """One column per leaf of a nested schema, named by its dotted path, without reading any data.

    Arrays become a JSON cell and a ``.n`` length (``arrays="json"``), or the length only (``"n"``). A map becomes one
    column per key listed in ``maps[path]``, else a JSON cell.
    """
    out: list[Column] = []

    def walk(col: Column, dtype: T.DataType, path: str):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(col[f.name], f.dataType, f"{path}.{f.name}" if path else f.name)
        elif isinstance(dtype, T.MapType):
            keys = (maps or {}).get(path)
            if keys is None:
                out.append(F.to_json(col).alias(path))
            else:
                for k in keys:
                    walk(col[k], dtype.valueType, f"{path}.{k}")
        elif isinstance(dtype, T.ArrayType):
            if arrays == "json":
                out.append(F.to_json(col).alias(path))
            out.append(F.when(col.isNotNull(), F.size(col)).alias(f"{path}.n"))
        else:
            out.append(col.alias(path))

    for f in schema.fields:
        walk(F.col(f"`{f.name}`"), f.dataType, f.name)
    return out


def flatten(df: DataFrame, **options) -> DataFrame:
    return df.select(*flat_columns(df.schema, **options))


def leaves(schema: T.StructType, without: list[str] = (), finite: bool = False) -> Column:
    """Every scalar leaf of a row as an array of (key, value as text), in the order of the fields, of map entries and of list items;
    a list has its length before its items, under ``.n``. With ``finite`` NaN and infinities count as missing."""
    pair = "array<struct<key:string,value:string>>"

    def leaf(key: Column, col: Column, dtype: T.DataType | None = None) -> Column:
        if finite and isinstance(dtype, (T.DoubleType, T.FloatType)):
            col = F.when(F.abs(col) < float("inf"), col)
        return F.array(F.struct(key.alias("key"), col.cast("string").alias("value"))).cast(pair)

    def walk(col: Column, dtype: T.DataType, key: Column) -> Column:
        if isinstance(dtype, T.StructType):
            parts = [walk(col[f.name], f.dataType, F.concat(key, F.lit(f".{f.name}"))) for f in dtype.fields]
            return F.when(col.isNull(), leaf(key, F.lit(None))).otherwise(F.concat(*parts))
        if isinstance(dtype, T.ArrayType):
            items = F.transform(col, lambda x, i: walk(x, dtype.elementType,
                                                       F.concat(key, F.lit("."), i.cast("string"))))
            return F.when(col.isNull(), leaf(key, F.lit(None))).otherwise(
                F.concat(leaf(F.concat(key, F.lit(".n")), F.size(col)), F.flatten(items)))
        if isinstance(dtype, T.MapType):
            items = F.transform(F.map_entries(col), lambda e: walk(e["value"], dtype.valueType,
                                                                   F.concat(key, F.lit("."), e["key"].cast("string"))))
            return F.when(col.isNull(), leaf(key, F.lit(None))).otherwise(F.flatten(items))
        return leaf(key, col, dtype)

    return F.concat(*[walk(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)) for f in schema.fields if f.name not in without])


def flatten_long(df: DataFrame, id_cols: list[str]) -> DataFrame:
    """(ids, key, value): every scalar leaf of every row as text, list items by position plus the list's ``.n``.

    The leaves are gathered into one array per row and exploded, so this is a narrow job whatever the nesting.
    """
    return (df.select(*id_cols, F.explode(leaves(df.schema, id_cols)).alias("kv"))
            .select(*id_cols, F.col("kv.key").alias("key"), F.col("kv.value").alias("value")))


def canonical_json(doc) -> str:
    return json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def body_hash(docs: pd.Series) -> pd.Series:
    """SHA-256 of a parameter document's canonical JSON without its ``golden`` and ``version`` members."""
    def one(text):
        if text is None:
            return None
        body = {k: v for k, v in json.loads(text).items() if k not in ("golden", "version")}
        return hashlib.sha256(canonical_json(body).encode()).hexdigest()
    return docs.map(one)


def version_parts(version: Column) -> Column:
    """"1.12.0-rc1" -> [1, 12, 0], so versions compare as numbers."""
    core = F.regexp_extract(version, r"^([0-9.]*)", 1)
    return F.transform(F.filter(F.split(core, r"\."), lambda t: t != ""), lambda t: t.cast("int"))


def bump(version: Column, part: str) -> Column:
    """Next version: ``major``, ``minor`` or ``patch``."""
    v = version_parts(version)
    at = lambda i: F.coalesce(F.try_element_at(v, F.lit(i)), F.lit(0))
    new = {"major": [at(1) + 1, F.lit(0), F.lit(0)], "minor": [at(1), at(2) + 1, F.lit(0)],
           "patch": [at(1), at(2), at(3) + 1]}[part]
    return F.concat_ws(".", *[c.cast("string") for c in new])
