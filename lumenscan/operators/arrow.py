"""Arrow-batch evaluation of layout-dependent operators.

A batch holds scans of possibly different layouts (grid and detector joins). Rows are grouped by layout inside the
batch, the weights of a layout are built once per task, and each group is one matrix product. Nothing is shuffled.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenscan.operators.weights import OperatorError, grid

SUB_BATCH = 512          # rows per matrix product: bounds the scratch memory of one task
CACHE_LIMIT = 256        # layouts whose weights a task keeps


def list_rows(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row offsets, flat values) of a list column; null items become NaN, null rows are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False)
    flat = arr.flatten()
    values = flat.to_numpy(zero_copy_only=False)
    if values.dtype != np.float64:
        values = values.astype(np.float64)
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), values


def to_list_column(rows: list[np.ndarray | None]) -> pa.Array:
    lengths = [0 if r is None else len(r) for r in rows]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    live = [r for r in rows if r is not None]
    values = pa.array(np.concatenate(live) if live else np.zeros(0), type=pa.float64())
    mask = pa.array([r is None for r in rows])
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)


def layouts(batch: pa.RecordBatch, arr: str) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """((start, step, n, joins), row numbers, matrix) per layout, in blocks of at most SUB_BATCH rows."""
    offsets, values = list_rows(batch.column(arr))
    n = np.diff(offsets)
    start = batch.column("wl_start").to_numpy(zero_copy_only=False)
    step = batch.column("wl_step").to_numpy(zero_copy_only=False)
    joins = batch.column("joins_nm").to_pylist() if "joins_nm" in batch.schema.names else [None] * len(n)
    groups: dict[tuple, list[int]] = {}
    for i in range(len(n)):
        groups.setdefault((float(start[i]), float(step[i]), int(n[i]), tuple(joins[i] or ())), []).append(i)
    for key, rows in groups.items():
        for k in range(0, len(rows), SUB_BATCH):
            block = np.asarray(rows[k:k + SUB_BATCH])
            m = key[2]
            X = values[offsets[block][:, None] + np.arange(m)[None, :]] if m else np.zeros((len(block), 0))
            yield key, block, X


def linear_pass(df: DataFrame, build: Callable, col: str = "r") -> DataFrame:
    """Replace ``col`` by ``build(wl, joins).apply(X)``; a layout the operator refuses gives null and an ``error``."""
    fields = [f for f in df.schema.fields if f.name != "error"] + [T.StructField("error", T.StringType())]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out: list = [None] * batch.num_rows
            start = batch.column("wl_start").to_numpy(zero_copy_only=False).copy()
            step = batch.column("wl_step").to_numpy(zero_copy_only=False).copy()
            had_error = "error" in batch.schema.names
            error = batch.column("error").to_pylist() if had_error else [None] * batch.num_rows
            null_row = batch.column(col).is_null().to_numpy(zero_copy_only=False)
            for key, rows, X in layouts(batch, col):
                if key not in cache:
                    if len(cache) >= CACHE_LIMIT:
                        cache.clear()
                    try:
                        cache[key] = build(grid(*key[:3]), key[3])
                    except (OperatorError, IndexError) as e:
                        cache[key] = str(e)
                op = cache[key]
                if isinstance(op, str):
                    for i in rows:
                        if not null_row[i]:
                            error[i] = error[i] or op
                    continue
                Y = op.apply(X)
                for i, y in zip(rows, Y):
                    if not null_row[i]:
                        out[i] = y
                if len(op.wl):
                    start[rows] = op.wl[0]
                    step[rows] = (op.wl[1] - op.wl[0]) if len(op.wl) > 1 else key[1]
            cols = {"wl_start": pa.array(start), "wl_step": pa.array(step), col: to_list_column(out),
                    "error": pa.array(error, type=pa.string())}
            arrays = [cols[f.name] if f.name in cols else batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return df.mapInArrow(run, schema)
