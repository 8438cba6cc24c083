"""Shared helpers: Arrow text columns as numpy bytes, word hashes of whole texts in bounded slices, binary blobs for shuffles.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text. A word's hash is a polynomial over
randomised byte values modulo 2**64 with a final mix; a whole slice of text is hashed with a few vector operations.
"""
from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.sources.shared import stored  # noqa: F401  (a written table ends a plan here too)

SLICE = 1 << 20  # bytes of text hashed at once; temporaries take some 40 times that
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n + 1:
        inv = _U(pow(int(_BASE), -1, 1 << 64))
        for k, b in (("p", _BASE), ("q", inv)):
            a = np.full(n + 1, b, dtype=np.uint64)
            a[0] = 1
            _POW[k] = np.multiply.accumulate(a)
    return _POW["p"], _POW["q"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Slices of about `size` bytes that end behind white space or at the end."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + size)
        while end < n:
            gap = np.flatnonzero(SPACE[data[end - 1:end - 1 + size]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(n, end + size)
        yield at, end
        at = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, spans: bool = False):
    """(hash, row) of every word in order, uint64 and int64; with `spans` also its first byte and the byte behind it.

    `offsets` are the row borders; a word never crosses one. Rows of any length are cut into slices at white space only.
    """
    table = _LOWER if lower else _BYTES
    hs, rs, ss, es = [], [], [], []
    for a, b in _cuts(data, SLICE):
        piece = data[a:b]
        n = len(piece)
        power, inverse = _powers(max(n, SLICE))
        solid = ~SPACE[piece]
        edge = np.zeros(n + 1, dtype=bool)
        lo, hi = np.searchsorted(offsets, (a, b))
        edge[offsets[lo:hi] - a] = True
        edge[0] = edge[n] = True
        # a slice ends behind white space, so only row borders and white space end words
        before = np.empty(n, dtype=bool)
        before[0] = False
        before[1:] = solid[:-1]
        starts = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.empty(n, dtype=bool)
        after[-1] = False
        after[:-1] = solid[1:]
        ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        total = np.empty(n + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(table[piece] * power[:n], out=total[1:])
        hs.append(mix((total[ends] - total[starts]) * inverse[starts]))
        rs.append(np.searchsorted(offsets, starts + a, side="right") - 1)
        if spans:
            ss.append(starts + a)
            es.append(ends + a)
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    out = (cat(hs, np.uint64), cat(rs, np.int64))
    return out + (cat(ss, np.int64), cat(es, np.int64)) if spans else out


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] for ascending spans; the data is read in slices of whole spans."""
    out, k = np.empty(len(start), np.uint64), 0
    while k < len(start):
        z = max(k + 1, int(np.searchsorted(end, start[k] + SLICE, side="right")))
        a, b = int(start[k]), int(end[z - 1])
        power, inverse = _powers(max(b - a, SLICE))
        total = np.empty(b - a + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTES[data[a:b]] * power[:b - a], out=total[1:])
        out[k:z] = mix((total[end[k:z] - a] - total[start[k:z] - a]) * inverse[start[k:z] - a])
        k = z
    return out


def run_starts(sorted_values: np.ndarray) -> np.ndarray:
    """Positions at which a new value begins."""
    if len(sorted_values) == 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def grams(h: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word windows: (hash, row, index of the first word). Windows never cross rows."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = row[:m] == row[k - 1:]
    acc = np.zeros(m, dtype=np.uint64)
    for j in range(k):
        acc *= _BASE
        acc += h[j:j + m]
    at = np.flatnonzero(ok)
    return mix(acc[at]), row[at], at


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def crc_mod(column: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % m


def partitions(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def trim() -> None:
    """Give freed memory back to the system. A worker is used again by later stages and would keep the peak of each of them."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or the first of `name_`, `name__`, ... that is no column of `df` (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def apart(*scratch: str):
    """For a function of a DataFrame that adds and drops columns of these names: columns that have them already step aside."""
    def around(f):
        @wraps(f)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            clash = {c: free_name(docs, f"{c}_kept") for c in docs.columns if c.lower() in scratch}
            if not clash:
                return f(docs, *args, **kwargs)
            return f(docs.withColumnsRenamed(clash), *args, **kwargs).withColumnsRenamed({v: k for k, v in clash.items()})
        return run
    return around


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def list_array(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def row_groups(offsets: np.ndarray, limit: int = 1 << 23) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about `limit` bytes; a longer row is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = b
