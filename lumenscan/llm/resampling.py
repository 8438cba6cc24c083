"""Target-distribution importance resampling: documents are drawn by how much their words look like those of a target.

1. `bucket_counts`: every word's crc32 modulo BUCKETS is counted over all texts of the corpus and of the target; a task sends one
   number per bucket. The two arrays of fixed size give one gain per bucket, the logarithm of the smoothed ratio of frequencies.
2. `scored`: a document's weight is the mean gain of its words, read from that array, and its score adds Gumbel noise made from
   its id and the seed. The largest scores are a draw without replacement by weight. Scores are written once.
3. `cutoff`: the number of documents to draw is known, the score of the last one is not: the interval of scores is halved
   by exact count jobs over the written table until one value is left; documents tied there are cut by id in the same way, and
   repeated rows of one id by their row number. No order of all documents is needed.
4. Only the drawn rows are put in order, by range partitions, for their ranks.

A word is a maximal run of bytes of [0-9a-z] or above 0x7F after A-Z were lower-cased. Null texts have no words; without words the
weight is 0. A null id counts as the empty text in the noise and comes after all ids among ties. Repeated rows are documents of
their own. An empty target makes all gains follow the corpus; an empty table gives an empty table. Texts of any length are read
whole, in slices. Further columns are ignored.
"""
from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.llm.blocks import stored, text_bytes
from lumenscan.operators.sequencing import positions

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
SLICE = 1 << 20
SHORT = 64          # longer words get their crc one by one

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of data[start:end] for every word: one byte of all words at a time, longest words first."""
    size = end - start
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    begin, size = start[order], size[order]
    left = -np.minimum(size, SHORT + 1)     # ascending
    state = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for j in range(min(-int(left[0]), SHORT) if len(left) else 0):
        k = int(np.searchsorted(left, -j))
        s = state[:k]
        state[:k] = _CRC[(s ^ data[begin[:k] + j]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > SHORT):
        state[i] = zlib.crc32(data[begin[i]:begin[i] + size[i]].tobytes())
    out = np.empty_like(state)
    out[order] = state
    return out


def word_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int):
    """(bucket, row) of all words, in slices that end behind a byte that is in no word."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + SLICE)
        while end < n:
            gap = np.flatnonzero(~_WORD[_LOWER[data[end - 1:end - 1 + SLICE]]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(n, end + SLICE)
        piece = _LOWER[data[at:end]]
        solid = _WORD[piece]
        edge = np.zeros(len(piece) + 1, dtype=bool)
        lo, hi = np.searchsorted(offsets, (at, end))
        edge[offsets[lo:hi] - at] = True
        edge[0] = edge[-1] = True
        was = np.concatenate([[False], solid[:-1]])
        then = np.concatenate([solid[1:], [False]])
        start = np.flatnonzero(solid & (~was | edge[:-1]))
        stop = np.flatnonzero(solid & (~then | edge[1:])) + 1
        yield (crcs(piece, start, stop) % np.uint32(buckets)).astype(np.int64), np.searchsorted(offsets, start + at, side="right") - 1
        at = end


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of words per bucket over all texts; one row per bucket comes to the driver."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for bucket, _ in word_buckets(*text_bytes(b.column(0)), buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    parts = docs.select(F.col(text_col).cast("binary").alias("text")).where(F.col("text").isNotNull()).mapInArrow(count, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) per bucket, in doubles."""
    k, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(id_: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2**32))) of the first 32 bits h of sha256('seed:id')."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """ref (a number of the row), doc_id, n_features, weight, score."""
    def weigh(batches):
        for b in batches:
            data, off = text_bytes(b.column(1))
            n, total = np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1, np.int64)
            for bucket, row in word_buckets(data, off, len(gain)):
                at, k = np.unique(row, return_index=True)
                n[at] += np.diff(np.append(k, len(row)))
                total[at] += np.add.reduceat(gain[bucket], k) if len(k) else 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(weigh, "doc_id bigint, n_features bigint, weight bigint")
    return rows.select(F.monotonically_increasing_id().alias("ref"), "doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))


def cutoff(rows: DataFrame, keys: list[Column], k: int) -> Column:
    """A condition that exactly the `k` first rows by `keys` (integers, ascending; together unique) meet.

    Every key's interval is halved by exact counts over `rows`, which should be a written table; rows tied at the value found
    are decided by the next key.
    """
    if k <= 0:
        return F.lit(False)
    drawn, tied = F.lit(False), F.lit(True)
    for key in keys:
        held = rows.where(tied)
        lo, hi = held.agg(F.min(key), F.max(key)).first()
        if lo is None:      # no rows at all
            return drawn
        below, upto = 0, None      # rows with a key under lo; rows with a key of at most hi
        while lo < hi:
            mid = (lo + hi) // 2
            n = held.where(key <= F.lit(mid)).count()
            if n >= k:
                hi, upto = mid, n
            else:
                lo, below = mid + 1, n
            if upto == k:
                return drawn | (tied & (key <= F.lit(hi)))
        drawn = drawn | (tied & (key < F.lit(lo)))
        tied, k = tied & (key == F.lit(lo)), k - below
    return drawn | tied


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and, of the `percent` % drawn among documents of `least_words` words or more, rank."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    rows = stored(scored(docs, gain, id_col, text_col, seed))
    able = rows.where(F.col("n_features") >= least_words)
    keys = [-F.col("score"), F.when(F.col("doc_id").isNull(), 1).otherwise(0), F.coalesce("doc_id", F.lit(0)), F.col("ref")]
    drawn = (F.col("n_features") >= least_words) & cutoff(able, keys, percent * able.count() // 100)
    first = positions(rows.where(drawn), keys)
    names = ["doc_id", "n_features", "weight", "score"]
    return first.select(*names, F.col("rank").cast("bigint")).unionByName(rows.where(~drawn).select(*names, F.lit(None).cast("bigint").alias("rank")))
