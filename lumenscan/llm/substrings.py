"""Substring dedup: word sequences that occur more than once, found by backward search in a compressed FM-index per shard.

A window is WINDOW consecutive words of one document. The smallest hash of its GRAM-word grams, its anchor, depends on the
words of the window alone, so equal windows have equal anchors. Shards are made by anchor: consecutive windows of one anchor
form a segment, and equal windows always meet in one shard.

1. `row_groups_table`: the text once more as compressed row groups, so that all passes see the same groups.
2. `anchor_filter`: every position that is an anchor is counted over all documents. Anchors of one position lead to no copy;
   the others set a bit in a filter of at most 2**FILTER_BITS bits, which is all that goes to the tasks. A false bit only adds
   a segment to a shard.
3. `_search`: a shard builds an FM-index (wavelet matrix over the Burrows-Wheeler transform, sorted to a depth that covers a
   window) of its distinct segments. Segments of several occurrences are copies as a whole. The others are streamed through
   backward search, which gives, for an end position, the length up to WINDOW that occurs at least twice; the first and the
   last window of that length bound the part of the segment that is covered.
4. The covered intervals return to their row group, where words are dropped and the rest is joined.

A shard holds the segments of its anchors in memory; an anchor is a hash of rarely repeated grams, and equal segments of a row
group are sent once. Null or empty text has no words. Repeated rows are documents of their own, and so copies of each other;
null ids stay. An empty table gives an empty table. Further columns are ignored. Words of equal 48-bit hashes count as equal.
"""
from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.llm.blocks import partitions, row_groups, run_starts, stored, text_bytes, words

WINDOW, GRAM, SEGMENT, DEPTH = 35, 6, 30, 64
FILTER_BITS = 28
_SPAN = WINDOW - GRAM + 1      # grams of a window
_GROUPS = "base bigint, ids binary, nulls binary, offsets binary, text binary"
_SEGMENTS = "shard int, base bigint, place binary, first binary, low binary, high binary"
_COVERED = "base bigint, place binary, start binary, stop binary"
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
REWRITTEN = RESULT + ", kept string"


def row_groups_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            data, off = text_bytes(b.column(2))
            refs, ids = b.column(0).to_numpy(), b.column(1)
            out = []
            for lo, hi in row_groups(off):
                for a in range(lo, hi, 65536):
                    z = min(hi, a + 65536)
                    own = ids.slice(a, z - a)
                    out.append((int(refs[a]), own.fill_null(0).to_numpy().tobytes(), np.asarray(own.is_null()).astype(np.uint8).tobytes(), (off[a:z + 1] - off[a]).tobytes(), pack.compress(data[off[a]:off[z]].tobytes())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), *[pa.binary()] * 4))], ["base", "ids", "nulls", "offsets", "text"])

    src = docs.select(F.monotonically_increasing_id().alias("ref"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return stored(src.mapInArrow(run, _GROUPS))


def _texts(batches):
    """(base, data, offsets) of stored row groups."""
    for b in batches:
        for base, off, text in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            yield base, np.frombuffer(zstandard.ZstdDecompressor().decompress(text.as_py()), np.uint8), np.frombuffer(off.as_py(), np.int64)


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every `width` neighbours."""
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[:len(x) - (width - size)], x[width - size:]) if size < width else x


class Windows:
    """The windows of a row group: word hashes, and the anchor of every window that lies in one row (else 0)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.h, self.row = words(data, offsets)
        n = len(self.h) - WINDOW + 1
        self.anchor = np.zeros(0, np.uint64)
        if n > 0:
            m = len(self.h) - GRAM + 1
            g = np.zeros(m, np.uint64)
            for j in range(GRAM):
                g = g * np.uint64(0x9E3779B97F4A7C15) + self.h[j:j + m]
            g ^= g >> np.uint64(29)
            g *= np.uint64(0xBF58476D1CE4E5B9)
            g ^= g >> np.uint64(32)
            self.gram = np.maximum(g, np.uint64(1))
            self.anchor = np.where(self.row[:n] == self.row[WINDOW - 1:], _slide(self.gram, _SPAN, np.minimum), np.uint64(0))

    def anchors(self) -> np.ndarray:
        """The hash at every position that is the anchor of some window."""
        if not len(self.anchor):
            return np.zeros(0, np.uint64)
        edge = np.zeros(_SPAN - 1, np.uint64)
        return self.gram[_slide(np.concatenate([edge, self.anchor, edge]), _SPAN, np.maximum)[:len(self.gram)] == self.gram]

    def segments(self, passes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows (at most SEGMENT) and anchor of each run of windows whose anchor `passes`."""
        a = self.anchor
        if not len(a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), a
        row = self.row[:len(a)]
        change = np.concatenate([[True], (a[1:] != a[:-1]) | (row[1:] != row[:-1])])
        begin = np.flatnonzero(change)
        since = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a))))
        start = np.flatnonzero(since % SEGMENT == 0)
        count = np.diff(np.append(start, len(a)))
        ok = (a[start] > 0) & passes(a[start])
        return start[ok], count[ok], a[start][ok]


def anchor_filter(groups: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each value of an anchor's leading bits under which some anchor has two positions or more."""
    total = groups.select(F.sum(F.length("offsets"))).first()[0] or 0
    buckets = 1 << max(1, (2 * partitions(groups.sparkSession) - 1).bit_length())
    rough = groups.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(FILTER_BITS, max(16, (rough + total).bit_length() + 1))

    def count(batches):
        for _, data, off in _texts(batches):
            v, n = np.unique(Windows(data, off).anchors(), return_counts=True)
            cut = np.searchsorted((v >> np.uint64(32)).astype(np.int64) * buckets >> 32, np.arange(buckets + 1))
            rows = [(q, v[cut[q]:cut[q + 1]].tobytes(), (n[cut[q]:cut[q + 1]] > 1).tobytes()) for q in range(buckets) if cut[q] < cut[q + 1]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "v", "more"])

    def mark(part: pa.Table) -> pa.Table:
        v = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in part.column("v")])
        more = np.concatenate([np.frombuffer(x.as_py(), bool) for x in part.column("more")])
        order = np.argsort(v, kind="stable")
        v, more = v[order], more[order]
        at = run_starts(v)
        many = (np.diff(np.append(at, len(v))) > 1) | np.logical_or.reduceat(more, at)
        bucket = part.column("bucket")[0].as_py()
        own = np.zeros(max(8, (1 << bits) // buckets), bool)
        own[(v[at][many] >> np.uint64(64 - bits)).astype(np.int64) - bucket * len(own)] = True
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    if (1 << bits) < 8 * buckets:
        bits = (8 * buckets).bit_length()
    filter_ = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << bits) // buckets // 8
    rows = groups.select("base", "offsets", "text").mapInArrow(count, "bucket int, v binary, more binary")
    for r in rows.groupBy("bucket").applyInArrow(mark, "bucket int, bits binary").toLocalIterator():
        filter_[r["bucket"] * size:(r["bucket"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return filter_, bits


class FMIndex:
    """Counts of word sequences in a text of symbols 1..sigma-1 with 0 as separator, for patterns of up to DEPTH symbols."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = self.n = len(text)
        rank = text.astype(np.int64)
        size, order = 1, None
        while size < DEPTH:
            behind = np.zeros(n, np.int64)
            behind[:n - size] = rank[size:] + 1 if n > size else 0
            key = rank * (n + sigma + 1) + behind
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]])) if n else 0
            size *= 2
            if n and rank[order[-1]] == n - 1:
                break
        bwt = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.ones, self.zeros = [], [], []
        x = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (x >> level & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bit, np.zeros(-n % 64 + 64, np.uint8)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int64))
            self.zeros.append(n - int(bit.sum()))
            x = np.concatenate([x[bit == 0], x[bit == 1]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return self.ones[level][w] + np.bitwise_count(self.words[level][w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of c followed by what [lo, hi) stands for: one step of backward search, many patterns at once."""
        k = len(c)
        at, base = np.concatenate([lo, hi]), np.zeros(k, np.int64)
        for level in range(self.levels):
            bit = (c >> (self.levels - 1 - level) & 1).astype(bool)
            # the position where this symbol's subtree begins takes the same way as both borders
            ones = self._ones(level, np.concatenate([at, base]))
            both = np.concatenate([bit, bit])
            at = np.where(both, self.zeros[level] + ones[:2 * k], at - ones[:2 * k])
            base = np.where(bit, self.zeros[level] + ones[2 * k:], base - ones[2 * k:])
        start = self.before[c]
        return start + at[:k] - base, start + at[k:] - base

    def matching(self, text: np.ndarray, end: np.ndarray, most: int = WINDOW) -> np.ndarray:
        """Length, up to `most`, of the longest sequence that ends at each position and occurs at least twice."""
        depth = np.zeros(len(end), np.int64)
        live, lo, hi = np.arange(len(end)), np.zeros(len(end), np.int64), np.full(len(end), self.n, np.int64)
        for step in range(most):
            lo, hi = self.extend(text[end[live] - step], lo, hi)
            on = hi - lo > 1
            live, lo, hi = live[on], lo[on], hi[on]
            depth[live] += 1
            if not len(live):
                break
        return depth


def _outer_windows(index: FMIndex, text: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window (or -1) of each segment that occurs at least twice."""
    once = np.diff(index.before)[text] < 2
    breaker = np.maximum.accumulate(np.where(once, np.arange(len(text)), -1))    # nearest single word at or before
    first, last = np.full(len(start), -1), np.full(len(start), -1)
    lane, i = np.arange(len(start)), start.copy()
    stop = start + count
    while len(lane):
        gap = breaker[np.minimum(i + WINDOW - 1, len(text) - 1)]
        i = np.where(gap >= i, gap + 1, i)
        ok = i < stop[lane]
        lane, i = lane[ok], i[ok]
        still = breaker[i + WINDOW - 1] < i
        depth = np.zeros(len(i), np.int64)
        depth[still] = index.matching(text, i[still] + WINDOW - 1)
        hit = depth == WINDOW
        first[lane[hit]] = i[hit]
        # nothing that ends there and is longer than depth occurs twice: the next window starts behind it
        i = np.where(still, i + WINDOW - depth, i)[~hit]
        lane = lane[~hit]
    lane = np.flatnonzero(first >= 0)
    i = stop[lane] - 1
    while len(lane):
        gap = breaker[i + WINDOW - 1]
        i = np.maximum(np.where(gap >= i, gap - WINDOW, i), first[lane])
        still = (breaker[i + WINDOW - 1] < i) & (i > first[lane])
        hit = i == first[lane]
        hit[still] |= index.matching(text, i[still] + WINDOW - 1) == WINDOW
        last[lane[hit]] = i[hit]
        i = np.where(still, i - 1, i)[~hit]
        lane = lane[~hit]
    return first, last


def _search(part: pa.Table) -> pa.Table:
    """One shard: covered intervals of its segments, by row group."""
    rows = part.select(["base", "place", "first", "low", "high"]).to_pylist()
    rows.sort(key=lambda r: r["base"])
    known: dict[bytes, int] = {}
    which, base, place, first = [], [], [], []
    for r in rows:
        p = np.frombuffer(r["place"], np.uint32).reshape(3, -1)      # row, windows, occurrence's first word
        h = np.frombuffer(r["low"], np.uint32).astype(np.uint64) | np.frombuffer(r["high"], np.uint16).astype(np.uint64) << np.uint64(32)
        size = p[1].astype(np.int64) + WINDOW - 1
        sent = np.frombuffer(r["first"], np.uint32)                   # for each occurrence, which of the sent segments it is
        length = np.zeros(int(sent.max()) + 1, np.int64)
        length[sent] = size
        ends = np.cumsum(length)
        raw = h.tobytes()
        codes = np.array([known.setdefault(raw[8 * (e - n):8 * e], len(known)) for e, n in zip(ends.tolist(), length.tolist())], np.int64)
        which.append(codes[sent])
        base.append(np.full(len(sent), r["base"], np.int64))
        place.append(p[0])
        first.append(p[2])
    which, base, place, first = (np.concatenate(x) for x in (which, base, place, first))
    segs = [np.frombuffer(k, np.uint64) for k in known]
    times = np.bincount(which, minlength=len(segs))
    length = np.array([len(s) for s in segs], np.int64)
    begin = np.zeros(len(segs), np.int64)       # covered words of each segment
    end = np.where(times > 1, length, 0)
    if (times == 1).any():
        flat = np.concatenate([x for s in segs for x in (s, np.array([0xFFFFFFFFFFFFFFFF], np.uint64))])
        value, text = np.unique(flat, return_inverse=True)
        text = (text + 1) % len(value)          # separators, the largest value, become 0
        index = FMIndex(text, len(value))
        start = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
        single = np.flatnonzero(times == 1)
        a, b = _outer_windows(index, text, start[single], length[single] - WINDOW + 1)
        found = a >= 0
        begin[single[found]] = (a - start[single])[found]
        end[single[found]] = (b - start[single])[found] + WINDOW
    hit = end[which] > begin[which]
    base, place, which, first = base[hit], place[hit], which[hit], first[hit].astype(np.int64)
    out = []
    for s, e in zip((at := run_starts(base)), np.append(at, len(base))[1:]):
        out.append((int(base[s]), place[s:e].tobytes(), (first[s:e] + begin[which[s:e]]).tobytes(), (first[s:e] + end[which[s:e]]).tobytes()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), (), ()), (pa.int64(), *[pa.binary()] * 3))], names=["base", "place", "start", "stop"])


def _deal(groups: DataFrame, filter_, bits: int, shards: int) -> DataFrame:
    """Row groups' segments by shard; equal segments of a row group are sent once."""
    def run(batches):
        f, shift = filter_.value, np.uint64(64 - bits)

        def passes(a):
            i = (a >> shift).astype(np.int64)
            return f[i >> 3] >> (7 - (i & 7)).astype(np.uint8) & 1 > 0

        for base, data, off in _texts(batches):
            w = Windows(data, off)
            start, count, anchor = w.segments(passes)
            shard = (anchor >> np.uint64(32)).astype(np.int64) % shards
            order = np.lexsort((start, anchor, shard))
            start, count, shard = start[order], count[order], shard[order]
            row = w.row[start]
            local = start - np.searchsorted(w.row, row)
            h = w.h & np.uint64((1 << 48) - 1)
            rows = []
            for s, e in zip((at := run_starts(shard)), np.append(at, len(shard))[1:]):
                known: dict[bytes, int] = {}
                sent = [known.setdefault(h[i:i + n].tobytes(), len(known)) for i, n in zip(start[s:e].tolist(), (count[s:e] + WINDOW - 1).tolist())]
                flat = np.frombuffer(b"".join(known), np.uint64)
                rows.append((int(shard[s]), base, np.concatenate([row[s:e], count[s:e], local[s:e]]).astype(np.uint32).tobytes(), np.array(sent, np.uint32).tobytes(),
                             flat.astype(np.uint32).tobytes(), (flat >> np.uint64(32)).astype(np.uint16).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), *[pa.binary()] * 4))], ["shard", "base", "place", "first", "low", "high"])

    return groups.select("base", "offsets", "text").mapInArrow(run, _SEGMENTS)


def _finish(keep_text: bool):
    def run(groups: pa.Table, covered: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for g in groups.to_pylist():
            off, ids, null = np.frombuffer(g["offsets"], np.int64), np.frombuffer(g["ids"], np.int64), np.frombuffer(g["nulls"], np.uint8)
            text = zstandard.ZstdDecompressor().decompress(g["text"])
            parts = [(np.frombuffer(c["place"], np.uint32).astype(np.int64), np.frombuffer(c["start"], np.int64), np.frombuffer(c["stop"], np.int64)) for c in covered.to_pylist()]
            place, start, stop = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
            order = np.argsort(place, kind="stable")
            place, start, stop = place[order], start[order], stop[order]
            cut = np.searchsorted(place, np.arange(len(ids) + 1))
            for k in range(len(ids)):
                w = text[off[k]:off[k + 1]].split()
                n, removed = len(w), 0
                if cut[k] < cut[k + 1]:
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, start[cut[k]:cut[k + 1]], 1)
                    np.add.at(step, stop[cut[k]:cut[k + 1]], -1)
                    keep = np.cumsum(step[:n]) == 0
                    removed = n - int(keep.sum())
                    w = list(compress(w, keep.tolist()))
                kept = b" ".join(w)
                out.append((None if null[k] else int(ids[k]), n, removed, hashlib.sha256(kept).hexdigest(), *([kept.decode()] if keep_text else [])))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())[:5 if keep_text else 4]
        names = [f.split()[0] for f in REWRITTEN.split(", ")][:len(kinds)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * len(kinds), kinds)], names=names)

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and `kept`, if asked for) of every document."""
    spark = docs.sparkSession
    groups = row_groups_table(docs, id_col, text_col)
    bits_of, bits = anchor_filter(groups)
    segments = _deal(groups, spark.sparkContext.broadcast(bits_of), bits, 2 * partitions(spark))
    covered = segments.groupBy("shard").applyInArrow(_search, _COVERED)
    return groups.groupBy("base").cogroup(covered.groupBy("base")).applyInArrow(_finish(keep_text), REWRITTEN if keep_text else RESULT)
