"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find; 3-word shingles, Jaccard 0.85.

1. `signatures`: every shingle has a random permutation of the SLOTS slots; at its step j it offers j plus a random fraction to
   the slot in place j. A slot keeps the least offer of all shingles of a document. The permutations make the slots of one
   document correlated in a way that lowers the variance of the share of equal slots. Step j + 1 is only taken for documents that
   have an empty slot after step j, as later offers are larger: long documents stop after one step, which is the early stop.
2. Documents with equal sets are one class from here on (their digests are equal), whatever their number.
3. `buckets`: ROWS slots form a band; classes with an equal band meet. Two sets at the threshold miss all BANDS bands with
   probability (1 - 0.85 ** 5) ** 32 < 1e-8. Buckets of one class are dropped.
4. Every class is compared with the first of each of its buckets, on full sets, and union-find joins what is linked. The sets are
   made anew from the texts of the classes that are in buckets; no other text is read into shingles twice.
5. Where a bucket still holds several components, all pairs of different components are looked at: the bucket is cut by size
   (sets of similarity 0.85 differ by less than one size class) and into blocks; blocks meet as numpy arrays, where pairs of at
   least CLOSE equal slots (7 standard deviations below the threshold) are verified on full sets, and only links that join
   components leave. So no pair of a large family is listed, and no link is lost but by the probabilities named.

Null or empty text, or text without words, has an empty set and links with nothing. Repeated rows are documents of their own; a
null id links and names a component only if no member has an id (kept then compares null with null and holds). An empty table
gives an empty table. Further columns are ignored. A long text is one row group. Equal 64-bit hashes count as equal shingles.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.llm.blocks import mix, row_groups, stored, text_bytes
from lumenscan.llm.components import components
from lumenscan.llm.jaccard import shingles

WORDS, PERCENT = 3, 85
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
CLOSE = SLOTS * 65 // 100
BLOCK = 512
GROUP_BYTES = 1 << 20
SMALL = 500_000         # rows (some 40 bytes each) of which a broadcast may consist
_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)


def signatures(h: np.ndarray, row: np.ndarray, n_rows: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of every row's elements: n_rows x slots values, step in the top byte and a random fraction below."""
    sig = np.full(n_rows * slots, _NONE, np.uint64)
    live, place, perm = np.arange(len(h)), None, None       # `place`: the line of `perm` of each live element
    for j in range(slots):
        if not len(live):
            break
        x = mix(h[live] + _U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((x >> _U(32)) * _U(slots - j) >> _U(32)).astype(np.int64)
        slot = k if perm is None else perm[place, k]
        np.minimum.at(sig, row[live] * slots + slot, (_U(j) << _U(56)) | (mix(x ^ _U(0x5851F42D4C957F2D)) >> _U(8)))
        open_ = (sig.reshape(n_rows, slots) == _NONE).any(axis=1)[row[live]]
        if perm is None:
            live, k = live[open_], k[open_]
            place = np.arange(len(live))
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(live), 1))
            perm[place, k] = 0
        else:
            perm[place, k] = perm[place, j]
            live, place = live[open_], place[open_]
    return sig.reshape(n_rows, slots)


SIGNED = "doc_id bigint, text_md5 string, n bigint, digest binary, sig binary"


def _sign(batches, words: int):
    for b in batches:
        data, off = text_bytes(b.column(2))
        for lo, hi in row_groups(off, GROUP_BYTES):
            h, row = shingles(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], words)
            order = np.argsort(row, kind="stable")      # by row, then by hash
            h, row = h[order], row[order]
            at = np.searchsorted(row, np.arange(hi - lo + 1))
            # 16 bits of a slot are enough to compare it
            sig = (mix(signatures(h, row, hi - lo)) & _U(0xFFFF)).astype(np.uint16)
            some = [bool(at[i] < at[i + 1]) for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([
                b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.diff(at), pa.int64()),
                pa.array([hashlib.md5(h[at[i]:at[i + 1]].tobytes()).digest() if s else None for i, s in enumerate(some)], pa.binary()),
                pa.array([sig[i].tobytes() if s else None for i, s in enumerate(some)], pa.binary())], [f.split()[0] for f in SIGNED.split(", ")])


def _bands(batches):
    """Every class's band keys."""
    for b in batches:
        sig = _matrix(b.column(2)).astype(np.uint64).reshape(-1, BANDS, ROWS)
        key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), 1))
        for j in range(ROWS):
            key = mix(key * _U(0x9E3779B97F4A7C15) + sig[:, :, j])
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS)), pa.array(np.repeat(b.column(1).to_numpy(), BANDS)),
                                           pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(sig)))], ["key", "cid", "n", "band"])


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = text_bytes(column)
    return np.frombuffer(data.tobytes(), np.uint16).reshape(len(column), SLOTS)


def _sets(batches, words: int):
    for b in batches:
        data, off = text_bytes(b.column(1))
        for lo, hi in row_groups(off, GROUP_BYTES):
            h, row = shingles(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], words)
            h = h[np.argsort(row, kind="stable")]
            at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([h[s:e].tobytes() for s, e in zip(at, at[1:])], pa.binary())], ["cid", "keys"])


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int(np.count_nonzero(y[at] == x))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _linked(batches):
    """Pairs whose full sets are similar enough."""
    for b in batches:
        out = []
        for u, v, ku, kv in zip(*(c.to_pylist() for c in b.columns)):
            if _similar(np.frombuffer(ku, np.uint64), np.frombuffer(kv, np.uint64)):
                out.append((u, v))
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], ["u", "v"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs u, v (ids of classes) that are links."""
    one = pairs.join(sets.select(F.col("cid").alias("u"), F.col("keys").alias("ku")), "u")
    two = one.join(sets.select(F.col("cid").alias("v"), F.col("keys").alias("kv")), "v")
    return two.select("u", "v", "ku", "kv").mapInArrow(_linked, "u bigint, v bigint")


def _meet(part: pa.Table) -> pa.Table:
    """Links between two blocks of a bucket that join different components, as far as these blocks tell.

    A pair is looked at in the first band that it shares, if its sizes allow a link and CLOSE slots are equal; full sets decide.
    Members of the most frequent component here meet only those of others.
    """
    cid, n, comp, block = (part.column(c).to_numpy() for c in ("cid", "n", "comp", "block"))
    own = part.column("own").to_numpy(zero_copy_only=False)
    sig, keys = _matrix(part.column("sig")), part.column("keys")
    i, j, band = (part.column(c)[0].as_py() for c in ("i", "j", "band"))
    names, times = np.unique(comp, return_counts=True)
    main = comp == names[np.argmax(times)]
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    for a in np.flatnonzero(~main):
        other = (block == (j if block[a] == i else i)) & (comp != comp[a]) & (own | own[a]) & (100 * np.minimum(n, n[a]) >= PERCENT * np.maximum(n, n[a]))
        if i == j:
            other[:a] &= main[:a]
        elif block[a] == j:
            other &= main
        b = np.flatnonzero(other)
        if not len(b):
            continue
        same = sig[b] == sig[a]
        b = b[(np.count_nonzero(same, axis=1) >= CLOSE) & (same.reshape(len(b), BANDS, ROWS).all(axis=2).argmax(axis=1) == band)]
        mine = np.frombuffer(keys[int(a)].as_py(), np.uint64) if len(b) else None
        for k in b.tolist():
            u, v = find(int(comp[a])), find(int(comp[k]))
            if u != v and _similar(mine, np.frombuffer(keys[k].as_py(), np.uint64)):
                parent[u] = v
                links.append((int(cid[a]), int(cid[k])))
    return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})


def rest_of_buckets(buckets: DataFrame, classes: DataFrame, sets: DataFrame, comps: DataFrame) -> DataFrame:
    """u, v: links between classes that share a bucket and are in different components."""
    rows = buckets.select("key", "band", "cid", "n").join(comps.select(F.col("node").alias("cid"), "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where(F.col("a") != F.col("b")).select("key")
    # a class of size is as wide as the largest allowed difference, and a little more for rounding
    size = F.floor(F.log(F.col("n")) / F.lit(1.001 * math.log(100 / PERCENT))).cast("int")
    rows = rows.join(mixed, "key").select("key", "band", "cid", "n", "comp", F.explode(F.array(F.struct(size.alias("c"), F.lit(True).alias("own")), F.struct((size + 1).alias("c"), F.lit(False).alias("own")))).alias("x")).select("key", "band", "cid", "n", "comp", "x.c", "x.own")
    many = rows.groupBy("key", "c").agg(F.count("*").alias("m"), F.count_if("own").alias("owns"), F.min("comp").alias("a"), F.max("comp").alias("b")).where((F.col("owns") > 0) & (F.col("a") != F.col("b")))
    many = many.select("key", "c", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(many, ["key", "c"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    met = rows.select("key", "band", "c", "cid", "n", "comp", "own", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    met = met.select("*", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j")).drop("o")
    return met.join(classes.select("cid", "sig"), "cid").join(sets, "cid").groupBy("key", "c", "i", "j").applyInArrow(_meet, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept (the id is its component's)."""
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = stored(src.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("text").cast("binary").alias("text")).mapInArrow(lambda b: _sign(b, words), SIGNED))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_md5")).alias("first")
    classes = signed.where(F.col("n") > 0).groupBy("digest").agg(first, F.any_value("n").alias("n"), F.any_value("sig").alias("sig"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("cid"), "digest", "first.doc_id", "first.text_md5", "n", "sig"))

    keys = classes.select("cid", "n", "sig").mapInArrow(_bands, "key bigint, cid bigint, n bigint, band int")
    met = keys.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("cid", "n")).alias("hub")).where(F.col("m") > 1)
    buckets = stored(keys.join(met, "key").select("key", "band", "cid", "n", F.col("hub.cid").alias("hub"), F.col("hub.n").alias("hub_n")))

    needed = stored(classes.join(buckets.select("cid").distinct(), "cid", "left_semi").select("cid", F.col("doc_id").alias("_id"), "text_md5"))
    small = F.broadcast(needed) if needed.count() <= SMALL else needed
    texts = src.withColumn("_md5", F.md5(F.col("text").cast("binary"))).join(small, (F.col("_md5") == F.col("text_md5")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    sets = stored(texts.select("cid", "text").dropDuplicates(["cid"]).select("cid", F.col("text").cast("binary").alias("text")).mapInArrow(lambda b: _sets(b, words), "cid bigint, keys binary"))

    alike = 100 * F.least("n", "hub_n") >= PERCENT * F.greatest("n", "hub_n")
    links = stored(verified(buckets.where((F.col("cid") != F.col("hub")) & alike).select(F.col("hub").alias("u"), F.col("cid").alias("v")).distinct(), sets))
    comps = components(links)
    more = stored(rest_of_buckets(buckets, classes, sets, comps))
    if not more.isEmpty():
        comps = components(more.unionByName(comps.select(F.col("node").alias("u"), F.col("comp").alias("v"))))

    of = classes.select("cid", "digest", "doc_id").join(comps, F.col("cid") == F.col("node"), "left").select("digest", "doc_id", F.coalesce("comp", "cid").alias("comp"))
    names = of.join(of.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "comp").select("digest", "component_id")
    rows = signed.where(F.col("n") > 0).select("doc_id", "n", "digest").join(names, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    plain = signed.where(F.col("n") == 0).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.unionByName(plain).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
