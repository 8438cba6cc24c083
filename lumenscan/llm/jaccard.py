"""Near-duplicate documents by a grouped prefix join on word shingles, Jaccard similarity of at least 0.8.

1. `shingle_table`: one pass over the text. Every row group's shingle hashes go, as binary columns, to hash buckets, where each
   shingle's document frequency is counted over all documents; what at least two documents share goes back to its row group.
   A shingle of one document joins nothing, so a document whose shared shingles are fewer than 80 % of its set has no link.
   The others keep their shared shingles and, rarest first, the prefix that a partner must touch.
2. Documents with equal sets become one class. Classes with equal size and prefix become one group (of at most GROUP members;
   a larger one is split by a salt).
3. Group pairs that share a prefix shingle and may be similar by their sizes are gathered as arrays: in the list of a shingle
   every group sees the NEAR groups before it. That is every pair of lists of up to NEAR + 1 groups.
4. `verify`: groups are dealt into shards; every class of a group visits the shards of its candidate groups, which expand to
   their members, and the overlap of the whole sets decides. Only links that join two parts of a shard leave it.
5. In longer lists, every pair that steps 3 and 4 left in different components is then verified too: groups outside of a list's
   most frequent component visit all of the list, in blocks. So the components are those of all links, while the number of
   pairs that are looked at stays far below the square of a large family.

Null or empty text, or text without words, has an empty set and links with nothing. Repeated rows are documents of their own;
a null id counts in frequencies and links but names no component unless all its members are null. An empty table gives an
empty table. Further columns are ignored. A long text is one row group. Equal 64-bit hashes count as equal shingles.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenscan.llm.blocks import apart, grams, mix, partitions, row_groups, run_starts, stored, text_bytes, words
from lumenscan.llm.components import components

WORDS, PERCENT = 5, 80
NEAR, GROUP, SHARD, BLOCK = 64, 1024, 4096, 512
_PARTS = "bucket int, base bigint, kind int, a binary, b binary, c binary, d binary"
TABLE = "ref bigint, doc_id bigint, n bigint, shared bigint, keys binary, prefix array<bigint>"
_LOW48 = np.uint64((1 << 48) - 1)


def needed(n):
    """Shingles of a set of n that a partner must share at least: overlap >= PERCENT % of the union >= PERCENT % of n."""
    return -(-n * PERCENT // 100)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every distinct shingle of every row, ordered by hash."""
    h, row = words(data, offsets, lower=True)
    g, r, _ = grams(h, row, 0, k)
    count = np.bincount(row, minlength=len(offsets) - 1)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        begin = np.searchsorted(row, few)
        extra = []
        for at, n in zip(begin, count[few]):
            acc = np.array([n], np.uint64)
            for j in range(at, at + n):
                acc = mix(acc + h[j:j + 1])
            extra.append(acc[0])
        g, r = np.concatenate([g, np.array(extra, np.uint64)]), np.concatenate([r, few])
    order = np.argsort(g, kind="stable")
    g, r = g[order], r[order]
    if len(g):
        first = np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])])
        # rows of equal hashes need not be neighbours, unless the order is by row as well
        if not np.all((g[1:] != g[:-1]) | (r[1:] >= r[:-1])):
            order = np.lexsort((r, g))
            g, r = g[order], r[order]
            first = np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])])
        g, r = g[first], r[first]
    return g, r


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.split()[0] for f in _PARTS.split(", ")])


def _deal(batches, buckets: int, k: int):
    """Row groups' shingles by bucket, and a row of what each document is."""
    for b in batches:
        data, off = text_bytes(b.column(2))
        refs = b.column(0).to_numpy()
        ids = b.column(1)
        # rows of several stored files may meet in a batch: a row group has consecutive numbers
        breaks = np.flatnonzero(np.diff(refs) != 1) + 1
        for lo, hi in row_groups(off):
            cuts = [lo, *breaks[(breaks > lo) & (breaks < hi)].tolist(), hi]
            for lo2, hi2 in ((a, min(z, a + 65536)) for y, z in zip(cuts, cuts[1:]) for a in range(y, z, 65536)):
                g, r = shingles(data[off[lo2]:off[hi2]], off[lo2:hi2 + 1] - off[lo2], k)
                base = int(refs[lo2])
                own = ids.slice(lo2, hi2 - lo2)
                rows = [(base % buckets, base, 1, own.fill_null(0).to_numpy().tobytes(), np.asarray(own.is_null()).astype(np.uint8).tobytes(), np.bincount(r, minlength=hi2 - lo2).astype(np.int64).tobytes(), None)]
                which = (g >> np.uint64(48)).astype(np.int64) * buckets >> 16       # ascending, as g is
                cut = np.searchsorted(which, np.arange(buckets + 1))
                low, high, ordinal = (g & np.uint64(0xFFFFFFFF)).astype(np.uint32), (g >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.uint16), r.astype(np.uint16)
                top = (g >> np.uint64(48)).astype(np.uint16)
                for q in range(buckets):
                    s = slice(cut[q], cut[q + 1])
                    if s.start < s.stop:
                        # the highest bits change seldom, as the hashes are in order: stored as runs
                        at = run_starts(top[s])
                        runs = np.concatenate([top[s][at].astype(np.uint32), np.diff(np.append(at, s.stop - s.start)).astype(np.uint32)])
                        rows.append((q, base, 0, low[s].tobytes(), high[s].tobytes(), ordinal[s].tobytes(), runs.tobytes()))
                yield _parts(rows)


def _count(part: pa.Table) -> pa.Table:
    """One bucket: document frequencies; what is shared returns to its row group."""
    rows = part.to_pylist()
    out = [tuple(r.values()) for r in rows if r["kind"] == 1]
    entries = sorted((r for r in rows if r["kind"] == 0), key=lambda r: r["base"])
    if entries:
        key, base, ordinal = [], [], []
        for i, r in enumerate(entries):
            runs = np.frombuffer(r["d"], np.uint32).reshape(2, -1)
            top = np.repeat(runs[0].astype(np.uint64), runs[1])
            key.append(top << np.uint64(48) | np.frombuffer(r["b"], np.uint16).astype(np.uint64) << np.uint64(32) | np.frombuffer(r["a"], np.uint32).astype(np.uint64))
            ordinal.append(np.frombuffer(r["c"], np.uint16))
            base.append(np.full(len(key[-1]), i, np.int32))
        key, base, ordinal = np.concatenate(key), np.concatenate(base), np.concatenate(ordinal)
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = run_starts(key)
        n = np.diff(np.append(at, len(key)))
        keep = np.repeat(n > 1, n)
        key, order, often = key[keep], order[keep], np.minimum(np.repeat(n, n)[keep], 0xFFFFFFFF).astype(np.uint32)
        base, ordinal = base[order], ordinal[order]
        back = np.argsort(base, kind="stable")
        cut = np.searchsorted(base[back], np.arange(len(entries) + 1))
        for i, r in enumerate(entries):
            s = back[cut[i]:cut[i + 1]]
            if len(s):
                out.append((r["bucket"], r["base"], 0, key[s].tobytes(), often[s].tobytes(), ordinal[s].tobytes(), None))
    return pa.Table.from_batches([_parts(out)]) if out else pa.Table.from_batches([], _parts([(0, 0, 0, b"", b"", b"", b"")]).schema)


def _gather(part: pa.Table) -> pa.Table:
    """One row group: the documents that may have partners get their shared shingles and their prefix."""
    rows = part.to_pylist()
    (meta,) = {(r["base"], r["a"], r["b"], r["c"]) for r in rows if r["kind"] == 1}
    base, ids, null, size = meta[0], np.frombuffer(meta[1], np.int64), np.frombuffer(meta[2], np.uint8).astype(bool), np.frombuffer(meta[3], np.int64)
    entries = sorted((r for r in rows if r["kind"] == 0), key=lambda r: r["bucket"])
    join = lambda c, t: np.concatenate([np.frombuffer(r[c], t) for r in entries]) if entries else np.zeros(0, t)
    key, often, ordinal = join("a", np.uint64), join("b", np.uint32), join("c", np.uint16)
    shared = np.bincount(ordinal, minlength=len(size))
    able = (shared >= needed(size)) & (size > 0)
    keep = able[ordinal]
    key, often, ordinal = key[keep], often[keep], ordinal[keep]
    order = np.lexsort((key, often, ordinal))
    key, ordinal = key[order], ordinal[order]
    begin = np.searchsorted(ordinal, np.arange(len(size) + 1))
    keys, prefix = [], []
    for i in range(len(size)):
        if not able[i]:
            keys.append(None)
            prefix.append(None)
            continue
        own = key[begin[i]:begin[i + 1]]
        prefix.append(own[:shared[i] - needed(size[i]) + 1].view(np.int64))
        keys.append(np.sort(own).tobytes())
    return pa.table({"ref": pa.array(base + np.arange(len(size)), pa.int64()), "doc_id": pa.array(ids, mask=null), "n": pa.array(size, pa.int64()), "shared": pa.array(shared, pa.int64()),
                     "keys": pa.array(keys, pa.binary()), "prefix": pa.array(prefix, pa.list_(pa.int64()))})


def shingle_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, ref_col: str | None = None) -> DataFrame:
    """Per document: size of its set; if it may have partners, the shared shingles (sorted) and the prefix.

    `ref_col` names the rows' numbers where they are stored; otherwise this read numbers them.
    """
    buckets = 2 * partitions(docs.sparkSession)
    src = docs.select((F.col(ref_col) if ref_col else F.monotonically_increasing_id()).alias("ref"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    dealt = src.mapInArrow(lambda batches: _deal(batches, buckets, k), _PARTS)
    counted = dealt.groupBy("bucket").applyInArrow(_count, _PARTS)
    return stored(counted.groupBy("base").applyInArrow(_gather, TABLE))


_LINKS = "u bigint, v bigint"


def _verify_shard(probes: pa.Table, targets: pa.Table) -> pa.Table:
    """Links between classes that join different parts of what this shard sees."""
    members: dict[int, list[tuple]] = {}
    for cid, gid, n, keys in zip(*(targets.column(c).to_pylist() for c in ("cid", "gid", "n", "keys"))):
        members.setdefault(gid, []).append((cid, n, np.frombuffer(keys, np.uint64)))
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    for a, na, keys, cands in zip(*(probes.column(c).to_pylist() for c in ("a", "na", "ka", "cands"))):
        ka = np.frombuffer(keys, np.uint64)
        for g in cands:
            for b, nb, kb in members.get(g, ()):
                if a == b or 100 * min(na, nb) < PERCENT * max(na, nb) or find(a) == find(b):
                    continue
                at = np.searchsorted(kb, ka)
                at[at == len(kb)] = 0
                both = int(np.count_nonzero(kb[at] == ka))
                if 100 * both >= PERCENT * (na + nb - both):
                    parent[find(a)] = find(b)
                    links.append((a, b))
    return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})


def verify(cands: DataFrame, classes: DataFrame, shards: int) -> DataFrame:
    """u, v: links found between the classes of groups `gid` and those of the groups in the array `cands`."""
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")
    split = F.filter(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(s.alias("s"), F.filter("cands", lambda g: shard(g) == s).alias("c"))), lambda x: F.size(x["c"]) > 0)
    probes = classes.join(cands.select("gid", F.explode(split).alias("x")), "gid").select(F.col("x.s").alias("s"), F.col("cid").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka"), F.col("x.c").alias("cands"))
    targets = classes.select(shard(F.col("gid")).alias("s"), *(F.col(c).alias(c) for c in ("cid", "gid", "n", "keys")))
    return probes.groupBy("s").cogroup(targets.groupBy("s")).applyInArrow(_verify_shard, _LINKS)


def near_groups(lists: DataFrame) -> DataFrame:
    """gid, cands: itself and, per shared prefix shingle, the NEAR groups before it that its size allows."""
    w = Window.partitionBy("key").orderBy("n", "gid").rowsBetween(-NEAR, -1)
    seen = lists.withColumn("before", F.collect_list(F.struct("gid", "n")).over(w))
    fit = F.transform(F.filter("before", lambda x: x["n"] * 100 >= F.col("n") * PERCENT), lambda x: x["gid"])
    return seen.select("gid", fit.alias("c")).groupBy("gid").agg(F.array_distinct(F.flatten(F.collect_list("c"))).alias("c")).select("gid", F.array_union("c", F.array("gid")).alias("cands"))


def far_groups(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """gid, cands: in lists longer than NEAR + 1, the groups of other components than one's own.

    `parts` has gid, part: the component of all members, or a value of its own for a group whose members differ.
    """
    long_ = lists.groupBy("key").count().where(F.col("count") > NEAR + 1)
    rows = lists.join(long_, "key").withColumnRenamed("count", "size").join(parts, "gid")
    often = rows.groupBy("key", "part").count().groupBy("key").agg(F.max(F.struct("count", "part")).alias("m"), F.count("*").alias("kinds")).where(F.col("kinds") > 1)
    blocks = (rows.join(often.select("key"), "key", "left_semi").withColumn("block", F.pmod(F.xxhash64("gid"), F.ceil(F.col("size") / BLOCK)))
              .groupBy("key", "block").agg(F.collect_list(F.struct("gid", "n", "part")).alias("them")))
    probes = rows.join(often.select("key", F.col("m.part").alias("main")), "key").where(F.col("part") != F.col("main")).drop("main", "size")
    met = probes.join(blocks, "key")
    fit = F.transform(F.filter("them", lambda x: (x["part"] != F.col("part")) & (F.least(x["n"], F.col("n")) * 100 >= F.greatest(x["n"], F.col("n")) * PERCENT)), lambda x: x["gid"])
    return met.select("gid", fit.alias("c")).where(F.size("c") > 0).groupBy("gid").agg(F.array_distinct(F.flatten(F.collect_list("c"))).alias("cands"))


def linked(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ckey, cid: class of every set that may have partners; cid, comp: component of every class that has a link)."""
    able = table.where(F.col("keys").isNotNull()).withColumn("ckey", F.concat_ws(":", F.col("n"), F.md5("keys"), F.when(F.col("shared") < F.col("n"), F.col("ref"))))
    names = stored(able.groupBy("ckey").agg(F.min("ref").alias("cid")))
    reps = able.join(names.select(F.col("cid").alias("ref")), "ref").select(F.col("ref").alias("cid"), "n", "keys", "prefix")
    reps = reps.withColumn("gkey", F.concat_ws(":", F.col("n"), F.md5(F.concat_ws(",", F.col("prefix").cast("array<string>")))))
    sizes = reps.groupBy("gkey").agg(F.count("*").alias("m"))
    salted = reps.join(sizes, "gkey").withColumn("gkey", F.concat_ws(":", "gkey", F.pmod(F.xxhash64("cid"), F.ceil(F.col("m") / GROUP))))
    gids = salted.groupBy("gkey").agg(F.min("cid").alias("gid"))
    classes = stored(salted.join(gids, "gkey").select("cid", "gid", "n", "keys", "prefix"))
    shards = max(1, -(-classes.count() // SHARD))
    lists = classes.where(F.col("cid") == F.col("gid")).select(F.explode("prefix").alias("key"), "gid", "n")
    slim = classes.drop("prefix")
    links = stored(verify(near_groups(lists), slim, shards))
    comps = components(links)
    known = slim.select("cid", "gid").join(comps, F.col("cid") == F.col("node"), "left").select("gid", F.coalesce("comp", "cid").alias("comp"))
    parts = known.groupBy("gid").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).select("gid", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(-1 - F.col("gid")).alias("part"))
    more = stored(verify(far_groups(lists, parts), slim, shards))
    if not more.isEmpty():
        comps = components(more.unionByName(comps.select(F.col("node").alias("u"), F.col("comp").alias("v"))))
    return names, comps


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ref_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), ref (the row) and is_first (of its component)."""
    table = shingle_table(docs, id_col, text_col, ref_col=ref_col)
    names, comps = linked(table)
    rows = table.withColumn("ckey", F.concat_ws(":", F.col("n"), F.md5("keys"), F.when(F.col("shared") < F.col("n"), F.col("ref"))))
    rows = rows.select("ref", "doc_id", "n", F.when(F.col("keys").isNotNull(), F.col("ckey")).alias("ckey"))
    plain = rows.where(F.col("ckey").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "ref", F.lit(True).alias("is_first"))
    of = names.join(comps, F.col("cid") == F.col("node"), "left").select("ckey", F.coalesce("comp", "cid").alias("comp"))
    rows = rows.where(F.col("ckey").isNotNull()).join(of, "ckey")
    least = rows.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "ref")).alias("first"))
    rest = rows.join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "ref", (F.col("ref") == F.col("first.ref")).alias("is_first"))
    return plain.unionByName(rest)


@apart("_ref")
def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are alone or the first of their component: smallest id, nulls last, then the earliest row.

    `docs` is read once: its rows are stored with their numbers, as a second read may deal them to other partitions.
    """
    docs = stored(docs.withColumn("_ref", F.monotonically_increasing_id()))
    later = near_duplicates(docs, id_col, text_col, "_ref").where(~F.col("is_first")).select(F.col("ref").alias("_ref"))
    return docs.join(later, "_ref", "left_anti").drop("_ref")
