"""Language model scoring by deleted interpolation of bigram, unigram and uniform estimates.

p(w | h) = a(b) c(hw) / c(h) + b(b) c(w) / N + u(b) / size, where b, the bucket of the context's frequency, is the binary logarithm of
c(h). The weights of each bucket are learned by expectation-maximisation on held-out counts: a part of the training documents
(crc32 of the id mod 10 = 1) is set aside, estimates come from the rest, and the held-out bigrams are summed by bucket and by
both estimates in quarter octaves. Final estimates use all training documents.

1. Words are counted over all training documents, in hash buckets. Words of more than N / 2**VOCABULARY_BITS occurrences are
   frequent, which that bound keeps below 2**VOCABULARY_BITS words; their counts go to all tasks.
2. Bigrams of two frequent words go, as pairs of their numbers in scrambled order, to buckets by pair, so that no frequent
   context meets in one task. A bigram with a rarer word goes, by 64-bit hashes, to the bucket of its rarer word (of two, the
   context), where all of the same bigram and that word's exact count meet; no task gets more of a word than that bound.
3. Counted bigrams of two rarer words go on to the bucket of their second word, for its count.
4. Each bucket gives its held-out sums, and, once the weights are known, its documents' partial scores.

So every word has its own counts at every size; words that no training document has count 0. With `bits`, words of at most
N / 2**bits occurrences are pooled in one class instead, shared out evenly.

Text is lower-cased (A-Z); every document ends in an end token. Null text is the empty text: one end token. Repeated rows count
and are scored each; a null id counts as the empty string in the split. Without training documents all base terms are
log10(0.1 / 0.1) = 0 and the model is uniform. An empty table gives an empty table; further columns are ignored. Long texts are
row groups of their own. Equal 64-bit hashes count as equal words.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.llm.blocks import crc_mod, partitions, row_groups, run_starts, stored, text_bytes, trim, words

VOCABULARY_BITS = 20
BUCKET_BYTES = 1 << 21
FOLDS, TEST, TUNE = 10, 0, 1
RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
_UNITS = "bucket int, keys binary, counts binary, kept binary"
_PARTS = "bucket int, base bigint, kind int, a binary, b binary, c binary, d binary, e binary"
_ROW = "bucket int, kind int, bases binary, sizes binary, x binary, place binary, sums binary, cells binary, amounts binary, metas binary, pairs binary"
_FREQUENT, _AHEAD, _COUNTED = 0, 1, 2      # kinds of these rows: pairs of frequent words, pairs that go on to their second word, pairs with their counts
_END, _START = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)     # stand for word hashes
_ROWS_MAX = 1 << 14          # documents of a row group: the place of a document is 14 bits, its role 2
_GROUP = 1 << 20             # bytes of text of a row group: a task's arrays are some 30 times that
_PAIR = 2 * (VOCABULARY_BITS + 1)
_MASK = np.uint64((1 << _PAIR) - 1)
_ODD = 0x9E3779B97F4A7C15 & ((1 << _PAIR) - 1) | 1
_INVERSE = np.uint64(pow(_ODD, -1, 1 << _PAIR))
_BINS = 128
_HELD = 1 << 21              # partial scores that a task sums up before it hands them on


def _groups(b):
    """(first ref, slice of rows, data, offsets, roles) of bounded row groups; roles: 0 test, 1 training, 2 training set aside."""
    data, off = text_bytes(b.column(2))
    refs, fold = b.column(0).to_numpy(), b.column(3).to_numpy()
    role = np.where(fold == TEST, 0, np.where(fold == TUNE, 2, 1))
    for lo, hi in row_groups(off, _GROUP):
        for a in range(lo, hi, _ROWS_MAX):
            z = min(hi, a + _ROWS_MAX)
            yield int(refs[a]), slice(a, z), data[off[a]:off[z]], off[a:z + 1] - off[a], role[a:z]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.int64) * buckets >> 32


def _slices(buckets: np.ndarray):
    """(bucket, slice) of every bucket that occurs in the ascending array; the others cost nothing."""
    at = run_starts(buckets)
    for a, z in zip(at.tolist(), np.append(at[1:], len(buckets)).tolist()):
        yield int(buckets[a]), slice(a, z)


def unigrams(src: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: the words of the training documents, sorted by hash, their counts, and those without the part set aside."""
    def count(batches):
        for b in batches:
            for _, _, data, off, role in _groups(b):
                h, row = words(data, off, lower=True)
                r = role[row]
                v, at = np.unique(h[r > 0], return_inverse=True)
                n, k = np.bincount(at, minlength=len(v)), np.bincount(at, r[r > 0] == 1, minlength=len(v)).astype(np.int64)
                rows = [(q, v[s].tobytes(), n[s].astype(np.int64).tobytes(), k[s].tobytes()) for q, s in _slices(_bucket(v, buckets))]
                if rows:
                    yield _batch(rows, _UNITS)

    def add(part: pa.Table) -> pa.Table:
        v, n, k = (np.concatenate([np.frombuffer(x.as_py(), t) for x in part.column(c)]) for c, t in (("keys", np.uint64), ("counts", np.int64), ("kept", np.int64)))
        order = np.argsort(v, kind="stable")
        v, n, k = v[order], n[order], k[order]
        at = run_starts(v)
        return pa.Table.from_batches([_batch([(part.column("bucket")[0].as_py(), v[at].tobytes(), np.add.reduceat(n, at).tobytes(), np.add.reduceat(k, at).tobytes())], _UNITS)])

    return stored(src.mapInArrow(count, _UNITS).groupBy("bucket").applyInArrow(add, _UNITS))


class Model:
    """Vocabulary and counts; numbers K, K + 1, K + 2 are the class of other words, the end and the start."""

    def __init__(self, keys, counts, kept, total, total_kept, types, docs, docs_kept, pooled):
        order = np.argsort(keys)
        self.keys = keys[order]
        self.k = len(keys)
        self.n, self.n_kept = total + docs, total_kept + docs_kept         # tokens with ends
        self.types = types + (docs > 0)
        self.pooled, self.other_types = pooled, types - self.k if pooled else 0
        self.size = (self.k if pooled else types) + 2
        self.hashes = np.concatenate([self.keys, np.array([0, _END, _START], np.uint64)])       # by number
        special = lambda c, t, d: np.concatenate([c[order], [t - c.sum(), d, d]]).astype(np.int64)
        self.count, self.kept = special(counts, total, docs), special(kept, total_kept, docs_kept)

    @property
    def unk(self):
        return self.k

    def numbers(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, h)
        at[at == self.k] = 0
        return np.where(self.keys[at] == h, at, self.k) if self.k else np.full(len(h), self.k)

    def special(self, h: np.ndarray) -> np.ndarray:
        """As `numbers`, of word hashes and the two signs."""
        return np.where(h == _END, self.k + 1, np.where(h == _START, self.k + 2, self.numbers(h)))

    def base(self, count):
        return np.log10((count + 0.1) / (self.n + 0.1 * (self.types + 1)))


def fit_vocabulary(units: DataFrame, src: DataFrame, bits: int, pooled: bool) -> Model:
    def sums(batches):
        for b in batches:
            for n, k in zip(b.column(2), b.column(3)):
                n, k = np.frombuffer(n.as_py(), np.int64), np.frombuffer(k.as_py(), np.int64)
                yield pa.RecordBatch.from_pydict({"n": [int(n.sum())], "k": [int(k.sum())], "t": [len(n)]})

    row = units.mapInArrow(sums, "n bigint, k bigint, t bigint").agg(F.sum("n"), F.sum("k"), F.sum("t")).first()
    total, kept, types = (int(x or 0) for x in row)
    least = total >> bits

    def frequent(batches):
        for b in batches:
            for v, n, k in zip(b.column(1), b.column(2), b.column(3)):
                v, n, k = np.frombuffer(v.as_py(), np.uint64), np.frombuffer(n.as_py(), np.int64), np.frombuffer(k.as_py(), np.int64)
                s = n > least
                yield pa.RecordBatch.from_pydict({"v": [v[s].tobytes()], "n": [n[s].tobytes()], "k": [k[s].tobytes()]})

    # fewer than 2**bits words can have more than total / 2**bits occurrences each
    found = units.mapInArrow(frequent, "v binary, n binary, k binary").collect()
    docs = src.select(F.count_if(F.col("fold") != TEST), F.count_if((F.col("fold") != TEST) & (F.col("fold") != TUNE))).first()
    join = lambda c, t: np.concatenate([np.frombuffer(r[c], t) for r in found]) if found else np.zeros(0, t)
    return Model(join("v", np.uint64), join("n", np.int64), join("k", np.int64), total, kept, types, int(docs[0]), int(docs[1]), pooled)


def _deal(batches, model: Model, buckets: int):
    """Per row group: its pairs by bucket (0), its rarer words by bucket if they are pooled (1), its documents (2), its pairs with
    rarer words (3): of two, of a rarer and a frequent one, of a frequent and a rarer one. Every word stands before another or the
    end, so each occurrence of a rarer word is in its own bucket once, as the first of a pair."""
    m = np.uint64(model.k + 3)
    for b in batches:
        for base, rows_at, data, off, role in _groups(b):
            n_docs = len(role)
            h, row = words(data, off, lower=True)
            v, inverse = np.unique(h, return_inverse=True)
            number = model.numbers(v)[inverse].astype(np.uint64)
            other = number == model.unk
            size = np.bincount(row, minlength=n_docs)
            # every document's words, then its end; what stands before each is its context
            slot = np.arange(len(h)) + row
            doc = np.repeat(np.arange(n_docs), size + 1)
            token = np.full(len(doc), model.k + 1, np.uint64)
            token[slot] = number
            context = np.empty_like(token)
            context[1:] = token[:-1]
            first = np.cumsum(size + 1) - size - 1
            context[first] = model.k + 2
            place = (doc | role[doc] << 14).astype(np.uint16)
            rows = []
            if not model.pooled:
                far = (token == model.unk) | (context == model.unk)
                if far.any():
                    sign = np.full(len(doc), _END)
                    sign[slot] = h
                    before = np.empty_like(sign)
                    before[1:] = sign[:-1]
                    before[first] = _START
                    a, z, p, by_context = before[far], sign[far], place[far], context[far] == model.unk
                    number_a, number_z = context[far].astype(np.uint32), token[far].astype(np.uint32)
                    two = by_context & (number_z == model.unk)
                    # a frequent partner goes as its number, half as long as a hash; a bucket gets all three kinds in one row
                    sets = []
                    for at, key, partner in ((two, a, z), (by_context & ~two, a, number_z), (~by_context, z, number_a)):
                        at = np.flatnonzero(at)
                        at = at[np.argsort(_bucket(key[at], buckets), kind="stable")]
                        key, partner, where = key[at], partner[at], p[at]
                        sets.append({q: (key[c].tobytes(), partner[c].tobytes(), where[c].tobytes()) for q, c in _slices(_bucket(key, buckets))})
                    for q in sorted(set().union(*sets)):
                        got = [x.get(q, (b"", b"", b"")) for x in sets]
                        rows.append((q, base, 3, b"".join(x[0] for x in got), got[0][1], b"".join(x[2] for x in got), got[1][1] + got[2][1], np.array([len(x[0]) // 8 for x in got], np.int64).tobytes()))
                    token, context, place = token[~far], context[~far], place[~far]
            x = (context * m + token) * np.uint64(_ODD) & _MASK
            order = np.argsort(x, kind="stable")
            x, place = x[order], place[order]
            which = (x >> np.uint64(_PAIR - 32)).astype(np.int64) * buckets >> 32
            low, top = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
            for q, s in _slices(which):
                at = run_starts(top[s])
                rows.append((q, base, 0, low[s].tobytes(), place[s].tobytes(), top[s][at].tobytes(), np.diff(np.append(at, s.stop - s.start)).astype(np.uint32).tobytes(), None))
            if model.pooled and other.any():
                rare = np.flatnonzero(other)
                rare = rare[np.argsort(h[rare], kind="stable")]
                rows += [(q, base, 1, h[rare[c]].tobytes(), row[rare[c]].astype(np.uint16).tobytes(), None, None, None) for q, c in _slices(_bucket(h[rare], buckets))]
            known = model.count[number.astype(np.int64)]
            sums = np.bincount(row[~other], model.base(known[~other]), minlength=n_docs) + model.base(model.count[model.k + 1])
            n_known = np.bincount(row[~other], minlength=n_docs) + (model.count[model.k + 1] > 0)
            ids = b.column(1).slice(rows_at.start, n_docs)
            flat = np.concatenate([ids.fill_null(0).to_numpy(), np.asarray(ids.is_null()).astype(np.int64), role, size + 1, n_known, np.bincount(row[other], minlength=n_docs)]).astype(np.int64)
            rows.append((base % buckets, base, 2, flat.tobytes(), sums.tobytes(), None, None, None))
            yield _batch(rows, _PARTS)
        trim()


def _join(items: list[tuple[int, bytes, bytes]]) -> bytes:
    """Several (base, a, b) as one value."""
    head = np.array([(base, len(a), len(b)) for base, a, b in items], np.int64)
    return len(items).to_bytes(8, "little") + head.tobytes() + b"".join(a + b for _, a, b in items)


def _split(value: bytes) -> list[tuple[int, bytes, bytes]]:
    n = int.from_bytes(value[:8], "little")
    at, out = 8 + 24 * n, []
    for base, a, b in np.frombuffer(value[8:at], np.int64).reshape(n, 3).tolist():
        out.append((base, value[at:at + a], value[at + a:at + a + b]))
        at += a + b
    return out


def frequency_bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, 1 + np.floor(np.log2(np.maximum(c, 1))), 0).astype(np.int64)


def _bin(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.clip(np.rint(-4 * np.log2(p)), 0, _BINS - 2), 0).astype(np.int64)


class Pairs:
    """A bucket's pairs in order, with counts over training documents and over those that were not set aside."""

    def __init__(self, x: np.ndarray, role: np.ndarray, model: Model):
        self.order = np.argsort(x, kind="stable")
        x, self.role = x[self.order], role[self.order]
        self.at = run_starts(x)
        pair = x[self.at] * _INVERSE & _MASK
        self.context, self.token = (v.astype(np.int64) for v in np.divmod(pair, np.uint64(model.k + 3)))
        add = lambda v: np.add.reduceat(v.astype(np.int64), self.at) if len(x) else np.zeros(0, np.int64)
        self.train, self.kept, self.tune = add(self.role > 0), add(self.role == 1), add(self.role == 2)


def _cells(context: np.ndarray, token: np.ndarray, pair: np.ndarray, tune: np.ndarray, model: Model) -> tuple[bytes, bytes]:
    """Held-out sums of pairs by the estimates' cells; counts are those without the part set aside."""
    s = tune > 0
    c = context[s]
    with np.errstate(divide="ignore", invalid="ignore"):
        two = np.where(c > 0, pair[s] / c, 0.0)
    one = token[s] / max(model.n_kept, 1)
    cell = (frequency_bucket(c) * _BINS + _bin(two)) * _BINS + _bin(one)
    cells, where = np.unique(cell, return_inverse=True)
    return cells.tobytes(), np.bincount(where, tune[s], minlength=len(cells)).astype(np.float64).tobytes()


def _units(units: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's words, their counts and those without the part set aside."""
    if not units.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.frombuffer(units.column(c)[0].as_py(), t) for c, t in (("keys", np.uint64), ("counts", np.int64), ("kept", np.int64)))


def _counts(h: np.ndarray, words_: tuple, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, count without the part set aside, whether frequent or a sign) of hashes; a rarer word's are those of this bucket."""
    number = model.special(h)
    often = number != model.unk
    n, k = model.count[number], model.kept[number]
    keys, counts, kept = words_
    if len(keys):
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        hit = keys[at] == h
        n, k = np.where(often, n, np.where(hit, counts[at], 0)), np.where(often, k, np.where(hit, kept[at], 0))
    else:
        n, k = np.where(often, n, 0), np.where(often, k, 0)
    return n, k, often


def _part(bases: np.ndarray, group: np.ndarray, index: np.ndarray, place: np.ndarray) -> tuple[tuple, np.ndarray]:
    """(row groups, their sizes, numbers of pairs, places) of occurrences in order of their row groups; the pairs numbered."""
    groups, sizes = np.unique(group, return_counts=True)
    pairs, x = np.unique(index, return_inverse=True)
    return (bases[groups].tobytes(), sizes.astype(np.int64).tobytes(), x.astype(np.uint32).tobytes(), place.tobytes()), pairs


def _counted(bucket: int, part: tuple, c, ck, t, tk, train, kept, tune, model: Model) -> tuple:
    cells, amounts = _cells(ck, tk, kept, tune, model)
    return (bucket, _COUNTED, *part, None, cells, amounts, None, np.concatenate([c, t, train]).astype(np.int64).tobytes())


def _both(r: dict, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of both words of a row's pairs: of two rarer words, of a rarer and a frequent one, of a frequent and a rarer one."""
    key, n = np.frombuffer(r["a"], np.uint64), np.frombuffer(r["e"], np.int64)
    partner = model.hashes[np.frombuffer(r["d"], np.uint32)]
    first = n[0] + n[1]
    return np.concatenate([key[:first], partner[n[1]:]]), np.concatenate([np.frombuffer(r["b"], np.uint64), partner[:n[1]], key[first:]])


def _rarer(rows: list[dict], words_: tuple, model: Model, buckets: int) -> list[tuple]:
    """Pairs with a rarer word, in its bucket: with their counts, or on the way to their second word."""
    bucket, bases = rows[0]["bucket"], np.array([r["base"] for r in rows], np.int64)
    a, b = (np.concatenate(x) for x in zip(*(_both(r, model) for r in rows)))
    place = np.concatenate([np.frombuffer(r["c"], np.uint16) for r in rows])
    group = np.repeat(np.arange(len(rows)), [len(r["c"]) // 2 for r in rows])
    order = np.lexsort((b, a))
    new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
    index = np.empty(len(a), np.int64)
    index[order] = np.cumsum(new) - 1
    a, b = a[order][new], b[order][new]
    role = place >> 14
    train, kept, tune = (np.bincount(index, s, minlength=len(a)).astype(np.int64) for s in (role > 0, role == 1, role == 2))
    c, ck, _ = _counts(a, words_, model)
    t, tk, often = _counts(b, words_, model)
    target = np.where(often, bucket, _bucket(b, buckets))
    out, to = [], target[index]
    order = np.argsort(to, kind="stable")
    cut = np.append(np.flatnonzero(np.append(True, to[order][1:] != to[order][:-1])), len(to))
    for lo, hi in zip(cut[:-1], cut[1:]):
        s = order[lo:hi]
        part, p = _part(bases, group[s], index[s], place[s])
        if to[s[0]] == bucket:
            out.append(_counted(bucket, part, c[p], ck[p], t[p], tk[p], train[p], kept[p], tune[p], model))
        else:
            out.append((int(to[s[0]]), _AHEAD, *part, None, None, None, None, np.concatenate([b[p].view(np.int64), c[p], ck[p], train[p], kept[p], tune[p]]).tobytes()))
    return out


def _second(parts: pa.Table, units: pa.Table, model: Model) -> pa.Table:
    """Pairs that came to the bucket of their second word, with its counts."""
    rows = parts.to_pylist()
    if not rows:
        return pa.Table.from_batches([], _batch([], _ROW).schema)
    pairs = [np.frombuffer(r["pairs"], np.int64).reshape(6, -1) for r in rows]
    begin = np.cumsum([0] + [p.shape[1] for p in pairs])
    b, c, ck, train, kept, tune = np.concatenate(pairs, axis=1)
    t, tk, _ = _counts(b.view(np.uint64), _units(units), model)
    x = np.concatenate([np.frombuffer(r["x"], np.uint32) + n for r, n in zip(rows, begin)]).astype(np.uint32)
    part = (*(b"".join(r[k] for r in rows) for k in ("bases", "sizes")), x.tobytes(), b"".join(r["place"] for r in rows))
    return pa.Table.from_batches([_batch([_counted(rows[0]["bucket"], part, c, ck, t, tk, train, kept, tune, model)], _ROW)])


def _trimmed(result: pa.Table) -> pa.Table:
    trim()
    return result


def _merge(parts: pa.Table, units: pa.Table, model: Model, buckets: int) -> pa.Table:
    rows = sorted(parts.to_pylist(), key=lambda r: (r["base"], r["kind"]))
    if not rows:
        return pa.Table.from_batches([], _batch([], _ROW).schema)
    pairs = [r for r in rows if r["kind"] == 0]
    x = [np.repeat(np.frombuffer(r["c"], np.uint32), np.frombuffer(r["d"], np.uint32)).astype(np.uint64) << np.uint64(32) | np.frombuffer(r["a"], np.uint32) for r in pairs]
    x = np.concatenate(x) if x else np.zeros(0, np.uint64)
    place = np.concatenate([np.frombuffer(r["b"], np.uint16) for r in pairs]) if pairs else np.zeros(0, np.uint16)
    p = Pairs(x, place >> 14, model)
    cells, amounts = _cells(model.kept[p.context], model.kept[p.token], p.kept, p.tune, model)
    words_ = _units(units)
    keys, counts, _ = words_
    sums = []
    for r in rows:
        if r["kind"] in (1, 3):
            h, row = np.frombuffer(r["a"], np.uint64), (np.frombuffer(r["b"], np.uint16) if r["kind"] == 1 else np.frombuffer(r["c"], np.uint16) & np.uint16(_ROWS_MAX - 1)).astype(np.int64)
            if r["kind"] == 3:
                first = int(np.frombuffer(r["e"], np.int64)[:2].sum())
                h, row = h[:first], row[:first]
            n = np.zeros(len(h), np.int64)
            if len(keys):
                at = np.searchsorted(keys, h)
                at[at == len(keys)] = 0
                n = np.where(keys[at] == h, counts[at], 0)
            docs, where = np.unique(row, return_inverse=True)
            # documents, then how many of these words are known, then the base terms' sums
            got = np.concatenate([docs.astype(np.float64), np.bincount(where, n > 0, minlength=len(docs)), np.bincount(where, model.base(n), minlength=len(docs))])
            sums.append((r["base"], got.tobytes(), b""))
    metas = [(r["base"], r["a"], r["b"]) for r in rows if r["kind"] == 2]
    # of x, 42 bits, the low and the high part are kept apart
    row = (rows[0]["bucket"], _FREQUENT, np.array([r["base"] for r in pairs], np.int64).tobytes(), np.array([len(r["b"]) // 2 for r in pairs], np.int64).tobytes(),
           x.astype(np.uint32).tobytes() + (x >> np.uint64(32)).astype(np.uint16).tobytes(), place.tobytes(), _join(sums), cells, amounts, _join(metas), None)
    rarer = [r for r in rows if r["kind"] == 3]
    return pa.Table.from_batches([_batch([row] + (_rarer(rarer, words_, model, buckets) if rarer else []), _ROW)])


def weights(cells: np.ndarray, amounts: np.ndarray, size: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) per frequency bucket by expectation-maximisation on held-out sums."""
    b, two, one = cells // (_BINS * _BINS), cells // _BINS % _BINS, cells % _BINS
    value = lambda q: np.where(q > 0, 2.0 ** (-(q - 1) / 4), 0.0)
    p = np.stack([value(two), value(one), np.full(len(cells), 1.0 / size)], 1)

    def learn(at):
        w = np.array([0.4, 0.4, 0.2])
        for _ in range(rounds):
            part = p[at] * w
            w = (part / part.sum(1, keepdims=True) * amounts[at, None]).sum(0)
            w = np.maximum(w / w.sum(), 1e-7)
            w /= w.sum()
        return w

    every = learn(np.arange(len(cells))) if len(cells) else np.array([0.4, 0.4, 0.2])
    table = np.tile(every, (66, 1))
    for k in np.unique(b):
        table[k] = learn(np.flatnonzero(b == k))
    return table


def _score(batches, model: Model, table: np.ndarray):
    """Partial scores of the documents of each bucket, by row group, beside what `_merge` had summed."""
    other = -np.log10(model.other_types + 1.0)
    held: dict[int, np.ndarray] = {}
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["base", "kind", "a", "b"])

    def logs(c: np.ndarray, t: np.ndarray, train: np.ndarray) -> np.ndarray:
        w = table[frequency_bucket(c)]
        return np.log10(w[:, 1] * (t / max(model.n, 1)) + w[:, 2] / model.size + w[:, 0] * train / np.maximum(c, 1))

    def share(bases, sizes, place, each) -> None:
        ends = np.append(0, np.cumsum(sizes))
        for k, base in enumerate(bases.tolist()):
            doc = (place[ends[k]:ends[k + 1]] & (_ROWS_MAX - 1)).astype(np.int64)
            got = np.bincount(doc, each[ends[k]:ends[k + 1]])
            have = held.get(base)
            if have is None or len(have) < len(got):
                held[base] = got if have is None else got + np.append(have, np.zeros(len(got) - len(have)))
            else:
                have[:len(got)] += got

    for b in batches:
        for i in range(b.num_rows):       # a row is large: one at a time
            r = {name: column[i].as_py() for name, column in zip(b.schema.names, b.columns)}
            if sum(map(len, held.values())) > _HELD:
                yield batch([(base, 0, v.tobytes(), None) for base, v in held.items()])
                held.clear()
            bases, sizes = np.frombuffer(r["bases"], np.int64), np.frombuffer(r["sizes"], np.int64)
            n = int(sizes.sum())
            if r["kind"] == _COUNTED:
                c, t, train = np.frombuffer(r["pairs"], np.int64).reshape(3, -1)
                place, each = np.frombuffer(r["place"], np.uint16), logs(c, t, train)[np.frombuffer(r["x"], np.uint32)]
                share(bases, sizes, place, each)
                continue
            x = np.frombuffer(r["x"][:4 * n], np.uint32).astype(np.uint64) | np.frombuffer(r["x"][4 * n:], np.uint16).astype(np.uint64) << np.uint64(32)
            place = np.frombuffer(r["place"], np.uint16)
            p = Pairs(x, place >> 14, model)
            value = logs(model.count[p.context], model.count[p.token], p.train) + np.where(p.token == model.unk, other, 0.0)
            each = np.empty(n)
            each[p.order] = np.repeat(value, np.diff(np.append(p.at, n)))
            share(bases, sizes, place, each)
            out = [(base, 1, a, None) for base, a, _ in _split(r["sums"])] + [(base, 2, a, s) for base, a, s in _split(r["metas"])]
            if out:
                yield batch(out)
        trim()
    if held:
        yield batch([(base, 0, v.tobytes(), None) for base, v in held.items()])


def _finish(part: pa.Table, total: int) -> pa.Table:
    rows = part.to_pylist()
    meta = next(r for r in rows if r["kind"] == 2)
    ids, null, role, size, known, _ = np.frombuffer(meta["a"], np.int64).reshape(6, -1)
    base, score, known = np.frombuffer(meta["b"], np.float64).copy(), np.zeros(len(ids)), known.copy()
    for r in sorted((r for r in rows if r["kind"] < 2), key=lambda r: (r["kind"], r["a"], r["b"] or b"")):
        if r["kind"] == 0:
            part_score = np.frombuffer(r["a"], np.float64)
            score[:len(part_score)] += part_score
        else:
            docs, n, s = np.frombuffer(r["a"], np.float64).reshape(3, -1)
            base[docs.astype(np.int64)] += s
            known[docs.astype(np.int64)] += n.astype(np.int64)
    return pa.table({"doc_id": pa.array(ids, mask=null.astype(bool)), "held_out": pa.array(role == 0), "n_tokens": pa.array(size), "n_known": pa.array(known),
                     "train_tokens": pa.array(np.full(len(ids), total, np.int64)), "base_score": pa.array(base), "score": pa.array(score)})


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None, held: int = VOCABULARY_BITS) -> DataFrame:
    """Every document's scores. Without `bits` no word is pooled, and words of more than N / 2**held occurrences count as frequent."""
    spark = docs.sparkSession
    src = docs.select(F.monotonically_increasing_id().alias("ref"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"),
                      crc_mod(F.col(id_col), FOLDS).cast("int").alias("fold"))
    # a bucket's arrays are those of some BUCKET_BYTES of text, whatever the size of the corpus and the number of partitions
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * partitions(spark), size // BUCKET_BYTES)
    units = unigrams(src, buckets)
    fitted = fit_vocabulary(units, src.select("fold"), held if bits is None else bits, bits is not None)
    model = spark.sparkContext.broadcast(fitted)
    dealt = src.mapInArrow(lambda batches: _deal(batches, model.value, buckets), _PARTS)
    table = stored(dealt.groupBy("bucket").cogroup(units.groupBy("bucket")).applyInArrow(lambda p, u: _trimmed(_merge(p, u, model.value, buckets)), _ROW))
    if bits is None:
        ahead = table.where(F.col("kind") == _AHEAD).groupBy("bucket").cogroup(units.groupBy("bucket"))
        table = table.where(F.col("kind") != _AHEAD).unionByName(stored(ahead.applyInArrow(lambda p, u: _trimmed(_second(p, u, model.value)), _ROW)))

    def cells(batches):
        for b in batches:
            for c, n in zip(b.column(0), b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(c.as_py(), np.int64)), pa.array(np.frombuffer(n.as_py(), np.float64))], ["cell", "n"])

    # at most 66 x 128 x 128 cells, whatever the corpus
    sums = table.select("cells", "amounts").mapInArrow(cells, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").collect()
    mix = weights(np.array([r["cell"] for r in sums], np.int64), np.array([r["n"] for r in sums], np.float64), fitted.size)
    partial = table.drop("bucket", "cells", "amounts").mapInArrow(lambda batches: _score(batches, model.value, mix), "base bigint, kind int, a binary, b binary")
    total = fitted.n
    return partial.groupBy("base").applyInArrow(lambda part: _finish(part, total), RESULT)
