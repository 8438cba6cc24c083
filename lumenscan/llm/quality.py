"""Quality classifier: supervised subword embeddings.

Every word and every character n-gram of it (with its borders, 3 to 5 characters) hashes to one of BUCKETS vectors. Word n-grams
enter by their pattern, whatever the words: a word that equals the one 1, 2 or 3 places before it adds a vector of its own. A
document is the average of the vectors of all its words, n-grams and patterns and of one end sign, and a softmax over two classes is read from
that average. Vectors and output weights are learned by stochastic gradient descent in numpy, one document at a step, in one
task, on at most SAMPLE labelled documents with the smallest hashes of their ids. Averages are linear, so scoring needs one
number per bucket: the vector times the difference of the two output columns; this table of fixed size goes to every task.

Null text is the empty text, whose only feature is the end sign. Labels of null quality or id do not count; a document with
several labels counts by its smallest. Without any label all scores are 0.5. Repeated rows are scored alike and trained on
once; null ids are scored. An empty table gives an empty table. Inputs of a score are bytes of the text only; further columns
are passed through or ignored, whatever their names. Texts of any length are read whole, in row groups.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenscan.llm.blocks import crc_mod, mix, row_groups, run_starts, text_bytes, trim, words

BITS, DIMS, SAMPLE, EPOCHS, RATE, SIZES, SEED = 18, 10, 4000, 5, 0.5, (3, 4, 5), 3
BUCKETS = 1 << BITS
GROUP_BYTES = 1 << 20     # bytes of text whose arrays (some 100 times that) a task holds at once
_END = 0            # bucket of the end sign; the next ones are those of the patterns
LAGS = (1, 2, 3)
_SHIFT = np.uint64(64 - BITS)


def grams_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of the character n-grams of the words at data[start:end], borders as spaces."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = end - start + 1
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    joined = np.full(int(size.sum()), 32, np.uint8)
    at = np.arange(len(joined)) - np.repeat(begin, size)
    inside = at < np.repeat(size - 1, size)
    joined[inside] = data[(np.repeat(start, size) + at)[inside]]
    text = (b" " + joined.tobytes()).decode("utf-8", "replace")
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    gap = code == 32
    word = np.cumsum(gap) - 1            # of the sign behind or at a border
    value = mix(code.astype(np.uint64) + np.uint64(1))
    who, what = [], []
    for n in SIZES:
        m = len(code) - n + 1
        if m <= 0:
            continue
        acc = np.full(m, n, np.uint64)
        blocked = np.zeros(m, bool)
        for j in range(n):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + value[j:j + m]
            if 0 < j < n - 1:
                blocked |= gap[j:j + m]
        ok = np.flatnonzero(~blocked)
        who.append(word[ok])
        what.append((mix(acc[ok]) >> _SHIFT).astype(np.int64))
    return np.concatenate(who), np.concatenate(what)


def distinct_words(data: np.ndarray, offsets: np.ndarray):
    """Distinct words' hashes and byte ranges, and each word's index among them and its row."""
    h, row, start, end = words(data, offsets, spans=True)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    return h[first], start[first], end[first], inverse, row


def repeats(word: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """For each lag the rows of the words that equal the one so many places before."""
    return [row[k:][(word[k:] == word[:-k]) & (row[k:] == row[:-k])] for k in LAGS]


def document_features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights (summing to 1) of one text."""
    h, start, end, inverse, row = distinct_words(data, np.array([0, len(data)]))
    count = np.bincount(inverse, minlength=len(h))
    who, what = grams_of(data, start, end)
    bucket = np.concatenate([(h >> _SHIFT).astype(np.int64), what, [_END, *LAGS]])
    weight = np.concatenate([count, count[who], [1], [len(r) for r in repeats(inverse, row)]]).astype(np.float64)
    order = np.argsort(bucket, kind="stable")
    at = run_starts(bucket[order])
    sums = np.add.reduceat(weight[order], at)
    return bucket[order][at].astype(np.int32), (sums / sums.sum()).astype(np.float32)


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """One number per bucket: its share in the log odds of label 1."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    out = np.zeros((DIMS, 2), np.float32)
    steps, done = EPOCHS * len(features), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(features)):
            rate = RATE * (1 - done / steps)
            done += 1
            at, w = features[i]
            hidden = w @ vectors[at]
            z = hidden @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            # a long document spreads its step over many vectors; the root of their number keeps the steps comparable
            vectors[at] -= rate * np.outer(w * len(at) ** 0.5, back)
    return vectors @ (out[:, 1] - out[:, 0])


def margins(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log odds of label 1 of every row."""
    n = len(offsets) - 1
    result = np.zeros(n)
    for a, b in row_groups(offsets, GROUP_BYTES):
        part, off = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        h, start, end, inverse, row = distinct_words(part, off)
        who, what = grams_of(part, start, end)
        total = table[(h >> _SHIFT).astype(np.int64)].astype(np.float64) + np.bincount(who, table[what], minlength=len(h))
        size = 1 + np.bincount(who, minlength=len(h))
        again = [np.bincount(r, minlength=b - a) for r in repeats(inverse, row)]
        sums = np.bincount(row, total[inverse], minlength=b - a) + table[_END] + sum(table[k] * n for k, n in zip(LAGS, again))
        result[a:b] = sums / (np.bincount(row, size[inverse], minlength=b - a) + 1 + sum(again))
    return result


def sample_labels(labels: DataFrame, condition, limit: int = SAMPLE) -> DataFrame:
    rows = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(condition)
    rows = rows.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, condition=None, limit: int = SAMPLE) -> np.ndarray:
    """The model of at most `limit` labelled documents (doc_id, text) whose label row meets `condition`."""
    chosen = sample_labels(labels, F.lit(True) if condition is None else condition, limit)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit(b"")).alias("text"), "quality")).alias("r")).select("r.*", "doc_id")

    def featurize(batches):
        for b in batches:
            data, off = text_bytes(b.column(0))
            got = [document_features(data[off[i]:off[i + 1]]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), pa.array([x.tobytes() for x, _ in got], pa.binary()), pa.array([w.tobytes() for _, w in got], pa.binary())], ["doc_id", "quality", "at", "w"])

    def learn(batches):
        got = [(d, y, np.frombuffer(a, np.int32), np.frombuffer(w, np.float32)) for b in batches for d, y, a, w in zip(*(b.column(i).to_pylist() for i in range(4)))]
        got.sort(key=lambda r: r[0])
        model = train([r[2:] for r in got], np.array([int(r[1] > 0) for r in got])) if got else np.zeros(BUCKETS, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([model.astype(np.float32).tobytes()], pa.binary())], ["model"])

    features = rows.mapInArrow(featurize, "doc_id bigint, quality int, at binary, w binary")
    return np.frombuffer(features.repartition(1).mapInArrow(learn, "model binary").first()[0], np.float32)


def with_score(docs: DataFrame, model: np.ndarray, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of `docs` and the probability of label 1 as a last column `name`."""
    at = docs.columns.index(text_col)
    schema = T.StructType(list(docs.schema.fields) + [T.StructField(name, T.DoubleType())])

    def run(batches):
        for b in batches:
            data, off = text_bytes(b.column(at))
            m = margins(data, off, model)
            trim()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(m, -500, 500))), pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; rows of crc32(doc_id) mod 4 = 2 are held out of training."""
    model = fit(docs, labels, crc_mod(F.col("doc_id"), 4) != 2)
    s = with_score(docs.select("doc_id", "text"), model)
    return s.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
