import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenscan.llm import resampling

K = resampling.BUCKETS


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, target, percent=10, least=20):
    bucket = lambda w: zlib.crc32(w.encode()) % K
    s, t = np.zeros(K, int), np.zeros(K, int)
    for _, x in rows:
        for w in tokens(x):
            s[bucket(w)] += 1
    for x in target:
        for w in tokens(x):
            t[bucket(w)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (float(s.sum()) + K) / ((a + 1) * (float(t.sum()) + K)))) for a, b in zip(s.tolist(), t.tolist())]
    out = []
    for d, x in rows:
        g = [gain[bucket(w)] for w in tokens(x)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, out), key=str)


def got(docs, target, **more):
    return sorted((tuple(r) for r in resampling.resampled(docs, target, **more).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def frames(spark, rows, target):
    """With columns that clash with those of the operator."""
    return (spark.createDataFrame([(d, t, 5, 1, "z", 2, 3) for d, t in rows], "doc_id long, text string, score int, rank int, ref string, weight int, _at int"),
            spark.createDataFrame([(x, 1) for x in target], "text string, bucket int"))


def texts(seed, n, vocabulary=300):
    r = random.Random(seed)
    return [" ".join(r.choice(["Ünï", "wörd", "TOKEN"]) + str(r.randrange(vocabulary)) for _ in range(r.randrange(5, 60))) for _ in range(n)]


@pytest.mark.parametrize("percent", [10, 35, 100, 0])
def test_against_brute_force(spark, percent):
    rows = [(i * 37 % 1009, t) for i, t in enumerate(texts(1, 300))] + [(2000, None), (2001, ""), (2002, "--- ..."), (None, texts(9, 1)[0]), (None, None)]
    target = texts(2, 40, 60) + [None, ""]
    assert got(*frames(spark, rows, target), percent=percent) == brute(rows, target, percent)


def test_ties_and_repeated_rows(spark):
    """Equal texts differ by their ids' noise only; repeated rows are drawn one by one, with ranks of their own."""
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(7, text)] * 50 + [(None, text)] * 30 + [(i, text) for i in range(20)]
    target = [text]
    for percent in (5, 33, 60):
        mine, want = got(*frames(spark, rows, target), percent=percent), brute(rows, target, percent)
        assert mine == want


def test_words_in_slices_and_long_texts(spark, monkeypatch):
    long_ = " ".join(texts(4, 3000)) + " " + "é" * 300 + " " + "z" * 5000
    data = long_.encode() + b"tail"
    off = np.array([0, len(long_.encode()), len(data)])
    for size in (64, 1 << 20):
        monkeypatch.setattr(resampling, "SLICE", size)
        found = list(resampling.word_buckets(np.frombuffer(data, np.uint8), off, K))
        b, r = (np.concatenate(x) for x in zip(*found))
        assert b.tolist() == [zlib.crc32(w.encode()) % K for w in tokens(long_)] + [zlib.crc32(b"tail") % K] and (r == 0).sum() == len(b) - 1
    monkeypatch.undo()
    rows = [(1, long_), (2, "short text")] + list(enumerate(texts(5, 30), 3))
    assert got(*frames(spark, rows, texts(6, 5))) == brute(rows, texts(6, 5))


def test_empty_tables(spark):
    docs, target = frames(spark, list(enumerate(texts(7, 40))), texts(8, 3))
    assert got(docs.limit(0), target) == []
    assert got(docs, target.limit(0)) == brute(list(enumerate(texts(7, 40))), [])


def test_cutoff_takes_the_first_rows(spark):
    r = random.Random(3)
    rows = [(r.randrange(-4, 4), r.randrange(-3, 3), i) for i in range(200)]
    df = spark.createDataFrame(rows, "a long, b long, c long").persist()
    for k in (0, 1, 7, 100, 199, 200):
        picked = sorted(tuple(x) for x in df.where(resampling.cutoff(df, [F.col("a"), F.col("b"), F.col("c")], k)).collect())
        assert picked == sorted(rows)[:k]
    df.unpersist()
