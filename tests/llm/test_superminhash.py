import random

import numpy as np
import pytest

from lumenscan.llm import superminhash
from test_jaccard import family, sets

SF = "/root/testdata/sf0.001"


def brute(rows, words=3, percent=85):
    s = [sets(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, x in enumerate(s):
        for g in x:
            where.setdefault(g, []).append(i)
    for i, x in enumerate(s):
        for j in {j for g in x for j in where[g] if j > i}:
            both = len(x & s[j])
            if 100 * both >= percent * (len(x) + len(s[j]) - both):
                parent[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in superminhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def frame(spark, rows):
    """With columns that clash with those of the operator."""
    return spark.createDataFrame([(*r, "x", 1, "y", "z", 2) for r in rows], "doc_id long, text string, text_md5 string, n int, digest string, _md5 string, cid int")


def slow(elements, slots):
    """SuperMinHash by its definition: element by element, each with its own permutation."""
    sig = [None] * slots
    for e in elements:
        perm = list(range(slots))
        for j in range(slots):
            x = superminhash.mix(np.array([e], np.uint64) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (2 ** 64 - 1)))
            k = j + (int(x[0]) >> 32) * (slots - j) // 2 ** 32
            perm[j], perm[k] = perm[k], perm[j]
            v = (j << 56) | int(superminhash.mix(x ^ np.uint64(0x5851F42D4C957F2D))[0]) >> 8
            sig[perm[j]] = v if sig[perm[j]] is None else min(sig[perm[j]], v)
    return sig


def test_signatures_by_their_definition():
    r = random.Random(1)
    docs = [[r.randrange(2 ** 64) for _ in range(n)] for n in (1, 2, 7, 40, 300)]
    h, row = np.array([e for d in docs for e in d], np.uint64), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    got_ = superminhash.signatures(h, row, len(docs), 20)
    assert got_.tolist() == [slow(d, 20) for d in docs]


def test_signatures_estimate_similarity_with_less_variance():
    r = np.random.default_rng(2)
    errors, m = [], superminhash.SLOTS
    for n in (20, 200):
        for _ in range(150):
            h = r.integers(0, 2 ** 63, 2 * n, dtype=np.uint64)
            a, b = h[:n + n // 2], h[n // 2:]       # two sets of 1.5 n that share n of 2 n
            sig = superminhash.signatures(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
            errors.append((n, np.mean(sig[0] == sig[1]) - 0.5))
    for n in (20, 200):
        e = np.array([x for k, x in errors if k == n])
        assert abs(e.mean()) < 0.01
        assert e.var() < 0.25 / m * (0.6 if n == 20 else 1.1)       # much less than that of independent slots for small sets


def test_families_against_brute_force(spark):
    texts = [t for s in range(6) for t in family(s, 25, 3)] + ["", None, " \n", "one two", "ONE  two", "one two three", "a b c", "Ünï cödé x y z q", "ünï cödé x y z q"]
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)] + [(3, texts[0]), (3, texts[0]), (None, texts[30]), (None, "alone with no id at all here"), (None, None)]
    want = [r if r[0] is not None or r[2] is not None else (*r[:3], True) for r in brute(rows)]
    assert got(frame(spark, rows)) == want


def test_links_that_no_first_class_shows(spark, monkeypatch):
    """Families with many edits: the first of a bucket is linked with few, the rest is found among the blocks of the bucket."""
    monkeypatch.setattr(superminhash, "BLOCK", 4)
    rows = list(enumerate(t for s in range(4) for t in family(s, 60, 4, base=70, vocabulary=2000)))
    random.Random(1).shuffle(rows)
    assert got(frame(spark, rows)) == brute(rows)


def test_texts_that_share_a_passage(spark):
    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"x{r.randrange(10 ** 6)}" for _ in range(25))) for i in range(150)] + [(200 + i, passage + f" tail {i}") for i in range(20)]
    assert got(frame(spark, rows)) == brute(rows)


@pytest.mark.parametrize("limit", [0, 500_000])
def test_given_documents(spark, monkeypatch, limit):
    monkeypatch.setattr(superminhash, "SMALL", limit)      # with and without the broadcast
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(frame(spark, rows)) == brute(rows)


def test_very_long_texts(spark):
    r = random.Random(4)
    w = [f"w{r.randrange(10 ** 5)}" for _ in range(250_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[2000:])), (3, " ".join(w[:150_000])), (4, "short one"), (5, "z" * 3_000_000)]
    n = [len(sets(t, 3)) for _, t in rows]
    assert got(frame(spark, rows)) == sorted([(1, n[0], 1, True), (2, n[1], 1, False), (3, n[2], 3, True), (4, n[3], 4, True), (5, n[4], 5, True)], key=str)


def test_empty_table(spark):
    assert got(frame(spark, [(1, "a b")]).limit(0)) == []
