import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenscan.llm import interpolation as lm

SF = "/root/testdata/sf0.001"


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, bits):
    fold = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 for d, _ in rows]
    docs = [tokens(t) for _, t in rows]
    END, START, UNK = ("end",), ("start",), ("unk",)

    def counts(keep):
        uni, n_docs = Counter(), 0
        for f, w in zip(fold, docs):
            if keep(f):
                uni.update(w)
                n_docs += 1
        return uni, n_docs

    uni, n_docs = counts(lambda f: f != 0)
    kept, kept_docs = counts(lambda f: f not in (0, 1))
    total = sum(uni.values())
    vocab = {w for w, c in uni.items() if c > total >> bits}
    name = lambda w: w if w in vocab else UNK

    def table(u, d):
        c = Counter({w: u[w] for w in vocab})
        c[UNK], c[END], c[START] = sum(u.values()) - sum(c.values()), d, d
        return c

    def pairs(keep):
        out = Counter()
        for f, w in zip(fold, docs):
            if keep(f):
                s = [START, *map(name, w), END]
                out.update(zip(s, s[1:]))
        return out

    c, ck = table(uni, n_docs), table(kept, kept_docs)
    big, bigk, tune = pairs(lambda f: f != 0), pairs(lambda f: f not in (0, 1)), pairs(lambda f: f == 1)
    n, nk = total + n_docs, sum(kept.values()) + kept_docs
    bucket = lambda x: 0 if x == 0 else 1 + int(math.log2(x))
    q = lambda p: 0 if p == 0 else 1 + min(max(round(-4 * math.log2(p)), 0), 126)
    cells = Counter()
    for (h, w), k in tune.items():
        cells[(bucket(ck[h]) * 128 + q(bigk[h, w] / ck[h] if ck[h] else 0)) * 128 + q(ck[w] / nk if nk else 0)] += k
    size = len(vocab) + 2
    keys = sorted(cells)
    mix = lm.weights(np.array(keys, np.int64), np.array([cells[k] for k in keys], float), size)
    types = len(uni) + (n_docs > 0)
    out = []
    for (d, _), f, w in zip(rows, fold, docs):
        base = sum(math.log10((x + .1) / (n + .1 * (types + 1))) for x in [*(uni[t] for t in w), n_docs])
        known = sum(uni[t] > 0 for t in w) + (n_docs > 0)
        score, s = 0.0, [START, *map(name, w), END]
        for h, t in zip(s, s[1:]):
            m = mix[bucket(c[h])]
            p = m[0] * (big[h, t] / c[h] if c[h] else 0) + m[1] * (c[t] / n if n else 0) + m[2] / size
            score += math.log10(p) - (math.log10(len(uni) - len(vocab) + 1) if t == UNK else 0)
        out.append((d, f == 0, len(w) + 1, known, n, base, score))
    return out


def compare(spark, rows, bits, parts=3):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(parts)
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    got, want = sorted((tuple(r) for r in lm.scores(df, bits=bits).collect()), key=key), sorted(brute(rows, bits), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("bits", [20, 6])
def test_scores_against_brute_force(spark, bits):
    r = random.Random(bits)
    vocab = [f"w{int(r.paretovariate(.8))}" for _ in range(400)]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "Unseen WORDS été"), (None, "null id here"), (3, rows[3][1]), (3, rows[3][1]), (203, "w1 " * 3000)]
    compare(spark, rows, bits)


@pytest.mark.parametrize("held", [20, 6, 3])
def test_no_word_is_pooled(spark, held):
    """However few words are frequent, scores are those of the model that has every word."""
    r = random.Random(held)
    vocab = [f"w{int(r.paretovariate(.8))}" for _ in range(400)]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "Unseen WORDS été"), (None, "null id here"), (3, rows[3][1]), (3, rows[3][1]), (203, "w1 " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    got, want = sorted((tuple(x) for x in lm.scores(df, held=held).collect()), key=key), sorted(brute(rows, 62), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_given_documents_and_gain_over_the_base(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    compare(spark, rows, 10)
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.scores(df).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert got[0] > got[1]


def test_no_training_documents_and_empty_table(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    compare(spark, [(i, "some words") for i in ids], 20)
    assert lm.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_weights_maximise_held_out_likelihood():
    cells = np.array([(3 * 128 + 5) * 128 + 20, (3 * 128 + 0) * 128 + 20])
    w = lm.weights(cells, np.array([900.0, 100.0]), 1000)[3]
    assert w.sum() == pytest.approx(1) and w[0] > 0.8
