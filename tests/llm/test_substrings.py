import hashlib
import random
import re
from collections import Counter

import numpy as np

from lumenscan.llm import substrings

SF = "/root/testdata/sf0.001"


def brute(rows, k=35):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + k]) for w in docs for i in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(rows, docs):
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i:i + k])] > 1:
                gone.update(range(i, i + k))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in substrings.without_repeats(df).collect()), key=str)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, base string").repartition(parts)


def passages(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdéf") for _ in range(r.randrange(1, 4)))
    pool = [[word() for _ in range(r.choice((34, 35, 36, 60, 120)))] for _ in range(6)]
    out = []
    for _ in range(n):
        w = []
        for _ in range(r.randrange(4)):
            p = list(r.choice(pool))
            if r.random() < .5:
                p[r.randrange(len(p))] = "edit" + word()
            w += p[r.randrange(5):] + [word() for _ in range(r.randrange(30))]
        out.append(r.choice((" ", "\n", "  ")).join(w))
    return out


def test_passages_against_brute_force(spark):
    texts = passages(1) + passages(2) + ["", None, "a " * 34, "b " * 35, "c " * 36, "d e " * 200, "one two three " * 30, "same " + "x y z w v " * 9]
    rows = list(enumerate(texts)) + [(5, texts[4]), (5, texts[4]), (None, texts[3])]
    random.Random(0).shuffle(rows)
    assert got(frame(spark, rows)) == brute(rows)


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(frame(spark, rows, 5)) == brute(rows)


def test_kept_text_and_empty_table(spark):
    df = frame(spark, [(1, "p  q\nr"), (2, "z " * 50)])
    assert {r.doc_id: r.kept for r in substrings.without_repeats(df, keep_text=True).collect()} == {1: "p q r", 2: ""}
    assert got(df.limit(0)) == []


def test_backward_search_counts_like_a_scan():
    r = np.random.default_rng(0)
    text = np.concatenate([np.append(r.integers(1, 6, 70), 0) for _ in range(8)])
    index = substrings.FMIndex(text, 6)
    seen = text.tolist()
    for _ in range(200):
        at, n = int(r.integers(0, len(text) - 9)), int(r.integers(1, 9))
        pattern = seen[at:at + n]
        if 0 in pattern:
            continue
        lo, hi = np.array([0]), np.array([len(text)])
        for c in reversed(pattern):
            lo, hi = index.extend(np.array([c]), lo, hi)
        assert hi[0] - lo[0] == sum(seen[i:i + n] == pattern for i in range(len(seen) - n + 1))
