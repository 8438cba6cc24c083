import random
import re
import zlib

import pytest

from lumenscan.llm import spelling

LETTERS = "abcdéßÿ×"


def counts(rows, slips=31):
    n = {}
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % slips == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] = n.get(run, 0) + 1
    return {w: k for w, k in n.items() if k >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, slips=31):
    n = counts(rows, slips)
    form, k = {}, {}
    for w in n:
        them = [v for v in n if near(w, v)]
        k[w] = len(them)
        best = min(them, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], k[w], n.get(form[w])) for w in n)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_forms(df).collect())


def frame(spark, rows):
    """With columns that clash with those of the operator."""
    return spark.createDataFrame([(d, t, "x", 1, "k", "r") for d, t in rows], "doc_id long, text string, word string, n int, key string, root string")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_words_against_brute_force(spark, seed):
    r = random.Random(seed)
    base = ["".join(r.choice(LETTERS) for _ in range(r.randrange(7, 11))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "abababab", "babababa"]
    rows = []
    for i in range(60):
        out = []
        for _ in range(r.randrange(40)):
            w = r.choice(base[:3] if r.random() < 0.5 else base)
            at = r.randrange(len(w))
            w = r.choice([w, w, w, w[:at] + w[at + 1:], w[:at] + r.choice(LETTERS) + w[at:], w[:at] + r.choice(LETTERS) + w[at + 1:]])
            out.append(w.upper().replace("SS", "ß") if r.random() < 0.1 else w)
        rows.append((i, r.choice([" ", "-", "1", "\n", "_"]).join(out)))
    assert got(frame(spark, rows)) == brute(rows)


def test_chains_of_forms_reach_their_root(spark):
    words = [("abcdefghij", 4500), ("abcdefghi", 400), ("abcdefgh", 33), ("abcdefgx", 2)]
    rows = [(i, w) for w, n in words for i in range(n)]
    want = brute(rows)
    assert got(frame(spark, rows)) == want
    assert {x[1:3] for x in want if x[0] == "abcdefgx"} == {("abcdefgh", "abcdefghij")}


def test_nulls_long_texts_and_repeated_rows(spark):
    long_ = " ".join(["Lengthy", "words", "lengthy", "lengthyx"] * 60000) + " " + "q" * 200000
    rows = [(None, "nothing nothing nothing"), (None, None), (3, None), (4, ""), (5, long_), (5, long_), (6, "nothinh nothinh"), (7, "x" * 200000 + " " + "x" * 200000)]
    small = [(d, t) for d, t in rows if t is None or len(t) < 1000]
    assert got(frame(spark, small)) == brute(small)
    all_ = {r[0]: r for r in got(frame(spark, rows))}
    n = counts(rows)
    assert {w: r[3] for w, r in all_.items()} == n
    assert all_["lengthyx"][4] == 1 and all_["x" * 200000][4] == 0


def test_words_around_the_length_of_hashed_keys(spark):
    r = random.Random(8)
    base = ["".join(r.choice("abcdéÿ") for _ in range(n)) for n in (63, 64, 65, 66, 200)] + ["a" * 64, "ab" * 32]
    words = base + [w for b in base for w in (b[:9] + b[10:], b[:30] + "q" + b[30:], b[:-1] + "z", b + "z", b[1:], b[:5] + "ß" + b[6:])]
    rows = [(i, w) for w in words for i in range(2 + 30 * (w in base))]
    assert got(frame(spark, rows)) == brute(rows)


def test_empty_table(spark):
    assert got(frame(spark, [(1, "a")]).limit(0)) == []


def test_slips_take_place(spark):
    rows = [(i, "wonderful") for i in range(500)]
    words = {r[0] for r in got(frame(spark, rows))}
    assert len(words) > 3 and all(r[2] == "wonderful" for r in got(frame(spark, rows)))
