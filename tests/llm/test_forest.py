import numpy as np
import pytest

from lumenscan.llm import forest


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def brute(rows, k, query=lambda i: i % 20 == 0):
    ok = {(i, tuple(v)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array([i for i, _ in ok])
    x = np.array([v for _, v in ok], dtype=np.float64)
    out = {}
    for i, v in ok:
        if query(i):
            s = x @ np.array(v, dtype=np.float64)
            order = sorted((-round(a, 9), j) for a, j in zip(s, ids) if j != i)[:k]
            out[i] = [j for _, j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.vec_id)
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_on_structureless_vectors_and_shards(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    df = frame(spark, rows)
    got, want = found(forest.nearest(df, df.where("vec_id % 20 = 0"), shard=2048)), brute(rows, 20)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert hits / (20 * len(want)) >= 0.9


@pytest.mark.parametrize("n", [2000, 3000, 4096, 8192])
def test_recall_and_share_with_the_parameters_in_use(n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked, shards = rng.choice(n, 60, replace=False), -(-n // forest.SHARD)
    part, best, scored = rng.integers(0, shards, n), {i: [] for i in asked}, 0
    for s in range(shards):
        ids = np.flatnonzero(part == s)
        for i, (rows, score) in zip(asked, forest.Forest(x[ids], 1.0).search(x[asked], int(np.ceil(forest.SHARE * len(ids))))):
            scored += len(rows)
            best[i] += [(-v, j) for v, j in zip(score, ids[rows]) if j != i]
    want = {i: [j for j in np.argsort(-(x @ x[i])) if j != i][:20] for i in asked}
    assert sum(len({j for _, j in sorted(best[i])[:20]} & set(want[i])) for i in asked) >= 0.9 * 20 * len(asked)
    assert scored <= 0.35 * n * len(asked)


def test_descent_finds_the_longest_prefix():
    rng = np.random.default_rng(1)
    f = forest.Forest(rng.standard_normal((300, 8)), 9.0)
    s = f._strings(rng.standard_normal((20, 9)))
    shared = lambda a, b: next((k for k in range(f.bits) if (a ^ b) >> (f.bits - 1 - k) & 1), f.bits)
    want = [[max(shared(int(a), int(s[k, t])) for a in f.keys[:, t]) for t in range(0, f.trees, 16)] for k in range(20)]
    assert f.depths(s)[:, ::16].tolist() == want


def test_everything_with_share_one_copies_ties_and_bad_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (300, 6)).astype(float)       # many equal scores
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    rows += [(1000 + i, [3.0, 1.0, 0.0, 0.0, -1.0, 2.0], "x") for i in range(80)]     # copies
    rows += [(2000, None, "x"), (2020, [0.0] * 6, "x"), (2040, [float("nan")] * 6, "x"), (2060, [None, 1.0, 1.0, 1.0, 1.0, 1.0], "x"), (None, [1.0] * 6, "x"),
             (2080, [float("inf")] * 6, "x"), (7, x[7].tolist(), "x"), (20, x[20].tolist(), "x"), (2100, [1.0, 2.0], "x"), (2120, [], "x")]
    df = frame(spark, rows)
    want = brute([r for r in rows if r[0] not in (2100, 2120)], 20)
    assert found(forest.nearest(df, df.where("vec_id % 20 = 0"), share=1.0, shard=100)) == want


def test_few_rows_and_none(spark):
    df = frame(spark, [(0, [1.0, 0.0], ""), (1, [0.5, 0.5], ""), (2, [0.0, 1.0], "")])
    assert found(forest.nearest(df, df.where("vec_id % 20 = 0"))) == {0: [1, 2]}
    assert forest.nearest(df.limit(0), df.limit(0)).count() == 0


def test_ascent_reads_few_levels_and_finds_the_same(monkeypatch):
    """The level at which the trees' ranges hold enough is the first one on the way up; few levels are read on the way there."""
    x = np.random.default_rng(8).standard_normal((900, 16))
    f = forest.Forest(x, float(np.sqrt((x * x).sum(1).max())))
    read, ranges = [], f.ranges
    monkeypatch.setattr(f, "ranges", lambda s, level: (read.append(level), ranges(s, level))[1])
    got = list(f.search(x[:50], 225))
    assert len(read) < 0.75 * f.depths(f._strings(np.hstack([x[:50], np.zeros((50, 1))]))).max()
    s = f._strings(np.hstack([x[:50], np.zeros((50, 1))]))
    for k, (rows, score) in enumerate(got):
        level = int(f.depths(s[k:k + 1]).max())
        while level and sum(int(b) - int(a) for a, b in zip(*(r[0] for r in ranges(s[k:k + 1], level)))) < forest.MEETINGS * len(x):
            level -= 1
        a, b = ranges(s[k:k + 1], level)
        met = np.bincount(np.concatenate([f.order[t, a[0, t]:b[0, t]] for t in range(f.trees)]), minlength=len(x))
        assert rows.tolist() == np.flatnonzero(met >= np.sort(met)[-225]).tolist()
        assert np.allclose(score, x[rows] @ x[k], rtol=0, atol=1e-12)
