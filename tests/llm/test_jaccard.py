import random
import re

import pytest

from lumenscan.llm import jaccard
from lumenscan.llm.components import components

SF = "/root/testdata/sf0.001"


def sets(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows):
    """(id, set size, smallest id of the component) per row; rows without words stand alone."""
    s = [sets(t) for _, t in rows]
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
            if 100 * both >= 80 * (len(x) + len(s[j]) - both):
                parent[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in jaccard.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ref string")


def family(seed, n, edits, base=60, vocabulary=500):
    r = random.Random(seed)
    first = [f"w{r.randrange(vocabulary)}" for _ in range(base)]
    out = []
    for _ in range(n):
        w = list(first)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"e{r.randrange(10 ** 6)}"
        out.append(" ".join(w[r.randrange(3):]))
    return out


def test_families_against_brute_force(spark):
    texts = [t for s in range(6) for t in family(s, 25, 3)] + ["", None, " \n", "one two", "ONE  two", "one two three four five", "a b c", "Ünï cödé x y z q", "ünï cödé x y z q"]
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)] + [(3, texts[0]), (3, texts[0]), (None, texts[30]), (None, "alone with no id at all here"), (None, None)]
    assert got(frame(spark, rows)) == brute(rows)


def test_long_lists_keep_every_link(spark, monkeypatch):
    """A family larger than the lists' near range, in small groups and shards: distant pairs must still be found."""
    monkeypatch.setattr(jaccard, "NEAR", 2)
    monkeypatch.setattr(jaccard, "GROUP", 3)
    monkeypatch.setattr(jaccard, "SHARD", 16)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rows = list(enumerate(t for s in range(4) for t in family(s, 60, 4, base=70, vocabulary=2000)))
    random.Random(1).shuffle(rows)
    assert got(frame(spark, rows)) == brute(rows)


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(frame(spark, rows)) == brute(rows)


def test_first_of_each_when_rows_are_dealt_anew(spark, tmp_path):
    """The files are packed into other partitions between the two uses of the table."""
    texts = [t for s in range(8) for t in family(s, 5, 2)] + [f"alone {i} " + " ".join(f"u{i}x{j}" for j in range(30)) for i in range(40)]
    rows = list(enumerate(texts))
    random.Random(3).shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(12).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    was = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "1m")
        out = jaccard.first_of_each(docs)
        spark.conf.set(names[0], "1g")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        got_ = sorted(r.doc_id for r in out.collect())
    finally:
        for n in names:
            spark.conf.set(n, was[n])
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got_ == sorted(d for d, _, c in brute(rows) if d == c)


def test_empty_table(spark):
    assert got(frame(spark, [(1, "a b")]).limit(0)) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for u, v in links if u != v for x in (u, v)}
    df = spark.createDataFrame(links, "u long, v long").repartition(6)
    assert {x.node: x.comp for x in components(df).collect()} == want
