"""Columns of the input that have the names of an operator's own scratch columns are kept, whatever their place and case."""
import pytest

import corpus_pipeline
from lumenscan.llm import jaccard, lines, surrogates
from lumenscan.llm.blocks import apart, free_name

SF = "/root/testdata/sf0.001"
NAMES = ["_id", "_key", "_Gone", "_near", "_tkey", "_hash", "_new", "_known", "_ref", "_quality", "n_chars"]
TEXTS = ["One line that is here\nand a second one", "One line that is here\nbut not that", None, "", "Mail to Mrs Anna Keller, anna.keller@example.org, now", "Mail to Mrs Anna Keller, anna.keller@example.org, now"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, *[f"{n}{i}" for n in NAMES], t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", *[f"{n} string" for n in NAMES], "text string"]))


def values(df, names=NAMES):
    return sorted(tuple(r[n] for n in ["doc_id", *names]) for r in df.collect())


def plain(df):
    return df.select("doc_id", "text")


@pytest.mark.parametrize("f, more", [(lambda d: lines.dedup_lines(d), 3), (lambda d: surrogates.with_surrogates(d, "k"), 1)])
def test_rows_keep_their_columns(docs, f, more):
    out = f(docs)
    assert out.columns[:len(docs.columns)] == docs.columns and len(out.columns) == len(docs.columns) + more
    assert values(out) == values(docs)
    assert sorted(map(str, plain(out).collect())) == sorted(map(str, plain(f(plain(docs))).collect()))


def test_first_of_each_keeps_columns(docs):
    out = jaccard.first_of_each(docs)
    assert out.columns == docs.columns and [r.doc_id for r in out.orderBy("doc_id").collect()] == [0, 1, 2, 3, 4]
    assert values(out) == values(docs)[:5]


def test_quality_stage_keeps_columns(spark, docs):
    out = corpus_pipeline.quality_stage(spark, docs, SF)
    assert out.columns == docs.columns and set(values(out)) <= set(values(docs))


def test_names(spark):
    df = spark.range(1).selectExpr("id", "id AS A", "id AS a_")
    assert free_name(df, "b") == "b" and free_name(df, "a") == "a__"
    seen = []

    @apart("a", "x")
    def f(d):
        seen.append(d.columns)
        return d.selectExpr("*", "1 AS x")

    assert f(df).columns == ["id", "A", "a_", "x"] and seen[0] == ["id", "A_kept", "a_"]
