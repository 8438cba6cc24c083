import hashlib
import re

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lumenscan.llm import quality
from lumenscan.llm.queries import OP4_SQL
from tests_llm_util import near_brute, packing_check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of every stage, each written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {n: (a, b) for n, a, b in out}


def test_order_and_columns(stages):
    assert list(stages) == ["quality", "lines", "near_duplicates", "personal_data", "packing"]
    for n, (a, b) in stages.items():
        assert n == "packing" or a.columns == b.columns
        assert b.count() > 0


def test_quality_keeps_good_documents_whole(spark, stages):
    before, after = stages["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    was, now = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
    assert all(was[d] == r for d, r in now.items())
    good = [d for d in was if labels.get(d) == 1]
    bad = [d for d in was if labels.get(d) == 0]
    assert sum(d in now for d in good) >= 0.95 * len(good) and sum(d in now for d in bad) <= 0.4 * len(bad)
    model = quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet"), quality.crc_mod(F.col("doc_id"), 4) != 2)
    s = {r.doc_id: r.s for r in quality.with_score(before, model, name="s").collect()}
    assert {d for d in was if s[d] >= corpus_pipeline.LEAST} == set(now)


def test_lines_equal_the_sql_twin(stages):
    before, after = stages["lines"]
    con = duckdb.connect()
    documents = before.toPandas()       # noqa: F841  (read by the SQL)
    twin = {r[0]: r[1:] for r in con.sql(OP4_SQL).fetchall()}
    now = {r.doc_id: r for r in after.collect()}
    gone = {d for d, (n, removed, *_) in twin.items() if removed == n}
    assert set(now) == set(twin) - gone
    for d, r in now.items():
        assert hashlib.sha256(r.text.encode()).hexdigest() == twin[d][3] and r.n_chars == len(r.text)


def test_copies_with_empty_lines_go(spark):
    rows = [(1, "a first line\nand another"), (2, "a first line\nand another\n"), (3, "\na first line\n\nand another"), (4, "\n\n"), (5, ""), (6, None), (7, "and another\n\nbut new")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines_stage(spark, docs, SF).collect()}
    assert got == {1: "a first line\nand another", 4: "\n\n", 5: "", 6: None, 7: "\nbut new"}


def test_one_document_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = {d for d, _, c in near_brute(rows) if d == c}
    assert {r.doc_id for r in after.collect()} == want
    was = {r.doc_id: r for r in before.collect()}
    assert all(was[r.doc_id] == r for r in after.collect())


def test_personal_data_is_replaced(stages):
    before, after = stages["personal_data"]
    was, now = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in after.collect()}
    assert set(was) == set(now)
    for d, t in was.items():
        for m in re.findall(r"[\w.+-]+@[\w.-]+\.\w+|\+\d \(\d{3}\) \d{3}-\d{4}|(?<!\w)[0-9a-f]{40}(?!\w)", t):
            assert m not in now[d]
        if not re.search(r"\d", t):
            assert t == now[d]


def test_packing_holds_every_token(stages):
    before, after = stages["packing"]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [1] for r in before.collect()}
    rows = after.collect()
    assert {r.doc_id for r in rows} == set(docs)
    pad, used = packing_check(rows, docs)
    assert used == sum(map(len, docs.values())) and pad <= 0.05 * used


def test_empty_table_passes_all_stages(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
