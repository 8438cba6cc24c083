import zlib

import numpy as np

from lumenscan.llm import quality

SF = "/root/testdata/sf0.01"


def margin(text, table):
    at, w = quality.document_features(np.frombuffer(text.encode(), np.uint8))
    return float(w.astype(float) @ table[at])


def test_margins_equal_the_average_of_the_features(spark):
    rng = np.random.default_rng(0)
    table = rng.standard_normal(quality.BUCKETS)
    texts = ["", "a", "héllo wörld wörld", "日本 x", " \n\t ", "of of of it is of it is", "long " * 5000 + "end"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = quality.margins(np.frombuffer(b"".join(raw), np.uint8), off, table)
    assert np.allclose(got, [margin(t, table) for t in texts])


def test_ngrams_are_the_characters_of_words_with_borders():
    data = np.frombuffer("ab été".encode(), np.uint8)
    h, s, e, inv, row = quality.distinct_words(data, np.array([0, len(data)]))
    who, what = quality.grams_of(data, s, e)
    pad = {len(" ab "): 2 + 1, len(" été "): 3 + 2 + 1}      # windows of 3, 4 and 5 characters
    assert sorted(np.bincount(who).tolist()) == sorted(pad.values()) and len(h) == 2


def test_held_out_accuracy_and_edges(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.scored(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(got[d].predicted, q) for d, q in truth.items() if d in got and got[d].held_out]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in got)
    assert held and np.mean([p == q for p, q in held]) >= 0.93


def test_defined_results_without_labels_and_with_nulls(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (None, "text", 9.0), (2, "", 9.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = quality.scored(docs, none).collect()
    assert len(got) == 4 and all(r.score == 0.5 and r.predicted == 0 for r in got)
    some = spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    assert len(quality.scored(docs, some).collect()) == 4
    assert quality.scored(docs.limit(0), some).count() == 0
