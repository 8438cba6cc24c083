import array
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenscan.llm import packing
from lumenscan.llm.vocab import ByteLevelIds, read_vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
THEIRS = Tokenizer.from_file(PATH)
HARD = ["", None, " ", "a", "Hello  world\n\n it's\tfine ", "x<|endoftext|> y", "nbsp    two  \x1c  z", "日本語 ÖÄ çaile", "word " * 9000, "  lead", "tail  \n"]


MINE = ByteLevelIds(read_vocabulary(PATH))


def ids(texts):
    raw = [(t or "").encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    flat, cut = MINE.rows(np.frombuffer(b"".join(raw), np.uint8), off)
    return [flat[a:b].tolist() for a, b in zip(cut, cut[1:])]


def theirs(texts):
    return [THEIRS.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_ids_are_the_library_s():
    assert ids(HARD) == theirs(HARD)
    assert ids(HARD + HARD) == theirs(HARD + HARD)
    assert ids([]) == [] and ids(["", ""]) == [[], []]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab é÷×'\n \x1c　.1,!”s", max_size=30), max_size=4))
def test_any_white_space_and_signs(texts):
    assert ids(texts) == theirs(texts)


@pytest.mark.parametrize("m", [1, 2, 3, 7])
def test_differencing_is_a_partition_and_near_equal(m):
    sizes = [(i * 37) % 101 + 1 for i in range(60)]
    parts = packing.differencing(sizes, m)
    assert sorted(i for p in parts for i in p) == list(range(60)) and len(parts) == m
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) <= 8


def test_window_count_rises():
    parts = packing.windows([6, 6, 6], 10)     # 18 tokens would fit two windows, but not without cutting an item
    assert len(parts) == 3


def check(rows, docs):
    """docs: how often each (doc, ids) occurs."""
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at and n > 0
            at += n
        assert at <= 2048
    for (doc, total), ps in pieces.items():
        ids = docs[doc]
        assert total == len(ids)
        seen = [0] * total
        for a, n, c in ps:
            assert c == zlib.crc32(array.array("I", ids[a:a + n]).tobytes())
            for k in range(a, a + n):
                seen[k] += 1
        assert len(set(seen)) == 1
    used = [sum(n for _, n in s) for s in seqs.values()]
    return sum(0 if u & (u - 1) == 0 else 2048 - u for u in used), sum(used)


def test_operator(spark):
    texts = HARD + [("some words of a text, number %d. " % i) * (i * 13 % 97) for i in range(300)]
    df = spark.createDataFrame([(i if i != 5 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, start string").repartition(2)
    rows = packing.pack(df, PATH, 1).collect()
    docs = {i if i != 5 else None: THEIRS.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    assert {r.doc_id for r in rows} == set(docs)
    pad, used = check(rows, docs)
    assert used == sum(map(len, docs.values())) and pad <= 0.05 * used
    assert packing.pack(df.limit(0), PATH, 1).count() == 0


def test_repeated_rows_are_documents_of_their_own(spark):
    df = spark.createDataFrame([(1, "same text here")] * 5, "doc_id long, text string")
    n = len(THEIRS.encode("same text here", add_special_tokens=False).ids) + 1
    assert sum(r.length for r in packing.pack(df, PATH, 1).collect()) == 5 * n
