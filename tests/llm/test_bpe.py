import hashlib
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenscan.llm import bpe
from lumenscan.llm.vocab import read_vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")
CODER, THEIRS = bpe.PrefixCoder(read_vocabulary(PATH)), Tokenizer.from_file(PATH)
HARD = ["", " ", "Hello, World! it's 2024's", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ÀÉÎ Straße ΣΑΣ İstanbul ﬁ", "é à́", "日本語 テスト 👩‍👩‍👧 ☕", "x<|endoftext|>y <|startoftext|>", "a b c　d\x0be\x1cf\x85g",
        "</w> <w></w>x", "\x00\x01\x7f", "don't we'll I'd 'tis ''s", "!!!???...---===", "https://example.com/a_b?c=1&d=%20", "thlyonble ndwhst, Öungheit; çaile", "a" * 3000, "ab" * 2000 + " " + "1" * 500]


def theirs(t):
    return THEIRS.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("text", HARD)
def test_ids_are_the_library_s(text):
    ids = theirs(text)
    assert CODER.ids(text) == ids
    assert CODER.texts([text.encode()])[0][1].decode() == CODER.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


def test_every_character_below_u0250_and_samples_above():
    for c in [*range(0x250), *range(0x250, 0x3000, 7), *range(0x3000, 0x20000, 101)]:
        if not 0xD800 <= c < 0xE000:
            t = f"a{chr(c)}b1{chr(c)} {chr(c)}{chr(c)}."
            assert CODER.ids(t) == theirs(t), hex(c)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("abcdefgh th'sér.!1 ", max_size=80))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert CODER.ids(text) == theirs(text)


def test_operator(spark):
    rows = [(i, t, "x") for i, t in enumerate(HARD)] + [(None, "null id", "x"), (5, None, "x"), (5, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    want = sorted((-1 if i is None else i, len(theirs(t or "")), hashlib.sha256(struct.pack(f"<{len(theirs(t or ''))}I", *theirs(t or ""))).hexdigest(),
                   hashlib.sha256(THEIRS.decode(theirs(t or ""), skip_special_tokens=False).encode()).hexdigest()) for i, t, _ in rows)
    got = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in bpe.round_trip(df, PATH).collect())
    assert got == want
    assert bpe.round_trip(df.limit(0), PATH).count() == 0
