"""Spelling variants by permuterm rotations: words that differ by one inserted, deleted or replaced code point.

1. `word_counts`: maximal runs of letters (a-z and U+00C0-U+00FF after A-Z were lower-cased). In one of SLIPS (document, run)
   pairs, chosen by a hash, one code point is left out: a typing slip of known rate. Counts are summed in the task before they
   are shuffled. Words of at least LEAST code points and TWICE occurrences stay.
2. `neighbourhoods`: a word with an end mark has one rotation per code point and one for the mark. A word that was changed at one
   place shares the rotation that starts behind that place up to, not including, the changed code point: the edited character
   is the last one and the rest is a prefix. So each rotation enters twice, whole and without its last code point. Rotations with
   equal text meet: two that lost a code point are replacements of each other, a whole one is a deletion of those that lost one.
   Of equal code points in a row only the last may be deleted, so every pair of words meets in exactly one group.
   A group holds one whole rotation and at most one per letter of the alphabet (90), whatever the corpus, so its members are
   gathered in one row; each member leaves with the number of its neighbours there and the best of them, not with pairs. Words go as
   numbers in their order; rotations of more than LONG code points go as 128 bits of hashes.
3. `spelling_forms`: a word's form is its most frequent neighbour (ties: the smallest in code-point order) if that is FACTOR times
   as frequent. Counts grow by FACTOR along forms, so pointer doubling reaches every root in a few rounds.

Null texts have no words. A null id counts as the empty text in the hash. Repeated rows count as often as they stand. Texts of
any length are scanned whole, one document at a time. An empty table gives an empty table. Further columns are ignored.
"""
from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.llm.blocks import _powers, mix, stored, text_bytes
from lumenscan.operators.sequencing import positions

LEAST, TWICE, FACTOR, SLIPS = 7, 2, 10, 31
HELD = 100_000      # distinct words that a task keeps before it hands their counts on
MARK = "$"          # no letter
LONG = 64           # code points of a key up to which it is kept as text


def _counts(batches, least: int, slips: int):
    run = re.compile("[a-zÀ-ÿ]{%d,}" % least)
    held: dict[str, int] = {}

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for b in batches:
        data, off = text_bytes(b.column(1))
        for i, doc in enumerate(b.column(0).to_pylist()):
            prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            seen: dict[str, str] = {}       # run -> word in this document
            # bytes.lower changes A-Z only
            for m in run.finditer(data[off[i]:off[i + 1]].tobytes().lower().decode("utf-8", "replace")):
                w = m[0]
                to = seen.get(w)
                if to is None:
                    h = zlib.crc32(w.encode(), prefix)
                    cut = h % len(w)
                    to = seen[w] = w if h % slips else w[:cut] + w[cut + 1:]
                    if len(seen) >= HELD:
                        seen = {w: to}
                if len(to) >= least:
                    held[to] = held.get(to, 0) + 1
                    if len(held) >= HELD:
                        yield flush()
    yield flush()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, twice: int = TWICE, slips: int = SLIPS) -> DataFrame:
    """word, n: words of at least `least` code points with at least `twice` occurrences."""
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    parts = src.mapInArrow(lambda batches: _counts(batches, least, slips), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)


KEYS = "m int, k1 bigint, k2 bigint, whole boolean, last boolean, id bigint, n bigint"


def _hashed(batches):
    """The rotations of long words by two rolling hashes, so that a word's work grows with its length and not with the square."""
    names = [f.split()[0] for f in KEYS.split(", ")]
    for b in batches:
        for word, id_, n in zip(*(b.column(c).to_pylist() for c in ("word", "id", "n"))):
            code = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
            size = len(code)
            power, inverse = _powers(size + 2)
            keys = []
            for value, mark in ((mix(code), mix(np.zeros(1, np.uint64))), (mix(mix(code) + code), mix(np.ones(1, np.uint64) << np.uint64(40)))):
                before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[:size])])
                i = np.arange(size + 1)
                turned = (before[-1] - before) * inverse[i] + mark * power[size - i] + before * power[size - i + 1]
                keys.append((turned, turned[1:] - value * power[size]))      # whole, and without the last code point
            last = np.append(code[:-1] != code[1:], True)
            for whole in (True, False):
                k1, k2 = (k[0 if whole else 1].view(np.int64) for k in keys)
                for lo in range(0, len(k1), 1 << 16):
                    x, y, z = k1[lo:lo + (1 << 16)], k2[lo:lo + (1 << 16)], last[lo:lo + (1 << 16)]
                    m = len(x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, size + whole), pa.int32()), pa.array(x), pa.array(y), pa.array(np.full(m, whole)), pa.array(np.full(m, True) if whole else z),
                                                      pa.array(np.full(m, id_), pa.int64()), pa.array(np.full(m, n), pa.int64())], names)


def rotations(words: DataFrame) -> DataFrame:
    """key, whole, last, id, n: every rotation of the marked word, whole and without its last code point.

    `last`: the code point left out is not followed by an equal one in the word. Keys of more than LONG code points are hashes of
    them; which form a key has depends on its length only, so equal keys have equal forms.
    """
    size = F.length("word")
    turned = (words.where(size <= LONG).select("word", "id", "n", F.explode(F.sequence(F.lit(0), size)).alias("i"))
              .select("word", "id", "n", "i", F.concat(F.expr("substring(word, i + 1)"), F.lit(MARK), F.expr("substring(word, 1, i)")).alias("rotation")))
    whole = F.struct(F.col("rotation").alias("key"), F.lit(True).alias("whole"), F.lit(True).alias("last"))
    # the rotation by i ends with code point i of the word; the one by 0 ends with the mark, which nobody edits
    cut = F.struct(F.expr("left(rotation, length(rotation) - 1)").alias("key"), F.lit(False).alias("whole"), F.expr("substring(word, i, 1) != substring(word, i + 1, 1)").alias("last"))
    short = turned.select("id", "n", F.explode(F.when(F.col("i") == 0, F.array(whole)).otherwise(F.array(whole, cut))).alias("x")).select("x.*", "id", "n").where(F.length("key") <= LONG)
    hashed = words.where(size >= LONG).mapInArrow(_hashed, KEYS).where(F.col("m") > LONG)
    return short.unionByName(hashed.select(F.concat_ws(":", F.lit("#"), "m", "k1", "k2").alias("key"), "whole", "last", "id", "n"))


def neighbourhoods(words: DataFrame) -> DataFrame:
    """id, n_near, best (struct: negative count and id of the most frequent neighbour) of every word (id, word, n) with a neighbour.
    Ids follow the order of the words."""
    groups = rotations(words).groupBy("key").agg(F.collect_list(F.struct("whole", "last", "id", "n")).alias("all")).where(F.size("all") > 1)
    one = groups.select("all", F.explode("all").alias("x"))
    near = F.filter("all", lambda y: F.when(F.col("x.whole"), ~y["whole"] & y["last"]).when(y["whole"], F.col("x.last")).otherwise(y["id"] != F.col("x.id")))
    seen = one.select(F.col("x.id").alias("id"), F.transform(near, lambda y: F.struct((-y["n"]).alias("minus"), y["id"].alias("id"))).alias("near"))
    return (seen.where(F.size("near") > 0).select("id", F.size("near").cast("bigint").alias("k"), F.array_min("near").alias("best"))
            .groupBy("id").agg(F.sum("k").alias("n_near"), F.min("best").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """id, root: the end of the chain of forms that starts at each word of `forms` (id, form)."""
    at = stored(forms.select("id", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        if at.join(on, "root", "left_semi").isEmpty():
            return at
        at = stored(at.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root")))


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = stored(positions(word_counts(docs, id_col, text_col), [F.col("word")], out="id"))
    near = neighbourhoods(words)
    far = -F.col("best.minus") >= factor * F.col("n")
    table = stored(words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("best.id")).alias("form"), F.when(far, -F.col("best.minus")).alias("form_n")))
    formed = table.where(F.col("form").isNotNull()).select("id", "form")
    text = lambda c, name: words.select(F.col("id").alias(c), F.col("word").alias(name))
    named = formed.join(roots(formed), "id").join(text("form", "form_word"), "form").join(text("root", "root_word"), "root").select("id", "form_word", "root_word")
    return table.join(named, "id", "left").select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
