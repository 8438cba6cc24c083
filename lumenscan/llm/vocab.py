"""Tokenizer files as text (shipped to the executors, which need not hold them) and per-process caches of word encodings."""
from __future__ import annotations

import array
import hashlib
import os
import re
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np

from lumenscan.llm.blocks import SPACE, span_hashes

# White space that the word split below does not cut at; a text that holds any of it is encoded whole.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_CONTROL = re.compile(rb"[\x1c-\x1f]")
CACHE = 600_000     # encodings of words that a process keeps
SLICE = 1 << 22     # bytes of text whose unknown words are encoded in one call


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def slices(texts: Iterable[bytes]):
    """Lists of whole texts of about SLICE bytes together."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


class WordCache:
    """Values of byte strings, computed in batches by `compute`; the first CACHE of them stay for later slices."""

    def __init__(self, compute: Callable[[list[bytes]], list]):
        self.compute, self.kept = compute, {}

    def table(self, lists: list[list[bytes]]) -> dict:
        """A table that holds all words of `lists`."""
        kept = self.kept
        new = [w for w in set(chain.from_iterable(lists)) if w not in kept]
        got = dict(zip(new, self.compute(new)))
        if len(kept) + len(got) <= CACHE:
            kept.update(got)
            return kept
        return Layered(got, kept)


class Layered(dict):
    def __init__(self, top: dict, below: dict):
        super().__init__(top)
        self.below = below

    def __missing__(self, key):
        return self.below[key]


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?")] = True
_SURE = np.zeros(256, bool)         # ASCII letters and digits
_SURE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the text can be cut without changing its ids: before white space, and before a sign behind a letter or digit."""
    space = SPACE[data]
    start = np.zeros(len(data), bool)
    start[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    start[1:] |= space[1:] & ~space[:-1]
    letter = _SURE[data[:-1]]
    latin = (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)     # U+00C0 to U+00FF but the two signs among them
    letter[1:] |= latin
    start[1:] |= _PUNCTUATION[data[1:]] & letter
    return np.flatnonzero(start)


class ByteLevelIds:
    """Ids of a byte-level BPE file of the tokenizers library. Each distinct piece of text goes to the library once."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[int, bytes] = {}

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([w.decode() for w in texts], add_special_tokens=False)
        return [array.array("I", e.ids).tobytes() for e in got]

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all rows, joined, and the offsets of each row's ids."""
        raw, n = data.tobytes(), len(offsets) - 1
        odd = {}
        if not raw.isascii() or _CONTROL.search(raw):
            for k in range(n):
                t = raw[offsets[k]:offsets[k + 1]]
                if (not t.isascii() or _CONTROL.search(t)) and _OTHER_SPACE.search(t.decode()):
                    odd[k] = np.frombuffer(self._encode([t])[0], np.uint32)
        start = piece_starts(data, offsets)
        h = span_hashes(data, start, np.append(start[1:], len(data)))
        value, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        got = list(map(self.known.get, value.tolist()))
        new = [i for i, v in enumerate(got) if v is None]
        if new:
            ends = np.append(start[1:], len(data))
            for i, ids in zip(new, self._encode([raw[a:b] for a, b in zip(start[first[new]].tolist(), ends[first[new]].tolist())])):
                got[i] = ids
            if len(self.known) + len(new) > CACHE:
                self.known = {}
            self.known.update(zip(value[new].tolist(), map(got.__getitem__, new)))
        length = np.array(list(map(len, got)), np.int64) >> 2
        flat = np.frombuffer(b"".join(got), np.uint32)
        begin = np.cumsum(length) - length
        size = length[inverse]
        end = np.cumsum(size)
        ids = flat[np.arange(int(size.sum())) + np.repeat(begin[inverse] - (end - size), size)]
        cut = np.append(0, end)[np.searchsorted(start, offsets)]
        if odd:
            parts = [odd[k] if k in odd else ids[cut[k]:cut[k + 1]] for k in range(n)]
            ids, cut = np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))
        return ids, cut


_HELD: dict[str, object] = {}


def held(kind: type, vocabulary: str):
    """One encoder per process, kind and file."""
    key = f"{kind.__name__}:{hashlib.sha256(vocabulary.encode()).hexdigest()}"
    if key not in _HELD:
        _HELD[key] = kind(vocabulary)
    return _HELD[key]
