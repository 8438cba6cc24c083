"""BPE encoding and decoding by dynamic programming over prefixes.

The encoding of a prefix ends in exactly one token. For every prefix of a piece the automaton of the vocabulary yields the
tokens that end there, longest first; the one that is compatible with the last token of the prefix before it is stored, and
the stored tokens, followed back from the end, are the exact ids. Two tokens are compatible if merging their joined symbols
in rank order leaves both as they are; this is tested by taking the later merge of the two apart again and again and asking
whether the pair that then faces the border would have merged first.

Texts are normalised and split as the vocabulary file says: NFC, lower case per character, letters, single digits and other
signs apart, white space dropped; the last symbol of a piece carries the word end. Strings of special tokens become their ids.

Null text is the empty text: no ids, empty decoding. Repeated rows stay; null ids stay; an empty table gives an empty table;
further columns are ignored. A text of any length is processed whole, word by word.
"""
from __future__ import annotations

import array
import hashlib
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.llm.vocab import WordCache, held, read_vocabulary, slices

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
_PAIRS = 1 << 20   # compatibility results kept


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte: itself, or the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    signs, free = [], 256
    for b in range(256):
        signs.append(chr(b if b in plain else free))
        free += b not in plain
    return signs


class PrefixCoder:
    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.strings = {i: s for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings.update({i: s for s, i in self.special.items()})
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.piece = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        from tokenizers import Tokenizer

        signs = byte_signs()
        self.value = {ord(c): b for b, c in enumerate(signs)}
        library = Tokenizer.from_str(vocabulary)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        symbols: dict[int, tuple[int, ...]] = {}
        for b, sign in enumerate(signs):
            symbols[vocab[sign]] = (b,)
            symbols[vocab[sign + end]] = (b + 256,)
        self.born = dict.fromkeys(symbols, -1)
        self.left, self.right, self.merge = {}, {}, {}
        for rank, (a, b) in enumerate(model["merges"]):
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.merge[i << 20 | j] = rank
            if k not in symbols:
                symbols[k], self.born[k], self.left[k], self.right[k] = symbols[i] + symbols[j], rank, i, j
        self._automaton(symbols)
        self.known: dict[int, bool] = {}
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self.cache = WordCache(lambda ws: [self.word(w) for w in ws])

    def _automaton(self, symbols: dict[int, tuple[int, ...]]) -> None:
        """States are the prefixes of tokens; shorter[s] is the longest proper suffix of s that is a token's prefix."""
        step: dict[int, int] = {}
        token, depth, order = [-1], [0], []
        for t, seq in symbols.items():
            s = 0
            for x in seq:
                key = s << 9 | x
                n = step.get(key)
                if n is None:
                    n = step[key] = len(token)
                    token.append(-1)
                    depth.append(depth[s] + 1)
                    order.append((s, x, n))
                s = n
            token[s] = t
        shorter, ending = [0] * len(token), [0] * len(token)
        for s, x, n in sorted(order, key=lambda o: depth[o[2]]):
            f = shorter[s]
            while f and f << 9 | x not in step:
                f = shorter[f]
            shorter[n] = step.get(f << 9 | x, 0) if s else 0
            f = shorter[n]
            ending[n] = f if token[f] >= 0 else ending[f]   # next shorter state that is a token
        self.step, self.token, self.depth, self.shorter, self.ending = step, token, depth, shorter, ending

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= _PAIRS:
                self.known.clear()
            got = self.known[key] = self._compatible(a, b)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        born, limit = self.born, len(self.merge)
        while True:
            rank = self.merge.get(a << 20 | b)
            if rank is not None and rank < limit:
                return False
            if born[a] > born[b]:
                limit = born[a]          # at equal rank the merge to the left came first
                a = self.right[a]
            elif born[b] >= 0:
                limit = born[b] + 1      # at equal rank the pair at the border would have come first
                b = self.left[b]
            else:
                return True

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        step, token, depth, shorter, ending, compatible = self.step, self.token, self.depth, self.shorter, self.ending, self.compatible
        n = len(piece)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        s = 0
        for i, x in enumerate(piece, 1):
            if i == n:
                x += 256
            key = s << 9 | x
            nxt = step.get(key)
            while nxt is None:
                s = shorter[s]
                nxt = step.get(s << 9 | x)
            s = nxt
            t = s if token[s] >= 0 else ending[s]
            while True:
                k, d = token[t], depth[t]
                if d == i or compatible(last[i - d], k):
                    last[i], size[i] = k, d
                    break
                t = ending[t]
        out, i = [], n
        while i:
            out.append(last[i])
            i -= size[i]
        return tuple(out[::-1])

    def split(self, text: str) -> list[bytes]:
        """Normalised pieces. Signs from U+0250 on go to the library's normaliser and splitter, whose Unicode version counts."""
        if not text.isascii() and max(text) > "\u024f":
            return [bytes(map(self.value.__getitem__, map(ord, p))) for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]
        text = unicodedata.normalize("NFC", text)
        text = text.lower() if text.isascii() else "".join(map(str.lower, text))
        return [p.encode() for p in self.piece.findall(text)]

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        for raw in self.split(text):
            ids = self.pieces.get(raw)
            if ids is None:
                ids = self.encode_piece(raw)
                if len(self.pieces) < 250_000 and len(raw) < 64:
                    self.pieces[raw] = ids
            out.extend(ids)
        return out

    def word(self, raw: bytes) -> tuple[bytes, bytes]:
        """(ids as little-endian uint32 bytes, their strings joined by spaces) of text between white space."""
        text, at, ids = raw.decode(), 0, []
        for m in self.cut.finditer(text) if self.cut and "<" in text else ():
            ids += self._plain(text[at:m.start()])
            ids.append(self.special[m[0]])
            at = m.end()
        ids += self._plain(text[at:] if at else text)
        return array.array("I", ids).tobytes(), " ".join([self.strings[i] for i in ids]).encode()

    def texts(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        lists = [t.split() for t in texts]
        table = self.cache.table(lists)
        out = []
        for ws in lists:
            got = [table[w] for w in ws]
            out.append((b"".join([g[0] for g in got]), b" ".join([g[1] for g in got if g[1]])))
        return out

    def ids(self, text: str) -> list[int]:
        return array.array("I", self.texts([text.encode()])[0][0]).tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids)


def encode_batches(batches, vocabulary: str):
    coder = held(PrefixCoder, vocabulary)
    for b in batches:
        for k, texts in _sliced(b):
            got = coder.texts(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(k, len(texts)), pa.array([len(i) // 4 for i, _ in got], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i, _ in got]),
                 pa.array([hashlib.sha256(d).hexdigest() for _, d in got])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _sliced(b):
    k = 0
    for texts in slices(x.as_py() or b"" for x in b.column(1)):
        yield k, texts
        k += len(texts)


def round_trip(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of every text's ids and of their decoding."""
    vocabulary = read_vocabulary(vocabulary_path)
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return src.mapInArrow(lambda batches: encode_batches(batches, vocabulary), SCHEMA)
