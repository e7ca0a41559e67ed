"""Byte-pair encoding and decoding with forced-boundary splitting.

A merge joins two neighbours into a vocabulary token, so two bytes that stand side by side in no
token can never be joined: between them lies a certain cut. Each word is cut at all such places, the
fragments are encoded on their own, and their ids are concatenated; the result is that of encoding
the word whole. Fragments and words repeat, so each task keeps what it has encoded in a bounded
cache.

The vocabulary is a file of the ``tokenizers`` library (BPE model with a word-end mark); its path is
a parameter and must be readable on every executor. Normalisation and word splitting follow that
file: NFC, white space to blanks, lower case, then contractions, letter runs, single digits and runs
of anything else. Special tokens that stand in a text are recognised before that.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from clientele.llm.common import map_texts

CACHED = 100_000
LONG = 64  # bytes of a fragment from which a heap finds the next merge
LONGEST_KEPT = 256  # longer words are not kept
# fixed values of the vocabulary file, for text below U+0370: letters, digits and its word pattern
LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02c1\u02c6-\u02d1\u02e0-\u02e4\u02ec\u02ee"
DIGITS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\t-\r \x85\xa0{LETTERS}{DIGITS}]+"
SIMPLE = "\u0370"
END = "</w>"
SHIFT, MASK, NONE = 24, (1 << 24) - 1, 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class _Cache(dict):
    """Fills itself; starts anew when it holds ``CACHED`` entries, so its memory is bounded."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) > LONGEST_KEPT:
            return value
        if len(self) >= CACHED:
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.start = [vocab[c] for c in letters]
        self.last = [vocab[c + END] for c in letters]
        # both ids in one key; rank and new id in one value, so the least value is the first merge
        self.merges = {vocab[a] << SHIFT | vocab[b]: rank << SHIFT | vocab[a + b] for rank, (a, b) in enumerate(merges)}
        self.tokens = [""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = token
        # pairs that occur inside some token; any other pair is a certain cut
        self.joined = bytearray(1 << 16)
        for token in vocab:
            raw = [byte_of[c] for c in token.removesuffix(END)]
            for a, b in zip(raw, raw[1:]):
                self.joined[a << 8 | b] = 1
        self.special = {s: np.uint32(i).tobytes() for s, i in special.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.byte_of = byte_of
        self.pieces = re.compile(PIECE).findall
        self.path, self.library = path, None
        self.fragments = _Cache(self._encode_fragment)
        self.words = _Cache(self._encode_word)

    def _encode_fragment(self, key: tuple[bytes, bool]) -> bytes:
        raw, ends = key
        ids = [self.start[b] for b in raw]
        if ends:
            ids[-1] = self.last[raw[-1]]
        if len(ids) > LONG:
            ids = self._merge_long(ids)
            return pack(f"<{len(ids)}I", *ids)
        found = self.merges.get
        ranks = [found(a << SHIFT | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NONE:
            i = ranks.index(best)
            ids[i] = best & MASK
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = found(ids[i - 1] << SHIFT | ids[i], NONE)
            if i < len(ranks):
                ranks[i] = found(ids[i] << SHIFT | ids[i + 1], NONE)
        return pack(f"<{len(ids)}I", *ids)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in the same order (best rank, then leftmost) with a heap, for fragments of any length."""
        found, n = self.merges.get, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(v, i, ids[i], ids[i + 1]) for i in range(n - 1) if (v := found(ids[i] << SHIFT | ids[i + 1])) is not None]
        heapify(heap)

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (v := found(ids[i] << SHIFT | ids[j])) is not None:
                heappush(heap, (v, i, ids[i], ids[j]))

        while heap:
            v, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = v & MASK, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]

    def cuts(self, raw: bytes) -> list[int]:
        """Places inside a word that no merge can cross."""
        joined = self.joined
        return [i + 1 for i in range(len(raw) - 1) if not joined[raw[i] << 8 | raw[i + 1]]]

    def _encode_word(self, word: str) -> bytes:
        raw = word.encode()
        cuts = self.cuts(raw)
        edges = [0, *cuts, len(raw)]
        return b"".join([self._fragment(raw[a:b], b == len(raw)) for a, b in zip(edges, edges[1:])])

    def _fragment(self, raw: bytes, ends: bool) -> bytes:
        return self.fragments[raw, ends] if len(raw) <= LONGEST_KEPT else self._encode_fragment((raw, ends))

    def _split(self, text: str) -> Iterator[str]:
        """Words of a text beyond Latin, by the library's own normaliser and splitter.

        Letters, digits and white space there depend on the Unicode release the library was built with.
        """
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        text = self.library.normalizer.normalize_str(text)
        for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text):
            yield bytes(self.byte_of[c] for c in piece).decode()

    def _plain(self, text: str) -> bytes:
        plain = unicodedata.normalize("NFC", text).lower()
        words = self.pieces(plain) if plain.isascii() or max(plain) < SIMPLE else self._split(text)
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.at_special or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join([self.special.get(x) or self._plain(x) for x in self.at_special.split(text) if x])

    def decode(self, ids: bytes | None) -> str:
        """Tokens joined by blanks, as the file names no decoder; special tokens stay."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """All columns of ``df`` plus ``out``: the ids as packed little-endian 32-bit integers.

    Null and empty texts give empty ids; texts of any length are encoded whole.
    """
    path = path or default_path()

    def make():
        codec = Codec(path)
        return lambda texts: [(codec.encode(t),) for t in texts]

    return map_texts(df, text, make, (out, T.BinaryType()))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """All columns of ``df`` plus ``out``: the text of packed ids; null ids give the empty text."""
    path = path or default_path()

    def make():
        codec = Codec(path)
        return lambda values: [(codec.decode(v),) for v in values]

    return map_texts(df, ids, make, (out, T.StringType()))


def encode_decode(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", path: str | None = None) -> DataFrame:
    """All columns of ``df`` plus the packed ids and the text they decode to, in one pass over the rows."""
    path = path or default_path()

    def make():
        codec = Codec(path)

        def both(value: str | None) -> tuple[bytes, str]:
            packed = codec.encode(value)
            return packed, codec.decode(packed)

        return lambda texts: [both(t) for t in texts]

    return map_texts(df, text, make, (ids, T.BinaryType()), (decoded, T.StringType()))
