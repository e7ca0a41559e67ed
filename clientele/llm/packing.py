"""Best-fit decreasing packing of token sequences.

Texts become token ids with an end id behind them; only what is longer than a sequence is cut. Pieces go
by falling length into the open sequence with the tightest room that holds them, which a segment tree
over remaining capacities finds in logarithmic time.

Pieces of one length are interchangeable, and so are sequences with one remaining capacity. So the
decisions follow from the count of each length alone: the tree is asked once for a whole run of equal
pieces and equal sequences, and the answer is the one that asking it piece by piece gives. Spark counts
lengths, numbers the pieces of each length and looks every piece up in the runs; the driver holds one
count per length, at most ``capacity`` of them, and the runs that follow from these.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from struct import pack as packed_ids

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from clientele.llm.bpe import PIECE, SIMPLE, byte_letters, default_path
from clientele.llm.common import small, small_batches
from clientele.operators.ordering import settled

CAPACITY = 2048
END_ID = 0
LARGEST_CAPACITY = 1 << 16
KEPT_WORDS = 400_000  # of each of the two ages of the word cache
LONGEST_KEPT = 64
CHUNK = r"[^\t-\r \x85\xa0]+"  # fixed value: what the file's pattern takes for white space separates words

PIECES = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType()),
])
RUNS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("length", T.LongType()), T.StructField("low", T.LongType()),
    T.StructField("high", T.LongType()), T.StructField("skip", T.LongType()), T.StructField("bin", T.LongType()),
    T.StructField("each", T.LongType()), T.StructField("base", T.LongType()),
])


# ---------------------------------------------------------------- tokens


class _Words(dict):
    """Ids of words, filled on demand, in two ages: when this one is full it becomes the old one, whose
    words return when they are met again. So frequent words stay, and memory is bounded."""

    def __init__(self, make, most: int = KEPT_WORDS):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file, with a cache of words.

    Texts of Latin letters are cut at white space; each new word is split by the file's pattern and goes
    to the library's model, known ones are looked up. Texts with other scripts or with special tokens go
    to the library whole.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokens = self.library.model.tokenize
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.letters = byte_letters()
        self.chunks, self.pieces = re.compile(CHUNK).findall, re.compile(PIECE).findall
        self.beyond = re.compile(f"[{SIMPLE}-\U0010ffff]").search
        self.words = _Words(self._encode_word)

    def _encode_word(self, word: str) -> bytes:
        plain = word.isascii()
        found = [word] if plain and word.isalpha() else self.pieces(word)
        if not plain:
            found = ["".join([self.letters[b] for b in piece.encode()]) for piece in found]
        ids = [t.id for piece in found for t in self.tokens(piece)]
        return packed_ids(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null is the empty text."""
        if not text:
            return b""
        plain = unicodedata.normalize("NFC", text).lower()
        if self.beyond(plain) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, self.chunks(plain)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process, so tasks share its words."""
    return Encoder(path)


def pieces(documents: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END_ID,
           path: str | None = None) -> DataFrame:
    """``(key, piece, start, length, ids)`` and the place ``(part, nth)`` of each piece among those of its length.

    A document is its ids and ``end``; one longer than ``capacity`` is cut into full pieces and a rest.
    ``nth`` counts the pieces of one length within a task, so the rows must be kept before they are used.
    """
    path = path or default_path()
    mark = packed_ids("<I", end)
    wide = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

        for rows in batches:
            made, size = [], 0
            for k, value in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                ids = encode(value) + mark
                for i, at in enumerate(range(0, len(ids), wide)):
                    cut = ids[at : at + wide]
                    length = len(cut) // 4
                    made.append((k, i, at // 4, length, cut, part, seen[length]))
                    seen[length] += 1
                    size += len(cut)
                    if size > 1 << 20:
                        yield batch(made)
                        made, size = [], 0
            if made:
                yield batch(made)

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
    names = PIECES.names
    narrow = small_batches(documents).select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return narrow.mapInArrow(run, PIECES)


# ---------------------------------------------------------------- the plan


class Rooms:
    """Open sequences by remaining capacity, under a segment tree that tells which capacities occur."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, first: int, count: int) -> None:
        """``count`` sequences numbered from ``first``, each with this room; full ones are closed."""
        if room and count:
            self.open[room].append((first, count))
            at = self.leaves + room
            while at and not self.any[at]:
                self.any[at] = 1
                at >>= 1

    def take(self, room: int) -> tuple[int, int]:
        run = self.open[room].pop()
        at = self.leaves + room
        if not self.open[room]:
            self.any[at] = 0
            while at > 1:
                at >>= 1
                self.any[at] = self.any[2 * at] | self.any[2 * at + 1]
        return run

    def tightest(self, length: int) -> int | None:
        """The least room of an open sequence that is at least ``length``: up to the first subtree on the
        right that has one, then down its left side."""
        at = self.leaves + length
        while not self.any[at]:
            while at & 1:
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            while not self.any[at] and not at & 1:
                at >>= 1
                if at <= 1:
                    return None
        while at < self.leaves:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs ``(length, first, count, bin, each, base)`` of best-fit decreasing, for the number of pieces per length.

    Pieces ``first .. first + count - 1`` of a length go to sequences from ``bin`` on, ``each`` to one,
    side by side from offset ``base``. A piece leaves its sequence the tightest one for the next of the
    same length as long as that fits, so a sequence takes ``room // length`` pieces before the next does.
    """
    rooms, bins, runs = Rooms(capacity), 0, []

    def fill(length: int, done: int, left: int, room: int, first: int, count: int) -> tuple[int, int]:
        """Pieces placed and sequences touched."""
        each = room // length
        full = min(count, left // each)
        if full:
            runs.append((length, done, full * each, first, each, capacity - room))
            rooms.add(room - each * length, first, full)
        rest = min(left - full * each, each - 1) if full < count else 0
        if rest:
            runs.append((length, done + full * each, rest, first + full, rest, capacity - room))
            rooms.add(room - rest * length, first + full, 1)
        return full * each + rest, full + (rest > 0)

    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                need = -(-left // (capacity // length))
                placed, _ = fill(length, done, left, capacity, bins, need)
                bins += need
            else:
                first, count = rooms.take(room)
                placed, touched = fill(length, done, left, room, first, count)
                rooms.add(room, first + touched, count - touched)
            done, left = done + placed, left - placed
    return np.array(runs, np.int64).reshape(-1, 6)


# ---------------------------------------------------------------- the operator


def pack(documents: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END_ID,
         path: str | None = None) -> DataFrame:
    """``(key, piece, start, length, ids, sequence_id, offset)``: one row per piece of at most ``capacity`` tokens.

    ``start`` counts the document's ids before the piece, ``offset`` the place in its sequence, gapless
    from 0; ``ids`` are packed little-endian 32-bit integers. Null and empty texts are the end id alone;
    texts of any length are encoded whole; repeated rows and null keys are packed like any other; other
    columns are not read, whatever their names. An empty table gives no rows. ``capacity`` is at most
    65,536, which bounds the table of lengths that the driver sees; a wider one is refused.
    """
    if not 0 < capacity <= LARGEST_CAPACITY:
        raise ValueError(f"capacity must be between 1 and {LARGEST_CAPACITY}")
    kept = settled(pieces(documents, text, key, capacity, end, path))
    counts = settled(kept.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    lengths = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(lengths, capacity)
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    placed = counts.select("part", "length", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    wanted = settled(placed.mapInArrow(_cut_by(runs), RUNS))
    at = kept.alias("p").join(
        small(wanted).alias("r"),
        (F.col("p.part") == F.col("r.part")) & (F.col("p.length") == F.col("r.length"))
        & (F.col("p.nth") >= F.col("r.low")) & (F.col("p.nth") < F.col("r.high")),
    )
    j = F.col("p.nth") + F.col("r.skip")
    sequence = F.col("r.bin") + F.floor(j / F.col("r.each"))
    offset = F.col("r.base") + F.pmod(j, F.col("r.each")) * F.col("p.length")
    return at.select(F.col("p.key").alias(key), "p.piece", "p.start", "p.length", "p.ids",
                     sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def _cut_by(runs: np.ndarray):
    """For each task's pieces of one length, the runs that hold them: ``nth`` from ``low`` to before ``high``
    is number ``nth + skip`` of its run."""
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    table = runs[order]
    edges = {int(x): slice(*np.searchsorted(table[:, 0], [x, x + 1])) for x in np.unique(table[:, 0])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for r in rows.to_pylist():
                own = table[edges[r["length"]]]
                last = r["before"] + r["n"]
                a, z = np.searchsorted(own[:, 1], [r["before"], last - 1], side="right") - 1
                for _, first, count, first_bin, each, base in own[a : z + 1].tolist():
                    low, high = max(first - r["before"], 0), min(first + count, last) - r["before"]
                    out.append((r["part"], r["length"], low, high, r["before"] - first, first_bin, each, base))
            columns = list(zip(*out, strict=True)) if out else [()] * len(RUNS)
            types = [pa.int32(), *[pa.int64()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=RUNS.names)

    return run
