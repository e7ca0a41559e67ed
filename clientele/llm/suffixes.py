"""Removal of long repeats over a logarithmic family of suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier, in a document with a
smaller key or earlier in the same one. The index holds suffixes that the content itself selects:
every window of ``length`` bytes names the smallest of its ``sample``-byte hashes, and neighbouring
windows that name the same value form a run. Equal windows lie in runs of the same value, so a run is
entered as one suffix (value, hash of all its bytes, place), one for some thirty bytes of text.

Documents come in batches of ascending keys. A batch's suffixes are sorted by value and content (its
suffix array) and merge-scanned against the existing arrays, the levels: a run whose bytes all stand
in an earlier run repeats whole; runs that share only the value may repeat in part, and so may runs
with a periodic text. The batch's first suffixes then become a level; two levels of equal rank are
merged into one of the next rank, so there are never more levels than the logarithm of the batches.

Windows of the runs that may repeat in part are hashed one by one at the end and compared; all
comparisons are joins and partial minima on hashes, so a passage that very many documents share is
split like any other. Strings are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientele.llm.common import small_batches
from clientele.llm.shingles import BASE, INVERSE, U, mixed, powers
from clientele.operators.ordering import dropped, settled

LENGTH = 100
SAMPLE = 40
BATCHES = 4
SLICE = 128  # documents handled at a time inside a task


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


class Hashes:
    """Hashes of any stretch of one text, from running sums of a polynomial."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.zeros(len(raw) + 1, U)
        np.cumsum((raw.astype(U) + U(1)) * powers(BASE, len(raw)), out=self.sums[1:])
        self.shift = powers(INVERSE, len(raw) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.shift[starts] + (ends - starts).astype(U))

    def rolling(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.shift[:n])


def runs(text: str | None, length: int = LENGTH, sample: int = SAMPLE) -> tuple[np.ndarray, ...] | None:
    """Value, content hash, first window, number of windows, and whether it may repeat itself, of each run."""
    raw = _bytes(text)
    windows = len(raw) - length + 1
    if windows <= 0:
        return None
    hashes = Hashes(raw)
    h = hashes.rolling(sample)
    wide = length - sample + 1
    # smallest of the next `span` hashes by doubling, then of `wide` by two overlapping spans
    low, span = h, 1
    while span * 2 <= wide:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    smallest = np.minimum(low[:windows], low[wide - span : wide - span + windows])
    first = np.flatnonzero(np.concatenate([[True], smallest[1:] != smallest[:-1]]))
    count = np.diff(np.concatenate([first, [windows]]))
    value = smallest[first]
    itself = np.zeros(len(first), bool)
    # a value that comes again within `wide` places may belong to a periodic text
    after = np.full(len(h), np.iinfo(np.uint64).max, U)
    after[: windows - 1] = smallest[1:]
    tail = h[windows - 1 :]
    if len(tail) > 1:
        after[windows - 1 : len(h) - 1] = np.minimum.accumulate(tail[:0:-1])[::-1]
    q = np.flatnonzero(h == after)
    if len(q):
        # the first such place of the run's value that does not lie before the run, found in one sorted list
        kinds, kind = np.unique(h[q], return_inverse=True)
        listed = np.sort(kind * len(h) + q)
        own = np.minimum(np.searchsorted(kinds, value), len(kinds) - 1)
        at = np.searchsorted(listed, own * len(h) + first)
        place = listed[np.minimum(at, len(listed) - 1)] - own * len(h)
        itself = (kinds[own] == value) & (at < len(listed)) & (place >= first) & (place < np.minimum(first + count + wide - 1, len(h)))
    return value, hashes.of(first, first + count + length - 1), first, count, itself


def _sliced(batches: Iterator[pa.RecordBatch], make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield make(batch.slice(at, SLICE))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _first_ones(*columns: np.ndarray) -> np.ndarray:
    """Which rows are the first of their kind."""
    order = np.lexsort((np.arange(len(columns[0])), *columns))
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    new[:1] = True
    out = np.zeros(len(order), bool)
    out[order] = new
    return out


def suffixes(docs: DataFrame, length: int, sample: int) -> DataFrame:
    """``(value, content, doc, tie, place, again)`` of all runs of the texts.

    ``place`` packs the first window, the number of windows and whether the run may repeat itself;
    ``again`` marks runs whose content stands earlier in the same text.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs_, ties, texts = (c.to_pylist() for c in batch.columns)
        found = [(d, t, r) for d, t, x in zip(docs_, ties, texts, strict=True) if (r := runs(x, length, sample)) is not None]
        sizes = [len(r[0]) for _, _, r in found]
        whole = lambda i, kind: np.concatenate([np.zeros(0, kind), *[r[i] for _, _, r in found]])
        again = np.concatenate([np.zeros(0, bool), *[~_first_ones(r[0], r[1]) for _, _, r in found]])
        spread = lambda x: np.repeat(np.array(x, np.int64), sizes)
        place = whole(2, np.int64) << 32 | whole(3, np.int64) << 1 | whole(4, bool)
        return pa.RecordBatch.from_arrays(
            [_signed(whole(0, U)), _signed(whole(1, U)), pa.array(spread([d for d, _, _ in found])), pa.array(spread([t for _, t, _ in found])),
             pa.array(place), pa.array(again)], names=["value", "content", "doc", "tie", "place", "again"])

    narrow = small_batches(docs).select("doc", "tie", "text")
    return narrow.mapInArrow(lambda b: _sliced(b, one), "value long, content long, doc long, tie long, place long, again boolean")


class Levels:
    """Suffix arrays of geometric sizes: inserting one merges levels of equal rank."""

    def __init__(self):
        self.tables: list[tuple[int, DataFrame]] = []

    def insert(self, array: DataFrame) -> None:
        rank, table = 0, self._sorted(array)
        while self.tables and self.tables[-1][0] == rank:
            _, other = self.tables.pop()
            merged = self._sorted(other.unionByName(table))
            dropped(other, table)
            rank, table = rank + 1, merged
        self.tables.append((rank, table))

    @staticmethod
    def _sorted(array: DataFrame) -> DataFrame:
        return settled(array.repartition("value").sortWithinPartitions("value", "content"))

    def scan(self, batch: DataFrame) -> DataFrame | None:
        """The suffixes of all levels whose value the batch holds too."""
        out = None
        for _, table in self.tables:
            met = table.join(batch.select("value"), "value", "left_semi")
            out = met if out is None else out.unionByName(met)
        return out

    def drop(self) -> None:
        dropped(*[t for _, t in self.tables])
        self.tables = []


def _batch_ends(docs: DataFrame, batches: int) -> list[int]:
    shares = [i / batches for i in range(1, batches)]
    ends = docs.agg(F.percentile_approx("doc", shares, F.lit(1000)).alias("e")).first()["e"] if shares else None
    return sorted(set(ends or []))


def repeats(docs: DataFrame, length: int, sample: int, batches: int, ties: bool) -> DataFrame:
    """``(doc, tie, stretches)``: per document the windows that repeat, as packed (first window, number).

    A text holds each content once (later ones are marked before), so the earliest of several places
    is the one of the smallest document; with unique keys that is a minimum of plain numbers.
    """
    levels, whole, some = Levels(), [], []
    ends = _batch_ends(docs, batches)
    order = F.struct("doc", "tie") if ties else F.col("doc")
    stretch = F.shiftrightunsigned("place", 1).bitwiseAND(F.lit(0x7FFFFFFF)).bitwiseOR(F.shiftleft(F.shiftrightunsigned("place", 32), 32)).alias("stretch")
    for i in range(len(ends) + 1):
        after = F.lit(True) if i == 0 else F.col("doc") > ends[i - 1]
        until = F.lit(True) if i == len(ends) else F.col("doc") <= ends[i]
        batch = settled(suffixes(docs.where(after & until), length, sample))
        own = batch.where("NOT again").drop("again")
        known = levels.scan(own)
        entries = own.withColumn("old", F.lit(False))
        if known is not None:
            entries = entries.unionByName(known.withColumn("old", F.lit(True)))
        firsts = settled(entries.groupBy("value", "content").agg(
            F.min(order).alias("first"), F.min_by("place", order).alias("place"), F.count(F.lit(1)).alias("same"), F.max("old").alias("old")))
        placed = firsts.withColumn("doc", F.col("first.doc") if ties else F.col("first")).withColumn("tie", F.col("first.tie") if ties else F.lit(0).cast("long"))
        # whole repeats: any run of the batch whose content stands earlier
        met = firsts.where("same > 1").select("value", "content", "first")
        later = own.join(met, ["value", "content"]).where(order != F.col("first")).select("doc", "tie", stretch)
        whole.append(settled(later.unionByName(batch.where("again").select("doc", "tie", stretch))))
        # runs that share their value with other content, or may repeat themselves
        shared = firsts.groupBy("value").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("value")
        partly = placed.join(shared, "value", "left_semi").unionByName(placed.where("place % 2 = 1 AND NOT old"))
        some.append(settled(partly.select("doc", "tie", stretch)))
        if i < len(ends):
            levels.insert(placed.where("NOT old").select("value", "content", "doc", "tie", "place"))
        dropped(batch, firsts)
    levels.drop()
    windows = settled(_windows(docs, _union(some).distinct(), length))
    own = windows.where("NOT again")
    earliest = own.groupBy("hash").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("same"))
    earliest = settled(earliest.where("same > 1").select("hash", "first"))
    one = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.lit(1)).alias("stretch")
    again = own.join(earliest, "hash").where(order != F.col("first")).unionByName(windows.where("again"), allowMissingColumns=True)
    stretches = _union([*whole, again.select("doc", "tie", one)])
    out = settled(stretches.groupBy("doc", "tie").agg(F.collect_list("stretch").alias("stretches")))
    dropped(windows, earliest, *whole, *some)
    return out


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _unpacked(stretches: list[int]) -> tuple[np.ndarray, np.ndarray]:
    packed = np.array(stretches or [], np.int64)
    return packed >> 32, packed & 0xFFFFFFFF


def _windows(docs: DataFrame, some: DataFrame, length: int) -> DataFrame:
    """``(hash, doc, tie, at, again)`` of all windows in the given runs, and whether each stands earlier in its text."""
    per_doc = some.groupBy("doc", "tie").agg(F.collect_list("stretch").alias("stretches"))
    joined = docs.join(per_doc, ["doc", "tie"]).select("doc", "tie", "text", "stretches")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs_, ties, texts, lists = (c.to_pylist() for c in batch.columns)
        places, hashed, again, sizes = [np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros(0, bool)], []
        for text, stretches in zip(texts, lists, strict=True):
            first, count = _unpacked(stretches)
            at = np.unique(np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum()))
            hashes = Hashes(_bytes(text)).of(at, at + length)
            places.append(at)
            hashed.append(hashes)
            again.append(~_first_ones(hashes))
            sizes.append(len(at))
        spread = lambda x: pa.array(np.repeat(np.array(x, np.int64), sizes))
        return pa.RecordBatch.from_arrays(
            [_signed(np.concatenate(hashed)), spread(docs_), spread(ties), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(again))],
            names=["hash", "doc", "tie", "at", "again"])

    return joined.mapInArrow(lambda b: _sliced(b, one), "hash long, doc long, tie long, at int, again boolean")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, sample: int = SAMPLE,
                   batches: int = BATCHES) -> DataFrame:
    """``(key, kept, n_bytes, n_removed, n_spans)``: what is left of each text, as bytes.

    Null and empty texts have no bytes; texts shorter than ``length`` lose none. Null keys come before
    all others. Rows with equal keys and unequal texts are ordered by a hash of the text; of rows
    equal in both, one counts as the first and the others lose everything (if long enough). Only key
    and text are read.
    """
    if not 8 <= sample < length:
        raise ValueError("the sample must be shorter than the repeats")
    doc = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    rows = df.select(doc.alias("doc"), F.col(key).isNull().alias("none"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc").alias("d")).first()
    # a second sort key is only needed if keys repeat
    ties = counts["n"] != counts["d"]
    docs = rows.select("doc", (F.xxhash64("text") if ties else F.lit(0)).cast("long").alias("tie"), "text", "none")
    once = docs.select("doc", "tie", "text")
    found = repeats(once.distinct() if ties else once, length, sample, batches, ties)
    joined = docs.join(found, ["doc", "tie"], "left").select("doc", "tie", "text", "stretches", "none")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, removed, spans, size = [], [], [], []
        for value, stretches in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            raw = _bytes(value)
            edges = np.zeros(len(raw) + 1, np.int64)
            first, count = _unpacked(stretches)
            np.add.at(edges, first, 1)
            np.add.at(edges, first + count - 1 + length, -1)
            gone = np.cumsum(edges)[:-1] > 0
            kept.append(raw[~gone].tobytes())
            size.append(len(raw))
            removed.append(int(gone.sum()))
            spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(4), pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())],
            names=["doc", "tie", "none", "kept", "n_bytes", "n_removed", "n_spans"])

    made = joined.mapInArrow(lambda b: _sliced(b, one), "doc long, tie long, none boolean, kept binary, n_bytes long, n_removed long, n_spans long")
    if ties:
        nth = F.row_number().over(W.partitionBy("doc", "tie").orderBy("n_bytes"))
        made = made.withColumn("again", (nth > 1) & (F.col("n_bytes") >= length))
        made = made.select(
            "doc", "none", F.when(F.col("again"), F.lit(b"")).otherwise(F.col("kept")).alias("kept"), "n_bytes",
            F.when(F.col("again"), F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
            F.when(F.col("again"), F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"))
    return made.select(F.when(~F.col("none"), F.col("doc")).alias(key), "kept", "n_bytes", "n_removed", "n_spans")
