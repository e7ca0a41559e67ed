"""Nearest neighbours by random-hyperplane hashing, for tables whose pairs are too many to compare.

Each of a few hash tables gives a vector one bit per random hyperplane: the side on which it lies. A query
probes buckets in the order in which a neighbour is likely to be there: bits whose hyperplane is near are
flipped first, alone and together. Every candidate in a probed bucket is compared exactly.

How many buckets to probe is fitted: for a bounded sample of queries the true neighbours are found by
comparing all, and the least number of probes is taken that reaches the wanted recall on it. All rows are
indexed; the sample decides the cost only. ``pairs.nearest`` is the exact form.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientele.functions.hashing import unit_hash
from clientele.operators.ordering import settled, top_rows
from clientele.operators.pairs import nearest, squared_distances

TABLES = 4
MOST_BITS = 14
BUCKET_ROWS = 512  # wanted mean size of a bucket
UNIT_ROWS = 4096  # rows of either side that meet at once
SPREAD_ROWS = 16_384  # rows with their vectors that a task holds while it deals them to buckets
BLOCK_CELLS = 1 << 20  # distances that a task holds at once
SAMPLE = 256  # queries whose true neighbours are found to fit the number of probes
RECALL = 0.95  # wanted on the sample


@dataclass(frozen=True)
class Index:
    """Hyperplanes of each table, the centre they pass through, and the flips of a query in their order."""

    planes: np.ndarray  # tables x bits x width
    center: np.ndarray
    flips: np.ndarray  # masks over bits sorted by distance, likeliest first
    probes: int

    def sides(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(codes, margins)``: rows x tables, and rows x tables x bits."""
        margins = np.einsum("nw,tbw->ntb", vectors - self.center, self.planes)
        return (margins > 0) @ (1 << np.arange(self.planes.shape[1])), np.abs(margins)

    def probed(self, vectors: np.ndarray) -> np.ndarray:
        """Buckets of each row, rows x tables x probes."""
        codes, margins = self.sides(vectors)
        place = 1 << np.argsort(margins, axis=2)
        chosen = (self.flips[: self.probes, None] >> np.arange(self.planes.shape[1])) & 1
        return codes[:, :, None] ^ np.einsum("pb,ntb->ntp", chosen, place)

    def rank(self, queries: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The probe at which a query's found vector is met first, over all tables."""
        a, margins = self.sides(queries)
        b, _ = self.sides(found)
        order = np.argsort(margins, axis=2)
        differs = ((a ^ b)[:, :, None] >> order) & 1
        mask = differs @ (1 << np.arange(self.planes.shape[1]))
        at = np.empty(len(self.flips), np.int64)
        at[self.flips] = np.arange(len(self.flips))
        return at[mask].min(axis=1)


def flip_order(bits: int) -> np.ndarray:
    """All sets of bits, sorted by the squared distance they are expected to cost.

    Bit j of a set is the j-th nearest hyperplane, whose squared distance grows as j (j + 1).
    """
    cost = np.arange(1, bits + 1) * np.arange(2, bits + 2)
    masks = np.arange(1 << bits)
    total = ((masks[:, None] >> np.arange(bits)) & 1) @ cost
    return masks[np.argsort(total, kind="stable")]


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(float) if len(column) else np.zeros((0, 0))


def fit(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, tables: int = TABLES, bucket_rows: int = BUCKET_ROWS,
        recall: float = RECALL, sample: int = SAMPLE, seed: int = 42) -> Index:
    """Hyperplanes through the mean of the base, and the number of probes that the sample needs.

    The sample are the ``sample`` queries with the smallest hashes; each is compared with all of the base.
    """
    n = base.count()
    bits = min(MOST_BITS, max(1, math.ceil(math.log2(max(2, n / bucket_rows)))))
    size = base.agg(F.max(F.size(vector))).first()[0] or 1
    means = base.select(F.posexplode(F.col(vector).cast("array<double>"))).groupBy("pos").agg(F.avg("col").alias("m")).collect()
    center = np.zeros(size)
    for r in means:
        center[r.pos] = r.m
    planes = np.random.default_rng(seed).standard_normal((tables, bits, size))
    index = Index(planes, center, flip_order(bits), 1)
    few = settled(queries.orderBy(unit_hash(seed, key), key).limit(sample))
    true = nearest(few, base.withColumn("__v", F.col(vector)), key, vector, "__v", k)
    rows = true.join(few.select(F.col(key).alias("query"), F.col(vector).alias("q")), "query").select("q", "carry").toPandas()
    if not len(rows):
        return index
    ranks = np.sort(index.rank(_vectors(rows["q"]), _vectors(rows["carry"])))
    probes = int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)]) + 1
    return Index(planes, center, index.flips, probes)


def dealt(codes_of: Callable[[np.ndarray], np.ndarray], per_row: int) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows with their vectors, once for each of the ``per_row`` buckets that ``codes_of`` gives them, a bounded number at a time."""
    step = max(1, SPREAD_ROWS // per_row)

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for at in range(0, len(whole), step):
                part = whole.iloc[at : at + step]
                codes = codes_of(_vectors(part["v"]))
                rows, where, _ = np.indices(codes.shape).reshape(3, -1)
                out = part.iloc[rows].reset_index(drop=True)
                yield out.assign(table=where.astype("int32"), code=codes.ravel().astype("int32"))

    return run


def best(asked: pd.DataFrame, held: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest held rows of each asked one; some queries at a time, so the distances in memory are bounded."""
    if asked.empty or held.empty:
        return pd.DataFrame({"query": asked["k"][:0], "neighbour": held["k"][:0], "distance": [], "carry": held["c"][:0]})
    held = held.sort_values("k")
    own, vectors = _vectors(asked["v"]), _vectors(held["v"])
    step, tops, near = max(1, BLOCK_CELLS // len(held)), [], []
    for i in range(0, len(asked), step):
        d = np.round(np.sqrt(squared_distances(own[i : i + step], vectors)), 12)
        tops.append(np.argsort(d, axis=1, kind="stable")[:, :k].copy())  # a view would keep all places
        near.append(np.take_along_axis(d, tops[-1], axis=1))
    top, away = np.concatenate(tops), np.concatenate(near)
    at, flat = np.repeat(np.arange(len(asked)), top.shape[1]), top.ravel()
    return pd.DataFrame({"query": asked["k"].to_numpy()[at], "neighbour": held["k"].to_numpy()[flat], "distance": away.ravel(),
                         "carry": held["c"].to_numpy()[flat]})


def hashed_nearest(queries: DataFrame, base: DataFrame, key: str, vector: str, carry: str, k: int, index: Index,
                   unit_rows: int = UNIT_ROWS) -> DataFrame:
    """The k nearest of the probed base rows of each query: ``(query, neighbour, distance, carry, place)``.

    Equal distances are settled by the neighbour's key, as in the exact form. A bucket that many rows or
    queries share is cut on both sides, and each cut returns its k best per query, so no task holds more
    than ``unit_rows`` of either side and no pair is written that cannot be among the k.
    """
    key_type, carry_type = queries.schema[key].dataType, base.schema[carry].dataType
    placed = T.StructType([T.StructField("k", key_type), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("table", T.IntegerType()),
                           T.StructField("code", T.IntegerType())])

    b = base.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.col(carry).alias("c"))
    b = settled(b.mapInPandas(dealt(lambda x: index.sides(x)[0][:, :, None], len(index.planes)), T.StructType([*placed.fields[:2], T.StructField("c", carry_type), *placed.fields[2:]])))
    q = queries.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    q = settled(q.mapInPandas(dealt(index.probed, len(index.planes) * index.probes), placed))
    bucket = ["table", "code"]
    cuts = lambda df, out: df.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / unit_rows).cast("int").alias(out))
    sizes = settled(cuts(b, "nb").join(cuts(q, "nq"), bucket))
    part = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.join(sizes, bucket).withColumn("i", part("nq")).withColumn("j", every("nb")).drop("nb", "nq")
    right = b.join(sizes, bucket).withColumn("j", part("nb")).withColumn("i", every("nq")).drop("nb", "nq")
    schema = T.StructType([T.StructField("query", key_type), T.StructField("neighbour", key_type), T.StructField("distance", T.DoubleType()),
                           T.StructField("carry", carry_type)])

    def compare(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        return best(asked, held, k)

    unit = [*bucket, "i", "j"]
    found = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInPandas(compare, schema)
    # several tables find the same neighbour
    once = found.groupBy("query", "neighbour").agg(F.min("distance").alias("distance"), F.first("carry").alias("carry"))
    return top_rows(once, ["query"], [F.col("distance"), F.col("neighbour")], k, out="place")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, true neighbours, how many of them were found, and their share."""
    hit = exact.select("query", "neighbour").join(found.select("query", "neighbour", F.lit(1).alias("hit")), ["query", "neighbour"], "left")
    return hit.agg(F.countDistinct("query").alias("queries"), F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found")).withColumn(
        "recall", F.try_divide("found", "neighbours"))
