"""Exact top-k search over integer vectors with block-at-a-time pruning.

Vectors are cut into blocks of neighbouring ids. A block keeps a forward index (the codes of its
vectors) and, per term (component), the largest and smallest code. A query's bound for a block is the
sum over terms of the best product these allow. Each query visits blocks in the order of their bounds
and stops when a bound falls below the k-th best score found so far; blocks it visits are scored whole.

Blocks are range-partitioned into shards, queries (a stated part of the rows) into groups. One task
unit is one shard and one group, both of bounded size; it answers each query with the shard's k best,
and a window keeps the k best of all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientele.operators.ordering import settled, top_rows

BLOCK = 256
SHARD = 32_768
QUERY_GROUP = 4096
SCALE = 256


def codes(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, code)``: floor(256 * x) of every component; rows with anything null or not finite are left out."""
    whole = F.col(vector).cast("array<double>")
    usable = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(
        whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(usable).select(
        F.col(key).cast("long").alias("id"), F.transform(whole, lambda x: F.floor(x * SCALE)).alias("code"))


def _matrix(values: pd.Series, width: int | None = None) -> np.ndarray:
    """Rows of codes as one matrix; shorter vectors end in zeros, which add nothing to a product."""
    width = max(map(len, values), default=0) if width is None else width
    out = np.zeros((len(values), width), np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


class Shard:
    """Blocks of one shard: ids, forward codes, and term maxima and minima."""

    def __init__(self, ids: np.ndarray, forward: np.ndarray, block: int = BLOCK):
        order = np.argsort(ids, kind="stable")
        self.ids, self.forward, self.block = ids[order], forward[order], block
        starts = np.arange(0, len(ids), block)
        self.high = np.maximum.reduceat(self.forward, starts) if len(ids) else self.forward
        self.low = np.minimum.reduceat(self.forward, starts) if len(ids) else self.forward
        largest = np.abs(self.forward).max(initial=0)
        self.exact = largest < 2**24  # small codes multiply exactly, and faster, as doubles

    def best(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int, forward: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best ``(score, id)`` of this shard for one query, ties to the smaller id; visits blocks by bound."""
        scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in np.argsort(-bounds, kind="stable"):
            if len(scores) == k and bounds[b] < scores[-1]:
                break
            at = slice(b * self.block, (b + 1) * self.block)
            new_ids, new = self.ids[at], (forward[at] @ query).astype(np.int64)
            if len(scores) == k:  # most rows of a block cannot enter
                kept = new >= scores[-1]
                new, new_ids = new[kept], new_ids[kept]
            other = new_ids != query_id
            scores, ids = np.concatenate([scores, new[other]]), np.concatenate([ids, new_ids[other]])
            first = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[first], ids[first]
        return scores, ids

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        largest = int(np.abs(queries).max(initial=0)) * int(np.abs(self.forward).max(initial=0)) * max(1, queries.shape[1])
        if largest >= 2**63:
            raise OverflowError("a score does not fit into a long")
        quick = largest < 2**53
        forward = self.forward.astype(np.float64) if quick else self.forward
        for i, q in enumerate(queries):
            yield query_ids[i], *self.best(query_ids[i], q.astype(np.float64) if quick else q, bounds[i], k, forward)


def search(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
           shard: int = SHARD, query_group: int = QUERY_GROUP) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest integer inner products of every query row.

    Candidates are all rows but those with the query's own id; ties go to the smaller id; a query with
    fewer candidates gets all of them. Vectors of unequal length are multiplied over the components
    both have; an empty vector scores 0. Rows with a null id take no part. If an id occurs in several
    rows, each row counts as a candidate, and each query row is answered (equal rows: once).
    """
    rows = settled(codes(vectors, key, vector))
    count = rows.count()
    shards = max(1, -(-count // shard))
    # ranges of ids; a shard is one row group of the exchange below
    placed = settled(rows.repartitionByRange(shards, "id").withColumn("shard", F.spark_partition_id()))
    queries = rows.where(is_query).distinct()
    groups = max(1, -(-queries.count() // query_group))
    grouped = queries.withColumn("group", F.pmod(F.xxhash64("id", "code"), F.lit(groups)).cast("int"))
    sent = grouped.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    sent = sent.withColumn("row", F.xxhash64("id", "code"))
    placed = placed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("query_row", T.LongType()),
                           T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])

    def answer(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if own.empty or asked.empty:
            return pd.DataFrame({f.name: pd.Series(dtype="int64") for f in schema})
        width = max(max(map(len, own["code"])), max(map(len, asked["code"])))
        index = Shard(own["id"].to_numpy(), _matrix(own["code"], width))
        found = index.search(asked["id"].to_numpy(), _matrix(asked["code"], width), k)
        parts = [pd.DataFrame({"query_id": query, "query_row": row, "vec_id": ids, "score": scores})
                 for (query, scores, ids), row in zip(found, asked["row"], strict=True)]
        return pd.concat(parts, ignore_index=True)

    unit = ["shard", "group"]
    found = placed.groupBy(*unit).cogroup(sent.groupBy(*unit)).applyInPandas(answer, schema)
    best = top_rows(found, ["query_id", "query_row"], [F.desc("score"), F.col("vec_id")], k, "rank")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
