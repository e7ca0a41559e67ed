"""Statistics over all pairs of rows without emitting a pair.

Rows are cut into blocks; a task compares two blocks as matrices and returns a few partial sums.
Block membership follows a hash, so a frequent label does not make a large block. The work is
quadratic by definition; the shuffle carries each row once per block of partners.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.operators.ordering import PIECE_ROWS, settled, top_rows, with_value_piece

BLOCK_ROWS = 2048


def _blocks(n_rows: int, block_rows: int) -> int:
    return max(1, -(-n_rows // block_rows))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def block_pairs(df: DataFrame, key: str, blocks: int, symmetric: bool = True) -> DataFrame:
    """Rows placed in every block pair they take part in, as ``(left, right, side)``."""
    home = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    placed = df.withColumn("__b", home)
    as_left = placed.withColumn("right", F.explode(F.sequence(F.col("__b") if symmetric else F.lit(0), F.lit(blocks - 1))))
    as_left = as_left.withColumns({"left": F.col("__b"), "side": F.lit(0)})
    as_right = placed.withColumn("left", F.explode(F.sequence(F.lit(0), F.col("__b") if symmetric else F.lit(blocks - 1))))
    as_right = as_right.withColumns({"right": F.col("__b"), "side": F.lit(1)})
    return as_left.unionByName(as_right).drop("__b")


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-10)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def kernel_sums(vectors: DataFrame, key: str, vector: str, temperature: float = 2.0, block_rows: int = BLOCK_ROWS,
                cell: Column | None = None, cell_rows: int | None = None) -> DataFrame:
    """Sums over ordered pairs, self pairs included: Gaussian kernel, distance, and their number.

    All pairs by default; with ``cell`` only those of one cell, which holds about ``cell_rows`` rows.
    """
    n = cell_rows if cell_rows else vectors.count()
    cell = F.lit(0) if cell is None else cell
    paired = block_pairs(vectors.select(key, vector, cell.alias("__cell")), key, _blocks(n, block_rows))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        a = unit_rows(_matrix(pdf.loc[pdf["side"] == 0, vector]).astype(float))
        b = unit_rows(_matrix(pdf.loc[pdf["side"] == 1, vector]).astype(float))
        if not len(a) or not len(b):
            return pd.DataFrame({"kernel": [0.0], "distance": [0.0], "pairs": [0.0]})
        d = squared_distances(a, b)
        if int(pdf["left"].iloc[0]) == int(pdf["right"].iloc[0]):
            np.fill_diagonal(d, 0.0) if (pdf.loc[pdf["side"] == 0, key].to_numpy() == pdf.loc[pdf["side"] == 1, key].to_numpy()).all() else None
            times = 1.0
        else:
            times = 2.0
        return pd.DataFrame({"kernel": [times * np.exp(-temperature * d).sum()], "distance": [times * np.sqrt(d).sum()], "pairs": [times * d.size]})

    parts = paired.groupBy("__cell", "left", "right").applyInPandas(work, "kernel double, distance double, pairs double")
    return parts.agg(F.sum("kernel").alias("kernel"), F.sum("distance").alias("distance"), F.sum("pairs").alias("pairs"))


def label_distances(vectors: DataFrame, key: str, vector: str, label: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sum and number of distances between unit vectors per pair of labels, each unordered pair once."""
    n = vectors.count()
    paired = block_pairs(vectors.select(key, vector, label), key, _blocks(n, block_rows))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "total": [], "n": []}).astype({"a": str, "b": str})
        d = np.sqrt(squared_distances(unit_rows(_matrix(left[vector]).astype(float)), unit_rows(_matrix(right[vector]).astype(float))))
        keep = np.ones_like(d, dtype=bool)
        if int(left["left"].iloc[0]) == int(left["right"].iloc[0]):
            keep = left[key].to_numpy()[:, None] < right[key].to_numpy()[None, :]
        ca, la = pd.factorize(left[label].astype(str))
        cb, lb = pd.factorize(right[label].astype(str))
        ia, ib = np.eye(len(la))[ca], np.eye(len(lb))[cb]
        totals, counts = ia.T @ (d * keep) @ ib, ia.T @ keep.astype(float) @ ib
        grid = [(x, y) if x <= y else (y, x) for x in la for y in lb]
        return pd.DataFrame({"a": [g[0] for g in grid], "b": [g[1] for g in grid], "total": totals.ravel(), "n": counts.ravel()})

    parts = paired.groupBy("left", "right").applyInPandas(work, "a string, b string, total double, n double")
    return parts.groupBy("a", "b").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def nearest(queries: DataFrame, base: DataFrame, key: str, vector: str, carry: str, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest base rows of each query row: ``(key, neighbour, distance, carry)``.

    Each block pair returns its k best per query; the final choice is made among those. Equal
    distances are settled by the neighbour's key.
    """
    blocks_q, blocks_b = _blocks(queries.count(), block_rows), _blocks(base.count(), block_rows)
    q = queries.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.lit(None).cast(base.schema[carry].dataType).alias("c"), F.lit(0).alias("side"))
    q = q.withColumn("left", F.pmod(F.xxhash64("k"), F.lit(blocks_q)).cast("int")).withColumn("right", F.explode(F.sequence(F.lit(0), F.lit(blocks_b - 1))))
    b = base.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.col(carry).alias("c"), F.lit(1).alias("side"))
    b = b.withColumn("right", F.pmod(F.xxhash64("k"), F.lit(blocks_b)).cast("int")).withColumn("left", F.explode(F.sequence(F.lit(0), F.lit(blocks_q - 1))))
    both = q.unionByName(b)
    key_type = queries.schema[key].dataType.simpleString()
    carry_type = base.schema[carry].dataType.simpleString()

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf[pdf["side"] == 0]
        right = pdf[pdf["side"] == 1].sort_values("k")
        if left.empty or right.empty:
            return pd.DataFrame({"query": left["k"][:0], "neighbour": right["k"][:0], "distance": [], "carry": right["c"][:0]})
        d = np.sqrt(squared_distances(_matrix(left["v"]).astype(float), _matrix(right["v"]).astype(float)))
        top = np.argsort(np.round(d, 12), axis=1, kind="stable")[:, :k]
        at = np.repeat(np.arange(len(left)), top.shape[1])
        flat = top.ravel()
        return pd.DataFrame({"query": left["k"].to_numpy()[at], "neighbour": right["k"].to_numpy()[flat],
                             "distance": np.round(d[at, flat], 12), "carry": right["c"].to_numpy()[flat]})

    found = both.groupBy("left", "right").applyInPandas(
        work, f"query {key_type}, neighbour {key_type}, distance double, carry {carry_type}"
    )
    return top_rows(found, ["query"], [F.col("distance"), F.col("neighbour")], k, out="place")


# ---------------------------------------------------------------- rank agreement


def _net(g: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Weighted concordant minus discordant pairs whose ``g`` differs, by halving the sorted groups."""
    order = np.argsort(g, kind="stable")
    g, y, w = g[order], y[order], w[order]
    total, work = 0.0, [(0, len(g))]
    while work:
        lo, hi = work.pop()
        if hi - lo < 2 or g[lo] == g[hi - 1]:
            continue
        if hi - lo <= 512:
            s = np.sign(g[lo:hi, None] - g[None, lo:hi]) * np.sign(y[lo:hi, None] - y[None, lo:hi])
            total += float(w[lo:hi] @ s @ w[lo:hi]) / 2
            continue
        mid = int(np.searchsorted(g[lo:hi], g[(lo + hi) // 2], "left")) + lo
        if mid == lo:
            mid = int(np.searchsorted(g[lo:hi], g[lo], "right")) + lo
        left = np.argsort(y[lo:mid], kind="stable") + lo
        sums = np.concatenate([[0.0], np.cumsum(w[left])])
        below = sums[np.searchsorted(y[left], y[mid:hi], "left")]
        above = sums[-1] - sums[np.searchsorted(y[left], y[mid:hi], "right")]
        total += float((w[mid:hi] * (below - above)).sum())
        work += [(lo, mid), (mid, hi)]
    return total


def concordance(points: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Concordant minus discordant pairs of weighted points ``(x, y, w)``, as one row ``net``."""
    gridded = with_value_piece(settled(points), "x", (), piece_rows).withColumnRenamed("__piece", "bx")
    gridded = with_value_piece(gridded, "y", (), piece_rows).withColumnRenamed("__piece", "by")

    # pairs in different grid columns and rows: at most the square of the piece limit in cells
    cells = gridded.groupBy("bx", "by").agg(F.sum("w").alias("w"))

    def net_by(group: str, value: str):
        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            net = _net(pdf[group].to_numpy(float), pdf[value].to_numpy(float), pdf["w"].to_numpy(float))
            return pd.DataFrame({"net": [net]})

        return work

    # a column (row) that holds a single x (y) value has only tied pairs and is left out
    spread_x = gridded.groupBy("bx").agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a < b").select("bx")
    spread_y = gridded.groupBy("by").agg(F.min("y").alias("a"), F.max("y").alias("b")).where("a < b").select("by")
    parts = cells.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(net_by("bx", "by"), "net double")
    columns = gridded.join(spread_x, "bx", "left_semi").groupBy("bx")
    rows = gridded.join(spread_y, "by", "left_semi").groupBy("by")
    parts = parts.unionByName(columns.applyInPandas(net_by("x", "y"), "net double"))
    parts = parts.unionByName(rows.applyInPandas(net_by("bx", "y"), "net double"))
    return parts.agg(F.coalesce(F.sum("net"), F.lit(0.0)).alias("net"))
