"""Embedding whitening by spectrum slicing.

The leading eigenpairs of the covariance are found one by one. The inertia of V - s I, read from its
LDLᵀ factors, counts the eigenvalues above s; bisecting s by these counts isolates each leading
eigenvalue. Rayleigh quotient iteration, which converges cubically, then gives the pair, and two more
counts, just above and just below it, certify its number.

Spark makes the fit list (each distinct vector once), its sums and its centred products, and projects
every row; partial sums of a task are one matrix. The driver holds one covariance of ``width`` x
``width`` numbers, so the width is bounded (``LARGEST_WIDTH``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientele.llm.common import small_batches
from clientele.operators.ordering import settled

SCALE = 256
COMPONENTS = 4
LARGEST_WIDTH = 4096
LARGEST_CODE = float(1 << 53)
EPS = float(np.finfo(float).eps)
BUNCH_KAUFMAN = (1 + 17**0.5) / 8  # fixed value: bounds the growth of pivots of order 1 and 2


# ---------------------------------------------------------------- eigenpairs


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are greater than ``shift``.

    By Sylvester's law they are the positive ones of D in L D Lᵀ = matrix - shift I. Pivots of order 1
    or 2 are chosen after Bunch and Kaufman; one of order 2 has one eigenvalue of either sign.
    """
    a = matrix - shift * np.eye(len(matrix))
    positive = k = 0
    while k < len(a):
        own, below = abs(a[k, k]), np.abs(a[k + 1 :, k])
        far = float(below.max(initial=0.0))
        if max(own, far) == 0:
            k += 1
            continue
        order, other = 1, k
        if own < BUNCH_KAUFMAN * far:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            widest = float(row.max())
            if own * widest < BUNCH_KAUFMAN * far * far:
                order, other = (1, r) if abs(a[r, r]) >= BUNCH_KAUFMAN * widest else (2, r)
        to = k + order - 1
        if other != to:
            a[[to, other]] = a[[other, to]]
            a[:, [to, other]] = a[:, [other, to]]
        pivot, column = a[k : k + order, k : k + order], a[k + order :, k : k + order]
        if order == 1:
            positive += int(pivot[0, 0] > 0)
            a[k + 1 :, k + 1 :] -= column @ column.T / pivot[0, 0]
        else:
            positive += 1
            a[k + 2 :, k + 2 :] -= column @ np.linalg.solve(pivot, column.T)
        k += order
    return positive


class Spectrum:
    """Leading eigenpairs of a symmetric matrix, numbered from 1 by falling eigenvalue."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.width = matrix, len(matrix)
        radius = np.abs(matrix).sum(axis=1)
        self.norm = float(radius.max(initial=0.0))
        self.tiny = 4 * EPS * self.norm * max(1, self.width)
        self.counts: dict[float, int] = {-self.norm - self.tiny - 1e-300: self.width, self.norm + self.tiny + 1e-300: 0}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = above(self.matrix, shift)
        return self.counts[shift]

    def bracket(self, number: int) -> tuple[float, float]:
        """The nearest shifts counted so far between which eigenvalue ``number`` lies."""
        return (max(s for s, n in self.counts.items() if n >= number), min(s for s, n in self.counts.items() if n < number))

    def halve(self, low: float, high: float, number: int) -> tuple[float, float]:
        self.above((low + high) / 2)
        return self.bracket(number)

    def isolate(self, number: int) -> tuple[float, float, bool]:
        """An interval that holds eigenvalue ``number`` alone, or, if its neighbours cannot be told apart, a tiny one."""
        low, high = self.bracket(number)
        while self.above(low) != number or self.above(high) != number - 1:
            if high - low <= self.tiny:
                return low, high, False
            low, high = self.halve(low, high, number)
        return low, high, True

    def _apart(self, y: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):
            for v in found:
                y = y - (v @ y) * v
        return y / np.linalg.norm(y)

    def _solved(self, shift: float, y: np.ndarray) -> np.ndarray:
        while True:
            try:
                return np.linalg.solve(self.matrix - shift * np.eye(self.width), y)
            except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
                shift += max(self.tiny, 1e-300)

    def pair(self, number: int, found: list[np.ndarray]) -> tuple[float, np.ndarray]:
        """Eigenvalue ``number`` and its unit vector, orthogonal to those found before; its largest entry is positive."""
        low, high, alone = self.isolate(number)
        start = np.random.default_rng(number).standard_normal(self.width)
        while True:
            shift, best = (low + high) / 2, None
            y = self._apart(start, found)
            for _ in range(30):
                y = self._apart(self._solved(shift, y), found)
                value = float(y @ self.matrix @ y)
                away = float(np.linalg.norm(self.matrix @ y - value * y))
                if best is None or away < best[0]:
                    best = away, value, y
                elif best[0] <= self.tiny:
                    break
                shift = value if alone and low < value < high else (low + high) / 2
            away, value, y = best
            near = max(2 * away, self.tiny)
            if away <= 64 * self.tiny and self.above(value + near) < number <= self.above(value - near):
                return value, y * np.sign(y[np.abs(y).argmax()])
            # the iteration went to a neighbour outside: a smaller interval keeps it in
            if high - low <= self.tiny:
                raise ArithmeticError(f"eigenvalue {number} could not be certified")
            low, high = self.halve(low, high, number)


def leading(matrix: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``components`` eigenvalues above rounding, by falling value, and their vectors as columns."""
    spectrum = Spectrum(matrix)
    values, vectors = [], []
    for number in range(1, min(components, len(matrix)) + 1):
        if spectrum.norm == 0:
            break
        value, vector = spectrum.pair(number, vectors)
        if value <= spectrum.tiny:
            break
        values.append(value)
        vectors.append(vector)
    return np.array(values), np.array(vectors).reshape(len(vectors), len(matrix)).T


# ---------------------------------------------------------------- sums over rows


def codes(rows: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``(key, x)``: floor(scale * c) of every component; rows with anything null or not finite are left out."""
    whole = F.col(f"`{vector}`").cast("array<double>")
    usable = F.col(f"`{vector}`").isNotNull() & F.forall(whole, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    code = lambda c: F.when(F.abs(c * scale) < LARGEST_CODE, F.floor(c * scale)).otherwise(
        F.raise_error(F.lit("a component is too large for a 64-bit code")).cast("long"))
    return rows.where(usable).select(F.col(f"`{key}`").alias("key"), F.transform(whole, code).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of codes; shorter ones end in zeros."""
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _summed(fit: DataFrame, width: int, shape: tuple[int, ...], of: Callable[[np.ndarray], np.ndarray], kind: type) -> np.ndarray:
    """The sum over all rows of ``of(rows of a batch)``: one partial array per task, added up by Spark."""
    number, arrow = ("long", pa.int64()) if kind is np.int64 else ("double", pa.float64())
    size = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), width)
                if kind is np.int64 and float(np.abs(x).max()) * len(x) + float(np.abs(total).max()) >= 2.0**62:
                    raise OverflowError("a sum of codes does not fit into a long")
                total += of(x)
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(flat, type=arrow)], names=["at", "part"])

    parts = small_batches(fit).select("x").mapInArrow(run, f"at long, part {number}")
    out = np.zeros(size, kind)
    for r in parts.groupBy("at").agg(F.sum("part").alias("total")).collect():
        out[r["at"]] = r["total"]
    return out.reshape(shape)


# ---------------------------------------------------------------- the operator

RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)``: one row per usable row and component.

    Vectors become codes floor(scale * c); rows whose vector is null or holds null or non-finite
    components are dropped. The fit list is each distinct code vector once: ``n`` of them, with sums S.
    The covariance divides by n and is centred before it is multiplied. ``whitened`` is the projection of
    x - S / n on a unit eigenvector over the root of its eigenvalue; ``explained`` that eigenvalue over the
    trace; ``deviation`` the exact sum of (n x - S)²; ``identity_error`` the largest entry of the fit list's
    whitened covariance minus the identity.

    Repeated rows and null keys are returned like any other; shorter vectors end in zeros. Components
    whose eigenvalue is not above rounding cannot be whitened and give no rows: there are fewer than
    ``components`` if the fit list spans fewer dimensions, and no row at all if it holds one vector or
    none. Tied eigenvalues get orthogonal vectors of their common space. Columns beside key and vector
    are not read. Codes of 2^53 or more, a deviation beyond 64 bits and vectors wider than
    ``LARGEST_WIDTH`` are refused aloud.
    """
    kept = settled(codes(rows, key, vector, scale))
    schema = T.StructType([T.StructField(key, kept.schema["key"].dataType), *T._parse_datatype_string(RESULT).fields])
    width = kept.agg(F.max(F.size("x"))).first()[0] or 0
    if width > LARGEST_WIDTH:
        raise ValueError(f"vectors of {width} components are wider than {LARGEST_WIDTH}")
    # vectors that differ in trailing zeros only are one vector
    same = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    fit = settled(kept.select(same.alias("x")).distinct())
    n = fit.count()
    if width == 0 or n < 2:
        return rows.sparkSession.createDataFrame([], schema)
    sums = _summed(fit, width, (width,), lambda x: x.sum(axis=0), np.int64)
    mean = sums / n

    def products(x: np.ndarray) -> np.ndarray:
        z = x - mean
        return z.T @ z

    covariance = _summed(fit, width, (width, width), products, np.float64) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = leading(covariance, components)
    if not len(values):
        return rows.sparkSession.createDataFrame([], schema)
    explained = values / np.trace(covariance)
    projection = vectors / np.sqrt(values)
    k = len(values)

    def whitened_products(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ projection
        return w.T @ w

    error = float(np.abs(_summed(fit, width, (k, k), whitened_products, np.float64) / n - np.eye(k)).max())
    ints = sums.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            w = (x - mean) @ projection
            far = float(n) * float(np.abs(x).max(initial=0)) + float(np.abs(sums).max())
            if far * far * width < 2.0**62:
                deviation = ((n * x - sums) ** 2).sum(axis=1)
            else:
                exact = [sum((n * c - s) ** 2 for c, s in zip(row, ints, strict=True)) for row in x.tolist()]
                if max(exact, default=0) >= 1 << 63:
                    raise OverflowError("a deviation does not fit into a long")
                deviation = np.array(exact, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(x) + 1, k), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), lists], names=["key", "deviation", "w"])

    made = T.StructType([kept.schema["key"], T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    each = small_batches(kept).mapInArrow(run, made).select("key", "deviation", F.posexplode("w").alias("at", "whitened"))
    share = F.element_at(F.array(*[F.lit(float(e)) for e in explained]), F.col("at") + 1)
    return each.select(F.col("key").alias(key), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
                       "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
