"""Small pieces the operators share: tables, row batches and the word rule of the contracts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

# what separates words: blank, tab, line feed, vertical tab, form feed, carriage return
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    """The schema with new or replaced fields at its end."""
    names = {n for n, _ in fields}
    kept = [f for f in schema.fields if f.name not in names]
    return T.StructType([*kept, *[T.StructField(n, t) for n, t in fields]])


BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """Let the session send at most ``BATCH_BYTES`` of rows to Python at once, if it would send more.

    Long texts then take little memory beside the heap, whatever number of rows a batch may hold.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH).rstrip("bB")) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function over batches; when a task ends, what it freed goes back to the system.

    Workers outlive their tasks, and what they hold stands beside the executor's heap: tables that refer
    to each other wait for the collector, and freed pages for the next task.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def map_texts(
    df: DataFrame,
    text: str,
    make: Callable[[], Callable[[list], list[tuple]]],
    *fields: tuple[str, T.DataType],
    keep: list[str] | None = None,
    slice_rows: int = 256,
) -> DataFrame:
    """Add columns that a Python function computes from one column, a few hundred rows at a time.

    ``make`` runs once per task and returns a function from a list of values to one tuple of new
    values per row. Small slices keep the memory of a task independent of the batch size.
    ``keep`` are the columns that stay (all by default); a column of a new field's name is replaced.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in {n for n, _ in fields}]
    # a text that stays is sent once
    at_text = kept.index(text) if text in kept else len(kept)
    extra = [] if text in kept else [F.col(f"`{text}`").alias("__text")]
    narrow = small_batches(df).select(*[F.col(f"`{c}`") for c in kept], *extra)
    schema = T.StructType([*narrow.schema.fields[: len(kept)], *[T.StructField(n, t) for n, t in fields]])

    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                rows = work(part.column(at_text).to_pylist())
                new = list(zip(*rows, strict=True)) if rows else [() for _ in fields]
                columns = [part.column(i) for i in range(len(kept))]
                columns += [pa.array(v, type=out.field(n).type) for v, (n, _) in zip(new, fields, strict=True)]
                columns = [c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return narrow.mapInArrow(giving_back(run), schema)


def with_row_key(df: DataFrame, key: str) -> DataFrame:
    """Add ``__h`` and ``__copy``, which with the key tell every row apart.

    ``__h`` hashes all columns; ``__copy`` numbers rows equal in all of them, which are
    interchangeable. If no row repeats, which one count finds, it is 0 and nothing is shuffled.
    """
    hashed = df.withColumn("__h", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    counts = hashed.groupBy(key, "__h").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if (counts or 0) <= 1:
        return hashed.withColumn("__copy", F.lit(0))
    return hashed.withColumn("__copy", F.row_number().over(W.partitionBy(key, "__h").orderBy("__h")))


def without_row_key(df: DataFrame) -> DataFrame:
    return df.drop("__h", "__copy")


def on_row(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Join two tables that carry the same row key; of the right one the other columns stay."""
    named = right.select(F.col(key).alias("__r_key"), F.col("__h").alias("__r_h"), F.col("__copy").alias("__r_copy"),
                         *[c for c in right.columns if c not in {key, "__h", "__copy"}])
    same = F.col(key).eqNullSafe(F.col("__r_key")) & (F.col("__h") == F.col("__r_h")) & (F.col("__copy") == F.col("__r_copy"))
    return left.join(named, same, how).drop("__r_key", "__r_h", "__r_copy")


def packed(columns: list[str]) -> list[Column]:
    """Columns that only pass through, as one struct, so that their names clash with no inner one."""
    return [F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__also")] if columns else []


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col("__also").getField(c).alias(c) for c in columns]


SMALL_ROWS = 1_000_000  # narrow rows up to which a table is broadcast; larger ones are shuffled


def small(df: DataFrame) -> DataFrame:
    """A settled narrow table with the hint to broadcast it, if a count finds few rows."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex_digest(text: Column) -> Column:
    """Lowercase SHA-256 of a string's UTF-8 bytes or of binary data."""
    return F.sha2(text, 256)
