"""Positions, running totals and quantiles that never put one large group into one task.

A plain window over a key sorts the whole key in one task. Here each key is first cut into
ordered pieces (calendar days, or value ranges); the pieces are processed in parallel and a
small table of piece totals supplies what lies before each piece. Results are exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


# drop shuffle files when an execution ends; only around writes that cut the lineage
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, else a folder in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/settled"


def stored(df: DataFrame) -> DataFrame:
    """Written as a Parquet table in the shared work folder, and read from there. It changes no setting, so threads may call it."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """Compute once and keep, as a Parquet table in the shared work folder, what several branches read.

    Compared with a checkpoint of rows the table is columnar and compressed, later reads prune its
    columns, and its real size guides joins. Losing an executor costs nothing that is written, so the
    shuffle files of the run are dropped once the table is there. The table is deleted when the
    session's JVM ends, or earlier by ``dropped``.
    """
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return stored(df)
    finally:
        spark.conf.set(CLEANUP, before)


def dropped(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/settled-" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of the same name, where NULL equals NULL; the left side's keys stay."""
    mine = [f"__right_{k}" for k in keys]
    renamed = right.withColumnsRenamed(dict(zip(keys, mine, strict=True)))
    on = F.lit(True)
    for k, m in zip(keys, mine, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(m))
    joined = left.join(renamed, on, how)
    if how in ("full", "full_outer"):
        joined = joined.withColumns({k: F.coalesce(k, m) for k, m in zip(keys, mine, strict=True)})
    return joined.drop(*mine)


def row_number_in_pieces(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    piece: Column,
    out: str = "rn",
    total: str | None = None,
) -> DataFrame:
    """1-based position of each row within its key; optionally the key's row count.

    ``piece`` must not decrease along the order. Each (key, piece) is numbered on its own and
    shifted by the counts of the key's earlier pieces. NULL is a key, and a piece, like any other.
    """
    pieced = df.withColumn("__piece", piece)
    counts = pieced.groupBy(*keys, "__piece").agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy(*keys).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(
        *keys,
        "__piece",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__shift"),
        F.sum("__n").over(W.partitionBy(*keys)).alias("__total"),
    )
    within = W.partitionBy(*keys, "__piece").orderBy(*order)
    numbered = pieced.withColumn("__rn", F.row_number().over(within))
    numbered = join_keys(numbered, shifts, [*keys, "__piece"])
    result = numbered.withColumn(out, F.col("__rn") + F.col("__shift"))
    if total:
        result = result.withColumn(total, F.col("__total"))
    return result.drop("__piece", "__rn", "__shift", "__total")


def row_number_by_time(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    ties: Sequence[str] = (),
    out: str = "rn",
    total: str | None = None,
) -> DataFrame:
    """Position of each row within its key by time, one calendar day per piece."""
    return row_number_in_pieces(df, keys, [time, *ties], F.to_date(time), out, total)


# A key is cut into as many pieces as its rows fill, up to this number.
MOST_PIECES = 512
PIECE_ROWS = 65_536


def _cuts(df: DataFrame, order: str, keys: Sequence[str], piece_rows: int) -> DataFrame | None:
    """``(keys, __cuts)`` of the keys that fill more than one piece; None if there is no such key.

    Rows are counted first, so quantiles are only estimated for large keys.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    most = sizes.agg(F.max("__rows")).first()[0] or 0
    if most <= piece_rows:
        return None
    if keys:
        rows = join_keys(df.select(*keys, order), sizes.where(F.col("__rows") > piece_rows), keys)
    else:
        rows = df.select(order, F.lit(most).alias("__rows"))
    shares = [i / MOST_PIECES for i in range(1, MOST_PIECES)]
    finest = F.percentile_approx(order, shares, F.lit(20 * MOST_PIECES))
    bounds = rows.groupBy(*keys).agg(finest.alias("__finest"), F.max("__rows").alias("__rows"))
    pieces = F.least(F.ceil(F.col("__rows") / piece_rows), F.lit(MOST_PIECES))
    # of the finest cuts those nearest to equal pieces
    chosen = F.filter("__finest", lambda x, i: F.floor((i + 1) * pieces / MOST_PIECES) > F.floor(i * pieces / MOST_PIECES))
    none = F.array().cast(T.ArrayType(df.schema[order].dataType))
    return bounds.select(*keys, F.coalesce(F.array_distinct(chosen), none).alias("__cuts"))


def with_value_piece(df: DataFrame, order: str, keys: Sequence[str], piece_rows: int = PIECE_ROWS, out: str = "__piece") -> DataFrame:
    """Number the value ranges of each key; keys of at most ``piece_rows`` rows are one piece. ``df`` is read up to three times."""
    cuts = _cuts(df, order, keys, piece_rows)
    if cuts is None:
        return df.withColumn(out, F.lit(0))
    if keys:
        df = join_keys(df, cuts, keys, "left")
        none = F.array().cast(T.ArrayType(df.schema[order].dataType))
        df = df.withColumn("__cuts", F.coalesce("__cuts", none))
    else:
        df = df.withColumn("__cuts", cuts.scalar())
    # a value that is itself a cut gets a piece of its own, so a very frequent value stays alone
    below = F.size(F.filter("__cuts", lambda c: c < F.col(order)))
    piece = 2 * below + F.array_contains("__cuts", F.col(order)).cast("int")
    return df.withColumn(out, piece).drop("__cuts")


def running_totals(
    df: DataFrame,
    order: str,
    sums: dict[str, str],
    keys: Sequence[str] = (),
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Totals of the rows with a smaller ``order`` value, exclusive of the row itself.

    ``df`` has one row per (keys, order). ``sums`` maps an input column to the output prefix:
    ``{"n": "cum"}`` adds ``cum_before`` and ``cum_total``. The input is read three times (cuts,
    piece totals, rows), so it is settled first.
    """
    pieced = with_value_piece(settled(df), order, keys, piece_rows)
    parts = pieced.groupBy(*keys, "__piece").agg(*[F.sum(c).alias(f"__part_{c}") for c in sums])
    scope = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    earlier = scope.orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    shifts = parts.select(
        *keys,
        "__piece",
        *[F.coalesce(F.sum(f"__part_{c}").over(earlier), F.lit(0)).alias(f"__shift_{c}") for c in sums],
        *[F.sum(f"__part_{c}").over(scope).alias(f"{p}_total") for c, p in sums.items()],
    )
    inside = W.partitionBy(*keys, "__piece").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    result = pieced.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__in_{c}") for c in sums])
    result = join_keys(result, shifts, [*keys, "__piece"])
    for c, p in sums.items():
        result = result.withColumn(f"{p}_before", F.col(f"__in_{c}") + F.col(f"__shift_{c}"))
    return result.drop("__piece", *[f"__in_{c}" for c in sums], *[f"__shift_{c}" for c in sums])


def quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    keys: Sequence[str] = (),
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Exact quantiles with linear interpolation, per key or over the whole frame.

    Equal values are merged before the shuffle, and a large key is ranked piece by piece.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    ranked = running_totals(counts, value, {"__n": "__c"}, keys, piece_rows)
    aggs = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("__c_total") - 1)

        def at(rank: Column) -> Column:
            inside = (F.col("__c_before") <= rank) & (rank < F.col("__c_before") + F.col("__n"))
            return F.max(F.when(inside, F.col(value).cast("double")))

        low, high = F.floor(position), F.ceil(position)
        share = F.max(position - low)
        aggs.append((at(low) + (at(high) - at(low)) * share).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def global_row_number(df: DataFrame, order: Sequence[Column | str], out: str = "row_id") -> DataFrame:
    """Dense 1-based numbers over a total order, without a one-task window.

    The sorted rows are settled once, so the per-partition counts and the rows agree even if an
    executor is lost in between; only one count per partition is combined.
    """
    placed = settled(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("__at"), 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__shift"))
    # one row per partition of the sort: bounded by the partition count, not by the data
    numbered = placed.withColumn("__part", part).join(F.broadcast(shifts), "__part")
    offset = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn(out, offset + F.col("__shift") + 1).drop("__at", "__part", "__shift")


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str | None = None) -> DataFrame:
    """First ``n`` rows per key. Spark limits each group before the shuffle, so hot keys stay small."""
    ranked = df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col("__rank") <= n)
    return kept.withColumnRenamed("__rank", out) if out else kept.drop("__rank")
