"""Document fingerprints by one-permutation MinHash.

All word shingles are hashed once; the leading bits of a hash name its bin, and each bin keeps its
smallest hash. An empty bin borrows from a filled one by optimal densification: every bin has a random
probing order of its own over all bins, equal for all texts, and takes the first filled one. Of each
bin only the low-order bits are kept, packed as hexadecimal text. Two fingerprints' share of equal
bins, corrected for bins that are equal by chance, estimates the Jaccard similarity of their shingles.

Everything is DataFrame expressions: hashes are sorted as one array, in which the bins lie side by
side and begin with their smallest hash.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH = 5
BIN_BITS = 7  # 128 bins: a standard error of about 0.04 at one half
LOW_BITS = 8
GROUP = 512  # documents that are sorted together to find each one's neighbour
MOST_GROUPS = 1 << 16


def with_fingerprint(df: DataFrame, text: str, out: str, width: int = WIDTH) -> DataFrame:
    """All columns of ``df`` plus ``out``; texts without words, and null, get the empty string.

    Letters are lower-cased; fewer than ``width`` words make one shingle. Steps are columns of their
    own, so that no array is computed twice.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    step = df.withColumn("__w", F.transform(words, lambda w: F.xxhash64(w)))
    last = F.size("__w") - width
    full = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get("__w", i + j) for j in range(width)]))
    some = F.when(last >= 0, full).when(F.size("__w") > 0, F.array(F.xxhash64("__w"))).otherwise(F.array().cast("array<bigint>"))
    step = step.withColumn("__h", F.sort_array(some)).drop("__w")
    bin_of = lambda h: F.shiftright(h, 64 - BIN_BITS)
    begins = F.filter("__h", lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get("__h", i - 1))))
    step = step.withColumn("__f", begins).drop("__h")
    step = step.withColumn("__b", F.transform("__f", bin_of))
    half = 1 << (BIN_BITS - 1)

    def value(j: Column) -> Column:
        own = F.array_position("__b", j.cast("bigint"))
        probed = F.array_min(F.transform("__f", lambda h: F.struct(F.xxhash64(j, bin_of(h)).alias("turn"), h.alias("h"))))
        chosen = F.when(own > 0, F.get("__f", (own - 1).cast("int"))).otherwise(probed["h"])
        return F.lpad(F.lower(F.hex(chosen.bitwiseAND(F.lit((1 << LOW_BITS) - 1)))), LOW_BITS // 4, "0")

    made = F.array_join(F.transform(F.sequence(F.lit(-half), F.lit(half - 1)), value), "")
    return step.withColumn(out, F.when(F.size("__f") > 0, made).otherwise(F.lit(""))).drop("__f", "__b")


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two fingerprints, 0 to 1; two empty ones are alike, one empty one is not."""
    digits = LOW_BITS // 4
    bins = 1 << BIN_BITS
    places = F.sequence(F.lit(0), F.lit(bins - 1))
    equal = F.size(F.filter(places, lambda i: F.substr(a, i * digits + 1, F.lit(digits)) == F.substr(b, i * digits + 1, F.lit(digits))))
    chance = 2.0**-LOW_BITS
    share = F.greatest((equal / F.lit(float(bins)) - chance) / (1 - chance), F.lit(0.0))
    return F.when((a == "") & (b == ""), F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(share)


def with_next(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Add ``next_<column>``: the values of the next row by descending key; after the last row comes the first.

    Rows are cut into groups between quantiles of the key, and the row at each upper end is also sent
    to the group above as its last neighbour, so every row moves once. Null keys come last, equal keys
    are ordered by a hash of the columns.
    """
    low = -(1 << 63)
    keyed = df.withColumn("__key", F.coalesce(F.col(key).cast("long"), F.lit(low)))
    count = df.count()
    groups = max(1, min(MOST_GROUPS, count // GROUP))
    shares = [i / groups for i in range(1, groups)] or [0.5]
    found = keyed.agg(F.percentile_approx("__key", shares, F.lit(20 * groups)).alias("q"), F.max("__key").alias("m")).first()
    ends = sorted({*(found["q"] or []), *([found["m"]] if count else [])})
    bounds = F.from_json(F.lit(json.dumps(ends)), "array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(ends).bit_length(), -1, -1)])
    # how many upper ends lie below the key, by halving steps
    group = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(F.get(bounds, at + s - 1) < F.col("__key"), F.lit(False)), at + s).otherwise(at))
    placed = keyed.withColumn("__g", group)
    n = max(1, len(ends))
    own = F.struct(F.col("__g").alias("g"), F.lit(False).alias("guest"))
    above = F.struct(F.pmod(F.col("__g") + 1, F.lit(n)).alias("g"), F.lit(True).alias("guest"))
    is_end = F.get(bounds, F.col("__g")) == F.col("__key")
    sent = placed.withColumn("__to", F.explode(F.when(is_end, F.array(own, above)).otherwise(F.array(own))))
    sent = sent.withColumn("__group", F.col("__to.g")).withColumn("__guest", F.col("__to.guest")).drop("__to", "__g")
    order = W.partitionBy("__group").orderBy("__guest", F.desc("__key"), F.xxhash64(*columns), *columns)
    named = sent.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return named.where(~F.col("__guest")).drop("__group", "__guest", "__key")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next)`` of every row.

    The edited text has its last third (rounded down) replaced by as many first characters of the next
    row's text, or all it has. Null texts are empty; a single row is its own neighbour; rows with equal
    keys follow one another; an empty table gives no rows.
    """
    docs = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    near = with_next(with_fingerprint(docs, "text", "fingerprint"), key, ["text", "fingerprint"])
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    changed = near.select(key, n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    both = with_fingerprint(changed, "edited", "edited_fingerprint")
    return both.select(key, "n_chars", "edited", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
