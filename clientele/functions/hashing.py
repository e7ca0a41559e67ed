"""Seeded hashes that any engine can repeat: splits and resampling weights stay reproducible."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2_147_483_647
LARGEST_DRAW = 12


def _digest(seed: int, *cols: Column | str) -> Column:
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def _hex_slice(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")


def unit_hash(seed: int, *cols: Column | str) -> Column:
    """A number in [0, 1) that depends only on the seed and the values."""
    return _hex_slice(_digest(seed, *cols), 1) / F.lit(4294967296.0)


def replicate_seeds(seed: int, *cols: Column | str) -> tuple[Column, Column]:
    """Two independent integers per row, from which every replicate's draw follows."""
    digest = _digest(seed, *cols)
    return _hex_slice(digest, 1), _hex_slice(digest, 9)


def poisson_one(h1: Column, h2: Column, replicate: Column) -> Column:
    """A Poisson(1) draw for a row in one replicate, by inverting its distribution."""
    # rotate the mix with the square of the replicate, so that draws of two rows do not stay in step
    mixed = F.pmod(
        F.pmod(h1, F.lit(PRIME))
        + replicate * F.pmod(h2, F.lit(PRIME))
        + replicate * replicate * F.pmod(h1 + h2, F.lit(65_521)),
        F.lit(PRIME),
    )
    u = mixed / F.lit(float(PRIME))
    # to the resolution of the draw: a count of 13 or more has less than one part in 2^31
    out, cumulative = F.lit(LARGEST_DRAW), []
    p, total = math.exp(-1.0), 0.0
    for k in range(LARGEST_DRAW):
        total += p
        cumulative.append((k, total))
        p /= k + 1
    for k, limit in reversed(cumulative):
        out = F.when(u < F.lit(limit), F.lit(k)).otherwise(out)
    return out
