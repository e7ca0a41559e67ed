"""Hashed neighbours against comparing all: recall, hot buckets, ties and small tables."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from clientele.operators import neighbours as N
from clientele.operators.pairs import nearest

SCHEMA = "id long, v array<double>, label string"


def table(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in v], f"l{i % 3}") for i, v in enumerate(vectors)], SCHEMA)


def test_recall_on_clustered_rows_with_a_hot_bucket(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((60, 16)) * 3
    base = centers[rng.integers(0, 60, 4000)] + rng.standard_normal((4000, 16))
    base[:1300] = centers[0]  # a third of all rows are one vector
    asked = np.vstack([centers[rng.integers(0, 60, 150)] + rng.standard_normal((150, 16)), np.repeat(centers[:1], 50, axis=0)])
    q, b = table(spark, asked, 10_000), table(spark, base)
    index = N.fit(q, b, "id", "v", 5, bucket_rows=64, sample=100)
    buckets = 1 << index.planes.shape[1]
    assert buckets == 64 and index.probes < buckets // 2  # it does not simply look everywhere
    found = N.hashed_nearest(q, b, "id", "v", "label", 5, index, unit_rows=100)
    one = N.recall(found, nearest(q, b, "id", "v", "label", 5)).first()
    assert (one.queries, one.neighbours) == (200, 1000) and one.recall >= 0.9
    same = [tuple(r) for r in found.where("query >= 10150").orderBy("query", "place").select("neighbour", "distance", "place").collect()]
    # among copies the smallest keys win, however the bucket was cut
    assert same == [(i, 0.0, i + 1) for i in range(5)] * 50


def test_all_probes_give_the_exact_neighbours(spark):
    rng = np.random.default_rng(4)
    q, b = table(spark, rng.standard_normal((30, 6)), 1000), table(spark, rng.standard_normal((300, 6)))
    index = N.fit(q, b, "id", "v", 4, bucket_rows=20, recall=1.0)
    every = N.Index(index.planes, index.center, index.flips, len(index.flips))
    columns = ["query", "neighbour", "distance", "carry", "place"]
    got = {tuple(r) for r in N.hashed_nearest(q, b, "id", "v", "label", 4, every, unit_rows=37).select(*columns).collect()}
    assert got == {tuple(r) for r in nearest(q, b, "id", "v", "label", 4).select(*columns).collect()}


def test_rank_is_the_first_probe_that_reaches(spark):
    rng = np.random.default_rng(5)
    index = N.Index(rng.standard_normal((3, 5, 8)), np.zeros(8), N.flip_order(5), 32)
    a, b = rng.standard_normal((40, 8)), rng.standard_normal((40, 8))
    probed, codes = index.probed(a), index.sides(b)[0]
    first = (probed == codes[:, :, None]).argmax(axis=2).min(axis=1)
    assert (index.rank(a, b) == first).all()
    assert all(sorted(p) == list(range(32)) for p in probed[:, 0])


@pytest.mark.parametrize("rows", [0, 1, 3])
def test_small_tables(spark, rows):
    rng = np.random.default_rng(6)
    q, b = table(spark, rng.standard_normal((4, 3)), 50), table(spark, rng.standard_normal((rows, 3)))
    found = N.hashed_nearest(q, b, "id", "v", "label", 5, N.fit(q, b, "id", "v", 5))
    assert found.count() == 4 * rows


def frame(vectors, start=0):
    return pd.DataFrame({"k": np.arange(start, start + len(vectors)), "v": list(vectors), "c": 0})


def peak(work):
    tracemalloc.start()
    work()
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    return most


def test_rows_are_dealt_to_buckets_a_bounded_number_at_a_time():
    rng = np.random.default_rng(7)
    index = N.Index(rng.standard_normal((4, 9, 8)), np.zeros(8), N.flip_order(9), 300)
    rows = frame(rng.standard_normal((500, 8)))
    pieces = list(N.dealt(index.probed, 4 * 300)([rows, rows[:0]]))
    assert max(map(len, pieces)) <= N.SPREAD_ROWS
    out = pd.concat(pieces)
    assert (out["k"].to_numpy() == np.repeat(np.arange(500), 4 * 300)).all()
    assert (out["code"].to_numpy() == index.probed(N._vectors(rows["v"])).ravel()).all()


def test_a_unit_holds_few_distances_at_once():
    rng = np.random.default_rng(8)
    asked, held = frame(rng.standard_normal((4096, 4))), frame(rng.standard_normal((4096, 4)), 10_000)
    assert peak(lambda: N.best(asked, held, 5)) < 100e6  # all distances of the unit alone are 134 MB
    some = asked[:50]
    got = N.best(some, held, 5)
    d = np.round(np.linalg.norm(np.stack(some["v"])[:, None] - np.stack(held["v"])[None], axis=2), 9)
    assert (np.round(got["distance"].to_numpy().reshape(50, 5), 9) == np.sort(d, axis=1)[:, :5]).all()
