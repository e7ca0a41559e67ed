import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientele.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>, score double, shard int"


def vectors(n=300):
    rnd = random.Random(6)
    out = [(i, [rnd.uniform(-1, 1) for _ in range(8)], None, None) for i in range(n)]
    out += [(n, out[3][1], None, None), (n + 1, out[3][1], None, None), (50, out[7][1], None, None)]  # ties and a repeated id
    out += [(100, out[100][1], None, None)]  # a row repeated as it is
    out += [(n + 2, None, None, None), (n + 3, [0.1, None], None, None), (n + 4, [float("nan")] * 8, None, None), (n + 5, [float("inf")], None, None)]
    out += [(n + 6, [], None, None), (n + 7, [0.5, -0.25], None, None), (None, [1.0] * 8, None, None)]
    return out


def brute(made, k, is_query):
    usable = []
    for i, v, *_ in made:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for q, own in sorted({u for u in usable if is_query(u[0])}):
        scored = sorted((-sum(a * b for a, b in zip(own, c)), i) for i, c in usable if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard, block, group", [(1000, 256, 4096), (40, 8, 3), (7, 4, 2)])
def test_equals_brute_force(spark, monkeypatch, shard, block, group):
    monkeypatch.setattr(K, "BLOCK", block)
    monkeypatch.setattr(K.Shard.__init__, "__defaults__", (block,))
    made = vectors()
    df = spark.createDataFrame(made, SCHEMA)
    got = K.search(df, F.col("id") % 50 == 0, shard=shard, query_group=group).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(made, 5, lambda i: i % 50 == 0)


def test_blocks_below_the_bound_are_not_scored():
    ids = np.arange(64)
    forward = np.zeros((64, 4), np.int64)
    forward[:8] = 100
    index = K.Shard(ids, forward, block=8)
    seen = []

    class Spy(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ other

    query = np.full(4, 3)
    scores, found = index.best(-1, query, np.maximum(query, 0) @ index.high.T, 5, forward.view(Spy))
    assert found.tolist() == [0, 1, 2, 3, 4] and scores.tolist() == [1200] * 5
    assert len(seen) == 1


def test_fewer_candidates_than_k_and_empty_table(spark):
    few = spark.createDataFrame([(0, [1.0], None, None), (1, [2.0], None, None)], SCHEMA)
    assert [tuple(r) for r in K.search(few, F.col("id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert K.search(spark.createDataFrame([], SCHEMA), F.col("id") == 0).collect() == []
    assert K.search(few, F.col("id") == 9).collect() == []


def test_scores_that_do_not_fit_are_refused(spark):
    huge = spark.createDataFrame([(0, [1e15], None, None), (1, [1e15], None, None)], SCHEMA)
    with pytest.raises(Exception, match="does not fit"):
        K.search(huge, F.col("id") == 0).collect()
