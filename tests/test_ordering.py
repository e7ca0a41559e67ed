import random

import numpy as np
from tests.conftest import ts

from clientele.operators import metrics as M
from clientele.operators import ordering as O
from clientele.operators import pairs as P
from clientele.operators import sessions as N


def skewed(n=600, seed=1):
    """One key holds two thirds of the rows and one value a third of them."""
    rng = random.Random(seed)
    return [("hot" if i % 3 else f"k{i % 7}", 5.0 if i % 3 == 1 else round(rng.uniform(0, 10), 1), i) for i in range(n)]


def test_row_numbers_match_a_plain_sort(spark):
    rows = [(k, ts(f"2024-01-{1 + i % 20:02d}T{i % 24:02d}:00:00"), i) for k, _, i in skewed()]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, i int")
    got = {r.i: (r.rn, r.n) for r in O.row_number_by_time(df, ["k"], "t", ["i"], total="n").collect()}
    for key in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == key], key=lambda r: (r[1], r[2]))
        for place, r in enumerate(mine, 1):
            assert got[r[2]] == (place, len(mine))


def test_quantiles_match_numpy_under_skew(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, v double, i int")
    got = {r.k: (r.a, r.b, r.c) for r in O.quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.99}, ["k"], piece_rows=40).collect()}
    for key in {r[0] for r in rows}:
        values = [r[1] for r in rows if r[0] == key]
        assert np.allclose(got[key], np.percentile(values, [25, 50, 99]))
    whole = O.quantiles(df, "v", {"m": 0.5}, piece_rows=40).first().m
    assert abs(whole - np.median([r[1] for r in rows])) < 1e-9


def test_a_large_key_is_cut_into_pieces(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=20_000), np.full(10_000, 0.25)])
    df = spark.createDataFrame([("hot", float(v)) for v in values] + [("small", 1.0), ("small", 3.0)], "k string, v double")
    pieced = O.with_value_piece(df.distinct(), "v", ["k"], 8)
    assert pieced.where("k = 'hot'").select("__piece").distinct().count() > 8
    assert pieced.where("k = 'small'").select("__piece").distinct().count() == 1
    got = {r.k: (r.a, r.b) for r in O.quantiles(df, "v", {"a": 0.5, "b": 0.95}, ["k"], piece_rows=40).collect()}
    assert np.allclose(got["hot"], np.percentile(values, [50, 95])) and np.allclose(got["small"], [2.0, 2.9])


def test_running_totals(spark):
    values = sorted({r[1] for r in skewed()})
    df = spark.createDataFrame([(v, 2) for v in values], "v double, n int")
    rows = O.running_totals(df, "v", {"n": "c"}, piece_rows=40).collect()
    assert {r.v: r.c_before for r in rows} == {v: 2 * i for i, v in enumerate(values)}
    assert {r.c_total for r in rows} == {2 * len(values)}


def test_global_numbers_are_dense(spark):
    df = spark.range(1000).selectExpr("pmod(id * 7919, 1000) as v").repartition(5)
    rows = O.global_row_number(df, ["v"]).collect()
    assert sorted((r.row_id, r.v) for r in rows) == [(i + 1, i) for i in range(1000)]


def test_kendall_and_spearman(spark):
    rng = random.Random(3)
    pts = [(float(rng.choice([1, 1, 1, rng.randrange(40)])), float(rng.randrange(30))) for _ in range(900)]
    df = spark.createDataFrame(pts, "x double, y double")
    x, y = np.array(pts).T
    s = np.sign(x[:, None] - x[None]) * np.sign(y[:, None] - y[None])
    n = len(x) * (len(x) - 1) / 2
    tx = sum(c * (c - 1) / 2 for c in np.unique(x, return_counts=True)[1])
    ty = sum(c * (c - 1) / 2 for c in np.unique(y, return_counts=True)[1])
    expected = s.sum() / 2 / np.sqrt((n - tx) * (n - ty))
    assert abs(M.kendall(df, "x", "y", piece_rows=20).first().kendall - expected) < 1e-9

    def ranks(v):
        order = np.sort(v)
        return (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2

    assert abs(M.spearman(df, "x", "y").first().spearman - np.corrcoef(ranks(x), ranks(y))[0, 1]) < 1e-9


def test_net_by_halves_equals_all_pairs():
    rng = np.random.default_rng(0)
    for n, groups in ((5000, 50), (3000, 3), (1500, 1)):
        g, y, w = rng.integers(0, groups, n).astype(float), rng.integers(0, 9, n).astype(float), rng.integers(1, 4, n).astype(float)
        brute = float((np.sign(g[:, None] - g[None]) * np.sign(y[:, None] - y[None]) * w[:, None] * w[None]).sum() / 2)
        assert abs(P._net(g, y, w) - brute) < 1e-6


def test_session_gaps(spark):
    times = ["2024-01-01T23:30:00", "2024-01-02T00:00:00", "2024-01-02T00:30:01", "2024-01-02T00:30:01", "2024-01-02T03:00:00"]
    df = spark.createDataFrame([("u", ts(t), i) for i, t in enumerate(times)], "user_id string, event_timestamp timestamp_ntz, i int")
    got = [r.session_id for r in N.sessionise(df).orderBy("i").collect()]
    # exactly 1800 s stays, 1801 s opens the next
    assert got == ["u_S0000", "u_S0000", "u_S0001", "u_S0001", "u_S0002"]


def test_block_statistics_match_brute_force(spark):
    rng = np.random.default_rng(5)
    vec = rng.normal(size=(60, 4))
    labels = [0 if i % 3 else i % 4 for i in range(60)]
    df = spark.createDataFrame([(i, [float(x) for x in v], labels[i]) for i, v in enumerate(vec)], "id bigint, v array<double>, y int")
    u = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    d = np.sqrt(np.maximum(((u[:, None] - u[None]) ** 2).sum(-1), 0))
    sums = P.kernel_sums(df, "id", "v", block_rows=16).first()
    assert sums.pairs == 3600 and abs(sums.kernel - np.exp(-2 * d**2).sum()) < 1e-6 and abs(sums.distance - d.sum()) < 1e-4
    got = {(r.a, r.b): (r.total, r.n) for r in P.label_distances(df, "id", "v", "y", block_rows=16).collect()}
    for a in set(labels):
        for b in set(labels):
            if a > b:
                continue
            pairs = [d[i, j] for i in range(60) for j in range(i) if sorted((labels[i], labels[j])) == [a, b]]
            total, n = got.get((str(a), str(b)), (0.0, 0.0))
            assert n == len(pairs) and abs(total - sum(pairs)) < 1e-4
    near = P.nearest(df.where("id < 10"), df.where("id >= 10"), "id", "v", "y", 3, block_rows=16).collect()
    plain = np.sqrt(((vec[:, None] - vec[None]) ** 2).sum(-1))
    for q in range(10):
        expected = sorted(range(10, 60), key=lambda j: (round(plain[q, j], 12), j))[:3]
        assert [r.neighbour for r in sorted((r for r in near if r.query == q), key=lambda r: r.place)] == expected


def test_uniformity_reads_every_row_in_cells(spark):
    import numpy as np

    from clientele.functions.hashing import unit_hash
    from clientele.operators import embeddings as E

    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "id long, v array<double>")
    cells = {r.id: int(r.u * 6) for r in df.select("id", unit_hash(42, "id").alias("u")).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    d = [((u[i] - u[j]) ** 2).sum() for i in range(60) for j in range(60) if cells[i] == cells[j]]
    got = E.uniformity(df, "id", "v", cell_rows=10).first()
    assert abs(got.uniformity_loss - np.log(np.mean(np.exp(-2 * np.array(d))))) < 1e-6
    assert abs(got.avg_pairwise_distance - np.mean(np.sqrt(d))) < 1e-6
