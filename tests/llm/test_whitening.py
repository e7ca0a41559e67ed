import math
import random

import numpy as np
import pytest

from clientele.llm import whitening as H

SCHEMA = "vec_id long, embedding array<float>, x long, w string, component int"


def vectors(n=400, d=9):
    rnd = random.Random(4)
    out = [(i, [rnd.gauss(0, 3 - 0.3 * j) for j in range(d)]) for i in range(n)]
    out += [(n + i, out[7][1]) for i in range(n // 2)]  # a third of all rows hold one vector
    out += [(7, out[9][1]), (None, out[3][1]), (n * 3, [0.0] * d), (n * 3 + 1, [-0.0] * d), (n * 3 + 2, [0.5, -0.25]), (n * 3 + 3, [])]
    out += [(n * 3 + 4, None), (n * 3 + 5, [0.1, None]), (n * 3 + 6, [float("nan")] * d), (n * 3 + 7, [float("inf")])]
    return [(*r, 1, "w", 2) for r in out]


def usable(made, d):
    out = []
    for i, v, *_ in made:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            out.append((i, tuple(math.floor(256 * float(np.float32(c))) for c in v) + (0,) * (d - len(v))))
    return out


def test_equals_dense_solution(spark):
    d, made = 9, vectors()
    got = H.whiten(spark.createDataFrame(made, SCHEMA).repartition(5)).collect()
    rows = usable(made, d)
    fit = np.array(sorted({x for _, x in rows}), np.int64)
    n, s = len(fit), fit.sum(axis=0)
    z = fit - s / n
    v = z.T @ z / n
    values, vectors_ = np.linalg.eigh(v)
    values, vectors_ = values[::-1][:4], vectors_[:, ::-1][:, :4]
    vectors_ = vectors_ * np.sign(vectors_[np.abs(vectors_).argmax(axis=0), range(4)])
    want = []
    for i, x in rows:
        deviation = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s, strict=True))
        w = (np.array(x) - s / n) @ vectors_ / np.sqrt(values)
        want += [(-1 if i is None else i, k + 1, n, deviation, round(float(w[k]), 9) + 0.0, round(float(values[k] / np.trace(v)), 12)) for k in range(4)]
    mine = [(-1 if r.vec_id is None else r.vec_id, r.component, r.n, r.deviation, round(r.whitened, 9) + 0.0, round(r.explained, 12)) for r in got]
    assert sorted(mine) == sorted(want)
    assert {type(r.identity_error) for r in got} == {float} and max(r.identity_error for r in got) < 1e-12


@pytest.mark.parametrize("seed", range(24))
def test_eigenpairs_of_awkward_matrices(seed):
    rnd = np.random.default_rng(seed)
    d = int(rnd.integers(1, 30))
    a = rnd.standard_normal((d, d))
    q = np.linalg.qr(a)[0]
    matrix = [a @ a.T, 3.0 * np.eye(d), q @ np.diag(([5.0] * 3 + [1.0] * d)[:d]) @ q.T, a[:, :2] @ a[:, :2].T,
              np.diag(np.arange(d) * 1.0), a @ a.T + np.diag([1e9] + [0.0] * (d - 1))][seed % 6]
    matrix = (matrix + matrix.T) / 2
    exact = np.sort(np.linalg.eigvalsh(matrix))[::-1]
    for shift in (exact[0] + 1, exact.mean() + 1e-3, exact[-1] - 1):
        assert H.above(matrix, shift) == (exact > shift).sum()
    values, vectors_ = H.leading(matrix, 4)
    m = len(values)
    assert m == min(4, d) or exact[m] <= 1e-10 * exact[0]
    assert np.allclose(values, exact[:m], rtol=1e-12, atol=1e-12 * exact[0])
    assert np.abs(vectors_.T @ vectors_ - np.eye(m)).max(initial=0) < 1e-12
    assert np.abs(matrix @ vectors_ - vectors_ * values).max(initial=0) < 1e-11 * np.abs(matrix).sum()


def test_inertia_with_pivots_of_order_two():
    matrix = np.array([[0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 0.0]])
    assert [H.above(matrix, s) for s in (-2.0, -0.5, 0.0, 0.5, 2.0)] == [3, 2, 1, 1, 0]


def test_fewer_dimensions_than_components_and_no_spread(spark):
    line = [(i, [float(i), 2.0 * i], 0, "", 0) for i in range(10)]
    got = H.whiten(spark.createDataFrame(line, SCHEMA)).collect()
    assert len(got) == 10 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    for same in ([], line[:1] * 5, [(1, [], 0, "", 0)] * 2, [(1, None, 0, "", 0)]):
        assert H.whiten(spark.createDataFrame(same, SCHEMA)).collect() == []


def test_what_does_not_fit_is_refused(spark):
    with pytest.raises(Exception, match="too large"):
        H.whiten(spark.createDataFrame([(1, [1e30], 0, "", 0), (2, [1.0], 0, "", 0)], SCHEMA)).collect()
    far = [(i, [float(2**40) * i], 0, "", 0) for i in range(9)]
    with pytest.raises(Exception, match="does not fit"):
        H.whiten(spark.createDataFrame(far, SCHEMA)).collect()
