import random

import pytest

from clientele.llm import suffixes as S
from tests.llm.data import prose, rows, table


def brute(made, length):
    """Rows in order of their keys; of equal keys the order of the given list."""
    seen, out = set(), []
    for key, text in made:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            piece = raw[i : i + length]
            if piece in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(piece)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((key, bytes(c for c, g in zip(raw, gone) if not g), len(raw), sum(gone), spans))
    return out


def got(spark, made, **kw):
    df = spark.createDataFrame(made, "doc_id long, text string")
    return sorted(((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in S.remove_repeats(df, **kw).collect()), key=str)


def texts(seed):
    rnd = random.Random(seed)
    common = [prose(rnd, 30) for _ in range(6)]
    made = []
    for i in range(60):
        parts = [rnd.choice([prose(rnd, rnd.randint(1, 25)), rnd.choice(common), "ab" * rnd.randint(1, 90), "-" * rnd.randint(1, 150), "é" * rnd.randint(1, 60)])
                 for _ in range(rnd.randint(0, 6))]
        made.append((i, " ".join(parts)))
        if rnd.random() < 0.2:
            made[-1] = (i, rnd.choice(made)[1][rnd.randint(0, 5) :])
    return made


@pytest.mark.parametrize("seed, batches", [(1, 4), (2, 1), (3, 7)])
def test_equals_brute_force(spark, seed, batches):
    made = texts(seed)
    assert got(spark, made, batches=batches) == sorted(brute(made, 100), key=str)


def test_short_repeats_and_dense_alphabet(spark):
    rnd = random.Random(9)
    made = [(i, "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 80)))) for i in range(60)]
    assert got(spark, made, length=14, sample=8, batches=3) == sorted(brute(made, 14), key=str)


def test_awkward_rows(spark):
    made = rows()
    unique = sorted({r[0]: (r[0], r[1]) for r in made if r[0] is not None}.values())
    assert got(spark, unique) == sorted(brute(unique, 100), key=str)
    all_rows = S.remove_repeats(table(spark)).collect()
    assert len(all_rows) == len(made)
    again = got(spark, [(1, "q" * 90 + "r" * 60)] * 3)
    assert [r[3] for r in again] == [0, 150, 150] or sorted(r[3] for r in again) == [0, 150, 150]
    assert got(spark, [(None, "n" * 50 + "m" * 60), (3, "n" * 50 + "m" * 60)])[1][3] + 0 in (0, 110)


def test_empty_table(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, ""), (3, "short")]) == [(1, b"", 0, 0, 0), (2, b"", 0, 0, 0), (3, b"short", 5, 0, 0)]


def test_levels_stay_logarithmic(spark):
    levels = S.Levels()
    for i in range(7):
        levels.insert(spark.createDataFrame([(i, i)], "value long, content long"))
    assert [rank for rank, _ in levels.tables] == [2, 1, 0]
    assert sorted(r.value for _, t in levels.tables for r in t.collect()) == list(range(7))


def test_bad_sample(spark):
    with pytest.raises(ValueError):
        S.remove_repeats(table(spark, []), length=10, sample=10)
