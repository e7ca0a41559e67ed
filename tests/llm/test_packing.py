import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from clientele.llm import packing as P
from tests.llm import data


def naive(lengths, capacity):
    """Rooms left by best-fit decreasing, piece by piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_best_fit_decreasing_piece_by_piece(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([1, 2, 5, 37, 64, 2048])
    lengths = [rnd.choice([rnd.randint(1, capacity), 1, min(3, capacity), capacity]) for _ in range(rnd.randint(0, 200))]
    bins, done = defaultdict(list), Counter()
    for length, first, count, start, each, base in P.plan(Counter(lengths), capacity).tolist():
        assert first == done[length]
        done[length] += count
        for j in range(count):
            bins[start + j // each].append((base + j % each * length, length))
    assert done == Counter(lengths)
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
    assert sorted(capacity - sum(n for _, n in held) for held in bins.values()) == naive(lengths, capacity)


def test_tree_finds_the_tightest_room():
    rnd = random.Random(1)
    rooms, held = P.Rooms(100), Counter()
    for step in range(2000):
        ask = rnd.randint(1, 100)
        fits = [r for r in held if r >= ask and held[r]]
        assert rooms.tightest(ask) == min(fits, default=None)
        if fits and rnd.random() < 0.6:
            rooms.take(min(fits))
            held[min(fits)] -= 1
        else:
            room = rnd.randint(0, 100)
            rooms.add(room, step, 1)
            held[room] += room > 0


def test_words_of_both_ages_and_long_ones(monkeypatch):
    encoder = P.Encoder(P.default_path())
    encoder.words.most = 3
    text = "the of and thing of the weather " + "x" * 500 + " the station's 12 of"
    assert encoder.encode(text) == np.array(encoder.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(encoder.words) <= 3


@pytest.mark.parametrize("capacity", [2048, 7, 1])
def test_whole_table_is_packed(spark, capacity):
    made = data.rows() + [(900, "of " * 5000 + "é 中 <|endoftext|>", None, None, None, None, None, None, None)]
    if capacity == 1:
        made = made[:12]
    df = data.table(spark, made).selectExpr("*", "n as piece", "n as length", "n as offset", "key as ids", "n as part")
    got = P.pack(df, capacity=capacity).collect()
    library = Tokenizer.from_file(P.default_path())
    library.no_truncation()
    want = Counter()
    for i, text, *_ in made:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), capacity):
            want[i, at // capacity, at, tuple(ids[at : at + capacity])] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert all(r.length == len(r.ids) // 4 <= capacity for r in got)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
    rooms = sorted(capacity - sum(n for _, n in spans) for spans in held.values())
    assert rooms == naive([len(k[3]) for k in want.elements()], capacity)


def test_one_length_holds_most_rows_over_many_tasks(spark):
    df = spark.range(0, 6000, 1, 13).selectExpr("id as doc_id", "case when id % 3 = 0 then null else repeat('of ', cast(id % 40 as int)) end as text")
    got = P.pack(df, capacity=50).collect()
    assert len(got) == 6000 and len({(r.sequence_id, r.offset) for r in got}) == 6000
    rooms = Counter()
    for r in got:
        rooms[r.sequence_id] += r.length
    assert sorted(50 - n for n in rooms.values()) == naive([r.length for r in got], 50)


def test_empty_table_and_refused_capacity(spark):
    assert P.pack(data.table(spark, [])).collect() == []
    with pytest.raises(ValueError, match="capacity"):
        P.pack(data.table(spark, []), capacity=0)
