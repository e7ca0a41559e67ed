import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from clientele.llm import queries as Q
from clientele.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string, n_convs string"


def conversations(seed=3, n=60):
    rnd = random.Random(seed)
    out = []
    for c in range(n):
        start = [("user", "hello"), ("assistant", "hi")] if c % 3 else [("system", f"rules {c % 2}")]
        turns = start + [(rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b", "é", None, ""])) for _ in range(rnd.randint(0, 6))]
        out += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    out += [(c, i, r, t) for c in (200, 201, 202, 205) for i, (r, t) in enumerate([("user", "copied"), ("assistant", "often")] * 6)]
    out += [(300, i, "user", f"t{i}") for i in range(400)] + [(301, i, "user", f"t{i}") for i in range(350)]  # very long ones
    out += [(400, 0, "user", "x" * 100_000), (401, None, "user", "first"), (401, 1, "user", "second"), (401, 1, "user", "second")]
    out += [(-6, 0, "user", "hello"), (-7, 0, "user", "hello"), (None, 0, "user", "no key")]
    rnd.shuffle(out)
    return [(*r, 1, "k", "n") for r in out]


def turn_id(role, text):
    return hashlib.sha256((str(len((role or "").encode())) + ":" + (role or "") + (text or "")).encode()).hexdigest()


def sequences(made):
    by = defaultdict(list)
    for c, turn, role, text, *_ in made:
        if c is not None:
            by[c].append((turn is not None, turn or 0, turn_id(role, text), role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(x)] for c, x in by.items()}


def rebuilt(by):
    out = {}
    for c in by:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = by.get(base, [])[:h] + by[c][h:]
    return out


def brute(by, key="conv_id"):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in by.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in members:
        own = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += not children.get(p, 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -999, len(m), children.get(p, 0), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items())


def plain(rows):
    return sorted((r.conv_id, r.depth, -999 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in rows)


@pytest.mark.parametrize("segment, keys, piece, chunk", [(64, 20_000, 12, 1 << 16), (3, 7, 2, 5)])
def test_equals_brute_force(spark, monkeypatch, segment, keys, piece, chunk):
    for name, value in {"SEGMENT": segment, "TREE_KEYS": keys, "PIECE_BITS": piece, "CHUNK_BYTES": chunk}.items():
        monkeypatch.setattr(T, name, value)
    made = conversations()
    rows = T.ordered(spark.createDataFrame(made, SCHEMA))
    assert plain(T.prefix_trie(rows).collect()) == brute(sequences(made))


def test_rebuilt_conversations_equal_brute_force(spark):
    made = conversations(8, 90)
    got = T.prefix_trie(*Q.rebuilt(T.ordered(spark.createDataFrame(made, SCHEMA))))
    assert plain(got.collect()) == brute(rebuilt(sequences(made)))


def test_copies_that_hold_most_rows(spark):
    by = {c: [("user", "same"), ("assistant", "answer")] + ([("user", str(c))] if c % 3 == 0 else []) for c in range(900)}
    made = [(c, i, r, t, 0, "", "") for c, x in by.items() for i, (r, t) in enumerate(x)]
    assert plain(T.prefix_trie(T.ordered(spark.createDataFrame(made, SCHEMA).repartition(17))).collect()) == brute(by)


def test_empty_table_and_conversations_without_turns(spark):
    none = T.ordered(spark.createDataFrame([], SCHEMA))
    assert T.prefix_trie(none).collect() == []
    keys = spark.createDataFrame([(3,), (1,)], "key long")
    assert plain(T.prefix_trie(none, keys).collect()) == brute({1: [], 3: []})


def test_layouts_grow_and_keep_their_children():
    tree = T.Tree()
    keys = [bytes([i, j]) + b"tail" for i in range(256) for j in range(0, 256, 37)] + [b"\x05"]
    random.Random(2).shuffle(keys)
    for n, k in enumerate(keys):
        tree.add(k, [1, n, 0, 0], (k,))
        size = len(tree.root.layout.children()) if tree.root.layout else 0
        kind = tree.root.layout
        if kind is not None and not tree.root.path:
            assert isinstance(kind, T.Direct if size > 48 else T.Indexed if size > 16 else T.Few)
            assert not isinstance(kind, T.Few) or kind.most == (4 if size <= 4 else 16)
    walked = list(tree.walk())
    assert walked[0][3][:2] == [len(keys), 0]
    assert sum(node.total is not None for node, *_ in walked) == len(set(keys))
    assert [c.path[:0] for c in tree.root.layout.children()] == [b""] * 256
