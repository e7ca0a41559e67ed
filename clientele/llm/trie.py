"""The prefix trie of conversations, from adaptive radix trees.

A turn (role and text) has an id of ``TURN`` bytes, big-endian, so a conversation is a byte string and a
common beginning is a common prefix. Tasks hold adaptive radix trees: inner nodes of 4, 16, 48 or 256
children that grow with use, and compressed paths. Branches may lie at any byte; only depths that end a
turn emit nodes.

A tree in a task holds a part of the conversations, and a part of each: a conversation is cut into
segments of ``SEGMENT`` turns, and the segments are range-partitioned by where they start, their bytes
and their conversation. So neither a long conversation nor a beginning that a third of all share lies in
one task, and a tree merges almost all it can before anything is shuffled. Trees emit partial nodes, named
by depth and a 124-bit sum over all turns up to there; Spark adds the parts up.

Whatever covers a subtree follows from the members. A node belongs to its smallest member, and the nodes
of one conversation are the lower end of its path. So a second pass of the trees adds up, over the
members of each node, what their own nodes hold; only the owner's own nodes above must be taken off.
"""

from __future__ import annotations

import hashlib
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientele.llm.common import small_batches
from clientele.operators.ordering import row_number_in_pieces, settled

TURN = 16  # bytes of a turn id: the head of a SHA-256
SEGMENT = 64  # turns
TREE_KEYS = 20_000  # segments after which a task starts a new tree
PIECE_BITS = 12  # long conversations are handled in pieces of this many bits of turns or segments
MASK = (1 << 62) - 1
CHUNK_BYTES = 1 << 16


# ---------------------------------------------------------------- adaptive radix tree


class Few:
    """Up to 4 or 16 children: bytes in order, children beside them."""

    __slots__ = ("most", "bytes", "nodes")

    def __init__(self, most: int):
        self.most, self.bytes, self.nodes = most, bytearray(), []

    def get(self, byte: int) -> Node | None:
        at = self.bytes.find(byte)
        return self.nodes[at] if at >= 0 else None

    def put(self, byte: int, node: Node) -> Few | Indexed:
        if len(self.bytes) == self.most:
            return (Few(16) if self.most == 4 else Indexed()).filled(self).put(byte, node)
        at = bisect(self.bytes, byte)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def filled(self, other: Few) -> Few:
        self.bytes, self.nodes = other.bytes, other.nodes
        return self

    def children(self) -> list[Node]:
        return self.nodes


class Indexed:
    """Up to 48 children: a slot for each byte, children in the order they came."""

    __slots__ = ("slots", "nodes")

    def __init__(self):
        self.slots, self.nodes = bytearray(256), []

    def get(self, byte: int) -> Node | None:
        slot = self.slots[byte]
        return self.nodes[slot - 1] if slot else None

    def put(self, byte: int, node: Node) -> Indexed | Direct:
        if len(self.nodes) == 48:
            return Direct().filled(self).put(byte, node)
        self.nodes.append(node)
        self.slots[byte] = len(self.nodes)
        return self

    def filled(self, other: Few) -> Indexed:
        for byte, node in zip(other.bytes, other.nodes, strict=True):
            self.put(byte, node)
        return self

    def children(self) -> list[Node]:
        return [self.nodes[s - 1] for s in self.slots if s]


class Direct:
    """Up to 256 children, found by the byte itself."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> Direct:
        self.nodes[byte] = node
        return self

    def filled(self, other: Indexed) -> Direct:
        for byte, slot in enumerate(other.slots):
            if slot:
                self.nodes[byte] = other.nodes[slot - 1]
        return self

    def children(self) -> list[Node]:
        return [n for n in self.nodes if n is not None]


class Node:
    """A compressed path, the children behind it, what the keys that end here add up to, and one key through it."""

    __slots__ = ("path", "layout", "total", "sample")

    def __init__(self, path: bytes, sample: tuple, total: list | None = None):
        self.path, self.layout, self.total, self.sample = path, None, total, sample

    def put(self, byte: int, node: Node) -> None:
        self.layout = (self.layout or Few(4)).put(byte, node)


def _merged(a: list | None, b: list | None) -> list | None:
    """Totals ``[members, smallest, own, leaves]`` of two sets of members."""
    if a is None or b is None:
        return b if a is None else a
    return [a[0] + b[0], min(a[1], b[1]), a[2] + b[2], a[3] + b[3]]


class Tree:
    """Byte strings with totals; ``sample`` is what the walk needs of one key through a node."""

    def __init__(self):
        self.root, self.keys = None, 0

    def add(self, key: bytes, total: list, sample: tuple) -> None:
        self.keys += 1
        if self.root is None:
            self.root = Node(key, sample, total)
            return
        node, at = self.root, 0
        while True:
            path = node.path
            if not key.startswith(path, at):
                same = next((i for i, (a, b) in enumerate(zip(path, key[at : at + len(path)])) if a != b), len(key) - at)
                lower = Node(path[same + 1 :], node.sample, node.total)
                lower.layout = node.layout
                node.path, node.layout, node.total = path[:same], None, None
                node.put(path[same], lower)
                path = node.path
            at += len(path)
            if at == len(key):
                node.total = _merged(node.total, total)
                return
            child = node.layout.get(key[at]) if node.layout else None
            if child is None:
                node.put(key[at], Node(key[at + 1 :], sample, total))
                return
            node, at = child, at + 1

    def walk(self) -> Iterator[tuple[Node, int, int, list]]:
        """``(node, depth at which its path starts, depth of its end, totals of its subtree)``, parents first."""
        if self.root is None:
            return
        order, stack = [], [(self.root, 0, -1)]
        while stack:
            node, start, parent = stack.pop()
            end = start + len(node.path)
            order.append([node, start, end, parent, node.total])
            here = len(order) - 1
            if node.layout:
                stack += [(child, end + 1, here) for child in node.layout.children()]
        for *_, parent, total in reversed(order):
            if parent >= 0:
                order[parent][4] = _merged(order[parent][4], total)
        for node, start, end, parent, total in order:
            yield node, parent, end, total


# ---------------------------------------------------------------- segments


def mark(depth: int, turn_id: bytes) -> tuple[int, int]:
    """What a turn at a depth adds to the name of its prefix."""
    digest = hashlib.blake2b(depth.to_bytes(8, "big") + turn_id, digest_size=16).digest()
    return int.from_bytes(digest[:8], "big") & MASK, int.from_bytes(digest[8:], "big") & MASK


def ordered(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(key, depth, id, size)``: turns numbered from 1, with their id and the UTF-8 bytes of their text.

    Null roles and texts are empty. Rows come by turn (null first); rows of one turn by their ids, and
    rows equal in both are interchangeable. Rows without a key take no part.
    """
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    whole = F.concat(F.octet_length(said[0]).cast("string"), F.lit(":"), *said)
    rows = turns.where(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.substring(F.unhex(F.sha2(whole, 256)), 1, TURN).alias("id"), F.octet_length(said[1]).cast("long").alias("size"))
    numbered = row_number_in_pieces(rows, ["key"], [F.col("turn").asc_nulls_first(), "id"], F.shiftright("turn", PIECE_BITS), "depth")
    return numbered.select("key", F.col("depth").cast("long").alias("depth"), "id", "size")


def _sums_before(df: DataFrame, key: str, order: str, sums: dict[str, str]) -> DataFrame:
    """Add the totals of the key's rows with a smaller ``order``, piece by piece."""
    pieced = df.withColumn("__piece", F.shiftright(order, PIECE_BITS))
    parts = pieced.groupBy(key, "__piece").agg(*[F.sum(c).alias(f"__part_{c}") for c in sums])
    earlier = W.partitionBy(key).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    shifts = parts.select(F.col(key).alias("__key"), F.col("__piece").alias("__at"),
                          *[F.coalesce(F.sum(f"__part_{c}").over(earlier), F.lit(0)).alias(f"__shift_{c}") for c in sums])
    inside = W.partitionBy(key, "__piece").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    within = pieced.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__in_{c}") for c in sums])
    joined = within.join(shifts, (F.col(key) == F.col("__key")) & (F.col("__piece") == F.col("__at")))
    added = {out: F.col(f"__in_{c}") + F.col(f"__shift_{c}") for c, out in sums.items()}
    return joined.withColumns(added).select(*df.columns, *sums.values())


def segments(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """``(key, segment, ids, sizes, high, low, start_high, start_low)`` of ``(key, depth, id, size)``.

    Every row of ``conversations (key)`` has a segment 0, an empty one if it has no turns. ``high`` and
    ``low`` add up the marks of the segment's turns, ``start_*`` those of all turns before it.
    """
    none = conversations.select("key", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("id"), F.lit(0).cast("long").alias("size"))
    at = F.when(F.col("depth") > 0, F.floor((F.col("depth") - 1) / SEGMENT)).otherwise(0).cast("long")
    met = none.unionByName(rows).groupBy("key", at.alias("segment")).agg(
        F.array_sort(F.collect_list(F.when(F.col("depth") > 0, F.struct("depth", "id", "size")))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, segment, ids, sizes in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                marks = [mark(segment * SEGMENT + i + 1, x) for i, x in enumerate(ids)]
                out.append((key, segment, b"".join(ids), sizes, sum(m[0] for m in marks) & MASK, sum(m[1] for m in marks) & MASK))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)],
                                             names=["key", "segment", "ids", "sizes", "high", "low"])

    flat = small_batches(met).select("key", "segment", F.transform("turns", lambda t: t["id"]).alias("ids"),
                                     F.transform("turns", lambda t: t["size"]).alias("sizes"))
    named = settled(flat.mapInArrow(run, "key long, segment long, ids binary, sizes array<long>, high long, low long"))
    wide = named.select("key", "segment", *[F.col(c).cast("decimal(38,0)").alias(c) for c in ("high", "low")])
    before = _sums_before(wide, "key", "segment", {"high": "start_high", "low": "start_low"})
    cut = {c: (F.col(c) % F.lit(MASK + 1).cast("decimal(38,0)")).cast("long") for c in ("start_high", "start_low")}
    starts = before.withColumns(cut).select(F.col("key").alias("__key"), F.col("segment").alias("__segment"), *cut)
    return named.join(starts, (F.col("key") == F.col("__key")) & (F.col("segment") == F.col("__segment"))).drop("__key", "__segment")


PARTS = "depth long, high long, low long, parent_high long, parent_low long, size long, n long, first long, own long, leaves long"


def folded(rows: DataFrame) -> DataFrame:
    """The partial nodes of the trees over ``segments`` with ``own`` and ``leaves`` of their conversations."""

    def emit(tree: Tree) -> Iterator[pa.RecordBatch]:
        names, out = [], []
        for node, parent, end, total in tree.walk():
            ids, sizes, segment = node.sample
            # the last depth above that ends a turn, and the name of the prefix there
            at, high, low = names[parent] if parent >= 0 else (0, 0, 0)
            while at + TURN <= end:
                at += TURN
                if at == TURN:  # the start stands before the turns of a segment
                    high, low = int.from_bytes(ids[:8], "big"), int.from_bytes(ids[8:TURN], "big")
                    if segment == 0:
                        out.append((0, high, low, None, None, 0, *total))
                    continue
                place = at // TURN - 2
                depth = segment * SEGMENT + place + 1
                more = mark(depth, ids[at - TURN : at])
                name = (high + more[0]) & MASK, (low + more[1]) & MASK
                out.append((depth, *name, high, low, sizes[place], *total))
                high, low = name
            names.append((at, high, low))
        for part in range(0, len(out), 10_000):
            columns = zip(*out[part : part + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=columns_named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree()
        for batch in batches:
            for key, segment, ids, sizes, high, low, own, leaves in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                whole = high.to_bytes(8, "big") + low.to_bytes(8, "big") + ids
                tree.add(whole, [1, key, own, leaves], (whole, sizes, segment))
                if tree.keys >= TREE_KEYS:
                    yield from emit(tree)
                    tree = Tree()
        yield from emit(tree)

    columns_named = [c.split(" ")[0] for c in PARTS.split(", ")]
    spread = rows.repartitionByRange("segment", "start_high", "start_low", "ids", "key")
    sent = spread.select("key", "segment", "ids", "sizes", "start_high", "start_low", "own", "leaves")
    return small_batches(sent).mapInArrow(run, PARTS)


# ---------------------------------------------------------------- conversations that end at a node


def _listed(rows: DataFrame, order: Column | str, whole: bool) -> DataFrame:
    """Per ``(high, low)`` the texts in order, joined by commas in chunks, or the digest of them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first, said, size, digest = None, None, [], 0, None
        out: list[tuple] = []

        def close() -> None:
            if group is not None and (said or whole):
                out.append((*group, first, digest.hexdigest() if whole else ",".join(said)))

        for batch in batches:
            for high, low, at, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (high, low) != group or (not whole and size > CHUNK_BYTES):
                    close()
                    group, first, said, size, digest = (high, low), at, [], 0, hashlib.sha256()
                    text_before = ""
                if whole:
                    digest.update((text_before + text).encode())
                    text_before = ","
                else:
                    said.append(text)
                    size += len(text) + 1
            if len(out) >= 1000 or not whole and out:
                yield made(out)
                out = []
        close()
        if out:
            yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                                          names=["high", "low", "first", "text"])

    spread = rows.repartition("high", "low") if whole else rows.repartitionByRange("high", "low", order)
    return small_batches(spread.sortWithinPartitions("high", "low", order)).select("high", "low", order, "text").mapInArrow(
        run, "high long, low long, first long, text string")


def endings(ends: DataFrame) -> DataFrame:
    """``(high, low, ends_sha256)``: the digest of the ascending keys of ``(key, high, low)``, comma-joined.

    Keys are first joined to chunks in ranges of (node, key), so copies of one conversation are spread
    over tasks; then one task per node digests its chunks as they come, as SHA-256 has no other way.
    """
    chunks = _listed(ends.select("high", "low", "key", F.col("key").cast("string").alias("text")), "key", False)
    return _listed(chunks, "first", True).select("high", "low", F.col("text").alias("ends_sha256"))


# ---------------------------------------------------------------- the operator


def prefix_trie(rows: DataFrame, conversations: DataFrame | None = None, key: str = "conv_id") -> DataFrame:
    """One row per distinct beginning of ``(key, depth, id, size)``, as ``ordered`` gives it.

    ``(key, depth, parent_<key>, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``: the smallest
    member and its parent's; members; children; leaves of the subtree (with the node); over the subtree,
    members less one times the bytes of the last text; the digest of the members that end here, ascending
    and comma-joined. ``conversations (key)`` adds such as have no turns: members of the root, which has
    depth 0 and no parent. Equal conversations are members of the same nodes; texts and conversations may
    be of any length; an empty table gives no rows.
    """
    present = rows.select("key").distinct() if conversations is None else conversations.select("key").unionByName(rows.select("key")).distinct()
    cut = settled(segments(rows, present))
    merged = folded(cut.withColumns({"own": F.lit(0).cast("long"), "leaves": F.lit(0).cast("long")})).groupBy("depth", "high", "low").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.first("parent_high").alias("parent_high"),
        F.first("parent_low").alias("parent_low"), F.first("size").alias("size"))
    nodes = settled(merged)
    of = lambda a, b, p="": (F.col(f"{a}.{p}high") == F.col(f"{b}.high")) & (F.col(f"{a}.{p}low") == F.col(f"{b}.low"))
    children = nodes.where(F.col("parent_high").isNotNull()).groupBy(F.col("parent_high").alias("high"), F.col("parent_low").alias("low")).agg(
        F.count(F.lit(1)).alias("n_children"))
    wide = nodes.alias("n").join(children.alias("c"), of("n", "c"), "left").select("n.*", F.coalesce("c.n_children", F.lit(0)).alias("n_children"))
    wide = settled(wide.withColumn("saved", (F.col("n") - 1) * F.col("size")))
    owned = wide.groupBy(F.col("first").alias("__key")).agg(F.sum("saved").alias("own"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    valued = cut.join(owned, F.col("key") == F.col("__key"), "left").drop("__key").na.fill(0, ["own", "leaves"])
    sums = folded(valued).groupBy("high", "low").agg(F.sum("own").alias("own"), F.sum("leaves").alias("n_leaves"))
    placed = _sums_before(wide.select("first", "depth", "high", "low", "saved"), "first", "depth", {"saved": "above"})
    last = cut.groupBy("key").agg(F.max(F.struct("segment", *[
        F.pmod(F.col(f"start_{c}") + F.col(c), F.lit(MASK + 1)).alias(c) for c in ("high", "low")])).alias("end"))
    ends = endings(settled(last.select("key", "end.high", "end.low")))
    parents = nodes.select("high", "low", "first")
    joined = (
        wide.alias("n")
        .join(sums.alias("s"), of("n", "s"))
        .join(placed.select("high", "low", "above").alias("a"), of("n", "a"))
        .join(parents.alias("p"), of("n", "p", "parent_"), "left")
        .join(ends.alias("e"), of("n", "e"), "left")
    )
    return joined.select(
        F.col("n.first").alias(key), "n.depth", F.col("p.first").alias(f"parent_{key}"), F.col("n.n").alias("n_convs"),
        F.col("n.n_children").alias("n_children"), "s.n_leaves", (F.col("s.own") - F.col("a.above")).alias("saved_tokens"),
        F.coalesce("e.ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
