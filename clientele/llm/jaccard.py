"""N-gram Jaccard join by a size-aware split into light and heavy sets.

Texts become sets of word shingles; two sets link if 100 * overlap >= percent * union. Sets with equal
content are one class, and only class representatives are compared.

All shingles have one order: rare ones first. Two linked sets of sizes n and m share at least
c(n) = ceil(percent * n / 100) shingles, so their k smallest common ones lie within the first
n - c(n) + k of each. **Light** sets (size up to a boundary) enumerate all 2-element subsets of that
prefix, and light pairs meet in an equal subset. **Heavy** sets go into inverted lists over the single
shingles of their prefix (k = 1) and scan these lists; light sets large enough to link with a heavy
one are listed too. The boundary is the size that minimises the estimated records and list scans of
both parts.

Lists never turn into all pairs of a group. First every member is compared with the first member of
its lists only; verified links form components. While many pairs of a list are still in different
components, another member at a time takes the first one's place. Then only those pairs of a list
are compared that different components still hold, so a large group of near copies costs a few
comparisons per member, and no component is missed. A bound from bit sketches drops most other
candidates; what remains is verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientele.llm.common import giving_back, map_texts, packed, small, small_batches, unpacked
from clientele.llm.shingles import BASE, U, mixed, shingle_set
from clientele.operators.ordering import settled

WIDTH = 5
PERCENT = 80
LARGEST_BOUNDARY = 64  # beyond it subsets are far more than list entries
FREQUENT = 200_000  # shingles whose counts the common order knows; 3 MB on each executor
CHUNK = 1 << 21  # shingles counted together inside a task
SKETCH_BITS = 128  # the shortest; longer sets have two to four bits per shingle
BRIEF_WORDS = 16  # 1,024 bits: enough for sets of up to some 2,000 shingles
PAIRS_AN_ENTRY = 16  # pairs left for each list entry up to which they are compared as they are
UNIT = 512  # entries of a list that are compared with as many others at once


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Shingles a set of size ``n`` shares at least with any set it links to."""
    return -(-percent * n // 100)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the hashes by their low-order bits: sets differ at least as often as their sketches.

    Lengths are powers of two, so a sketch folds to half its length by joining its halves.
    """
    bits = SKETCH_BITS
    while bits < 2 * len(s):
        bits *= 2
    return np.packbits(np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1).view(np.int64)


def brief(words: np.ndarray) -> np.ndarray:
    """A sketch folded to at most ``BRIEF_WORDS``, which travels with every list entry of its set."""
    while len(words) > BRIEF_WORDS:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def least_common(total, percent: int):
    """Overlap that two sets with ``total`` members together need to link."""
    return -(-total * percent // (100 + percent))


def subset_keys(prefix: np.ndarray) -> np.ndarray:
    """Hashes of all two-element subsets."""
    i, j = np.triu_indices(len(prefix), 1)
    low, high = np.minimum(prefix[i], prefix[j]), np.maximum(prefix[i], prefix[j])
    return mixed(low * U(BASE) + high)


def statistics(df: DataFrame, text: str, percent: int, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The most frequent shingles with their counts, and the boundary between light and heavy sets.

    Each task counts its shingles in chunks and reports those that occur in four or more texts of a
    chunk; sums over all tasks order the shingles. It also reports, per small size, how many records
    and list entries either way of joining would handle. The order and the boundary change only the
    cost, never the result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def report(sets: list[np.ndarray]) -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(sets), return_counts=True)
            often = counts >= 4
            rows = [(0, k, n, 0.0) for k, n in zip(keys[often].view(np.int64).tolist(), counts[often].tolist(), strict=True)]
            small: dict[int, list[np.ndarray]] = {}
            for s in sets:
                if 4 <= len(s) <= LARGEST_BOUNDARY:
                    small.setdefault(len(s), []).append(s)
            spare = {n: n - least_overlap(n, percent) for n in small}
            pairs = {n: [subset_keys(s[: spare[n] + 2]) for s in group] for n, group in small.items()}
            single = {n: [s[: spare[n] + 1] for s in group] for n, group in small.items()}
            for kind, made in ((1, pairs), (2, single)):
                if made:
                    all_keys, at = np.unique(np.concatenate([k for g in made.values() for k in g]), return_inverse=True)
                    length = np.bincount(at, minlength=len(all_keys))[at]
                    ends = np.cumsum([sum(map(len, g)) for g in made.values()])
                    for n, part in zip(made, np.split(length, ends[:-1]), strict=True):
                        rows.append((kind, n, len(part), float(part.sum() - len(part))))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "a", "n", "scan"])

        sets, held = [], 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                sets.append(shingle_set(value, width))
                held += len(sets[-1])
                if held >= CHUNK:
                    yield report(sets)
                    sets, held = [], 0
        if held:
            yield report(sets)

    counted = small_batches(df).select(F.col(text).alias("text")).where(F.col("text").isNotNull()).mapInArrow(giving_back(count), "kind int, a long, n long, scan double")
    counted = settled(counted)
    sums = counted.groupBy("kind", "a").agg(F.sum("n").alias("n"), F.sum("scan").alias("scan"), F.count(F.lit(1)).alias("chunks"))
    often = sums.where("kind = 0").orderBy(F.desc("n"), "a").limit(FREQUENT).select("a", "n").toPandas()
    often = often.sort_values("a", key=lambda a: a.to_numpy(np.int64).view(U))
    costs = sums.where("kind > 0").toPandas()  # at most two rows per size up to the largest boundary
    costs["cost"] = costs["n"] + costs["scan"] * costs["chunks"]
    by_size = costs.pivot(index="a", columns="kind", values="cost").sort_index()
    boundary = 3
    if len(by_size):
        # total cost if all sizes up to each one are light
        total = by_size[1].cumsum() + by_size[2][::-1].cumsum()[::-1] - by_size[2]
        if total.min() <= by_size[2].sum():
            boundary = int(total.idxmin())
    return often["a"].to_numpy(np.int64).view(U), often["n"].to_numpy(np.int64), boundary


def prepared(df: DataFrame, key: str, text: str, percent: int, width: int, also: list[str]) -> DataFrame:
    """One row per text: a row number, the set's size and signature, a bit sketch and the join keys."""
    frequent, counts, boundary = statistics(df, text, percent, width)
    order = df.sparkSession.sparkContext.broadcast((frequent, counts))

    def make():
        known, often = order.value

        def rare_first(s: np.ndarray, length: int) -> np.ndarray:
            if len(known) == 0:
                return s[:length]
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            n = np.where(known[at] == s, often[at], 0)
            return s[np.argsort(n, kind="stable")[:length]]

        def one(value: str | None) -> tuple:
            s = shingle_set(value, width)
            n = len(s)
            first, second = np.add.reduce(mixed(s)), np.bitwise_xor.reduce(mixed(s + U(BASE))) if n else U(0)
            bits = sketch(s)
            least = least_overlap(n, percent)
            light, single = [], []
            # some sets are too small to link with any set but an equal one
            if n and least_overlap(n + (least == n), percent) <= n:
                spare = n - least
                prefix = rare_first(s, spare + 2)
                if n <= boundary:
                    light = subset_keys(prefix).view(np.int64).tolist()
                if n > boundary or n >= least_overlap(boundary + 1, percent):
                    single = prefix[: spare + 1].view(np.int64).tolist()
            return (n, int(first.astype(np.int64)), int(second.astype(np.int64)), bits.tolist(), brief(bits).tolist(), light, single, n > boundary)

        return lambda texts: [one(t) for t in texts]

    longs = T.ArrayType(T.LongType())
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("th"), *packed(also))
    made = map_texts(rows, "text", make, ("n", T.LongType()), ("s1", T.LongType()), ("s2", T.LongType()), ("bits", longs), ("brief", longs),
                     ("light", longs), ("single", longs), ("heavy", T.BooleanType()), keep=["key", "th", *(["__also"] if also else [])])
    return settled(made.withColumn("row", F.monotonically_increasing_id()))


def listed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Entries of all lists with two or more members: ``(list, v, n, alone, lead, lead_n, many)``.

    ``alone`` tells that a pair with this entry is to be compared whatever the other one is: subsets
    serve light pairs, single shingles serve pairs with a heavy set.
    """
    own = rows.join(classes.select("v"), F.col("row") == F.col("v"), "left_semi")
    # a list of subsets and one of single shingles never meet: the kind is part of the name
    kinds = F.array(F.struct(F.lit(True).alias("sub"), F.col("light").alias("keys")), F.struct(F.lit(False).alias("sub"), F.col("single").alias("keys")))
    entries = own.select("row", "n", "heavy", F.inline(kinds)).select(
        F.col("row").alias("v"), F.col("n").cast("int").alias("n"), (F.col("sub") | F.col("heavy")).alias("alone"),
        "sub", F.explode("keys").alias("list"))
    # aggregates and a join instead of a window: a list that a third of all sets share is then no single task's work
    met = entries.groupBy("list", "sub").agg(
        F.count(F.lit(1)).alias("many"), F.min("v").alias("lead"), F.min_by("n", "v").alias("lead_n"), F.max("alone").alias("any"))
    met = settled(met.where((F.col("many") > 1) & F.col("any")).drop("any"))
    return settled(entries.join(met, ["list", "sub"]).select("list", "sub", "v", "n", "alone", "lead", "lead_n", "many"))


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def verified(pairs: DataFrame, rows: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """``(a, b, overlap)``: the pairs of row numbers whose sets link, checked on whole sets."""
    facts = rows.select("row", "n", "bits", "th", "s1")
    side = lambda x: facts.select(F.col("row").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "bits", "th", "s1")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    # sketches differ in no more bits than the sets in shingles; a longer one is folded to the other's length
    half = lambda x, n: F.zip_with(F.slice(x, 1, n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))
    a, b = F.col("bits_a"), F.col("bits_b")
    short = F.least(F.size(a), F.size(b))
    fold = lambda x: F.when(F.size(x) > short, half(x, short)).otherwise(x)
    apart = F.aggregate(F.zip_with(fold(a), fold(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    total = F.col("n_a") + F.col("n_b")
    close = both.where(apart <= total - 2 * F.ceil(total * percent / F.lit(100 + percent)))
    close = settled(close.select("a", "b", "n_a", "n_b", "th_a", "th_b", "s1_a", "s1_b"))
    wanted = close.select(F.inline(F.array(
        F.struct(F.col("a").alias("v"), F.col("th_a").alias("th"), F.col("s1_a").alias("s1")),
        F.struct(F.col("b").alias("v"), F.col("th_b").alias("th"), F.col("s1_b").alias("s1"))))).distinct()
    wanted = settled(wanted)
    hashes = small(settled(wanted.select("th").distinct()))
    found = texts.withColumn("th", F.xxhash64("text")).join(hashes, "th", "left_semi").dropDuplicates(["th", "text"])

    def make():
        def one(value: str | None) -> tuple:
            s = shingle_set(value, width)
            return s.view(np.int64).tolist(), int(np.add.reduce(mixed(s)).astype(np.int64))

        return lambda values: [one(v) for v in values]

    sets = map_texts(found, "text", make, ("shingles", T.ArrayType(T.LongType())), ("s1", T.LongType()), keep=["th"])
    sets = settled(sets.join(wanted, ["th", "s1"]).select("v", "shingles"))
    whole = close.join(sets.select(F.col("v").alias("a"), F.col("shingles").alias("of_a")), "a")
    whole = whole.join(sets.select(F.col("v").alias("b"), F.col("shingles").alias("of_b")), "b")
    overlap = F.size(F.array_intersect("of_a", "of_b"))
    measured = whole.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("both"), overlap.alias("overlap"))
    return settled(measured.where(F.col("overlap") * 100 >= (F.col("both") - F.col("overlap")) * percent).select("a", "b", "overlap"))


def close_pairs(entries: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: pairs of a list in different components whose sizes and sketches allow a link.

    Lists are cut into units of bounded size, and a pair of units is compared as arrays in one place:
    only what passes leaves it, and no list, however long, is one task's work.
    """
    counts = entries.groupBy("list", "sub").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(UNIT))).cast("int").alias("units"))
    cut = entries.join(counts, ["list", "sub"]).withColumn("own", F.pmod(F.xxhash64("v"), F.col("units")).cast("int"))
    cut = cut.join(rows.select(F.col("row").alias("v"), F.col("brief").alias("bits")), "v")
    others = F.explode(F.sequence(F.lit(0), F.col("units") - 1))
    sent = cut.withColumn("other", others).select(
        "list", "sub", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "v", "n", "alone", "root", "bits")
    unit = ["list", "sub", "lo", "hi"]
    placed = sent.repartition(*unit).sortWithinPartitions(*unit)

    def compare(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        one = pa.Table.from_batches(parts)
        own, v, n, alone, root = (one.column(c).to_numpy() for c in ("own", "v", "n", "alone", "root"))
        lo, hi = one.column("lo")[0].as_py(), one.column("hi")[0].as_py()
        bits = one.column("bits").combine_chunks()
        order = np.argsort(n, kind="stable")
        own, v, n, alone, root = own[order], v[order], n[order], alone[order], root[order]
        size = np.diff(bits.offsets.to_numpy())[order]
        start, flat = bits.offsets.to_numpy()[:-1][order], bits.values.to_numpy().view(U)
        left, right = [], []
        for length in np.unique(size):
            same = np.flatnonzero(size == length)
            longer = np.flatnonzero(size == 2 * length)
            at = np.concatenate([same, longer])
            words = flat[start[same][:, None] + np.arange(length)]
            if len(longer):
                wide = flat[start[longer][:, None] + np.arange(2 * length)]
                words = np.concatenate([words, wide[:, :length] ^ wide[:, length:]])
            sizes = n[at]
            for i in range(len(same)):
                until = np.searchsorted(sizes, sizes[i] * 100 // percent, side="right")
                js = np.arange(i + 1, until)
                if lo != hi:
                    js = js[own[at[js]] != own[at[i]]]
                js = js[(root[at[js]] != root[at[i]]) & (alone[at[js]] | alone[at[i]])]
                apart = np.bitwise_count(words[js] ^ words[i]).sum(axis=1, dtype=np.int64)
                total = sizes[js] + sizes[i]
                js = js[apart <= total - 2 * least_common(total, percent)]
                left.append(np.full(len(js), v[at[i]]))
                right.append(v[at[js]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in unit], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for x, y in zip(edges, edges[1:]):
                if x == y:
                    continue
                key = tuple(keys[x])
                if held and key != last:
                    yield compare(held)
                    held = []
                held.append(batch.slice(x, y - x))
                last = key
        if held:
            yield compare(held)

    return placed.mapInArrow(giving_back(run), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(v, root)`` of every linked row number: the smallest one reachable. Runs until nothing changes."""
    ends = links.select(F.inline(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("to")), F.struct(F.col("b").alias("v"), F.col("a").alias("to")))))
    ends = settled(ends)
    labels = settled(ends.groupBy("v").agg(F.least("v", F.min("to")).alias("root")))
    while True:
        near = ends.join(labels.select(F.col("v").alias("to"), "root"), "to").groupBy("v").agg(F.min("root").alias("near"))
        stepped = labels.join(near, "v").select("v", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # a root's own root as well, so long chains shorten by half
        hops = stepped.select(F.col("v").alias("root"), F.col("root").alias("next"))
        jumped = settled(stepped.join(hops, "root", "left").select("v", "old", F.least("root", F.coalesce("next", "root")).alias("root")))
        labels = jumped.select("v", "root")
        if jumped.where(F.col("old") != F.col("root")).isEmpty():
            return labels


def held_apart(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """The entries, with their components, of the lists that several components hold."""
    rooted = entries.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    several = rooted.groupBy("list", "sub").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("list", "sub")
    return settled(rooted.join(several, ["list", "sub"]).select("list", "sub", "v", "n", "alone", "root"))


def hub_rounds(entries: DataFrame, links: DataFrame, rows: DataFrame, texts: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """More links from one member of each list at a time, and the entries of lists still held by several components.

    A list's first member may be far from most of a group that its other members hold together. While the pairs
    left are many times the entries, another member of each list, drawn by hash, is compared with all of other
    components, so a round makes at most as many pairs as there are entries. Rounds end when one leaves more than
    nine tenths of the pairs it found: those are for the comparison of all that is left.
    """
    turn, before = 0, None
    while True:
        left = held_apart(entries, components(links))
        parts = left.groupBy("list", "sub", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("list", "sub")
        sizes = parts.agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("own"))
        pairs, held = sizes.agg(F.sum((F.col("all") * F.col("all") - F.col("own")) / 2), F.sum("all")).first()
        if not held or pairs <= PAIRS_AN_ENTRY * held or (before is not None and pairs > 0.9 * before):
            return links, left
        drawn = F.min_by(F.struct("v", "n", "root"), F.struct(F.xxhash64("list", "v", F.lit(turn)), "v"))
        hubs = left.groupBy("list", "sub").agg(drawn.alias("hub"))
        met = left.join(hubs, ["list", "sub"]).where((F.col("root") != F.col("hub.root")) & _sizes_fit(F.col("n"), F.col("hub.n"), percent))
        met = met.select(F.least("v", "hub.v").alias("a"), F.greatest("v", "hub.v").alias("b")).distinct()
        links = links.unionByName(verified(met, rows, texts, percent, width))
        turn, before = turn + 1, pairs


def jaccard_join(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = WIDTH,
                 also: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Members and links of the join.

    Members: one row per row of ``df`` with ``key``, ``n_shingles``, ``component_id`` (smallest key
    reachable by links, the row's own included; null keys only count where there is no other),
    ``class_id`` (rows with equal sets share it; null without words), ``text_hash``, ``is_first``
    (one row of each component; every row without words) and the columns named in ``also``. Links: ``(class_id, other_id, overlap)``
    between classes, enough to connect every component; pairs inside a component that its links
    connect already are not listed (``link_counts`` counts them). Null and empty texts have size 0 and link with nothing; equal rows are members
    of one class; texts are compared whole; an empty table gives empty results.
    """
    if not 60 <= percent <= 100:
        raise ValueError("subsets of two shingles serve similarities from 60 to 100 percent")
    also = also or []
    rows = prepared(df, key, text, percent, width, also)
    grouped = rows.where("n > 0").groupBy("n", "s1", "s2")
    classes = settled(grouped.agg(F.min("row").alias("v"), F.min("key").alias("low")))
    lists = listed(rows, classes)
    texts = df.select(F.col(text).alias("text"))
    star = lists.where((F.col("v") != F.col("lead")) & _sizes_fit(F.col("n"), F.col("lead_n"), percent))
    star = star.select(F.col("lead").alias("a"), F.col("v").alias("b")).distinct()
    links = verified(star, rows, texts, percent, width)
    longer = settled(lists.where((F.col("many") > 2) & (F.col("v") != F.col("lead"))).select("list", "sub", "v", "n", "alone"))
    links, longer = hub_rounds(longer, links, rows, texts, percent, width)
    # what is left: pairs of a list in different components
    rest = close_pairs(longer, rows, percent)
    links = links.unionByName(verified(rest, rows, texts, percent, width))
    roots = components(links)
    placed = classes.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    placed = settled(placed.join(lows, "root").select("n", "s1", "s2", "v", "root", "component_id"))
    joined = rows.select("key", "th", "n", "s1", "s2", "row", *(["__also"] if also else [])).join(placed, ["n", "s1", "s2"], "left")
    joined = joined.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")))
    firsts = joined.where("n > 0").groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("f"))
    firsts = firsts.select(F.col("f.row").alias("row"), F.lit(True).alias("is_first"))
    members = joined.join(firsts, "row", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("v").alias("class_id"),
        F.col("th").alias("text_hash"), (F.coalesce("is_first", F.lit(False)) | (F.col("n") == 0)).alias("is_first"), *unpacked(also))
    return members, links.select(F.col("a").alias("class_id"), F.col("b").alias("other_id"), "overlap")


def link_counts(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``key`` and ``n_links`` of every row of ``df``: how many other rows its text links to, equal sets included.

    Unlike the links of ``jaccard_join`` these are all of them: every pair of classes that meets in a list
    is compared and verified, also inside a component, and then counted with the classes' sizes. The
    pairs grow with the square of a group of near copies. Rows without words have no links.
    """
    if not 60 <= percent <= 100:
        raise ValueError("subsets of two shingles serve similarities from 60 to 100 percent")
    rows = prepared(df, key, text, percent, width, [])
    grouped = rows.where("n > 0").groupBy("n", "s1", "s2")
    classes = settled(grouped.agg(F.min("row").alias("v"), F.count(F.lit(1)).alias("size")))
    # each class is a component of its own, so no pair is left out
    every = settled(listed(rows, classes).select("list", "sub", "v", "n", "alone", F.col("v").alias("root")))
    links = verified(close_pairs(every, rows, percent), rows, df.select(F.col(text).alias("text")), percent, width)
    ends = links.select(F.inline(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("to")), F.struct(F.col("b").alias("v"), F.col("a").alias("to")))))
    other = ends.join(classes.select(F.col("v").alias("to"), F.col("size").alias("n_to")), "to").groupBy("v").agg(F.sum("n_to").alias("others"))
    counted = classes.join(other, "v", "left").select("n", "s1", "s2", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return rows.join(counted, ["n", "s1", "s2"], "left").select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"))
