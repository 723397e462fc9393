"""Near copies by SimHash whose word shingles are alike: all documents whose Jaccard similarity reaches a threshold.

op10's 64 bits and distance of 2 cannot reach that far: pairs of similarity 0.8 differ in 3 to 11 of 64 bits. So a SimHash
of a shingle set has BITS bits here, the first 64 of them as op10 makes them, and pigeonhole blocks of `width` of its bits,
drawn anew for each deal, are the keys: two sets that differ in fewer bits than a deal has blocks share one for certain,
those of similarity 0.8 (155 of 1024 bits) share none of 128 with probability 4e-5, closer ones with far less. Sets
that share a key meet there with CHECK bits; those within the distance make a group. Blocks grow by a bit and keys by a
fifth where documents double, so that a key's pairs do not become more. Sets of at most SMALL shingles, whose bits are
coarse, also share keys made of the shingles themselves. Equal shingle sets are one node.

Nodes that groups connect make a family, which is the unit of comparing: a set travels once or a few times, not once a
pair. Each key deals the nodes of a large family to other groups, so it would be told of once a key and node. But one
key in EARLY goes first; in the others nodes meet under the least node that these have connected them to, and a group
tells only which of those names it connects, mostly none. Families are the same as if all keys told all. A family of at
most `block` nodes is compared in one task, pair by pair, but only pairs whose SimHashes are within the distance, have
sizes that allow the similarity, and are not connected yet. A larger one is cut into blocks by hash, and each two
blocks meet in a task. Before that, its node with the most company is compared with all others; what then is of its
largest component need not be compared within itself. So a group of n copies near each other costs about n comparisons.
A family over `family` nodes falls apart into the nodes of each group, which are treated in the same way, where its
groups have fewer pairs in all than itself. All pairs that share a group and are not connected otherwise are compared
on their whole sets; none is left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, few_or_not, first_of_each, freed, identified, workers_find_us
from .near_copies import SEED, components

#: Bits of a SimHash, and those that meet in a key.
BITS, CHECK = 1024, 128
#: Shingles up to which a set also has keys made of them; nodes of a key from which on connected ones are set aside before others are compared.
SMALL, MANY = 5, 1024
#: One key in so many goes first and names the nodes that it connects.
EARLY = 8
#: Nodes that meet in a task at a time.
MEETING = 250_000
#: Nodes and shingles in a block, nodes in a family that is compared as a whole.
BLOCK, BLOCK_SHINGLES, FAMILY = 256, 1_000_000, 4096


def shingles(text: bytes, length: int = 5) -> np.ndarray:
    """The sorted set of XXH64 of word shingles, A-Z lower-cased; a shorter text is one shingle, no words are none."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    grams = map(b" ".join, zip(*(words[i:] for i in range(length)), strict=False)) if len(words) >= length else [b" ".join(words)] if words else []
    return np.unique(np.array([xxh64_intdigest(x, SEED) for x in grams], "<u8"))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; of two empty ones 1."""
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared) if len(both) else 1.0


_rng = np.random.default_rng(SEED)
TURN, SPREAD = _rng.integers(0, 2**64, BITS // 64, np.uint64), _rng.integers(0, 2**63, BITS // 64, np.uint64) * np.uint64(2) + np.uint64(1)


def simhash(grams: np.ndarray) -> np.ndarray:
    """The SimHash of a set of 64-bit hashes in BITS bits: a bit is 1 if set in over half of them. Words behind the first mix each hash anew."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(grams), 255):
        h = grams[at : at + 255, None]
        x = (h ^ TURN) * SPREAD
        x = (x ^ (x >> np.uint64(32))) * SPREAD[0]
        x ^= x >> np.uint64(29)
        x[:, :1] = h
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of SimHashes, word by word in the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.uint16)


def flips(similarity: float) -> float:
    """The share of bits that differ between sets of that Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def width_and_keys(rows: int, similarity: float) -> tuple[int, int]:
    """Bits in a block, so that about 2^9 of so many rows share one by chance at most; and keys, so that 13.5 are shared at that similarity."""
    width = max(14, math.ceil(math.log2(max(rows, 1))) - 9)
    return width, math.ceil(13.5 / -math.log1p(-((1 - flips(similarity)) ** width)))


def deal(width: int, keys: int) -> np.ndarray:
    """The bits of each key. In each run of BITS // width keys no bit comes twice."""
    rng, whole = np.random.default_rng(SEED), BITS // width
    return np.concatenate([rng.permutation(BITS)[: whole * width].reshape(whole, width) for _ in range(-(-keys // whole))])[:keys]


def small_keys(grams: np.ndarray, similarity: float) -> list[int]:
    """Keys of small sets: two of which one has one shingle more than the other share one, if they are similar enough."""
    n = len(grams)
    own = [grams] if 0 < n < SMALL and n / (n + 1) >= similarity else []
    return [_node(x) for x in own + ([np.delete(grams, i) for i in range(n)] if 1 < n <= SMALL and (n - 1) / n >= similarity else [])]


def _node(grams: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(grams.tobytes(), SEED)).view(np.int64))


def _sketches(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(id, h, node, bits, small) for every row of (id, h, text): the SimHash, null without words, and the keys of a small set."""
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("node", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("small", T.ArrayType(T.LongType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            nodes, bits, small = [], [], []
            for text in batch.column(2):
                grams = shingles((text.as_py() or "").encode(), shingle)
                nodes.append(_node(grams))
                bits.append(simhash(grams).tobytes() if len(grams) else None)
                small.append(small_keys(grams, similarity))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(nodes, pa.int64()), pa.array(bits, pa.binary()), pa.array(small, pa.list_(pa.int64()))], names=["id", "h", "node", "bits", "small"])

    return rows.mapInArrow(run, schema)


#: What meets in a key.
ENTRY = np.dtype([("key", "<u4"), ("node", "<i8"), ("check", "<u8", (CHECK // 64,))])


def _connected(entries: np.ndarray, distance: int, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, node, label), once for each key and node, in that order: label is the place of the least node of the same key that pairs within distance of their CHECK bits connect it to.

    A node may come with several CHECK bits, which are connected. In keys of more than many entries one is compared only
    with those that are not connected yet: n copies near each other cost about n comparisons.
    """
    entries = entries[np.lexsort((entries["node"], entries["key"]))]
    key, node, check = entries["key"], entries["node"], entries["check"]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    own = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
    length = np.diff(np.append(starts, len(key)))
    left = np.repeat(starts + length, length) - np.arange(len(key))
    several = np.add.reduceat(new, starts, dtype=np.int64) > 1 if len(key) else np.empty(0, bool)
    label = own.copy()
    for start, size in zip(starts[several & (length > many)].tolist(), length[several & (length > many)].tolist(), strict=True):
        free = np.arange(start, start + size)
        while len(free):
            root = own[free[0]]
            front, free = free[own[free] == root], free[own[free] != root]
            while len(front) and len(free):
                some = max(1, 1_000_000 // len(free))
                hit = np.isin(own[free], own[free[(apart(check[front[:some], None], check[free]) <= distance).any(axis=0)]])
                label[free[hit]] = root
                front, free = np.concatenate([front[some:], free[hit]]), free[~hit]
    few = several & (length <= many)
    at, pairs = np.flatnonzero(np.repeat(few, length)), []
    for step in range(1, int(length[few].max(initial=0))):
        at = at[left[at] > step]
        near = at[own[at] != own[at + step]]
        near = near[apart(check[near], check[near + step]) <= distance]
        if len(near):
            pairs.append(own[np.stack([near, near + step])])
    if pairs:
        i, j = np.concatenate(pairs, axis=1)
        while True:
            least = np.minimum(label[i], label[j])
            before = label.copy()
            for end in (i, j):
                np.minimum.at(label, end, least)
            label = label[label]
            if (label == before).all():
                break
    return key[new], node[new], (np.cumsum(new) - 1)[label[new]]


def groups_of_keys(entries: np.ndarray, distance: int, many: int = MANY) -> tuple[np.ndarray, np.ndarray]:
    """(group, node) of the nodes that share a key and are connected there by pairs within distance of their CHECK bits.

    A group's number is made of its nodes, so groups that several keys find are the same.
    """
    _, node, label = _connected(entries, distance, many)
    order = np.argsort(label, kind="stable")
    first = np.flatnonzero(np.append(True, label[order][1:] != label[order][:-1]))[: len(order)]
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = np.diff(np.append(first, len(order)))
    mixed = node[order].view(np.uint64) * SPREAD[1]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * SPREAD[2]
    group = np.repeat(np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), first), size).view(np.int64)
    shared = np.repeat(size, size) > 1
    return group[shared], node[order][shared]


def members_of_keys(entries: np.ndarray, distance: int, many: int = MANY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, node, company) of the nodes of each group of each key: its least node and its size."""
    _, node, label = _connected(entries, distance, many)
    company = np.bincount(label, minlength=len(label))[label]
    return node[label][company > 1], node[company > 1], company[company > 1]


def edges_of_keys(entries: np.ndarray, distance: int, many: int = MANY) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), a < b, each once, that connect the nodes of each group of each key: all with its least node."""
    _, node, label = _connected(entries, distance, many)
    pairs = np.unique(np.stack([node[label], node])[:, node[label] != node], axis=1)
    return pairs[0], pairs[1]


def _meetings(nodes: DataFrame, similarity: float, n: int, numbers: range | None, told: Callable[..., tuple[np.ndarray, ...]], names: list[str]) -> DataFrame:
    """What told finds in the entries of each meeting of nodes (node, bits): those of one key's number, a few of its values at a time. A task holds one meeting at a time, packed into bytes.

    n: how many rows the keys are made for. numbers: of the keys; None: all.
    """
    width, keys = width_and_keys(n, similarity)
    parts, share = 1 + n // MEETING, flips(similarity)
    dealt = [(number, mine) for number, mine in enumerate(deal(width, keys)) if numbers is None or number in numbers]
    distance = int(share * CHECK + 4.6 * math.sqrt(share * (1 - share) * CHECK))

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(width, dtype=np.uint32)
        for batch in freed(batches):
            words = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(batch.num_rows, -1)
            entries = np.empty(len(words), ENTRY)
            entries["node"], entries["check"] = batch.column(0).to_numpy(), words[:, : CHECK // 64]
            bits = np.ascontiguousarray(np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").T)
            for number, mine in dealt:
                entries["key"] = sum(bits[b] * w for b, w in zip(mine, weights, strict=True))
                part = entries["key"] % parts
                order = np.argsort(part, kind="stable")
                edges = [0, *(np.flatnonzero(np.diff(part[order])) + 1).tolist(), len(order)]
                packed, at = entries[order], [(a, b) for a, b in pairwise(edges) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array([number * parts + int(part[order[a]]) for a, _ in at], pa.int32()), pa.array([packed[a:b].tobytes() for a, b in at], pa.binary())], names=["meeting", "entries"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def found() -> pa.RecordBatch:
            columns = told(np.frombuffer(b"".join(held), ENTRY), distance)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

        last = None
        for batch in freed(batches):
            for meeting, entries in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and meeting != last:
                    yield found()
                last = meeting
                held.append(entries.as_py())
        if held:
            yield found()

    packed = nodes.select("node", "bits").filter("bits IS NOT NULL").mapInArrow(spread, "meeting int, entries binary")
    return packed.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(meet, ", ".join(f"{c} long" for c in names))


def _small(nodes: DataFrame) -> DataFrame:
    """(key, node) of the keys that small sets share."""
    small = nodes.filter(F.size("small") > 0).select("node", F.explode("small").alias("key"))
    return small.join(small.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "key", "left_semi").select("key", "node")


def _groups(nodes: DataFrame, similarity: float, n: int) -> DataFrame:
    """(key, node) of the groups of nodes (node, bits, small), by keys made for n rows."""
    return _meetings(nodes, similarity, n, None, groups_of_keys, ["key", "node"]).union(_small(nodes)).distinct()


def _families(nodes: DataFrame, similarity: float, n: int) -> tuple[DataFrame, DataFrame]:
    """(node, family) of all nodes (node, bits, small) that groups connect, and (node, company) of those that the early keys do: the sizes of their groups. n: about how many there are."""
    keys = width_and_keys(n, similarity)[1]
    early = -(-keys // EARLY)
    members = cut(_meetings(nodes, similarity, n, range(early), members_of_keys, ["a", "node", "company"]), n)
    known = cut(members.groupBy("node").agg(F.min("a").alias("a"), F.sum("company").alias("company")), n)
    named = nodes.join(few_or_not(known.filter("a < node").select("node", "a")), "node", "left").select(F.coalesce("a", "node").alias("node"), "bits")
    late = _meetings(named, similarity, n, range(early, keys), edges_of_keys, ["a", "node"])
    small = _small(nodes)
    small = small.join(small.groupBy("key").agg(F.min("node").alias("a")), "key").select("a", "node")
    edges = members.select("a", "node").union(late).union(small).filter("a < node").distinct().withColumnRenamed("node", "b")
    found = components(edges, n)
    return found.select("node", F.col("root").alias("family")).union(found.select("root", "root").distinct()), known.select("node", "company")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, size, bits, grams) for every row of (text): the last two as bytes of 64-bit integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            sets = [shingles((text.as_py() or "").encode(), shingle) for text in batch.column(0)]
            columns = [pa.array([_node(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([simhash(x).tobytes() for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "bits", "grams"])

    return texts.mapInArrow(run, "node long, size long, bits binary, grams binary")


def links_in_cell(x: int, y: int, place: np.ndarray, node: np.ndarray, root: np.ndarray, bits: np.ndarray, grams: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs (smaller node, larger) of blocks x and y, or within x if they are one, that connect what is not connected yet."""
    a, b = np.flatnonzero(place == x), np.flatnonzero(place == y)
    size = np.array([len(g) for g in grams])
    differ = np.zeros((len(a), len(b)), np.uint16)
    for word in range(bits.shape[1]):
        differ += np.bitwise_count(bits[a, word][:, None] ^ bits[b, word][None, :])
    near = differ <= 1.65 * flips(similarity) * BITS
    near &= np.minimum(size[a][:, None], size[b]) >= np.maximum(size[a][:, None], size[b]) * similarity - 1e-6
    near &= root[a][:, None] != root[b]
    if x == y:
        near = np.triu(near, 1)
    up: dict[int, int] = {}

    def top(r: int) -> int:
        while r in up:
            r = up[r]
        return r

    out = []
    for i, j in np.argwhere(near).tolist():
        i, j = a[i], b[j]
        p, q = top(int(root[i])), top(int(root[j]))
        if p != q and jaccard(grams[i], grams[j]) >= similarity:
            up[max(p, q)] = min(p, q)
            out.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
    return out


def _compare(cells: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of links_in_cell for all cells. A task holds one cell at a time."""
    cell = ["kind", "group", "x", "y"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            x, y, place, node, root = (rows[c].to_numpy() for c in ("x", "y", "place", "node", "root"))
            bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), "<u8").reshape(len(node), -1)
            found = links_in_cell(x[0], y[0], place, node, root, bits, [np.frombuffer(g, "<u8") for g in rows["grams"].to_pylist()], similarity)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        last = None
        for batch in freed(batches):
            ids = np.stack([batch.column(c).to_numpy() for c in range(4)])
            starts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(starts, starts[1:], strict=False):
                if start == end:
                    continue
                if held and (now := tuple(ids[:, start])) != last:
                    yield links()
                last = tuple(ids[:, start])
                held.append(batch.slice(start, end - start))
        if held:
            yield links()

    rows = cells.join(sets.drop("size"), "node").select(*cell, "place", "node", "root", "bits", "grams")
    return rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "a long, b long")


def _cells(members: DataFrame, block: int, block_shingles: int) -> DataFrame:
    """(kind, group, x, y, place, node, root): the rows of (kind, group, node, size, root, other) dealt to pairs of blocks.

    Others meet each other and those that are not other; the latter do not meet each other.
    """
    group = ["kind", "group"]
    blocks = lambda who: F.coalesce(F.ceil(F.greatest(F.count(F.when(who, 1)) / block, F.sum(F.when(who, F.col("size"))) / block_shingles)), F.lit(0)).cast("int")
    counts = members.groupBy(*group).agg(F.count("*").alias("n"), blocks(F.col("other")).alias("n_other"), blocks(~F.col("other")).alias("n_rest"))
    rows = members.join(counts.filter("n > 1 AND n_other > 0"), group)
    h = F.xxhash64("node", F.lit(1))
    rows = rows.withColumn("place", F.when(F.col("other"), F.pmod(h, F.greatest("n_other", F.lit(1)))).otherwise(F.col("n_other") + F.pmod(h, F.greatest("n_rest", F.lit(1)))).cast("int"))
    meets = F.sequence(F.lit(0), F.col("n_other") - 1 + F.when(F.col("other"), F.col("n_rest")).otherwise(0))
    rows = rows.withColumn("meets", F.explode(meets))
    return rows.select(*group, F.least("place", "meets").alias("x"), F.greatest("place", "meets").alias("y"), "place", "node", "root")


def _links(nodes: DataFrame, families: DataFrame, company: DataFrame, sets: DataFrame, similarity: float, block: int, block_shingles: int, family: int, rows: int) -> DataFrame:
    """(node, root) of the components that all similar pairs of nodes that share a group make."""
    placed = cut(families.join(company, "node", "left").select("node", F.coalesce("company", F.lit(0)).alias("company"), "family").join(sets.select("node", "size"), "node"), rows)
    # pairs of the family, and of the groups that all keys make of it, as the early ones tell
    n, pairs = F.count("*").cast("double"), F.sum("company") * F.lit(float(EARLY))
    sized = placed.groupBy("family").agg(((n > family) & (n * n > pairs)).alias("apart"))
    large = placed.join(sized.filter("apart"), "family").select("node", "size", "company")
    whole = placed.join(sized.filter("NOT apart"), "family").select(F.lit(0).alias("kind"), F.col("family").alias("group"), "node", "size", "company")
    if not large.isEmpty():
        shared = _groups(nodes.join(large.select("node"), "node", "left_semi"), similarity, rows)
        whole = whole.union(shared.join(large, "node").select(F.lit(1).alias("kind"), F.col("key").alias("group"), "node", "size", "company"))
    members = cut(whole, rows)

    group = ["kind", "group"]
    many = members.groupBy(*group).agg(F.count("*").alias("n"), F.max(F.struct("company", "node")).alias("most")).filter(F.col("n") > block)
    first = members.join(many.select(*group, F.col("most.node").alias("pivot")), group).select(*group, "node", "size", F.col("node").alias("root"), (F.col("node") == F.col("pivot")).alias("other"))
    edges = cut(_compare(_cells(first, block, block_shingles), sets, similarity), rows)
    rooted = cut(members.join(components(edges, rows), "node", "left").select(*group, "node", "size", F.coalesce("root", "node").alias("root")), rows)
    largest = rooted.groupBy(*group, "root").agg(F.count("*").alias("part")).groupBy(*group).agg(F.sum("part").alias("n"), F.max(F.struct("part", "root")).alias("most"))
    rest = rooted.join(largest.filter(F.col("n") > block).select(*group, F.col("most.root").alias("main")), group, "left").select(*group, "node", "size", "root", (F.col("main").isNull() | (F.col("root") != F.col("main"))).alias("other"))
    return components(edges.union(_compare(_cells(rest, block, block_shingles), sets, similarity)).distinct(), rows)


def drop_resembling(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES, family: int = FAMILY) -> DataFrame:
    """docs with one document of each group that pairs of that Jaccard similarity connect: the row with the smallest doc_id.

    Null ids come last, then content decides. All columns stay as they are, whatever their names and types. Of repeated rows
    one stays. Null texts are empty, and texts without words are equal. An empty table gives no rows.
    """
    workers_find_us(docs.sparkSession)
    named = identified(docs)
    text = F.col("doc.text").cast("string").alias("text")
    rows = cut(_sketches(named.select("id", "h", text), shingle, similarity))
    n = rows.count()
    nodes = cut(rows.filter("bits IS NOT NULL").select("node", "bits", "small").dropDuplicates(["node"]), n)
    families, company = _families(nodes, similarity, n)
    families = cut(families, n)
    # one row stands for each node
    wanted = few_or_not(families.select("node"))
    chosen = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "h")).alias("r"))
    chosen = few_or_not(cut(chosen.select(F.col("r.id").alias("id_"), F.col("r.h").alias("h_")), n))
    texts = named.join(chosen, F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left_semi").select(text)
    sets = cut(_sets(texts, shingle).dropDuplicates(["node"]), n)
    found = _links(nodes, families, company, sets, similarity, block, block_shingles, family, n)
    return first_of_each(named, rows.join(found, "node", "left").select("id", "h", F.coalesce("root", "node").alias("root")), n)
