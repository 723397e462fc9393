"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard; at each level the child with the largest draw wins. A shard's draw is a hash
of (document, shard) scaled by the shard's weight, that of a rack or region is the largest below it. So draws are of
weights that add up, and a changed weight moves documents only into or out of the shards whose weights change, also
through the levels above them: a shard that comes takes documents only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import few_files


@dataclass(frozen=True)
class Node:
    """A shard (with its number), or a rack or region with children. weight is a shard's own; others have their children's sum."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


    @property
    def shards(self) -> list[Node]:
        return [x for c in self.children for x in c.shards] if self.children else [self]


def even_tree(shards: int, racks: int = 2, per_rack: int = 2) -> Node:
    """Regions of racks of shards. A shard's number says its region and rack for good."""
    if shards < 1:
        raise ValueError("a tree needs a shard")
    per_region = racks * per_rack
    regions = []
    for r in range(-(-shards // per_region)):
        leaves = [Node(f"shard{s}", shard=s) for s in range(r * per_region, min(shards, (r + 1) * per_region))]
        regions.append(Node(f"region{r}", tuple(Node(f"region{r}/rack{k}", tuple(leaves[k * per_rack : (k + 1) * per_rack])) for k in range(-(-len(leaves) // per_rack)))))
    return Node("root", tuple(regions))


def _draw(key: Column, shard: Node) -> Column:
    """ln(u) / weight with u in (0, 1) from a hash of key and the shard's name."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard.name)), 11).cast("double") + 0.5) / float(1 << 53)
    return F.ln(u) / F.lit(float(shard.own))


def with_shards(rows: DataFrame, key: Column, trees: dict[str, Node]) -> DataFrame:
    """rows with a column (int) for each tree: the shard that key comes to. Trees share the draws of shards of one name and weight.

    A row costs one hash for each shard. Ties, which need equal 53-bit hashes, go to the first child. A tree in which no
    shard has weight is an error.
    """
    shards = list(dict.fromkeys((x.name, x.own, x) for tree in trees.values() for x in tree.shards if x.own > 0))
    place = {(name, own): i for i, (name, own, _) in enumerate(shards)}
    draws = F.col("__draws")

    def best(node: Node) -> Column:
        below = [draws[place[x.name, x.own]] for x in node.shards if x.own > 0]
        return F.greatest(*below) if len(below) > 1 else below[0]

    def descend(node: Node) -> Column:
        if not node.children:
            return F.lit(node.shard).cast("int")
        children = [c for c in node.children if c.weight > 0]
        if not children:
            raise ValueError(f"{node.name} has no weight")
        out = descend(children[-1])
        for child in reversed(children[:-1]):
            out = F.when(best(child) == best(node), descend(child)).otherwise(out)
        return out

    drawn = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"), F.array(*[_draw(key, x) for *_, x in shards]).alias("__draws"))
    return drawn.select("__row.*", *[descend(tree).alias(name) for name, tree in trees.items()])


def shard_documents(docs: DataFrame, tree: Node, grown: Node | None = None, id_col: str = "doc_id", text_col: str = "text", run: int = 4096, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each row: doc_id, size, text_crc32, shard, slot, grown_shard, *keep.

    size: UTF-8 bytes of the text (null: none) plus 1. slot: the row's place in its shard, from 0 without gaps.
    The id alone decides the shard; rows of one id, and those without one, share a shard, and repeated rows each get a
    slot. Slots are counted in runs of about `run` rows by a hash, whose sizes are summed first, so no shard's rows
    meet in one task.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("__key"), *keep)
    rows = with_shards(rows, F.col("__key"), {"shard": tree, **({"grown_shard": grown} if grown else {})}).drop("__key")
    rows = rows if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    n = docs.count()
    runs = max(1, min(1 << 20, -(-n // run)))
    rows = rows.withColumn("__run", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(7)), F.lit(runs)))
    sizes = rows.groupBy("shard", "__run").agg(F.count("*").alias("__n"))
    before = sizes.select("shard", "__run", (F.sum("__n").over(W.partitionBy("shard").orderBy("__run")) - F.col("__n")).alias("__before"))
    placed = rows.withColumn("__place", F.row_number().over(W.partitionBy("shard", "__run").orderBy("doc_id", "text_crc32", "size")))
    return few_files(placed.join(before, ["shard", "__run"]), n).select("doc_id", "size", "text_crc32", "shard", (F.col("__before") + F.col("__place") - 1).alias("slot"), "grown_shard", *keep)
