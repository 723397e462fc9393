"""Near copies by 64-bit SimHash.

Fingerprints are compared by pigeonhole blocks: 64 bits are split into 6 blocks; two fingerprints that differ in 2 bits
or fewer agree in at least 4 of them, so they share one of the 15 keys made of 4 blocks. Fingerprints join on keys and
the Hamming distance is verified. Equal fingerprints are one node, so copies cost no pairs. Where one key holds more
than DENSE fingerprints, no pairs are made: its members list the fingerprints one bit away, and those that list the
same one are within 2 bits of each other, which gives the same links in linear space.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, few_files, first_of_each, freed, identified, workers_find_us

SEED, BITS, BLOCKS, DENSE = 42, 64, 6, 48


def simhash(text: bytes, shingle: int = 3) -> int:
    """Signed 64-bit SimHash over XXH64 of word shingles, A-Z lower-cased; no words: zero."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = [xxh64_intdigest(x, SEED) for x in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))]
    ones, h = np.zeros(BITS, np.int64), np.array(hashes, "<u8")
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp long, *keep) for every row; a null text is empty, an empty text has fingerprint 0."""
    workers_find_us(docs.sparkSession)
    names = ["doc_id", *keep]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(docs.schema[c] for c in keep), T.StructField("fp", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            fps = [simhash((t.as_py() or "").encode(), shingle) for t in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(fps, pa.int64())], names=[*names, "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _masks(blocks: int, distance: int) -> list[int]:
    """Signed masks of all choices of blocks - distance blocks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [int(np.uint64(sum(block[i] for i in c)).astype(np.int64)) for c in combinations(range(blocks), blocks - distance)]


def _apart(a: str | Column, b: str | Column) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(nodes: DataFrame, distance: int = 2, blocks: int = BLOCKS, dense: int = DENSE, rows: int | None = None) -> DataFrame:
    """(a, b), a < b, over distinct fingerprints (fp): enough links to connect all that are within distance of each other.

    Links inside keys with at most dense members are complete. In denser keys, with distance 2, members are linked
    through the fingerprints they both are one bit away from; for other distances, keys of more blocks are needed.
    """
    if distance != 2:
        raise ValueError("dense keys are resolved for a distance of 2")
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(blocks, distance)])).alias("k", "key"))
    sizes = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(keyed.join(sizes, ["k", "key"]), rows)
    few = shared.filter(F.col("n") <= dense)
    a, b = few.select("k", "key", F.col("fp").alias("a")), few.select("k", "key", F.col("fp").alias("b"))
    near = a.join(b, ["k", "key"]).filter((F.col("a") < F.col("b")) & (_apart("a", "b") <= distance)).select("a", "b")
    flips = [0, *(1 << i for i in range(BITS - 1)), -(1 << (BITS - 1))]
    many = shared.filter(F.col("n") > dense).select("fp").distinct()
    listed = many.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in flips])).alias("mid"))
    first = listed.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("mid", "a")
    middle = listed.join(first, "mid").filter("a < fp").select("a", F.col("fp").alias("b"))
    return near.union(middle).distinct()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root): root is the smallest node reachable. Alternating large and small stars; each round is written to shared files. rows: about how many edges there are, if known."""
    edges, before = cut(edges.select("a", "b"), rows), None
    while True:
        total = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if tuple(total) == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = tuple(total)
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = large.filter("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).filter("x < y")
        edges = cut(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), total[0], work=False)


def group_near_copies(docs: DataFrame, shingle: int = 3, distance: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, fp, root, component_id) for every row: component_id is the smallest doc_id reachable over links.

    Empty and null texts have fingerprint zero and link like any other. Repeated rows come back as often as they come.
    A row without a doc_id takes part; component_id is null only if no row of its component has one.
    """
    rows = cut(fingerprints(docs, shingle, keep=keep))
    n = rows.count()
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), n)
    found = components(links(nodes.select("fp"), distance, rows=n), n)
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(least, "root").select("fp", "root", "component_id")
    return few_files(rows.join(by_fp, "fp").select("doc_id", *keep, "fp", "root", "component_id"), n)


def drop_near_copies(docs: DataFrame, distance: int = 2, shingle: int = 3) -> DataFrame:
    """docs with one document of each group of near copies: the row with the smallest doc_id (nulls last, then by content).

    All columns stay as they are, whatever their names and types. Of repeated rows one stays. An empty table gives no rows.
    """
    named = identified(docs)
    rows = named.select("id", "h", F.col("id").alias("doc_id"), F.col("doc.text").alias("text"))
    return first_of_each(named, group_near_copies(rows, shingle, distance, keep=("id", "h")).select("id", "h", "root"), docs.count())
