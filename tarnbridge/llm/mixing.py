"""Mixing sources to target weights by hierarchical budgeting.

Weights flow down a tree of domains, languages and sources. What a leaf cannot supply within its epochs goes to its
siblings first, and only what a whole subtree cannot supply goes to the ancestors' other children. Each leaf then gives
whole seeded epochs of its documents and the token-prefix of one more.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, workers_find_us
from .token_ids import encoder, slices

#: A leaf is (domain, language, source).
LEVELS = ("domain", "lang", "source")
BYTES_PER_TOKEN = 4
MAX_LEAVES = 100_000


@dataclass
class _Tree:
    supply: int = 0
    children: dict[str, _Tree] = field(default_factory=dict)


def allocate(supplies: Mapping[tuple[str, ...], int], weights: Mapping[tuple[str, ...], float], total: int) -> dict[tuple[str, ...], int]:
    """Tokens for each leaf, at most its supply, together total or all there is. weights: by path prefix; missing is 1.

    A node's budget is shared by weight among its children; a child that would exceed its subtree's supply gets that,
    and the rest is shared anew among its siblings. Whole tokens left over go to the first children with room. What lies
    under a weight of 0 gets nothing and is no supply of the nodes above it.
    """
    root = _Tree()
    for path, n in supplies.items():
        n = n if all(weights.get(path[: i + 1], 1.0) > 0 for i in range(len(path))) else 0
        node = root
        node.supply += n
        for part in path:
            node = node.children.setdefault(part, _Tree())
            node.supply += n

    out: dict[tuple[str, ...], int] = {}

    def give(node: _Tree, path: tuple[str, ...], budget: int) -> None:
        if not node.children:
            out[path] = budget
            return
        names = sorted(node.children)
        got, open_ = dict.fromkeys(names, 0), [n for n in names if weights.get((*path, n), 1.0) > 0]
        left = min(budget, sum(node.children[n].supply for n in open_))
        while open_:
            scale = left / sum(weights.get((*path, n), 1.0) for n in open_)
            full = [n for n in open_ if node.children[n].supply <= weights.get((*path, n), 1.0) * scale]
            if not full:
                for n in open_:
                    got[n] = int(weights.get((*path, n), 1.0) * scale)
                for n in open_:
                    more = min(left - sum(got[k] for k in open_), node.children[n].supply - got[n])
                    got[n] += max(0, more)
                break
            for n in full:
                got[n] = node.children[n].supply
            left -= sum(got[n] for n in full)
            open_ = [n for n in open_ if n not in full]
        for n in names:
            give(node.children[n], (*path, n), got[n])

    give(root, (), min(total, root.supply))
    return out


def token_count(text: Column) -> Column:
    """An estimate without a tokenizer: UTF-8 bytes over BYTES_PER_TOKEN, rounded up, at least 1. Null: 1."""
    return F.greatest(F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / BYTES_PER_TOKEN), F.lit(1)).cast("long")


def with_tokens(docs: DataFrame, tokenizer: str, kind: str = "byte", name: str = "__n_tokens") -> DataFrame:
    """docs with each text's number of ids, the end id included, in the column name. Null: 1.

    Written once to the shared folder and read again, since a mixture reads its documents several times.
    """
    spark = docs.sparkSession
    workers_find_us(spark)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
        counts = encoder(tokenizer, kind).counts
        return pd.Series(np.concatenate([np.empty(0, np.int64), *[counts(x.column(0)) + 1 for x in slices(batch, 0)]]))

    folder = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid4().hex}"
    docs.withColumn(name, count(F.col("text").cast("string"))).write.parquet(folder)
    return spark.read.parquet(folder)


#: Columns that a mixture adds.
ADDED = ("__domain", "__epoch", "__tokens", "__budget")


def mix(docs: DataFrame, domain: Column, weights: Mapping[tuple[str, ...], float], total: int | None = None, share: float | None = None, max_epochs: int = 4, seed: int = 17, tokens: Column | None = None, run: int = 2048) -> DataFrame:
    """docs' rows that the mixture takes, once for each epoch, with __domain, __epoch (from 0), __tokens, __budget.

    tokens: each row's number of tokens; token_count's estimate where none is given. Null ones count as 0.
    The budget is total tokens, or share of all tokens in docs. Null domains, languages and sources are leaves called ''.
    More than MAX_LEAVES leaves are an error: their supplies and budgets pass through the driver.
    A leaf with budget b and n tokens gives b // n whole epochs, and of the next the documents, in the order of a hash
    of (seed, epoch, id, content), whose running total of tokens stays within the rest. Repeated rows are rows of their own
    and stand together in that order. All columns stay, but for those called as the added ones; an empty table gives no
    rows. Running totals come from sums over runs of about `run` documents by hash, so that only the run in which a leaf's
    prefix ends is ordered row by row.
    """
    spark = docs.sparkSession
    leaf = ["__domain", "__lang", "__source"]
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    count = F.coalesce(tokens if tokens is not None else token_count(F.col("text")), F.lit(0)).cast("long")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED]).alias("__row"), name(domain).alias("__domain"), name(F.col("lang")).alias("__lang"), name(F.col("source")).alias("__source"),
        count.alias("__tokens"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__content"),
    )
    leaves = rows.groupBy(*leaf).agg(F.sum("__tokens").alias("t"), F.count("*").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(leaves) > MAX_LEAVES:
        raise ValueError(f"over {MAX_LEAVES} leaves: choose a coarser source")
    have = {tuple(r[c] for c in leaf): r["t"] for r in leaves}
    budget = total if total is not None else int((share if share is not None else 1.0) * sum(have.values()))
    plan = allocate({p: t * max_epochs for p, t in have.items()}, weights, budget)
    bits = min(20, max(0, (max([r["n"] for r in leaves], default=1) // run).bit_length()))

    # at most MAX_LEAVES rows; a leaf without tokens gives each document once
    shares = [(*p, plan[p], *(divmod(plan[p], have[p]) if have[p] else (0, 0))) for p in have]
    wanted = F.broadcast(spark.createDataFrame(shares, "__domain string, __lang string, __source string, __budget long, __whole long, __rest long"))
    # the epoch that is taken in part has an order of its own
    order = F.xxhash64(F.lit(seed), "__whole", "__id", "__content")
    rows = rows.join(wanted, leaf).withColumn("__u", order).drop("__id", "__content")
    rows = rows.withColumn("__run", F.shiftrightunsigned("__u", 64 - bits).cast("long") if bits else F.lit(0).cast("long"))
    sums = rows.groupBy(*leaf, "__run").agg(F.sum("__tokens").alias("__t"), F.first("__rest").alias("__rest"))
    running = sums.withColumn("__upto", F.sum("__t").over(W.partitionBy(*leaf).orderBy("__run")))
    # the run in which the prefix ends: the first whose running total exceeds the rest
    ends = running.filter("__upto > __rest").groupBy(*leaf).agg(F.min(F.struct(F.col("__run").alias("r"), (F.col("__upto") - F.col("__t")).alias("before"))).alias("e"))
    marked = rows.join(F.broadcast(ends.select(*leaf, F.col("e.r").alias("__end"), F.col("e.before").alias("__before"))), leaf, "left")
    cells = F.when(F.col("__end").isNull() | (F.col("__run") < F.col("__end")), F.col("__whole") + 1).otherwise(F.col("__whole"))
    sure = marked.withColumn("__epoch", F.explode(F.when(cells > 0, F.sequence(F.lit(0).cast("long"), cells - 1)).otherwise(F.array().cast("array<bigint>"))))
    last = marked.filter("__run = __end").withColumn("__sum", F.sum("__tokens").over(W.partitionBy(*leaf).orderBy("__u", F.to_json("__row")).rowsBetween(W.unboundedPreceding, 0)))
    last = last.filter("__before + __sum <= __rest").withColumn("__epoch", F.col("__whole"))
    out = ["__row.*", *ADDED]
    return sure.select(*out).union(last.select(*out))
