"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII letters, for lower-casing A-Z and nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is neither an ASCII letter or digit nor outside ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z. Pure ASCII texts take the fast built-in; in others only A-Z may change, so they are translated."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Lower-cased words of a non-null text: runs of ASCII letters, digits and all characters outside ASCII."""
    return F.array_remove(F.split(lower_ascii(text), NOT_WORD), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. One of our own only where none is set and all run on one machine, as in tests."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="tarnbridge-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to


#: Rows in one file of a written frame, where their number is known; and rows that a task with work to do should have at least.
ROWS_A_FILE, ROWS_A_TASK = 250_000, 5_000


def few_files(df: DataFrame, rows: int, work: bool = True) -> DataFrame:
    """df in no more partitions than so many rows are worth: each file that is written costs several calls of the file system.

    With work, the last stage computes something: it keeps two tasks for each core, and small tasks however many rows there are.
    """
    least = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(1 + rows // ROWS_A_TASK, least) if work else 1 + rows // ROWS_A_FILE)


def cut(df: DataFrame, rows: int | None = None, work: bool = True) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the files, so that lost executors cost no recomputation.

    rows: about how many it has, if that is known; few need few files.
    """
    shared_dir(df.sparkSession)
    return (df if rows is None else few_files(df, rows, work)).checkpoint()


#: Rows that are broadcast at most.
FEW = 500_000


def few_or_not(df: DataFrame, few: int = FEW) -> DataFrame:
    """df, to be broadcast if it has at most `few` rows; else joins shuffle it. df is counted, so it should be written."""
    return F.broadcast(df) if df.count() <= few else df


def _hashable(field: T.StructField) -> Column:
    """A column that xxhash64 takes: maps, at any depth, as JSON."""
    c = F.col(f"`{field.name}`")
    return F.to_json(F.struct(c)) if "map<" in field.dataType.simpleString() else c


def identified(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc struct, id, h): each row as it is, its id, and a 64-bit hash of its content. Names inside doc clash with nothing."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(*[_hashable(f) for f in docs.schema]).alias("h"))


def first_of_each(named: DataFrame, rooted: DataFrame, rows: int) -> DataFrame:
    """The documents of identified rows `named` that come first among those of their root: by id, nulls last, then by content.

    rooted: (id, h, root) of every row, about `rows` of them. Of repeated rows one stays. Only the rows that go, and repeated ones, are joined to the
    documents; they are broadcast where they are few.
    """
    rooted = cut(rooted, rows)
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("h").alias("h"))
    groups = rooted.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("rows")).filter("rows > 1").select("root", "first")
    gone = rooted.join(groups, "root").filter(order != F.col("first")).select("id", "h").distinct()
    again = rooted.groupBy("id", "h").agg(F.count("*").alias("rows")).filter("rows > 1").select("id", "h")
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_"))
    gone, again = (cut(x, rows).withColumnsRenamed({"id": "id_", "h": "h_"}) for x in (gone, again))
    out = named.join(few_or_not(gone), same, "left_anti")
    if again.isEmpty():
        return out.select("doc.*")
    again = few_or_not(again)
    once = out.join(again, same, "left_semi").dropDuplicates(["id", "h"])
    return out.join(again, same, "left_anti").select("doc.*").union(once.select("doc.*"))


def workers_find_us(spark: SparkSession) -> None:
    """Python workers import this package by name; tell them where it lies."""
    here, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (here, env.get("PYTHONPATH", "")) if x)


def freed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches; after each one Arrow gives back the memory that it does not use, which would add up over a worker's operators."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
