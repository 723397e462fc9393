"""Token ids as Arrow files of equal-length sequences.

Each file is an Arrow file (the stream of record batches with a footer) whose rows are fixed-size lists: `ids`, and a
`mask` that is true where a place holds an id. A memory-mapped reader gets any sequence by its number without copying.
All batches but a file's last have the same number of rows, so a sequence's batch follows from its number. A second
file holds where each document starts in the first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, workers_find_us
from .token_ids import encoder, slices

SEQUENCE, BATCH_ROWS = 2048, 64


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


class SequenceWriter:
    """Appends ids to one file; holds one batch of sequences in memory."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str, length: int, dtype: str):
        self.length, self.dtype, self.parts, self.held = length, np.dtype(dtype), [], 0
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = fs.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.file, self.schema)

    def append(self, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > np.iinfo(self.dtype).max:
            raise ValueError(f"id {ids.max()} does not fit in {self.dtype}")
        self.parts.append(ids.astype(self.dtype))
        self.held += len(ids)
        if self.held >= self.length * BATCH_ROWS:
            self._write(self.held // (self.length * BATCH_ROWS) * self.length * BATCH_ROWS)

    def _write(self, n: int) -> None:
        ids = np.concatenate(self.parts) if self.parts else np.empty(0, self.dtype)
        now, rest = ids[:n], ids[n:]
        self.parts, self.held = [rest], len(rest)
        for at in range(0, len(now), self.length * BATCH_ROWS):
            some = now[at : at + self.length * BATCH_ROWS]
            pad = -len(some) % self.length
            mask = np.concatenate([np.ones(len(some), bool), np.zeros(pad, bool)])
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (np.concatenate([some, np.zeros(pad, self.dtype)]), mask)]
            self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._write(self.held)
        self.writer.close()
        self.file.close()


class SequenceFile:
    """Random access to the sequences of one file, and to runs of ids across them."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str):
        self.source = pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self._at, self._ids = -1, np.empty(0)

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and mask of a sequence."""
        batch = self.reader.get_batch(number // BATCH_ROWS)
        ids, mask = (batch.column(c)[number % BATCH_ROWS].values.to_numpy(zero_copy_only=not c) for c in (0, 1))
        return ids, mask

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from place start on, as little-endian unsigned 32-bit."""
        per, parts = self.length * BATCH_ROWS, []
        while n > 0:
            if start // per != self._at:
                self._at = start // per
                self._ids = self.reader.get_batch(self._at).column(0).flatten().to_numpy()
            part = self._ids[start % per : start % per + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(parts).astype("<u4") if parts else np.empty(0, "<u4")

    def close(self) -> None:
        self.source.close()


def write_ids(docs: DataFrame, folder: str, tokenizer: str, kind: str = "word", end_id: int = 2, length: int = SEQUENCE, dtype: str = "uint16", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes docs in ascending id order and writes the files; returns the manifest: (part, path, index, n_docs, n_ids).

    Nulls come first among ids, rows of one id in the order of their text's hash; a null text is empty and has the end id only.
    Ranges of (id, hash) are dealt out, so no task gets the whole; each writes two files of its own under folder, which
    all executors must reach. A task that runs again writes new files; the manifest names those of the one that counts.
    The manifest has one row for each task and is itself written under folder.
    """
    spark = docs.sparkSession
    workers_find_us(spark)
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        part, name = TaskContext.get().partitionId(), uuid4().hex
        ended, writer, n_docs, n_ids = encoder(tokenizer, kind).ended, None, 0, 0
        for batch in batches:
            if writer is None:
                fs.create_dir(root, recursive=True)
                paths = [f"{root}/part-{part:06d}-{name}.{x}" for x in ("ids.arrow", "docs.arrow")]
                writer = SequenceWriter(fs, paths[0], length, dtype)
                index_file = fs.open_output_stream(paths[1])
                index_schema = pa.schema([("doc_id", batch.schema.field(0).type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                index = pa.ipc.new_file(index_file, index_schema)
            for docs_ in slices(batch, 1):
                ids, sizes = ended(docs_.column(1), end_id)
                writer.append(ids)
                index.write_batch(pa.record_batch([docs_.column(0), pa.array(n_ids + np.cumsum(sizes) - sizes), pa.array(sizes)], schema=index_schema))
                n_ids += len(ids)
                n_docs += docs_.num_rows
        if writer is not None:
            writer.close()
            index.close()
            index_file.close()
            yield pa.record_batch([pa.array([part], pa.int64()), pa.array([paths[0]]), pa.array([paths[1]]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], names=["part", "path", "index", "n_docs", "n_ids"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = docs.select(F.col(id_col).cast(id_type).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    rows.mapInArrow(run, "part long, path string, index string, n_docs long, n_ids long").write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_ids(manifest: DataFrame, folder: str, id_type: T.DataType, as_crc: bool = False) -> DataFrame:
    """For each document in the files: doc_id, start (ids of all documents before it), n_tokens, and ids (array) or ids_crc32."""
    spark = manifest.sparkSession
    workers_find_us(spark)
    # one row for each file
    files = manifest.orderBy("part").collect()
    base, based = 0, []
    for f in files:
        based.append((f["path"], f["index"], base))
        base += f["n_ids"]
    last = T.StructField("ids_crc32", T.LongType()) if as_crc else T.StructField("ids", T.ArrayType(T.LongType()))
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), last])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                data = SequenceFile(fs, row["path"])
                with fs.open_input_file(row["index"]) as f:
                    index = pa.ipc.open_file(f)
                    for i in range(index.num_record_batches):
                        docs = index.get_batch(i)
                        spans = list(zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True))
                        for at in range(0, len(spans), 256):
                            ids = [data.ids(s, n) for s, n in spans[at : at + 256]]
                            out = pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()) if as_crc else pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))
                            some = docs.slice(at, 256)
                            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([row["base"] + s for s, _ in spans[at : at + 256]], pa.int64()), some.column(2), out], names=schema.names)
                data.close()

    listed = spark.createDataFrame(based, "path string, index string, base long")
    return listed.repartition(max(1, len(based))).mapInArrow(run, schema)


def ids_folder(spark) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/token-ids-{uuid4().hex}"
