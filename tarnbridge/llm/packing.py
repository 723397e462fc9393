"""Best-fit packing of token pieces into sequences of a fixed length.

Bounded-space online best-fit: pieces arrive one by one; each goes to the open bin that it fills best. A fixed number
of bins is open at a time. A bitset has one bit for each free space that some open bin has, so the best bin is the
lowest set bit at or above the piece's length. Where a new bin is needed and all places are taken, the fullest closes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import workers_find_us
from .token_ids import encoder, slices

#: Pieces in one batch that leaves a task, so that its ids stay below 2 GB; documents that one task packs at least.
MOST_PIECES, DOCS_PER_TASK = 65_536, 50_000


class BestFit:
    """place(length) -> (bin number, offset in it). Keeps at most open_bins bins, however many pieces come."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.room = capacity, open_bins
        self.bits, self.bins, self.n_open, self.next = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return number

    def _lowest(self, at_least: int) -> int:
        above = self.bits >> at_least
        return at_least + (above & -above).bit_length() - 1 if above else -1

    def place(self, length: int) -> tuple[int, int]:
        if not 0 <= length <= self.capacity:
            raise ValueError(f"a piece has {length} tokens; a sequence takes {self.capacity}")
        free = self._lowest(length)
        if free >= 0:
            number = self._take(free)
        else:
            number, free = self.next, self.capacity
            self.next += 1
        left = free - length
        if left:
            if self.n_open == self.room:
                self._take(self._lowest(1))
            self.bins[left].append(number)
            self.bits |= 1 << left
            self.n_open += 1
        return number, self.capacity - free


def cut_into_pieces(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document's place, piece, start, length) of the pieces of documents of these sizes: only the first piece may be short."""
    pieces = -(-sizes // capacity)
    row = np.repeat(np.arange(len(sizes)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = (sizes - (pieces - 1) * capacity)[row]
    return row, piece, np.where(piece == 0, 0, first + (piece - 1) * capacity), np.where(piece == 0, first, capacity)


def token_pieces(docs: DataFrame, tokenizer: str, kind: str = "byte", capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", as_crc: bool = False) -> DataFrame:
    """One row for each piece of each document: (id, piece, start, length, ids as little-endian unsigned 32-bit).

    With as_crc the ids' CRC-32 comes in place of the ids, so that these need not move: ids_crc32 (long).
    A null text is empty: its only id is end_id. Only a document of more than capacity ids is cut; then all pieces but
    the first are full. Repeated rows and null ids are documents of their own; other columns are left out.
    """
    workers_find_us(docs.sparkSession)
    last = T.StructField("ids_crc32", T.LongType()) if as_crc else T.StructField("ids", T.BinaryType())
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), last])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ended = encoder(tokenizer, kind).ended
        for part in (part for batch in batches for part in slices(batch, 1)):
            ids, sizes = ended(part.column(1), end_id)
            all_pieces = cut_into_pieces(sizes, capacity)
            data, all_ends = memoryview(ids).cast("B"), 4 * np.cumsum(all_pieces[3])
            for at in range(0, len(all_ends), MOST_PIECES):
                row, piece, start, length = (x[at : at + MOST_PIECES] for x in all_pieces)
                ends = all_ends[at : at + MOST_PIECES]
                begins = ends - 4 * length
                if as_crc:
                    values = pa.array([crc32(data[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.int64())
                else:
                    offsets = np.append(begins, ends[-1]) - begins[0]
                    values = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[begins[0] : ends[-1]])])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), values], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def tasks_for(docs: DataFrame) -> int:
    """In how many tasks to pack the pieces of docs. Each task leaves some bins half full, so few documents need few tasks."""
    return max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // DOCS_PER_TASK)))


def pack(pieces: DataFrame, capacity: int = 1024, open_bins: int = 2048, length_col: str = "length", key_cols: tuple[str, ...] = ("doc_id", "piece"), tasks: int | None = None) -> DataFrame:
    """pieces with sequence_id (long) and offset (long); all other columns go along, old ones of these two names do not.

    Pieces are dealt out and ordered by a hash of key_cols, so each task sees lengths in random order, which bounded
    best-fit packs well, and sees the same pieces in the same order if it runs again. A task holds open_bins bins and
    one batch; tasks says how many there are (None: as Spark sets it). Sequence ids are unique across tasks. A null length counts as 0; one over capacity is an error.
    """
    workers_find_us(pieces.sparkSession)
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    schema = T.StructType([*(pieces.schema[c] for c in kept), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, first = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 36
        at = kept.index(length_col)
        for batch in batches:
            placed = [best.place(n or 0) for n in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([first + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], names=[*kept, "sequence_id", "offset"])

    order = F.xxhash64(*key_cols)
    dealt = pieces.select(*[F.col(f"`{c}`") for c in kept]).repartition(*([tasks] if tasks else []), order)
    return dealt.sortWithinPartitions(order, *key_cols, length_col).mapInArrow(run, schema)
