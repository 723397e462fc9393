"""Change batches from a stream: each micro-batch is one statement's change, applied by the operators for changes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.changes import upsert
from ..operators.load import latest


def upsert_stream(changes: DataFrame, key: Sequence[str], order: str, read_target: Callable[[], DataFrame], write_target: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that upserts each micro-batch's last row by key. write_target gets the batch's number, so a repeated batch can be known."""

    def one(batch: DataFrame, number: int) -> None:
        write_target(upsert(read_target(), latest(batch, key, F.col(order).desc()), key), number)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
