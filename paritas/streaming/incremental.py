"""Checks of changes as they arrive: the keys of each micro-batch are compared against the other side."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paritas.operators.diff import join_diff
from paritas.operators.sets import lookup


def changed_diff(changes: DataFrame, source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Differences of the keys among changes only."""
    wanted = changes.select(*keys).distinct()
    return join_diff(lookup(source, wanted, keys), lookup(target, wanted, keys), keys, columns)


def watch(changes: DataFrame, source: Callable[[], DataFrame], target: Callable[[], DataFrame], keys: Sequence[str], columns: Sequence[str], write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """A query that hands write the differences of each micro-batch of changes, with the batch's number.

    A batch that is run again after a failure has the same number, by which write can replace what it wrote before.
    """

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            write(changed_diff(held, source(), target(), keys, columns).withColumn("batch", F.lit(number)), number)
        finally:
            held.unpersist()

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
