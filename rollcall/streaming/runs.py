"""Running verdicts over a stream of numbered rows: the batch operator applied to each micro-batch's groups.

The reference has no streams; this lets the same rules watch an append-only table. A group is judged anew whenever rows of
it arrive, from all rows read so far, so late rows need no watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.assign import run_verdicts


def watch(stream: DataFrame, history: Callable[[], DataFrame], by: Sequence[str], order: Sequence[str], ordinal: str, emit: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that gives emit(verdicts, batch) for the groups that each batch touches."""

    def batch(rows: DataFrame, number: int) -> None:
        touched = rows.select(*by).distinct()
        emit(run_verdicts(history().join(touched, list(by), "left_semi"), by, order, ordinal), number)

    return stream.writeStream.foreachBatch(batch)
