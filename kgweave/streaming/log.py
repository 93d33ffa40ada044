"""Logs that grow by streams: every record once, whatever is killed and started again, and tasks that are left to do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from kgweave.operators.evaluation import remaining
from kgweave.sources.versioned import Versions


def append_stream(records: DataFrame, store: Versions, table: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append a stream's rows, or what ``work`` makes of each micro-batch, to a table of ``store``; runs until the input is used up.

    A micro-batch becomes one version, marked with the checkpoint and the batch's number. What the checkpoint has not
    noted when the driver dies is done again with the same number and rows, and where its version is already there it is
    not taken again. A batch that died half-way leaves only files that no version names.
    """

    def commit(batch: DataFrame, number: int) -> None:
        store.publish({table: work(batch) if work else batch}, append=True, mark=(checkpoint, number))

    return records.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resume_stream(tasks: DataFrame, store: Versions, table: str, keys: list[str], is_error: Column, answer: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Answer a stream of tasks: those whose keys have a record without error are passed over, as are repeats within a batch."""

    def work(batch: DataFrame) -> DataFrame:
        todo = batch.dropDuplicates(keys)
        return answer(remaining(todo, store.read(table), keys, is_error) if table in store.manifest()["tables"] else todo)

    return append_stream(tasks, store, table, checkpoint, work)
