"""Extension: a stream of changes into a store, each micro-batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..store import Store


def ingest(changes: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """``changes`` (key, value, seq, is_delete): the change with the highest seq of a key counts, in whichever micro-batch it comes (see Store.write_log). A batch
    run again changes nothing."""

    def apply(batch: DataFrame, _: int) -> None:
        store.write_log(batch)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
