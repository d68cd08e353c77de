"""Measurements as they arrive: the batch cleaning rules, applied to each micro-batch.

Detection limits are those configured and those known when the stream starts; the least detected
value of a variable can't be known before its data are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from fenmark.operators import ingest
from fenmark.sources.store import Store


def clean_into(stream: DataFrame, store: Store, limits: DataFrame, checkpoint: str, method: str = "limit_div_sqrt2") -> StreamingQuery:
    """Upserts cleaned cells of a stream (sample_id, original_row_index, variable_name, raw_value_text) to cleaned_measurements.

    A later batch's cell replaces an earlier one, whatever its row index, unless it is blank: a blank only comes where nothing is stored.
    A batch's cells and its number become one version of the store, so a micro-batch that is run again after a failure is known and left out.
    Only the buckets that its cells fall in are read, and only the files with a cell that it replaces are written anew.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        if number <= store.done(checkpoint):
            return
        with store.transaction():
            store.merge_cells(ingest.clean(batch, limits, method, use_min_detected=False))
            store.mark(checkpoint, number)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
