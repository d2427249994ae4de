"""Incremental processing: micro-batches of files, page states per document, emission on completion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DONE_SCHEMA = "doc_index long, pages long"
STATE_SCHEMA = "seen array<int>, closed boolean"


def file_stream(spark: SparkSession, folder: str, files: int = 16, pattern: str = "*.pdf") -> DataFrame:
    """Files of a folder as they appear; at most `files` a micro-batch, which is the back pressure."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern)
    return stream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).load(folder)


def completed(pages: DataFrame) -> DataFrame:
    """doc_index and pages of each document once its last page is there, from a stream of pages
    (doc_index, page_index, page_count). A page that comes twice counts once, and a document that is
    done isn't given again; its state is then a mark."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, closed = state.get if state.exists else ([], False)
        seen, count = set(seen), 0
        for frame in frames:
            seen.update(frame["page_index"].tolist())
            count = max(count, int(frame["page_count"].max()))
        if closed or len(seen) < count:
            state.update(([] if closed else sorted(seen), closed))
            return
        state.update(([], True))
        yield pd.DataFrame({"doc_index": [key[0]], "pages": [len(seen)]})

    return pages.groupBy("doc_index").applyInPandasWithState(step, DONE_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def run_batches(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process all that is there in micro-batches and stop. A batch that was cut off is given again with
    its number, so `process` has to write by document."""
    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "1 day", time: str = "ts") -> DataFrame:
    """Counts by type in tumbling windows of event time; later rows than the watermark are dropped, as
    is usual for streams. The same on a table of events is a plain aggregation."""
    # a watermark needs times that are points, which those without a zone become by the session's
    windowed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, size).alias("w"), "event_type")
    return windowed.count().select("w.start", "w.end", "event_type", "count")
