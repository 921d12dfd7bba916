"""Uploads as a stream: pages of a document arrive over any number of batches; whole ones become searchable, late ones fail."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import constants as K
from ..operators.passages import passages
from ..plans.index import KEYS, index_store, store_index
from ..sources.pages import PAGES, ingest_status, numbered_pages
from ..sources.scratch import stored

#: Pages of uploads: `pages` says how many the document has.
UPLOADS = StructType([*PAGES, StructField("pages", LongType())])
LATE = "Some pages of this PDF did not arrive."
_EVENT = "document_id long, state string, ordinal long, page_number double, text string"
STATES = "document_id long, status string, error string, page_count long, chunk_count long, embedding_mode string"


class Gather(StatefulProcessor):
    """The pages of one document until all are there, each ordinal once, whichever batch brings it. Then they are given out
    together and forgotten; pages that come afterwards are another upload of the document. What isn't whole when its time
    is over is given out as late, without pages. A document's pages are held while it is being read, no longer."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getListState("pages", "ordinal long, page_number double, text string")
        self.seen = handle.getValueState("seen", "ordinals array<long>, expected long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ordinals, expected, timer = self.seen.get() if self.seen.exists() else ([], 0, 0)
        known = set(ordinals)
        if not timer:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
            self.handle.registerTimer(timer)
        for part in rows:
            new = []
            for r in part.itertuples(index=False):
                if pd.isna(r.ordinal) or r.ordinal in known:
                    continue
                known.add(int(r.ordinal))
                new.append((int(r.ordinal), float("nan") if pd.isna(r.page_number) else float(r.page_number), r.text if isinstance(r.text, str) else ""))
                expected = max(expected, 0 if pd.isna(r.pages) else int(r.pages))
            if new:
                self.pages.appendList(new)
        if expected and len(known) >= expected:
            held = sorted(self.pages.get())
            yield pd.DataFrame([(key[0], "whole", *p) for p in held], columns=["document_id", "state", "ordinal", "page_number", "text"])
            self._forget(timer)
        else:
            self.seen.update((sorted(known), expected, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            yield pd.DataFrame({"document_id": [key[0]], "state": ["late"], "ordinal": [0], "page_number": [0.0], "text": [None]})
            self._forget(0)

    def _forget(self, timer: int) -> None:
        if timer:
            self.handle.deleteTimer(timer)
        self.pages.clear()
        self.seen.clear()

    def close(self) -> None:
        pass


def upload_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(UPLOADS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _store(out: str, stream: str, embedder: str, then: Callable[[SparkSession], object] | None):
    def write(batch: DataFrame, number: int) -> None:
        take(batch, number)
        if then is not None:
            then(batch.sparkSession)

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = index_store(spark, out)
        if store.note(stream) >= number:
            return  # this batch has been committed already; its commit and its number are one act
        events = stored(batch, "events")
        due = events.select("document_id").distinct()
        if due.isEmpty():
            return
        whole = events.where("state = 'whole'")
        numbered = stored(numbered_pages(whole.select("document_id", "ordinal", "page_number", "text")), "numbered")
        made = stored(passages(numbered), "passages")
        late = events.where("state = 'late'").join(whole.select("document_id"), "document_id", "left_anti").select("document_id").distinct()
        read = ingest_status(due.join(late, "document_id", "left_anti"), numbered, made).withColumn("embedding_mode", F.when(F.col("status") == "ready", embedder))
        none = F.lit(None)
        failed = late.select("document_id", F.lit("failed").alias("status"), F.lit(LATE).alias("error"), none.cast("long").alias("page_count"), none.cast("long").alias("chunk_count"), none.cast("string").alias("embedding_mode"))
        states = stored(read.select(failed.columns).unionByName(failed), "states")
        ready = states.where("status = 'ready'").select("document_id")
        mine = made.join(ready, "document_id", "left_semi")
        shown = numbered.join(ready, "document_id", "left_semi").withColumn("text", F.substring("text", 1, K.PAGE_CHARS))
        beside = {"pages": shown, "places": mine.select(*KEYS, "page_number", "token_count"), "states": states}
        store_index(mine, out, embedder, due, beside, note=(stream, number))

    return write


def ingest_uploads(pages: DataFrame, out: str, checkpoint: str, wait: int = 3600, embedder: str = K.EMBEDDER, then: Callable[[SparkSession], object] | None = None) -> StreamingQuery:
    """Index documents as their pages (UPLOADS) arrive, over as many batches as they take; under out is what ingest() writes,
    and `states`, the last state of each document that has one: ready, or failed with its error. A document of which `wait`
    seconds after its first page some are missing has failed; its pages may come again.

    Pages are kept in the stream's state by document. A batch's whole documents, their index, the states and the batch's
    number are one commit of the store, so a restart neither loses nor repeats any. Rows without a document are left out.
    Times are looked at when a batch comes: what is late fails with the next pages of any document. then: called after each
    batch is stored, and once more where a batch is run again; it brings standing questions up to date, say.
    """
    spark = pages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # With batches of no data, which processing-time timers ask for without end, a stream of what is there now never ends.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    events = pages.where("document_id is not null").groupBy("document_id").transformWithStateInPandas(Gather(wait * 1000), _EVENT, "Append", "ProcessingTime")
    return events.writeStream.foreachBatch(_store(out, checkpoint, embedder, then)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upload_states(spark: SparkSession, out: str, documents: DataFrame) -> DataFrame:
    """(document_id, status, error, page_count, chunk_count, embedding_mode) of documents: processing until there is another."""
    known = index_store(spark, out).read("states")
    rest = [F.coalesce("status", F.lit("processing")).alias("status"), "error", "page_count", "chunk_count", "embedding_mode"]
    return documents.select("document_id").join(known, "document_id", "left").select("document_id", *rest)
