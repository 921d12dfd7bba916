"""Pages as a stream: each micro-batch is cleaned, split and appended, once for each batch number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.passages import passages
from ..sources.pages import PAGES, numbered_pages

PASSAGES = "document_id long, page_number long, chunk_index int, text string, token_count int, batch long"


def page_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PAGES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def ingest_stream(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Passages of all pages that arrive, as Parquet under out/batch=N. A document's pages must arrive in one batch, in one
    file, say: passages are numbered through a document. A batch with more pages of a document that an earlier one had
    stops the stream with a ValueError, rather than number its passages anew.

    A batch that is run again overwrites its own folder, so a restart neither loses nor repeats passages.
    """

    def write(batch: DataFrame, number: int) -> None:
        made = passages(numbered_pages(batch))
        spark = batch.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            before = stored_passages(spark, out, number)
            again = before.join(batch.select("document_id").distinct(), "document_id", "left_semi").select("document_id").first()
            if again is not None:
                raise ValueError(f"document {again[0]} has come in two batches")
        made.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_passages(spark: SparkSession, out: str, below: int | None = None) -> DataFrame:
    """What is stored, of batches below a number if one is given."""
    kept = spark.read.schema(PASSAGES).option("basePath", out).parquet(out)
    return (kept if below is None else kept.where(F.col("batch") < below)).drop("batch")
