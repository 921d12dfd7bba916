"""What ingest derives of passages once, so that a search reads it instead of their texts."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators.headings import heading_words, passage_traits
from ..operators.lexical import postings
from ..operators.vector_index import cell_bounds, clustered
from ..operators.vectors import EMBEDDERS, topical_words
from ..sources.scratch import scratch, stored
from ..sources.versions import Store

KEYS = ("document_id", "chunk_index")


class Index(NamedTuple):
    """passages: (document_id, chunk_index, text). terms: (document_id, chunk_index, token, tf), in order of tokens. sizes:
    (document_id, chunk_index, length), in tokens. vectors: (document_id, chunk_index, cell, slots, weights, embedder), a
    folder for each cell; cells: (cell, slots, high, low, embedder), their bounds. traits: (document_id, chunk_index,
    headings, stems, raw_words, tokens, has_body); headings: (document_id, chunk_index, word), stems of headings."""

    passages: DataFrame
    terms: DataFrame
    sizes: DataFrame
    vectors: DataFrame
    cells: DataFrame
    traits: DataFrame
    headings: DataFrame


def index_store(spark: SparkSession, path: str) -> Store:
    """The store that an index is in, perhaps with other tables beside it."""
    return Store(spark, path, order={"terms": "token", "headings": "word"}, folders={"vectors": "cell"})


def open_index(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """The index of a version, the latest by default. Bounds of cells are of no document: those of rows that are void now
    are bounds still."""
    store = index_store(spark, path)
    return Index(*(store.read(name, version) for name in Index._fields))._replace(cells=store.read("cells", version).drop("document_id"))


def _vectors(passages: DataFrame, embedder: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of passages, made and stored here, once, and the bounds of their cells."""
    words = passages.select(*KEYS, EMBEDDERS[embedder].words(F.col("text")).alias("words"))
    made, name = clustered(words, KEYS, embedder), F.lit(embedder).alias("embedder")
    return made.select("*", name), cell_bounds(made, embedder).select("*", name)


def _by_words(passages: DataFrame) -> dict[str, DataFrame]:
    """The tables that are columns of passages (document_id, chunk_index, text)."""
    own = passages.select(*KEYS, "text")
    # As many tokens as topical words: a token is a topical word's stem.
    sizes = own.select(*KEYS, F.size(topical_words(F.col("text"))).cast("long").alias("length"))
    return {"passages": own, "terms": postings(own, KEYS).sortWithinPartitions("token"), "sizes": sizes, "traits": passage_traits(own, KEYS)}


def store_index(passages: DataFrame, path: str, embedder: str = K.EMBEDDER, documents: DataFrame | None = None, beside: dict[str, DataFrame] | None = None, note: tuple[str, int] | None = None) -> Index:
    """Index passages under a path, at ingest, in one commit with the tables `beside` them: all that is there of their
    documents already is void from then on, other documents stay. documents (document_id): whose passages these are, with
    those that have none any more; by default those that have some."""
    store = index_store(passages.sparkSession, path)
    vectors, cells = _vectors(passages, embedder)
    words = _by_words(passages)
    traits = stored(words["traits"], "traits")
    # Cells are of no document, so they never become void.
    cells = cells.withColumn("document_id", F.lit(None).cast("long"))
    index = {**words, "traits": traits, "headings": heading_words(traits, KEYS), "vectors": vectors, "cells": cells}
    store.commit({**index, **(beside or {})}, passages if documents is None else documents, note)
    return open_index(passages.sparkSession, path)


def compact_index(spark: SparkSession, path: str, **how) -> int | None:
    """Merge segments of like size. Vectors keep their cells, of which those without any go."""

    def again(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        if "vectors" not in tables:
            return tables
        return {**tables, "cells": tables["cells"].join(tables["vectors"].select("cell").distinct(), "cell", "left_semi")}

    return index_store(spark, path).compact(derive=again, **how)


def indexed(passages: DataFrame, embedder: str = K.EMBEDDER) -> Index:
    """The index of passages, each once, in the shared folder."""
    spark, passages = passages.sparkSession, passages.dropDuplicates(list(KEYS))
    path = scratch(spark, "index")

    def write(name: str, table: DataFrame) -> dict[str, DataFrame]:
        table.write.parquet(f"{path}/{name}")
        return {name: spark.read.schema(table.schema).parquet(f"{path}/{name}")}

    def vectors() -> dict[str, DataFrame]:
        made, cells = _vectors(passages, embedder)
        return {"vectors": made, **write("cells", cells)}

    def traits() -> dict[str, DataFrame]:
        made = write("traits", words["traits"])
        return {**made, **write("headings", heading_words(made["traits"], KEYS))}

    words = _by_words(passages)
    # At the same time: none of these needs another, and each alone may leave cores idle.
    with ThreadPoolExecutor(len(Index._fields)) as pool:
        tasks = [pool.submit(vectors), pool.submit(traits), *(pool.submit(write, *item) for item in words.items() if item[0] != "traits")]
        return Index(**{k: v for t in tasks for k, v in t.result().items()})
