"""Standing questions: asked once, answered anew after every commit of a store, from what the commit brought."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators.lexical import query_terms
from ..operators.rollups import Rollups, best_passages, size_rollups, word_rollups
from ..sources.scratch import stored
from ..sources.versions import Store
from .index import KEYS

_FOLLOWED = "followed"
_HIT = ["rank", "hit_document", "chunk_index", "score"]


class Answers(NamedTuple):
    """hits: (query_id, rank, document_id, chunk_index, score) of every question that has any; changed: (query_id) of those
    whose hits differ from the answers before; version: that of the store which they are of."""

    hits: DataFrame
    changed: DataFrame
    version: int


class StandingQuestions:
    """Questions over a store with the index's `terms` and `sizes`, whose ranked passages are kept up to date.

    Under a path of its own this keeps what questions need: postings of the tokens they ask for, with their passages'
    lengths, and roll-ups of all documents. An update reads rows of the segments that came since the last one, and makes
    void what documents had that were stored again or removed; statistics of a scope are sums over roll-ups, so a new
    document changes every score in its scope without any other being read. Of the kept postings, those of documents are
    read that can still be among the best. The result is that of a full search.

    A question with tokens that none had before is caught up with once, by reading those tokens' postings. What is kept
    and the version it is of become visible as one; an update that died is made up by the next one.
    """

    def __init__(self, index: Store, path: str, k: int = K.SEARCH_HITS):
        self.index, self.k, self.spark = index, k, index.spark
        self.kept = Store(index.spark, f"{path}/kept", order={"impacts": "token", "words": "token"})
        self.answers = Store(index.spark, f"{path}/answers")

    def _impacts(self, terms: DataFrame, sizes: DataFrame) -> DataFrame:
        return stored(terms.join(sizes, list(KEYS)).select(*KEYS, "token", "tf", "length"), "impacts")

    def _asked(self) -> DataFrame:
        if "asked" in self.kept.manifest()["schemas"]:
            return self.kept.read("asked").select("token")
        return self.spark.createDataFrame([], "token string")

    def _follow(self, now: dict) -> None:
        """Take over what came since the last update."""
        since = self.kept.note(_FOLLOWED)
        if since >= now["version"] or not now["segments"]:
            return
        documents = self.index.touched(since, now)
        if since < now.get("forgotten", 0):
            # Lists of what was removed since then have been merged away: all is taken over anew.
            held = self.kept.held()
            documents, since = documents if held is None else documents.unionByName(held).distinct(), -1
        sizes = self.index.since("sizes", since, now)
        impacts = self._impacts(self.index.since("terms", since, now).join(self._asked(), "token", "left_semi"), sizes)
        self.kept.commit({"impacts": impacts, "words": word_rollups(impacts), "sizes": size_rollups(sizes)}, documents, (_FOLLOWED, now["version"]))

    def _catch_up(self, terms: DataFrame, now: dict) -> None:
        """Read the postings of tokens that no question had before."""
        fresh = stored(terms.select("token").distinct().join(self._asked(), "token", "left_anti"), "tokens")
        if fresh.isEmpty():
            return
        impacts = self._impacts(self.index.since("terms", -1, now).join(fresh, "token", "left_semi"), self.index.since("sizes", -1, now))
        # Tokens are of no document, and no document's rows become void by these.
        nobody = F.lit(None).cast("long").alias("document_id")
        tables = {"impacts": impacts, "words": word_rollups(impacts), "asked": fresh.select(nobody, "token")}
        self.kept.commit(tables, fresh.select(nobody))

    def update(self, queries: DataFrame, selection: DataFrame) -> Answers:
        """Bring the answers to the store's latest version. queries: (query_id, scope, query), query_id a number, those that
        stand now: others have no hits any more; selection: (scope, document_id, doc_pos), the documents that each scope
        has now, of which those that aren't stored are left out."""
        now = self.index.manifest()
        if now["segments"]:
            self._follow(now)
            terms = stored(query_terms(queries), "terms")
            self._catch_up(terms, now)
            rollups = Rollups(self.kept.read("words"), self.kept.read("sizes"))
            hits, _ = best_passages(terms, selection, rollups, self.kept.read("impacts"), self.k)
        else:
            hits = self.spark.createDataFrame([], "query_id long, rank int, document_id long, chunk_index int, score double")
        hits = stored(hits.select(F.col("query_id").cast("long").alias("document_id"), "rank", F.col("document_id").alias("hit_document"), "chunk_index", "score"), "hits")

        def digest(rows: DataFrame, name: str) -> DataFrame:
            return rows.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(*_HIT))).alias(name))

        old = self.hits_as_stored()
        met = digest(hits, "new") if old is None else digest(hits, "new").join(digest(old, "old"), "document_id", "full").where(~F.col("new").eqNullSafe(F.col("old")))
        changed = stored(met.select("document_id"), "changed")
        if not changed.isEmpty():
            self.answers.commit({"hits": hits.join(changed, "document_id", "left_semi")}, changed, (_FOLLOWED, now["version"]))
        return Answers(self.hits(), changed.withColumnRenamed("document_id", "query_id"), now["version"])

    def hits_as_stored(self) -> DataFrame | None:
        return self.answers.read("hits") if "hits" in self.answers.manifest()["schemas"] else None

    def hits(self) -> DataFrame:
        """The answers of the last update."""
        rows = self.hits_as_stored()
        if rows is None:
            return self.spark.createDataFrame([], "query_id long, rank int, document_id long, chunk_index int, score double")
        return rows.select(F.col("document_id").alias("query_id"), "rank", F.col("hit_document").alias("document_id"), "chunk_index", "score")
