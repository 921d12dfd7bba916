"""Exact top-k inner-product search by block-at-a-time pruning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stored

#: Vectors in a block, blocks' vectors in a task, and queries in a task.
BLOCK, SHARD, QUERIES = 256, 16384, 2048
#: Vectors in the sample that starts the bounds, ranges that have bounds of their own, and numbers in either at most.
SEEDS, RANGES, NUMBERS = 2048, 1024, 1 << 20


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(rows, pa.ChunkedArray):
        rows = pa.concat_arrays(rows.chunks) if rows.num_chunks else pa.array([], pa.list_(pa.int64()))
    sizes = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(rows), max(1, int(sizes.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = rows.flatten().to_numpy()
    return out


def _aligned(*parts: np.ndarray) -> list[np.ndarray]:
    """Equal widths, padded by 0; doubles where every sum is a whole number below 2^53, else exact Python integers."""
    width = max(p.shape[1] for p in parts)
    parts = [np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts]
    most = [float(np.abs(p.astype(np.float64)).max(initial=0)) for p in parts]
    exact = max(most) ** 2 * width < 2**53
    return [p.astype(np.float64 if exact else object) for p in parts]


def _keep_best(score, ids, new_score, new_ids, k):
    s, i = np.concatenate([score, new_score]), np.concatenate([ids, new_ids])
    order = np.lexsort((i, -s))[:k] if s.dtype != object else np.array(sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[:k], dtype=np.int64)
    return s[order], i[order]


class Blocks:
    """A range of vectors cut into blocks, each with its forward index (the rows) and its largest and smallest term."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, block: int = BLOCK):
        # Like vectors next to each other make narrow term maxima; the order is free, since ties go by id.
        order = np.lexsort((ids, np.argmin(rows, axis=1), np.argmax(rows, axis=1))) if len(ids) else np.arange(0)
        ids, rows = ids[order], rows[order]
        self.ids = [ids[i : i + block] for i in range(0, len(ids), block)]
        self.rows = [rows[i : i + block] for i in range(0, len(ids), block)]
        self.high = np.array([r.max(axis=0) for r in self.rows]).reshape(len(self.rows), rows.shape[1])
        self.low = np.array([r.min(axis=0) for r in self.rows]).reshape(len(self.rows), rows.shape[1])

    def search(self, q_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int):
        """For each query its k best here among those that reach its floor; yields (query, scores, ids)."""
        zero = queries.dtype.type(0) if queries.dtype != object else 0
        bound = np.maximum(queries, zero) @ self.high.T + np.minimum(queries, zero) @ self.low.T
        plan = np.argsort(-bound, axis=1, kind="stable")
        score = [np.empty(0, queries.dtype)] * len(q_ids)
        ids = [np.empty(0, np.int64)] * len(q_ids)
        kth = np.array(floors, dtype=queries.dtype if queries.dtype == object else np.float64)
        live = np.arange(len(q_ids))
        for turn in range(len(self.rows)):
            at = plan[live, turn]
            best = bound[live, at]
            going = np.array([b >= f for b, f in zip(best, kth[live], strict=True)], bool) if queries.dtype == object else best >= kth[live]
            live, at = live[going], at[going]  # bounds only fall from here, so the others are done
            if not len(live):
                break
            order = np.argsort(at, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                b, who = at[own[0]], live[own]
                got = queries[who] @ self.rows[b].T
                hit = got >= kth[who][:, None]
                for j in np.flatnonzero(hit.any(axis=1)):
                    q, mine = who[j], hit[j].astype(bool) & (self.ids[b] != q_ids[who[j]])
                    score[q], ids[q] = _keep_best(score[q], ids[q], got[j][mine], self.ids[b][mine], k)
                    if len(score[q]) == k:
                        kth[q] = max(kth[q], score[q][-1])
        return zip(q_ids, score, ids, strict=True)


def _search(k: int):
    def task(key, queries: pa.Table, docs: pa.Table) -> pa.Table:
        out = ([], [], [])
        if queries.num_rows and docs.num_rows:
            ids, q_ids = docs.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
            rows, asked = _aligned(_matrix(docs.column("v")), _matrix(queries.column("v")))
            # A floor may be rounded to a double: the one below it is a floor as well.
            floors = [-float("inf") if f is None else float(np.nextafter(f, -np.inf)) if abs(f) >= 2**53 else float(f) for f in queries.column("floor").to_pylist()]
            for q, score, found in Blocks(ids, rows).search(q_ids, asked, np.array(floors, dtype=asked.dtype), k):
                out[0].extend([q] * len(found))
                out[1].extend(found)
                out[2].extend(int(x) for x in score)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["query_id", "vec_id", "score"])

    return task


class Ranges:
    """A sample of vectors that starts the bounds, and the vectors in it that ranges lie around. What tasks need of both
    is bounded by SEEDS, RANGES and NUMBERS, whatever the input."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, ranges: int):
        self.ids, self.rows, self.centres = ids, rows, rows[:ranges].astype(np.float64)
        self.high = self.low = None

    def nearest(self, rows: np.ndarray) -> np.ndarray:
        """The range of each vector. Any would do for right results; near vectors make narrow term maxima."""
        if len(self.centres) < 2:
            return np.zeros(len(rows), np.int64)
        rows, centres = (np.pad(x, ((0, 0), (0, max(rows.shape[1], self.centres.shape[1]) - x.shape[1]))) for x in (rows.astype(np.float64), self.centres))
        return ((centres * centres).sum(axis=1) / 2 - rows @ centres.T).argmin(axis=1)

    def floors(self, q_ids: np.ndarray, queries: np.ndarray, k: int) -> list[int | None]:
        """Each query's kth best score in the sample, itself left out: no worse one is among its k best of all."""
        asked, first = _aligned(queries, self.rows)
        out = []
        for q, s in zip(q_ids, asked @ first.T, strict=True):
            s = np.sort(s[self.ids != q])
            out.append(int(s[-k]) if len(s) >= k else None)
        return out

    def reached(self, queries: np.ndarray, floors: list[int | None]) -> np.ndarray:
        """Whether each range's summed term maxima reach each query's floor."""
        asked, high, low = _aligned(queries, self.high, self.low)
        zero = asked.dtype.type(0) if asked.dtype != object else 0
        bound = np.maximum(asked, zero) @ high.T + np.minimum(asked, zero) @ low.T
        return np.array([[f is None or x >= f for x in row] for row, f in zip(bound, floors, strict=True)], bool).reshape(len(queries), len(high))


def _placed(ranges):
    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ranges.value.nearest(_matrix(b.column(1))))], names=["vec_id", "v", "cell"])

    return lean(rows)


def _list(row: np.ndarray) -> list[int]:
    return [int(x) for x in row]


def _partial_maxima(batches):
    for b in batches:
        cells, rows = b.column(1).to_numpy(), _matrix(b.column(0))
        # _matrix() fills a shorter vector up with zeros, so zero is within the bounds there.
        found = [(int(c), rows[cells == c]) for c in np.unique(cells)]
        cols = ([c for c, _ in found], [len(r) for _, r in found], [_list(r.max(axis=0)) for _, r in found], [_list(r.min(axis=0)) for _, r in found])
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["cell", "n", "high", "low"])


def _merged_maxima(table: pa.Table) -> pa.Table:
    high, low = _matrix(table.column("high")), _matrix(table.column("low"))
    if min(map(len, table.column("high").to_pylist())) < high.shape[1]:  # as above
        high, low = np.maximum(high, 0), np.minimum(low, 0)
    return pa.table([pa.array([table.column("cell")[0].as_py()], pa.int64()), pa.array([pc.sum(table.column("n")).as_py()], pa.int64()), pa.array([_list(high.max(axis=0))], pa.list_(pa.int64())), pa.array([_list(low.min(axis=0))], pa.list_(pa.int64()))], names=["cell", "n", "high", "low"])


def _asking(ranges, k: int):
    def rows(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                queries = _matrix(part.column(1))
                floors = ranges.value.floors(part.column(0).to_numpy(), queries, k)
                q, cell = np.nonzero(ranges.value.reached(queries, floors))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(q)), part.column(1).take(pa.array(q)), pa.array([floors[i] for i in q], pa.int64()), pa.array(cell.astype(np.int64))], names=["vec_id", "v", "floor", "cell"])

    return lean(rows)


def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): each component x as floor(scale * x). Without vectors that are null or hold a null, NaN or infinity."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where(v.isNotNull() & fine & F.col(id_col).isNotNull())
    return usable.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def dealt(queries: DataFrame, vectors: DataFrame, k: int, shard: int = SHARD, group: int = QUERIES, most_ranges: int = RANGES) -> tuple[DataFrame, DataFrame]:
    """What each task searches: queries (g, cell, part, vec_id, v, floor) and vectors (g, cell, part, vec_id, v).

    Vectors lie in ranges around some of a sample, and a range in parts of about `shard`. A query goes to the ranges
    whose summed term maxima reach its floor, its kth best score in the sample; a range's vectors go to the groups of
    queries that reach it. Only the maxima of ranges, as many as RANGES at most, come to the driver.
    """
    spark = vectors.sparkSession
    n, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    q = queries.count()
    width = max(1, width)
    seeds = vectors.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(max(1, min(SEEDS, NUMBERS // width))).collect()
    rows = np.zeros((len(seeds), width), np.int64)
    for i, r in enumerate(seeds):
        rows[i, : len(r.v)] = r.v
    # A row that repeats a vec_id may be sampled twice or not at all; each id's first row alone starts the bounds.
    ids, first = np.unique(np.array([r.vec_id for r in seeds], np.int64), return_index=True)
    ranges = Ranges(ids, rows[first], max(1, min(most_ranges, NUMBERS // width, -(-n // shard))))
    placed = stored(vectors.select("vec_id", "v").mapInArrow(_placed(spark.sparkContext.broadcast(ranges)), "vec_id long, v array<long>, cell long"), "placed")
    partial = placed.select("v", "cell").mapInArrow(_partial_maxima, "cell long, n long, high array<long>, low array<long>")
    merged = {r.cell: r for r in partial.groupBy("cell").applyInArrow(_merged_maxima, "cell long, n long, high array<long>, low array<long>").collect()}
    cells = max(merged, default=-1) + 1
    ranges.high, ranges.low = np.zeros((cells, width), np.int64), np.zeros((cells, width), np.int64)
    for c, r in merged.items():
        ranges.high[c, : len(r.high)], ranges.low[c, : len(r.low)] = r.high, r.low
    parts = [-(-merged[c].n // shard) if c in merged else 0 for c in range(cells)]
    part = F.element_at(F.array(*[F.lit(p).cast("long") for p in parts or [0]]), (F.col("cell") + 1).cast("int"))

    asked = queries.select("vec_id", "v").mapInArrow(_asking(spark.sparkContext.broadcast(ranges), k), "vec_id long, v array<long>, floor long, cell long").where(part > 0)
    asked = asked.withColumn("g", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(max(1, -(-q // group)))))
    asked = asked.select("g", "cell", F.explode(F.sequence(F.lit(0).cast("long"), part - 1)).alias("part"), "vec_id", "v", "floor")
    asked = stored(asked, "asked")
    wanted = asked.select(F.col("g").alias("g"), F.col("cell").alias("c"), F.col("part").alias("p")).distinct()
    # By row and not by id, so that rows that repeat one are spread too; the stored table's rows keep their places.
    held = placed.select("cell", F.pmod(F.xxhash64(F.lit(2), F.monotonically_increasing_id()), part).alias("part"), "vec_id", "v")
    held = held.join(wanted, (F.col("cell") == F.col("c")) & (F.col("part") == F.col("p"))).select("g", "cell", "part", "vec_id", "v")
    return asked, held


def block_topk(queries: DataFrame, vectors: DataFrame, k: int = 20, shard: int = SHARD, group: int = QUERIES) -> DataFrame:
    """The k vectors of largest integer inner product with each query: query_id, rank, vec_id, score.

    queries and vectors: (vec_id long, v array<long>), as quantised() gives them; other columns are ignored. A query's
    own vec_id is no candidate; ties go to the smaller vec_id; a query with fewer than k candidates gets them all. Of
    unequal lengths the shorter vector is padded by zeros. Repeated rows are candidates each; a repeated query is asked
    once. Empty tables give an empty table.

    Queries and vectors meet as dealt() says, so a range whose bound is below a query's floor never gets it; a group of
    queries and a part of a range are one task of bounded size. There, vectors form blocks with the largest and smallest
    value of each term. A query takes the blocks by falling bound (the sum over its terms of the largest product that the
    block allows), scores each through the block's rows, and stops once a bound is below its kth score. Where vectors
    point everywhere alike, no bound falls below any floor, and every query meets every vector.
    """
    asked, held = dealt(queries.dropDuplicates(["vec_id"]), vectors, k, shard, group)
    best = asked.groupBy("g", "cell", "part").cogroup(held.groupBy("g", "cell", "part")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
