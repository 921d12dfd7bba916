"""Hard-negative mining by one-dimensional distance keys: sorted by (pivot, distance), scanned outwards in annuli."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stored
from .topk import _aligned, _keep_best, _matrix

#: Vectors in a scanned interval of keys, vectors of one task and queries that meet them there; queries scored at a time.
BLOCK, SHARD, QUERIES, BATCH = 256, 8192, 1 << 16, 256
#: Vectors in the sample that pivots, key intervals and first bounds come from; pivots, intervals and numbers at most.
SEEDS, PIVOTS, CELLS, NUMBERS = 2048, 32, 1024, 1 << 20


def labelled(vectors: DataFrame, scale: int = 256, every: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, v): each component x as floor(scale * x); where `every` divides vec_id, the label is the next one.
    Rows without an id or a label, and vectors that are null or hold a null, NaN or infinity, take no part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where(v.isNotNull() & fine & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    i, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    return usable.select(i.alias("vec_id"), F.when(i % every == 0, (label + 1) % labels).otherwise(label).alias("label"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _wide(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, max(0, width - rows.shape[1])))).astype(np.float64)


class Keys:
    """Pivots among a sample, and intervals of distance to each. A vector x is augmented by sqrt(most - |x|^2), a query by 0:
    then a larger inner product is a smaller distance. What tasks need of it is bounded, whatever the input."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, most: float, pivots: int, cells: int):
        self.ids, self.labels, self.rows, self.most = ids, labels, rows, most
        #: Distances are doubles: no bound is nearer to its value than that.
        self.slack = 1e-6 * np.sqrt(most) + 1e-6
        self.points = rows[:pivots].astype(np.float64)
        self.extra = np.sqrt(np.maximum(most - (self.points**2).sum(axis=1), 0))
        pivot, key = self.placed(rows)
        #: Of each interval, its pivot, and where it begins; each ends where the pivot's next one begins.
        self.pivots, self.starts = [], []
        for p in range(len(self.points)):
            own = np.sort(key[pivot == p])
            n = max(1, min(len(own), round(cells * len(own) / max(1, len(rows)))))
            self.pivots += [p] * n
            self.starts += [0.0, *own[[len(own) * k // n for k in range(1, n)]]]
        self.pivots, self.starts = np.array(self.pivots), np.array(self.starts)
        self.first = np.searchsorted(self.pivots, np.arange(len(self.points)))
        self.low = self.high = self.held = None

    def placed(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each vector, and the distance to it."""
        rows, points = _wide(rows, self.points.shape[1]), _wide(self.points, rows.shape[1])
        extra = np.sqrt(np.maximum(self.most - (rows**2).sum(axis=1), 0))
        square = np.maximum(2 * self.most - 2 * (rows @ points.T + np.outer(extra, self.extra)), 0)
        pivot = square.argmin(axis=1)
        return pivot, np.sqrt(square[np.arange(len(rows)), pivot])

    def cells(self, pivot: np.ndarray, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pivot), np.int64)
        for p in np.unique(pivot):
            own = pivot == p
            at = slice(self.first[p], self.first[p] + np.count_nonzero(self.pivots == p))
            out[own] = self.first[p] + np.maximum(np.searchsorted(self.starts[at], key[own], "right") - 1, 0)
        return out

    def away(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of queries to each pivot, and their squared lengths."""
        queries, points = _wide(queries, self.points.shape[1]), _wide(self.points, queries.shape[1])
        square = (queries**2).sum(axis=1)
        return np.sqrt(np.maximum(square[:, None] + self.most - 2 * (queries @ points.T), 0)), square

    def bounds(self, away: np.ndarray, square: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest and the smallest score that a vector of a key from low to high can have."""
        near = np.maximum(np.maximum(low - away, away - high) - self.slack, 0)
        far = away + high + self.slack
        room = square + self.most
        return (room - near * near) / 2 * (1 + 1e-9) + 1, (room - far * far) / 2 * (1 + 1e-9) - 1

    def reached(self, away: np.ndarray, square: np.ndarray, floors: np.ndarray, caps: np.ndarray) -> np.ndarray:
        """Whether a vector of each interval can score from its floor to its cap, for each query."""
        most, least = self.bounds(away[:, self.pivots], square[:, None], self.low, self.high)
        return (most >= floors[:, None]) & (least <= caps[:, None]) & self.held


def _number(x) -> float:
    """An integer as a bound: a double next to it, so that rounding loses nothing; None as no bound."""
    return -np.inf if x is None else float(np.nextafter(float(x), -np.inf)) if abs(x) >= 2**53 else float(x)


class Scan:
    """The vectors of one task in order of their keys, in intervals of BLOCK."""

    def __init__(self, keys: Keys, table: pa.Table):
        order = np.argsort(table.column("key").to_numpy(), kind="stable")
        key = table.column("key").to_numpy()[order]
        self.keys, self.pivot = keys, int(table.column("pivot")[0].as_py())
        self.all = _matrix(table.column("v"))[order]
        self.ids, self.labels = table.column("vec_id").to_numpy()[order], table.column("label").to_numpy()[order]
        self.cuts = list(range(0, len(key), BLOCK))
        self.low, self.high = key[self.cuts], key[[min(c + BLOCK, len(key)) - 1 for c in self.cuts]]

    def search(self, q: pa.Table, k: int, same: bool):
        """For each query its k best scores from floor to cap, of the same label or of others, itself left out."""
        rows, asked = _aligned(self.all, _matrix(q.column("v")))
        away, square = self.keys.away(asked.astype(np.float64))
        most, least = self.keys.bounds(away[:, [self.pivot]], square[:, None], self.low, self.high)
        turn = np.argsort(-most, axis=1, kind="stable")  # outwards from where the query's own key would be
        q_ids, q_labels = q.column("vec_id").to_numpy(), q.column("label").to_numpy()
        exact = object if rows.dtype == object else np.float64
        floors = q.column("floor").to_pylist()
        kth = np.array([_number(x) for x in floors], np.float64)
        floors = np.array([-np.inf if x is None else x for x in floors], exact)
        caps = [np.inf if x is None else x if exact is object else float(x) for x in q.column("cap").to_pylist()]
        score, ids = [np.empty(0, exact)] * len(q_ids), [np.empty(0, np.int64)] * len(q_ids)
        live = np.arange(len(q_ids))
        for step in range(len(self.cuts)):
            at = turn[live, step]
            going = most[live, at] >= kth[live]
            live, at = live[going], at[going]  # bounds only fall from here: what remains is certified
            if not len(live):
                break
            inside = np.array([least[j, a] <= caps[j] for j, a in zip(live, at, strict=True)], bool)  # else all are nearer than the annulus
            who_all, at = live[inside], at[inside]
            order = np.argsort(at, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else []:
                a, who = self.cuts[at[own[0]]], who_all[own]
                part = slice(a, a + BLOCK)
                got = asked[who] @ rows[part].T
                fits = (self.labels[part] == q_labels[who][:, None]) == same
                fits &= self.ids[part] != q_ids[who][:, None]
                fits &= (got >= kth[who][:, None]).astype(bool) & (got >= floors[who][:, None]).astype(bool) & (got <= np.array([caps[j] for j in who], exact)[:, None]).astype(bool)
                for j in np.flatnonzero(fits.any(axis=1)):
                    i, mine = who[j], fits[j]
                    score[i], ids[i] = _keep_best(score[i], ids[i], got[j][mine], self.ids[part][mine], k)
                    if len(score[i]) == k:
                        kth[i] = max(kth[i], _number(int(score[i][-1])))
        return score, ids


def _placing(keys):
    def rows(batches):
        for b in batches:
            pivot, key = keys.value.placed(_matrix(b.column(2)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys.value.cells(pivot, key)), pa.array(pivot.astype(np.int64)), pa.array(key)], names=["vec_id", "label", "v", "cell", "pivot", "key"])

    return lean(rows)


def _sending(keys):
    """Queries (.., v, floor, cap) once for each cell that they reach."""

    def rows(batches):
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                away, square = keys.value.away(_matrix(part.column("v")))
                floors = np.array([_number(x) for x in part.column("floor").to_pylist()])
                caps = np.array([np.inf if x is None else float(np.nextafter(float(x), np.inf)) for x in part.column("cap").to_pylist()])
                q, cell = np.nonzero(keys.value.reached(away, square, floors, caps))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(q)) for c in part.columns), pa.array(cell.astype(np.int64))], names=[*part.schema.names, "cell"])

    return lean(rows)


def _scanning(keys, k: int, same: bool):
    """Rows in order of (g, cell, part, asks): a task's vectors are held, then its queries pass by, some at a time."""

    def rows(batches):
        here, held, scan = None, [], None
        for b in batches:
            codes = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("g", "cell", "part", "asks")])
            cuts = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                group, run = tuple(codes[:3, a]), pa.Table.from_batches([b.slice(a, z - a)])
                if group != here:
                    here, held, scan = group, [], None
                if not codes[3, a]:
                    held.append(run)
                    continue
                if not held and scan is None:
                    continue  # no vector there
                if scan is None:
                    scan, held = Scan(keys.value, pa.concat_tables(held).combine_chunks()), []
                for at in range(0, run.num_rows, BATCH):
                    q = run.slice(at, BATCH)
                    score, ids = scan.search(q, k, same)
                    which = pa.array(np.repeat(np.arange(len(ids)), [len(x) for x in ids]))
                    both = [q.column(c).combine_chunks().take(which) for c in ("vec_id", "positive_id")]
                    yield pa.RecordBatch.from_arrays([*both, pa.array(np.concatenate(ids), pa.int64()), pa.array([int(x) for s in score for x in s], pa.int64())], names=["anchor_id", "positive_id", "vec_id", "score"])

    return lean(rows)


class Index:
    """Vectors stored in order of (pivot, distance), and where queries have to look."""

    def __init__(self, vectors: DataFrame, shard: int = SHARD):
        spark = vectors.sparkSession
        vectors = stored(vectors.select("vec_id", "label", "v"), "vectors")
        square = F.aggregate("v", F.lit(0.0), lambda n, x: n + x.cast("double") * x)
        n, width, most = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(square), F.lit(0.0))).first()
        self.spark, self.vectors, width = spark, None, max(1, width)
        if not n:
            return
        seeds = vectors.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(max(1, min(SEEDS, NUMBERS // width))).collect()
        rows = np.zeros((len(seeds), width), np.int64)
        for i, r in enumerate(seeds):
            rows[i, : len(r.v)] = r.v
        # A repeated id may be sampled in part: its first row alone, since a bound counts unlike rows.
        ids, at = np.unique(np.array([r.vec_id for r in seeds], np.int64), return_index=True)
        labels = np.array([r.label for r in seeds], np.int64)[at]
        self.shard = shard = max(1, min(shard, max(1024, n // 64)))
        cells = max(1, min(CELLS, NUMBERS // width, -(-n // shard)))
        self.keys = Keys(ids, labels, rows[at], float(most), max(1, min(PIVOTS, cells // 2)), cells)
        placed = vectors.mapInArrow(_placing(spark.sparkContext.broadcast(self.keys)), "vec_id long, label long, v array<long>, cell long, pivot long, key double")
        placed = stored(placed, "placed")
        seen = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        every = range(len(self.keys.pivots))
        self.keys.held = np.array([c in seen for c in every])
        self.keys.low, self.keys.high = (np.array([seen[c][x] if c in seen else 0.0 for c in every]) for x in ("low", "high"))
        self.parts = [-(-seen[c].n // shard) if c in seen else 0 for c in every]
        part = self._parts()
        # By row and not by id, so that rows that repeat one are spread too; a stored table's rows keep their places.
        dealt = placed.withColumn("part", F.pmod(F.xxhash64(F.lit(2), F.monotonically_increasing_id()), part))
        self.vectors = stored(dealt.repartition(self._tasks(1), "cell", "part").sortWithinPartitions("cell", "part", "key"), "keyed")

    def _parts(self):
        return F.element_at(F.array(*[F.lit(p).cast("long") for p in self.parts]), (F.col("cell") + 1).cast("int"))

    def _tasks(self, groups: int) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), min(1 << 14, groups * sum(self.parts)))

    def search(self, queries: DataFrame, k: int, same: bool, group: int = QUERIES) -> DataFrame:
        """(anchor_id, positive_id, vec_id, score, rank): for each of queries (vec_id, label, v, positive_id, floor, cap) the k
        best scores from floor to cap, of vectors of its label or of others, ties to the smaller vec_id."""
        keys = self.spark.sparkContext.broadcast(self.keys)
        queries = stored(queries.select("vec_id", "label", "v", "positive_id", "floor", "cap"), "queries")
        kinds = "vec_id long, label long, v array<long>, positive_id long, floor long, cap long"
        groups = max(1, -(-queries.count() // group))
        sent = queries.mapInArrow(_sending(keys), kinds + ", cell long").withColumn("g", F.pmod(F.xxhash64("vec_id", "positive_id"), F.lit(groups)))
        sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), self._parts() - 1)))
        sent = sent.select("g", "cell", "part", F.lit(1).alias("asks"), F.lit(0.0).alias("key"), F.lit(0).cast("long").alias("pivot"), *[x.split()[0] for x in kinds.split(", ")])
        none = F.lit(None).cast("long")
        held = self.vectors.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        held = held.select("g", "cell", "part", F.lit(0), "key", "pivot", "vec_id", "label", "v", none, none, none)
        both = sent.union(held).repartition(self._tasks(groups), "g", "cell", "part").sortWithinPartitions("g", "cell", "part", "asks", "key")
        near = both.mapInArrow(_scanning(keys, k, same), "anchor_id long, positive_id long, vec_id long, score long")
        order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _floored(keys, k: int, same: bool):
    """Queries with the kth best score of the sample as a floor, where it has so many that fit."""

    def rows(batches):
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                asked, known = _aligned(_matrix(part.column("v")), keys.value.rows)
                floors = []
                columns = [part.column(c).to_pylist() for c in ("vec_id", "label", "floor", "cap")]
                for i, label, low, cap, s in zip(*columns, asked @ known.T, strict=True):
                    fits = ((keys.value.labels == label) == same) & (keys.value.ids != i)
                    s = s[fits & (True if cap is None else (s <= cap).astype(bool)) & (True if low is None else (s >= low).astype(bool))]
                    best = int(np.sort(s)[-k]) if len(s) >= k else None
                    floors.append(best if best is not None else low)
                yield part.set_column(part.schema.get_field_index("floor"), "floor", pa.array(floors, pa.int64()))

    return lean(rows)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), shard: int = SHARD, group: int = QUERIES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors among vectors (vec_id, label, v).

    An anchor's positives are the `positives` rows of its label of the largest integer inner product, itself left out; for
    each, its negatives are the `negatives` best rows of other labels whose score is from low to high of the positive's
    (as fractions, exactly). A positive id that repeats is asked for once, with its best score. Ties go to the smaller vec_id. Fewer, if there are fewer; an anchor or a positive without any
    has no row. Rows that repeat a vec_id are candidates each, as an anchor one of them counts. Of unequal lengths the
    shorter vector is padded by zeros. Empty tables give an empty table; other columns are ignored.

    Keys are one-dimensional: each vector, augmented so that scores are distances, lies in order of its distance to the
    nearest of at most PIVOTS pivots, in intervals (cells) cut into tasks of at most `shard` vectors. A query goes to the
    cells whose annulus can hold a score from its floor to its cap; the floor starts as the kth best of a bounded sample.
    In a task, keys are scanned outwards from the query's own distance to the pivot until what remains is too far; what
    lies nearer than a cap allows is skipped. A task holds its vectors once, and queries, `group` at most, pass by them.
    Two searches follow one another, since a negative's band comes from a positive's score.
    """
    spark, schema = vectors.sparkSession, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    index = Index(vectors, shard)
    if index.vectors is None:
        return spark.createDataFrame([], schema)
    keys, none = spark.sparkContext.broadcast(index.keys), F.lit(None).cast("long")
    kinds = "vec_id long, label long, v array<long>, positive_id long, floor long, cap long"
    own = stored(anchors.select("vec_id", "label", "v").dropDuplicates(["vec_id"]), "anchors")
    asked = own.select("vec_id", "label", "v", none.alias("positive_id"), none.alias("floor"), none.alias("cap"))
    best = index.search(asked.mapInArrow(_floored(keys, positives, True), kinds), positives, True, group)
    best = best.groupBy("anchor_id", F.col("vec_id").alias("positive_id")).agg(F.max("score").alias("positive_score")).withColumnRenamed("anchor_id", "vec_id")
    best = stored(best, "positives")
    # Whole numbers from low to high of a score s: from ceil(a s / b) to floor(c s / d).
    s = F.col("positive_score")
    floor, cap = -_below(-s, *low), _below(s, *high)
    asked = best.select("vec_id", "positive_id", floor.alias("floor"), cap.alias("cap")).where("floor <= cap").join(own, "vec_id")
    found = index.search(asked.select("vec_id", "label", "v", "positive_id", "floor", "cap").mapInArrow(_floored(keys, negatives, False), kinds), negatives, False, group)
    shown = found.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score").withColumnRenamed("anchor_id", "vec_id").join(best, ["vec_id", "positive_id"])
    return shown.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _below(s, a: int, b: int):
    """floor(a s / b) in whole numbers."""
    part, b = s.cast("decimal(20,0)") * F.lit(a).cast("decimal(10,0)"), F.lit(b).cast("decimal(10,0)")
    return F.call_function("div", part - F.pmod(part, b), b)
