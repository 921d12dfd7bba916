"""Feature-hashed vectors, kept sparse, and cosine search over blocks of arrays."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T

#: Passages that are made into vectors, or scored, at a time; queries and vectors that one task meets.
BLOCK, QUERIES, VECTORS = 256, 512, 16384
_PRIME, _SEED, _LOW = np.uint64(16777619), 2166136261, np.uint64(0xFFFFFFFF)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """ASCII words as a matrix of bytes, and their lengths."""
    width = max(map(len, words), default=0) or 1
    table = np.array([w.encode("ascii", "replace") for w in words], f"S{width}")
    return table.view(np.uint8).reshape(len(words), width), np.fromiter(map(len, words), np.int64, len(words))


def _hashed(start: np.ndarray, letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """fnv1a of many strings at once, carried on from `start`."""
    h = start.astype(np.uint64)
    for j in range(letters.shape[1]):
        h = np.where(j < lengths, ((h ^ letters[:, j]) * _PRIME) & _LOW, h)
    return h


def _prefixed(prefix: str, n: int) -> np.ndarray:
    h = _SEED
    for c in prefix:
        h = (h ^ ord(c)) * int(_PRIME) & int(_LOW)
    return np.full(n, h, np.uint64)


def _signed_slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A feature's slot, and its sign: by the hash of the feature with #s behind it."""
    s = h
    for c in b"#s":
        s = ((s ^ np.uint64(c)) * _PRIME) & _LOW
    return (h % np.uint64(K.DIMENSIONS)).astype(np.int64), np.where(s % np.uint64(2) == 1, -1.0, 1.0)


def _vocabulary(words: list[str], stems: list[str]):
    """For each word, where its features lie in the (slot, weight) that follow: the stem's, and those of its grams."""
    letters, lengths = _letters(words)
    found = [(np.arange(len(words)), *_signed_slots(_hashed(_prefixed("w:", len(words)), *_letters(stems))), K.WORD_WEIGHT)]
    for prefix, n, least, weight in (("c:", 3, 4, K.THREE_WEIGHT), ("d:", 4, 6, K.FOUR_WEIGHT)):
        for at in range(letters.shape[1] - n + 1):
            own = np.flatnonzero((lengths >= least) & (at <= lengths - n))
            found.append((own, *_signed_slots(_hashed(_prefixed(prefix, len(own)), letters[own, at : at + n], np.full(len(own), n))), weight))
    word, slot = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    value = np.concatenate([f[2] * f[3] for f in found])
    order = np.argsort(word, kind="stable")
    return np.searchsorted(word[order], np.arange(len(words) + 1)), slot[order], value[order]


def _stem(w: str) -> str:
    n = len(w)
    if n > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    if n > 5 and w.endswith(("ses", "xes", "zes", "ches", "shes")):
        return w[:-2]
    return w[:-1] if n > 3 and w.endswith("s") and not w.endswith(("ss", "us")) else w


def _expanded(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, `count` of them."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _embed(words: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Slots and weights of the unit vector of each list of topical words."""
    coded = words.flatten().dictionary_encode()
    vocabulary, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    sizes = np.nan_to_num(np.array(words.value_lengths().to_pylist(), float)).astype(np.int64)
    row = np.repeat(np.arange(len(words)), sizes)
    first, slot, value = _vocabulary(vocabulary, stems := [_stem(w) for w in vocabulary])
    names = {s: k for k, s in enumerate(dict.fromkeys(stems))}
    stem = np.array([names[s] for s in stems], np.int64)[code] if len(code) else code
    beside = np.flatnonzero(row[1:] == row[:-1])
    pairs, which = np.unique(stem[beside] * max(1, len(names)) + stem[beside + 1], return_inverse=True)
    letters, lengths = _letters(list(names))
    a, b = pairs // max(1, len(names)), pairs % max(1, len(names))
    left = _hashed(_prefixed("b:", len(names)), letters, lengths)
    left = ((left ^ np.uint64(ord(" "))) * _PRIME) & _LOW
    pair_slot, pair_sign = _signed_slots(_hashed(left[a], letters[b], lengths[b])) if len(pairs) else (pairs, pairs.astype(float))
    slots, weights = [], []
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for at in range(0, len(words), BLOCK):
        n = min(BLOCK, len(words) - at)
        low, high = ends[at], ends[at + n]
        own = code[low:high]
        counts = (first[1:] - first[:-1])[own] if len(own) else own
        places = _expanded(first[:-1][own], counts) if len(own) else own
        where = np.repeat(row[low:high] - at, counts) * K.DIMENSIONS + slot[places]
        k, m = np.searchsorted(beside, (low, high))
        pair_where = (row[beside[k:m]] - at) * K.DIMENSIONS + pair_slot[which[k:m]]
        size = n * K.DIMENSIONS
        # Without a single word, counts are whole numbers.
        dense = np.bincount(where, value[places], size).astype(np.float64) + np.bincount(pair_where, pair_sign[which[k:m]] * K.PAIR_WEIGHT, size)
        used = (np.bincount(where, minlength=size) + np.bincount(pair_where, minlength=size)).reshape(n, K.DIMENSIONS) > 0
        dense = dense.reshape(n, K.DIMENSIONS)
        norm = np.sqrt((dense * dense).sum(axis=1))
        dense /= np.where(norm == 0, 1.0, norm)[:, None]
        for r in range(n):
            s = np.flatnonzero(used[r])
            slots.append(s.astype(np.int32))
            weights.append(dense[r, s])
    return slots, weights


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))


def _embedded(width: int, embedder: Embedder):
    def rows(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4 * BLOCK):
                part = b.slice(at, 4 * BLOCK)
                slots, weights = embedder.embed(part.column(width))
                yield pa.RecordBatch.from_arrays([*part.columns[:width], _lists(slots, pa.int32()), _lists(weights, pa.float64())], names=[*part.schema.names[:width], "slots", "weights"])

    return rows


class Embedder(NamedTuple):
    """An embedding by its id: what of a text it is made from, as a column, and the vectors of a batch of that."""

    words: Callable[[Column], Column]
    embed: Callable[[pa.Array], tuple[list[np.ndarray], list[np.ndarray]]]
    dimensions: int


def topical_words(text: Column) -> Column:
    """The words of a text that vectors are made of."""
    return F.filter(T.words(F.coalesce(text, F.lit(""))), T.is_topical)


#: Embedders by id. Vectors of two of them are never compared.
EMBEDDERS = {K.EMBEDDER: Embedder(topical_words, _embed, K.DIMENSIONS)}


def embedded(words: DataFrame, keys: tuple[str, ...], embedder: str = K.EMBEDDER) -> DataFrame:
    """(keys, slots, weights): the unit vector of each row's words, as parallel arrays of the slots that its features hit."""
    words = words.select(*keys, "words")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields[:-1])
    return words.mapInArrow(_embedded(len(keys), EMBEDDERS[embedder]), f"{schema}, slots array<int>, weights array<double>")


def vectors(rows: DataFrame, keys: tuple[str, ...], text_col: str = "text", embedder: str = K.EMBEDDER) -> DataFrame:
    """(keys, slots, weights): the unit vector of each text.

    Words are cut out by column expressions. Hashing is for all of a batch's distinct words and pairs at once, byte by
    byte over arrays, in an Arrow function: the same as column expressions takes a row for every feature of a text."""
    return embedded(rows.select(*keys, EMBEDDERS[embedder].words(F.col(text_col)).alias("words")), keys, embedder)


def sparse_vectors(rows: DataFrame, keys: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """(keys, slot, weight): the same vectors, a row for each slot."""
    zipped = vectors(rows, keys, text_col).select(*keys, F.explode(F.arrays_zip("slots", "weights")).alias("x"))
    return zipped.select(*keys, F.col("x.slots").alias("slot"), F.col("x.weights").alias("weight"))


def dense_vectors(sparse: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, embedding): the same vectors as arrays of all dimensions, for export."""
    pairs = sparse.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("slot", "weight"))).alias("m"))
    return pairs.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(K.DIMENSIONS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))


def top_places(scores: np.ndarray, ties: np.ndarray, most: int) -> np.ndarray:
    """Places of the largest scores, ties to the smaller."""
    if len(scores) > 4 * most:
        few = np.flatnonzero(scores >= np.partition(scores, -most)[-most])
        return few[np.lexsort((ties[few], -scores[few]))[:most]]
    return np.lexsort((ties, -scores))[:most]


def _nearest(k: int):
    def task(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        ids, found, cosines = [], [], []
        q_ids, v_ids = (t.column("vec_id").to_numpy() for t in (queries, rows))
        width = max([t.column("v").combine_chunks().value_lengths().to_numpy().max(initial=1) for t in (queries, rows)])

        def dense(table):
            lists = table.column("v").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            out = np.zeros((len(lists), width))
            out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
            norm = np.sqrt((out * out).sum(axis=1))
            return out, norm

        if queries.num_rows and rows.num_rows:
            (q, q_norm), (v, v_norm) = dense(queries), dense(rows)
            for at, row in enumerate(q):
                both = q_norm[at] * v_norm
                cosine = np.round(np.where(both > 0, v @ row / np.where(both > 0, both, 1.0), 0.0), 6)
                other = np.flatnonzero(v_ids != q_ids[at])
                top = other[top_places(cosine[other], v_ids[other], k)]
                ids += [q_ids[at]] * len(top)
                found.append(v_ids[top])
                cosines.append(cosine[top])
        return pa.table([pa.array(ids, pa.int64()), pa.array(np.concatenate(found or [[]]).astype(np.int64)), pa.array(np.concatenate(cosines or [[]]), pa.float64())], names=["query_id", "vec_id", "cosine"])

    return task


def array_topk(queries: DataFrame, rows: DataFrame, k: int, group: int = QUERIES, block: int = VECTORS) -> DataFrame:
    """The k vectors of largest cosine with each query, as arrays: (query_id, rank, vec_id, cosine), itself left out.

    Exact search: groups of queries meet blocks of vectors, a pair of them being one task of bounded size that keeps
    each query's k best; those are merged. Nothing is broadcast. Vectors that are null have no row."""
    known = [df.where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")) for df in (queries, rows)]
    groups, blocks = (max(1, -(-df.count() // size)) for df, size in zip(known, (group, block), strict=True))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other))

    asked, held = dealt(known[0], "g", groups, "b", blocks), dealt(known[1], "b", blocks, "g", groups)
    near = asked.groupBy("g", "b").cogroup(held.groupBy("g", "b")).applyInArrow(_nearest(k), "query_id long, vec_id long, cosine double")
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "cosine")
