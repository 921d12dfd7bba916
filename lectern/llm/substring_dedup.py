"""Substring dedup by level-wise doubling of repeated word windows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, let_go, raw_texts, slices, stored

WINDOW, BASE = 13, 6
_ODD = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mixed(x: np.ndarray) -> np.ndarray:
    for m in _MIX:
        x = (x ^ (x >> np.uint64(33))) * m
    return x ^ (x >> np.uint64(33))


class Levels:
    """Hashes of all windows of one text at one length after another, each made from two of a shorter length."""

    def __init__(self, words: np.ndarray):
        self.sums = {1: words}

    def raw(self, n: int) -> np.ndarray:
        """Before mixing: the window of n words is its first 2^k words followed by the rest."""
        if n not in self.sums:
            head = 1 << ((n - 1).bit_length() - 1)
            a, b = self.raw(head), self.raw(n - head)
            scale = np.uint64(pow(_ODD, head, 1 << 64))
            m = len(self.sums[1]) - n + 1
            self.sums[n] = a[:m] + b[head : head + m] * scale
        return self.sums[n]

    def hashes(self, n: int) -> np.ndarray:
        return _mixed(self.raw(n))


def anchors(levels: Levels, base: int, window: int) -> np.ndarray:
    """Each window's anchor: the position of the `base`-word window within it that has the least hash (ties: the first).
    Equal windows have equal anchors, and neighbours mostly share theirs: of a random order, two of window - base + 2
    positions are anchors."""
    h = levels.hashes(base)
    m = len(h) - (window - base)
    least, at = h[:m].copy(), np.arange(m)
    for j in range(1, window - base + 1):
        less = h[j : j + m] < least
        np.copyto(least, h[j : j + m], where=less)
        at[less] = np.flatnonzero(less) + j
    return at


class Words:
    """The words of a column of texts, as one row of numbers: each word's 64-bit hash. Another seed, another hash.

    A word's hash is the sum of its bytes' random numbers times powers of an odd number, for all words at once by
    running sums over a bounded stretch of text. Words of over LONG bytes have a hash of their own kind instead.
    """

    STRETCH, LONG = 1 << 18, 64
    WHITE = np.zeros(256, bool)
    WHITE[[9, 10, 11, 12, 13, 32]] = True

    def __init__(self, seed: int = 0):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.seed, self.numbers = seed, draw.integers(0, 1 << 64, 256, np.uint64)
        odd = int(draw.integers(0, 1 << 63)) * 2 + 1
        self.powers, self.inverse = (self._powers(x) for x in (odd, pow(odd, -1, 1 << 64)))

    def _powers(self, x: int) -> np.ndarray:
        out = np.full(self.STRETCH + 1, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    @classmethod
    def split(cls, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The column's bytes, where words start and end in them, and the number of each text's first word (and the end)."""
        if column.null_count:
            column = pc.fill_null(column, "")
        wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
        offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = column.buffers()[2]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        solid = np.append(~cls.WHITE[data], False)
        border = np.zeros(len(solid), bool)
        border[offsets] = True
        before = np.concatenate([[False], solid[:-1]]) & ~border
        starts = np.flatnonzero(solid & ~before)
        ends = np.flatnonzero(solid[:-1] & (~solid[1:] | border[1:])) + 1
        return data, starts, ends, np.searchsorted(starts, offsets)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, long = np.zeros(len(starts), np.uint64), ends - starts > self.LONG
        k = 0
        while k < len(starts):
            low = starts[k]
            n = max(1, int(np.searchsorted(ends, low + self.STRETCH, "right")) - k)
            if ends[k] - low <= self.STRETCH:  # else a single word, and a long one
                part = self.numbers[data[low : ends[k + n - 1]]]
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(part * self.powers[: len(part)], out=sums[1:])
                a = starts[k : k + n] - low
                out[k : k + n] = (sums[ends[k : k + n] - low] - sums[a]) * self.inverse[a]
            k += n
        for k in np.flatnonzero(long):
            out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), self.seed)
        return _mixed(out)


def _inside(first: np.ndarray, window: int) -> np.ndarray:
    """Whether the window from each word on ends in the same text."""
    ends = np.repeat(first[1:], np.diff(first))
    return np.arange(max(0, len(ends) - window + 1)) + window <= ends[: max(0, len(ends) - window + 1)]


@lean
def _whole(batches):
    """doc_id, tag, n_words, sha256 of the words."""
    for b in slices(batches, 2):
        n, sha = [], []
        for text in raw_texts(b.column(2)):
            words = text.split()
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "tag", "n_words", "sha"])


def _anchored(base: int, window: int):
    def rows(batches):
        read = Words()
        for b in slices(batches, 1):
            data, starts, ends, first = Words.split(b.column(1))
            if len(starts) < window:
                continue
            levels = Levels(read(data, starts, ends))
            at = anchors(levels, base, window)[_inside(first, window)]
            at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at  # they only rise
            text = np.searchsorted(first, at, "right") - 1
            # The anchors' hashes are small ones; the lower bits of all are alike random.
            h = levels.hashes(base)[at] & np.uint64((1 << 48) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array(h.view(np.int64)), pa.array((at - first[text]).astype(np.int32))], names=["tag", "h", "pos"])

    return lean(rows)


def _windows(base: int, window: int):
    def rows(batches):
        # Two hashes of independent hashes of the words: at 96 bits chance collisions stay out of reach.
        read, other = Words(), Words(1)
        for b in slices(batches, 2):
            data, starts, ends, first = Words.split(b.column(2))
            seen = b.column(3)
            survives = np.zeros(len(starts), bool)
            survives[seen.flatten().to_numpy() + np.repeat(first[:-1], pc.list_value_length(seen).to_numpy())] = True
            levels = Levels(read(data, starts, ends))
            pos = np.flatnonzero(survives[anchors(levels, base, window)] & _inside(first, window))
            text = np.searchsorted(first, pos, "right") - 1
            row = pa.array(text)
            h = levels.hashes(window)[pos].view(np.int64)
            g = (Levels(other(data, starts, ends)).hashes(window)[pos] >> np.uint64(32)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(h), pa.array(g), pa.array((pos - first[text]).astype(np.int32))], names=["doc_id", "tag", "h", "g", "pos"])

    return lean(rows)


def _removed(window: int):
    def rows(batches):
        for b in slices(batches, 2):
            gone, sha, texts = [], [], []
            for text, seen in zip(raw_texts(b.column(2)), b.column(3), strict=True):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int64)
                starts = seen.values.to_numpy()
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                keep = np.cumsum(edge[:-1]) == 0
                left = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])
                gone.append(len(words) - int(keep.sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                texts.append(left)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "tag", "n_removed", "kept_sha256", "kept_text"])

    return lean(rows)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, base: int = BASE) -> tuple[DataFrame, DataFrame]:
    """Remove every word that lies in a window of `window` words which also starts in a document with a smaller id.

    Returns two tables: one row per row of docs (doc_id, n_words, n_removed, kept_sha256), and the remaining text of
    those that lost words but are not whole copies (doc_id, kept_text).

    Levels: windows of `base` words are the first. Only those that several unlike texts have are extended to twice their
    length and the odd word, `window`, at which removals are decided; longer windows would decide nothing more, so the
    levels end there. At the first level one window in each run of `window` words stands for the run (see `anchors`),
    which is enough: equal runs choose the same one, so a run whose choice does not repeat cannot repeat either. The
    hash of a longer window is made of those of two shorter ones.

    Texts go by a hash (tag) of their own until the last level, so equal texts count once however many rows have them.
    Documents of one word sequence are combined: only the smallest id of each is searched, the rest lose all. Counts
    are pre-aggregated, and joins back are ones that AQE can split, so no key needs one task of its own.

    Null text has no words. Texts shorter than a window lose nothing. A null doc_id loses nothing and removes nothing.
    Rows of one doc_id, repeated or with unlike texts, are one document: they lose what smaller ids have, each from its
    own text, and don't remove each other's words. Very long texts are taken whole. Empty tables give empty tables;
    other columns are ignored, whatever their names.
    """
    text = F.col(text_col).cast("string")
    three = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    whole = stored(three.mapInArrow(_whole, "doc_id long, tag long, n_words long, sha string"), "whole")
    firsts = stored(whole.where("doc_id is not null").where(F.col("n_words") >= window).groupBy("sha", "n_words").agg(F.min("doc_id").alias("first_id")), "firsts")
    ranked = stored(whole.join(firsts, ["sha", "n_words"], "left"), "ranked")
    searched = ranked.where("doc_id = first_id").select("doc_id", "tag").distinct()

    found = three.where("doc_id is not null").select("tag", "text").mapInArrow(_anchored(base, window), "tag long, h long, pos int")
    repeated = found.groupBy("h").agg(F.min("tag").alias("a"), F.max("tag").alias("b")).where("a <> b").select("h")
    # Stored, so that the join has an exchange on either side: AQE splits a hash that many documents share only then.
    repeated = stored(repeated, "repeated")
    let_go(docs.sparkSession)
    per_text = found.join(repeated, "h", "left_semi").groupBy("tag").agg(F.collect_set("pos").alias("seen"))
    near = stored(three.join(per_text.join(searched, "tag"), ["doc_id", "tag"]).select("doc_id", "tag", "text", "seen"), "candidates")
    let_go(docs.sparkSession)

    at = near.mapInArrow(_windows(base, window), "doc_id long, tag long, h long, g long, pos int")
    least = at.groupBy("h", "g").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("h", "g", "least")
    least = stored(least, "least")
    let_go(docs.sparkSession)
    late = at.join(least, ["h", "g"]).where("doc_id > least").groupBy("doc_id", "tag").agg(F.collect_set("pos").alias("seen"))
    cut = near.select("doc_id", "tag", "text").join(late, ["doc_id", "tag"]).mapInArrow(_removed(window), "doc_id long, tag long, n_removed long, kept_sha256 string, kept_text string")
    cut = stored(cut, "cut").dropDuplicates(["doc_id", "tag"])
    let_go(docs.sparkSession)

    is_copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    empty = hashlib.sha256(b"").hexdigest()
    out = ranked.join(cut.drop("kept_text"), ["doc_id", "tag"], "left").select(
        "doc_id",
        "n_words",
        F.when(is_copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(is_copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
    return out, cut.select("doc_id", "kept_text")
