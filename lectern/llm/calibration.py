"""Bounded labelled samples, and the logistic curve that turns raw figures into scores from 0 to 1."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: At most so many documents of each class are fitted on, and so many bytes of text of each class.
SAMPLE_DOCS, SAMPLE_BYTES = 1600, 16 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[tuple[str, int, bool]], float | None]:
    """(text, label, odd) of at most `most` documents of each class, chosen by a hash of the id, never held-out ones.

    The sample's texts of a class have `most_bytes` bytes at most: they are taken whole, in the order of the hash, and
    one that would go beyond is passed over. So the bound is on the sample, and no text is out of it for its size alone
    unless it is larger than the whole bound. odd tells two halves apart, for fitting on one and looking at the other.
    The same text under several ids counts once. An id that has both labels counts as label 1. With the sample comes
    the share of label 1 among all labelled ids that aren't held out, None without any.
    """
    known = labels.select(F.col(id_col).cast("long").alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("k"))).groupBy("k").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.lit(5), "k")
    share = known.agg(F.avg("y")).first()[0]
    ids = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(order, "k").limit(most).collect()]
    if not ids:
        return [], None
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(r.k, r.y) for r in ids], "k long, y int"))
    text = F.col(text_col).cast("string")
    found = docs.select(F.col(id_col).cast("long").alias("k"), text.alias("text")).where(F.col("text") != "").join(wanted, "k")
    # Sizes first, so that no more text than the bound is ever sent to the driver. An id's rows are few or alike: of
    # equal ones a digest is counted once.
    named = F.sha2("text", 256)
    sizes = found.select("k", "y", F.octet_length("text").alias("n"), named.alias("name"), order.alias("h")).groupBy("k", "y", "n", "name").agg(F.min("h").alias("h"))
    left, taken = {0: most_bytes, 1: most_bytes}, {}
    for r in sizes.orderBy("h", "k", "n", "name").limit(4 * most).collect():
        if r.name not in taken and r.n <= left[r.y]:
            left[r.y] -= r.n
            taken[r.name] = (r.y, bool(r.h % 2))
    if not taken:
        return [], share
    names = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in taken], "name string"))
    rows = {r.name: r.text for r in found.select(named.alias("name"), "text").join(names, "name").groupBy("name").agg(F.min("text").alias("text")).collect()}
    return [(rows[x], *taken[x]) for x in taken], share


class Curve:
    """P(label 1) as a logistic function of figures that are first centred and scaled.

    share: of label 1 among the rows to be scored; each class of the sample is weighted to it.
    """

    def __init__(self, figures, labels, share: float | None = None, ridge: float = 1e-2, steps: int = 50):
        x, y = np.asarray(figures, float), np.asarray(labels, float)
        self.prior = (y.sum() + 0.5) / (len(y) + 1)
        self.width = x.shape[1] if x.ndim == 2 else 0
        if not len(y) or y.min() == y.max():
            self.weights = None  # one class alone: every score is its share
            return
        share = y.mean() if share is None else min(max(share, 0.01), 0.99)
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(y))])
        w = np.zeros(z.shape[1])
        penalty = ridge * np.eye(len(w)) * len(y) / 100
        penalty[-1, -1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            move = np.linalg.solve((z * (weight * p * (1 - p) + 1e-6)[:, None]).T @ z + penalty, z.T @ (weight * (y - p)) - penalty @ w)
            w = w + move
            if np.abs(move).max() < 1e-6:
                break
        self.weights = w

    def __call__(self, figures) -> np.ndarray:
        x = np.asarray(figures, float).reshape(-1, self.width or 1)
        if self.weights is None:
            return np.full(len(x), self.prior)
        z = (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
