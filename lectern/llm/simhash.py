"""SimHash near-dedup over pivot distance tables."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, lean, raw_texts, slices, stored
from .components import connected_components

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Bits are cut into four blocks; two fingerprints within two bits agree on two blocks at least.
BLOCKS, PER_BLOCK = 4, 8
PAIRS = [(a, b) for a in range(BLOCKS) for b in range(a + 1, BLOCKS)]
#: Bits that are still open at each level, and how many fingerprints of a cell are paired up rather than dealt further.
WIDTHS, CROWDED = (64, 32, 16, 8), 64

_LOWER = bytes(range(65)) + UPPER.lower().encode() + bytes(range(91, 256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text's word shingles; 0 for a text without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: len(words) - shingle].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    return majority(hashes)


def majority(hashes) -> int:
    """The bits that are set in over half of the hashes."""
    n, total = len(hashes), np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):  # a bounded table of bits, however long the text
        part = np.array(hashes[k : k + (1 << 15)], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


@lean
def _fingerprints(batches):
    for b in slices(batches, 2):
        prints = np.array([fingerprint(x) for x in raw_texts(b.column(2))], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints)], names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): a hash of each text, and its SimHash, as signed longs."""
    text = F.col(text_col).cast("string")
    three = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return three.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def references(width: int = WIDTHS[0], seed: int = 7) -> list[int]:
    """The reference fingerprints: a base, then for each block copies of it with other bits in that block alone.

    The difference between the distances to a copy and to the base depends on that block only.
    """
    draw, part = random.Random(f"{seed}:{width}"), width // BLOCKS
    base, mask = draw.getrandbits(width), (1 << part) - 1
    # A narrow block has a copy for each bit, so that equal differences mean equal blocks.
    others = [[draw.getrandbits(part) for _ in range(PER_BLOCK)] if part > PER_BLOCK else [(base >> part * b & mask) ^ 1 << j for j in range(part)] for b in range(BLOCKS)]
    return [base] + [base & ~(mask << part * b) | x << part * b for b in range(BLOCKS) for x in others[b]]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distance_row(bits, width: int = WIDTHS[0]):
    """Hamming distances of a column of so many bits to every reference."""
    return F.array(*[F.bit_count(bits.bitwiseXOR(F.lit(_signed(r)).cast("long"))).cast("tinyint") for r in references(width)])


def _cells(row, bits, width: int, *above):
    """(cell, rest) for each pair of blocks: the differences of distances that depend on these two, and the others' bits."""
    part, copies = width // BLOCKS, (len(references(width)) - 1) // BLOCKS
    own = [[row[1 + b * copies + j] - row[0] for j in range(copies)] for b in range(BLOCKS)]
    block = [F.shiftrightunsigned(bits, part * b).bitwiseAND(F.lit((1 << part) - 1).cast("long")) for b in range(BLOCKS)]
    out = []
    for k, (a, b) in enumerate(PAIRS):
        c, d = (x for x in range(BLOCKS) if x not in (a, b))
        out.append(F.struct(F.xxhash64(F.lit(k), *above, *own[a], *own[b]).alias("cell"), F.shiftleft(block[c], part).bitwiseOR(block[d]).alias("rest")))
    return F.explode(F.array(*out))


def near_links(prints: DataFrame, distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """Links (u, v) between distinct fingerprints fp: all that lie within `distance` (2 at most).

    Every fingerprint is stored with its row of distances to the references. Fingerprints within two bits differ in two
    of four blocks at most, so their rows agree, difference by difference, on two blocks: that gives six cells each. The
    rows of those that meet in a cell are compared, pairs of a larger coordinate difference discarded, and survivors
    verified.

    A cell of more than `crowded` is dealt further by the same rule: the bits that are still open are cut into four
    blocks with references of their own. After the last level four open bits are left, so a cell is small however many
    fingerprints were in the first; none is passed over.
    """
    if distance != DISTANCE:
        raise ValueError("the block layout is made for a distance of 2")
    rows = stored(prints.select("fp", distance_row(F.col("fp")).alias("row")), "distances")
    own = rows.select("fp", _cells(F.col("row"), F.col("fp"), WIDTHS[0]).alias("at")).select("fp", "at.*")
    links = None
    for level, width in enumerate(WIDTHS, 1):
        # Stored, so that the join has an exchange on either side: AQE splits a crowded cell only then.
        sizes = stored(own.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        met = stored(own.join(sizes, "cell"), "cells")
        last = level == len(WIDTHS)
        few = (met if last else met.where(F.col("n") <= crowded)).select("cell", "fp").join(rows, "fp")
        a, b = few.select("cell", F.col("fp").alias("u"), F.col("row").alias("x")), few.select("cell", F.col("fp").alias("v"), F.col("row").alias("y"))
        far = F.array_max(F.zip_with("x", "y", lambda x, y: F.abs(x - y)))
        found = a.join(b, "cell").where("u < v").where(far <= distance).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance).select("u", "v")
        links = found if links is None else links.union(found)
        many = met.where(F.col("n") > crowded)
        if last or many.isEmpty():
            return links.distinct()
        bits = F.col("rest")
        own = many.select("fp", _cells(distance_row(bits, WIDTHS[level]), bits, WIDTHS[level], F.lit(level), F.col("cell")).alias("at")).select("fp", "at.*")
    raise AssertionError("the last level returns")


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, component_hash): the last two are of the row that stands for the component."""
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("least")
    distinct = stored(prints.groupBy("fp").agg(least), "distinct")
    labels = connected_components(near_links(distinct.select("fp")))
    linked = stored(distinct.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "linked")
    firsts = stored(linked.groupBy("label").agg(F.min("least").alias("first")), "firsts")
    classes = stored(linked.join(firsts, "label").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("component_hash")), "classes")
    return prints.join(classes, "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable).

    Words are runs of anything but ASCII white space, after lower-casing A-Z. Null and empty texts, and texts of white
    space, have fingerprint zero and are linked like any other; a text of fewer words than a shingle is one shingle.
    Rows with equal fingerprints are combined before any search, so a large group of copies counts once. A null doc_id
    is never the smallest; a component of nothing else has a null component_id. Repeated rows each give a row; rows of
    one id and unlike texts are compared each for itself. Empty tables give empty tables; other columns are ignored,
    whatever their names.
    """
    return _components(docs, id_col, text_col).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one document of each component of simhash_components(): the one of the smallest id.

    A row goes by its id and its text, so an id that several texts have stays or goes with each of them; of unlike texts
    in one component that share the smallest id, the one of the smallest hash stays. Rows that repeat the one that stays
    do too, as do rows without an id. Null, empty and very long texts are fingerprinted like any other. An empty table
    stays empty. Other columns stay as they are, whatever their names.
    """
    stays = (F.col("doc_id") == F.col("component_id")) & (F.col("text_hash") == F.col("component_hash"))
    lost = stored(_components(docs, id_col, text_col).where(F.col("doc_id").isNotNull() & ~stays).select("doc_id", "text_hash").distinct(), "lost")
    return docs.join(lost, (docs[id_col].cast("long") == lost["doc_id"]) & (F.xxhash64(docs[text_col].cast("string")) == lost["text_hash"]), "left_anti")
