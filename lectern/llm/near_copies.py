"""Near copies by Jaccard similarity of word shingles: SimHash over pivot distance tables first, an exact prefix join for
the links that lie further apart, and components of all."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, lean, let_go, parted, raw_texts, slices, small_batches, stored
from .components import connected_components
from .simhash import _LOWER, SEED, majority, near_links

#: Two texts are near copies if they share SIMILAR[0] / SIMILAR[1] of their five-word shingles or more.
SHINGLE, SIMILAR = 5, (4, 5)
#: The order of shingles comes from about so many documents, and has so many common shingles at most.
ORDER_DOCS, ORDER_SHINGLES, ORDER_LEAST = 20_000, 200_000, 3
#: A bucket of more sets than this is first searched by pivots, so many for each.
CROWDED, ROUNDS = 32, 2
#: Sets outside a bucket's largest component that are still met one by one; more of them meet by a second shingle.
APART = 1024
#: Shingles of sets that a task holds, for the next pair, before it starts anew.
HELD = 1 << 20
#: The columns of a set's sketch.
SKETCH = ("k0", "k1", "k2", "k3")
#: Sets of more shingles than this have a sketch of as many classes as shingles besides: 256 can't tell them apart.
LONG = 256


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's word shingles, each once, in order of size; a shorter text is one shingle."""
    words = text.translate(_LOWER).split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts)).view(np.int64))


def sketch(s: np.ndarray) -> np.ndarray:
    """Of 256 classes of hashes, whether a set has an odd number of members in each, as four longs. One shingle more or
    less turns one bit, so two sketches differ in no more bits than their sets do in shingles."""
    odd = np.bincount((s & 255).astype(np.int64), minlength=256).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def long_sketch(s: np.ndarray) -> np.ndarray | None:
    """A sketch of one bit or two for each shingle of a set of more than LONG. Its halves, one turned by the other, are the
    sketch of half as many classes."""
    if len(s) <= LONG:
        return None
    classes = 1 << (len(s) - 1).bit_length()
    odd = np.bincount((s & (classes - 1)).astype(np.int64), minlength=classes).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))


@lean
def _plain(batches):
    for b in slices(batches, 0):
        yield pa.RecordBatch.from_arrays([_lists([shingle_set(x) for x in raw_texts(b.column(0))])], names=["shingles"])


def common_shingles(docs: DataFrame, text_col: str, most: int = ORDER_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about `most` documents have, sorted, and in how many. They only set an order in which
    common shingles are last, which decides what the join costs and not what it finds."""
    every = max(1, docs.count() // most)
    text = F.col(text_col).cast("string")
    few = small_batches(docs).where(F.pmod(F.xxhash64(text), F.lit(every)) == 0).select(text.alias("text")).mapInArrow(_plain, "shingles array<long>")
    counts = few.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= ORDER_LEAST)
    rows = sorted(counts.orderBy(F.desc("n"), "s").limit(ORDER_SHINGLES).collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def first_shingles(s: np.ndarray, share: int = 1) -> np.ndarray:
    """Of a set in the common order, those of which it shares so many with every similar set, smaller or not."""
    x, y = SIMILAR
    return s[: len(s) - -(-len(s) * x // y) + share]


def _ordered(order):
    def rows(batches):
        known, times = order.value
        for b in slices(batches, 2):
            firsts, afters, sizes, names, seconds, sketches, prints, wides = [], [], [], [], [], [], [], []
            for text in raw_texts(b.column(2)):
                s = shingle_set(text)
                data = s.tobytes()
                sketches.append(sketch(s))
                wides.append(long_sketch(s))
                prints.append(majority(s.view(np.uint64)))
                names.append(xxhash.xxh3_64_intdigest(data, SEED))
                seconds.append(xxhash.xxh64_intdigest(data, SEED + 1))
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[at] == s, times[at], 0), kind="stable")]
                sizes.append(len(s))
                firsts.append(first_shingles(s))
                afters.append(int(s[len(firsts[-1])]) if len(firsts[-1]) < len(s) else None)
            both = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (names, seconds, prints)]
            bits = [pa.array(x) for x in np.array(sketches).reshape(-1, 4).T]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *both, pa.array(sizes, pa.int32()), _lists(firsts), pa.array(afters, pa.int64()), *bits, pa.array(wides, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "node", "second", "fp", "n", "first", "after", *SKETCH, "wide"])

    return lean(rows)


def _members(x: pa.Scalar) -> np.ndarray:
    """The set that a text, or a set as longs, stands for; null is a text without words."""
    if pa.types.is_list(x.type):
        return x.values.to_numpy()
    return shingle_set(x.as_buffer().to_pybytes() if x.is_valid else b"")


@lean
def _near(batches):
    """Of pairs (u, v, a, b), the names of those whose sets a and b are similar, counted shingle by shingle."""
    x, y = SIMILAR
    made, size = {}, 0
    for b in batches:
        names, keep = [b.column(k).to_pylist() for k in (0, 1)], []
        for k in range(b.num_rows):
            pair = []
            for name, column in ((names[0][k], b.column(2)), (names[1][k], b.column(3))):
                if (s := made.get(name)) is None:
                    s = _members(column[k])
                    if size > HELD:
                        made, size = {}, 0
                    made[name], size = s, size + len(s)
                pair.append(s)
            both = len(np.intersect1d(*pair, assume_unique=True))
            keep.append(both * (x + y) >= (len(pair[0]) + len(pair[1])) * x)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def first_sets(texts: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, fp, n, first, after, k0 to k3, wide) of texts(doc_id, text_hash, text): a name that no unlike
    set has, the SimHash of the set, its size, its first shingles in the common order, the one after them, and its sketches.

    A name has 64 bits of a hash. Where unlike sets share it, by a second hash of 64 bits, those few take names of both
    hashes instead, until none is shared: no text is read again for that."""
    order = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, "text"))
    let_go(texts.sparkSession)
    sets = stored(small_batches(texts).mapInArrow(_ordered(order), "doc_id long, text_hash long, node long, second long, fp long, n int, first array<long>, after long, " + ", ".join(f"{k} long" for k in SKETCH) + ", wide array<long>"), "sets")
    return _apart(sets).drop("second")


def _apart(sets: DataFrame) -> DataFrame:
    for seed in count(1):
        shared = sets.groupBy("node").agg(F.min("second").alias("a"), F.max("second").alias("b")).where("a <> b").select("node", F.lit(True).alias("shared"))
        if shared.isEmpty():
            return sets
        sets = sets.join(stored(shared, "shared"), "node", "left").withColumn("node", F.when(F.col("shared"), F.xxhash64(F.lit(seed), "node", "second")).otherwise(F.col("node"))).drop("shared")


def _meet(a: DataFrame, b: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Pairs of (s, u, n, i) and (s, v, m, j) whose sets can be similar, if s is the first shingle that they share: by
    their sizes, and by what is left of both from there on. For similar sets, that holds at their first one."""
    x, y = SIMILAR
    n, m = F.col("n"), F.col("m")
    alike = F.least(n, m) * y >= F.greatest(n, m) * x
    enough = F.least(n - F.col("i"), m - F.col("j")) * (x + y) >= (n + m) * x
    return a.join(b, key or ["s"]).where(alike).where(enough)


def _sketched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of different components, as far as sets(label) knows, whose sketches leave room for similar sets."""
    one = sets.select(F.col("node").alias("u"), F.col("n").alias("n"), F.col("label").alias("one"), *[F.col(k).alias(f"u{k}") for k in SKETCH])
    other = sets.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("label").alias("other"), *[F.col(k).alias(f"v{k}") for k in SKETCH])
    return pairs.join(one, "u").join(other, "v").where("one <> other").where(_alike("u", "v")).select("u", "v")


def _alike(u: str, v: str):
    """Whether sketches of sets of n and m shingles differ in no more bits than similar sets do in shingles."""
    x, y = SIMILAR
    differ = sum((F.bit_count(F.col(f"{u}{k}").bitwiseXOR(F.col(f"{v}{k}"))) for k in SKETCH), F.lit(0))
    return differ * (x + y) <= (F.col("n") + F.col("m")) * (y - x)


def _sketched_long(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """The pairs (u, v) but those of two long sets, wide(node, n, wide), that can't be similar: by their sizes or by the bits
    in which their long sketches differ. A long sketch moves in place of a text."""
    x, y = SIMILAR
    ends = [wide.select(F.col("node").alias(k), F.col("n").alias(f"{k}_n"), F.col("wide").alias(f"{k}_wide")) for k in ("u", "v")]
    n, m, a, b = (F.col(c) for c in ("u_n", "v_n", "u_wide", "v_wide"))
    classes = F.least(F.size(a), F.size(b))

    def folded(s):  # sets of like sizes have as many classes, or twice as many
        half = F.floor(F.size(s) / 2).cast("int")
        return F.when(F.size(s) > classes, F.zip_with(F.slice(s, F.lit(1), half), F.slice(s, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(s)

    differ = F.aggregate(F.zip_with(folded(a), folded(b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, k: s + k)
    near = (F.least(n, m) * y >= F.greatest(n, m) * x) & (differ * (x + y) <= (n + m) * (y - x))
    return pairs.join(ends[0], "u", "left").join(ends[1], "v", "left").where(F.coalesce(near, F.lit(True))).select("u", "v")


def _verified(pairs: DataFrame, sets: DataFrame, whole, wide: DataFrame | None = None) -> DataFrame:
    """The pairs (u, v) whose sets are similar; whole(nodes) gives nodes with what their sets are counted from: the texts,
    which move in less than half of the bytes, or the sets as longs. They move for pairs alone that no sketch rules out."""
    pairs = stored(_sketched(pairs.distinct(), sets), "pairs")
    if wide is not None:
        pairs = stored(_sketched_long(pairs, wide), "alike")
    nodes = stored(pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct(), "nodes")
    some = stored(whole(nodes), "candidates")
    a, b = (some.select(F.col("node").alias(end), F.col(some.columns[1]).alias(content)) for end, content in (("u", "a"), ("v", "b")))
    links = stored(small_batches(pairs).join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(_near, "u long, v long"), "links")
    discarded(some)  # the largest of the scratch tables
    let_go(links.sparkSession)
    return links


def fingerprint_links(sets: DataFrame, whole, wide: DataFrame | None = None) -> DataFrame:
    """Links (u, v) between similar sets of sets(node, fp, n, k0 to k3) whose fingerprints are equal or close: operator 1's
    search over pivot distance tables, each pair of fingerprints that it finds, and what it finds verified by whole sets.

    A fingerprint that several sets have is searched once; of its sets each is held against the one of the smallest name.
    So is each fingerprint against the smallest that is close, so the pairs to verify are fewer than sets: those of a large
    family needn't all be paired up, as similar_links() finds every link between components that is left.
    """
    prints = stored(sets.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    equal = sets.join(prints, "fp").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    close = near_links(prints.select("fp")).groupBy("v").agg(F.min("u").alias("u"))
    ends = [prints.select(F.col("fp").alias(k), F.col("first").alias(f"{k}_node")) for k in ("u", "v")]
    close = close.join(ends[0], "u").join(ends[1], "v").select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v"))
    return _verified(equal.union(close), sets.withColumn("label", F.col("node")), whole, wide)


def similar_links(sets: DataFrame, whole, crowded: int = CROWDED, rounds: int = ROUNDS, known: DataFrame | None = None, wide: DataFrame | None = None) -> DataFrame:
    """Links (u, v) between nodes of sets(node, n, first, after, k0 to k3), one row a node: enough to join all similar ones.
    Those of `known` are taken over, and sets that they join aren't compared again.

    Sets of n and at least 4 n / 5 shingles that are similar share 4 n / 5 shingles or more, so under any common order
    they share one of their first n / 5 + 1. Those are the buckets. What meets in one is compared by length and place,
    then by sketches, of long sets by long ones too (wide: node, n, wide), and verified by whole sets, which whole(nodes)
    gives as (node, text) or (node, shingles).

    A bucket of over `crowded` sets is not paired up at once. First each of its sets is compared with some pivots: the one
    that has the fewest rarer shingles, so that it is in the middle of copies that were changed here and there, and for
    further rounds any one. Then only sets of different components are paired: those outside a bucket's largest component
    with all that are in another. Sets of one component need no more links, so nothing is lost. Where more than APART are
    outside, sets meet by that shingle and a second one: similar sets share two of their first n / 5 + 2 shingles as well
    (all but equal ones share four or more). So unlike sets that have one shingle in common cost a row for each of their
    first shingles, not one for each other.
    """
    entries = sets.select("node", "n", F.posexplode("first").alias("i", "s"))
    if known is None:
        parts = sets.select("node", "n", F.col("node").alias("label"), *SKETCH)
    else:
        parts = sets.select("node", "n", *SKETCH).join(connected_components(known), "node", "left")
        parts = stored(parts.withColumn("label", F.coalesce("label", "node")), "parts")
    # Stored, so that the join has an exchange on either side: AQE splits a shingle that many sets have only then.
    sizes = stored(entries.groupBy("s").agg(F.count("*").alias("members")).where("members > 1"), "sizes")
    met = stored(entries.join(sizes, "s"), "buckets")
    let_go(sets.sparkSession)  # all first shingles have moved twice; texts are next
    small = met.where(F.col("members") <= crowded)
    a = small.select("s", F.col("node").alias("u"), "n", "i")
    b = small.select("s", F.col("node").alias("v"), F.col("n").alias("m"), F.col("i").alias("j"))
    links = _verified(_meet(a, b).where("u < v").select("u", "v"), parts, whole, wide)
    if known is not None:
        links = links.union(known.select("u", "v"))
    busy = met.where(F.col("members") > crowded).select("s", "node", "n", "i")
    if busy.isEmpty():
        return links
    # Verified round by round: all at once would read texts fewer times, but hold more on disk and in memory.
    for k in range(rounds):
        at_random = F.xxhash64("node", "s", F.lit(k))
        pivots = stored(busy.groupBy("s").agg(F.min_by("node", F.struct("i", at_random) if k == 0 else at_random).alias("pivot")), "pivots")
        pairs = busy.join(pivots, "s").where("node <> pivot").select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v"))
        links = links.union(_verified(pairs, parts, whole, wide))
    labels = connected_components(links)
    members = stored(busy.join(labels, "node", "left").select("s", "node", "n", "i", F.coalesce("label", "node").alias("label")), "members")
    counts = members.groupBy("s", "label").agg(F.count("*").alias("k"))
    mixed = counts.groupBy("s").agg(F.max_by("label", F.struct("k", "label")).alias("largest"), (F.sum("k") - F.max("k")).alias("outside"), F.count("*").alias("parts"))
    mixed = stored(mixed.where("parts > 1").select("s", "largest", "outside"), "mixed")
    if mixed.isEmpty():
        return links
    held = stored(members.join(mixed, "s").join(sets.select("node", *SKETCH), "node"), "held")
    few = held.where(F.col("outside") <= APART)
    rest = _unlike(few, ["s"])
    many = held.where(F.col("outside") > APART)
    if not many.isEmpty():
        after = sets.select("node", F.posexplode(F.when(F.col("after").isNotNull(), F.concat("first", F.array("after"))).otherwise(F.col("first"))).alias("at", "t"))
        rest = rest.union(_unlike(stored(many.join(after, "node").where("at > i"), "seconds"), ["s", "t"]))
    return links.union(_verified(rest, parts, whole, wide))


def _unlike(held: DataFrame, key: list[str]) -> DataFrame:
    """Pairs (u, v) of different components, one of them outside the bucket's largest, that meet by the key and can be similar."""
    a = held.where("label <> largest").select(*key, F.col("node").alias("u"), "n", "i", F.col("label").alias("one"), *[F.col(k).alias(f"u{k}") for k in SKETCH])
    b = held.select(*key, F.col("node").alias("v"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("label").alias("other"), *[F.col(k).alias(f"v{k}") for k in SKETCH])
    return _meet(a, b, key).where("one <> other").where(_alike("u", "v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).where("doc_id is not null")
    sets = first_sets(rows)
    copies = stored(sets.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")).where("rows > 1").select("node", "first_id"), "copies")
    once = sets
    if not copies.isEmpty():
        kept = sets.join(copies, "node", "left").where("first_id is null or doc_id = first_id").drop("first_id")
        once = stored(kept.dropDuplicates(["node"]), "once")

    def whole(nodes: DataFrame) -> DataFrame:
        places = stored(once.join(nodes, "node", "left_semi").select("doc_id", "text_hash", "node"), "places")
        _, some = parted(rows, rows["doc_id"], places)  # so that no other texts move
        return some.join(places, ["doc_id", "text_hash"]).select("node", "text")

    wide = once.where("wide is not null").select("node", "n", "wide")
    known = fingerprint_links(once.select("node", "fp", "n", *SKETCH), whole, wide)
    labels = connected_components(similar_links(once.select("node", "n", "first", "after", *SKETCH), whole, known=known, wide=wide))
    named = sets.select("doc_id", "text_hash", "node").join(labels, "node", "left").select("doc_id", "text_hash", F.coalesce("label", "node").alias("label"))
    named = stored(named, "named")
    firsts = stored(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "firsts")
    return stored(named.join(firsts, "label").select("doc_id", "text_hash", "component_id"), "components")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of rows with an id: the smallest doc_id that is reachable by near copies.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Words are those of
    simhash_components(); a text of fewer than five words is one shingle, so it is only like texts of the same words,
    and texts without words are alike. Equal sets are combined before any search. Rows without an id are compared with
    none. Repeated rows each give a row. Empty tables give empty tables; other columns are ignored.
    """
    return _components(docs, id_col, text_col).select("doc_id", "component_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one document of each component of similar_components(): the one of the smallest id.
    Rows without an id stay, as do repeated rows of one that stays; rows of one id and unlike texts go each by its own.
    Null and empty texts have no words and are alike; very long texts are compared whole. An empty table stays empty.
    Other columns stay as they are, whatever their names."""
    found = _components(docs, id_col, text_col)
    lost = stored(found.where("doc_id <> component_id").select("doc_id", "text_hash").distinct(), "lost")
    others, some = parted(docs, docs[id_col].cast("long"), lost)
    # A row that can be lost is lost for certain unless its id can be one that stays (or none), so few texts move to the join.
    stay = found.where("doc_id = component_id").select("doc_id").union(docs.sparkSession.range(1).select(F.lit(None).cast("long")))
    _, taken = parted(stay, stay["doc_id"], lost)
    _, some = parted(some, some[id_col].cast("long"), stored(taken, "taken"))
    return others.union(some.join(lost, (some[id_col].cast("long") == lost["doc_id"]) & (F.xxhash64(some[text_col].cast("string")) == lost["text_hash"]), "left_anti"))
