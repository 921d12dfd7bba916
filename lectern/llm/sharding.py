"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import random

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stored

#: Text that a bucket holds, about; a task reads one bucket, or the few that hashing puts together.
BUCKET_BYTES = 32 << 20


def _fisher_yates(seed: int):
    def shuffle(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        # Rows arrive in whatever order the shuffle brings them: first a fixed order, then the seeded one.
        ids, names = table.column("id").to_pylist(), table.column("name").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, names[i]))
        draw = random.Random(xxhash.xxh64_intdigest(f"{seed}:{table.column('bucket')[0].as_py()}".encode()))
        for i in range(len(order) - 1, 0, -1):
            j = draw.randrange(i + 1)
            order[i], order[j] = order[j], order[i]
        first = table.column("first_rank")[0].as_py()
        taken = table.select(["id", "crc", "size", "text", "n_rows"]).take(pa.array(order, pa.int64()))
        return taken.append_column("rank", pa.array(range(first, first + len(order)), pa.int64()))

    return shuffle


def sharded(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row of docs in a uniformly random order dealt to `shards` shards: doc_id, text, size, text_crc32, shard, slot.

    First pass: rows scatter uniformly over buckets by a seeded hash of the id, of a hash of the text and, for rows that
    repeat both, of their count, so that no group of copies meets in one. There are as many buckets, and partitions, as
    keep one at about `bucket_bytes` of text. Second pass: each bucket is read whole by one task, put in a
    fixed order, shuffled by Fisher-Yates with a seed of its own and written. Buckets follow one another, so a row's
    rank is its bucket's first rank plus its place there; shard s takes the ranks from s/shards of all rows on, which
    keeps the counts of any two shards within one (the law `rows`). Slots count from 0 within each shard.

    The same rows and seed give the same shards, whatever the partitioning and however often a task is run again.
    size is the UTF-8 length of the text plus 1; null text has length 0 and the checksum of an empty text, and stays
    null. Rows alike in id and text are interchangeable. A very long text is one row of its bucket. Empty tables give
    empty tables; other columns are ignored, whatever their names.
    """
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    size = (F.octet_length(data) + 1).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.crc32(data).alias("crc"), size.alias("size"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("name"), F.lit(0).cast("long").alias("copy"))
    narrow = stored(rows.select("id", "name", "size"), "sizes")
    total = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-total[0] // bucket_bytes))
    alike = stored(narrow.groupBy("id", "name").agg(F.count("*").alias("n")).where("n > 1"), "alike")
    if not alike.isEmpty():
        # Copies are combined where they are read, counted, and set out again with a number each.
        same = rows["id"].eqNullSafe(alike["id"]) & (rows["name"] == alike["name"])
        several = rows.join(alike, same, "left_semi").groupBy("id", "crc", "size", "text", "name").agg(F.count("*").alias("n"))
        rows = rows.join(alike, same, "left_anti").unionByName(several.select("id", "crc", "size", "text", "name", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")))
        narrow = narrow.groupBy("id", "name").agg(F.count("*").alias("n")).select("id", "name", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    else:
        narrow = narrow.withColumn("copy", F.lit(0).cast("long"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "id", "name", "copy"), F.lit(buckets)).alias("bucket")
    counts = narrow.groupBy(bucket).agg(F.count("*").alias("n"))
    # Two steps, so that prefix sums of many buckets need no single task: sums of blocks of buckets, then within blocks.
    block = F.floor(F.col("bucket") / 4096)
    blocks = counts.groupBy(block.alias("block")).agg(F.sum("n").alias("bn"))
    blocks = blocks.select("block", (F.sum("bn").over(Window.orderBy("block")) - F.col("bn")).alias("before"))
    inside = counts.select("bucket", "n", block.alias("block")).join(blocks, "block")
    firsts = inside.select("bucket", (F.col("before") + F.sum("n").over(Window.partitionBy("block").orderBy("bucket")) - F.col("n")).alias("first_rank"))
    # Both sides are dealt alike, so each text moves once, and a task's share doesn't grow with the input. With fewer
    # partitions than the session's, the join would deal both sides once more.
    parts = max(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    scattered = rows.select("*", bucket).repartition(parts, "bucket")
    placed = scattered.join(firsts.repartition(parts, "bucket"), "bucket").withColumn("n_rows", F.lit(total[1]).cast("long"))
    dealt = placed.groupBy("bucket").applyInArrow(_fisher_yates(seed), "id long, crc long, size long, text string, n_rows long, rank long")
    shard = F.expr(f"cast((rank * {shards}) div n_rows as int)")
    start = F.expr(f"(shard * n_rows + {shards - 1}) div {shards}")
    return dealt.withColumn("shard", shard).select(F.col("id").alias("doc_id"), "text", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("rank") - start).alias("slot"))


def write_shards(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """sharded(docs, ...) as files: under `path` (a new folder in the shared one) a Parquet folder `shard=k` for each
    shard that has rows, whose files are in the order of slots; read back. Cases are treated as there."""
    found = sharded(docs, **options)
    path = path or scratch(docs.sparkSession, "shards")
    found.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path).select(found.columns)
