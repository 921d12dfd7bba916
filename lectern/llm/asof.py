"""Tolerant as-of join: shards of client hash and time chunk, each with a halo, joined by Acero's join_asof."""

from __future__ import annotations

import functools

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .common import stored

HOUR = 3_600_000_000
#: Times of a shard at most, a chunk's parts when it has more, and shards for each shuffle partition of the session.
ROWS, FAN, SHARDS = 1 << 15, 64, 4
#: Of a client's orders at one time: the largest total, the largest id with it, and how many there are.
_ORDER = "order_us long, total_cents long, sale_id long, n_tied long"


def micros(column: Column, kind: S.DataType) -> Column:
    """Microseconds since 1970 of a timestamp, read as UTC where it has no zone, whatever the session's zone is; a whole
    number is taken as it is."""
    if isinstance(kind, S.TimestampNTZType):
        apart = column - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return (apart.cast("interval second").cast("decimal(24,6)") * 1_000_000).cast("long")
    return F.unix_micros(column) if isinstance(kind, S.TimestampType) else column.cast("long")


def _digits_crc(column: Column) -> Column:
    return F.crc32(column.cast("string").cast("binary"))


def _coarse(us: Column, h: Column, hours: int) -> Column:
    """us, where h is odd as the last multiple of so many hours."""
    return F.when(h % 2 == 1, us - F.pmod(us, F.lit(hours * HOUR))).otherwise(us)


def clicks_to_match(clicks: DataFrame, hours: int = 6) -> DataFrame:
    """(click_id, client_id, ts_us): each id once. Of rows that share an id and differ, the latest counts, then the one of
    the largest client. Rows without an id are no clicks."""
    us = micros(F.col("ts"), clicks.schema["ts"].dataType)
    known = clicks.where("click_id is not null").select(F.col("click_id").cast("long").alias("click_id"), F.col("client_id").cast("long").alias("client_id"), us.alias("us"))
    once = known.groupBy("click_id").agg(F.max(F.struct("us", "client_id")).alias("c"))
    return once.select("click_id", "c.client_id", _coarse(F.col("c.us"), _digits_crc(F.col("click_id")), hours).alias("ts_us"))


def orders_of_sales(sales: DataFrame, hours: int = 6) -> DataFrame:
    """(client_id, order_us, total_cents, sale_id, priority): an order for each row, and for two in three another like it,
    of id -1 - sale_id and priority 6 - priority. A total that is null, NaN or infinite is null; a sale without an id has
    its own time and no second order."""
    h, us = _digits_crc(F.col("sale_id")), micros(F.col("sold_at"), sales.schema["sold_at"].dataType)
    total = F.col("total").cast("double")
    fine = ~F.isnan(total) & (F.abs(total) < float("inf"))
    cents = F.when(fine, F.floor(100 * total + 0.5).cast("long"))
    known = sales.select(F.col("client_id").cast("long").alias("client_id"), F.coalesce(_coarse(us, h, hours), us).alias("order_us"), cents.alias("total_cents"), F.col("sale_id").cast("long").alias("sale_id"), F.col("priority").cast("long").alias("priority"), h.alias("h"))
    one = F.struct("sale_id", "priority")
    both = F.array(one, F.struct((-1 - F.col("sale_id")).alias("sale_id"), (6 - F.col("priority")).alias("priority")))
    each = known.withColumn("o", F.explode(F.when(F.col("h") % 3 != 0, both).otherwise(F.array(one))))
    return each.select("client_id", "order_us", "total_cents", "o.sale_id", "o.priority")


def _summed(points: DataFrame, keys: list[str]) -> DataFrame:
    """Of each chunk: its times, whether any is asked for, and its last order."""
    last = F.max(F.when(F.col("is_order"), F.struct(F.col("us").alias("order_us"), "total_cents", "sale_id", "n_tied")))
    return points.groupBy(*keys).agg(F.count("*").alias("n"), F.max(~F.col("is_order")).alias("asked"), last.alias("last"))


def _chunked(points: DataFrame, width: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """points with the start of the chunk that each lies in, and (client_id, start, halo) of the chunks that are asked for.

    Chunks are as wide as the tolerance at first, so that of what lies before one only the last order of the chunk before
    can match: that is its halo. A chunk of more than `rows` times is cut into FAN parts, and those again; a part's halo is
    the last order of the parts before it, or else that of the whole. Times are unlike within a client, so that ends.
    """
    key = ["client_id", "start"]
    placed = points.withColumn("start", F.col("us") - F.pmod("us", F.lit(width))).withColumn("level", F.lit(0))
    before = Window.partitionBy("client_id").orderBy("start")  # as many rows as tolerances in the whole time
    sums = _summed(placed, key)
    halo = F.when(F.lag("start").over(before) == F.col("start") - width, F.lag("last").over(before))
    chunks = stored(sums.withColumn("halo", halo), "chunks")
    done, level = [], 0
    while True:
        # Every chunk that is cut has over `rows` times, so there are fewer of them than times by `rows`.
        cut = chunks.where(F.col("n") > rows) if width > 1 else chunks.where("false")
        if cut.isEmpty():
            return placed, functools.reduce(DataFrame.union, [*done, chunks.where("asked").select(*key, "halo")])
        done.append(chunks.where((F.col("n") <= rows) & F.col("asked")).select(*key, "halo"))
        width, level = -(-width // FAN), level + 1
        wide = cut.select("client_id", "start", F.col("start").alias("whole"))
        part = F.col("start") + (F.col("us") - F.col("start")) - F.pmod(F.col("us") - F.col("start"), F.lit(width))
        placed = placed.join(wide, key, "left").withColumn("start", F.when(F.col("whole").isNotNull(), part).otherwise(F.col("start")))
        placed = placed.withColumn("level", F.when(F.col("whole").isNotNull(), level).otherwise(F.col("level")))
        parts = stored(_summed(placed.where(F.col("level") == level), ["client_id", "whole", "start"]), "parts").join(cut.select("client_id", F.col("start").alias("whole"), "halo"), ["client_id", "whole"])
        earlier = Window.partitionBy("client_id", "whole").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # FAN rows at most
        chunks = stored(parts.withColumn("halo", F.coalesce(F.last("last", ignorenulls=True).over(earlier), "halo")).drop("whole"), "chunks")
        placed = placed.drop("whole")


def _joined(tolerance: int):
    def task(key, asked: pa.Table, orders: pa.Table) -> pa.Table:
        out = ["client_id", "us", "order_us", "total_cents", "sale_id", "n_tied"]
        if not asked.num_rows or not orders.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in out})
        asked, orders = asked.select(["client_id", "us"]), orders.select(["client_id", *out[2:]])
        # Acero takes keys in order, and none below zero.
        least = min(pc.min(asked["us"]).as_py(), pc.min(orders["order_us"]).as_py())
        left = asked.append_column("at", pc.subtract(asked["us"], least)).sort_by("at").combine_chunks()
        right = orders.append_column("at", pc.subtract(orders["order_us"], least)).sort_by("at").combine_chunks()
        found = left.join_asof(right, on="at", by="client_id", tolerance=-tolerance)
        return found.filter(pc.is_valid(found["order_us"])).select(out)

    return task


def asof_join(clicks: DataFrame, orders: DataFrame, tolerance_us: int, rows: int | None = None) -> DataFrame:
    """clicks (click_id, client_id, ts_us) with the latest order of the same client at or before, and at most tolerance_us
    earlier: click_id, client_id, ts_us, sale_id, lag_us, total_cents, n_tied.

    orders: (client_id, order_us, total_cents, sale_id). Of a client's orders at one time the one of the largest total_cents
    stands for all, then of the largest sale_id, nulls last; n_tied counts them. A row of either side without client or
    time matches nothing; such clicks have a row all the same, as do all without a match: n_tied 0, the rest null. Rows
    of clicks that repeat are matched each; empty tables give what that says. Columns with other names are ignored.

    Ties are collapsed first, and what is asked for likewise: a client's time once, however many clicks have it. Both
    sides' times lie in chunks (_chunked()), of which none has over `rows` of them, so that a client of many rows is spread
    over time; chunks are dealt to shards by a hash of client and start, with their halo as one order more. A shard is one
    task's cogroup, joined there by client. Matches join the clicks again by client and time.
    """
    spark = clicks.sparkSession
    valid = clicks.where("client_id is not null and ts_us is not null").select("click_id", "client_id", "ts_us")
    ties = orders.where("client_id is not null and order_us is not null").groupBy("client_id", "order_us").agg(F.max(F.struct("total_cents", "sale_id")).alias("top"), F.count("*").alias("n_tied"))
    ours = ties.select("client_id", F.col("order_us").alias("us"), F.lit(True).alias("is_order"), "top.total_cents", "top.sale_id", "n_tied")
    none = F.lit(None).cast("long")
    theirs = valid.select("client_id", F.col("ts_us").alias("us")).distinct().select("client_id", "us", F.lit(False), none, none, none)
    points = stored(ours.union(theirs), "points")
    total = points.count()
    rows = rows or max(256, min(ROWS, total // (SHARDS * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    placed, halos = _chunked(points, max(1, tolerance_us), rows)
    shard = F.pmod(F.xxhash64("client_id", "start"), F.lit(max(1, -(-total // rows)))).alias("shard")
    asked = placed.where("not is_order").select(shard, "client_id", "us")
    held = placed.where("is_order").select(shard, "client_id", F.col("us").alias("order_us"), "total_cents", "sale_id", "n_tied")
    held = held.union(halos.where("halo is not null").select(shard, "client_id", "halo.*"))
    held = held.select(*[F.col(c).alias(c) for c in held.columns])  # names of their own: both sides come of one table
    found = asked.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(_joined(max(0, tolerance_us)), "client_id long, us long, " + _ORDER)
    matched = valid.join(found.withColumnRenamed("us", "ts_us").hint("merge"), ["client_id", "ts_us"], "left")
    shown = matched.select("click_id", "client_id", "ts_us", "sale_id", (F.col("ts_us") - F.col("order_us")).alias("lag_us"), "total_cents", F.coalesce("n_tied", F.lit(0).cast("long")).alias("n_tied"))
    rest = clicks.where("client_id is null or ts_us is null").select("click_id", "client_id", "ts_us", none.alias("sale_id"), none.alias("lag_us"), none.alias("total_cents"), F.lit(0).cast("long").alias("n_tied"))
    return shown.union(rest)
