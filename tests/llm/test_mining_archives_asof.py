"""Hard negatives, WARC archives and the as-of join: against brute force, and on awkward rows."""

import gzip
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import asof, negatives, warc

# Hard negatives


def mined(rows, positives=5, count=3):
    """(anchor, positive, rank, negative, scores) of rows (vec_id, label, v), in plain Python integers."""
    out = []
    anchors = {}
    for i, label, v in rows:
        if i % 50 == 0:
            anchors.setdefault(i, (label, v))

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    for a, (label, v) in anchors.items():
        scored = sorted(((-dot(v, w), i, k) for i, k, w in rows if i != a))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            found = [(-t, i) for t, i, k in scored if k != label and 50 * -s <= 100 * -t <= 95 * -s][:count]
            out += [(a, p, r, i, -s, t) for r, (t, i) in enumerate(found, 1)]
    return sorted(out)


def got_negatives(spark, rows, **how):
    vectors = spark.createDataFrame(rows, "vec_id long, label long, v array<long>").repartition(3)
    found = negatives.hard_negatives(vectors, vectors.where("vec_id % 50 = 0"), **how)
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("how", [{}, {"shard": 400, "group": 40}])
def test_negatives_are_those_of_brute_force(spark, how):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) * 30
    # Clusters, many ties, copies of one vector, zeros.
    rows = [(i, int(rng.integers(0, 3)), np.floor(centres[i % 6] + rng.normal(size=8) * 4).astype(int).tolist()) for i in range(1500)]
    rows += [(2000 + i, i % 3, [7] * 8) for i in range(500)] + [(3000, 1, [0] * 8)]
    assert got_negatives(spark, rows, **how) == mined(rows)


def test_negatives_beyond_doubles_and_of_unequal_lengths(spark):
    rows = [(0, 0, [1 << 31, 3]), (1, 0, [1 << 31, 2]), (2, 1, [(1 << 31) - (1 << 27), 5, 9]), (3, 1, [(1 << 31) - (1 << 27), 5]), (4, 1, [(1 << 30), 1]), (50, 1, []), (51, 0, [-5])]
    assert got_negatives(spark, rows) == mined(rows)


def test_scans_leave_intervals_out():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16)) * 300
    rows = np.floor(np.concatenate([c + rng.normal(size=(1024, 16)) for c in centres])).astype(np.int64)
    most = float((rows.astype(float) ** 2).sum(axis=1).max())
    keys = negatives.Keys(np.arange(len(rows)), np.zeros(len(rows), int), rng.permutation(rows)[:128], most, 8, 32)
    pivot, key = keys.placed(rows)
    cell = keys.cells(pivot, key)
    keys.held = np.isin(np.arange(len(keys.pivots)), cell)
    keys.low, keys.high = (np.array([f(key[cell == c], initial=w) for c in range(len(keys.pivots))]) for f, w in ((np.min, np.inf), (np.max, 0)))
    queries = rows[::512]
    scores = queries @ rows.T
    kth = np.sort(scores, axis=1)[:, -20].astype(float)
    away, square = keys.away(queries)
    reached = keys.reached(away, square, kth, np.full(len(queries), np.inf))
    assert reached.sum() < 0.7 * reached.size
    for q, c in np.argwhere(~reached):
        assert not (scores[q, cell == c] >= kth[q]).any()
    # The inner side of an annulus: nothing far below the best is near.
    far = keys.reached(away, square, np.full(len(queries), -np.inf), np.full(len(queries), scores.min() / 2.0))
    for q, c in np.argwhere(~far):
        assert not (scores[q, cell == c] <= scores.min() / 2.0).any()
    assert not far.all()


def test_negatives_of_awkward_rows(spark):
    rows = [(0, 1, [1.0, 0.5]), (7, 0, [1.0, 0.5]), (1, None, [1.0, 1.0]), (2, 1, None), (3, 1, [1.0, None]), (4, 2, [float("nan"), 1.0]), (5, 2, [0.6, 0.5]), (None, 2, [0.6, 0.5]), (6, 2, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("v", F.lit("x")).withColumn("score", F.lit(1))
    v = negatives.labelled(vectors)
    # 0 and 7 are divided by seven: their labels are the next ones.
    assert sorted(map(tuple, v.collect())) == [(0, 2, [256, 128]), (5, 2, [153, 128]), (6, 2, []), (7, 1, [256, 128])]
    assert negatives.hard_negatives(v, v.where("vec_id % 50 = 0")).count() == 0
    nothing = v.where("false")
    found = negatives.hard_negatives(nothing, nothing)
    assert found.count() == 0 and found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


# WARC


def archived(spark, tmp_path, rows, **how):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("name", F.lit("x"))
    spark_path = str(tmp_path / "in")
    pages.write.parquet(spark_path)
    out = str(tmp_path / "warc")
    warc.write_warc(spark.read.parquet(spark_path), out, **how)
    return out


def test_archives_give_back_what_was_written(spark, tmp_path):
    long = "".join(random.Random(3).choices("abc é\U0001f600\r\n", k=60_000))
    rows = [(1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, None), (4, "http://c/", ""), (5, "http://d/", long), (6, "u", "WARC/1.1\r\n\r\n\r\nContent-Length: 5\r\n\r\n0\r\n\r\n"), (None, "n", "same"), (None, "n", None), (7, "s", "same"), (7, "s", "same")]
    out = archived(spark, tmp_path, rows, segment=1000)
    records = warc.read_warc(spark, out)
    kinds = {r.kind: r["count"] for r in records.groupBy("kind").count().collect()}
    assert kinds["response"] == 4 and kinds["revisit"] == 6 and kinds["continuation"] > 60
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.complete) for r in warc.archived_pages(records).collect()), key=repr)
    top = {"same": 7, "": 4}
    expected, first = [], set()
    for i, _, t in rows:
        t = t or ""
        data, winner = t.encode(), top.get(t, i)
        own = i == winner and (i, t) not in first
        first.add((i, t)) if own else None
        expected.append((i, len(data), warc.digest(data), "response" if own else "revisit", None if own else winner, True))
    assert got == sorted(expected, key=repr)
    texts = {r.page_id: bytes(r.payload).decode() for r in warc.payloads(records).where("kind = 'response'").collect()}
    assert texts == {4: "", 5: long, 6: rows[5][2], 7: "same"}
    assert {r.uri for r in records.where("page_id = 2").collect()} == {"http://b/%0D%0AX:%20y"}


def test_small_payloads_are_all_responses(spark, tmp_path):
    out = archived(spark, tmp_path, [(1, "a", "abc"), (2, "a", "abc"), (3, "a", "abcd"), (4, "a", "abcd")], least=4)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archived_pages(warc.read_warc(spark, out)).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_segments_in_any_order_lost_doubled_or_wrong(spark):
    block = warc._HTTP + warc.chunked(b"x" * 5000, 700)
    parts = [(f"s{k}", block[at : at + 1000]) for k, at in enumerate(range(0, len(block), 1000), 1)]

    def record(origin, k, data, total=None):
        first = k == 1
        return (origin if first else f"{origin}/{k}", "response" if first else "continuation", "u", None, None, None if first else origin, 9 if first else None, k, total, bytearray(data))

    def all_of(origin):
        return [record(origin, k, data, len(block) if k == len(parts) else None) for k, (_, data) in enumerate(parts, 1)]

    rows = all_of("fine")[::-1] + all_of("twice") + all_of("twice")[1:3]
    rows += [r for r in all_of("gap") if r[7] != 3] + [r for r in all_of("headless") if r[7] != 1] + all_of("cut")[:-1]
    rows += all_of("unlike") + [record("unlike", 2, b"y" * 1000)]
    rows += [(*r[:8], 7 if r[8] else None, r[9]) for r in all_of("total")]
    rows.append(("lone", "response", "u", "sha1:AAAA", None, None, 9, None, None, bytearray(block)))
    got = {r.record_id: (r.complete, None if r.payload is None else len(r.payload)) for r in warc.payloads(spark.createDataFrame(rows, warc.RECORD).repartition(3)).collect()}
    assert got == {"fine": (True, 5000), "twice": (True, 5000), "lone": (False, 5000), **dict.fromkeys(("gap", "headless", "cut", "unlike", "total"), (False, None))}


def test_files_of_others():
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nX-Long: a\r\n  b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    two = one.replace(b"<a>", b"<b>")
    names = [f["warc-record-id"] for f, _ in warc.parsed(one + two)]
    assert names == ["<a>", "<b>"]
    assert [(f["x-long"], b) for f, b in warc.parsed(gzip.compress(one) + gzip.compress(two))] == [("a b", b"abc")] * 2
    assert [b for _, b in warc.parsed(one + two[:-8])] == [b"abc"] and list(warc.parsed(b"")) == [] == list(warc.parsed(b"\x1f\x8bno"))
    long = two.replace(b"Length: 3", b"Length: 300000").replace(b"abc", random.Random(1).randbytes(300_000))
    assert [len(b) for _, b in warc.parsed(gzip.compress(one + long))] == [3, 300_000] and [b for _, b in warc.parsed(gzip.compress(one + long)[:-2000])] == [b"abc"]


def test_chunked_framing():
    for data in (b"", b"a", b"\r\n0\r\n\r\n" * 50):
        assert warc.unchunked(warc.chunked(data, 7)) == data
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: z\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc", b"zz\r\nabc\r\n0\r\n\r\n", b"3\r\nabcX\r\n0\r\n\r\n", b"-1\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)


def test_an_empty_table_of_pages(spark, tmp_path):
    out = archived(spark, tmp_path, [])
    assert warc.archived_pages(warc.read_warc(spark, out)).count() == 0


# As-of join

TOLERANCE = 1000


def matched(clicks, orders, tolerance=TOLERANCE):
    out = []
    for i, client, t in clicks:
        fit = [o for o in orders if client is not None and t is not None and o[0] == client and o[1] is not None and t - tolerance <= o[1] <= t]
        at = max((o[1] for o in fit), default=None)
        tied = sorted((o for o in fit if o[1] == at), key=lambda o: (o[2] is not None, o[2] or 0, o[3] is not None, o[3] or 0))
        best = tied[-1] if tied else None
        out.append((i, client, t, *((best[3], t - at, best[2], len(tied)) if best else (None, None, None, 0))))
    return sorted(out, key=repr)


def got_matches(spark, clicks, orders, rows=None):
    c = spark.createDataFrame(clicks, "click_id long, client_id long, ts_us long").withColumn("order_us", F.lit("x")).withColumn("start", F.lit(1)).repartition(3)
    o = spark.createDataFrame(orders, "client_id long, order_us long, total_cents long, sale_id long").withColumn("shard", F.lit(2)).repartition(3)
    return sorted(map(tuple, asof.asof_join(c, o, TOLERANCE, rows).collect()), key=repr)


@pytest.mark.parametrize("rows", [None, 5])
def test_matches_are_those_of_brute_force(spark, rows):
    """Most rows are one client's, in bursts, so that chunks are cut more than once; gaps and edges at the tolerance."""
    r = random.Random(4)

    def client():
        return 1 if r.random() < 0.5 else r.choice([None, *range(2, 30)])

    def time():
        return r.choice([None, -5000, 0, r.randrange(-9000, 9000), r.randrange(100, 130), r.randrange(100, 130) + TOLERANCE])

    clicks = [(i, client(), time()) for i in range(1200)]
    orders = [(client(), time(), r.choice([None, 5, 7, r.randrange(99)]), r.choice([None, *range(400)])) for _ in range(700)]
    assert got_matches(spark, clicks, orders, rows) == matched(clicks, orders)


def test_matches_without_rows(spark):
    some = [(1, 1, 5), (2, None, 5), (3, 1, None), (3, 1, None)]
    assert got_matches(spark, some, []) == matched(some, []) and got_matches(spark, [], [(1, 1, 1, 1)]) == [] == got_matches(spark, [], [])


def test_orders_and_clicks_of_a_shop(spark):
    sales = spark.sql("""SELECT * FROM VALUES (10, 1, 0.285D, timestamp_ntz'2024-01-02 07:00:00.000001', 4, 'a'), (11, 1, cast('NaN' AS double), timestamp_ntz'2024-01-02 07:00:00', null, 'b'),
      (null, 1, 1D, timestamp_ntz'2024-01-02 07:00:00', 1, 'c'), (12, null, null, null, 1, 'd') AS t(sale_id, client_id, total, sold_at, priority, h)""")
    got = {(r.sale_id, r.priority): (r.order_us, r.total_cents) for r in asof.orders_of_sales(sales).collect()}
    at = 1704178800_000000
    expected = {}
    for i, us, cents, priority in ((10, at + 1, 28, 4), (11, at, None, None), (12, None, None, 1)):
        h = zlib.crc32(str(i).encode())
        us = us if us is None or h % 2 == 0 else us // (6 * asof.HOUR) * (6 * asof.HOUR)
        expected[i, priority] = us, cents
        if h % 3:
            expected[-1 - i, None if priority is None else 6 - priority] = us, cents
    assert got == expected | {(None, 1): (at, 100)}
    clicks = spark.sql("SELECT * FROM VALUES (1, 5, timestamp_ntz'2024-01-02 07:00:00'), (1, 5, timestamp_ntz'2024-01-02 07:00:00'), (1, null, null), (null, 5, timestamp_ntz'2024-01-02 07:00:00'), (2, null, null) AS t(click_id, client_id, ts)")
    h = zlib.crc32(b"1")
    us = at if h % 2 == 0 else at // (6 * asof.HOUR) * (6 * asof.HOUR)
    assert sorted(map(tuple, asof.clicks_to_match(clicks).collect())) == [(1, 5, us), (2, None, None)]
