"""Uploads over several batches give what one ingest gives, restarts included; what isn't whole in time has failed."""

from pyspark.sql import functions as F

from lectern.plans.index import index_store, open_index
from lectern.plans.ingest import ingest, stored_passages
from lectern.streaming.uploads import LATE, UPLOADS, ingest_uploads, upload_states, upload_stream

TEXTS = ["Sonar Arrays\n\nThe sonar array listens at forty metres below the surface of the sea.", "Hull\n\nThe hull is pressed from recycled aluminium and carries lithium cells for a month.", "Timetable\n\nThe report is due on 3 March 2031, at the harbour office, before noon."]


def test_pages_over_batches_are_one_document(spark, tmp_path):
    rows = [(d, n, float(n), f"{TEXTS[(d + n) % 3]} Copy {d}.", 3) for d in (1, 2) for n in (1, 2, 3)] + [(3, 1, 1.0, "", 1), (4, 1, 1.0, TEXTS[0], 2), (None, 1, 1.0, "x", 1)]
    pages = spark.createDataFrame(rows, UPLOADS)

    def arrive(name, condition):
        pages.where(condition).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run(wait=3600):
        ingest_uploads(upload_stream(spark, f"{tmp_path}/in/*", 1), f"{tmp_path}/out", f"{tmp_path}/state", wait).awaitTermination(240)

    arrive("a", "ordinal = 1 or document_id is null")
    run()
    store = index_store(spark, f"{tmp_path}/out")
    documents = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "document_id long")
    assert {r.document_id: r.status for r in upload_states(spark, f"{tmp_path}/out", documents).collect()} == {1: "processing", 2: "processing", 3: "failed", 4: "processing"}
    # Document 1 is whole after the next batch, which brings a page again; 2 after the one that follows.
    arrive("b", "document_id = 1 or (document_id = 2 and ordinal = 2)")
    run()
    version = store.versions()[-1]
    assert {r.document_id for r in store.read("passages").collect()} == {1}
    arrive("c", "document_id = 2")
    run()
    run()
    assert store.versions()[-1] == version + 1
    got = stored_passages(spark, f"{tmp_path}/out")
    due = documents.where("document_id < 4").select("document_id", F.lit("ann").alias("user_id"), F.lit("a.pdf").alias("file_name"), F.lit("processing").alias("status"))
    after = ingest(pages.where("document_id < 4").select("document_id", "ordinal", "page_number", "text"), due, f"{tmp_path}/whole")
    expected = stored_passages(spark, f"{tmp_path}/whole")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect())) and got.count() == 6
    for name in ("terms", "sizes", "headings", "pages"):
        assert sorted(map(tuple, store.read(name).collect())) == sorted(map(tuple, index_store(spark, f"{tmp_path}/whole").read(name).collect()))
    assert open_index(spark, f"{tmp_path}/out").vectors.count() == 6
    assert {r.document_id: r.status for r in upload_states(spark, f"{tmp_path}/out", documents).where("document_id < 4").collect()} == {r.document_id: r.status for r in after.collect()}


def test_what_is_not_whole_in_time_has_failed(spark, tmp_path):
    import time

    pages = spark.createDataFrame([(1, 1, 1.0, TEXTS[0], 2), (2, 1, 1.0, TEXTS[1], 1)], UPLOADS)
    pages.where("document_id = 1").coalesce(1).write.parquet(f"{tmp_path}/in/a")

    def run():
        ingest_uploads(upload_stream(spark, f"{tmp_path}/in/*", 1), f"{tmp_path}/out", f"{tmp_path}/state", 1).awaitTermination(240)

    run()
    time.sleep(1.5)
    pages.where("document_id = 2").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    run()
    documents = pages.select("document_id")
    got = {r.document_id: (r.status, r.error) for r in upload_states(spark, f"{tmp_path}/out", documents).collect()}
    assert got == {1: ("failed", LATE), 2: ("ready", None)}
