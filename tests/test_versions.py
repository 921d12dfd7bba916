"""The store: commits that append, versions of all tables at once, removal, compaction, writers that meet or die."""

import json
import os

import pytest

from lectern.sources.versions import DEAD, Store, StoreConflict


def rows(spark, ids, tag, copies=1):
    return spark.createDataFrame([(i, k, f"{tag}{i}") for i in ids for k in range(copies)], "document_id long, k int, text string")


def ids(spark, some):
    return spark.createDataFrame([(i,) for i in some], "document_id long")


def put(spark, store, some, tag, copies=1):
    return store.commit({"a": rows(spark, some, tag, copies), "b": rows(spark, some, tag).select("document_id", "text")}, ids(spark, some))


def texts(df):
    return sorted(r.text for r in df.select("text").collect())


def test_documents_stored_again_removed_and_merged(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), order={"a": "text"})
    assert store.manifest()["version"] == 0 and store.remove(ids(spark, [1])) == 0
    assert put(spark, store, range(6), "x", 2) == 1
    assert put(spark, store, [1, 2, 9], "y") == 2
    # A document that has no row any more loses the old ones all the same.
    assert store.commit({"a": rows(spark, [], "z")}, ids(spark, [3])) == 3
    assert store.remove(ids(spark, [4, 77])) == 4
    assert put(spark, store, [4], "again") == 5
    expected_a, expected_b = sorted(["x0", "x0", "x5", "x5", "y1", "y2", "y9", "again4"]), sorted(["x0", "x5", "y1", "y2", "y9", "again4"])
    assert texts(store.read("a")) == expected_a and texts(store.read("b")) == expected_b
    assert texts(store.read("b", 1)) == [f"x{i}" for i in range(6)] and texts(store.read("b", 4)) == ["x0", "x5", "y1", "y2", "y9"]
    assert store.compact(fan=9) is None
    assert store.compact(fan=2) == 6
    assert texts(store.read("a")) == expected_a and texts(store.read("b")) == expected_b
    assert len(store.manifest()["segments"]) == 1 and all(DEAD not in s["tables"] for s in store.manifest()["segments"])
    put(spark, store, [0, 9], "new")
    assert texts(store.read("b")) == sorted(["new0", "x5", "y1", "y2", "new9", "again4"])
    assert store.vacuum(keep=1) > 0 and texts(store.read("b")) == sorted(["new0", "x5", "y1", "y2", "new9", "again4"]) and store.versions() == [7]
    with pytest.raises(KeyError):
        store.read("c")


def test_merging_some_keeps_what_voids_the_rest(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    put(spark, store, range(200), "x", 50)  # a large segment, which isn't merged with the small ones
    for k in range(3):
        put(spark, store, [k, 100 + k], f"y{k}-")
    store.remove(ids(spark, [5]))
    before = texts(store.read("b"))
    small = max(sum(s["tables"].values()) for s in store.manifest()["segments"][1:]) + 1
    assert store.compact(fan=3, least=small) is not None
    assert texts(store.read("b")) == before and "x5" not in before and "y0-0" in before and "x0" not in before


def test_a_commit_costs_what_it_brings(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))

    def size():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path) for f in fs)

    put(spark, store, range(20_000), "some text that takes room ", 4)
    first = size()
    put(spark, store, range(20), "some text that takes room ", 4)
    assert size() - first < first / 4
    assert store.read("a").count() == 80_000


def test_a_writer_that_dies_or_is_late_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    put(spark, store, [1, 2], "x")
    real = Store._size

    def dying(self, name):
        if "/b/" in name:
            raise OSError("lost")
        return real(self, name)

    monkeypatch.setattr(Store, "_size", dying)
    with pytest.raises(OSError):
        put(spark, store, [1, 3], "y")
    monkeypatch.undo()
    assert store.versions() == [1] and texts(store.read("a")) == ["x1", "x2"] == texts(store.read("b"))
    slow = Store(spark, store.path)
    old = slow.manifest()
    put(spark, store, [2], "z")
    monkeypatch.setattr(slow, "manifest", lambda version=None: old)
    with pytest.raises(StoreConflict):
        put(spark, slow, [1], "late")
    assert texts(store.read("a")) == ["x1", "z2"]
    assert [n for n in os.listdir(tmp_path / "s" / "manifests") if n.endswith(".json")] and json.loads((tmp_path / "s" / "manifests" / "000000000002.json").read_text())["version"] == 2
