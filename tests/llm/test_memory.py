"""How much of whole texts the corpus operators have in memory at once."""

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from lectern.llm import near_copies, packing
from lectern.llm.secrets import redact_secrets

KEYS = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]


def test_texts_reach_python_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some word "), F.when(F.col("id") < 2000, 1).otherwise(1000)).alias("text"))
    before = [spark.conf.get(k) for k in KEYS]
    try:
        redact_secrets(docs)
        got = docs.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in got) == 3000 and max(r.n for r in got) == 1000 and max(r.size for r in got) < 5 << 20
        spark.conf.set(KEYS[0], "7")
        spark.conf.set(KEYS[1], "64k")
        redact_secrets(docs)
        assert [spark.conf.get(k) for k in KEYS] == ["7", "64k"]
    finally:
        for k, x in zip(KEYS, before, strict=True):
            spark.conf.set(k, x)


def test_packing_makes_tokens_of_few_texts_at_once(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    lengths = [40, 700_000, 300, 300_000, 2_500_000, 0, 900_000, 12]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(["some words, " * (n // 12) for n in lengths])], names=["doc_id", "text"])
    made, all_of = [], packing.WordTokens.all
    monkeypatch.setattr(packing.WordTokens, "all", lambda self, some: made.append([*map(len, some)]) or all_of(self, some))
    got = pa.Table.from_batches(packing._packed(path, packing.TIERS)(iter([batch])))
    assert all(len(x) == 1 or sum(x) <= 1 << 20 for x in made)
    monkeypatch.setattr(packing, "AT_ONCE", 1 << 30, raising=False)
    assert got == pa.Table.from_batches(packing._packed(path, packing.TIERS)(iter([batch])))  # the same pieces


def test_sets_to_verify_are_kept_from_batch_to_batch(monkeypatch):
    made, shingle_set = [], near_copies.shingle_set
    monkeypatch.setattr(near_copies, "shingle_set", lambda text, *a: made.append(text) or shingle_set(text, *a))
    one, other = "a b c d e f g h", "i j k l m n o p"
    pairs = pa.RecordBatch.from_arrays([pa.array([1, 1]), pa.array([2, 3]), pa.array([one, one]), pa.array([one.upper(), other])], names=["u", "v", "a", "b"])
    got = pa.Table.from_batches(near_copies._near(iter([pairs, pairs])))
    assert got.to_pydict() == {"u": [1, 1], "v": [2, 2]} and len(made) == 3
