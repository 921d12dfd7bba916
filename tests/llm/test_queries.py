"""Registered corpus queries: over whole tables, equal to their SQL where there is some, and the pipeline."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "clicks", "sales"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    made = con.execute(ORACLE_SQL[name])
    at = [[c[0] for c in made.description].index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in made.fetchall())


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def test_op1_is_that_of_brute_force(spark, texts):
    prints = {}
    for i, t in texts.items():
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(ws[k : k + 3]).encode(), 42) for k in range(max(1, len(ws) - 2))] if ws else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    label = dict.fromkeys(texts)
    for i in sorted(texts):
        if label[i] is None:
            reach = [i]
            while reach:
                x = reach.pop()
                label[x] = i
                reach += [y for y in texts if label[y] is None and (prints[x] ^ prints[y]).bit_count() <= 2]
    got = QUERIES["op1_simhash_near_dedup"](spark, SF).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{prints[i]:016x}", label[i]) for i in texts)


def test_op2_is_that_of_brute_force(spark, texts):
    patterns = {"assign": r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    got = {r.doc_id: r for r in QUERIES["op2_secret_scans"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        found = {k: [m for m in re.finditer(p, t or "", re.ASCII)] for k, p in patterns.items()}
        found["assign"] = [m for m in found["assign"] if len(m[2]) >= 12]
        found["access"] = [m for m in found["access"] if len(m[0]) >= 18]
        found["hex"] = [m for m in found["hex"] if len(m[0]) >= 16]
        order = list(patterns)
        base = sorted(((m.start(), order.index(k), m.end()) for k, ms in found.items() for m in ms))
        listed = [f"{order[k]}:{a}:{b}" for a, k, b in base]
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(len(found[k]) for k in order) and r.base_sha256 == sha(",".join(listed))
        assert set(listed) <= set(r.spans.split(",")) | {""}


def test_op5_has_the_ids_of_the_library(spark, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op5_packing"](spark, SF).collect():
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        covered[r.doc_id].append((r.start, r.length, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(covered) == set(texts)
    for pieces in covered.values():
        at = 0
        for start, length, total in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert at == total
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_op6_keeps_its_law(spark, texts):
    got = QUERIES["op6_sharding"](spark, SF).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts.items())
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1 and {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())


def test_op8_has_the_ids_and_texts_of_the_library(spark, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for i, t in texts.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    got = QUERIES["op8_bpe_round_trip"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


@pytest.mark.parametrize(("name", "label", "threshold"), [("op4_toxicity", "toxic", 0.3), ("op9_quality_classifier", "quality", 0.7)])
def test_classifiers_on_rows_that_they_have_not_seen(spark, name, label, threshold):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES[name](spark, folder).collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= threshold) and 0 <= r.score <= 1 for i, r in got.items())
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.doc_id in got and got[r.doc_id].held_out}
    ones, zeros = ([got[i].score for i, y in truth.items() if y == k] for k in (1, 0))
    above = [a > b for a in ones for b in zeros]
    assert sum(above) >= 0.85 * len(above) > 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, SF)
        assert left.schema.names == docs.schema.names and 0 < left.count() <= docs.count()
        docs = left
    assert {r[0] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_stages_on_awkward_rows(spark):
    ws = " ".join(f"w{k}" for k in range(300))
    rows = [(1, None, "a", 1), (2, "", "b", 2), (None, "x y z", "c", None), (None, None, "d", 4), (5, "A b C", "e", 5), (6, "a B c", "f", 5), (6, "a B c", "f", 5), (7, ws, "g", 7), (8, ws + " more", "h", 8), (9, "token=abcdefghijklmnopq " * 40_000, "i", 9), (9, "another text of the same id", "j", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, n_chars long").repartition(3)
    nothing = docs.where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nothing, SF).count() == 0 and stage(spark, nothing, SF).schema.names == docs.schema.names
    assert corpus_pipeline.packing(spark, nothing, SF).count() == 0

    def after(name):
        return sorted(map(tuple, dict(corpus_pipeline.STAGES)[name](spark, docs, SF).collect()), key=repr)

    assert after("toxicity") == sorted(rows, key=repr)
    exact = after("exact_dedup")  # the largest id of each text, and one row of it
    assert exact == sorted([(2, "", "b", 2), (None, "x y z", "c", None), (6, "a B c", "f", 5), *rows[7:]], key=repr)
    near = after("near_dedup")  # the smallest id of each component; rows without an id stay
    assert near == sorted([rows[0], rows[2], rows[3], rows[4], rows[7], *rows[9:]], key=repr)
    clean = after("secret_scans")
    assert sorted(r[0] is not None and r[0] for r in clean) == sorted(r[0] is not None and r[0] for r in rows) and [r for r in clean if r[0] != 9 or r[2] == "j"] == sorted([r for r in rows if r[0] != 9 or r[2] == "j"], key=repr)
    assert [r[1:] for r in clean if r[2] == "i"] == [("[SECRET] " * 40_000, "i", 9 * 40_000)]
    packed = corpus_pipeline.packing(spark, docs, SF).groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).collect()
    assert all(r[2] % r[1] == 0 for r in packed) and {r.doc_id for r in packed} == {r[0] for r in rows}


def test_near_dedup_stage_drops_copies_of_five_word_similarity(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base), " ".join(base[:50] + ["x"] + base[51:150] + ["y"] + base[151:]), " ".join(f"u{i}" for i in range(200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [0, 2]
