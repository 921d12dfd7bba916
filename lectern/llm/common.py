"""What the operators of this subpackage share: scratch tables, hashing of words, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discarded as discarded
from ..sources.scratch import let_go as let_go
from ..sources.scratch import scratch as scratch
from ..sources.scratch import stored as stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: One row in four is held out of every fit: crc32 of the id as text, modulo 4, is 2.
HELD_OUT_OF, HELD_OUT = 4, 2


#: Bits of a map of keys.
MAP_BITS = 1 << 24


def parted(rows: DataFrame, column, keys: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows whose column is none of the keys, for certain, and those where it can be one; the column and the key are of
    one type, and null is a key like any other. What can't match needn't move to a join. Keys are hashed into a map of
    MAP_BITS, which goes to all tasks as MAP_BITS / 64 longs at most; the more keys, the more other rows pass, too."""
    place, own = (F.pmod(F.xxhash64(c), F.lit(MAP_BITS)) for c in (column, F.col(key)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(own, F.lit(64)).cast("int"))
    words = keys.groupBy(F.shiftright(own, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    marked = rows.join(F.broadcast(words), F.shiftright(place, 6) == words["word"], "left")
    can = F.coalesce(F.getbit(words["bits"], F.pmod(place, F.lit(64)).cast("int")) == 1, F.lit(False))
    return marked.where(~can).select(rows["*"]), marked.where(can).select(rows["*"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column):
    """A-Z lower-cased and nothing else; null counts as empty."""
    return F.translate(F.coalesce(column, F.lit("")), UPPER, UPPER.lower())


def held_out(doc_id):
    """Whether a row stays out of every fit."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HELD_OUT_OF)) == HELD_OUT, F.lit(False))


def texts(column: pa.Array):
    """The strings of an Arrow column, null as empty, one at a time."""
    for x in column:
        yield x.as_py() or ""


def raw_texts(column: pa.Array):
    """The UTF-8 bytes of an Arrow column, null as empty, one at a time."""
    for x in column:
        b = x.as_buffer() if x.is_valid else None
        yield b.to_pybytes() if b is not None else b""


class Memo(dict):
    """make(key) for each key, kept for the next time. Keys of over LONGEST letters aren't kept, and `most` others at
    most, after which it starts anew: so its memory has a bound, whatever the texts."""

    LONGEST = 64

    def __init__(self, make, most: int = 1 << 16):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        return self.put(key, self.make(key))

    def put(self, key, value):
        if len(key) <= self.LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


#: Rows and bytes of text that an Arrow function turns into Python objects at a time.
ROWS, BYTES = 1000, 4 << 20


def small_batches(docs: DataFrame) -> DataFrame:
    """docs, after the session is set to give Arrow functions no more than ROWS rows and BYTES bytes at once. As Spark has it
    it's 10,000 rows and 64 MB, which each task holds in buffers that double, beside the heap, and once more in its worker.
    It stays set, since frames run later than they are made; a smaller setting of the session's own stays, too."""
    conf, size = docs.sparkSession.conf, docs.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("maxRecordsPerBatch", ROWS), ("maxBytesPerBatch", BYTES)):
        if not 0 < size(conf.get(f"spark.sql.execution.arrow.{key}")) <= most:
            conf.set(f"spark.sql.execution.arrow.{key}", most)
    return docs


def slices(batches, column: int, rows: int = ROWS, size: int = BYTES):
    """The batches in pieces, which share their memory, of at most so many rows and bytes of a text column; a row at least."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            n = min(rows, max(1, int(np.searchsorted(ends, before + size, "right")) - at))
            yield b.slice(at, n)
            at += n


def lean(rows):
    """An Arrow function after which the worker gives back what memory it has freed: it lives on, next to others."""

    def run(batches):
        yield from rows(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without malloc_trim
            ctypes.CDLL(None).malloc_trim(0)

    return run
