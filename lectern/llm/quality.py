"""Quality scores from compression against dictionaries of good and bad text."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import SAMPLE_DOCS, Curve, labelled_sample
from .common import held_out, lean, raw_texts, slices

DICT_BYTES, LEVEL, THRESHOLD = 112 << 10, 3, 0.7
#: Bytes that are compressed at a time: few, so that what a text repeats of itself hides little of what a dictionary has.
PIECE = 256


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of sampled text; raw text where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class QualityModel:
    def __init__(self, sample: list[tuple[str, int, bool]], share: float | None = None, size: int = DICT_BYTES, level: int = LEVEL):
        self.level, self.size = level, size
        seen, labels = [], []
        for half in (False, True):  # the curve is fitted on figures from dictionaries that haven't seen the row
            self._train([x for x in sample if x[2] is half])
            measure, rows = self.measure(), [x for x in sample if x[2] is not half]
            seen += [[measure(text.encode())] for text, _, _ in rows]
            labels += [y for _, y, _ in rows]
        self.curve = Curve(seen or [[0.0]], labels or [0], share)
        self._train(sample)

    def _train(self, rows) -> None:
        self.dictionaries = [_dictionary([t.encode() for t, c, _ in rows if c == y], self.size) for y in (0, 1)]

    def measure(self):
        def compressor(d: bytes):
            if not d:
                return zstandard.ZstdCompressor(level=self.level, write_content_size=False).compress
            loaded = zstandard.ZstdCompressionDict(d)
            loaded.precompute_compress(level=self.level)
            return zstandard.ZstdCompressor(dict_data=loaded, write_content_size=False, write_checksum=False).compress

        bad, good = (compressor(d) for d in self.dictionaries)

        def difference(text: bytes) -> float:
            """Bytes that the whole text takes with the bad dictionary less those with the good one, over its own."""
            more = 0
            for at in range(0, len(text), PIECE):
                piece = text[at : at + PIECE]
                more += len(bad(piece)) - len(good(piece))
            return more / max(1, len(text))

        return difference


def _scored(model, threshold: float):
    def rows(batches):
        m = model.value
        measure = m.measure()
        for b in slices(batches, 1):
            scores = m.curve([[measure(t)] for t in raw_texts(b.column(1))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(scores >= threshold).cast(pa.int32())], names=["doc_id", "score", "predicted"])

    return lean(rows)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, most: int = SAMPLE_DOCS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 from `threshold` on).

    Two zstandard dictionaries are trained, on good and on bad labelled text. A document is compressed whole with each,
    a short piece at a time; the difference of the sizes, normalised by the text's, is its figure, and a logistic curve
    of that figure alone makes it a score. The curve is fitted on figures of rows by dictionaries that haven't seen them.

    Learns from a bounded sample of labelled documents (labelled_sample), none held out (crc32 of the id modulo 4 is 2);
    scores every row by its whole text, with no shuffle. Text alone decides: null and empty texts get the score of no
    difference, repeated rows equal scores. An id whose labels differ counts as good. Without labels of both classes,
    every score is the smoothed share of class 1 among them. Empty tables give empty tables; other columns are ignored,
    whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(QualityModel(*labelled_sample(docs, labels, "quality", id_col, text_col, most)))
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(_scored(model, threshold), "doc_id long, score double, predicted int").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
