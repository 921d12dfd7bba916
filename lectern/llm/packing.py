"""Hierarchical multi-length packing of tokenised documents."""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, lean, slices, small_batches, stored, texts

END, WINDOW = 2, 4096
TIERS = (512, 1024, 2048, 4096)
#: Tokens in a step group, and the smallest sequence that the tail of a task is cut to.
STEP_TOKENS, LEAST = 1 << 18, 64
#: Bytes of text whose tokens are made at a time: what stands between text and ids takes some twenty times as much.
AT_ONCE = 1 << 20
#: The upper bits of a sequence's number are its task's, the lower ones count the task's sequences.
OWN_BITS = 40

_LETTERS, _MARKS = "a-zß-öø-ÿ", "!-&(-/:-@\\[-`{-~"
_SIMPLE = re.compile(f"[{_LETTERS}{_MARKS} \n]*")
_PARTS = re.compile(f"[{_LETTERS}]+|[{_MARKS}]+")


class WordTokens:
    """Ids of whole texts by a word-end BPE file of the tokenizers library, as little-endian unsigned 32-bit bytes.

    Texts of plain letters and marks alone are runs of the one or the other; each run is merged by rank, which is what
    the library's merges come to (the tests compare the two), and kept in a bounded memo. In other texts a space or a
    newline is still a boundary that no token crosses: stretches between them that aren't plain go to the library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path) as f:
            vocab = json.load(f)["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
        # \xff never occurs in UTF-8, and stands for the end of a word.
        ranks = {bytes(byte[c] for c in t.removesuffix("</w>")) + b"\xff" * t.endswith("</w>"): i for t, i in vocab.items() if t[:2] != "<|"}
        ranks[b"\xff"] = len(ranks) + 2
        self.merge = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.runs, self.plain, self.stretches = Memo(self._run), Memo(self._plain), Memo(self._stretch)

    def _run(self, run: str) -> bytes:
        return array("I", self.merge(run.encode() + b"\xff")).tobytes()

    def _plain(self, low: str) -> bytes:
        if low.isalpha():
            return self.runs[low]
        if low[:-1].isalpha():
            return self.runs[low[:-1]] + self.runs[low[-1]]
        return b"".join([self.runs[x] for x in _PARTS.findall(low)])

    def _stretch(self, stretch: str) -> bytes:
        low = stretch.lower()
        if _SIMPLE.fullmatch(low) and "<|" not in low:
            return self._plain(low)
        return array("I", self.library.encode(stretch, add_special_tokens=False).ids).tobytes()

    def all(self, some: list[str]) -> list[bytes]:
        """The ids of each text. Stretches are first made unique together, so that each is looked up once."""
        lows = [x.lower() for x in some]
        plain = [_SIMPLE.fullmatch(low) is not None and "<|" not in low for low in lows]
        out: list[bytes] = [b""] * len(some)
        for memo, own, kind in ((self.plain, lows, True), (self.stretches, some, False)):
            at = [i for i, p in enumerate(plain) if p is kind]
            if not at:
                continue
            split = pc.split_pattern(pa.array([own[i].replace("\n", " ") for i in at], pa.string()), " ")
            coded = split.flatten().dictionary_encode()
            ids = list(map(memo.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
            flat = np.frombuffer(b"".join(ids), np.uint32)
            sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
            use = coded.indices.to_numpy()
            n = sizes[use]
            ends = np.cumsum(n, dtype=np.int32)
            # Position k of the text is position k - (where its stretch begins here) of that stretch's ids.
            where = np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes)[use] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
            joined = flat[where]
            last = np.concatenate([[0], ends])[split.offsets.to_numpy()]
            for i, a, b in zip(at, last[:-1].tolist(), last[1:].tolist(), strict=True):
                out[i] = joined[a:b].tobytes()
        return out


class Packer:
    """Packs documents as they come; holds those of one batch, and fewer pieces than fill a window of each tier."""

    def __init__(self, tiers=TIERS):
        self.tiers, self.window = tuple(tiers), tiers[-1]
        self.held = {t: [] for t in self.tiers}  # of each tier: (length, number, document, start) by length
        self.sequences, self.number, self.made = 0, 0, Counter()
        self.out = []

    def add(self, doc_id, ids: bytes) -> None:
        doc, n = (doc_id, ids, len(ids) // 4), len(ids) // 4
        full = n - n % self.window
        for start in range(0, full, self.window):
            self._emit([(doc, start, self.window)])
        if full < n:
            self._hold(doc, full, n - full)

    def _tier(self, n: int) -> int:
        return next(t for t in self.tiers if n <= t)

    def _hold(self, doc, start: int, n: int) -> None:
        self.number += 1
        bisect.insort(self.held[self._tier(n)], (n, self.number, doc, start))

    def _emit(self, parts) -> None:
        total, at = sum(n for _, _, n in parts), 0
        # A tail's sequence is of a tier of its own length: a power of two, to which the very last one is padded.
        tier = total if total in self.tiers else max(LEAST, 1 << (total - 1).bit_length())
        for doc, start, n in parts:
            crc = zlib.crc32(memoryview(doc[1])[4 * start : 4 * (start + n)])
            self.out.append((doc[0], start, n, crc, doc[2], self.sequences, at, tier, self.made[tier]))
            at += n
        self.made[tier] += 1
        self.sequences += 1

    def _fitting(self, tier: int, gap: int):
        """The longest held piece of this tier or a shorter one that fits, taken out."""
        for t in reversed(self.tiers[: self.tiers.index(tier) + 1]):
            if i := bisect.bisect_right(self.held[t], (gap, float("inf"))):
                return self.held[t].pop(i - 1)
        return None

    def _any(self, tier: int):
        """The shortest held piece of this tier or a shorter one, taken out, to be cut."""
        for t in self.tiers[: self.tiers.index(tier) + 1]:
            if self.held[t]:
                return self.held[t].pop(0)
        return None

    def _fill(self, size: int, tier: int):
        """One sequence of `size` from pieces up to `tier`: the longest first, gaps from shorter tiers, the last cut."""
        parts, gap = [], size
        while gap:
            piece = self._fitting(tier, gap)
            if piece is None:
                if (piece := self._any(tier)) is None:
                    break
                n, _, doc, start = piece
                parts.append((doc, start, gap))
                self._hold(doc, start + gap, n - gap)
                break
            n, _, doc, start = piece
            parts.append((doc, start, n))
            gap -= n
        self._emit(parts)

    def pack(self) -> list:
        """Fill whole windows of every tier, longest first, while that tier and the shorter ones can; the finished pieces."""
        for k in reversed(range(len(self.tiers))):
            t = self.tiers[k]
            while self.held[t]:
                stock = 0
                for x in self.tiers[: k + 1]:
                    stock += sum(p[0] for p in self.held[x])
                    if stock >= t:
                        break
                if stock < t:
                    break
                self._fill(t, t)
        out, self.out = self.out, []
        return out

    def finish(self) -> list:
        """What is left, in windows of falling powers of two; only the last sequence, below LEAST, needs padding."""
        size = self.window
        while stock := sum(p[0] for t in self.tiers for p in self.held[t]):
            while size > stock and size > LEAST:
                size //= 2
            self._fill(min(size, stock), self.window)
        out, self.out = self.out, []
        return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, nth long"


def _packed(path: str, tiers):
    def rows(batches):
        encode, packer = WordTokens(path), Packer(tiers)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        end = END.to_bytes(4, "little")
        kinds = [pa.int64()] * 9
        names = [x.split()[0] for x in PIECES.split(", ")]

        def table(found):
            cols = [list(c) for c in zip(*found, strict=True)] if found else [[] for _ in kinds]
            cols[5] = [(part << OWN_BITS) + s for s in cols[5]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        for b in slices(batches, 1):
            for few in slices([b], 1, size=AT_ONCE):
                for doc_id, ids in zip(few.column(0).to_pylist(), encode.all(list(texts(few.column(1)))), strict=True):
                    packer.add(doc_id, ids + end)
            yield table(packer.pack())
        yield table(packer.finish())

    return lean(rows)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tiers=TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Every token of every document in exactly one piece of a sequence: one row per piece.

    Columns: doc_id, start, length, ids_crc32 (of the piece's ids as little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, tier, step_group. A document is its ids and the end id 2.

    Documents are routed by length to tiers of 512, 1024, 2048 and 4096 tokens; whole windows come off longer ones
    first. Windows of each tier, the longest first, take the longest pieces that fit, fill gaps from shorter tiers, and
    cut one piece to end exactly full. What a task has left makes sequences of falling powers of two, each of a tier of
    that length; only a task's last one, of under LEAST tokens, needs padding.

    Step groups: the sequences of each tier, of all tasks, are counted and dealt in turn to as many groups as their
    tokens fill, so that the totals of a tier's groups differ by one sequence at most. A group's number is its own:
    16 times its place in the tier, plus the binary logarithm of the tier's length.

    Each task packs the rows it reads, so no token is shuffled and a lost task is repeated with the same result; it
    holds the documents of some 1,000 rows at a time. Pieces, without their ids, are stored once for the dealing, which
    moves counts of tasks. Null text counts as empty: such a document is the end id alone. Very long texts are cut into
    windows. Repeated rows are documents each. Empty tables give empty tables; other columns are ignored, whatever their
    names.
    """
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = stored(small_batches(two).mapInArrow(_packed(tokenizer, tiers), PIECES), "pieces").withColumn("task", F.shiftright("sequence_id", OWN_BITS))
    made = pieces.groupBy("tier", "task").agg((F.max("nth") + 1).alias("n"))
    tasks, tier = Window.partitionBy("tier").orderBy("task"), Window.partitionBy("tier")
    made = made.select("tier", "task", (F.sum("n").over(tasks) - F.col("n")).alias("before"), F.sum("n").over(tier).alias("all"))
    groups = F.greatest(F.lit(1), F.round(F.col("all") * F.col("tier") / F.lit(step_tokens)).cast("long"))
    group = (F.col("before") + F.col("nth")) % groups * 16 + F.round(F.log2("tier")).cast("long")
    return pieces.join(made, ["tier", "task"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", group.alias("step_group"))
