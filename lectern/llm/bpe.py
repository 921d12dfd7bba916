"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import functools
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, lean, slices, texts

# White space as the pattern means it: the Unicode property.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pattern of byte-level vocabularies, which no token crosses.
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Where a text can't simply be cut before each space.
_UNEVEN = regex.compile(r"^\s|\s$|\s |\s(?<! )\s| \s")


#: Pairs of tokens whose test is kept.
MOST_PAIRS = 1 << 19


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(rest)) for b in range(256)}


def _check(file: dict) -> None:
    """That a file asks for nothing beyond what is done here: byte-level BPE with the usual pattern, and special tokens
    that are taken wherever their text stands."""
    split, model = file.get("pre_tokenizer") or {}, file["model"]
    usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and file.get("normalizer") is None
    usual &= model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not usual or any(t.get(k) for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("the vocabulary file asks for a way of encoding that isn't implemented")


class PrefixEncoder:
    """Exact BPE ids of a text, from a vocabulary file of the tokenizers library.

    The text's prefixes are taken by rising length. The encoding of a prefix ends with one token only: of the tokens
    that are suffixes of the prefix (an automaton over the vocabulary gives them), it is the one that BPE would leave
    standing next to the last token of the prefix before it. So one token is stored for each prefix, and the encoding
    is read off backwards.
    """

    def __init__(self, path: str):
        with open(path) as f:
            file = json.load(f)
        _check(file)
        vocab = file["model"]["vocab"]
        letters = byte_letters()
        back = {c: bytes([b]) for b, c in letters.items()}
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes = {i: t.encode() if t in special else b"".join(back[c] for c in t) for t, i in [*vocab.items(), *special.items()]}
        self.special = special
        self.apart = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.pairs, self.halves = {}, {}
        for rank, merge in enumerate(file["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.pairs[left, right] = rank
            self.halves.setdefault(whole, (rank, left, right))
        # Tokens as letters of one byte each.
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if t not in special:
                self.automaton.add_word(self.bytes[i].decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.known: dict[int, bool] = {}  # pairs that have been tested, of MOST_PAIRS at most
        self.tokens = Memo(self.piece)

    def _beside(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' text leaves just these two.

        Their merges are undone from the last on. Whenever the tokens that face each other at the seam could have
        merged before the merge that was undone last, BPE would have joined them instead.
        """
        none, limit = (-1, 0, 0), 1 << 62
        while True:
            if self.pairs.get((a, b), limit) < limit:
                return False
            left, right = self.halves.get(a, none), self.halves.get(b, none)
            if left[0] > right[0]:
                limit, a = left[0], left[2]
            elif right[0] >= 0:
                # Of equal merges the left one comes first, so one across the seam beats its like on the right.
                limit, b = right[0] + 1, right[1]
            else:
                return True

    def piece(self, piece: str) -> array:
        """Ids of one piece of text that the pattern gives."""
        return next(self.pieces([piece]))

    def pieces(self, pieces: Iterable[str]) -> Iterator[array]:
        """Ids of pieces of text that the pattern gives. A prefix's last token depends on that prefix alone, so what a piece
        shares with the one before it is not worked out again: pieces had best come in order."""
        known, found, before = self.known, self.automaton.iter, ""
        last: list[int] = []
        sizes: list[int] = []
        for piece in pieces:
            word = piece.encode("utf-8", "surrogatepass").decode("latin-1")
            same = 0
            for x, y in zip(word, before):  # noqa: B905  as far as both go
                if x != y:
                    break
                same += 1
            before, more = word, len(word) - same
            last[same:], sizes[same:] = [-1] * more, [0] * more
            for end, (size, token) in found(word):
                if end < same or sizes[end]:
                    continue
                if size <= end:
                    left = last[end - size]
                    if left < 0:
                        continue
                    pair = left << 32 | token
                    fits = known.get(pair)
                    if fits is None:
                        if len(known) >= MOST_PAIRS:
                            known.clear()
                        fits = known[pair] = self._beside(left, token)
                    if not fits:
                        continue
                last[end], sizes[end] = token, size
            out, at = array("I"), len(word) - 1
            while at >= 0:
                out.append(last[at])
                at -= sizes[at]
            out.reverse()
            yield out

    def plain(self, text: str) -> list[int]:
        return [i for piece in PATTERN.findall(text) for i in self.tokens[piece]]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; its special tokens' strings have their own ids."""
        if self.apart is None:
            return self.plain(text)
        return [i for part in self.apart.split(text) if part for i in ([self.special[part]] if part in self.special else self.plain(part))]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _places(starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its size; ends: the sizes' running sum, below 2^31."""
    out = np.repeat((starts - (ends - sizes)).astype(np.int32), sizes)
    out += np.arange(len(out), dtype=np.int32)
    return out


class Strings:
    """A byte string for each id, and what those of many ids are one after another."""

    def __init__(self, strings: dict[int, bytes]):
        ordered = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.sizes = np.fromiter(map(len, ordered), np.int64, len(ordered))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(ordered), np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, and where those of each id end."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.data[_places(self.starts[ids], sizes, ends)], ends


class RoundTrips:
    """For whole texts: the number of ids, digests of the ids and of the text they decode to, and whether that is the same.

    Many texts, or parts of a long one, go together: their words are made unique, each is encoded once, and the ids of
    all are strung together as arrays."""

    #: Characters that go together, and words that are kept for the next texts.
    TOGETHER, WORDS = 1 << 21, 1 << 18

    def __init__(self, path: str):
        self.encoder = PrefixEncoder(path)
        self.words = Memo(self._word, self.WORDS)
        self.decimals = Strings({i: b",%d" % i for i in self.encoder.bytes})
        self.decoded = Strings(self.encoder.bytes)

    def _word(self, word: str) -> bytes:
        return array("I", self.encoder.plain(word)).tobytes()

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of words with a space before them. Of those that aren't known yet, all pieces are encoded once each and in
        order, so that they share their prefixes."""
        words = [" " + x for x in words]
        known = list(map(self.words.get, words))
        new = [(k, w) for k, (w, ids) in enumerate(zip(words, known, strict=True)) if ids is None]
        # Letters alone, with a space before them, are one piece of the pattern.
        split = [(w,) if w[1:].isalpha() else PATTERN.findall(w) for _, w in new]
        ordered = sorted({x for own in split for x in own})
        ids = dict(zip(ordered, map(array.tobytes, self.encoder.pieces(ordered)), strict=True))
        for (k, word), own in zip(new, split, strict=True):
            known[k] = self.words.put(word, ids[own[0]] if len(own) == 1 else b"".join([ids[x] for x in own]))
        return known

    def _parts(self, text: str):
        """The text in parts of bounded size that can be encoded each for itself, and whether their words can."""
        if any(t in text for t in self.encoder.special) or _UNEVEN.search(text):
            yield text, False
            return
        at = 0
        while len(text) - at > self.TOGETHER:
            # A space between two other characters always begins a piece, so the text can be cut before it.
            cut = text.rfind(" ", at + 1, at + self.TOGETHER)
            if cut < 0:
                cut = text.find(" ", at + self.TOGETHER)
            if cut < 0:
                break
            yield text[at:cut], True
            at = cut
        yield text[at:], True

    def _ids(self, parts: list[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, and where those of each end."""
        even = [p for p, words in parts if words]
        found = [np.zeros(0, np.uint32)] * len(parts)
        if even:
            split = pc.split_pattern(pa.array(even, pa.string()), " ")
            coded = split.flatten().dictionary_encode()
            known = self._known(coded.dictionary.to_pylist())
            # The first word of a part has no space before it.
            first, code = split.offsets.to_numpy()[:-1], coded.indices.to_numpy().astype(np.int64)
            for k, x in zip(first.tolist(), pc.list_element(split, 0).to_pylist(), strict=True):
                code[k] = len(known)
                known.append(self.words[x])
            flat = np.frombuffer(b"".join(known), np.uint32)
            sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
            n = sizes[code]
            ends = np.cumsum(n)
            ids = flat[_places((np.cumsum(sizes) - sizes)[code], n, ends)]
            cuts = np.concatenate([[0], ends])[split.offsets.to_numpy()]
            each = iter(np.split(ids, cuts[1:-1]))
            found = [next(each) if words else x for x, (_, words) in zip(found, parts, strict=True)]
        found = [x if words else np.array(self.encoder.encode(p), np.uint32) for x, (p, words) in zip(found, parts, strict=True)]
        return np.concatenate(found), np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))

    def __call__(self, some) -> list[tuple[int, str, str, bool]]:
        found, waiting, size = [], [], 0
        for k, text in enumerate(some):
            found.append([0, hashlib.sha256(), hashlib.sha256(), True])
            for part, words in self._parts(text):
                waiting.append((k, part, words))
                size += len(part)
                if size >= self.TOGETHER:
                    self._add(found, waiting)
                    waiting, size = [], 0
        self._add(found, waiting)
        return [(n, ids.hexdigest(), text.hexdigest(), same) for n, ids, text, same in found]

    def _add(self, found: list[list], waiting: list[tuple[int, str, bool]]) -> None:
        """Take the waiting parts (number of the text, part, whether its words can be encoded alone) into what is found."""
        if not waiting:
            return
        ids, ends = self._ids([(part, words) for _, part, words in waiting])
        (digits, digit_ends), (data, data_ends) = self.decimals(ids), self.decoded(ids)
        cuts = np.concatenate([[0], ends])
        digit_cuts, data_cuts = (np.concatenate([[0], e])[cuts].tolist() for e in (digit_ends, data_ends))
        digits, data, cuts = digits.tobytes(), data.tobytes(), cuts.tolist()
        for j, (k, part, _) in enumerate(waiting):
            own = found[k]
            # Each number has a comma before it; a text's first one goes.
            own[1].update(memoryview(digits)[digit_cuts[j] + (own[0] == 0 and cuts[j] < cuts[j + 1]) : digit_cuts[j + 1]])
            back = data[data_cuts[j] : data_cuts[j + 1]].decode("utf-8", "replace")
            own[2].update(back.encode())
            own[0] += cuts[j + 1] - cuts[j]
            own[3] &= back == part


@functools.lru_cache(maxsize=1)
def round_trip_coder(path: str) -> RoundTrips:
    """One for each worker, which its tasks share: the words that it keeps are as many as WORDS at most."""
    return RoundTrips(path)


def _round_trip(path: str):
    def rows(batches):
        code = round_trip_coder(path)
        for b in slices(batches, 1):
            cols = list(zip(*code(texts(b.column(1))), strict=True))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same"])

    return lean(rows)


def _encoded(path: str):
    def rows(batches):
        encoder = PrefixEncoder(path)
        for b in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encoder.encode(t) for t in texts(b.column(1))], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return rows


def _decoded(path: str):
    def rows(batches):
        encoder = PrefixEncoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encoder.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each whole text's BPE ids; null counts as empty and has none. Nothing is shuffled."""
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(_encoded(path), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids count as none. Bytes that aren't UTF-8 become the replacement sign."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(path), "doc_id long, text string")


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and whether the decoded text is the same.

    Null text counts as empty: no tokens. A very long text is encoded in parts, cut where no token crosses. Repeated rows
    give a row each; nothing is shuffled. Empty tables give empty tables; other columns are ignored, whatever their names.
    """
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(_round_trip(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")
