"""Toxicity scores from class-conditional Kneser-Ney models."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import SAMPLE_DOCS, Curve, labelled_sample
from .common import held_out, lean, slices, small_batches, texts

ORDER, DISCOUNT, THRESHOLD = 5, 0.75, 0.3
#: Codes: 0 before a word, 1 after it, 2 for letters that no fitted word has, then one for each letter.
START, STOP, OTHER = 0, 1, 2
#: Characters that are scored at a time, of one text or of many.
CHARS_AT_ONCE = 1 << 18
_WORD = re.compile(r"[^\W\d_]+")
# A gram of codes is the number that they are the digits of, to an odd base modulo 2^64.
_BASE, _SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


@functools.cache
def _letters() -> np.ndarray:
    """Of each code point, whether it is a letter as _WORD means it; made once in a worker."""
    return np.fromiter((c.isalnum() and not c.isdecimal() for c in map(chr, range(0x110000))), bool, 0x110000)


class Lookup:
    """Values by 64-bit key, for whole arrays of keys. A key that finds its place taken goes to the next, smaller table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.tables = keys, values, []
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            bits = max(1, int(2 * len(left)).bit_length())
            at = self._places(keys[left], len(self.tables), bits)
            places = np.full(1 << bits, -1, np.int32)
            places[at] = left
            self.tables.append((bits, places))
            left = left[places[at] != left]

    @staticmethod
    def _places(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29 + level))) * _SPREAD >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is here, and its value or 0."""
        found, out, left, own = np.zeros(len(keys), bool), np.zeros(len(keys), np.float32), None, keys
        for level, (bits, places) in enumerate(self.tables):
            i = places[self._places(own, level, bits)]
            hit = (i >= 0) & (self.keys[i] == own)
            at = np.flatnonzero(hit) if left is None else left[hit]
            found[at], out[at] = True, self.values[i[hit]]
            rest = np.flatnonzero((i >= 0) & ~hit)  # where nothing is, nothing was in the way
            left = rest if left is None else left[rest]
            own = keys[left]
        return found, out


def _grams(words: Counter, codes: dict[str, int], order: int) -> Counter:
    """How often each code follows each order - 1 others, as tuples."""
    found: Counter = Counter()
    for word, n in words.items():
        digits = (START,) * (order - 1) + tuple(map(codes.__getitem__, word)) + (STOP,)
        for k in range(len(word) + 1):
            found[digits[k : k + order]] += n
    return found


class ClassModels:
    """Two letter models of words, toxic and ordinary, of one order. Each has its own counts of the longest n-grams;
    what they leave to shorter ones goes to continuation counts that both share: of how many longer grams each is part.

    Fitted, they are differences, toxic less ordinary log-probability: one for each gram that either class has seen, and
    one for each context before letters that neither has seen after it. After any other context both leave the letter
    to the same shared counts, so there is no difference.
    """

    def __init__(self, ordinary: Counter, toxic: Counter, order: int = ORDER):
        self.order = order
        self.codes = {c: k for k, c in enumerate(sorted(set().union(*ordinary, *toxic)), OTHER + 1)}
        own = [_grams(words, self.codes, order) for words in (ordinary, toxic)]
        below = self._shared(own[0].keys() | own[1].keys(), order - 1)
        total, kinds = [Counter(), Counter()], [Counter(), Counter()]
        for k in (0, 1):
            for gram, n in own[k].items():
                total[k][gram[:-1]] += n
                kinds[k][gram[:-1]] += 1

        def share(k: int, context) -> float:
            """What a class leaves to shorter grams after a context."""
            return DISCOUNT * kinds[k][context] / total[k][context] if context in total[k] else 1.0

        def p(k: int, gram) -> float:
            return max(own[k][gram] - DISCOUNT, 0) / max(total[k][gram[:-1]], 1) + share(k, gram[:-1]) * below(gram[1:])

        self.grams = {g: math.log(p(1, g) / p(0, g)) for g in sorted(own[0].keys() | own[1].keys())}
        self.contexts = {c: math.log(share(1, c) / share(0, c)) for c in sorted(total[0].keys() | total[1].keys())}

    def _shared(self, longer, n: int):
        """P(letter | n - 1 letters), from the kinds of grams of n + 1 letters; for grams that end one of these."""
        if n < 1:
            even = 1 / (len(self.codes) + 2)  # any letter, one that no word has, or the end
            return lambda gram: even
        count = Counter(g[1:] for g in longer)
        below = self._shared(count.keys(), n - 1)
        total, kinds = Counter(), Counter()
        for g, n_of in count.items():
            total[g[:-1]] += n_of
            kinds[g[:-1]] += 1
        return functools.cache(lambda g: (max(count[g] - DISCOUNT, 0) + DISCOUNT * kinds[g[:-1]] * below(g[1:])) / total[g[:-1]])

    def tables(self) -> tuple[dict[str, int], Lookup, Lookup]:
        """Codes of letters, and the values of grams and of contexts, for arrays."""

        def lookup(values: dict) -> Lookup:
            keys = np.zeros(len(values), np.uint64)
            for column in zip(*values, strict=True):
                keys = keys * np.uint64(_BASE) + np.array(column, np.uint64)
            return Lookup(keys, np.fromiter(values.values(), np.float32, len(values)))

        return self.codes, lookup(self.grams), lookup(self.contexts)


class Scorer:
    """The models over whole batches of texts, a bounded number of characters at a time, however long a text is."""

    def __init__(self, tables, order: int = ORDER):
        codes, self.grams, self.contexts = tables
        self.before = order - 1
        self.codes = np.where(_letters(), np.uint32(OTHER), np.uint32(0))
        self.codes[[ord(c) for c in codes]] = list(codes.values())

    def figures(self, some) -> np.ndarray:
        """For each text, of its words' length-normalised differences the largest, the second largest and the mean."""
        some = list(some)
        best, second = np.full(len(some), -np.inf), np.full(len(some), -np.inf)
        total, n = np.zeros(len(some)), np.zeros(len(some), np.int64)
        # What the last piece has left open: codes of the unfinished word's end, its sum and its letters.
        state = (np.zeros(0, np.uint64), 0.0, 0)
        for docs, ends, chars in self._pieces(some):
            places, words, state = self._words(chars, state)
            if not len(words):
                continue
            doc = docs[np.searchsorted(ends, places, side="right")]
            has, start = np.unique(doc, return_index=True)
            n[has] += (count := np.diff(np.append(start, len(doc))))
            total[has] += np.add.reduceat(words, start)
            top = np.maximum.reduceat(words, start)
            first = np.flatnonzero(words == np.repeat(top, count))
            rest = words.copy()
            rest[first[np.unique(doc[first], return_index=True)[1]]] = -np.inf
            second[has] = np.maximum(np.minimum(best[has], top), np.maximum(second[has], np.maximum.reduceat(rest, start)))
            best[has] = np.maximum(best[has], top)
        out = np.column_stack([best, second, total / np.maximum(n, 1)])
        out[~np.isfinite(out)] = 0  # no word, or no second one
        return out

    def _pieces(self, some: list[str]):
        """Stretches of the texts, one after another with a line end after each text: numbers of the texts, where each
        ends, and the characters."""
        own, docs, size = [], [], 0

        def piece():
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
            return np.array(docs), ends, np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)

        for k, text in enumerate(some):
            low = text.lower()
            for at in range(0, len(low) + 1, CHARS_AT_ONCE):
                part = low[at : at + CHARS_AT_ONCE]
                part += "\n" * (at + CHARS_AT_ONCE > len(low))
                if size + len(part) > CHARS_AT_ONCE + 1:
                    yield piece()
                    own, docs, size = [], [], 0
                own.append(part)
                docs.append(k)
                size += len(part)
        if own:
            yield piece()

    def _words(self, chars: np.ndarray, state):
        """Where the words that end in chars do so, and each one's difference over its letters and its end."""
        tail, carried, letters = state
        code = self.codes[chars].astype(np.uint64)
        letter = code > 0
        opened = letters > 0
        before = np.concatenate([[opened], letter[:-1]])
        at = np.arange(len(code), dtype=np.int64)
        begun = np.where(letter & ~before, at, -self.before if not opened else -len(tail))
        begun = np.maximum.accumulate(begun)
        stop = ~letter & before
        digits = np.where(stop, np.uint64(STOP), code)
        padded = np.concatenate([np.zeros(self.before - len(tail), np.uint64), tail, np.where(letter, code, np.uint64(0))])
        context = np.zeros(len(code), np.uint64)
        for j in range(self.before, 0, -1):
            earlier = padded[self.before - j : self.before - j + len(code)]
            context = context * np.uint64(_BASE) + np.where(at - begun >= j, earlier, np.uint64(START))
        use = np.flatnonzero(letter | stop)
        key = context[use]
        seen, value = self.grams(key * np.uint64(_BASE) + digits[use])
        unseen = np.flatnonzero(~seen)
        value[unseen] = self.contexts(key[unseen])[1]
        ends = np.flatnonzero(stop[use])  # places of the ends among the used characters
        firsts = np.concatenate([[0], ends + 1])
        sums = np.append(value.astype(np.float64), 0.0)
        sums = np.add.reduceat(sums, firsts)  # of each word, and of the unfinished one
        sums[0] += carried
        sizes = np.diff(np.append(firsts, len(use)))
        sizes[0] += letters
        if not letter[-1]:
            return use[ends], sums[:-1] / sizes[:-1], (np.zeros(0, np.uint64), 0.0, 0)
        left = int(sizes[-1])
        return use[ends], sums[:-1] / sizes[:-1], (padded[len(padded) - min(left, self.before) :], float(sums[-1]), left)


def _fitted(rows) -> ClassModels:
    counts = (Counter(), Counter())
    for text, y, _ in rows:
        counts[y].update(_WORD.findall(text.lower()))
    return ClassModels(*counts)


class ToxicityModel:
    def __init__(self, sample: list[tuple[str, int, bool]], share: float | None = None):
        seen, labels = [], []
        for half in (False, True):  # the curve is fitted on figures from models that haven't seen the row
            rows = [x for x in sample if x[2] is not half]
            seen.append(Scorer(_fitted([x for x in sample if x[2] is half]).tables()).figures(text for text, _, _ in rows))
            labels += [y for _, y, _ in rows]
        self.curve = Curve(np.concatenate(seen) if labels else [(0, 0, 0)], labels or [0], share)
        self.tables = _fitted(sample).tables()

    def scorer(self):
        """Scores of texts."""
        scorer = Scorer(self.tables)
        return lambda some: self.curve(scorer.figures(some))


def _model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int):
    """The fitted model for all tasks. Its size is bounded, as that of the sample is."""
    return docs.sparkSession.sparkContext.broadcast(ToxicityModel(*labelled_sample(docs, labels, "toxic", id_col, text_col, most)))


def _scored(model, threshold: float):
    def rows(batches):
        score = model.value.scorer()
        for b in slices(batches, 1):
            scores = score(texts(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(scores >= threshold).cast(pa.int32())], names=["doc_id", "score", "predicted"])

    return lean(rows)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, most: int = SAMPLE_DOCS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 from `threshold` on).

    Two letter-level Kneser-Ney models, one of words in toxic and one of words in ordinary documents, share their
    lower-order counts, so that a rare expression is judged by its parts. A word's figure is the difference of its
    log-likelihoods over its length; a document's are the largest, the second largest and the mean of its words', which
    a logistic curve makes a score. It is fitted on figures of rows by models that haven't seen them. Letters are those
    of any script; each that the sample has is its own symbol.

    Learns from a bounded sample of labelled documents (labelled_sample), none held out (crc32 of the id modulo 4 is 2);
    scores every row by its whole text, in pieces of bounded size, with no shuffle. Text alone decides: null, empty and
    wordless texts all get the score of no evidence, repeated rows equal scores. An id whose labels differ counts as
    toxic. Without labels of both classes, every score is the smoothed share of class 1 among them. Empty tables give
    empty tables; other columns are ignored, whatever their names.
    """
    model = _model(docs, labels, id_col, text_col, most)
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(_scored(model, threshold), "doc_id long, score double, predicted int").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def _clean(model, at: int, threshold: float):
    def rows(batches):
        score = model.value.scorer()
        for b in slices(batches, at):
            yield b.filter(pa.array(score(texts(b.column(at))) < threshold))

    return lean(rows)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, most: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of docs, all columns, that toxicity_scores() does not predict to be toxic; nothing is shuffled.

    Null, empty and wordless texts have the score of no evidence; rows of one text stay or go together, repeated ones
    and those without an id too; very long texts are judged whole. An empty table stays empty. Other columns stay as
    they are, whatever their names.
    """
    model = _model(docs, labels, id_col, text_col, most)
    return small_batches(docs).mapInArrow(_clean(model, docs.columns.index(text_col), threshold), docs.schema)
