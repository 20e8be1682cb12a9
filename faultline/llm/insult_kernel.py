"""Toxicity by a support vector machine on a subsequence string kernel.

The kernel of two words sums, over all subsequences of three letters (the word's begin and end count as one each) that
span at most ``SPAN`` letters in each, a decay per skipped letter, over norms by length; words with letters inserted or left out therefore stay
near. Marks inside a word are dropped and letters that stand alone in a row are read as one word, so ``i d i o t``
and ``id-iot`` are the word itself.

Training reads sentences of labelled documents, equal sentences once. A word that is significantly more frequent in
sentences of label 1 than of label 0 is a positive example, one that is not at all so a negative one. A Nyström map over ``LANDMARKS`` of these words turns
the kernel into a linear space, where a squared hinge loss is minimised; then as many negative words as there are
landmarks, those of the highest values, become landmarks too, and the loss is minimised again. Map, landmarks and weights fold into
one table of weights by letter triple, so scoring is a table look-up per triple, over whole texts. A document's
score is a logistic function of its three highest word values and the rate of high values, fitted on the training
documents.

Training documents are samples by a hash of doc_id of at most ``TRAINING`` a label, and at most ``WORDS`` words, the
most frequent ones. Rules: texts that are null, empty or without words of three letters have the lowest word values, and are
scored by them; a null doc_id is never held out and never labelled; repeated rows and labels count one by one; null
labels are ignored; with nothing to learn from, the score is the share of label 1 (0 without labels); other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import text_arrays as ta
from faultline.llm.fourier_quality import held_out
from faultline.llm.sampling import ids_by_class
from faultline.llm.selection import text_hash
from faultline.llm.storage import stored

SPAN = 5
DECAY = 0.6
LETTERS = 64
_BEGIN, _END = LETTERS - 1, LETTERS - 2
LANDMARKS = 128
TRAINING = 3000
WORDS = 20_000
CUT = 0.7
_TOP = 3
_HIGH = 0.3
_FEWEST, _RATIO = 3, 4.0
_STEPS = [(a, b, DECAY ** (b - 2)) for b in range(2, SPAN + 1) for a in range(1, b)]


# letters and words

def _letter_classes() -> np.ndarray:
    """Class of each code point of the first plane: 0 for no letter, 1 to 26 for a to z, others share the rest."""
    points = np.arange(1 << 16)
    out = (27 + points % (_END - 27)).astype(np.uint8)
    out[:0xC0] = 0
    out[97:123] = np.arange(1, 27)
    out[[0xAA, 0xB5, 0xBA]] = [27, 28, 29]
    for a, b in ((0xD7, 0xD8), (0xF7, 0xF8), (0x2000, 0x2070), (0x2190, 0x2C00), (0x3000, 0x3005)):
        out[a:b] = 0
    return out


_CLASS = _letter_classes()
_WHITE = np.zeros(1 << 16, bool)
_WHITE[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)]] = True


class Words(NamedTuple):
    """Letters of all words of a slice, with each word's start, length (begin and end included), text and sentence."""

    letters: np.ndarray
    start: np.ndarray
    length: np.ndarray
    text: np.ndarray
    sentence: np.ndarray


def words_of(part: ta.Slice) -> Words:
    """Words between white space without their marks; runs of single letters are one word."""
    lead = (part.data & 0xC0) != 0x80
    offsets = np.concatenate([[0], np.cumsum(lead)])[part.offsets]
    points = np.frombuffer(part.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    points = np.where(points < 1 << 16, points, 0xFFFF).astype(np.uint16)
    classes, white = _CLASS[points], _WHITE[points]
    letters = np.flatnonzero(classes)
    none = np.zeros(0, np.int64)
    if not len(letters):
        return Words(none.astype(np.int32), none, none, none, none)
    cut = white.copy()
    edges = offsets[:-1][offsets[:-1] < len(points)]
    edge = np.zeros(len(points), bool)
    edge[edges] = True
    token = np.cumsum(cut | edge)
    # a sentence ends at a stop before white space, or with the line or text
    stop = (points == 33) | (points == 46) | (points == 63)
    ends = points == 10
    ends[:-1] |= stop[:-1] & white[1:]
    sentence = np.cumsum(np.concatenate([[False], ends[:-1]]) | edge)
    owner = np.searchsorted(offsets, letters, "right") - 1
    number = token[letters]
    first = np.concatenate([[True], (number[1:] != number[:-1]) | (owner[1:] != owner[:-1])])
    start = np.flatnonzero(first)
    alone = np.diff(np.append(start, len(letters))) == 1
    joined = np.zeros(len(start), bool)
    joined[1:] = alone[1:] & alone[:-1] & (owner[start[1:]] == owner[start[:-1]])
    start = start[~joined]
    stop = np.append(start[1:], len(letters))
    marks = np.tile(np.array([_BEGIN, _END], np.int32), len(start))
    marked = np.insert(classes[letters].astype(np.int32), np.stack([start, stop], axis=1).reshape(-1), marks)
    place = start + 2 * np.arange(len(start))
    return Words(marked, place, np.diff(np.append(place, len(marked))), owner[start], sentence[letters[start]])


def norms(length: np.ndarray) -> np.ndarray:
    """Norm of a word by its length: root of the sum of squared decays of its triples."""
    total = sum(np.maximum(length - b, 0) * decay**2 for _, b, decay in _STEPS)
    return np.sqrt(np.maximum(total, 1e-9))


def triple_sums(letters: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each word the decayed sum of table values over its triples, over its norm."""
    n = len(letters)
    if not len(start):
        return np.zeros(0)
    word = np.repeat(np.arange(len(start), dtype=np.int32), length)
    sums = np.zeros(n, np.float32)
    for b in range(2, SPAN + 1):
        if n <= b:
            break
        inside = word[:-b] == word[b:]
        high, low = letters[:-b] * (LETTERS * LETTERS), letters[b:]
        both = np.zeros(n - b, np.float32)
        for a in range(1, b):
            both += table[high + letters[a:n - b + a] * LETTERS + low]
        sums[:-b] += np.where(inside, both, 0) * np.float32(DECAY ** (b - 2))
    return np.add.reduceat(sums, start) / norms(length)


def features_of(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triples of one word and their normalised weights."""
    place, weight = [], []
    for a, b, decay in _STEPS:
        if len(word) > b:
            place.append((word[:-b] * LETTERS + word[a:len(word) - b + a]) * LETTERS + word[b:])
            weight.append(np.full(len(word) - b, decay))
    if not place:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(place), np.concatenate(weight) / norms(np.array([len(word)]))[0]


def table_of(words: list[np.ndarray], factors: np.ndarray) -> np.ndarray:
    """Sum of the words' feature vectors times factors, as a table over all triples."""
    table = np.zeros(LETTERS**3)
    for word, factor in zip(words, factors, strict=True):
        place, weight = features_of(word)
        np.add.at(table, place, weight * factor)
    return table.astype(np.float32)


# the model

class InsultModel:
    """Folded weights by letter triple, and the logistic function over the highest word values."""

    def __init__(self, base: float) -> None:
        self.base, self.table, self.bias = base, None, -1.0
        self.curve = np.zeros(_TOP + 2)

    def tops(self, column: pa.Array) -> np.ndarray:
        """The highest word values of each text, highest first, and the logarithm of the rate of high ones."""
        out = []
        for part in ta.slices(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))):
            words = words_of(part)
            values = triple_sums(words.letters, words.start, words.length, self.table) + self.bias
            cuts = ta.bounds(words.text, part.n)
            best = np.full((part.n, _TOP + 1), self.bias)
            high = np.bincount(words.text, values > _HIGH, part.n) if len(values) else np.zeros(part.n)
            best[:, -1] = np.log(high + 0.5) - np.log(np.diff(cuts) + 20)
            for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if b > a:
                    some = values[a:b]
                    if b - a > _TOP:
                        some = np.partition(some, b - a - _TOP)[-_TOP:]
                    best[i, :len(some)] = np.maximum(np.sort(some)[::-1], self.bias)
            out.append(best)
        return np.concatenate(out) if out else np.zeros((0, _TOP + 1))

    def score(self, column: pa.Array) -> np.ndarray:
        if self.table is None:
            return np.full(len(column), self.base)
        return _logistic(self.tops(column), self.curve)


def _logistic(tops: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.clip(tops, -8, 2) @ curve[:-1] + curve[-1], -30, 30)))


def _fit_logistic(tops: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps, both labels weighing the same."""
    x = np.hstack([np.clip(tops, -8, 2), np.ones((len(tops), 1))])
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    curve, keep = np.zeros(x.shape[1]), np.diag([1e-4] * (_TOP + 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        slope = x.T @ (weight * (p - y)) + keep @ curve
        curve = curve - np.linalg.solve((x.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ x + keep, slope)
    return curve


def support_vector_weights(z: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float = 1e-5) -> np.ndarray:
    """Least squared hinge loss plus a ridge, by Newton steps; the last column of z is the constant."""
    w = np.zeros(z.shape[1])
    ridge = strength * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-9
    for _ in range(25):
        active = y * (z @ w) < 1
        if not active.any():
            break
        za, wa = z[active], weight[active] / weight.sum()
        new = np.linalg.solve((za.T * wa) @ za + ridge, za.T @ (wa * y[active]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def train_words(words: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Folded table and bias from labelled words (the most telling first)."""
    length = np.array([len(w) for w in words])
    letters, start = np.concatenate(words).astype(np.int32), np.cumsum(length) - length
    good, bad = np.flatnonzero(y > 0), np.flatnonzero(y < 0)
    # half of the landmarks are positive words as far as there are, the rest spread over the negative ones
    chosen = good[:LANDMARKS // 2]
    chosen = np.concatenate([chosen, bad[np.unique(np.linspace(0, len(bad) - 1, LANDMARKS - len(chosen)).astype(int))]]) if len(bad) else chosen
    near = lambda some: np.stack([
        triple_sums(letters, start, length, table_of([words[i]], np.ones(1))) for i in some], axis=1)
    kernel = near(chosen)
    table, bias = _folded(words, chosen, kernel, y, weight)
    values = triple_sums(letters, start, length, table)
    rest = np.setdiff1d(bad, chosen)
    hard = rest[np.argsort(-values[rest], kind="stable")[:LANDMARKS]]
    if not len(hard):
        return table, bias
    return _folded(words, np.concatenate([chosen, hard]), np.hstack([kernel, near(hard)]), y, weight)


def _folded(words: list[np.ndarray], chosen: np.ndarray, kernel: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Table and bias of the vector machine in the Nyström space of the chosen landmarks."""
    values, vectors = np.linalg.eigh(kernel[chosen])
    keep = values > 1e-4 * values.max()
    nystroem = vectors[:, keep] / np.sqrt(values[keep])
    z = np.hstack([kernel @ nystroem, np.ones((len(words), 1))])
    w = support_vector_weights(z, y, weight)
    return table_of([words[i] for i in chosen], nystroem @ w[:-1]), float(w[-1])


def _sentence_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column("y").to_numpy(zero_copy_only=False)
        for part in ta.slices(pc.utf8_lower(pc.fill_null(batch.column("text").cast(pa.large_string()), ""))):
            words = words_of(part)
            letters, y = words.letters.astype(np.uint8), labels[part.first:part.first + part.n]
            hashes = ta.span_hashes(letters, words.start, words.start + words.length)
            weight = ta.mixed(np.arange(len(hashes), dtype=np.uint64) - np.searchsorted(words.sentence, words.sentence).astype(np.uint64))
            named = np.zeros(int(words.sentence[-1]) + 1 if len(hashes) else 1, np.uint64)
            np.add.at(named, words.sentence, hashes * (weight | np.uint64(1)))
            seen = {
                (int(named[s]), letters[a:a + n].tobytes(), float(y[t]))
                for a, n, t, s in zip(words.start, words.length, words.text, words.sentence, strict=True) if n > 3}
            yield pa.RecordBatch.from_pydict({
                "sentence": pa.array(np.array([s for s, _, _ in seen], np.uint64).view(np.int64)),
                "word": pa.array([w for _, w, _ in seen], pa.binary()), "y": pa.array([y for _, _, y in seen], pa.float64())})


def _labelled(p: np.ndarray, q: np.ndarray, all_p: float, all_q: float) -> np.ndarray:
    """1 for words of label 1 by a likelihood ratio beyond what the number of words explains, -1 for words
    that are no more frequent there than chance would make them, 0 for words in between."""
    share, n = all_p / (all_p + all_q), p + q
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(p > 0, p * np.log(p / (n * share)), 0) + np.where(q > 0, q * np.log(q / (n * (1 - share))), 0)
    # rates within each label, so that it does not matter how many sentences of either there are
    more = ((p + 0.5) / (all_p + 1)) / ((q + 0.5) / (all_q + 1))
    sure = (more >= _RATIO) & (p >= _FEWEST) & (gain > np.log(len(p)) + 2)
    return np.where(sure, 1.0, np.where((more < _RATIO) | (gain < 2), -1.0, 0.0))


def fit(docs: DataFrame, labels: DataFrame, label: str) -> InsultModel:
    """A model from ``docs(doc_id, text)``, as many as are labelled in ``labels(doc_id, <label>)``."""
    known = labels.select("doc_id", F.col(label).cast("double").alias("y")).filter("y in (0, 1)")
    there = docs.select("doc_id").join(known, "doc_id")
    ids = ids_by_class(there, "y", TRAINING).select("doc_id")
    # at most TRAINING ids a label
    train = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").join(F.broadcast(known.join(ids, "doc_id", "left_semi")), "doc_id")
    train = stored(train.select("text", "y"), "insult-train")
    counts = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = counts.get(1.0, 0), counts.get(0.0, 0)
    model = InsultModel(bad / (bad + good) if bad + good else 0.0)
    if not bad or not good:
        return model
    once = train.mapInArrow(_sentence_words, "sentence long, word binary, y double").groupBy("sentence", "word").agg(F.max("y").alias("y"))
    seen = once.groupBy("word").agg(
        F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    rows = stored(seen, "insult-words")
    total = rows.agg(F.sum("p").alias("p"), F.sum("q").alias("q")).first()
    top = rows.filter("p + q > 1").orderBy(F.desc(F.col("p") + F.col("q")), "word").limit(WORDS).collect()
    if not top:
        return model
    words = [np.frombuffer(bytes(r["word"]), np.uint8).astype(np.int64) for r in top]
    p, q = (np.array([r[c] for r in top]) for c in ("p", "q"))
    y = _labelled(p, q, total["p"], total["q"])
    words, p, q, y = [w for w, k in zip(words, y, strict=True) if k], p[y != 0], q[y != 0], y[y != 0]
    if not (y > 0).any() or not (y < 0).any():
        return model
    weight = np.sqrt(p + q)
    weight[y > 0] *= max(1.0, 0.3 * weight[y < 0].sum() / weight[y > 0].sum())
    model.table, model.bias = train_words(words, y, weight)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "tops": pa.array(list(model.tops(batch.column("text"))), pa.list_(pa.float64())), "y": batch.column("y")})

    found = train.mapInArrow(tops, "tops array<double>, y double").collect()
    model.curve = _fit_logistic(np.array([r["tops"] for r in found]), np.array([r["y"] for r in found]))
    return model


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, fold: int = 1, cut: float = CUT) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, text_hash, held_out, score and predicted (score >= ``cut``).

    Labels of documents whose crc32(doc_id) mod ``folds`` is ``fold`` are never read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(rows.filter(~held_out(F.col("doc_id"), folds, fold)), labels, label)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.score(batch.column("text"))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"),
                "score": pa.array(got), "predicted": pa.array((got >= cut).astype(np.int32))})

    done = rows.withColumn("text_hash", text_hash()).mapInArrow(score, "doc_id long, text_hash long, score double, predicted int")
    return done.select("doc_id", "text_hash", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", "predicted")
