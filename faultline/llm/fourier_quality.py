"""Quality classifier: ridge regression on random Fourier features of document statistics.

Every text is described by ``STATISTICS`` (shares and logarithms of counts). Standardised by the training
rows and projected on ``FEATURES`` random directions, their cosines approximate a Gaussian kernel; ridge
weights come from normal equations summed by partition. The raw scores of the training rows, counted in
bins, are calibrated by isotonic regression, so that a score reads as the chance of label 1.

Training takes every labelled row that is not held out; there is no sample. Rules: null and empty texts have
all statistics 0 and are scored like any other; a null doc_id is never held out and never labelled; repeated rows
and repeated labels count one by one; null labels are ignored; without labels of both kinds the score is the share of label
1 there is (0.5 without any). Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm import text_arrays as ta
from faultline.llm.normal_equations import partition_sums, ridge
from faultline.llm.selection import BROADCAST_ROWS, text_hash
from faultline.llm.storage import stored

FEATURES = 384
BANDWIDTH = 4.0
STRENGTH = 1e-5
SEED = 20260
_BINS = 2000

_UPPER = ta.table_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = ta.table_of("abcdefghijklmnopqrstuvwxyz")
_DIGIT = ta.table_of("0123456789")
_SYMBOL = ta.table_of("#*$%&|<>{}[]\\^~=+_@/")
_STOP = ta.table_of(".!?")
_PAUSE = ta.table_of(",;:-'\"()")

STATISTICS = (
    "log_bytes", "log_words", "upper", "lower", "digit", "symbol", "stop", "pause", "beyond_ascii", "bang", "bar",
    "word_length", "word_spread", "short_words", "long_words", "symbol_words", "capital_words", "shout_words", "distinct_words", "repeat_neighbours",
    "repeat_runs", "line_words", "line_spread", "repeat_lines", "stopped_lines", "short_lines", "entropy",
)


def statistics(part: ta.Slice) -> np.ndarray:
    """One row of ``STATISTICS`` for each text of a slice; ratios over nothing are 0."""
    data, n = part.data, part.n
    sizes = np.diff(part.offsets).astype(float)
    count = lambda flags: ta.counts_within(flags, part.offsets).astype(float)
    upper, lower, symbol, stop = _UPPER[data], _LOWER[data], _SYMBOL[data], _STOP[data]
    words = ta.word_spans(part)
    cuts = ta.bounds(words.text, n)
    n_words = np.diff(cuts).astype(float)
    length = (words.end - words.start).astype(float)
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    per_text = lambda values, owner: np.bincount(owner, values, n)
    upto = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    within = lambda total, a, b: total[b] - total[a]
    capitals = within(upto(upper), words.start, words.end)
    marks = within(upto(symbol), words.start, words.end)
    hashes = ta.span_hashes(data, words.start, words.end)
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.text[1:] == words.text[:-1])
    runs = ta.run_hashes(hashes, 3)

    lines = ta.spans(part, data != 10)
    line_words = (np.searchsorted(words.start, lines.end) - np.searchsorted(words.start, lines.start)).astype(float)
    line_cuts = ta.bounds(lines.text, n)
    n_lines = np.diff(line_cuts).astype(float)
    line_hash = ta.span_hashes(data, lines.start, lines.end)
    mean_line, mean_word = share(per_text(line_words, lines.text), n_lines), share(per_text(length, words.text), n_words)
    distinct, again, line_again, entropy = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        a, b = cuts[i], cuts[i + 1]
        if b > a:
            distinct[i] = len(np.unique(hashes[a:b])) / (b - a)
        if b - a > 3:
            again[i] = 1 - len(np.unique(runs[a:b - 2])) / (b - a - 2)
        c, d = line_cuts[i], line_cuts[i + 1]
        if d > c:
            line_again[i] = 1 - len(np.unique(line_hash[c:d])) / (d - c)
        if sizes[i]:
            p = np.bincount(data[part.offsets[i]:part.offsets[i + 1]], minlength=256) / sizes[i]
            entropy[i] = -(p[p > 0] * np.log2(p[p > 0])).sum()
    spread = lambda values, owner, mean, total: np.sqrt(np.maximum(
        share(per_text(values * values, owner), total) - mean * mean, 0))
    found = {
        "log_bytes": np.log1p(sizes), "log_words": np.log1p(n_words), "upper": share(count(upper), sizes), "lower": share(count(lower), sizes),
        "digit": share(count(_DIGIT[data]), sizes), "symbol": share(count(symbol), sizes), "stop": share(count(stop), sizes),
        "pause": share(count(_PAUSE[data]), sizes), "beyond_ascii": share(count(data > 127), sizes),
        "bang": share(count(data == 33), sizes), "bar": share(count(data == 124), sizes),
        "word_length": np.minimum(mean_word, 50), "word_spread": np.minimum(spread(length, words.text, mean_word, n_words), 50),
        "short_words": share(per_text(length < 3, words.text), n_words), "long_words": share(per_text(length > 10, words.text), n_words),
        "symbol_words": share(per_text(marks > 0, words.text), n_words),
        "capital_words": share(per_text(upper[words.start], words.text), n_words),
        "shout_words": share(per_text(capitals > 1, words.text), n_words), "distinct_words": distinct,
        "repeat_neighbours": share(per_text(same, words.text), n_words), "repeat_runs": again,
        "line_words": np.log1p(mean_line), "line_spread": np.log1p(spread(line_words, lines.text, mean_line, n_lines)),
        "repeat_lines": line_again, "stopped_lines": share(per_text(stop[lines.end - 1], lines.text), n_lines),
        "short_lines": share(per_text(line_words < 4, lines.text), n_lines), "entropy": entropy,
    }
    return np.stack([found[name] for name in STATISTICS], axis=1).astype(np.float32)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(part) for part in ta.slices(batch.column("text"))]
        if rows:
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "stats": pa.array(list(np.concatenate(rows)), pa.list_(pa.float32()))})


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("stats").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, len(STATISTICS)).astype(np.float64)


class Projection:
    """Random Fourier features of standardised statistics, and one constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, bandwidth: float = BANDWIDTH) -> None:
        draw = np.random.default_rng(SEED)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.directions = draw.normal(size=(len(mean), features)) / bandwidth
        self.phases = draw.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        standard = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(standard @ self.directions + self.phases)
        return np.hstack([waves, np.ones((len(stats), 1))])


def isotonic(x: np.ndarray, positive: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least squares increasing fit (pool adjacent violators) of positive / total over sorted x."""
    blocks: list[list[float]] = []
    for at, p, t in zip(x, positive, total, strict=True):
        blocks.append([at * t, p, t])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    # half a row of each label is added to a block, so that no score is certain
    return (np.array([b[0] / b[2] for b in blocks]), np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks]))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def _score_bin(raw: Column) -> Column:
    return F.floor((F.least(F.greatest(raw, F.lit(-1.0)), F.lit(2.0)) + 1) * (_BINS / 3))


class QualityModel:
    """Projection, weights and calibration; small enough for any closure."""

    def __init__(self, projection: Projection | None, weights: np.ndarray | None, base: float) -> None:
        self.projection, self.weights, self.base = projection, weights, base
        self.knots: tuple[np.ndarray, np.ndarray] | None = None

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.projection(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.base)
        raw = self.raw(stats)
        return np.clip(np.interp(raw, *self.knots), 0, 1) if self.knots else np.clip(raw, 0, 1)


def fit(described: DataFrame, labels: DataFrame, label: str) -> QualityModel:
    """A model from all rows of ``described(doc_id, stats)`` with a label in ``labels(doc_id, <label>)``."""
    known = labels.select("doc_id", F.col(label).cast("double").alias("y")).filter("y is not null")
    train = stored(described.join(known, "doc_id").select("stats", "y"), "quality-train")
    ones = partition_sums(train, lambda b: (np.hstack([_matrix(b), np.ones((b.num_rows, 1))]), b.column("y").to_numpy()[:, None]))
    if ones is None:
        return QualityModel(None, None, 0.5)
    squares, targets = ones
    n = squares[-1, -1]
    base = float(targets[-1, 0] / n)
    if not 0 < base < 1:
        return QualityModel(None, None, base)
    mean = squares[-1, :-1] / n
    scale = np.sqrt(np.maximum(np.diag(squares)[:-1] / n - mean**2, 0))
    projection = Projection(mean, scale)
    sums = partition_sums(train, lambda b: (projection(_matrix(b)), b.column("y").to_numpy()[:, None]))
    model = QualityModel(projection, ridge(*sums, STRENGTH)[:, 0], base)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"raw": pa.array(model.raw(_matrix(batch))), "y": batch.column("y")})

    bins = train.mapInArrow(raw, "raw double, y double").groupBy(_score_bin(F.col("raw")).alias("bin")).agg(
        F.avg("raw").alias("x"), F.sum("y").alias("p"), F.count("*").alias("n")).orderBy("bin").collect()
    model.knots = isotonic(*(np.array([float(r[c]) for r in bins]) for c in ("x", "p", "n")))
    return model


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, fold: int = 1, cut: float = 0.5) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, text_hash, held_out, score and predicted (score >= ``cut``).

    Labels of documents whose crc32(doc_id) mod ``folds`` is ``fold`` are never read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash"))
    described = stored(rows.mapInArrow(_described, "doc_id long, text_hash long, stats array<float>"), "quality-statistics")
    model = fit(described.filter(~held_out(F.col("doc_id"), folds, fold)), labels, label)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.score(_matrix(batch))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "score": pa.array(got), "predicted": pa.array((got >= cut).astype(np.int32))})

    done = described.mapInArrow(score, "doc_id long, text_hash long, score double, predicted int")
    return done.select("doc_id", "text_hash", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", "predicted")


def without_poor(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, fold: int = 1, cut: float = 0.5) -> DataFrame:
    """``docs`` without the rows predicted to be poor; all columns stay.

    Statistics of labelled documents are stored to learn from. Rows are judged where they are read: of all columns only
    the text goes through Python, and nothing is joined.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash")).filter(
        ~held_out(F.col("doc_id"), folds, fold))
    labelled = labels.filter(F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    if labelled.count() <= BROADCAST_ROWS:
        # other documents need no statistics yet
        rows = rows.join(F.broadcast(labelled), "doc_id", "left_semi")
    model = fit(rows.mapInArrow(_described, "doc_id long, text_hash long, stats array<float>"), labels, label)

    def stays(texts: pa.Array) -> pa.Array:
        parts = [model.score(statistics(part).astype(np.float64)) for part in ta.slices(texts)]
        return pa.array(np.concatenate(parts) >= cut if parts else np.zeros(0, bool))

    return docs.filter(F.arrow_udf(stays, "boolean")(F.col("text")))
