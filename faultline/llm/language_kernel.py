"""Language identification by a string kernel.

A text is cut into even blocks of about ``BLOCK_BYTES``, so that its length does not matter. A block is the set of
byte n-grams (1 to ``SPECTRUM`` bytes, hashed to ``WIDTH`` places) of its lower-cased letters, with one blank for
whatever stands between words. The kernel of two blocks is the number of shared n-grams over the geometric mean of
their own numbers. The first blocks of ``LANDMARKS`` training texts a language span a Nyström map, in which kernel
ridge regression learns one weight vector per language against the rest, from all blocks of the training texts.
A text's score is the mean of all its blocks' scores. Training and scoring are matrix products over batches of blocks.

These scores sum to 1 over the languages, so they cannot tell a text that is of none. That is told by the share of its
longest n-grams that the training texts of any language know, which no length changes. Its cut is taken from the
training texts: halfway between the share of a language's own blocks, each without what only itself knows, and the share of blocks
whose language is left out of what is known. A text below the cut, by more than chance explains at its length, keeps
the nearest language with score 0. A language with too few training texts to tell them from foreign ones has no cut.

Landmarks and training texts are samples by a hash of doc_id, at most ``LANDMARKS`` and ``TRAINING`` of each
language; every text is scored whole. Rules: a text that is null or has no letter gets ``und`` with score 0;
null languages are not learned; a null doc_id is never held out and never learned from; repeated rows count one by one;
with nothing to learn from every text is ``und``; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import text_arrays as ta
from faultline.llm.fourier_quality import held_out
from faultline.llm.normal_equations import partition_sums, ridge
from faultline.llm.sampling import ids_by_class
from faultline.llm.selection import text_hash
from faultline.llm.storage import stored

SPECTRUM = 4
WIDTH = 1 << 13
LANDMARKS = 40
TRAINING = 1500
STRENGTH = 1e-4
_BLOCK = 128
#: Long texts are cut into even blocks of about this many bytes.
BLOCK_BYTES = 2048
#: Places of the longest n-grams, for the share of them that training texts know.
KNOWN = 1 << 18
#: Standard errors below the cut, and deviations of a language's own blocks above it.
CHANCE, SPREAD = 2, 6

_LETTER = re.compile(r"[^\W\d_]")
_INSIDE = ta.table_of("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)


class Rows(NamedTuple):
    """Blocks of texts: their text's number and their number in it, 0/1 rows of n-gram places, and for each longest
    n-gram in order its block's place among them and its own place in ``KNOWN`` places."""

    text: np.ndarray
    block: np.ndarray
    present: np.ndarray
    owner: np.ndarray
    longest: np.ndarray


def presence(column: pa.Array) -> Iterator[Rows]:
    """All blocks of all texts, at most ``_BLOCK`` at a time; an empty text is one block."""
    lowered = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    for part in ta.slices(lowered):
        for a in range(0, part.n, _BLOCK):
            offsets = part.offsets[a:min(a + _BLOCK, part.n) + 1]
            data = part.data[offsets[0]:offsets[-1]]
            yield from _present(data, offsets - offsets[0], part.first + a)


def _present(data: np.ndarray, offsets: np.ndarray, first: int) -> Iterator[Rows]:
    n = len(offsets) - 1
    letters = _INSIDE[data]
    # one blank stands for a run of other characters, at the ends of a text too
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))[keep]
    plain = np.where(letters, data, 32)[keep].astype(np.uint32)
    # each text in even blocks of about BLOCK_BYTES; an n-gram is in the block that it begins in
    length = np.bincount(owner, minlength=n)
    blocks = np.maximum((length + BLOCK_BYTES // 2) // BLOCK_BYTES, 1)
    text = np.repeat(np.arange(n), blocks)
    number = np.arange(len(text)) - (np.cumsum(blocks) - blocks)[text]
    upto = lambda k: -(-k * length[text] // blocks[text])
    size = upto(number + 1) - upto(number)
    ends = np.concatenate([[0], np.cumsum(size)])
    for a in range(0, len(text), _BLOCK):
        b = min(a + _BLOCK, len(text))
        begin, end = ends[a], ends[b]
        more = min(end + SPECTRUM - 1, len(plain))
        row = np.repeat(np.arange(b - a), size[a:b])
        yield Rows(first + text[a:b], number[a:b], *_places(plain[begin:more], owner[begin:more], row, b - a))


def _places(plain: np.ndarray, text: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out = np.zeros((n, WIDTH), np.float32)
    code = np.zeros(len(plain), np.uint32)
    for size in range(1, SPECTRUM + 1):
        whole = len(plain) - size + 1
        if whole < 1:
            return out, np.zeros(0, np.int64), np.zeros(0, np.uint32)
        code = (code[:whole] << np.uint32(8)) | plain[size - 1:]
        some = min(whole, len(row))
        hashed = (code[:some] + np.uint32(size)) * np.uint32(0x9E3779B1)
        inside = text[:some] == text[size - 1:size - 1 + some]
        out.reshape(-1)[(row[:some] * WIDTH + (hashed >> np.uint32(32 - WIDTH.bit_length() + 1)))[inside]] = 1
    return out, row[:some][inside], (hashed >> np.uint32(32 - KNOWN.bit_length() + 1))[inside]


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


class LanguageModel:
    """Landmark sets, the Nyström map and the weights of each language."""

    def __init__(self, landmarks: np.ndarray) -> None:
        self.landmarks = np.ascontiguousarray(_unit(landmarks).T)
        values, vectors = np.linalg.eigh((self.landmarks.T @ self.landmarks).astype(np.float64))
        good = values > 1e-6 * values.max()
        self.map = (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)
        self.languages: list[str] = []
        self.weights = np.zeros((0, 0))
        self.known = np.zeros(KNOWN, bool)
        self.cuts = np.zeros(0)

    def features(self, rows: np.ndarray) -> np.ndarray:
        """Nyström features of presence rows, and one constant."""
        near = _unit(rows) @ self.landmarks @ self.map
        return np.hstack([near, np.ones((len(rows), 1), np.float32)])

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(column)
        total, blocks, grams, known = np.zeros((n, len(self.languages))), np.zeros(n), np.zeros(n), np.zeros(n)
        for rows in presence(column):
            np.add.at(total, rows.text, self.features(rows.present) @ self.weights)
            np.add.at(blocks, rows.text, 1)
            grams += np.bincount(rows.text[rows.owner], minlength=n)
            known += np.bincount(rows.text[rows.owner], self.known[rows.longest], n)
        mean = total / np.maximum(blocks, 1)[:, None]
        best = mean.argmax(axis=1)
        cut = self.cuts[best]
        # neighbouring n-grams share all but one byte, so only each SPECTRUM-th counts as a draw
        chance = CHANCE * np.sqrt(cut * (1 - cut) * SPECTRUM / np.maximum(grams, 1))
        foreign = (grams > 0) & (known < (cut - chance) * grams)
        return [self.languages[i] for i in best], np.where(foreign, 0, np.clip(mean[np.arange(n), best], 0, 1))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in presence(batch.column("text")):
            cuts = np.searchsorted(rows.owner, np.arange(len(rows.text) + 1))
            yield pa.RecordBatch.from_pydict({
                "lang": batch.column("lang").take(pa.array(rows.text)), "rank": batch.column("rank").take(pa.array(rows.text)),
                "block": pa.array(rows.block, pa.int64()),
                "bits": pa.array([np.packbits(r.astype(bool)).tobytes() for r in rows.present], pa.binary()),
                "longest": pa.array([rows.longest[a:b].tobytes() for a, b in itertools.pairwise(cuts)], pa.binary())})


def _unpacked(blobs: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), WIDTH // 8), axis=1).astype(np.float32)


def _seen(sets: DataFrame, languages: list[str]) -> np.ndarray:
    """For each language and place, the number of training blocks that have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, blob in zip(batch.column("lang").to_pylist(), batch.column("longest").to_pylist(), strict=True):
                seen.setdefault(lang, np.zeros(KNOWN, np.uint32))[np.unique(np.frombuffer(blob, np.uint32))] += 1
        for lang, counts in seen.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang]), "counts": pa.array([counts.tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.uint32).astype(np.uint32) for x in table.column("counts").to_pylist())
        return pa.table({"lang": table.column("lang").slice(0, 1), "counts": pa.array([total.astype(np.uint32).tobytes()], pa.binary())})

    schema = "lang string, counts binary"
    found = sets.select("lang", "longest").mapInArrow(count, schema).groupBy("lang").applyInArrow(add, schema).collect()
    by = {r["lang"]: np.frombuffer(bytes(r["counts"]), np.uint32) for r in found}
    return np.array([by[x] for x in languages])


def _least(seen: np.ndarray) -> np.ndarray:
    """Blocks that must have a place for it to be known: two, and more than if all places were alike."""
    return np.maximum(2, seen.sum(axis=-1) / KNOWN)


def _cuts(sets: DataFrame, languages: list[str], seen: np.ndarray) -> np.ndarray:
    """For each language, the share of known n-grams below which a text is of no language; 0 is no cut."""
    place = {name: i for i, name in enumerate(languages)}
    least = _least(seen)
    knowing = (seen >= least[:, None]).sum(axis=0).astype(np.uint16)
    own = [(x >= k).astype(np.uint8) + (x >= k + 1) for x, k in zip(seen, least, strict=True)]

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, mean_own, mean_foreign = [], [], []
            for lang, blob in zip(batch.column("lang").to_pylist(), batch.column("longest").to_pylist(), strict=True):
                if blob:
                    at = np.frombuffer(blob, np.uint32)
                    mine = own[place[lang]][at]
                    others = knowing[at] > (mine > 0)
                    names.append(lang)
                    # without this block, a place must be known by one block more
                    mean_own.append(float(((mine > 1) | others).mean()))
                    mean_foreign.append(float(others.mean()))
            yield pa.RecordBatch.from_pydict({"lang": pa.array(names, pa.string()), "own": pa.array(mean_own, pa.float64()),
                                              "foreign": pa.array(mean_foreign, pa.float64())})

    middle = lambda x: F.percentile(x, F.lit(0.5))
    rows = sets.select("lang", "longest").mapInArrow(shares, "lang string, own double, foreign double")
    found = rows.groupBy("lang").agg(middle("own").alias("own"), middle("foreign").alias("foreign"))
    away = rows.join(F.broadcast(found.select("lang", F.col("own").alias("middle"))), "lang").groupBy("lang").agg(
        middle(F.abs(F.col("own") - F.col("middle"))).alias("away"))
    by = {r["lang"]: r for r in found.join(away, "lang").collect()}
    # a text by chance has as much as the share of places that are known
    level = max(float(np.median([r["foreign"] for r in by.values()] or [0])), float((knowing > 0).mean()))
    out = np.zeros(len(languages))
    for lang, r in by.items():
        if r["own"] > level:
            out[place[lang]] = max(min((r["own"] + level) / 2, r["own"] - SPREAD * 1.4826 * r["away"]), 0)
    return out


def fit(docs: DataFrame, folds: int, fold: int) -> LanguageModel | None:
    """A model of the languages of ``docs(doc_id, lang, text)`` outside the held-out fold."""
    train = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    ids = ids_by_class(train.select("doc_id", "lang"), "lang", TRAINING)
    # bounded by the number of languages times TRAINING
    sample = train.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id")
    sets = stored(sample.select("lang", "rank", "text").mapInArrow(_packed, "lang string, rank int, block long, bits binary, longest binary"), "language-sets")
    top = sets.filter((F.col("rank") <= LANDMARKS) & (F.col("block") == 0)).groupBy("lang", "rank").agg(F.min("bits").alias("bits")).orderBy("lang", "rank").collect()
    if not top:
        return None
    model = LanguageModel(_unpacked([bytes(r["bits"]) for r in top]))
    model.languages = sorted({r["lang"] for r in top})
    place = {name: i for i, name in enumerate(model.languages)}

    def equations(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        targets = np.zeros((batch.num_rows, len(place)))
        targets[np.arange(batch.num_rows), [place[x] for x in batch.column("lang").to_pylist()]] = 1
        return model.features(_unpacked(batch.column("bits").to_pylist())), targets

    model.weights = ridge(*partition_sums(sets, equations), STRENGTH).astype(np.float32)
    seen = _seen(sets, model.languages)
    model.known = (seen >= _least(seen)[:, None]).any(axis=0)
    model.cuts = _cuts(sets, model.languages, seen)
    return model


def languages(docs: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """One row per row of ``docs(doc_id, lang, text)``: doc_id, text_hash, held_out, lang_pred and score.

    Languages of documents whose crc32(doc_id) mod ``folds`` is ``fold`` are never read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", text_hash().alias("text_hash"))
    model = fit(rows, folds, fold)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _named(model, batch.column("text"))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "lang_pred": names, "score": pa.array(scores)})

    done = rows.select("doc_id", "text_hash", "text").mapInArrow(predict, "doc_id long, text_hash long, lang_pred string, score double")
    return done.select("doc_id", "text_hash", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score")


def _named(model: LanguageModel | None, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Language and score of each text; ``und`` and 0 where there is no letter or nothing was learned."""
    plain = pc.match_substring_regex(pc.fill_null(texts, ""), "[A-Za-z]").to_numpy(zero_copy_only=False)
    lettered = [p or bool(t and _LETTER.search(t)) for p, t in zip(
        plain, texts.to_pylist() if not plain.all() else plain, strict=True)]
    names, scores = model.predict(texts) if model else ([""] * len(texts), np.zeros(len(texts)))
    known = np.array(lettered, bool) & (model is not None)
    return (pa.array([x if k else "und" for x, k in zip(names, known, strict=True)], pa.string()),
            np.where(known, scores, 0.0).astype(np.float64))


def with_language(docs: DataFrame, least_score: float, folds: int = 5, fold: int = 0) -> DataFrame:
    """``docs`` without rows of no language (score 0) or a score below ``least_score``; all columns stay.

    Rows are judged where they are read: of all columns only the text goes through Python, and nothing is joined.
    """
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"), folds, fold)

    def stays(texts: pa.Array) -> pa.Array:
        names, scores = _named(model, texts)
        return pa.array((scores >= least_score) & np.asarray(pc.not_equal(names, "und")))

    return docs.filter(F.arrow_udf(stays, "boolean")(F.col("text")))
