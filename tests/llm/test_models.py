"""The three learned operators against brute force: kernels by enumeration, exact machines without landmarks or random
features, the increasing fit by its definition; and held-out ranking, which a model that learned nothing fails."""

import itertools
import math
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from faultline.llm import fourier_quality as fq
from faultline.llm import insult_kernel as ik
from faultline.llm import language_kernel as lk
from faultline.llm import queries as llm
from faultline.llm import text_arrays as ta
from faultline.llm.normal_equations import partition_sums, ridge
from faultline.llm.runtime import prepared

LARGER = os.path.join(os.path.dirname(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")), "sf0.01")


def _words(draw, n):
    parts = "in so ta re lu mi ko de va ne ist unk".split()
    text = " ".join("".join(draw.choices(parts, k=draw.randint(1, 4))) for _ in range(n))
    found = ik.words_of(next(ta.slices(pa.array([text]))))
    return [found.letters[a:a + k].astype(np.int64) for a, k in zip(found.start, found.length, strict=True)]


def _subsequences(word):
    """Weight of each subsequence of three letters that spans at most SPAN steps, by listing all of them."""
    found: dict[tuple, float] = {}
    for i, j, k in itertools.combinations(range(len(word)), 3):
        if k - i <= ik.SPAN:
            triple = int(word[i]), int(word[j]), int(word[k])
            found[triple] = found.get(triple, 0) + ik.DECAY ** (k - i - 2)
    return found


def _norm(word):
    return math.sqrt(sum(ik.DECAY ** (2 * (k - i - 2)) for i, _, k in itertools.combinations(range(len(word)), 3) if k - i <= ik.SPAN) or 1e-9)


def test_subsequence_kernel_is_the_enumerated_one():
    words = _words(random.Random(1), 25)
    listed, lengths = [_subsequences(w) for w in words], np.array([len(w) for w in words])
    letters, start = np.concatenate(words).astype(np.int32), np.cumsum(lengths) - lengths
    for i, word in enumerate(words):
        got = ik.triple_sums(letters, start, lengths, ik.table_of([word], np.ones(1)))
        truth = [sum(x * other.get(t, 0) for t, x in listed[i].items()) / _norm(word) / _norm(w) for w, other in zip(words, listed, strict=True)]
        assert np.allclose(got, truth, rtol=1e-4, atol=1e-6)


def test_landmark_machine_is_the_exact_one_when_all_words_are_landmarks():
    draw = random.Random(2)
    words = list({w.tobytes(): w for w in _words(draw, 60)}.values())
    y = np.array([draw.choice([-1.0, 1.0]) for _ in words])
    weight = np.array([draw.uniform(0.5, 2) for _ in words])
    lengths = np.array([len(w) for w in words])
    letters, start = np.concatenate(words).astype(np.int32), np.cumsum(lengths) - lengths
    kernel = np.stack([ik.triple_sums(letters, start, lengths, ik.table_of([w], np.ones(1))) for w in words], axis=1)
    table, bias = ik._folded(words, np.arange(len(words)), kernel, y, weight)
    got = ik.triple_sums(letters, start, lengths, table) + bias
    # the same loss over the listed subsequences themselves
    place = {t: i for i, t in enumerate(sorted({t for w in words for t in _subsequences(w)}))}
    z = np.zeros((len(words), len(place) + 1))
    for row, word in zip(z, words, strict=True):
        for t, x in _subsequences(word).items():
            row[place[t]] = x / _norm(word)
    z[:, -1] = 1
    exact = z @ ik.support_vector_weights(z, y, weight)
    assert np.abs(got - exact).max() < 0.05 and (np.sign(got) == np.sign(exact)).mean() > 0.97


def _grams(text):
    raw = re.sub(rb"[^a-z\x80-\xff]+", b" ", text.lower().encode())
    return {raw[i:i + n] for n in range(1, lk.SPECTRUM + 1) for i in range(len(raw) - n + 1)}


def _texts(draw, n):
    units = {"aa": "the ing tion ed and er of".split(), "bb": "sch ung keit ich der ein ver".split(), "cc": "eau ique ment le oi re ai".split()}
    return [(" ".join("".join(draw.choices(units[lang], k=draw.randint(1, 3))) for _ in range(draw.randint(4, 30))), lang)
            for lang in draw.choices(sorted(units), k=n)]


def _rows(texts):
    return np.concatenate([r.present for r in lk.presence(pa.array([t for t, _ in texts]))])


def test_presence_kernel_is_that_of_the_n_gram_sets(monkeypatch):
    monkeypatch.setattr(lk, "WIDTH", 1 << 20)
    texts = _texts(random.Random(3), 30) + [(t, "aa") for t in ("  12, The thing!  ", "Über 3 Äpfel", "a", "the")]
    unit = lk._unit(_rows(texts))
    sets = [_grams(t) for t, _ in texts]
    truth = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    # the places are hashes, of which hardly two fall together at this width
    assert np.abs(unit @ unit.T - truth).max() < 0.005


def test_landmark_ridge_is_plain_kernel_ridge_when_all_texts_are_landmarks():
    draw = random.Random(4)
    train, new = _texts(draw, 50), _texts(draw, 40)
    names = sorted({lang for _, lang in train})
    target = np.array([[float(lang == x) for x in names] for _, lang in train])
    model = lk.LanguageModel(_rows(train))
    z = model.features(_rows(train)).astype(np.float64)
    got = model.features(_rows(new)) @ ridge(z.T @ z, z.T @ target, lk.STRENGTH)
    places = [[set(np.flatnonzero(r).tolist()) for r in _rows(x)] for x in (train, new)]
    near = lambda a, b: np.array([[1 + len(x & y) / math.sqrt(len(x) * len(y)) for y in b] for x in a])
    strength = lk.STRENGTH * np.trace(z.T @ z) / z.shape[1]
    exact = near(places[1], places[0]) @ np.linalg.solve(near(places[0], places[0]) + strength * np.eye(len(train)), target)
    assert np.abs(got - exact).max() < 0.01
    assert [names[i] for i in got.argmax(axis=1)] == [lang for _, lang in new]


def test_fourier_features_approach_the_gaussian_kernel():
    points = np.random.default_rng(5).normal(size=(40, len(fq.STATISTICS)))
    z = fq.Projection(np.zeros(points.shape[1]), np.ones(points.shape[1]), features=40_000)(points)[:, :-1]
    distance = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-distance / (2 * fq.BANDWIDTH**2))).max() < 0.03


def test_increasing_fit_is_the_one_of_its_definition():
    draw = random.Random(6)
    for n in (1, 2, 5, 12, 30):
        total = [draw.randint(1, 6) for _ in range(n)]
        positive = [draw.randint(0, t) for t in total]
        mean = lambda a, b: Fraction(sum(positive[a:b + 1]), sum(total[a:b + 1]))  # noqa: B023, E731
        # least squares under order: the largest over beginnings of the smallest mean over ends
        fit = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        blocks = [list(g) for _, g in itertools.groupby(range(n), key=fit.__getitem__)]
        at = [sum(x * total[x] for x in g) / sum(total[x] for x in g) for g in blocks]
        shares = [(sum(positive[x] for x in g) + 0.5) / (sum(total[x] for x in g) + 1) for g in blocks]
        x, y = fq.isotonic(np.arange(n, dtype=float), np.array(positive, float), np.array(total, float))
        assert np.allclose(x, at) and np.allclose(y, shares)


def test_partition_sums_are_those_of_all_rows(spark):
    prepared(spark)
    rows = np.random.default_rng(7).normal(size=(500, 4))
    df = spark.createDataFrame([([float(v) for v in r[:3]], float(r[3])) for r in rows], "x array<double>, y double").repartition(5)
    matrix = lambda b: np.array(b.column("x").to_pylist())
    squares, targets = partition_sums(df, lambda b: (matrix(b), b.column("y").to_numpy()[:, None]))
    x, y = rows[:, :3], rows[:, 3:]
    assert np.allclose(squares, x.T @ x) and np.allclose(targets, x.T @ y)
    assert np.allclose(ridge(squares, targets, 0.0), np.linalg.lstsq(x, y, rcond=None)[0])


# Some labels are noise: of the 18 held-out documents of label toxic at least three hold no insult at all, and nothing ranks them
# above clean ones, so the area cannot come near 1 there. A model that always says 0 has recall 0 and area 0.5.
@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no larger test tables here")
@pytest.mark.parametrize(("name", "label", "precision", "recall", "area"), [
    ("op4_insult_kernel", "toxic", 0.9, 0.75, 0.85), ("op10_fourier_quality", "quality", 0.98, 0.98, 0.97)])
def test_held_out_documents_are_told_apart(spark, name, label, precision, recall, area):
    table = pq.read_table(os.path.join(LARGER, "labels.parquet"))
    labels = {d: v for d, v in zip(table.column("doc_id").to_pylist(), table.column(label).to_pylist(), strict=True) if v is not None}
    rows = [r for r in llm.queries()[name](spark, LARGER).select("doc_id", "held_out", "score", "predicted").collect()
            if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.held_out for r in rows)
    good = np.array([r.score for r in rows if labels[r.doc_id] == 1])
    bad = np.array([r.score for r in rows if labels[r.doc_id] == 0])
    assert len(good) > 5 and len(bad) > 5
    caught = sum(r.predicted for r in rows if labels[r.doc_id] == 1)
    assert caught >= recall * len(good) and caught >= precision * sum(r.predicted for r in rows)
    wins = (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()
    assert wins >= area, wins
