"""The corpus pipeline, stage by stage against plain versions."""

import base64
import os
import random
import re

import pytest

import corpus_pipeline
from faultline.llm import fourier_quality, language_kernel
from faultline.llm.storage import stored

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


def _shingles(text, n, words):
    found = re.findall(words, text or "")
    return {tuple(found[i:i + n]) for i in range(len(found) - n + 1)} or ({tuple(found)} if found else set())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns
            kept[name] = {r.doc_id for r in docs.collect()}
            assert docs.count() == len(kept[name])
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "quality", "near_duplicates", "benchmark", "packing"]

    all_docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = language_kernel.languages(all_docs).collect()
    assert kept["language"] == {
        r.doc_id for r in found if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    scores = fourier_quality.scored(all_docs.filter(all_docs.doc_id.isin(list(kept["language"]))),
                                    spark.read.parquet(f"{SF_DIR}/labels.parquet")).collect()
    assert kept["quality"] == {r.doc_id for r in scores if r.predicted}

    sets = {d: _shingles(before[d].translate({c: c + 32 for c in range(65, 91)}), 5, r"[^\x20\x09-\x0D]+") for d in kept["quality"]}
    label = {d: d for d in sets}
    for _ in range(len(sets)):
        changed = False
        for x in sets:
            for y in sets:
                if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                    low = min(label[x], label[y])
                    changed |= label[x] != low or label[y] != low
                    label[x] = label[y] = low
        if not changed:
            break
    assert kept["near_duplicates"] == set(label.values())

    items = [_shingles(r.text.lower(), 5, r"(?:[0-9a-z]|[^\x00-\x7f])+") for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    held = {d: _shingles(before[d].lower(), 5, r"(?:[0-9a-z]|[^\x00-\x7f])+") for d in kept["near_duplicates"]}
    leaked = {d for d, own in held.items() if any(i and 100 * len(i & own) >= 80 * len(i) for i in items)}
    assert leaked and kept["benchmark"] == kept["near_duplicates"] - leaked

    assert {r.doc_id for r in docs.collect()} == kept["benchmark"]


OTHERS = [
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
    "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem "
    "i powinni postępować wobec innych w duchu braterstwa.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
]


def test_texts_of_no_learned_language_go(spark):
    draw = random.Random(5)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang", "text")
    clean = [r for r in docs.collect() if r.text and re.search(r"[^\W\d_]", r.text)]
    letters = " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(300))
    with open(corpus_pipeline.__file__) as file:
        code = file.read().split('"""', 2)[2]
    gone = [*OTHERS, letters, letters * 400, base64.b64encode(draw.randbytes(3000)).decode(), code]
    long = {lang: "\n".join(r.text for r in clean if r.lang == lang) for lang in {r.lang for r in clean}}
    long = [text * (1_000_000 // len(text) + 1) for text in long.values()] + ["\n".join(long.values())]
    short = [" ".join(r.text.split()[:6]) for r in clean[:40]]
    added = [(-1 - i, None, t) for i, t in enumerate([*gone, *long, *short])]
    kept = corpus_pipeline.by_language(spark, docs.union(spark.createDataFrame(added, docs.schema)), SF_DIR)
    found = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not found & {-1 - i for i in range(len(gone))}
    assert found == {r.doc_id for r in clean} | {-1 - i for i in range(len(gone), len(added))}
