"""Line de-duplication, ranked search and hard negatives against plain versions, with their edge cases."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import blocks, bond_negatives, line_dedup, ranked_search, selection
from faultline.llm.runtime import prepared

CLASHING = ("_row", "row", "n", "at", "keep", "lines", "n_lines", "text_hash", "doc", "score", "rank", "found_id", "label_", "h1", "line", "kept")
EXTRA = "".join(f", {c} string" for c in CLASHING)


def _with_clashes(rows):
    return [(*r, *[f"x{i}" for i in range(len(CLASHING))]) for r in rows]


def _key(line):
    return line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})


def _lines_plain(rows, min_docs, min_chars, keep_first):
    """``rows`` of (doc_id, text): expected (doc_id, n_lines, n_dropped, digest) of each row."""
    order = lambda r: (r[0] is not None, r[0] or 0)
    holders, firsts = collections.defaultdict(set), {}
    for doc, text in sorted(set(rows), key=order):
        for i, line in enumerate((text or "").split("\n")):
            holders[_key(line)].add((doc, text))
            firsts.setdefault(_key(line), (doc, text, i))
    often = {k for k, d in holders.items() if len(k) >= min_chars and len(d) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stays = [_key(x) not in often or (keep_first and firsts[_key(x)] == (doc, text, i)) for i, x in enumerate(lines)]
        kept = "\n".join(x for x, s in zip(lines, stays, strict=True) if s)
        out.append((doc, len(lines), stays.count(False), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


LINES = [
    (1, None), (2, ""), (3, "\n\n"), (4, "Shared\nown 4"), (5, " shared\t\nown 5\nSHARED"), (6, "x\nshared"), (6, "x\nshared"),
    (7, "ÀB shared\nÀb SHARED\n" + "long " * 50_000), (8, "àb shared"), (9, " shared"), (10, "\x1cshared\r\n\x0b shared \x0c"),
    (11, "\n".join(f"line {i % 700}" for i in range(30_000))), (12, "\n".join(f"LINE {i}" for i in range(0, 700, 2)) + "\nown 12\n"), (13, "中文\n中文\nshared"),
]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize(("min_docs", "min_chars"), [(2, 1), (3, 1), (2, 0), (2, 7)])
def test_lines(spark, monkeypatch, keep_first, min_docs, min_chars):
    docs = spark.createDataFrame(_with_clashes(LINES), "doc_id long, text string" + EXTRA).repartition(3)
    want = _lines_plain(LINES, min_docs, min_chars, keep_first)
    for rows in (selection.BROADCAST_ROWS, 0):
        monkeypatch.setattr(selection, "BROADCAST_ROWS", rows)
        got = line_dedup.line_digests(docs, min_docs, min_chars, keep_first)
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_lines_without_an_id_and_of_one_id(spark):
    rows = [(None, "a\nb"), (None, "a\nc"), (1, "a"), (1, "a\nd"), (1, "a\nd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in line_dedup.without_lines(docs, line_dedup.keep_bitmaps(docs, 4)).select("doc.doc_id", "kept").collect()}
    assert got == {(None, "b"), (None, "c"), (1, ""), (1, "d")}
    assert line_dedup.keep_bitmaps(docs, 5).count() == 0
    assert line_dedup.line_digests(docs.limit(0)).count() == 0


def test_keep_bitmaps_are_runs_of_kept_lines(spark):
    rows = [(i, "a\nb\nown %d\nown too %d\na\nend %d" % (i, i, i)) for i in range(3)] + [(9, "a\na"), (10, "nothing shared")]
    got = {r.doc_id: r for r in line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()}
    assert set(got) == {0, 1, 2, 9}
    assert [tuple(r) for r in got[0].keep] == [(2, 2), (5, 1)] and (got[0].n_lines, got[0].n_dropped) == (6, 3)
    assert got[9].keep == [] and got[9].n_dropped == 2


def test_line_plan_streams_ranges_and_stays_in_the_jvm(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    found = line_dedup.occurrences(docs)
    plan = line_dedup._frequent(found, 10, False)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Window"):]
    assert below.count("Exchange") == 1 and "rangepartitioning(h1" in below and "doc_id" in below
    digests = line_dedup.line_digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan + digests)


def _terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in found]


def _ranked_plain(docs, items, top):
    words = [(d, _terms(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = collections.Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in sorted(set(items), key=repr):
        scored = []
        for d, own in words:
            tf = collections.Counter(own)
            if own:
                m = 50 + 50 * len(own) * n_docs // n_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m))
                            for t in set(_terms(text)) if tf[t])
                if score > 0:
                    scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, r[3], -r[0]) for i, r in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def _search_rows():
    draw = random.Random(4)
    words = [f"w{i}" for i in range(120)] + ["Été", "中文", "a1b2"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(draw.choices(words, weights, k=draw.choice([1, 3, 20, 80])))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(70)] + [docs[9]] * 3  # ties and repeated rows
    docs += [(2001, None), (2002, ""), (2003, "!?. -"), (None, docs[7][1]), (2004, "w3,W3;w3 ÉTÉ 中文。"), (2005, "w5 " * 60_000)]
    items = [(i, " ".join(draw.choices(words, k=draw.choice([1, 4, 12])))) for i in range(12)]
    items += [(20, docs[7][1]), (21, None), (22, "..."), (23, "unknown terms only"), (24, " ".join(words)), (24, " ".join(words)), (25, "w0 W0 w0"), (None, "w4 w5")]
    return docs, items


@pytest.mark.parametrize(("block", "size", "step"), [(200_000, 8192, 64), (40, 64, 1)])
def test_ranked_search(spark, monkeypatch, block, size, step):
    prepared(spark)
    docs, items = _search_rows()
    for name, value in (("BLOCK", block), ("_DOCS", size), ("_STEP", step)):
        monkeypatch.setattr(ranked_search, name, value)
    got = ranked_search.ranked(spark.createDataFrame(_with_clashes(docs), "doc_id long, text string" + EXTRA).repartition(3),
                               spark.createDataFrame(_with_clashes(items), "item_id long, text string" + EXTRA), 50)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == _ranked_plain(docs, items, 50)


def test_ranked_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, "z")], "item_id long, text string")
    assert ranked_search.ranked(docs.limit(0), items).count() == ranked_search.ranked(docs, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in ranked_search.ranked(docs, items).collect()] == [(1, 1, 1)]


def test_masks_cut_off_groups_that_cannot_rank(monkeypatch):
    """Documents of the weaker masks are never scored once the last place is above them."""
    import pyarrow as pa

    n = 4000
    terms = [[0, 1, 2] if i % 40 == 0 else [2] for i in range(n)]
    batch = pa.RecordBatch.from_pydict({
        "doc_id": pa.array(range(n), pa.int64()), "n": pa.array([10] * n, pa.int64()), "terms": pa.array(terms, pa.list_(pa.int32())),
        "tf": pa.array([[1] * len(t) for t in terms], pa.list_(pa.int64()))})
    block = ranked_search._Postings([batch], np.array([9000, 8000, 10]), n, 10 * n)
    scored, plain = [], block.scores
    monkeypatch.setattr(block, "scores", lambda docs, own: scored.append(len(docs)) or plain(docs, own))
    best = ranked_search._Best(50)
    ranked_search._search(block, np.array([0, 1, 2]), best)
    assert sum(scored) == 100 and best.ids.tolist() == list(range(0, 2000, 40))


def test_best_ranks_in_two_steps(spark):
    rows = spark.range(0, 5000, 1, 90).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    got = blocks.best(rows, ["k"], [F.desc("v")], 4).collect()
    assert sorted((r.k, r["rank"], r.v) for r in got) == [(k, i + 1, max(v for v in range(5000) if v % 3 == k) - 3 * i) for k in range(3) for i in range(4)]


def _negatives_plain(rows, positives=5, negatives=10):
    usable = [(i, v, lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(256 * x) for x in v], int(math.fmod(lab + 1, 10)) if i is not None and i % 7 == 0 else lab) for i, v, lab in usable]
    out = []
    for a, own, lab in {(i, tuple(v), lab) for i, v, lab in whole if i is not None and i % 100 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(own, v, strict=False)), i is None, i or 0, i, other == lab) for i, v, other in whole if i != a)
        for p in [s for s in scored if s[4]][:positives]:
            inside = [s for s in scored if not s[4] and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]][:negatives]
            out += [(a, p[3], k + 1, s[3], -p[0], -s[0]) for k, s in enumerate(inside)]
    return sorted(out, key=repr)


def _vectors():
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 24))
    rows = []
    for i in range(900):
        v = centres[i % 6] * draw.choice([0.2, 0.6, 1.0]) + draw.normal(size=24) * 0.5
        rows.append((i, [float(np.float32(x)) for x in v], int(draw.integers(0, 10))))
    same = rows[10][1]
    rows += [(1000 + i, same, i % 3) for i in range(80)]  # ties
    rows += [rows[300], rows[300], rows[17], rows[17]]  # repeated anchors and rows
    rows += [(2000, None, 1), (2100, [1.0, None] + [0.0] * 22, 1), (2200, [float("nan")] * 24, 2), (2300, [float("inf")] * 24, 2),
             (2400, same, None), (2500, [0.0] * 24, 1), (2600, [], 1), (2700, same[:9], 1), (None, same, 1), (-100, same, 3), (2800, [x * 40 for x in same], -5)]
    return rows


@pytest.mark.parametrize(("block", "size", "columns"), [(4_000_000, 1_000_000, 8), (60, 2500, 1)])
def test_hard_negatives(spark, monkeypatch, block, size, columns):
    prepared(spark)
    for name, value in (("BLOCK", block), ("_ROWS", size), ("_COLUMNS", columns)):
        monkeypatch.setattr(bond_negatives, name, value)
    vectors = _vectors()
    df = spark.createDataFrame(_with_clashes(vectors), "vec_id long, embedding array<double>, label int" + EXTRA).repartition(3)
    rows = bond_negatives.usable(df, relabel_every=7)
    got = bond_negatives.hard_negatives(rows, rows.filter(F.col("vec_id") % 100 == 0))
    want = _negatives_plain(vectors)
    assert len(want) > 300 and sorted(map(tuple, got.collect()), key=repr) == want


def test_columns_are_left_out_of_the_scan():
    """Once the bounds tell the first rows apart, later columns are read for few rows."""
    import pyarrow as pa

    draw = np.random.default_rng(1)
    vectors = draw.integers(-20, 20, (5000, 64))
    vectors[:, :8] *= 30
    batch = pa.RecordBatch.from_pydict({
        "vec_id": pa.array(range(5000), pa.int64()), "label": pa.array([1] * 5000, pa.int64()), "v": pa.array(vectors.tolist(), pa.list_(pa.int64()))})
    block, anchor = bond_negatives._Columns([batch]), bond_negatives._Anchor(-1, 1, vectors[3].tolist())
    best = bond_negatives._Best(5)
    sizes = []

    def keep(lowest, highest):
        sizes.append(len(lowest))
        return highest >= best.last_place(lowest)

    rows, score = block.scan(anchor, block.same_label(anchor), keep)
    best.add(block, rows, score)
    assert sizes[0] == 5000 and sizes[-1] < 500
    whole = vectors @ vectors[3]
    assert best.ids.tolist() == np.lexsort((np.arange(5000), -whole))[:5].tolist()


def test_hard_negatives_of_nothing(spark):
    empty = bond_negatives.usable(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), 7)
    assert bond_negatives.hard_negatives(empty, empty).count() == 0
    large = spark.createDataFrame([(0, [2.0**60], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large"):
        bond_negatives.usable(large).collect()
