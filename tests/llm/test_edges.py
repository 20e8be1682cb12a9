"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm import (
    chat_format,
    containment,
    edit_counts,
    fourier_quality,
    insult_kernel,
    language_kernel,
    line_frequency,
    oracles,
    packing,
    sampling,
    signature_trees,
    token_codes,
    tokenizing,
)
from faultline.llm import text_arrays as ta
from faultline.llm.components import components
from faultline.llm.queries import _tokenizer
from faultline.llm.runtime import prepared
from faultline.llm.storage import new_path

pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and {i}" for i in range(60_000))
ROWS = [
    (1, None, None, None, None), (None, "a text without an id, of some more words than five in all", "en", "s", 3),
    (2, "", "en", "s", 0), (3, " \n\t ", "de", "s", 4), (4, "one", "en", "s", 3), (5, LONG, "en", "s", len(LONG)),
    (6, "the same words again and again in one line", "en", "s", 1), (7, "the same words again and again in one line", "en", "t", 1),
    (7, "the same words again and again in one line", "en", "t", 1), (7, "another text of the same id, which is longer", None, "t", 1),
    (8, "中文 \U0001f642 été \x1c\x00 <|endoftext|>", "fr", "s", 1), (9, "1234 5678 !!!", "en", "s", 1),
]
CLASHING = ("_row", "_hash", "row", "node", "label", "score", "doc", "host", "line", "text_hash", "component", "stays", "length", "offset")


@pytest.fixture(scope="module")
def docs(spark):
    prepared(spark)
    rows = [(*r, *[f"x{i}" for i in range(len(CLASHING))]) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(d, d % 2, (d + 1) % 2) for d in range(2, 10)] + [(None, 1, 1), (3, None, None), (4, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def _ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is not None, x))


ALL_IDS = sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x))


def test_line_quality(docs, none):
    got = line_frequency.line_quality(docs)
    assert _ids(got) == ALL_IDS and line_frequency.line_quality(none).count() == 0
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[5].n_words == 180_000 and by[5].kept


def test_line_limits(spark):
    common = "shared line of the host"
    rows = [(i, f"{common}\nown line {chr(97 + i)}", "h") for i in range(6)] + [(9, common, "h"), (10, common, None), (11, f"x\n{common}", "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_frequency.line_quality(df, min_docs=5, share=0.1).collect()}
    assert [got[i].removed_lines for i in (0, 9, 10, 11)] == [1, 1, 0, 0]
    left = {r.doc_id: r.text for r in line_frequency.without_frequent_lines(df, min_docs=5, share=0.1).collect()}
    assert left[0] == "own line a" and left[9] == "" and left[10] == common and left[11] == f"x\n{common}"


def test_jaccard(docs, none):
    got = signature_trees.jaccard_components(docs)
    assert _ids(got) == ALL_IDS and signature_trees.jaccard_components(none).count() == 0
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got.collect()}
    assert by[1, 0] == 1 and by[2, 0] == 2 and by[3, 0] == 3 and by[4, 1] == 4 and by[7, 7] == by[6, 7] == 6


def test_one_of_each(docs, none):
    got = signature_trees.one_of_each(docs)
    assert got.columns == docs.columns and signature_trees.one_of_each(none).count() == 0
    assert _ids(got) == sorted([None, 1, 2, 3, 4, 5, 6, 7, 8, 9], key=lambda x: (x is not None, x))
    assert {r.text for r in got.collect() if r.doc_id == 7} == {"another text of the same id, which is longer"}
    assert {r.stays for r in got.collect()} == {"x11"}


@pytest.mark.parametrize(("keys", "percent"), [("parts", 90), ("parts", 80), ("minhash", 80)])
def test_jaccard_equals_all_pairs(spark, keys, percent, monkeypatch):
    # small chunks: the ways for blocks that are too large are taken too
    draw = random.Random(3)
    base = [[f"w{draw.randrange(4000)}" for _ in range(draw.choice([3, 8, 30, 120]))] for _ in range(12)]
    rows = []
    for i in range(260):
        words = list(draw.choice(base))
        for _ in range(draw.choice([0, 1, 1, 2, 4, 9])):
            words[draw.randrange(len(words))] = f"n{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: {tuple(w[i:i + 3]) for i in range(max(len(w) - 2, 1))} for d, t in rows for w in [t.split()]}
    label = {d: d for d in sets}
    links = [(x, y) for x, y in itertools.combinations(sets, 2) if 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y])]
    for _ in sets:
        for x, y in links:
            label[x] = label[y] = min(label[x], label[y])
    for chunk in (2_000_000, 400):
        monkeypatch.setattr(signature_trees, "CHUNK", chunk)
        got = signature_trees.jaccard_components(df, 3, percent, keys).collect()
        assert {r.doc_id: r.component_id for r in got} == label


def test_components(spark):
    draw = random.Random(1)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7), (9, 9)]
    label = {n: n for pair in links for n in pair}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: x for n, x in label.items() if n in got} and {n for p in links if p[0] != p[1] for n in p} == set(got)


def test_chat_layouts(spark):
    prepared(spark)
    records = [
        ('{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":null},null]}', "messages", [("user", "hi"), ("assistant", ""), ("", "")]),
        ('{"id":7,"conversations":[{"value":"q","from":"human"},{"from":"gpt","value":"a & b"}]}', "from_value", [("user", "q"), ("assistant", "a & b")]),
        ('{"response":"r","prompt":"p"}', "prompt_response", [("user", "p"), ("assistant", "r")]),
        ('{"system":"s","prompt":"p","response":5}', "prompt_response", [("system", "s"), ("user", "p"), ("assistant", "5")]),
        ('{"instruction":"do","input":"x","output":"y"}', "instruction", [("user", "do"), ("user", "x"), ("assistant", "y")]),
        ('{"instruction":"do","output":"y"}', "instruction", [("user", "do"), ("assistant", "y")]),
        ('{"question":"q","answer":"### a: </turn>\\n"}', "question_answer", [("user", "q"), ("assistant", "### a: </turn>\n")]),
        ('{"data":{"reply":{"text":"r"},"prompt":{"text":"p"}}}', "nested_pair", [("user", "p"), ("assistant", "r")]),
        ('{"prompt":"p","completion":"c","id":"1"}', "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ('{"prompt":"p","other":"c"}', None, []), ("[1]", None, []), ("{", None, []), (None, None, []), ("", None, []),
        ('{"messages":[{"role":"a: ### &colon;","content":"' + "long " * 50_000 + '"}]}', "messages", [("a: ### &colon;", "long " * 50_000)]),
    ]
    df = spark.createDataFrame([(i, r, "kept") for i, (r, _, _) in enumerate(records)], "id int, record string, row string")
    done = chat_format.formatted(chat_format.canonical_turns(df))
    got = done.select("id", "layout", "row", "turns", chat_format.read_back(done.formatted).alias("back"),
                      chat_format.loss_texts(done.formatted, done.loss_spans).alias("loss")).collect()
    assert len(got) == len(records)
    for r in got:
        _, layout, turns = records[r.id]
        assert (r.layout, [tuple(t) for t in r.turns], [tuple(t) for t in r.back]) == (layout, turns, turns)
        assert list(r.loss) == [t for role, t in turns if role == "assistant"] and r.row == "kept"
    assert chat_format.formatted(chat_format.canonical_turns(df.limit(0))).count() == 0


def test_chat_records_beyond_the_variant(spark):
    """Records with a text of 21 million characters keep their layout and all turns; malformed ones still have none."""
    long = F.repeat(F.lit("### a & "), 2_700_000)
    json = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    records = [
        (json('{"id":1,"messages":[{"role":"user","content":"', long, '"},null,{"content":"short","role":"assistant"}]}'), "messages", ["user", "", "assistant"]),
        (json('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"', long, '"}]}'), "from_value", ["user", "assistant"]),
        (json('{"system":null,"prompt":"', long, '","response":"r"}'), "prompt_response", ["system", "user", "assistant"]),
        (json('{"prompt":"p","response":"', long, '"}'), "prompt_response", ["user", "assistant"]),
        (json('{"data":{"prompt":{"text":"', long, '"},"reply":{"text":"r"}}}'), "nested_pair", ["user", "assistant"]),
        (json('{"messages":[{"role":"user","content":"', long, '","other":1}]}'), None, []),
        (json('{"prompt":"', long, '"'), None, []),
    ]
    df = spark.range(len(records)).select("id", F.lit("x").alias("_keys_"), F.coalesce(*[F.when(F.col("id") == i, r) for i, (r, _, _) in enumerate(records)]).alias("record"))
    done = chat_format.formatted(chat_format.canonical_turns(df))
    back = chat_format.read_back(F.col("formatted"))
    got = done.select("id", "layout", "fingerprint", "turns.role", (back == F.col("turns")).alias("same"),
                      F.aggregate("turns", F.lit(0), lambda n, t: n + F.length(t["text"])).alias("chars")).orderBy("id").collect()
    assert [(r.layout, r.role) for r in got] == [(layout, roles) for _, layout, roles in records]
    assert all(r.same for r in got) and [r.chars for r in got] == [21_600_005, 21_600_001, 21_600_001, 21_600_001, 21_600_001, 0, 0]
    short = spark.createDataFrame([('{"prompt":"p","response":"r"}',)], "record string")
    assert chat_format.canonical_turns(short).first().fingerprint == got[3].fingerprint


@pytest.mark.parametrize(("operator", "label"), [(fourier_quality, "quality"), (insult_kernel, "toxic")])
def test_scores(docs, none, labels, operator, label):
    got = operator.scored(docs, labels, label)
    assert _ids(got) == ALL_IDS and all(0 <= r.score <= 1 for r in got.collect())
    assert operator.scored(none, labels, label).count() == 0
    assert _ids(operator.scored(docs, labels.limit(0), label)) == ALL_IDS


def test_insults_with_gaps_and_inserted_letters():
    words = ["idiot", "stupid", "worthless", "pathetic"] * 3 + ["the", "mountain", "thing", "reading", "other", "station", "stud", "path"] * 8
    part = next(ta.slices(pa.array([" ".join(words)])))
    found = insult_kernel.words_of(part)
    letters = [found.letters[a:a + n].astype(np.int64) for a, n in zip(found.start, found.length, strict=True)]
    y = np.array([1.0 if i < 12 else -1.0 for i in range(len(words))])
    model = insult_kernel.InsultModel(0.1)
    model.table, model.bias = insult_kernel.train_words(letters, y, np.ones(len(words)))
    tops = model.tops(pa.array(["i d i o t", "st*upid", "wortthless", "s.t.u.p.i.d", "pathexticc", "the mountain path", "reading", None, ""]))[:, 0]
    assert tops[:5].min() > 0 > tops[5:].max()


@pytest.mark.parametrize("all_p", [50.0, 1000.0, 30_000.0])
def test_telling_words_are_found_at_any_balance_of_labels(all_p):
    p, q = np.array([0.3, 0.2, 0.001, 0.0]) * all_p, np.array([0.0, 200.0, 1.0, 400.0])
    found = insult_kernel._labelled(np.ceil(p), q, all_p, 1000.0)
    assert found.tolist() == [1.0, -1.0, -1.0, -1.0]


def test_languages(docs, none):
    got = language_kernel.languages(docs)
    assert _ids(got) == ALL_IDS and language_kernel.languages(none).count() == 0
    by = {r.doc_id: r for r in got.collect()}
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (1, 2, 3, 9)) and by[8].lang_pred != "und"


def _prose(draw, units, n):
    """Words of the units, without meaning; each language of a test has its own units."""
    return " ".join("".join(draw.choices(units, k=draw.randint(1, 3))) for _ in range(n))


UNITS = {"aa": "the ing tion ed and er of th re on is ly".split(), "bb": "sch ung keit ich der ein ver zu ö heit ä ge".split(),
         "cc": "eau ique ment le é ou oi re è ai tre vi".split(), "dd": "ción ado os ñ mente rr ez que ll ar ja ó".split()}


def test_language_scores_do_not_fall_with_length(spark):
    prepared(spark)
    draw = random.Random(12)
    rich = {lang: units * 9 + [a + b for a in "bcdfghjklmnpqrstvwxz" for b in "aeiou"] for lang, units in UNITS.items()}
    short = [(4 * i + k, _prose(draw, units, 300), lang) for i in range(80) for k, (lang, units) in enumerate(rich.items())]
    long = [(1000 + k, _prose(draw, units, 150_000), lang) for k, (lang, units) in enumerate(rich.items())]
    df = spark.createDataFrame(short + long, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_kernel.languages(df.withColumn("lang", F.when(df.doc_id < 1000, df.lang))).collect()}
    for doc, _, lang in long:
        like = np.median([got[d].score for d, _, x in short if x == lang])
        assert got[doc].lang_pred == lang and got[doc].score > like - 0.1, (lang, got[doc].score, like)


def test_every_byte_of_a_text_is_in_a_block():
    draw = random.Random(13)
    texts = ["", None, "a", "ab", *(_prose(draw, UNITS["bb"], n) for n in (10, 900, 1500, 40_000, 3)), "12 34"]
    blocks = list(language_kernel.presence(pa.array(texts)))
    number = np.concatenate([b.text for b in blocks])
    assert sorted(set(number.tolist())) == list(range(len(texts))) and np.bincount(number)[7] > 40
    together = np.zeros((len(texts), language_kernel.WIDTH))
    for b in blocks:
        np.maximum.at(together, b.text, b.present)
    size = language_kernel.BLOCK_BYTES
    try:
        language_kernel.BLOCK_BYTES = 1 << 40
        whole = np.concatenate([b.present for b in language_kernel.presence(pa.array(texts))])
    finally:
        language_kernel.BLOCK_BYTES = size
    assert (together == whole).all()


def test_token_codes(spark, docs, none):
    path = _tokenizer("word_bpe_49k.json")
    folder, empty = new_path(spark, "codes"), new_path(spark, "codes")
    token_codes.write_codes(docs, folder, path, 1)
    token_codes.write_codes(none, empty, path, 1)
    got = token_codes.read_codes(spark, folder, with_ids=True).collect()
    assert sorted((r.doc_id for r in got), key=lambda x: (x is not None, x)) == ALL_IDS
    assert token_codes.read_codes(spark, empty).count() == 0
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == ALL_IDS and [r.start for r in ordered][1:] == list(np.cumsum([r.n_tokens for r in ordered]))[:-1]
    ids = {r.doc_id: list(r.ids) for r in got if r.doc_id in (1, 5, 8)}
    wanted = [(5, 0), (5, 100_000), (5, len(ids[5]) - 1), (5, len(ids[5])), (8, 2), (1, 0), (99, 0), (5, None)]
    found = token_codes.tokens_at(spark, folder, spark.createDataFrame(wanted, "doc_id long, position long")).collect()
    assert {(r.doc_id, r.position): r.token for r in found} == {
        (d, p): ids[d][p] if p is not None and p < len(ids[d]) else None for d, p in wanted if d != 99}


def test_codes_of_any_width():
    draw = np.random.default_rng(2)
    for ids in (np.zeros(0), np.array([0, 255, 256, 65_535, 65_536, 2**32 - 1]), draw.integers(0, 70_000, 5000), draw.integers(0, 200, 513)):
        code = token_codes.Code(token_codes.encoded(ids.astype(np.uint32)))
        assert code.all().tolist() == ids.tolist() and len(code) == len(ids)
        assert [code[i] for i in range(0, len(ids), 7)] == ids.tolist()[::7]
        with pytest.raises(IndexError):
            code[len(ids)]


def test_packing_edges(spark, docs, none):
    path = _tokenizer("byte_bpe_50k.json")
    got = packing.pack_documents(docs, path, 2).collect()
    assert {r.doc_id for r in got} == set(ALL_IDS) and packing.pack_documents(none, path, 2).count() == 0
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 1024
    with pytest.raises(ValueError, match="lengths outside"):
        packing.packed(spark.createDataFrame([(1, 2000)], "k int, length long")).count()


def test_packing_keeps_the_columns_of_its_parts(spark):
    prepared(spark)
    names = ("_row", "_salt", "_own", "_before", "_rank", "part", "k")
    rows = [(100 + i % 5, *[f"{name}{i}" for name in names]) for i in range(40)]
    parts = spark.createDataFrame(rows, "length long, " + ", ".join(f"{name} string" for name in names))
    got = packing.packed(parts)
    assert got.columns == [*parts.columns, "sequence_id", "offset"]
    assert sorted(got.select(*parts.columns).collect()) == sorted(parts.collect())
    for name in ("offset", "Sequence_ID"):
        with pytest.raises(ValueError, match="names of the result"):
            packing.packed(parts.withColumnRenamed("k", name))


def test_sample_of_ids_with_several_classes(spark):
    rows = [(i, "a") for i in range(40)] + [(i, "b") for i in range(30, 60)] + [(7, "a")] * 500 + [(None, "a"), (3, None)]
    given = spark.createDataFrame(rows, "doc_id long, lang string").filter("lang is not null")
    for part in (given, given.repartition(5, "lang")):
        got = sampling.ids_by_class(part, "lang", 1000).collect()
        assert sorted(r.doc_id for r in got if r.doc_id is not None) == list(range(60))
        # an id of two classes counts in the least
        assert sorted(r["rank"] for r in got) == sorted([*range(1, 42), *range(1, 21)])
    # repeated rows do not use up a class's share
    few = sampling.ids_by_class(given, "lang", 10).collect()
    assert len(few) == 20


def _fewest(items, capacity):
    """Least number of bins, by trying all ways."""
    best = len(items)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity:
                put(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1:]])
        put(i + 1, [*bins, items[i]])

    put(0, [])
    return best


def test_reduction_keeps_an_optimum_and_bins_hold_all():
    draw = random.Random(4)
    for _ in range(150):
        capacity = draw.choice([10, 17, 30])
        items = sorted((draw.randint(1, capacity) for _ in range(draw.randint(1, 9))), reverse=True)
        counts = {x: items.count(x) for x in items}
        fixed, left = packing.reduced(counts, capacity)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert sum(p.times for p in fixed) + _fewest(sorted(rest, reverse=True), capacity) == _fewest(items, capacity)
        patterns = packing.solve(counts, capacity)
        assert all(sum(x * n for x, n in p.items) <= capacity for p in patterns)
        held = {x: sum(p.times * n for p in patterns for y, n in p.items if x == y) for x in counts}
        assert held == counts


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_change_no_id_and_edits_no_count(name):
    draw = random.Random(6)
    signs = ["a", "bc", "é", "Σ", "İ", " ", "  ", "\n", "\t", " ", "́", "1", "23", "'s", "'ll", "don't", ".", "!!", "\r\n",
             "中", "\U0001f642", "<|endoftext|>", "Zz", ",", "x=", "̸", "÷", "-", "\x1c", "\u0085", " "]
    texts = ["".join(draw.choices(signs[:28] if k % 3 else signs, k=draw.choice([0, 1, 5, 40]))) for k in range(600)]
    tokenizer = tokenizing.Encoder(_tokenizer(name))
    got = []
    for part in ta.slices(pa.array(texts), 500):
        ids, cuts = tokenizer.encode(part)
        got += [ids[a:b].tolist() for a, b in itertools.pairwise(cuts)]
    assert got == tokenizer.encode_texts(texts)
    for k, text in enumerate(texts[::4]):
        chars, tokens, _ = edit_counts.chunk_counts(tokenizer, next(ta.slices(pa.array([text]))))
        counted = edit_counts.CountedText(text, chars, tokens)
        for _ in range(8):
            n = len(counted.text)
            edit = draw.randint(-1, n + 2), draw.choice([0, 1, 3, n]), "".join(draw.choices(signs[:28] if k % 3 else signs, k=draw.choice([0, 1, 4, 90])))
            edit_counts.edit_all(tokenizer, [(counted, *edit)])
            assert counted.tree.tokens == len(tokenizer.encode_texts([counted.text])[0])
            assert counted.tree.chars == len(counted.text)


def test_edits_of_a_table(spark, docs, none):
    path = _tokenizer("byte_bpe_50k.json")
    edits = spark.createDataFrame([(5, 2, 10, 5, " new"), (5, 1, 0, 0, "first "), (2, 1, None, None, "text"), (1, 1, 0, 9, None), (77, 1, 0, 0, "x")],
                                  "doc_id long, seq int, start long, length long, insert string")
    got = {r.doc_id: r for r in edit_counts.edited_counts(edit_counts.with_edits(docs, edits), path).collect()}
    library = tokenizing.Encoder(path)
    after = "first " + LONG
    after = after[:10] + " new" + after[15:]
    assert got[5].n_tokens_edited == len(library.encode_texts([after])[0]) and 0 < got[5].chars_encoded_again < 200
    assert (got[2].n_tokens, got[2].n_tokens_edited, got[1].n_tokens_edited, got[4].n_edits) == (0, 1, 0, 0)
    assert edit_counts.edited_counts(edit_counts.with_edits(none, edits), path).count() == 0


def test_kept_trees_take_batches_of_edits(spark, docs, none, tmp_path):
    path, library = _tokenizer("byte_bpe_50k.json"), tokenizing.Encoder(_tokenizer("byte_bpe_50k.json"))
    size = lambda text: len(library.encode_texts([text or ""])[0])
    table = edit_counts.counted_texts(docs.select("doc_id", "text", "source", "label"), path)
    table.write.parquet(str(tmp_path / "0"))
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id != 7}
    for turn, batch in enumerate([[(5, 1, 10, 5, " new "), (6, 1, 4, 4, "\u3000"), (2, 1, 0, 0, "from nothing")],
                                  [(5, 1, 200_000, 3, "xx"), (6, 1, 0, 0, "9 "), (8, 1, 0, 2, None), (4, 1, 0, 99, "")],
                                  [(5, 1, 0, 0, "\u00a0"), (2, 1, 4, 1, "  ")], [(5, 1, 300_000, 4, "end"), (4, 1, 0, 0, "again")]]):
        edits = spark.createDataFrame(batch, "doc_id long, seq int, start long, length long, insert string")
        kept = spark.read.parquet(str(tmp_path / str(turn)))
        edit_counts.apply_edits(edit_counts.with_edits(kept, edits), path).write.parquet(str(tmp_path / str(turn + 1)))
        got = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / str(turn + 1))).collect()}
        for doc, _, start, length, insert in batch:
            text = texts[doc] or ""
            texts[doc] = text[:start] + (insert or "") + text[start + length:]
        for doc, text in texts.items():
            row = got[doc]
            assert (row.text, row.n_tokens_edited) == (text, size(text)), (turn, doc)
            assert sum(row.chunk_chars) == len(text or "") and sum(row.chunk_tokens) == row.n_tokens_edited
            assert (row.n_edits > 0) == any(doc == e[0] for e in batch)
        assert turn > 1 or 0 < got[5].chars_encoded_again < 200
        assert got[5].source == "s" and got[9].chars_encoded_again == 0 and len(got) == len(set(ALL_IDS))
    # white space that only the library cuts made the third batch, and from then on the text, one chunk
    assert got[5].chars_encoded_again == len(got[5].text)
    assert edit_counts.apply_edits(edit_counts.with_edits(none, edits), path).isEmpty()


def test_trees_that_are_missing_or_of_another_text_are_built_anew(spark, docs):
    path, library = _tokenizer("byte_bpe_50k.json"), tokenizing.Encoder(_tokenizer("byte_bpe_50k.json"))
    rows = [(1, "some words of a text", None, None, [(0, 4, "more")]), (2, "other words", [3], [1], [(0, 0, "x")]),
            (3, "words", [], [], None), (4, None, None, None, None), (5, "two words", [3, 6], [1], [None])]
    df = spark.createDataFrame(rows,
                               "doc_id long, text string, chunk_chars array<int>, chunk_tokens array<int>, edits " + edit_counts.EDITS)
    got = {r.doc_id: r for r in edit_counts.apply_edits(df, path).collect()}
    for doc, text in {1: "more words of a text", 2: "xother words", 3: "words", 4: None, 5: "two words"}.items():
        assert (got[doc].text, got[doc].n_tokens_edited) == (text, len(library.encode_texts([text or ""])[0]))


def test_containment(spark, docs, none):
    items = spark.createDataFrame([
        (1, "Word5 and 5 word6 and 6 word7, and 7"), (2, None), (3, ""), (4, "too few words"), (None, "the same words again AND again in"),
        (6, "the same words again and again in"), (7, "nothing of this is in any of the texts there"), (8, LONG)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in containment.held_items(docs, items).collect()}
    assert got == {(5, 1), (5, 8), (6, None), (6, 6), (7, None), (7, 6)}  # item 4 is in no text
    assert containment.held_items(none, items).count() == containment.held_items(docs, items.limit(0)).count() == 0
    kept = containment.decontaminated(docs, items)
    assert kept.columns == docs.columns and _ids(kept) == sorted([None, 1, 2, 3, 4, 7, 8, 9], key=lambda x: (x is not None, x))


def test_containment_of_short_items(spark, docs, none, tmp_path):
    """Items of one to four words are found as runs of that length, as the SQL finds them."""
    duckdb = pytest.importorskip("duckdb")
    texts = [(i, t) for i, t, *_ in ROWS if i in (1, 2, 3, 4, 6)] + [
        (20, "We know: the answer IS forty-two."), (21, "forty two"), (22, "two forty"), (23, "the answer is forty 2 two"),
        (24, "forty two " * 40 + "in all the text of it"), (25, "forty\ntwo"), (26, "fortytwo")]
    items = [(1, "Forty two"), (2, "the answer is forty two"), (3, "two"), (4, "the answer is forty"), (5, "forty two"), (6, "—"), (7, None), (8, "again in one"), (9, "no such words")]
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in containment.held_items(table, bench).drop("text_hash").collect()}
    duck = duckdb.connect()
    duck.execute("create table documents (doc_id bigint, text varchar)").executemany("insert into documents values (?, ?)", texts)
    duck.execute("create table benchmark (item_id bigint, text varchar)").executemany("insert into benchmark values (?, ?)", items)
    assert got == set(duck.execute(oracles.CONTAINMENT).fetchall())
    # a mark beyond ASCII is a word here
    assert {(d, i) for d, i, _, _ in got} >= {(20, 1), (20, 2), (20, 3), (20, 4), (20, 5), (21, 1), (22, 3), (23, 4), (24, 1), (25, 5), (6, 8)}
    assert not {(22, 1), (23, 1), (26, 1), (26, 3)} & {(d, i) for d, i, _, _ in got}


def test_containment_in_blocks(spark, docs, monkeypatch):
    draw = random.Random(8)
    words = LONG.split()
    rows = [(i, " ".join(words[a:a + 20] if i % 2 else [f"q{draw.randrange(10**6)}" for _ in range(20)])) for i, a in enumerate(range(0, 9000, 300))]
    items = spark.createDataFrame(rows, "item_id long, text string").repartition(3)
    whole = sorted(map(tuple, containment.held_items(docs, items).collect()))
    monkeypatch.setattr(containment, "BLOCK", 40)
    assert sorted(map(tuple, containment.held_items(docs, items).collect())) == whole and len(whole) == 15


@pytest.mark.parametrize("number", range(5))
def test_stages_on_an_empty_table(spark, none, number, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    _, stage = corpus_pipeline.STAGES[number]
    got = stage(spark, none, str(tmp_path))
    assert got.count() == 0 and (number == 4 or got.columns == none.columns)


def test_stages_on_odd_rows(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "word5 and 5 word6 and 6 word7 and 7")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        counts.append(got.count())
        assert name == "packing" or got.columns == docs.columns
    assert counts[2] == 10 and counts[3] == len(ROWS) - 1 and counts[4] >= len(ROWS)
