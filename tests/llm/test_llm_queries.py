"""The registered queries of the training-data package: against SQL, plain versions, or held-out labels."""

import collections
import glob
import os
import zlib

import numpy as np
import pytest

import __spark_entry__ as contract
from faultline.llm import queries as llm

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return connection


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("select doc_id, coalesce(text, '') from documents order by doc_id").fetchall()


def test_registered_in_the_contract():
    assert set(llm.queries()) | {"pipeline"} <= set(contract.queries())
    assert sorted(int(name[2:].split("_")[0]) for name in llm.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = llm.queries()[name](spark, SF_DIR)
    result = duck.execute(llm.oracle_sql()[name])
    named = [c[0] for c in result.description]
    assert sorted(named) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*named).collect())) == sorted(result.fetchall())


def _ids(name, texts, end):
    tokenizers = pytest.importorskip("tokenizers")
    path = llm._tokenizer(name)
    library = tokenizers.Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return [np.array([*e.ids, *end], "<u4") for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_codes_give_the_library_s_ids(spark, documents):
    got = {r.doc_id: r for r in llm.queries()["op6_token_codes"](spark, SF_DIR).collect()}
    before = 0
    for (doc, _), ids in zip(documents, _ids("word_bpe_49k.json", [t for _, t in documents], [1]), strict=True):
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (before, len(ids), zlib.crc32(ids.tobytes()))
        before += len(ids)
    assert len(got) == len(documents)


def test_packing_holds_every_token_once_in_few_sequences(spark, documents):
    rows = llm.queries()["op7_packing"](spark, SF_DIR).collect()
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    total = 0
    for (doc, _), ids in zip(documents, _ids("byte_bpe_50k.json", [t for _, t in documents], [2]), strict=True):
        at = 0
        for i, r in enumerate(sorted(pieces[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (i, at, zlib.crc32(ids[at:at + r.length].tobytes()))
            assert i == 0 or r.length == 1024
            at += r.length
        assert at == len(ids)
        total += at
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.01 * -(-total // 1024) + 2


def test_edited_counts_equal_whole_encodings(spark, duck):
    rows = duck.execute("select doc_id, coalesce(text, ''), source from documents").fetchall()
    got = {r.doc_id: r for r in llm.queries()["op8_edit_counts"](spark, SF_DIR).collect()}
    edited = []
    for _, text, source in rows:
        n, a, b = len(text), len(text) // 4, len(text) // 2
        text = text[:a] + source + text[a + 12:]
        text = text[:b] + text[b + 40:] + f" {n}"
        edited.append(text)
    before = _ids("byte_bpe_50k.json", [t for _, t, _ in rows], [])
    after = _ids("byte_bpe_50k.json", edited, [])
    for (doc, _, _), x, y in zip(rows, before, after, strict=True):
        assert (got[doc].n_tokens, got[doc].n_tokens_edited, got[doc].n_edits) == (len(x), len(y), 3)


@pytest.mark.parametrize(("name", "label", "least"), [("op4_insult_kernel", "toxic", 0.8), ("op10_fourier_quality", "quality", 0.9)])
def test_held_out_accuracy(spark, duck, name, label, least):
    labels = dict(duck.execute(f"select doc_id, {label} from labels").fetchall())
    rows = llm.queries()[name](spark, SF_DIR).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= least * len(held)


def test_languages_of_held_out_documents(spark, duck):
    known = dict(duck.execute("select doc_id, lang from documents").fetchall())
    rows = llm.queries()["op5_language_kernel"](spark, SF_DIR).collect()
    assert len(rows) == len(known)
    held = [r for r in rows if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.95 * len(held)
