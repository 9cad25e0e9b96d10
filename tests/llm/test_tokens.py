from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle

from silverprint.llm import simple8b, word_bpe
from silverprint.llm import texts as texts_module
from silverprint.llm.byte_bpe import Encoder
from silverprint.llm.queries import vocabulary
from silverprint.workspace import new_table_path
from tests.llm.data import SCHEMA, awkward, prose, rows_of

ODD = list("aAbΣς éÉ̀İßﬁ１½²_'s  \n\t  \x1c\x85.!?😀中文اَ‍\U0010ffff") + [
    "<|endoftext|>", "<|startoftext|>", "'ll", "'re", " ", "don't", "I'M", " 's", "''s", "\n's", "1's",
]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def word_model():
    return word_bpe.tokenizer(vocabulary("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def byte_model():
    return word_bpe.tokenizer(vocabulary("byte_bpe_50k.json"))


def rows():
    return rows_of([*odd_texts(300, 3), *prose(50, 4)], 100) + awkward()


@pytest.mark.parametrize("block", [200, 1 << 25])
def test_word_ids_and_texts_match_the_library(spark, word_model, monkeypatch, block):
    monkeypatch.setattr(word_bpe, "BLOCK_BYTES", block)
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = sorted(tuple(r) for r in word_bpe.digests(docs.filter("doc_id is not null"), vocabulary("word_bpe_49k.json")).collect())
    want = []
    for row in rows():
        if row[0] is not None:
            ids = word_model.encode(row[1] or "", add_special_tokens=False).ids
            text = word_model.decode(ids, skip_special_tokens=False)
            want.append((row[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)


def test_blocks_do_not_depend_on_arrow_batches(spark, word_model, monkeypatch, tmp_path):
    monkeypatch.setattr(word_bpe, "BLOCK_BYTES", 20_000)
    texts = [f"{t} own{i}" for i, t in enumerate(prose(700, 9, words=20))]
    spark.createDataFrame(rows_of(texts), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/docs")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "10000")
    cloudpickle.register_pickle_by_value(word_bpe)  # so that tasks see the small blocks
    try:
        got = {r.doc_id: r.ids_sha256 for r in word_bpe.digests(spark.read.parquet(f"{tmp_path}/docs"), vocabulary("word_bpe_49k.json"), stored=True).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        cloudpickle.unregister_pickle_by_value(word_bpe)
    ids = [word_model.encode(t, add_special_tokens=False).ids for t in texts]
    assert got == {i: hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for i, x in enumerate(ids)}


def test_encode_and_decode_keep_other_columns(spark, word_model):
    path = vocabulary("word_bpe_49k.json")
    docs = spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "'old' as ids", "7 as decoded", "doc_id as block")
    got = word_bpe.decode(word_bpe.encode(docs, path), path)
    assert set(got.columns) == set(docs.columns)
    collected = got.collect()
    assert len(collected) == len(rows())
    for r in collected:
        ids = word_model.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == word_model.decode(ids, skip_special_tokens=False)
    assert word_bpe.digests(docs.limit(0), path).isEmpty()


def test_packed_numbers_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1])
    assert word_bpe.unpack_numbers(word_bpe.pack_numbers(values)).tolist() == values.tolist()
    assert len(word_bpe.unpack_numbers(b"")) == 0


def test_byte_ids_match_the_library(byte_model):
    texts = [*odd_texts(1500, 8), None, "", " \n ", *prose(40, 5)]
    for part in (texts, [t.replace("<|endoftext|>", "") if t else t for t in texts]):
        ids, counts = Encoder(vocabulary("byte_bpe_50k.json")).encode(part)
        for text, row in zip(part, np.split(ids, np.cumsum(counts)[:-1])):
            assert row.tolist() == byte_model.encode(text or "", add_special_tokens=False).ids


def test_byte_ids_of_texts_with_many_special_tokens(byte_model):
    texts = ["a text <|endoftext|> " * 5000, "<|endoftext|>" * 3, None, "plain", "<|endoftext|>x"]
    ids, counts = Encoder(vocabulary("byte_bpe_50k.json")).encode(texts)
    for text, row in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert row.tolist() == byte_model.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 5, 1024, 1025, 4000])
@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 2**31, 2**60, 2**63])
def test_simple8b_round_trip(n, high):
    values = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64, endpoint=True)
    values[: n // 2] %= 3
    words, offsets = simple8b.pack(values)
    assert (simple8b.unpack(words) == values).all()
    for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
        assert (simple8b.unpack(words[a:b]) == values[i * simple8b.BLOCK : (i + 1) * simple8b.BLOCK]).all()


@pytest.mark.parametrize("chunk", [50, 1 << 18])
def test_token_file_holds_every_document(spark, byte_model, monkeypatch, chunk):
    monkeypatch.setattr(simple8b, "CHUNK", chunk)
    docs = spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "1 as start", "2 as shard")
    path = new_table_path(spark, "tokens")
    simple8b.write_tokens(docs, vocabulary("byte_bpe_50k.json"), path)
    whole = sorted((r.start, r.doc_id, r.ids) for r in simple8b.read_tokens(spark, path).collect())
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at = 0
    for (start, doc_id, ids), row in zip(whole, ordered, strict=True):
        want = byte_model.encode(row[1] or "", add_special_tokens=False).ids + [0]
        assert (start, doc_id, ids) == (at, row[0], want)
        at += len(want)
    digests = {(r.start, r.n_tokens, r.ids_crc32) for r in simple8b.read_tokens(spark, path, digest=True).collect()}
    assert digests == {(s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for s, _, i in whole}


def test_empty_token_file(spark):
    path = new_table_path(spark, "tokens")
    simple8b.write_tokens(spark.createDataFrame([], SCHEMA), vocabulary("byte_bpe_50k.json"), path)
    assert simple8b.read_tokens(spark, path).isEmpty()


def thue_morse(n, flip=0):
    """a and b by the parity of the bits of the place: blocks on which sums of powers modulo 2^64 agree."""
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


def test_runs_that_collide_under_polynomial_hashes_get_their_own_ids(byte_model):
    texts = [thue_morse(n, flip) for n in (512, 1_024, 2_048) for flip in (0, 1)]
    ids, counts = Encoder(vocabulary("byte_bpe_50k.json")).encode(texts)
    for text, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert got.tolist() == byte_model.encode(text, add_special_tokens=False).ids


def test_distinct_spans_are_exact(monkeypatch):
    rng = random.Random(4)
    spans = [bytes(rng.choice(b"\x00ab") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40]))) for _ in range(3_000)]
    buffer = b"".join(spans)
    ends = np.cumsum([len(s) for s in spans])
    starts = ends - [len(s) for s in spans]
    for weak in (False, True):
        if weak:  # all keys agree
            monkeypatch.setattr(texts_module, "mix64", lambda x: x.astype(np.uint64) * np.uint64(0))
        numbers, where = texts_module.distinct_spans(buffer, starts, ends)
        assert [spans[where[n]] for n in numbers] == spans and len(where) == len(set(spans))
