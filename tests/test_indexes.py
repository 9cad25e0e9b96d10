"""Stored indexes for text and vector search: same results as a scan, fewer files read."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from silverprint.operators import search, text_index, vector_index

WORDS = "the cat sat on a mat while my dog ran after über cats IMG_0042 and 2024 notes".split()


def documents(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS[:8] if rng.random() < 0.8 else WORDS) for _ in range(rng.choice([0, 3, 20, 200]))]
        if i % 97 == 0:
            words += ["needle"] * rng.randint(1, 4)
        rows.append((f"d{i:05}", f"scan_{i % 5}.jpg", " ".join(words) if i % 11 else None, [rng.choice(["trip", "Iron work", ""])] if i % 3 else None))
    return rows


SCHEMA = "media_id string, filename string, ocr string, tags array<string>"


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "terms")
    rows = documents(3_000, 1)
    docs = spark.createDataFrame(rows, SCHEMA)
    for batch, part in enumerate((rows[:1_000], rows[1_000:1_001], rows[1_001:])):
        text_index.add_batch(spark.createDataFrame(part, SCHEMA), path, batch, "media_id", ["filename", "ocr", "tags"], buckets=16, region=64)
    return path, docs


def full_scan(docs, query):
    joined = docs.select("media_id", F.concat_ws(" ", "filename", "ocr", F.array_join("tags", " ")).alias("text"))
    return search.lexical_search(joined, query, "media_id", "text")


@pytest.mark.parametrize("query", ["needle", "The needle", "cat mat dog", "jpg", "IMG_0042 2024", "absent", "absent needle", "ÜBER"])
def test_index_scores_are_those_of_the_scan(spark, indexed, query):
    path, docs = indexed
    want = {r[0]: r[1] for r in full_scan(docs, query).collect()}
    found = text_index.Search(spark, path, query)
    got = {r.id: r.score for r in found.scores().collect()}
    assert got == want
    for top in (1, 10, 60):
        head = sorted(want.items(), key=lambda r: (-r[1], r[0]))[:top]
        assert [(r.id, r.score) for r in found.best(top).collect()] == head


def test_a_query_reads_only_the_buckets_of_its_terms(spark, indexed):
    path, _ = indexed
    found = text_index.Search(spark, path, "needle")
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit("needle")), F.lit(16))).head()[0]
    files = found.scores().inputFiles()
    assert files and all(f"/bucket={bucket}/" in f for f in files)
    assert len(files) < len(spark.read.parquet(f"{path}/postings").inputFiles())
    plan = found.scores()._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(term,needle\)|In\(term, \[needle\]\)", plan)


def test_the_best_rows_need_few_blocks(spark, indexed):
    path, _ = indexed
    found = text_index.Search(spark, path, "the needle")
    kept, every = found.kept_blocks(found.least_score(5)).count(), found.blocks.count()
    assert 0 < kept < every / 2


def test_batches_are_added_not_rewritten_and_only_seen_when_committed(spark, tmp_path):
    path = f"{tmp_path}/terms"
    rows = documents(400, 2)
    add = lambda part, batch: text_index.add_batch(spark.createDataFrame(part, SCHEMA), path, batch, "media_id", ["ocr"], buckets=4)
    add(rows[:200], 0)
    before = set(spark.read.parquet(f"{path}/postings").inputFiles())
    first = text_index.Search(spark, path, "cat").scores().count()
    add(rows[200:], 1)
    assert before < set(spark.read.parquet(f"{path}/postings").inputFiles())
    both = text_index.Search(spark, path, "cat").scores().count()
    assert both > first
    add(rows[200:], 1)  # a replayed batch replaces itself
    assert text_index.Search(spark, path, "cat").scores().count() == both
    spark.read.parquet(f"{path}/postings/batch=1").write.parquet(f"{path}/postings/batch=2")  # not committed
    assert text_index.Search(spark, path, "cat").scores().count() == both


def test_indexes_of_nothing(spark, tmp_path):
    text_index.add_batch(spark.createDataFrame([], SCHEMA), f"{tmp_path}/terms", 0, "media_id", ["ocr"])
    assert text_index.Search(spark, f"{tmp_path}/terms", "cat").best(3).isEmpty()
    with pytest.raises(ValueError):
        text_index.Search(spark, f"{tmp_path}/terms", " - ")
    vector_index.build(spark.createDataFrame([("a", None), ("b", [])], "media_id string, embedding array<float>"), f"{tmp_path}/vectors")
    assert vector_index.VectorIndex(spark, f"{tmp_path}/vectors").search([1.0, 0.0]).isEmpty()


def clustered(n, length, groups, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, length))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = centres[rng.integers(0, groups, n)] + rng.normal(size=(n, length)) * 0.02
    return [(f"v{i:05}", [float(x) for x in row]) for i, row in enumerate(rows)]


@pytest.mark.parametrize("groups", [20, 2_000])
def test_vector_index_gives_the_rows_of_the_scan(spark, tmp_path, groups):
    rows = clustered(2_000, 32, groups, 4)
    rows += [("copy" + str(i), rows[0][1]) for i in range(700)]  # a hot vector
    rows += [("short", rows[1][1][:5]), ("none", None), ("zero", [0.0] * 32)]
    items = spark.createDataFrame(rows, "media_id string, embedding array<double>")
    vector_index.build(items, f"{tmp_path}/vectors", cells=40, sample=500)
    index = vector_index.VectorIndex(spark, f"{tmp_path}/vectors")
    for query in (rows[0][1], rows[7][1], [0.3] * 32, rows[1][1][:5]):
        for top, least in ((60, 0.15), (5, -10.0), (3_000, 0.2)):
            got = [tuple(r) for r in index.search(query, top, least).collect()]
            want = [tuple(r) for r in search.semantic_search(items, query, top, least).collect()]
            assert sorted(r[0] for r in got) == sorted(r[0] for r in want)
            assert np.allclose([r[1] for r in got], [r[1] for r in want], rtol=1e-12, atol=1e-12)


def test_vector_index_reads_few_files_of_clustered_vectors(spark, tmp_path):
    rows = clustered(3_000, 64, 30, 5)
    vector_index.build(spark.createDataFrame(rows, "media_id string, embedding array<float>"), f"{tmp_path}/vectors", cells=32, sample=1_000)
    index = vector_index.VectorIndex(spark, f"{tmp_path}/vectors")
    kept = index.cells_for(rows[0][1], 60, 0.15)
    files, every = index.rows(kept).inputFiles(), spark.read.parquet(f"{tmp_path}/vectors/rows").inputFiles()
    assert len(files) <= len(every) / 5


def _shuffled_rows(spark):
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_indexing_moves_texts_and_blocks_but_no_row_per_term_and_document(spark, tmp_path):
    words = [f"word{i}" for i in range(50)]
    docs = spark.createDataFrame([(f"d{i:05}", " ".join(words)) for i in range(2_000)], "id string, region string")
    before = _shuffled_rows(spark)
    text_index.add_batch(docs, str(tmp_path), 0, "id", ["id", "region"], buckets=4, region=64)
    moved = sum(n for stage, n in _shuffled_rows(spark).items() if stage not in before)
    assert 0 < moved < 2_000 * 50 / 5
    assert text_index.Search(spark, str(tmp_path), "word7").scores().count() == 2_000
