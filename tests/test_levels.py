"""Folded logs of stream batches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from silverprint.streaming import ingest
from silverprint.streaming.levels import LevelledLog, fold_catalog, fold_digests, stream_digests

ONE = "sha256 string, copies long, total_bytes long, first_id string"
FILES = "path string, kind string, size_bytes long, last_modified timestamp, batch long"


def batch(spark, rng, n=40):
    return spark.createDataFrame([(f"d{rng.randrange(30)}", 1, rng.randrange(9), f"m{rng.randrange(999):03d}") for _ in range(n)], ONE)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_the_view_stays_the_same_and_folders_stay_few(spark, tmp_path):
    rng = random.Random(1)
    log = LevelledLog(spark, str(tmp_path / "log"), fold_digests, fan=2)
    assert log.view() is None and log.current() == []
    seen = None
    for i in range(9):
        rows = batch(spark, rng)
        seen = rows if seen is None else seen.union(rows)
        log.append(rows, i)
        assert rows_of(log.view()) == rows_of(fold_digests(seen))
    assert log.current() == [(0, 7), (8, 8)]
    assert len(log.complete()) < 9  # covered folders go with a later fold
    assert log.read().count() <= 60  # one row a digest in each of two folders


def test_a_replayed_batch_counts_once(spark, tmp_path):
    rng = random.Random(2)
    batches = [batch(spark, rng) for _ in range(3)]
    log = LevelledLog(spark, str(tmp_path / "log"), fold_digests, fan=2)
    for i, rows in enumerate(batches):
        log.append(rows, i)
    want = rows_of(log.view())
    log.append(batches[2], 2)  # its own folder is written again
    log.append(batches[0], 0)  # a wider folder holds it
    assert rows_of(log.view()) == want and log.current() == [(0, 1), (2, 2)]


def test_an_unfinished_folder_is_passed_over(spark, tmp_path):
    rng = random.Random(3)
    log = LevelledLog(spark, str(tmp_path / "log"), fold_digests, fan=2)
    first, second = batch(spark, rng), batch(spark, rng)
    log.append(first, 0)
    # a fold that was cut off: rows without the mark at the end
    first.write.parquet(f"{tmp_path}/log/batches-0-1")
    (tmp_path / "log" / "batches-0-1" / "_SUCCESS").unlink()
    assert log.current() == [(0, 0)]
    log.append(second, 1)
    assert log.current() == [(0, 1)] and rows_of(log.view()) == rows_of(fold_digests(first.union(second)))
    with pytest.raises(ValueError):
        LevelledLog(spark, "x", fold_digests, fan=1)


def test_catalog_view_is_equal_before_and_after_folding(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"p{rng.randrange(12)}", f"k{i}", rng.choice([None, i]), None, i // 10) for i in range(80)]
    # one path changes twice in one batch, one row is there twice
    rows += [("p1", "a", 5, None, 3), ("p1", "b", 4, None, 3), ("p1", "b", 4, None, 3)]
    whole = spark.createDataFrame(rows, FILES)
    want = rows_of(ingest.catalog_view(whole))
    assert rows_of(ingest.catalog_view(fold_catalog(whole))) == want
    log = LevelledLog(spark, str(tmp_path / "log"), fold_catalog, fan=3)
    for i in range(8):
        log.append(whole.filter(F.col("batch") == i), i)
    assert log.current() == [(0, 2), (3, 5), (6, 6), (7, 7)]
    assert rows_of(ingest.catalog_view(log.read())) == want
    assert log.read().groupBy("path", "batch").count().agg(F.max("count")).head()[0] <= 2


def test_a_stream_keeps_no_state(spark, tmp_path):
    items = spark.createDataFrame([(f"d{i % 7}" if i % 5 else None, i, f"m{i:02d}") for i in range(60)], "sha256 string, size_bytes int, media_id string")
    items.repartition(5).write.parquet(str(tmp_path / "items"))
    source = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "items"))
    log = LevelledLog(spark, str(tmp_path / "log"), fold_digests, fan=2)
    query = stream_digests(source, log, str(tmp_path / "checkpoint"), availableNow=True)
    query.awaitTermination()
    assert not (tmp_path / "checkpoint" / "state").exists()
    assert len(query.recentProgress) >= 5 and log.current() == [(0, 3), (4, 4)]
    want = items.filter("sha256 IS NOT NULL").groupBy("sha256").agg(F.count("*"), F.sum("size_bytes"), F.min("media_id"))
    assert rows_of(log.view()) == rows_of(want)
