"""Time clusters, places, and streams fed in several steps."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from silverprint.operators import events
from silverprint.streaming import ingest, sessions

DAY = datetime(2024, 1, 1)


def photos(spark, rows):
    return spark.createDataFrame(rows, "media_id string, library_id string, taken_at timestamp")


def clusters_by_hand(rows, hours, least):
    by_group = {}
    for i, g, at in rows:
        by_group.setdefault(g, []).append((at, i))
    out = []
    for g, entries in by_group.items():
        entries.sort()
        run = [entries[0]]
        for previous, entry in zip(entries, entries[1:] + [None]):
            if entry is None or entry[0] - previous[0] > timedelta(hours=hours):
                if len(run) >= least:
                    out.append((g, run[0][0], run[-1][0], len(run)))
                run = []
            run.append(entry)
    return sorted(out)


def test_time_clusters_match_the_sorted_scan(spark):
    rng = random.Random(4)
    rows = [(f"m{i}", "hot" if i % 3 else f"g{i % 5}", DAY + timedelta(minutes=rng.randrange(60_000))) for i in range(250)]
    got = events.event_time_clusters(photos(spark, rows)).select("library_id", "start_at", "end_at", "photos")
    assert sorted(map(tuple, got.collect())) == clusters_by_hand(rows, 12, 3)
    members = events.event_members(photos(spark, rows))
    assert members.count() == sum(c[3] for c in clusters_by_hand(rows, 12, 3))


def test_a_gap_of_exactly_twelve_hours_joins(spark):
    def rows(extra):
        return [("a", "g", DAY), ("b", "g", DAY + timedelta(hours=12)), ("c", "g", DAY + timedelta(hours=24, microseconds=extra)), ("d", "g", None)]

    assert events.event_time_clusters(photos(spark, rows(0))).count() == 1
    assert events.event_time_clusters(photos(spark, rows(1))).count() == 0


def test_nearest_city_within_reach_also_across_the_date_line(spark):
    cities = spark.createDataFrame([("A", 0.0, 179.9), ("B", 0.0, 10.0), ("C", 80.0, 0.0), ("D", 0.3, 10.0)], "city string, lat double, lon double")
    points = [("p1", 0.0, -179.9), ("p2", 0.1, 10.0), ("p3", 80.2, 3.0), ("p4", 45.0, 45.0), ("p5", 0.2, 10.0)]
    got = {r["media_id"]: r["city"] for r in events.reverse_geocode(spark.createDataFrame(points, "media_id string, lat double, lon double"), cities).collect()}
    assert got["p1"] == "A" and got["p2"] == "B" and got["p3"] == "C" and got["p4"] is None and got["p5"] in ("B", "D")


def test_wide_events_split_by_city_and_close_ones_merge(spark):
    schema = "media_id string, library_id string, taken_at timestamp, start_at timestamp, lat double, lon double, city string"
    rows = []
    for n, (hours, lat, city, start) in enumerate(
        [(0, 0.0, "X", 0), (1, 0.0, "X", 0), (2, 3.0, "Y", 0), (3, 3.0, "Y", 0), (40, 0.0, "X", 40), (41, 0.0, "X", 40), (42, 0.0, "X", 40)]
    ):
        rows.append((f"m{n}", "l", DAY + timedelta(hours=hours), DAY + timedelta(hours=start), lat, 0.0, city))
    got = events.event_location_refine(spark.createDataFrame(rows, schema)).select("city", "photos", "parts").collect()
    assert sorted(map(tuple, got)) == [("X", 5, 2), ("Y", 2, 1)]


def test_outliers(spark):
    rows = [("a", "e", [1.0, 0.0]), ("b", "e", [1.0, 0.1]), ("c", "e", [1.0, -0.1]), ("d", "e", [-1.0, 0.2])]
    df = spark.createDataFrame(rows, "media_id string, event_id string, embedding array<float>")
    assert {r["media_id"] for r in events.event_outliers(df).filter("not stays").collect()} == {"d"}


def put(spark, folder, name, rows):
    """Add one small file to a watched folder."""
    spark.createDataFrame(rows, "path string, size_bytes long, last_modified timestamp, sha256 string").coalesce(1).write.parquet(
        str(folder / name)
    )


SCHEMA = "path string, size_bytes long, last_modified timestamp, sha256 string"


def watch(spark, folder):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(folder))


def test_ingest_keeps_first_class_and_last_size(spark, tmp_path):
    source, log, checkpoint = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "ck")
    source.mkdir()

    def run():
        ingest.stream_ingest(watch(spark, source), log, checkpoint, availableNow=True).awaitTermination()
        return {r["path"]: r for r in ingest.catalog_view(spark.read.parquet(log)).collect()}

    put(spark, source, "1", [("/l/DCIM/a.jpg", 1, DAY, "x"), ("/l/.git/b.jpg", 1, DAY, "x"), ("/l/c.txt", 1, DAY, "x")])
    assert set(run()) == {"/l/DCIM/a.jpg"}
    put(spark, source, "2", [("/l/DCIM/a.jpg", 7, DAY + timedelta(days=1), "y"), ("/l/d.mp4", 3, DAY, "z")])
    got = run()
    assert set(got) == {"/l/DCIM/a.jpg", "/l/d.mp4"}
    assert (got["/l/DCIM/a.jpg"]["size_bytes"], got["/l/DCIM/a.jpg"]["sha256"], got["/l/DCIM/a.jpg"]["category"]) == (7, "y", "PHOTO")
    assert run().keys() == got.keys()  # nothing new, nothing twice


def test_arriving_copies_update_their_group(spark, tmp_path):
    source, log, checkpoint = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "ck")
    source.mkdir()
    for name, rows in (("1", [("b", 5, DAY, "s"), ("c", 1, DAY, "t")]), ("2", [("a", 5, DAY, "s")])):
        put(spark, source, name, rows)
        stream = ingest.stream_exact_dups(watch(spark, source).withColumnRenamed("path", "media_id"))
        ingest.append_batches(stream, log, checkpoint, "update", availableNow=True).awaitTermination()
    got = ingest.latest_updates(spark.read.parquet(log)).collect()
    assert [(r["sha256"], r["copies"], r["total_bytes"], r["first_id"]) for r in got] == [("s", 2, 10, "a")]


def test_first_of_each_content_within_the_watermark(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put(spark, source, "1", [("a", 1, DAY, "s"), ("b", 1, DAY, "s"), ("c", 1, DAY, "t")])
    stream = ingest.stream_new_content(watch(spark, source), "last_modified", "1 hour")
    ingest.append_batches(stream, str(tmp_path / "log"), str(tmp_path / "ck"), availableNow=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).groupBy("sha256").count().filter("count > 1").count() == 0


def test_progress_counters(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put(spark, source, "1", [("a.jpg", 1, DAY, "s"), ("b.txt", 9, DAY, "s"), ("c.mp4", 4, DAY, "t")])
    listener = ingest.ProgressListener()
    spark.streams.addListener(listener)
    try:
        kind = F.when(F.col("path").endswith(".txt"), "UNKNOWN").otherwise("IMAGE")
        stream = ingest.with_progress(watch(spark, source).withColumn("kind", kind))
        query = ingest.append_batches(stream, str(tmp_path / "log"), str(tmp_path / "ck"), availableNow=True)
        query.awaitTermination()
        for _ in range(50):
            if listener.phase.get(str(query.id)) == "done":
                break
            import time

            time.sleep(0.1)
        assert listener.totals[str(query.id)] == {"scanned": 3, "matched": 2, "bytes": 5}
    finally:
        spark.streams.removeListener(listener)


def test_sessions_close_by_watermark_and_drop_late_photos(spark, tmp_path):
    source, log, checkpoint = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "ck")
    source.mkdir()

    def run(name, hours):
        put(spark, source, name, [(f"{name}{h}", 1, DAY + timedelta(hours=h), "l") for h in hours])
        stream = sessions.stream_sessions(watch(spark, source).select(F.col("sha256").alias("library_id"), F.col("last_modified").alias("taken_at")))
        ingest.append_batches(stream, log, checkpoint, availableNow=True).awaitTermination()
        return sorted((r["start_at"], r["photos"]) for r in spark.read.parquet(log).collect())

    assert run("1", [0, 1, 2, 100]) == [(DAY, 3)]
    assert run("2", [1, 101, 102, 200]) == [(DAY, 3), (DAY + timedelta(hours=100), 3)]
