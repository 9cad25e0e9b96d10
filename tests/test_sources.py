"""Listings, digests, pixels, EXIF, merges and sinks."""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from silverprint.functions import models
from silverprint.functions.hashing import hamming, hash_from_hex
from silverprint.functions.imaging import area_resize, dhash_hex, quality
from silverprint.operators import merge, todo
from silverprint.operators.dedup import exact_dup_groups, near_dedup
from silverprint.sources import exif, images, listing, tables, tree
from silverprint.sources.versions import Conflict, VersionedTables
from silverprint.streaming import ingest
from tests.pictures import library, png, scene


@pytest.fixture(scope="module")
def photos(tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    return root, library(root)


def test_scan_finds_the_library_and_its_duplicates(spark, photos):
    root, files = photos
    found = listing.scan_files(spark, str(root)).cache()
    assert {os.path.relpath(r["path"], root) for r in found.collect()} == set(files)
    digests = listing.content_hash(spark, str(root)).collect()
    assert {os.path.relpath(r["path"], root): r["sha256"] for r in digests} == {
        n: hashlib.sha256(d).hexdigest() for n, d in files.items()
    }
    shots = listing.content_hash(spark, str(root), "Screenshot_*.png").collect()
    assert {os.path.basename(r["path"]) for r in shots} == {os.path.basename(n) for n in files if n.startswith("Screenshots")}

    features = images.with_features(images.image_pixels(spark, str(root)))
    catalog = (
        found.join(spark.createDataFrame(digests), "path")
        .join(features.select("path", "width", "height", "dhash_hex", "quality_score"), "path")
        .withColumns({"media_id": F.sha1("path"), "library_id": F.lit("l"), "dhash": hash_from_hex(F.col("dhash_hex"))})
    ).cache()
    assert catalog.count() == 11
    classified = merge.media_upsert(
        catalog.limit(0).withColumns({"category": F.lit(""), "intent": F.lit(""), "category_confidence": F.lit(0.0), "is_hashed": F.lit(False)}),
        found,
        "l",
    )
    assert classified.filter("category = 'SCREENSHOT'").count() == 2

    by_name = {os.path.basename(r["path"]): r["dhash"] for r in catalog.collect()}
    mask = (1 << 64) - 1
    for near in ("photo_1_smaller.png", "photo_1_recompressed.png"):
        assert bin((by_name[near] ^ by_name["photo_1.png"]) & mask).count("1") <= 6
    groups = exact_dup_groups(catalog).collect()
    assert len(groups) == 1 and groups[0]["member_count"] == 3 and groups[0]["recoverable_bytes"] > 0
    assert near_dedup(catalog)[0].count() >= 1
    plan = todo.thumbnail_plan(catalog, spark.createDataFrame([], "sha256 string, variant string"))
    assert plan.groupBy("media_id").count().filter("count <> 2").count() == 0


def test_listing_rules(spark, tmp_path):
    names = [
        "_DSC1.png", ".hidden.png", "~$x.png", "a.JPG", "b.txt", "c.nef", "node_modules/x.png", "sub/.git/y.png", "sub/z.mp4", "app/t.png",
    ]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    os.symlink(tmp_path / "sub", tmp_path / "link")

    def rel(df):
        return {os.path.relpath(r["path"], tmp_path) for r in df.collect()}

    assert rel(listing.scan_files(spark, str(tmp_path), ("app",))) == {"_DSC1.png", "a.JPG", "c.nef", "sub/z.mp4"}
    quick = rel(listing.scan_files(spark, str(tmp_path), ("app",), spark_listing=True))
    assert quick == {"a.JPG", "c.nef", "sub/z.mp4", "link/z.mp4"}
    everything = rel(listing.scan_files_unfiltered(spark, str(tmp_path)))
    assert everything == {n for n in names if n not in ("b.txt", "c.nef")}


def test_trees_are_dealt_to_tasks_and_report_what_they_cannot_read(spark, tmp_path, monkeypatch):
    want = set()
    for a in range(12):
        for b in range(a):
            folder = tmp_path / f"{a:02}" / f"{b} x" / "_deep"
            folder.mkdir(parents=True)
            for c in range(3):
                (folder / f"{c}.jpg").write_bytes(b"abc"[:c])
                want.add((str(folder / f"{c}.jpg"), c))
    for tasks in (1, 3, 64):
        parts = tree._Walk({"path": str(tmp_path), "tasks": str(tasks)}).plan()
        assert len(parts) <= tasks and (tasks < 64 or len(parts) > 8)
        walked = [r for part in parts for batch in tree._Walk({"path": str(tmp_path)}).rows(part) for r in batch.to_pylist()]
        assert len(walked) == len(want) and {(r["path"], r["size_bytes"]) for r in walked} == want
    found = tree.read_tree(spark, str(tmp_path)).collect()
    assert {(r.path, r.size_bytes) for r in found} == want and all(r.error is None for r in found)
    assert tree.read_tree(spark, str(tmp_path), ("_deep",)).isEmpty()
    gone = tree.read_tree(spark, str(tmp_path / "missing")).collect()
    assert [(r.path, r.size_bytes) for r in gone] == [(str(tmp_path / "missing"), None)] and gone[0].error

    scan = os.scandir

    def guarded(path):
        if str(path).endswith("03"):
            raise PermissionError(13, "Permission denied")
        return scan(path)

    monkeypatch.setattr(tree.os, "scandir", guarded)
    walk = tree._Walk({"path": str(tmp_path), "tasks": "4"})
    rows = [r for part in walk.plan() for batch in walk.rows(part) for r in batch.to_pylist()]
    assert [r["path"] for r in rows if r["error"]] == [str(tmp_path / "03")]
    assert {r["path"] for r in rows if not r["error"]} == {p for p, _ in want if "/03/" not in p}


def test_new_and_changed_files_arrive_once_with_their_digests(spark, tmp_path):
    root, log, checkpoint = tmp_path / "lib", str(tmp_path / "log"), str(tmp_path / "ck")
    root.mkdir()

    def run():
        files = ingest.file_stream(spark, str(root), settle_seconds=0)
        ingest.stream_ingest(files, log, checkpoint, availableNow=True).awaitTermination()
        return {os.path.basename(r["path"]): r["sha256"] for r in ingest.catalog_view(spark.read.parquet(log)).collect()}

    digest = lambda data: hashlib.sha256(data).hexdigest()
    (root / "_a.jpg").write_bytes(b"one")
    (root / "notes.txt").write_bytes(b"not media")
    assert run() == {"_a.jpg": digest(b"one")}
    (root / "sub").mkdir()
    (root / "sub" / "b c.mp4").write_bytes(b"two")
    os.utime(root / "sub" / "b c.mp4", (1, 1))  # copied with its old time
    assert run() == {"_a.jpg": digest(b"one"), "b c.mp4": digest(b"two")}
    assert sum(r["n"] for r in spark.read.parquet(log).groupBy("path").agg(F.count(F.lit(1)).alias("n")).collect()) == 2
    (root / "_a.jpg").write_bytes(b"three")
    assert run() == {"_a.jpg": digest(b"three"), "b c.mp4": digest(b"two")}


def test_merges_write_only_the_parts_they_touch(spark, tmp_path):
    catalog = VersionedTables(spark, str(tmp_path / "catalog"))
    rows = spark.range(5_000).select(F.col("id").cast("string").alias("media_id"), F.lit("old").alias("sha256"), F.lit("0").alias("dhash_hex"), F.lit(1).alias("computed_at"))
    assert catalog.create("hash", rows, "pmod(xxhash64(media_id), 40)") == 1
    first = catalog.manifest()
    batch = spark.createDataFrame([("17", "new", "1", 2), ("x", "new", "1", 2)], rows.schema)
    assert catalog.merge("hash", batch, merge.hash_upsert) == 2
    before, after = first["tables"]["hash"]["folders"], catalog.manifest()["tables"]["hash"]["folders"]
    assert 1 <= sum(before.get(p) != f for p, f in after.items()) <= 2
    assert catalog.read("hash").count() == 5_001 and {r.media_id for r in catalog.read("hash").filter("sha256 = 'new'").collect()} == {"17", "x"}
    assert catalog.read("hash", first).count() == 5_000  # who began with the first version still sees it whole
    assert catalog.merge("hash", batch.limit(0), merge.hash_upsert) == 2
    with pytest.raises(ValueError, match="does not touch"):
        catalog.merge("hash", batch, lambda old, new: rows)
    assert catalog.versions() == [1, 2]
    with pytest.raises(Conflict):
        catalog._commit(first, {})
    assert catalog.expire() >= 1 and catalog.read("hash").count() == 5_001


def test_groups_and_members_switch_together(spark, tmp_path):
    catalog = VersionedTables(spark, str(tmp_path / "catalog"))
    table = lambda names, kind: spark.createDataFrame([(n, kind) for n in names], "group_id string, kind string")
    catalog.create("dup_group", table(["e1"], "EXACT").unionByName(table(["n1"], "NEAR")), "kind")
    catalog.create("dup_member", table(["e1", "e1"], "EXACT").unionByName(table(["n1", None], "NEAR")), "kind")
    held = catalog.manifest()
    catalog.replace({"dup_group": table(["e2"], "EXACT"), "dup_member": table(["e2", "e2", "e2"], "EXACT")}, ["EXACT"])
    names = lambda t, m=None: sorted(str(r.group_id) for r in catalog.read(t, m).collect())
    assert (names("dup_group"), names("dup_member")) == (["e2", "n1"], ["None", "e2", "e2", "e2", "n1"])
    assert (names("dup_group", held), names("dup_member", held)) == (["e1", "n1"], ["None", "e1", "e1", "n1"])
    (tmp_path / "catalog" / "manifests" / "v00000004.json").write_text('{"version": 4, "ta')  # a writer that stopped half way
    assert names("dup_group") == ["e2", "n1"]


def test_listing_reads_no_content(spark, photos):
    plan = listing.list_files(spark, str(photos[0]))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_features_of_known_pictures(spark, tmp_path):
    rgb = scene(3, 96, 64)
    (tmp_path / "a.png").write_bytes(png(rgb))
    (tmp_path / "flat.png").write_bytes(png(np.full((20, 30, 3), 200)))
    (tmp_path / "bad.png").write_bytes(b"not a picture")
    rows = {os.path.basename(r["path"]): r for r in images.with_features(images.image_pixels(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a.png", "flat.png"}
    blur, bright, spread, exposure = quality(rgb)
    assert rows["a.png"]["dhash_hex"] == dhash_hex(rgb) and rows["a.png"]["quality_score"] == pytest.approx(blur)
    assert rows["a.png"]["brightness"] == pytest.approx(bright) and rows["a.png"]["color_variance"] == pytest.approx(spread)
    assert rows["flat.png"]["dhash_hex"] == "0" * 16 and rows["flat.png"]["color_variance"] == 0
    assert rows["flat.png"]["brightness"] == pytest.approx(200 / 255) and rows["flat.png"]["exposure"] == 1.0
    assert images.image_pixels(spark, str(tmp_path), max_bytes=100).count() <= 1


def test_area_resize_is_the_mean_of_the_covered_area():
    pixels = np.arange(36).reshape(6, 6, 1)
    assert area_resize(pixels, 1, 1)[0, 0, 0] == 18  # 17.5 rounds up
    assert (area_resize(pixels, 6, 6)[:, :, 0] == pixels[:, :, 0]).all()
    assert (area_resize(pixels, 12, 12)[::2, ::2, 0] == pixels[:, :, 0]).all()
    wide = area_resize(np.array([[[0], [90]]]), 1, 3)[0, :, 0]
    assert wide.tolist() == [0, 45, 90]
    left_dark = np.tile(np.linspace(0, 255, 90)[None, :, None], (40, 1, 3)).astype(np.uint8)
    assert dhash_hex(left_dark) == "f" * 16


def test_exif_columns_and_bad_values(spark):
    rows = [
        ("a", '{"Make":"M","ISO":200,"FNumber":1.8,"GPSLatitude":-1.5,"ImageWidth":10,"DateTimeOriginal":"2024:05:11 10:20:30"}'),
        ("b", '{"DateTimeOriginal":"0000:00:00"}'),
        ("c", "not json"),
    ]
    got = {r["media_id"]: r for r in exif.exif_normalize(spark.createDataFrame(rows, "media_id string, raw_json string")).collect()}
    assert (got["a"]["make"], got["a"]["iso"], got["a"]["f_number"], got["a"]["gps_lat"], got["a"]["width"]) == ("M", 200, 1.8, -1.5, 10)
    assert str(got["a"]["taken_at"]) == "2024-05-11 10:20:30"
    assert got["b"]["taken_at"] is None and got["c"]["make"] is None


def test_upsert_updates_listed_columns_only_and_patch_writes_nulls(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, name string, size int")
    new = spark.createDataFrame([(2, "changed", None), (3, "c", 30)], "id int, name string, size int")
    merged = sorted(map(tuple, merge.upsert(old, new, ["id"], ["size"]).collect()))
    assert merged == [(1, "a", 10), (2, "b", None), (3, "c", 30)]
    patched = merge.patch(old, spark.createDataFrame([(2, None), (9, 1)], "id int, size int"), ["id"])
    assert sorted(map(tuple, patched.collect())) == [(1, "a", 10), (2, "b", None)]
    assert sorted(map(tuple, merge.replace_rows(old, new, ["id"]).collect())) == [(1, "a", 10), (2, "changed", None), (3, "c", 30)]


def test_changed_files_are_hashed_again_unless_asked_not_to(spark):
    media = spark.createDataFrame(
        [("m1", "l", "/l/a.jpg", "a.jpg", ".jpg", "IMAGE", 1, "PHOTO", "KEEP_LONG_TERM", 0.9, True)],
        "media_id string, library_id string, path string, filename string, ext string, kind string, size_bytes long,"
        " category string, intent string, category_confidence double, is_hashed boolean",
    ).withColumn("last_modified", F.lit("2024-01-01").cast("timestamp"))
    seen = media.select("path", "library_id", "filename", F.lit(2).cast("long").alias("size_bytes"), "last_modified")
    row = merge.media_upsert(media, seen).head()
    assert (row["size_bytes"], row["category"], row["is_hashed"]) == (2, "PHOTO", False)
    assert merge.media_upsert(media, seen, rehash_on_change=False).head()["is_hashed"] is True
    assert merge.media_upsert(media, seen.union(seen)).count() == 1
    hashes = media.select("media_id")
    assert todo.hash_todo(media, hashes).count() == 0 and todo.hash_todo(merge.media_upsert(media, seen), hashes).count() == 1


def test_merges_take_one_row_a_key(spark):
    schema = "media_id string, sha256 string, dhash_hex string, computed_at int"
    old = spark.createDataFrame([("a", "x", "0", 1)], schema)
    new = spark.createDataFrame([("a", "y", "1", 2), ("a", "z", "2", 3), ("b", "q", "3", 1), ("b", "q", "3", 1)], schema)
    assert {tuple(r) for r in merge.hash_upsert(old, new).collect()} == {("a", "z", "2", 1), ("b", "q", "3", 1)}
    assert merge.replace_rows(old, new, ["media_id"]).count() == 2 and merge.patch(old, new, ["media_id"]).count() == 1
    assert merge.insert_only(old, new, ["media_id"]).count() == 2


def test_dup_sink_replaces_one_kind_only(spark, tmp_path):
    def groups(kind, ids):
        return spark.createDataFrame([(i, kind) for i in ids], "group_id string, kind string")

    path = str(tmp_path / "dup_group")
    tables.dup_rebuild_sink(groups("EXACT", ["e1", "e2"]).unionByName(groups("NEAR", ["n1"])), path, ("EXACT", "NEAR"))
    tables.dup_rebuild_sink(groups("EXACT", ["e3"]), path, ("EXACT",))
    assert {r["group_id"] for r in spark.read.parquet(f"{path}/groups").collect()} == {"e3", "n1"}
    tables.dup_rebuild_sink(groups("EXACT", []), path, ("EXACT",), groups("EXACT", []))
    assert {r["group_id"] for r in spark.read.parquet(f"{path}/groups").collect()} == {"n1"}
    first = tables.write_version(groups("NEAR", ["n1"]), str(tmp_path / "t"), 1)
    assert first.endswith("/v00000001") and spark.read.parquet(first).count() == 1


def test_model_wrappers_load_once_per_worker_and_pass_nulls(spark):
    def loader():
        return lambda text: [float(len(text)), 0.0]

    df = spark.createDataFrame([("ab",), (None,)], "t string")
    got = [r["v"] for r in df.select(models.encode(loader)("t").alias("v")).collect()]
    assert sorted(got, key=str) == [None, [1.0, 0.0]] or got == [[1.0, 0.0], None]


def test_hamming_of_signed_values(spark):
    df = spark.createDataFrame([(-1, 0), (5, 4)], "a long, b long")
    assert [r[0] for r in df.select(hamming(F.col("a"), F.col("b"))).collect()] == [64, 1]


def test_one_record_of_an_item_wins_in_the_catalog_and_in_the_exif_table(spark):
    media = spark.createDataFrame([("m1", 1, 1, None), ("m2", 5, 5, None)], "media_id string, width int, height int, taken_at string")
    old = spark.createDataFrame([("m1", "old", None)], "media_id string, make string, computed_at long")
    read = spark.createDataFrame(
        [("m1", 4000, 3000, "first", "A", 1), ("m1", 100, 100, "second", "B", 2)],
        "media_id string, width int, height int, taken_at string, make string, computed_at long",
    )
    items, rows = merge.exif_replace(media, old, read)
    assert sorted(map(tuple, items.collect())) == [("m1", 100, 100, "second"), ("m2", 5, 5, None)]
    assert [tuple(r) for r in rows.collect()] == [("m1", "B", 2)]
