"""Trash, rename, undo, staging, cleanup and suggestions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from silverprint.operators import cleanup, staging
from silverprint.plans import naming, operations

NOW = "2024-06-01"
ITEMS = "media_id string, path string, filename string, size_bytes long, is_hidden boolean"


def at(day):
    return F.lit(day).cast("timestamp")


def catalog(spark, n=6):
    return spark.createDataFrame([(f"m{i}", f"/lib/{i}.jpg", f"{i}.jpg", 100 + i, False) for i in range(n)], ITEMS)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "media_id string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_trash_then_undo_gives_the_catalog_back(spark):
    items = catalog(spark)
    hashes = spark.createDataFrame([("m1", "aa")], "media_id string, sha256 string")
    listing = items.filter("media_id <> 'm4'").select("path")
    plan = operations.plan_trash(ids(spark, "m1", "m2", "m4", "x1", "x2"), items, hashes, listing, "op_1", "/home/trash", "why")
    ops = {r["media_id"]: r for r in plan.ops.collect()}
    assert set(ops) == {"m1", "m2"} and ops["m1"]["sha256"] == "aa" and ops["m2"]["sha256"] is None
    assert ops["m1"]["to"].startswith("/home/trash/op_1/") and ops["m1"]["to"].endswith("/1.jpg")
    warnings = {r["warning"] for r in plan.warnings.collect()}
    assert warnings == {"2 requested item(s) no longer exist in the DB", "Source no longer on disk: /lib/4.jpg"}
    assert operations.plan_summary(plan).head()["summary"] == "Move 2 file(s) to Trash · 203 B"
    assert operations.op_safety_check(plan.ops, "/home").count() == 0

    trashed, entries = operations.apply_trash(items, plan.ops, "op_1", at(NOW), "/home")
    assert {r["media_id"] for r in trashed.filter("is_hidden").collect()} == {"m1", "m2"}
    assert entries.filter("expires_at = timestamp'2024-07-01'").count() == 2
    assert operations.trash_expired(entries, at("2024-06-30")).count() == 0
    assert operations.trash_expired(entries, at("2024-07-01")).count() == 2

    operation = operations.manifest_json(plan.ops).select(
        F.lit("op_1").alias("id"), F.lit("COMPLETED").alias("status"), F.col("entry").alias("manifest")
    )
    manifest = operations.manifest_parse(operation).drop("operation_id")
    in_trash = plan.ops.select(F.col("to").alias("path"))
    undone = operations.apply_undo(operation, manifest, trashed, entries, in_trash, at("2024-06-02"), "TRASH")
    assert rows(undone.items) == rows(items)
    assert undone.entries.filter("restored_at is null").count() == 0
    assert tuple(operations.undo_summary(undone.outcome).head()) == (2, 0)

    blocked = in_trash.filter("path like '%/1.jpg'").unionByName(spark.createDataFrame([("/lib/1.jpg",)], "path string"))
    partly = operations.apply_undo(operation, manifest, trashed, entries, blocked, at("2024-06-02"), "TRASH")
    assert {r["media_id"]: r["outcome"] for r in partly.outcome.collect()} == {"m1": "occupied", "m2": "gone"}
    assert partly.items.filter("is_hidden").count() == 2


def test_refused_requests(spark):
    items = catalog(spark)
    nothing = ids(spark)
    hashes = spark.createDataFrame([], "media_id string, sha256 string")
    with pytest.raises(operations.PlanError):
        operations.plan_trash(nothing, items, hashes, items.select("path"), "op", "/t", "r")
    with pytest.raises(operations.PlanError):
        operations.plan_rename(nothing.withColumn("new_name", F.lit("x")), items, hashes, items.select("path"))
    schema = "id string, status string, manifest string"
    for bad in ([], [("op", "UNDONE", "[]")], [("op", "COMPLETED", None)]):
        with pytest.raises(operations.PlanError):
            operations.apply_undo(spark.createDataFrame(bad, schema), None, items, None, None, at(NOW), "TRASH")


def test_manifest_of_the_array_form(spark):
    text = '[{"mediaId":"m1","from":"/a","to":"/b","sha256":null,"sizeBytes":"9007199254740993"}]'
    got = operations.manifest_parse(spark.createDataFrame([("op", text)], "id string, manifest string")).head()
    assert got["size_bytes"] == 9007199254740993 and got["sha256"] is None


def test_safety_check_names_the_problem(spark):
    ops = spark.createDataFrame(
        [("a", "/lib/../x", "/home/t/x"), ("b", "/home/x", "/home/t/x"), ("c", "/lib/x", "/homes/x"), ("d", "/lib/y", "/home/t/y")],
        "media_id string, `from` string, `to` string",
    )
    assert {r["media_id"] for r in operations.op_safety_check(ops, "/home").collect()} == {"a", "b", "c"}
    assert {r["media_id"] for r in operations.op_safety_check(ops, "/home", "RENAME").collect()} == {"a", "b"}


def free_names(wanted, taken):
    """One request after the other, each taking the first name nobody has or asks for."""
    asked = {t for _, t in wanted}
    used, out = set(taken), {}
    for target in sorted(asked):
        mine = sorted(i for i, t in wanted if t == target)
        stem, dot, ext = target.rpartition(".")
        if target not in taken:
            out[mine.pop(0)] = target
        n = 1
        for i in mine:
            while f"{stem} ({n}).{ext}" in used or f"{stem} ({n}).{ext}" in asked:
                n += 1
            out[i] = f"{stem} ({n}).{ext}"
            n += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_renames_are_unique_and_take_the_first_free_number(spark, seed):
    rng = random.Random(seed)
    names = ["/l/a.jpg", "/l/a (1).jpg", "/l/a (3).jpg", "/l/b.jpg", "/l/b (2).jpg"]
    wanted = [(f"m{i:03d}", rng.choice(names[: 2 + 2 * seed])) for i in range(30)]
    taken = [n for n in names + ["/l/a (2).jpg", "/l/a (7).jpg", "/l/a (1) (1).jpg", "/l/b (1).png"] if rng.random() < 0.5]
    df = spark.createDataFrame(wanted, "media_id string, target string")
    on_disk = spark.createDataFrame([(p,) for p in taken], "path string")
    got = {r["media_id"]: r["final"] for r in naming.unique_targets(df, on_disk).collect()}
    assert got == free_names(wanted, taken)
    assert len(set(got.values())) == 30 and not set(got.values()) & set(taken)


def test_rename_plan_stays_in_the_folder_and_reports(spark):
    items = catalog(spark, 3)
    hashes = spark.createDataFrame([], "media_id string, sha256 string")
    asks = spark.createDataFrame([("m0", "n.jpg"), ("m1", "n.jpg"), ("x", "n.jpg")], "media_id string, new_name string")
    plan = operations.plan_rename(asks, items, hashes, items.select("path"))
    assert {r["media_id"]: r["to"] for r in plan.ops.collect()} == {"m0": "/lib/n.jpg", "m1": "/lib/n (1).jpg"}
    assert {r["warning"] for r in plan.warnings.collect()} == {"Unknown media: x", "Collision: /lib/n.jpg → /lib/n (1).jpg"}
    moved = operations.apply_rename(items, plan.ops, "/home")
    assert {r["filename"] for r in moved.collect()} == {"n.jpg", "n (1).jpg", "2.jpg"}
    assert operations.plan_rename(asks.union(asks), items, hashes, items.select("path")).ops.count() == 2
    twice = asks.union(spark.createDataFrame([("m0", "other.jpg")], asks.schema))
    with pytest.raises(operations.PlanError):
        operations.plan_rename(twice, items, hashes, items.select("path"))
    with pytest.raises(operations.PlanError):
        operations.apply_rename(items, plan.ops.withColumn("from", F.lit("/lib/../etc")), "/home")


def test_status_of_operations(spark):
    results = spark.createDataFrame([("a", True), ("b", False), ("c", True), ("c", False)], "operation_id string, ok boolean")
    assert {r["operation_id"]: r["status"] for r in operations.op_status(results).collect()} == {"a": "COMPLETED", "b": "FAILED", "c": "PARTIAL"}


def test_verify_copy(spark):
    schema = "relative_path string, size_bytes long, sha256 string"
    source = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z"), ("d", 4, None)], schema)
    copy = spark.createDataFrame([("a", 1, "x"), ("b", 9, "y"), ("d", 4, "q")], schema)
    assert {r["relative_path"]: r["problem"] for r in operations.verify_copy(source, copy).collect()} == {"b": "size differs", "c": "missing"}
    assert operations.verify_copy(source, copy, with_hash=True).filter("problem = 'content differs'").count() == 1


def test_trash_bucket_views(spark):
    entries = spark.createDataFrame(
        [("2024-01", "b/x.jpg", "x.jpg", 1), ("2024-02", "a.mp4", "a.mp4", 2), ("2024-02", "b.PNG", "b.PNG", 4)],
        "bucket string, relative_path string, filename string, size_bytes long",
    )
    assert [r["id"] for r in operations.trash_browse_order(entries).collect()] == ["2024-02::a.mp4", "2024-02::b.PNG", "2024-01::b/x.jpg"]
    assert {r["filename"] for r in operations.trash_preview_todo(entries).collect()} == {"b.PNG", "x.jpg"}
    assert {(r["bucket"], r["bytes"]) for r in operations.trash_buckets(entries).collect()} == {("2024-01", 1), ("2024-02", 6), (None, 7)}


def test_smart_album_sees_allowed_columns_only(spark):
    items = catalog(spark).withColumn("secret", F.lit(1))
    assert operations.smart_album(items, "size_bytes >= 104").count() == 2
    assert operations.smart_album(items, "filename in ('4.jpg', '5.jpg', 'secret = 1') and not size_bytes between 0 and 103").count() == 2
    for query in ("java_method('java.lang.System', 'exit') = 1", "size_bytes >= abs(3)", "filename = `filename`", "filename(1) = 1", "true -- x"):
        with pytest.raises(operations.PlanError):
            operations.smart_album(items, query)
    with pytest.raises(Exception):
        operations.smart_album(items, "secret = 1").count()


def test_staging_algebra(spark):
    a, b = ids(spark, "1", "2", "3"), ids(spark, "3", "4")
    assert rows(staging.unstage(staging.stage(a, b), b)) == [("1",), ("2",)]
    once = staging.invert_staging(a, b)
    assert rows(once) == [("1",), ("2",), ("4",)] and rows(staging.invert_staging(once, b)) == rows(a)
    assert staging.clear_staging(a).count() == 0
    entries = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y")], "id string, bucket string")
    picked = spark.createDataFrame([("1",), ("3",)], "id string")
    whole = staging.bucket_select(entries, picked, "x")
    assert rows(whole) == [("1",), ("2",), ("3",)]
    assert rows(staging.bucket_select(entries, whole, "x")) == [("3",)]
    assert rows(staging.bucket_select(entries, picked)) == [("1",), ("2",), ("3",)]


def test_suggestion_rules(spark):
    schema = (
        "media_id string, kind string, category string, size_bytes long, width int, height int,"
        " quality_score double, brightness double, color_variance double"
    )
    data = [("a", "IMAGE", "SCREENSHOT", 10, 100, 100, None, None, None), ("b", "IMAGE", "OTHER", 20, 100, 100, None, None, None)]
    items = spark.createDataFrame(data, schema)
    group = "group_id string, kind string, member_count long, total_bytes long, best_media_id string, recoverable_bytes long"
    member = "group_id string, media_id string, score double, reason string"
    groups = spark.createDataFrame([("g", "EXACT", 2, 30, "b", 10)], group)
    exact = spark.createDataFrame([("g", "b", 1.0, "best candidate"), ("g", "a", 1.0, "duplicate of best")], member)
    none = spark.createDataFrame([], member)
    got = cleanup.suggestions(cleanup.suggestion_members(items, exact, none), groups, groups.limit(0), with_items=True).collect()
    assert [(r["id"], r["title"], r["item_ids"]) for r in got] == [
        ("dups-exact", "Remove 1 exact-duplicate copy", ["a"]),
        ("screenshots", "1 screenshot detected", ["a"]),
    ]
    assert got[0]["body"] == "1 duplicate group found by SHA-256 · recover 10 B"
    buckets = {r["id"]: (r["count"], r["size"]) for r in cleanup.cleanup_buckets(items, groups, groups.limit(0)).collect()}
    assert buckets["dups"] == (2, 10) and buckets["burst"] == (0, 0) and buckets["shots"] == (1, 10)
    assert cleanup.cleanup_summary(items, groups, groups.limit(0)).head()["reclaim"] == 10
