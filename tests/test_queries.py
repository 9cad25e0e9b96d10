"""Every registered query against its SQL on the smallest data, and the shape of its plan."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from silverprint.parity import QUERIES
from tests.parity_check import compare, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, text = compare(spark, con, name, SF_DIR)
    assert ok, text


# Queries whose plan is built without running anything first.
LAZY = [
    "exact_dup_groups",
    "exact_dup_members",
    "thumbnail_plan",
    "media_upsert",
    "event_time_clusters",
    "event_members",
    "reverse_geocode",
    "token_index",
    "semantic_search",
    "lexical_search",
    "plan_left_join",
    "quality_flags",
    "zero_shot_classify",
    "scan_summary",
]


@pytest.mark.parametrize("name", LAZY)
def test_plan_has_no_cross_join_and_no_single_task_window(spark, name):
    df = entry.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"Window [^\n]*\n[^\n]*Sort [^\n]*\n[^\n]*Exchange SinglePartition", plan)


def test_window_join_is_an_equi_join_on_buckets(spark):
    from silverprint.operators.hamming_pairs import near_window_pairs

    ranked = spark.range(10).selectExpr("id as rank", "cast(id as string) as media_id", "'s' as sha256", "id as dhash")
    plan = near_window_pairs(ranked)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_columns_and_filters_reach_the_scan(spark, tmp_path):
    from silverprint.operators import views
    from silverprint.parity.tables import Tables

    path = str(tmp_path / "media")
    Tables(spark, SF_DIR).media.write.parquet(path)
    plan = views.large_videos(spark.read.parquet(path)).select("media_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(size_bytes,524288000)" in plan and "EqualTo(kind,VIDEO)" in plan
    schema = plan.split("ReadSchema: ")[1]
    assert "embedding" not in schema and "path" not in schema


def test_entry_runs(spark):
    assert entry.entry(spark).columns == [
        "group_id",
        "kind",
        "member_count",
        "total_bytes",
        "best_media_id",
        "recoverable_bytes",
    ]
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", ["stream_exact_dups", "stream_ingest", "stream_progress", "stream_sessions"])
def test_streams_read_tables_that_are_folders(spark, con, tmp_path, name):
    for table in ("documents", "events"):
        spark.read.parquet(f"{SF_DIR}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    ok, text = compare(spark, con, name, str(tmp_path))
    assert ok, text
