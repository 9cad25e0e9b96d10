"""Keyed joins, global ranks, quantiles and components."""

from __future__ import annotations

import math
import random
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from silverprint.operators.components import connected_components, star_links, thin_edges
from silverprint.operators.keyed import attach_facts
from silverprint.operators.ranking import QuantileRule, global_rank, quantile_items, rank_within
from silverprint.workspace import materialise, release, scratch_root


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("hot_rows", [1, 50, 10**6])
def test_attach_facts_same_result_for_any_hot_bound(spark, hot_rows):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(300)], "id long, key string")
    facts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).filter("key <> 'k0'")
    got = attach_facts(rows, facts, ["key"], F.col("n"), "id", hot_rows)
    want = rows.join(facts, "key").select("id", "key", "n", "top")
    assert sorted(map(tuple, got.select("id", "key", "n", "top").collect())) == sorted(map(tuple, want.collect()))
    left = attach_facts(rows, facts, ["key"], F.col("n"), "id", hot_rows, keep_unmatched=True)
    assert left.count() == 300
    assert left.filter("n is null").select("key").distinct().collect() == [("k0",)]


def test_global_rank_and_totals_with_one_value_holding_half_of_the_rows(spark):
    rows = [(i, 5 if i % 2 else i % 11, i % 4) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, v long, w long")
    got = {r["id"]: (r["rank"], r["seen"]) for r in global_rank(df, [F.col("v"), F.col("id")], totals={"seen": "w"}, partitions=6).collect()}
    seen = 0
    for n, (i, _, w) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1):
        seen += w
        assert got[i] == (n, seen)


def test_rank_within_groups(spark):
    df = spark.createDataFrame([(i, "a" if i < 80 else "b") for i in range(100)], "id long, g string")
    got = {(r["g"], r["id"]): r["rank"] for r in rank_within(df, ["g"], [F.col("id").desc()]).collect()}
    assert got[("a", 79)] == 1 and got[("a", 0)] == 80 and got[("b", 99)] == 1 and got[("b", 80)] == 20


def brute_quantile(values, q, side):
    usable = [(v, i) for i, v in enumerate(values) if v is not None and math.isfinite(v)]
    usable.sort(key=lambda p: ((p[0] if side == "low" else -p[0]), p[1]))
    return {i for _, i in usable[: min(len(usable), max(3, math.ceil(len(usable) * q)))]}


def test_quantile_items_skip_missing_values_and_take_at_least_three(spark):
    values = [None, math.nan, math.inf, -math.inf, 3.0, 1.0, 1.0, 2.0, 9.0]
    df = spark.createDataFrame(list(enumerate(values)), "media_id long, v double")
    rules = [QuantileRule("low", "v", 0.05), QuantileRule("high", "v", 0.5, "high")]
    got = quantile_items(df, rules).collect()
    for rule in rules:
        assert {r["media_id"] for r in got if r["rule"] == rule.name} == brute_quantile(values, rule.q, rule.side)
    few = spark.createDataFrame([(1, 5.0), (2, 4.0)], "media_id long, v double")
    assert quantile_items(few, rules[:1]).count() == 2
    none = spark.createDataFrame([(1, None)], "media_id long, v double")
    assert quantile_items(none, rules[:1]).count() == 0


def test_quantile_prefilter_keeps_the_exact_answer(spark):
    rng = random.Random(1)
    values = [0.25 if rng.random() < 0.4 else rng.random() for _ in range(12_000)]
    df = spark.createDataFrame(list(enumerate(values)), "media_id long, v double")
    rules = [QuantileRule("low", "v", 0.05), QuantileRule("half", "v", 0.3), QuantileRule("high", "v", 0.02, "high")]
    got = quantile_items(df, rules, accuracy=100).collect()
    for rule in rules:
        assert {r["media_id"] for r in got if r["rule"] == rule.name} == brute_quantile(values, rule.q, rule.side)


@pytest.mark.parametrize("hot_rows, one_task", [(3, 0), (10**6, 0), (None, 1000)])
@pytest.mark.parametrize("shape", ["random", "chain", "hub", "empty"])
def test_components_match_union_find(spark, shape, hot_rows, one_task):
    rng = random.Random(7)
    edges = {
        "random": [(rng.randrange(120), rng.randrange(120)) for _ in range(90)],
        "chain": [(i, i + 1) for i in range(150)],
        "hub": [(99, i) for i in range(80)] + [(200, 201)],
        "empty": [],
    }[shape]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"), hot_rows=hot_rows, one_task=one_task)
    want = {k: v for k, v in union_find([e for e in edges if e[0] != e[1]]).items()}
    assert {r["node"]: r["component"] for r in got.collect()} == want


def test_star_links_and_thin_edges_keep_components(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 60, 100), rng.integers(0, 60, 100)
    hi, lo = star_links(a, b)
    assert union_find(zip(a.tolist(), b.tolist())) == {**{x: x for x in set(a.tolist()) | set(b.tolist())}, **union_find(zip(hi.tolist(), lo.tolist()))}
    pairs = spark.createDataFrame([(i // 50, int(x), int(y)) for i, (x, y) in enumerate(zip(a, b))], "g long, a long, b long")
    thin = [tuple(r) for r in thin_edges(pairs, "a", "b").collect()]
    both = union_find(zip(a.tolist(), b.tolist()))
    assert {k: v for k, v in both.items() if k in union_find(thin)} == union_find(thin)
    assert len(thin) <= 100


def fake_session(configured, master="spark://host:7077"):
    context = SimpleNamespace(master=master, applicationId="app-1", getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: configured), sparkContext=context)


def test_scratch_folder_comes_from_the_cluster_and_is_local_only_in_tests():
    assert scratch_root(fake_session("hdfs://shared/ck/")) == "hdfs://shared/ck"
    with pytest.raises(RuntimeError):
        scratch_root(fake_session(None))
    assert scratch_root(fake_session(None, "local[2]")).startswith("/")


def test_scratch_tables_are_written_and_released(spark):
    table = materialise(spark.range(5).toDF("x"))
    assert table.count() == 5 and list(Path(table._scratch_path).rglob("*.parquet"))
    release(table)
    assert not Path(table._scratch_path).exists()


def test_attach_facts_spreads_hot_null_and_served_rows(spark):
    n = 40_000
    key = F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 4 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 500))
    rows = spark.range(n).withColumn("key", key.cast("string"))
    facts = rows.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = attach_facts(rows, facts, ["key"], F.col("n"), "id", keep_unmatched=True)
        parts = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(parts) == n and max(parts) < 2 * n / len(parts) and len(parts) == 8
    assert "hashpartitioning(key" in plan and "_spread" in plan.split("hashpartitioning(key")[1][:40]
    assert joined.filter("key = 'hot' and n = 20000").count() == n // 2
