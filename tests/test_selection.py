"""Exact fractions found by counts, against sorting."""

from __future__ import annotations

import math
import random

import pytest

from silverprint.operators import selection
from silverprint.operators.ranking import QuantileRule, quantile_items
from silverprint.operators.selection import quantile_members

RULES = [QuantileRule("low", "v", 0.05), QuantileRule("half", "v", 0.3), QuantileRule("high", "v", 0.02, "high"), QuantileRule("all", "v", 1.0)]


def brute(rows, rule):
    usable = [(v if rule.side == "low" else -v, i) for i, v in rows if v is not None and math.isfinite(v)]
    return [i for _, i in sorted(usable)[: min(len(usable), max(3, math.ceil(len(usable) * rule.q)))]]


def members(df, rules, **more):
    got = {rule.name: [] for rule in rules}
    for r in quantile_members(df, rules, **more).collect():
        got[r["rule"]].append(r["media_id"])
    return got


VALUES = {
    "spread": lambda rng: rng.lognormvariate(0, 5),
    "a third equal": lambda rng: 0.25 if rng.random() < 0.34 else rng.random(),
    "two values": lambda rng: float(rng.randrange(2)),
    "whole": lambda rng: float(rng.randrange(40)),
    "holes": lambda rng: rng.choice([None, math.nan, math.inf, -math.inf, rng.random()]),
}


@pytest.mark.parametrize("few", [5, 4_096])
@pytest.mark.parametrize("shape", VALUES)
def test_members_equal_sorting(spark, monkeypatch, shape, few):
    monkeypatch.setattr(selection, "FEW_IDS", few)
    rng = random.Random(3)
    rows = [(f"m{rng.randrange(10**9):x}é{i}", VALUES[shape](rng)) for i in range(4_000)]
    df = spark.createDataFrame(rows, "media_id string, v double").repartition(7)
    got = members(df, RULES, accuracy=50)  # a rough sketch, so that several rounds are needed
    for rule in RULES:
        assert sorted(got[rule.name]) == sorted(brute(rows, rule))


def test_number_ids_negative_ids_and_repeated_rows(spark):
    rows = [(i, 1.0) for i in range(-300, 300)]
    df = spark.createDataFrame(rows, "media_id long, v double")
    assert sorted(members(df, RULES[:1])["low"]) == list(range(-300, -270))
    twice = spark.createDataFrame([("a", 1.0)] * 4 + [("b", 1.0)] * 96, "media_id string, v double")
    assert sorted(members(twice, RULES[:1])["low"]) == ["a"] * 4 + ["b"] * 96  # rows that cannot be told apart
    with pytest.raises(ValueError):
        quantile_members(df.selectExpr("cast(media_id as double) media_id", "v"), RULES)


def test_few_or_no_rows_missing_ids_and_conditions(spark):
    few = spark.createDataFrame([("b", 5.0, "x"), (None, 4.0, "x"), ("c", 1.0, "y")], "media_id string, v double, kind string")
    rule = QuantileRule("r", "v", 0.5, where="kind = 'x'")
    got = quantile_members(few, [rule], carry=("kind",)).collect()
    assert sorted((r["media_id"] or "", r["value"], r["kind"]) for r in got) == [("", 4.0, "x"), ("b", 5.0, "x")]
    empty = quantile_members(few.limit(0), [rule])
    assert empty.count() == 0 and empty.columns == ["rule", "media_id", "value"]
    assert quantile_members(few.selectExpr("media_id", "cast(null as double) v", "kind"), [rule]).count() == 0


def test_no_sort_and_no_exchange_of_rows(spark):
    df = spark.range(20_000).selectExpr("cast(id as string) media_id", "cast(id * 7919 % 1000 as double) v")
    found = quantile_members(df, RULES[:3])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    want = {(r["rule"], r["media_id"]) for r in quantile_items(df, RULES[:3]).collect()}
    assert {(r["rule"], r["media_id"]) for r in found.collect()} == want
