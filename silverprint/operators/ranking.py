"""Global ranks, running totals and quantile selection without a single-task window."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverprint.workspace import materialise

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its lower 33 bits


def global_rank(
    df: DataFrame,
    order: list[Column],
    name: str = "rank",
    totals: dict[str, str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Number all rows from 1 in ``order``, which must end in a unique key.

    The rows are range-partitioned and sorted once; the row number inside the partition comes with
    the row id, so only one count per partition has to be added. A heavy value cannot make a heavy
    partition, because the unique last key lets the ranges cut through it. ``totals`` maps new
    column names to numeric columns whose running totals are wanted as well.
    """
    totals = totals or {}
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = ranged.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    table = materialise(placed, "ranked")
    part = F.shiftright(F.col("_at"), _ROW_BITS)
    table = table.withColumn("_part", part)

    sums = [F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()]
    per_part = table.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), *sums).orderBy("_part").collect()
    offsets, seen, carried = [], 0, {n: 0 for n in totals}
    for row in per_part:  # one row per partition
        offsets.append((row["_part"], seen, *[carried[n] for n in totals]))
        seen += row["_rows"]
        for n in totals:
            carried[n] += row[f"_sum_{n}"] or 0
    fields = [T.StructField("_part", T.LongType()), T.StructField("_before", T.LongType())]
    fields += [T.StructField(f"_before_{n}", table.schema[c].dataType) for n, c in totals.items()]
    lookup = F.broadcast(df.sparkSession.createDataFrame(offsets, T.StructType(fields)))

    placed_rank = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + F.col("_before") + 1
    result = table
    for n, c in totals.items():
        running = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        result = result.withColumn(f"_run_{n}", F.sum(c).over(running))
    result = result.join(lookup, "_part")
    return result.select(
        *[F.col(c) for c in df.columns],
        placed_rank.alias(name),
        *[(F.col(f"_run_{n}") + F.col(f"_before_{n}")).alias(n) for n in totals],
    )


def rank_within(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Row numbers per group that stay spread out when one group holds most rows."""
    from silverprint.operators.keyed import attach_facts

    ranked = global_rank(df, [*[F.col(c) for c in group], *order], "_global")
    first = ranked.groupBy(*group).agg(F.min("_global").alias("_first"), F.count(F.lit(1)).alias("_size"))
    joined = attach_facts(ranked, first, group, F.col("_size"), "_global")
    return joined.select(*df.columns, (F.col("_global") - F.col("_first") + 1).alias(name))


@dataclass(frozen=True)
class QuantileRule:
    """Take the lowest or highest ``q`` of a column among the rows that meet ``where``."""

    name: str
    column: str
    q: float
    side: str = "low"
    where: str = "true"


def quantile_items(
    df: DataFrame,
    rules: list[QuantileRule],
    id_col: str = "media_id",
    carry: tuple[str, ...] = (),
    accuracy: int | None = 10_000,
) -> DataFrame:
    """Members of each rule: the first min(n, max(3, ceil(n * q))) rows in order, ties by id.

    All rules share one pass for the sizes and one range sort. A rough percentile first drops the
    rows that cannot be in the selected fraction, so the sort sees about ``q`` of them. Its rank
    error is at most n / ``accuracy``; it is taken 2 / ``accuracy`` further out and only used when n
    is 100 times ``accuracy``. What it kept is counted all the same, and if that is too few for any rule, everything is
    ranked (``accuracy=None`` does so at once).
    """
    entries = []
    for rule in rules:
        v = F.col(rule.column).cast("double")
        usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & F.expr(rule.where)
        key = v if rule.side == "low" else -v
        entries.append(F.when(usable, F.struct(F.lit(rule.name).alias("rule"), key.alias("key"), v.alias("value"))))
    flat = df.select(id_col, *carry, F.explode(F.array_compact(F.array(*entries))).alias("_e")).select(
        "_e.rule", "_e.key", "_e.value", id_col, *carry
    )

    margin = 2.0 / accuracy if accuracy else 1.0
    cuts = sorted({min(1.0, r.q + margin) for r in rules})
    sizes = {
        row["rule"]: row
        for row in flat.groupBy("rule")
        .agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("key", cuts, accuracy or 100).alias("cuts"))
        .collect()  # one row per rule
    }
    spark = df.sparkSession
    takes, keep = [], F.lit(False)
    for rule in rules:
        if rule.name not in sizes:
            continue
        n = sizes[rule.name]["n"]
        take = min(n, max(3, math.ceil(n * rule.q)))
        takes.append((rule.name, take))
        mine = F.col("rule") == rule.name
        if accuracy and n >= 100 * accuracy:
            bound = sizes[rule.name]["cuts"][cuts.index(min(1.0, rule.q + margin))]
            mine = mine & (F.col("key") <= bound)
        keep = keep | mine
    ranked = global_rank(flat.filter(keep), [F.col("rule"), F.col("key"), F.col(id_col)], "_global")
    starts = ranked.groupBy("rule").agg(F.min("_global").alias("_first"), F.count(F.lit(1)).alias("_kept"))
    if accuracy:
        kept = {r["rule"]: r["_kept"] for r in starts.collect()}  # one row per rule
        if any(kept.get(name, 0) < take for name, take in takes):
            return quantile_items(df, rules, id_col, carry, None)
    limits = spark.createDataFrame(takes, "rule string, take long")
    bounds = F.broadcast(starts.join(F.broadcast(limits), "rule"))
    return (
        ranked.join(bounds, "rule")
        .withColumn("position", F.col("_global") - F.col("_first") + 1)
        .filter(F.col("position") <= F.col("take"))
        .select("rule", id_col, *carry, "value", "position")
    )
