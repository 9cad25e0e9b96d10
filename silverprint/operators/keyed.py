"""Joining per-key facts back on to rows when one key may hold a large share of them.

A fact table has one row per key and knows how many rows the key has. A key that holds more than one
``HOT_PARTS``-th of all rows is hot; there are fewer than ``HOT_PARTS`` such keys whatever the size of the
table, so their facts are broadcast. All other rows go through an ordinary shuffle join, while rows that are
already served, rows with a null key and copies of a hot key are scattered over all its tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Proven bound on the number of broadcast facts.
HOT_PARTS = 256
#: Rows of one fact that stay below any hot share: small tables have no hot keys.
LEAST_HOT = 2_000


def single(df: DataFrame) -> Column:
    """The only row of ``df`` as a struct value: a scalar subquery, evaluated once per query."""
    return df.select(F.struct(*df.columns).alias("row")).scalar()


def attach_facts(
    rows: DataFrame,
    facts: DataFrame,
    key: list[str],
    weight: Column,
    spread_by: str,
    hot_rows: int | None = None,
    keep_unmatched: bool = False,
) -> DataFrame:
    """``rows`` with the columns of ``facts`` added by ``key``.

    ``weight`` counts the rows of a key; ``spread_by`` names a column of ``rows`` with many values, by which
    rows are scattered that need no partner in the shuffle. ``hot_rows`` sets the bound between the two ways by
    hand; the result is the same for any bound.
    """
    added = [c for c in facts.columns if c not in key]
    packed = facts.select(
        *[F.col(c).alias(f"_k_{c}") for c in key], F.struct(*added).alias("_facts"), weight.cast("long").alias("_weight")
    )
    if hot_rows is None:
        total = packed.agg(F.coalesce(F.sum("_weight"), F.lit(0)).alias("total")).scalar()
        bound = F.greatest(F.lit(LEAST_HOT).cast("long"), F.floor(total / HOT_PARTS) + 1)
    else:
        bound = F.lit(hot_rows).cast("long")
    hot = packed.filter(F.col("_weight") >= bound).drop("_weight").withColumnRenamed("_facts", "_hot")
    # the weight is below 2^62, so this is 0 for every cold key, but not to the optimizer, which would
    # otherwise replace it in the join condition and leave the hot rows on their own key
    cold = packed.filter(F.col("_weight") < bound).select(
        *[f"_k_{c}" for c in key], "_facts", F.shiftright("_weight", 62).alias("_k_spread")
    )

    on_key = [F.col(c) == F.col(f"_k_{c}") for c in key]
    no_key = F.lit(False)
    for c in key:
        no_key = no_key | F.col(c).isNull()
    routed = (
        rows.join(F.broadcast(hot), on_key, "left")
        .drop(*[f"_k_{c}" for c in key])
        .withColumn(
            "_spread",
            F.when(F.col("_hot").isNull() & ~no_key, F.lit(0).cast("long")).otherwise(
                F.xxhash64(F.col(spread_by)).bitwiseOR(F.lit(1))
            ),
        )
    )
    joined = routed.join(cold, [*on_key, F.col("_spread") == F.col("_k_spread")], "left")
    found = F.coalesce(F.col("_hot"), F.col("_facts"))
    if not keep_unmatched:
        joined = joined.filter(found.isNotNull())
    return joined.select(*[F.col(c) for c in rows.columns], *[found[c].alias(c) for c in added])
