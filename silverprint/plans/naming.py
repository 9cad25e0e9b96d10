"""Names that collide with nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverprint.functions.paths import basename, extname
from silverprint.operators.keyed import attach_facts
from silverprint.operators.ranking import global_rank

_NUMBERED = r"^(.*) \((\d{1,9})\)(\.[^./]*)?$"


def _numbered(path):
    """Split ``stem (7).ext`` into the path without the number and the number."""
    stem, number, ext = (F.regexp_extract(path, _NUMBERED, i) for i in (1, 2, 3))
    return F.when(path.rlike(_NUMBERED), F.struct(F.concat(stem, ext).alias("target"), number.cast("long").alias("number")))


def unique_targets(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """Give every row of ``wanted (media_id, target)`` a path no other row and no taken path has.

    The first request (by id) of a free target gets it as it is. Others get `` (i)`` before the
    extension, counting over the numbers that are still free. ``taken`` has one column ``path``.
    Requests and used numbers are put in one global order, so a target asked for by very many rows
    is spread over all tasks.
    """
    paths = taken.select("path").distinct()
    asked = wanted.groupBy("target").agg(F.count(F.lit(1)).alias("asked"))
    facts = asked.join(paths.select(F.col("path").alias("target"), F.lit(1).alias("_used")), "target", "left").select(
        "target", "asked", F.coalesce("_used", F.lit(0)).alias("occupied")
    )

    # free numbers: the j-th used number u leaves u - j free ones below it
    used = (
        paths.select(F.col("path").alias("target"))
        .unionByName(asked.select("target"))
        .withColumn("_p", _numbered(F.col("target")))
        .filter(F.col("_p").isNotNull() & (F.col("_p.number") >= 1))
        .select("_p.target", "_p.number")
        .distinct()
        .join(asked.filter("asked > 0").select("target"), "target", "left_semi")
    )
    used_order = global_rank(used, [F.col("target"), F.col("number")], "_g")
    used_first = used_order.groupBy("target").agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("_n"))
    used_at = attach_facts(used_order, used_first, ["target"], F.col("_n"), "_g").select(
        "target", (F.col("number") - (F.col("_g") - F.col("_first") + 1)).alias("place"), F.lit(1).alias("is_used")
    )

    requests = global_rank(wanted, [F.col("target"), F.col("media_id")], "_g")
    first = requests.groupBy("target").agg(F.min("_g").alias("_first"))
    with_facts = attach_facts(requests, facts.join(first, "target"), ["target"], F.col("asked"), "media_id")
    turn = F.col("_g") - F.col("_first") + F.col("occupied")  # 0 keeps the target, m takes the m-th free number
    turned = with_facts.withColumn("turn", turn)

    # the m-th free number is m plus the used numbers whose place is below m
    mixed = used_at.select("target", "place", "is_used", F.lit(None).cast("string").alias("media_id")).withColumn(
        "_seq", F.xxhash64("target", "place")
    )
    mixed = mixed.unionByName(
        turned.filter("turn > 0").select(
            "target", F.col("turn").alias("place"), F.lit(0).alias("is_used"), "media_id", F.lit(0).cast("long").alias("_seq")
        )
    )
    # at equal place the request comes first: a used number counts only for places above its own
    ordered = global_rank(
        mixed, [F.col("target"), F.col("place"), F.col("is_used"), F.col("media_id"), F.col("_seq")], "_g", totals={"_seen": "is_used"}
    )
    bounds = ordered.groupBy("target").agg(
        F.min(F.col("_seen") - F.col("is_used")).alias("_before"), F.count(F.lit(1)).alias("_n")
    )
    numbers = (
        attach_facts(ordered, bounds, ["target"], F.col("_n"), "_g")
        .filter("is_used = 0")
        .select("media_id", "target", (F.col("place") + F.col("_seen") - F.col("_before")).alias("number"))
    )
    ext = extname(F.col("target"))
    stem = F.expr("substring(target, 1, length(target) - length(_ext))")
    numbered = numbers.withColumn("_ext", ext).select(
        "media_id",
        "target",
        F.concat(stem, F.lit(" ("), F.col("number").cast("string"), F.lit(")"), F.col("_ext")).alias("final"),
    )
    kept = turned.filter("turn = 0").select("media_id", "target", F.col("target").alias("final"))
    return kept.unionByName(numbered).withColumn("collided", F.col("final") != F.col("target"))


def new_target(path, new_name):
    """The path of a file after it got a new name in its own directory."""
    return F.concat(F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)))"), new_name)


def file_name(path):
    return basename(path)
