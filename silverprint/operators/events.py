"""Capture events: time clusters, places, outliers and names."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverprint.functions.vectors import dot, norm
from silverprint.operators.keyed import attach_facts
from silverprint.workspace import materialise

# Gap and size of a time cluster, split and merge bounds, outlier bound.
GAP_HOURS = 12
MIN_PHOTOS = 3
SPLIT_KM = 50.0
MERGE_DAYS = 2
OUTLIER_COSINE = 0.5

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.19492664455873


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2 * EARTH_KM)


def _cell(ts: Column, gap_hours: float) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(int(gap_hours * 3_600_000_000)).cast("long"))


def _tagged_cells(items: DataFrame, group: str, ts: str, gap_hours: float) -> DataFrame:
    """Cells of one gap length with the start of the cluster they belong to.

    Two photos in one cell are always close enough, so only the cells have to be put in order. Their
    number per group depends on the time span, not on the number of photos.
    """
    cells = (
        items.filter(F.col(ts).isNotNull())
        .groupBy(group, _cell(F.col(ts), gap_hours).alias("cell"))
        .agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("photos"))
    )
    in_order = Window.partitionBy(group).orderBy("cell")
    gap = F.unix_micros("first") - F.unix_micros(F.lag("last").over(in_order))
    starts = F.when(gap.isNull() | (gap > int(gap_hours * 3_600_000_000)), F.col("first"))
    upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("_start", starts).withColumn("start_at", F.last("_start", ignorenulls=True).over(upto)).drop("_start")


def event_time_clusters(
    items: DataFrame, group: str = "library_id", ts: str = "taken_at", gap_hours: float = GAP_HOURS, min_photos: int = MIN_PHOTOS
) -> DataFrame:
    """Runs of photos with gaps up to ``gap_hours``, of at least ``min_photos``: one row per event."""
    cells = _tagged_cells(items, group, ts, gap_hours)
    return (
        cells.groupBy(group, "start_at")
        .agg(F.max("last").alias("end_at"), F.sum("photos").alias("photos"))
        .filter(F.col("photos") >= min_photos)
    )


def event_members(
    items: DataFrame,
    group: str = "library_id",
    ts: str = "taken_at",
    id_col: str = "media_id",
    gap_hours: float = GAP_HOURS,
    min_photos: int = MIN_PHOTOS,
) -> DataFrame:
    """Items with the start and size of the event they belong to."""
    cells = _tagged_cells(items, group, ts, gap_hours)
    events = event_time_clusters(items, group, ts, gap_hours, min_photos).select(
        group, "start_at", F.col("photos").alias("event_size")
    )
    facts = cells.join(events, [group, "start_at"]).select(group, "cell", "start_at", "event_size", F.col("photos").alias("_n"))
    rows = items.withColumn("cell", _cell(F.col(ts), gap_hours))
    return attach_facts(rows, facts, [group, "cell"], F.col("_n"), id_col).drop("cell", "_n")


def reverse_geocode(points: DataFrame, cities: DataFrame, max_km: float = 100.0, id_col: str = "media_id") -> DataFrame:
    """Nearest city within ``max_km`` of each point; points without one keep a null city.

    Cities are put into every grid cell their radius touches, a point looks only into its own.
    """
    step = max_km / KM_PER_DEGREE
    around = int(360 / step)
    lon_step = 360.0 / around
    reach = F.least(F.lit(180.0), F.lit(step) / F.greatest(F.cos(F.radians(F.least(F.abs("lat") + step, F.lit(89.9)))), F.lit(0.001)))
    rows = F.sequence(F.floor((F.col("lat") - step) / step), F.floor((F.col("lat") + step) / step))
    columns = F.sequence(F.floor((F.col("lon") - reach) / lon_step), F.floor((F.col("lon") + reach) / lon_step))
    placed = (
        cities.withColumn("row", F.explode(rows))
        .withColumn("_c", F.explode(columns))
        .select(
            "city", F.col("lat").alias("city_lat"), F.col("lon").alias("city_lon"), "row", F.pmod("_c", F.lit(around)).alias("column")
        )
        .distinct()
    )
    cell = placed.groupBy("row", "column").agg(F.collect_list(F.struct("city", "city_lat", "city_lon")).alias("_near"))
    located = points.withColumns(
        {
            "row": F.floor(F.col("lat") / step),
            "column": F.pmod(F.floor(F.col("lon") / lon_step), F.lit(around)),
        }
    )
    counts = located.groupBy("row", "column").agg(F.count(F.lit(1)).alias("_n"))
    facts = cell.join(counts, ["row", "column"])
    joined = attach_facts(located, facts, ["row", "column"], F.col("_n"), id_col, keep_unmatched=True)
    candidates = F.transform(
        "_near",
        lambda c: F.struct(
            haversine_km(F.col("lat"), F.col("lon"), c["city_lat"], c["city_lon"]).alias("km"), c["city"].alias("city")
        ),
    )
    best = F.array_min(F.filter(candidates, lambda c: c["km"] <= max_km))
    return joined.withColumn("_best", best).select(
        *points.columns, F.col("_best.city").alias("city"), F.col("_best.km").alias("city_km")
    )


def _refined_parts(members: DataFrame, group: str, ts: str, split_km: float, merge_days: float) -> tuple[DataFrame, DataFrame]:
    """Per event whether it is wide and its main city; per part of an event the start of the event it was merged into."""
    event = [group, "start_at"]
    centre = members.groupBy(*event).agg(
        F.avg("lat").alias("mean_lat"), F.avg("lon").alias("mean_lon"), F.count(F.lit(1)).alias("_n")
    )
    placed = attach_facts(members, centre, event, F.col("_n"), "media_id")
    away = haversine_km(F.col("lat"), F.col("lon"), F.col("mean_lat"), F.col("mean_lon"))
    # one row per event and city: everything after this works on parts, not on photos
    spread = placed.groupBy(*event).agg(
        (2 * F.count_if(away > split_km) > F.count(away)).alias("wide"), F.count(F.lit(1)).alias("_n")
    )
    by_city = members.groupBy(*event, F.coalesce("city", F.lit("")).alias("city")).agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("photos")
    )
    main_city = by_city.groupBy(*event).agg(F.min(F.struct((-F.col("photos")).alias("n"), "city")).alias("_m"))
    verdict = spread.join(main_city, event).select(*event, "wide", F.col("_m.city").alias("main_city"), "_n")
    parts = (
        by_city.join(verdict, event)
        .withColumn("part_city", F.when(F.col("wide"), F.col("city")).otherwise(F.col("main_city")))
        .groupBy(*event, "part_city")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("photos").alias("photos"))
    )
    in_order = Window.partitionBy(group, "part_city").orderBy("first", "start_at")
    reached = F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.unix_micros("first") - F.unix_micros(reached)
    fresh = F.when(gap.isNull() | (gap >= int(merge_days * 86_400_000_000)) | (F.col("part_city") == ""), F.col("first"))
    upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
    return verdict, parts.withColumn("_f", fresh).withColumn("event_start", F.last("_f", ignorenulls=True).over(upto))


def event_location_refine(
    members: DataFrame, group: str = "library_id", ts: str = "taken_at", split_km: float = SPLIT_KM, merge_days: float = MERGE_DAYS
) -> DataFrame:
    """Split wide events by city, then merge parts of one city less than ``merge_days`` apart.

    ``members`` come from :func:`event_members` with lat, lon and city. An event is wide when the
    median distance of its photos to its mean position exceeds ``split_km``: when more than half are farther away.
    """
    members = materialise(members.select("media_id", group, "start_at", ts, "lat", "lon", "city"), "event_members")
    _, merged = _refined_parts(members, group, ts, split_km, merge_days)
    return merged.groupBy(group, F.col("part_city").alias("city"), "event_start").agg(
        F.max("last").alias("event_end"), F.sum("photos").alias("photos"), F.count(F.lit(1)).alias("parts")
    )


def event_member(
    members: DataFrame, group: str = "library_id", ts: str = "taken_at", split_km: float = SPLIT_KM, merge_days: float = MERGE_DAYS
) -> DataFrame:
    """Which photo belongs to which event of :func:`event_location_refine`: (group, city, event_start) name the event."""
    members = materialise(members.select("media_id", group, "start_at", ts, "lat", "lon", "city"), "event_members")
    verdict, merged = _refined_parts(members, group, ts, split_km, merge_days)
    judged = attach_facts(members, verdict, [group, "start_at"], F.col("_n"), "media_id").withColumn(
        "part_city", F.when(F.col("wide"), F.coalesce("city", F.lit(""))).otherwise(F.col("main_city"))
    )
    key = [group, "start_at", "part_city"]
    found = attach_facts(judged, merged.select(*key, "event_start", "photos"), key, F.col("photos"), "media_id")
    return found.select(group, F.col("part_city").alias("city"), "event_start", "media_id", ts, "lat", "lon")


def event_group(members: DataFrame, group: str = "library_id", ts: str = "taken_at") -> DataFrame:
    """One row an event of :func:`event_member`: its span, cover (the first photo) and mean position."""
    first = F.min(F.struct(ts, "media_id"))
    return members.groupBy(group, "city", "event_start").agg(
        F.max(ts).alias("event_end"),
        F.count(F.lit(1)).alias("photos"),
        first["media_id"].alias("cover"),
        F.avg("lat").alias("centroid_lat"),
        F.avg("lon").alias("centroid_lon"),
    )


def event_outliers(members: DataFrame, event: str = "event_id", min_cosine: float = OUTLIER_COSINE) -> DataFrame:
    """Members with their cosine to the event's mean vector and whether they stay."""
    centroid = members.groupBy(event).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))).alias("centroid"),
        F.count(F.lit(1)).alias("_n"),
    )
    joined = attach_facts(members, centroid, [event], F.col("_n"), "media_id")
    length = norm(F.col("embedding")) * norm(F.col("centroid"))
    cosine = dot(F.col("embedding"), F.col("centroid")) / F.when(length == 0, F.lit(1.0)).otherwise(length)
    return joined.select(event, "media_id", cosine.alias("cosine"), (cosine >= min_cosine).alias("stays"))


def event_label(members: DataFrame, event: str = "event_id", label: str = "label", ts: str = "taken_at") -> DataFrame:
    """Name of an event: its three most frequent labels, its city and its dates."""
    counts = members.filter(F.col(label).isNotNull()).groupBy(event, label).agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy(event).orderBy(F.col("n").desc(), label)  # one row per label of an event
    top = (
        counts.withColumn("r", F.row_number().over(best))
        .filter("r <= 3")
        .groupBy(event)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("r", label))), lambda e: e[label]).alias("_labels"))
    )
    cities = members.filter(F.col("city").isNotNull()).groupBy(event, "city").agg(F.count(F.lit(1)).alias("n"))
    city = cities.groupBy(event).agg(F.min(F.struct((-F.col("n")).alias("n"), "city")).alias("_c"))
    span = members.groupBy(event).agg(F.min(ts).alias("start_at"), F.max(ts).alias("end_at"))
    start, end = F.date_format("start_at", "yyyy-MM-dd"), F.date_format("end_at", "yyyy-MM-dd")
    return (
        span.join(top, event, "left")
        .join(city, event, "left")
        .select(
            event,
            F.concat_ws(
                " · ",
                F.array_join("_labels", ", "),
                F.col("_c.city"),
                F.when(start == end, start).otherwise(F.concat(start, F.lit(" – "), end)),
            ).alias("label"),
            "start_at",
            "end_at",
        )
    )
