"""Face clusters and the items they appear in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverprint.operators.keyed import attach_facts
from silverprint.operators.ranking import global_rank
from silverprint.operators.vector_pairs import FACE_EPS, distinct_vectors, l2_pairs, vector_components
from silverprint.workspace import materialise


def explode_faces(items: DataFrame) -> DataFrame:
    """One row per detected face; its id sorts by item and then by position."""
    return items.select("media_id", F.posexplode("faces").alias("face_idx", "_f")).select(
        F.concat(F.col("media_id"), F.lit("#"), F.lpad(F.col("face_idx").cast("string"), 6, "0")).alias("face_id"),
        "media_id",
        "face_idx",
        F.col("_f.descriptor").alias("descriptor"),
    )


def face_pairs(faces: DataFrame, eps: float = FACE_EPS, **tuning: int) -> DataFrame:
    """Pairs of distinct descriptors closer than ``eps``, named by the first face holding each."""
    return l2_pairs(distinct_vectors(faces, "face_id", "descriptor"), eps, **tuning)


def tag_clusters(faces: DataFrame, eps: float = FACE_EPS, **tuning: int) -> DataFrame:
    """Faces that belong to a cluster of at least two, with the cluster's smallest face id."""
    labels = vector_components(faces, "face_id", "descriptor", eps, **tuning)
    return materialise(faces.drop("descriptor").join(labels, "face_id"), "face_tags")


def face_clusters(tagged: DataFrame) -> DataFrame:
    """Clusters by face count, largest first; the first face represents, size counts items."""
    by_item = tagged.groupBy("component", "media_id").agg(
        F.count(F.lit(1)).alias("faces"), F.min(F.struct("face_id", "face_idx")).alias("first")
    )
    clusters = by_item.groupBy("component").agg(
        F.sum("faces").alias("face_count"),
        F.count(F.lit(1)).alias("size"),
        F.min(F.struct("first", "media_id")).alias("rep"),
    )
    numbered = global_rank(clusters, [F.col("face_count").desc(), F.col("component")], "_n")
    return numbered.select(
        F.concat(F.lit("person-"), F.col("_n").cast("string")).alias("id"),
        "component",
        F.col("rep.media_id").alias("representative_item_id"),
        F.col("rep.first.face_idx").alias("representative_face_idx"),
        "face_count",
        "size",
    )


def cluster_item_set(tagged: DataFrame, clusters: DataFrame) -> DataFrame:
    """Distinct items per cluster, as rows."""
    pairs = tagged.select("component", "media_id").distinct()
    facts = clusters.select("component", "id", "size")
    return attach_facts(pairs, facts, ["component"], F.col("size"), "media_id").select("id", "media_id")


def solo_faces(items: DataFrame, tagged: DataFrame) -> DataFrame:
    """Items with faces, none of which is in a cluster."""
    return items.filter(F.size("faces") > 0).join(tagged.select("media_id").distinct(), "media_id", "left_anti")


def faces_total(items: DataFrame) -> DataFrame:
    return items.agg(
        F.coalesce(F.sum(F.when(F.size("faces") > 0, F.size("faces"))), F.lit(0)).cast("long").alias("faces")
    )
