"""Near-duplicate groups kept up as files arrive: a batch looks up its own hash bands and merges the components it links.

Three versioned tables, which switch together, hold what has arrived:

* ``hashes``: each distinct hash with the range of its content digests, its copies and its component (the smallest hash in it);
* ``bands``: the band keys of each hash, cut into parts by key;
* ``members``: the hashes of each component, cut into parts by component.

A batch only adds links, since files are not taken out. It reads the parts of its hashes and of their band keys, links what
is within the distance, and searches the components of the few components that these links join. Parts that hold a hash whose
component or facts have changed are written anew, all others stay as they are. The components are those of a full run over
everything that has arrived (``dedup.near_dedup`` with ``mode="banded"``), whatever the batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverprint.functions.hashing import hamming
from silverprint.operators.components import connected_components
from silverprint.operators.dedup import near_outputs, near_tagged
from silverprint.operators.hamming_pairs import HAMMING_LIMIT, band_keys, hash_groups, near_asked_pairs, near_candidates
from silverprint.operators.keyed import attach_facts
from silverprint.sources.versions import VersionedTables
from silverprint.workspace import materialise, release

_SCHEMAS = {
    "hashes": ("dhash long, sha_lo string, sha_hi string, copies long, component long, linked boolean", "dhash"),
    "bands": ("dhash long, key long", "key"),
    "members": ("dhash long, component long", "component"),
}


class StandingGroups:
    """Near groups of one catalog, or of one of its libraries, under ``path``."""

    def __init__(self, spark: SparkSession, path: str, library: str | None = None, limit: int = HAMMING_LIMIT, parts: int = 64, crowded: int = 1024):
        """``parts`` is fixed when the tables are first made: many parts make small batches cheap.

        Band values that more than ``crowded`` hashes of a batch have are cut again; the groups are the same for any bound.
        """
        self.spark, self.library, self.limit, self.crowded = spark, library, limit, crowded
        self.tables = VersionedTables(spark, path)
        made = self.tables.manifest()["tables"]
        for name, (schema, key) in _SCHEMAS.items():
            if name not in made:
                self.tables.create(name, spark.createDataFrame([], schema), f"pmod(xxhash64({key}), {parts})")

    def add(self, items: DataFrame) -> int:
        """Take in a batch of items that have not been added before; returns the version that holds it.

        Items without a usable hash are passed over, as in a full run. Another writer in between raises ``Conflict``.
        """
        base = self.tables.manifest()
        scratch: list[DataFrame] = []

        def stored(df: DataFrame, label: str) -> DataFrame:
            scratch.append(materialise(df, label))
            return scratch[-1]

        def parts(df: DataFrame, table: str, key: str) -> set[str]:
            """Parts of ``table`` that hold these keys: at most as many as the table has."""
            named = df.select(F.col(key).alias(_SCHEMAS[table][1]))
            return {r[0] for r in named.select(F.expr(base["tables"][table]["part"]).cast("string")).distinct().collect()}

        def held(table: str, wanted: set[str]) -> DataFrame:
            return self.tables.read(table, base, wanted)

        batch = stored(hash_groups(near_candidates(items, self.library)), "batch")
        own = parts(batch, "hashes", "dhash")
        if not own:
            release(batch)
            return base["version"]
        old = held("hashes", own).select("dhash", *[F.col(c).alias(f"_{c}") for c in ("sha_lo", "sha_hi", "copies", "component", "linked")])
        low, high = F.least("sha_lo", "_sha_lo"), F.greatest("sha_hi", "_sha_hi")
        new = F.col("_copies").isNull()
        merged = stored(
            batch.join(old, "dhash", "left").select(
                "dhash",
                low.alias("sha_lo"),
                high.alias("sha_hi"),
                (F.col("copies") + F.coalesce("_copies", F.lit(0))).alias("copies"),
                F.coalesce("_component", "dhash").alias("component"),
                F.coalesce("_linked", F.lit(False)).alias("linked"),
                new.alias("new"),
                # a hash with new content may now differ from a neighbour of the same content
                (new | ~low.eqNullSafe(F.col("_sha_lo")) | ~high.eqNullSafe(F.col("_sha_hi"))).alias("changed"),
            ),
            "merged",
        )
        arrived = merged.filter("new").select("dhash")
        new_keys = band_keys(arrived, self.limit)
        links = self._links(merged, new_keys, parts, held, stored)

        # components of components: a component is one node, whatever its size
        joined = connected_components(links.filter("component_a <> component_b"), "component_a", "component_b")
        ends = [links.select(F.col(f"component_{e}").alias("node"), F.col(f"linked_{e}").alias("linked")) for e in "ab"]
        before = ends[0].unionByName(ends[1]).distinct()
        # a component that keeps its name and had links before is left as it is
        moves = stored(joined.join(before, "node").filter("node <> component OR NOT linked").select("node", F.col("component").alias("to")), "moves")

        member_parts = parts(moves, "members", "node")
        moved = held("members", member_parts).join(moves, F.col("component") == F.col("node"), "left_semi")
        hash_parts = own | parts(moved, "hashes", "dhash")
        hashes = held("hashes", hash_parts).join(merged.select("dhash"), "dhash", "left_anti").unionByName(merged.drop("new", "changed"))
        member_parts |= parts(moves, "members", "to") | parts(arrived, "members", "dhash")
        members = held("members", member_parts).unionByName(arrived.select("dhash", F.col("dhash").alias("component")))
        key_parts = parts(new_keys, "bands", "key")
        version = self.tables.switch(
            {
                "hashes": (self._renamed(stored(hashes, "hashes"), moves).withColumn("linked", F.col("linked") | F.col("to").isNotNull()), hash_parts),
                "members": (self._renamed(stored(members, "members"), moves), member_parts),
                "bands": (held("bands", key_parts).unionByName(new_keys), key_parts),
            },
            base,
        )
        for table in scratch:
            release(table)
        return version

    def _links(self, merged: DataFrame, new_keys: DataFrame, parts, held, stored) -> DataFrame:
        """Links of changed hashes with all hashes, with the component of either end and whether it had links before."""
        again = band_keys(merged.filter("changed AND NOT new").select("dhash"), self.limit)
        asked = parts(again, "bands", "key") | parts(new_keys, "bands", "key")
        kinds = ((held("bands", asked), False, True), (new_keys, True, True), (again, True, False))
        old, new, changed = (df.select("dhash", "key", F.lit(asks).alias("asks"), F.lit(told).alias("told")) for df, asks, told in kinds)
        near = stored(near_asked_pairs(old.unionByName(new).unionByName(changed), self.limit, self.crowded, stored=stored), "near")
        columns = ("dhash", "sha_lo", "sha_hi", "component", "linked")
        others = held("hashes", parts(near, "hashes", "dhash_b")).join(merged.select("dhash"), "dhash", "left_anti")
        facts = merged.select(*columns).unionByName(others.select(*columns))
        for end in ("a", "b"):
            near = near.join(facts.select(*[F.col(c).alias(f"{c}_{end}") for c in columns]), f"dhash_{end}")
        one_content = (F.col("sha_lo_a") == F.col("sha_hi_a")) & (F.col("sha_lo_b") == F.col("sha_hi_b")) & (F.col("sha_lo_a") == F.col("sha_lo_b"))
        return stored(near.filter(~one_content).select("component_a", "component_b", "linked_a", "linked_b"), "links")

    def _renamed(self, rows: DataFrame, moves: DataFrame) -> DataFrame:
        """``rows`` with the new name of their component, and ``to``, null where it has not changed."""
        sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        facts = moves.withColumnRenamed("node", "component").join(sizes, "component")
        named = attach_facts(rows, facts, ["component"], F.col("n"), "dhash", keep_unmatched=True).drop("n")
        return named.withColumn("component", F.coalesce("to", "component"))

    def groups(self, items: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Groups and members, as ``dedup.near_dedup`` gives them; ``items`` are all that were added."""
        hashes = self.tables.read("hashes").filter("linked OR sha_lo <> sha_hi").select("dhash", "component", "copies")
        return near_outputs(materialise(near_tagged(items, hashes, self.library), "near_tagged"))
