"""Near groups kept up batch by batch against a full run."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from silverprint.operators import dedup
from silverprint.operators.hamming_pairs import band_keys, near_asked_pairs
from silverprint.operators.standing_groups import StandingGroups
from silverprint.workspace import materialise
from tests.test_dedup import frame, item, random_hashes, signed


def rows_of(found):
    return [sorted(map(tuple, df.collect())) for df in found]


def test_every_batch_leaves_what_a_full_run_finds(spark, tmp_path):
    items = [item(i, f"s{i % 40}", h) for i, h in enumerate(random_hashes(5, 90, 8))]
    # a chain whose middle arrives last, one content that gets a second one later, hashes that repeat, rows without hash
    items += [item(200 + i, f"c{i}", 0xFFFF0000FFFF0000 ^ ((1 << 5 * i) - 1)) for i in range(4)]
    items += [item(300, "same", 0x0F0F0F0F00000000), item(301, "same", 0x0F0F0F0F00000001), item(302, "other", 0x0F0F0F0F00000000)]
    items += [item(400 + i, f"r{i % 2}", 0x123456789ABCDEF0) for i in range(5)] + [item(500, "z", 0), item(501, "v", 7, kind="VIDEO")]
    random.Random(2).shuffle(items)
    late = [r for r in items if r[0] in ("m0201", "m0302")]
    order = [r for r in items if r not in late] + late
    cuts = [0, 30, 60, 61, len(order) - 2, len(order)]
    standing = StandingGroups(spark, str(tmp_path / "near"), parts=8)
    for a, b in zip(cuts, cuts[1:]):
        standing.add(frame(spark, order[a:b]))
        sofar = frame(spark, order[:b])
        assert rows_of(standing.groups(sofar)) == rows_of(dedup.near_dedup(sofar, mode="banded"))


def test_a_small_batch_rewrites_few_parts_and_an_empty_one_none(spark, tmp_path):
    first = [item(i, f"s{i}", random.Random(i).getrandbits(64)) for i in range(60)]
    standing = StandingGroups(spark, str(tmp_path / "near"), parts=32)
    standing.add(frame(spark, first))
    before = standing.tables.manifest()
    assert standing.add(frame(spark, [])) == before["version"] == standing.tables.manifest()["version"]
    standing.add(frame(spark, [item(900, "new", 0x5555AAAA5555AAAA)]))
    after = standing.tables.manifest()
    for table, most in (("hashes", 1), ("members", 1), ("bands", 7)):
        old, new = before["tables"][table]["folders"], after["tables"][table]["folders"]
        assert sum(old.get(p) != f for p, f in new.items()) <= most
    assert standing.tables.read("hashes", before).count() == 60  # a reader of the older manifest sees it whole


def test_crowded_band_values_are_cut_again_for_a_batch_too(spark, tmp_path):
    # one band value for all hashes: half the catalog is there, the other half arrives
    low = random.Random(7)
    hashes = [(low.getrandbits(54) << 9) | 5 for _ in range(500)] + [(h << 9) | 5 for h in random_hashes(8, 200, 20) if h < 1 << 54]
    hashes += [h ^ (1 << 9 + i % 50) ^ (1 << 40) for i, h in enumerate(hashes[:100])]
    items = [item(i, f"s{i % 650}", h) for i, h in enumerate(hashes)]
    items.append(item(9000, "again", hashes[0]))  # a known hash whose content changes
    standing = StandingGroups(spark, str(tmp_path / "near"), parts=4, crowded=40)
    for part in (items[::2], items[1::2]):
        standing.add(frame(spark, part))
    assert rows_of(standing.groups(frame(spark, items))) == rows_of(dedup.near_dedup(frame(spark, items), mode="banded"))


@pytest.mark.parametrize("crowded", [4, 1024])
def test_asked_pairs_are_all_pairs_and_come_once(spark, crowded):
    hashes = sorted({signed(h) for h in random_hashes(11, 300, 6)})
    near = {(a, b) for a in hashes for b in hashes if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 6}
    new = set(hashes[::3])
    rows = spark.createDataFrame([(h, h in new) for h in hashes], "dhash long, asks boolean")
    keyed = band_keys(rows.select("dhash")).join(rows, "dhash").withColumn("told", F.lit(True))
    found = [(min(r), max(r)) for r in near_asked_pairs(keyed, crowded=crowded).collect()]
    assert len(found) == len(set(found)) and set(found) == {p for p in near if new & set(p)}


def test_a_crowded_value_is_not_compared_whole(spark):
    rows = [((i * 0x9E3779B97F4A7C15 & (1 << 54) - 1) << 9 | 5) for i in range(1500)]
    keyed = band_keys(spark.createDataFrame([(h,) for h in rows], "dhash long")).selectExpr("*", "true AS asks", "true AS told")
    written = []

    def stored(df, label):
        written.append((label, materialise(df, label)))
        return written[-1][1]

    near_asked_pairs(keyed, crowded=100, stored=stored)
    levels = [t for label, t in written if label == "asked_bands"]
    assert levels[0].count() == 7 * 1500 and levels[1].count() == 7 * 1500
    assert levels[1].groupBy("key").count().agg(F.max("count")).first()[0] <= 100


def test_rows_that_ask_and_rows_that_are_told_meet_in_a_merge_join(spark):
    hashes = spark.range(40).select((F.col("id") * 37).alias("dhash"))
    asked = band_keys(hashes, 6).withColumns({"asks": F.col("dhash") % 2 == 0, "told": F.lit(True)})
    pairs = near_asked_pairs(asked)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    got = [tuple(sorted(r)) for r in pairs.collect()]
    values = [37 * i for i in range(40)]
    want = {(a, b) for a in values for b in values if a < b and bin(a ^ b).count("1") <= 6 and (a % 2 == 0 or b % 2 == 0)}
    assert len(got) == len(set(got)) and set(got) == want
