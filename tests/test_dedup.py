"""Hash pairs, vector pairs, duplicate groups and the copy to keep."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from silverprint.functions.hashing import gradient_hash, hash_from_hex, hash_to_hex
from silverprint.operators import dedup, people, staging
from silverprint.operators.hamming_pairs import (
    hash_groups,
    near_banded_pairs,
    near_candidates,
    near_window_pairs,
    rank_by_hash,
)
from silverprint.operators.vector_pairs import distinct_vectors, l2_pairs, similar_pairs, vector_components
from tests.test_core import union_find

SCHEMA = (
    "media_id string, library_id string, path string, filename string, kind string, size_bytes long, width int, height int,"
    " sha256 string, dhash long, dhash_hex string"
)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def item(n, sha, dhash=1, path=None, size=1000, w=100, h=100, library="l", kind="IMAGE"):
    path = path or f"/lib/Pictures/{n}.jpg"
    return (f"m{n:04d}", library, path, path.split("/")[-1], kind, size, w, h, sha, signed(dhash), f"{dhash:016x}")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def random_hashes(seed, n, centres):
    rng = random.Random(seed)
    bases = [rng.getrandbits(64) for _ in range(centres)]
    out = []
    for _ in range(n):
        h = rng.choice(bases)
        for _ in range(rng.randrange(8)):
            h ^= 1 << rng.randrange(64)
        out.append(h)
    return out


def test_hex_round_trip_covers_the_unsigned_range(spark):
    texts = ["0000000000000000", "7fffffffffffffff", "8000000000000000", "ffffffffffffffff", "00000000000000ab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", hash_from_hex(F.col("t")).alias("v"), hash_to_hex(hash_from_hex(F.col("t"))).alias("back")).collect()
    assert all(r["t"] == r["back"] and r["v"] == signed(int(r["t"], 16)) for r in rows)


def test_gradient_hash_sets_the_first_comparison_highest(spark):
    df = spark.createDataFrame([([1.0, 2.0, 1.0, 5.0],)], "v array<double>")
    assert df.select(gradient_hash(F.col("v"), 3)).head()[0] == 0b101


def window_pairs_by_hand(rows, window, limit):
    order = sorted(rows, key=lambda r: (r[10], r[0]))
    found = set()
    for i, a in enumerate(order):
        for b in order[i + 1 : i + window]:
            if a[8] != b[8] and bin((a[9] ^ b[9]) & (1 << 64) - 1).count("1") <= limit:
                found.add((a[0], b[0]))
    return found


@pytest.mark.parametrize("window", [4, 64])
def test_window_pairs_match_the_sorted_scan(spark, window):
    rows = [item(i, f"s{i % 40}", h) for i, h in enumerate(random_hashes(5, 150, 6))]
    pairs = near_window_pairs(rank_by_hash(frame(spark, rows)), window=window).collect()
    got = {(r["media_id_a"], r["media_id_b"]) for r in pairs}
    assert got == window_pairs_by_hand(rows, window, 6) and len(pairs) == len(got)


@pytest.mark.parametrize("crowded", [1, 8, 1024])
@pytest.mark.parametrize("limit", [3, 6])
def test_banded_pairs_find_everything_once_at_every_depth(spark, crowded, limit):
    hashes = sorted(set(random_hashes(9, 220, 5)))
    rows = [item(i, f"s{i}", h) for i, h in enumerate(hashes)]
    got = [tuple(sorted((r["dhash_a"], r["dhash_b"]))) for r in near_banded_pairs(hash_groups(frame(spark, rows)), limit, crowded).collect()]
    want = {
        tuple(sorted((signed(a), signed(b))))
        for i, a in enumerate(hashes)
        for b in hashes[:i]
        if bin(a ^ b).count("1") <= limit
    }
    assert len(got) == len(set(got)) and set(got) == want
    links = near_banded_pairs(hash_groups(frame(spark, rows)), limit, crowded, links_only=True).collect()
    assert union_find([tuple(r) for r in links]) == union_find(want)


def test_banded_groups_contain_the_windowed_ones_and_join_equal_hashes(spark):
    rows = [item(i, f"s{i % 50}", h) for i, h in enumerate(random_hashes(2, 120, 10))]
    rows += [item(900 + i, f"same{i % 2}", 0xF0F0F0F0F0F0F0F0) for i in range(6)] + [item(990 + i, "lone", 0x0123456789ABCDEF) for i in range(3)]
    df = frame(spark, rows)
    members = {}
    for mode in ("window", "banded"):
        for hot_rows in (2, 10**6):
            groups, rows_ = dedup.near_dedup(df, mode=mode, hot_rows=hot_rows)
            sets = {}
            for r in rows_.collect():
                sets.setdefault(r["group_id"], set()).add(r["media_id"])
            assert {g["group_id"]: g["member_count"] for g in groups.collect()} == {k: len(v) for k, v in sets.items()}
            assert members.setdefault(mode, sets) == sets
    for small in members["window"].values():
        assert any(small <= big for big in members["banded"].values())
    assert {f"m{900 + i:04d}" for i in range(6)} in members["banded"].values()
    assert not any("m0990" in s for s in members["banded"].values())  # one content is no near duplicate


def test_near_groups_leave_out_the_sentinel_videos_and_other_libraries(spark):
    rows = [item(1, "a", 0), item(2, "b", 0), item(3, "c", 7, kind="VIDEO"), item(4, "d", 7), item(5, "e", 7, library="x")]
    df = frame(spark, rows)
    assert near_candidates(df).count() == 2
    assert dedup.near_dedup(df, library="l")[0].count() == 0
    assert dedup.near_dedup(df)[0].collect()[0]["member_count"] == 2


def test_chained_member_may_exceed_the_limit_and_reasons_say_so(spark):
    rows = [item(1, "a", 0b111111, size=5000), item(2, "b", 0b111111000000 | 1), item(3, "c", 0b111111)]
    rows[1] = item(2, "b", 0b111111 ^ 0b111110000000)
    rows.append(item(4, "d", 0b111111 ^ 0b111110000000 ^ (0b111111 << 20)))
    rows.sort()
    groups, members = dedup.near_dedup(frame(spark, rows))
    assert groups.collect()[0]["best_media_id"] == "m0001"
    by_id = {r["media_id"]: r for r in members.collect()}
    assert by_id["m0001"]["reason"] == "best of cluster" and by_id["m0001"]["score"] == 1.0
    assert by_id["m0004"]["reason"] == "hamming=11" and by_id["m0004"]["score"] == 1 - 11 / 64


def test_keep_score_order(spark):
    rows = [
        item(1, "a", path="/x/WhatsApp/big.jpg", w=4000, h=3000),
        item(2, "a", path="/x/dcim/small.jpg", w=4000, h=2800),
        item(3, "a", path="/x/DCIM/Sent/both.jpg", w=4000, h=2800),
        item(4, "a", path="/x/none.jpg", w=None, h=None, size=10**9),
    ]
    best = dedup.pick_best(frame(spark, rows), "sha256").head()
    assert best["best_media_id"] == "m0002" and best["score"] == 4000 * 2800 + 0.1 + 1_000_000
    ties = [item(2, "t", size=10), item(1, "t", size=10), item(3, "t", w=0, h=5, size=10)]
    assert dedup.pick_best(frame(spark, ties), "sha256").head()["best_media_id"] == "m0001"
    # the larger file wins at equal score: 100 pixels less, 1,000,000 bytes more
    traded = [item(1, "t", w=200, h=1, size=0), item(2, "t", w=100, h=1, size=1_000_000)]
    assert dedup.pick_best(frame(spark, traded), "sha256").head()["best_media_id"] == "m0002"


@pytest.mark.parametrize("hot_rows", [2, 10**6])
def test_exact_groups_scope_and_members(spark, hot_rows):
    rows = [item(i, "hot", size=100 + i) for i in range(40)] + [item(50, "one"), item(51, "p", library="x"), item(52, "p")]
    df = frame(spark, rows)
    groups = {g["group_id"]: g for g in dedup.exact_dup_groups(df).collect()}
    assert {g["member_count"] for g in groups.values()} == {40, 2}
    members = dedup.exact_dup_members(df, hot_rows=hot_rows).collect()
    assert len(members) == 42 and sum(m["reason"] == "best candidate" for m in members) == 2
    assert [g["member_count"] for g in dedup.exact_dup_groups(df, "l").collect()] == [40]
    assert dedup.exact_dup_groups(df, "x", members_scope="all").count() == 0
    wide = frame(spark, rows + [item(53, "p", library="x")])
    assert [g["member_count"] for g in dedup.exact_dup_groups(wide, "x", members_scope="all").collect()] == [3]
    totals = dedup.dup_totals(dedup.exact_dup_groups(df)).head()
    assert totals["members"] == 42 and totals["bytes_recoverable"] == sum(100 + i for i in range(39)) + 1000
    assert dedup.exact_dup_groups(df, prefix="dg_e_", digits=12).filter("length(group_id) > 17").count() == 0


def test_largest_file_and_best_score_may_differ_and_actions_follow_the_file(spark):
    rows = [item(1, "a", path="/x/DCIM/1.jpg", size=10), item(2, "a", path="/x/2.jpg", size=20)]
    df = frame(spark, rows).withColumn("last_modified", F.lit("2024-01-01").cast("timestamp"))
    groups, members = dedup.exact_dup_groups(df), dedup.exact_dup_members(df)
    facts = dedup.member_rows(groups, members, df)
    assert groups.head()["best_media_id"] == "m0001"
    assert dedup.dup_recommended_by_size(facts).head()["recommended_id"] == "m0002"
    staged = spark.createDataFrame([("m0002",)], "media_id string")
    actions = {r["media_id"]: r["action"] for r in staging.stage_group_actions(facts, staged).collect()}
    assert actions == {"m0001": "trash", "m0002": "trash"}
    removed = staging.remove_items(df, groups, members, staged, staged)
    assert [d.count() for d in removed] == [1, 0, 0, 0]


def brute_l2(vectors, eps):
    v = np.array(vectors)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    return {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if d[i, j] < eps}


@pytest.mark.parametrize("tuning", [{}, {"cell_rows": 20, "block_rows": 7}, {"cell_rows": 5, "block_rows": 1000}])
@pytest.mark.parametrize("spread", [0.05, 0.6])
def test_l2_pairs_match_all_pairs(spark, tuning, spread):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 8))
    vectors = (centres[rng.integers(0, 6, 160)] + rng.normal(size=(160, 8)) * spread).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id long, v array<double>")
    got = [(r["a"], r["b"]) for r in l2_pairs(distinct_vectors(df, "id", "v"), 0.55, **tuning).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_l2(vectors, 0.55)
    labels = {r["id"]: r["component"] for r in vector_components(df, "id", "v", 0.55, **tuning).collect()}
    assert labels == union_find(brute_l2(vectors, 0.55))


@pytest.mark.parametrize("far", [0.0, 1e4])
def test_blocks_meet_in_a_nested_loop_without_copies_of_rows(spark, far):
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(700, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[350:] += far  # single precision does not do where both kinds meet
    vectors[3], vectors[4, 2], vectors[5, 0] = np.nan, np.inf, 1e200
    with np.errstate(all="ignore"):
        want = brute_l2(vectors, 0.9)
    assert len(want) > 500
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "id long, v array<double>")
    tuning = {"cell_rows": 60, "block_rows": 10}
    pairs = l2_pairs(distinct_vectors(df, "id", "v"), 0.9, **tuning)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "FlatMapGroups" not in plan
    got = [(r["a"], r["b"]) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    copied = l2_pairs(distinct_vectors(df, "id", "v"), 0.9, most_copies=1e9, **tuning)
    assert "Cartesian" not in copied._jdf.queryExecution().executedPlan().toString()
    assert {(r["a"], r["b"]) for r in copied.collect()} == want
    links = l2_pairs(distinct_vectors(df, "id", "v"), 0.9, links_only=True, **tuning).collect()
    assert {(r["a"], r["b"]) for r in links} <= {(a, b) for a in range(700) for b in range(a, 700)}
    labels = {r["id"]: r["component"] for r in vector_components(df, "id", "v", 0.9, **tuning).collect()}
    assert labels == union_find(want)


def test_links_of_a_task_are_handed_on_before_too_many_rows_are_held(monkeypatch):
    import pyarrow as pa

    from silverprint.operators import vector_pairs as v

    monkeypatch.setattr(v, "_LABELS_AT_ONCE", 20)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(90, 3)) * 0.3
    want = brute_l2(vectors, 0.3)
    blocks = [np.arange(k, k + 10) for k in range(0, 90, 10)]

    def column(k, rows, end):
        middle = vectors[rows].mean(0)
        radius = np.sqrt(((vectors[rows] - middle) ** 2).sum(1).max())
        values = {"block": k, "middle": middle, "radius": radius, "ids": rows, "vectors": vectors[rows].tobytes()}
        return {f"{name}_{end}": pa.array([value]) for name, value in values.items()}

    rows = [column(k, a, "a") | column(n, b, "b") for k, a in enumerate(blocks) for n, b in enumerate(blocks) if k <= n]
    batches = [pa.RecordBatch.from_pydict(row) for row in rows]
    for links_only in (False, True):
        out = pa.Table.from_batches(list(v._meet(0.3, links_only)(iter(batches)))).to_pydict()
        got = {tuple(sorted(p)) for p in zip(out["a"], out["b"])}
        if links_only:
            assert union_find(got) == union_find(want)
        else:
            assert len(out["a"]) == len(got) and got == want


def test_a_vector_is_scaled_by_a_length_taken_once(spark):
    import time

    from silverprint.functions.vectors import l2_normalize

    size = 20_000
    began = time.time()
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda x: x.cast("float")).alias("v"))
    got = df.select(l2_normalize(F.col("v")).alias("v"), l2_normalize(F.lit(None).cast("array<float>")).alias("none")).head()
    assert time.time() - began < 30  # a length for each element would be 800 million steps
    want = np.arange(1.0, size + 1)
    assert got["none"] is None and np.allclose(got["v"], want / np.sqrt((want**2).sum()), rtol=1e-12, atol=0)


def test_copies_of_a_vector_cost_one_node(spark):
    rows = [(i, [1.0, 0.0]) for i in range(50)] + [(100, [0.0, 1.0]), (101, [0.0, 0.99]), (200, [5.0, 5.0]), (300, None), (301, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert distinct_vectors(df, "id", "v").count() == 4
    labels = {r["id"]: r["component"] for r in vector_components(df, "id", "v", 0.55).collect()}
    assert labels == {**{i: 0 for i in range(50)}, 100: 100, 101: 100}
    empty = df.filter("id > 299")
    assert vector_components(empty, "id", "v", 0.55).count() == 0


def test_similar_pairs_bound_is_inclusive(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.92, (1 - 0.92**2) ** 0.5]), (3, [0.0, 1.0])], "id long, v array<double>")
    assert [(r["a"], r["b"]) for r in similar_pairs(df, "id", "v", 0.919999).collect()] == [(1, 2)]
    assert similar_pairs(df, "id", "v", 0.93).count() == 0


def test_face_clusters_rank_by_faces_and_size_counts_items(spark):
    def face(x):
        return (0, 0, 1, 1, [float(x), 0.0])

    rows = [("a", [face(0), face(0.1)]), ("b", [face(5)]), ("c", [face(5.1), face(5.2)]), ("d", [face(9)]), ("e", []), ("f", None)]
    items = spark.createDataFrame(rows, "media_id string, faces array<struct<x:int,y:int,w:int,h:int,descriptor:array<float>>>")
    tagged = people.tag_clusters(people.explode_faces(items))
    clusters = [tuple(r) for r in people.face_clusters(tagged).orderBy("id").collect()]
    assert [(c[0], c[2], c[3], c[4], c[5]) for c in clusters] == [("person-1", "b", 0, 3, 2), ("person-2", "a", 0, 2, 1)]
    assert [r["media_id"] for r in people.solo_faces(items, tagged).collect()] == ["d"]
    assert people.faces_total(items).head()[0] == 6


@pytest.mark.parametrize("links_only", [False, True])
def test_vector_tasks_hand_on_bounded_pieces(links_only):
    import numpy as np
    import pandas as pd

    from silverprint.operators import vector_pairs as v

    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1_500, 24)) * 0.02
    rows = pd.DataFrame({"rep": [f"v{i:05d}" for i in range(len(vectors))], "vec": list(vectors)})
    # all rows lie so near to each other that each visits every lower cell
    placed = list(v._place(vectors[:40].copy(), 0.5)(iter([rows])))
    assert max(map(len, placed)) <= v._ROWS_OUT
    both = pd.concat(placed)
    assert len(both) > 10 * len(rows) and (~both["visitor"].astype(bool)).sum() == len(rows)
    assert not both.duplicated(["cell", "rep"]).any()

    block = rows.assign(side=0, same=True)
    eps = 0.135
    out = list(v._compare(eps, links_only)(iter([block.iloc[:700], block.iloc[700:]])))
    assert max(map(len, out)) <= max(len(rows), v._VALUES_AT_ONCE // 24)
    want = {(i, j) for i, x in enumerate(vectors) for j in np.flatnonzero(np.sqrt(((vectors - x) ** 2).sum(1)) < eps) if i < j}
    got = [(int(a[1:]), int(b[1:])) for a, b in pd.concat(out)[["a", "b"]].itertuples(index=False)]
    assert all(a < b for a, b in got)
    if not links_only:
        assert len(out) > 1 and len(got) == len(set(got)) and set(got) == want
        return
    assert len(got) < len(rows) < len(want)

    def roots(links):
        root = list(range(len(rows)))
        def top(n):
            while root[n] != n:
                n = root[n]
            return n
        for a, b in links:
            a, b = sorted((top(a), top(b)))
            root[b] = a
        return [top(n) for n in range(len(rows))]

    assert roots(got) == roots(want)


def test_band_rows_carry_numbers_only_and_keep_the_rule_of_contents(spark):
    from silverprint.operators import hamming_pairs as h

    rows = [(1, "a", "a"), (3, "a", "a"), (7, "a", "b"), (15, None, None), (31, "b", "b"), (63, "b", "c"), (127, "b", "b")]
    groups = spark.createDataFrame(rows, "dhash long, sha_lo string, sha_hi string")
    slim = h._slim(groups).select("dhash", "content", "mixed", F.lit(0).cast("long").alias("key"), F.col("dhash").alias("rest"))
    keyed = h._expand(h._expand(slim, 0, 64, 6, 14), 1, 55, 6, 14)
    assert {f.dataType.simpleString() for f in keyed.schema} == {"bigint", "boolean"}

    def pair(a, b):
        (_, alo, ahi), (_, blo, bhi) = a, b
        if (alo and alo != ahi) or (blo and blo != bhi):
            return True
        return alo is not None and blo is not None and alo != blo  # an unknown content is like no other, and not unlike

    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and bin(a[0] ^ b[0]).count("1") <= 6 and pair(a, b)}
    for crowded in (1, 2, 1024):
        got = [(r.dhash_a, r.dhash_b) for r in near_banded_pairs(groups, 6, crowded).collect()]
        assert len(got) == len(set(got)) and set(got) == want
