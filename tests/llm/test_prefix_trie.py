from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from silverprint.llm import prefix_trie
from silverprint.llm.queries import QUERIES

TURNS = "conv_id long, turns array<struct<key:string,words:long>>"
TABLE = "conv_id long, turn long, role string, text string, note string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_trie(convs):
    """``convs``: id to a tuple of (key, words)."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    rows = []
    for node, ids in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = lambda m: [k for k in members if len(k) == len(m) + 1 and k[: len(m)] == m]
        ends = ",".join(str(c) for c in sorted(ids) if convs[c] == node)
        rows.append((
            min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children(node)),
            sum(not children(m) for m in below), sum((len(members[m]) - 1) * m[-1][1] for m in below if m), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows, key=repr)


def rows_in(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("partitions", ["1", "3", "40"])
def test_trie_matches_brute_force(spark, partitions):
    rng = random.Random(int(partitions))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turn = [(f"k{i}", rng.randint(0, 9)) for i in range(4)]
        convs = {c: tuple(turn[min(int(rng.expovariate(1)), 3)] for _ in range(rng.randint(0, 7))) for c in rng.sample(range(-50, 2_000), 150)}
        convs |= {c: (turn[0],) * 6 for c in range(3_000, 3_060)}  # a hot group of copies
        convs[9_999] = tuple(turn[i % 2] for i in range(60))
        df = spark.createDataFrame([(c, list(t)) for c, t in convs.items()], TURNS)
        assert rows_in(prefix_trie.build_trie(df)) == brute_trie(convs)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_trie_of_few_rows(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.build_trie(empty).isEmpty()
    assert prefix_trie.build_trie(spark.createDataFrame([(None, []), (3, None)], TURNS)).isEmpty()
    assert rows_in(prefix_trie.build_trie(spark.createDataFrame([(3, [])], TURNS))) == brute_trie({3: ()})
    assert rows_in(prefix_trie.build_trie(spark.createDataFrame([(3, [("a", 2)]), (1, [("a", 2)])], TURNS))) == brute_trie({3: (("a", 2),), 1: (("a", 2),)})


def test_ids_of_a_hot_key_are_digested_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    rows = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("seq"), "id").repartition(9)
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r.id):
        want.setdefault(r.seq, []).append(str(r.id))
    got = {r.seq: r.ends_sha256 for r in prefix_trie.ids_digests(rows, "seq", "id").collect()}
    assert got == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}


def test_registered_trie_of_awkward_turns(spark, tmp_path):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a b", "", None, "c"]), "x") for c in range(60) for t in range(rng.randint(1, 5))]
    rows += [(7, None, "user", "null turn first", None), (None, 0, "user", "no conversation", None), (19, 0, "user", "word " * 20_000, None)]
    rows += [(21, 9, "ab", "c", None), (22, 9, "a", "bc", None)]
    spark.createDataFrame(rows, TABLE).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    own = {}
    for c, t, role, text, _ in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: sorted(v) for c, v in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        joined = own.get(c - c % 20, [])[:h] + turns[h:]
        convs[c] = tuple(((role, text), len(text.split())) for _, _, role, text in joined)
    assert rows_in(QUERIES["op13_prefix_trie"](spark, str(tmp_path))) == brute_trie(convs)
