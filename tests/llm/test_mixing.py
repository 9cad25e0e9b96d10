from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from silverprint.llm import mixing
from silverprint.llm.queries import QUERIES
from tests.llm.data import PLAIN, SCHEMA, awkward, prose, rows_of

SOURCES = "source string, weight double"


def brute_targets(sizes, weights, wanted, most):
    capped, target = set(), {}
    while True:
        rest = wanted - sum(most * sizes[s] for s in capped)
        weight = sum(weights[s] for s in sizes if s not in capped)
        target = {s: most * sizes[s] if s in capped else rest * weights[s] / weight for s in sizes}
        above = {s for s in sizes if s not in capped and target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


def brute_awards(target, cap, blocks):
    """Sources in the order in which they are awarded blocks, one by one."""
    have, order = dict.fromkeys(target, 0), []
    for _ in range(blocks):
        best = min((s for s in target if have[s] < cap[s] and target[s] > 0), key=lambda s: (-target[s] / (2 * have[s] + 1), s))
        have[best] += 1
        order.append(best)
    return order


def test_words_are_counted_as_the_pattern_does(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\t\n\x0b\x0c\r\x1c   ") for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None, "", " ", "a", None]
    column = pa.array(["left out", *texts]).slice(1)
    assert mixing.word_counts(column).tolist() == [len(PLAIN.findall(t or "")) for t in texts]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 64, 1000])
def test_permutations_are_bijective_and_differ_by_seed(n):
    at = np.arange(n)
    a, b = (mixing.permuted(at, np.full(n, n), np.full(n, seed, np.uint64)) for seed in (1, 2))
    assert sorted(a.tolist()) == sorted(b.tolist()) == at.tolist()
    assert n < 64 or (a != b).mean() > 0.9


@pytest.mark.parametrize("shards", [1, 7])
def test_quotas_are_those_of_awarding_one_block_after_the_other(spark, shards):
    rng = random.Random(shards)
    for n in (1, 3, 40):
        target = {f"={i:02}": rng.choice([0.0, 5.0, 100.0, rng.random() * 1000]) for i in range(n)} | {"": 100.0}
        cap = {s: rng.choice([0, 2, 10**6]) if rng.random() < 0.3 else 10**6 for s in target}
        cap[""] = 10**6
        for blocks in (1, 10, 500):
            sources = spark.createDataFrame([(s, target[s], cap[s]) for s in target], "key string, target double, cap long")
            got = {r.key: list(r.upto) for r in mixing.quotas(sources, blocks, shards).collect()}
            order = brute_awards(target, cap, blocks)
            for s in target:
                assert got[s] == [order[: (k + 1) * blocks // shards].count(s) for k in range(shards)]


def test_a_mix_takes_its_quotas_in_whole_blocks(spark):
    rng = random.Random(5)
    texts = prose(400, 3, words=120) + [None, "", "word " * 5_000]
    rows = [(i, t, "en", None if i % 7 == 6 else "hot" if i % 2 else f"s{i % 5}", 0) for i, t in enumerate(texts)]
    weights = {"hot": 1.0, None: 2.0, **{f"s{i}": float(rng.randint(1, 9)) for i in range(4)}}  # s4 has no weight
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rank", "2 as target").repartition(5)
    weighed = spark.createDataFrame(list(weights.items()), SOURCES)
    block, shards = 16, 5
    got = mixing.mix(docs, weighed, block=block, shards=shards).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(3), weighed, block=block, shards=shards).collect()))
    sizes = defaultdict(int)
    for i, t, _, s, _ in rows:
        sizes[s] += len(PLAIN.findall(t or ""))
    target = brute_targets({s: n for s, n in sizes.items() if s in weights}, weights, 1.5 * sum(sizes.values()), 2.0) | {"s4": 0.0}
    by_key = {("" if s is None else "=" + s): target[s] for s in sizes}
    cap = {("" if s is None else "=" + s): int(2 * sizes[s] // block) if target[s] else 0 for s in sizes}
    blocks = round(sum(min(by_key[k] / block, cap[k]) for k in cap))
    order = brute_awards(by_key, cap, blocks)
    taken, of_shard, length = defaultdict(int), defaultdict(int), {i: len(PLAIN.findall(t or "")) for i, t, *_ in rows}
    for r in got:
        assert (r.size, r.source_size) == (length[r.doc_id], sizes[r.source]) and abs(r.target - target[r.source]) < 1e-6
        assert r.taken == sum(p.words for p in r.pieces) <= 2 * r.size
        times = [0] * r.size
        for p in r.pieces:
            assert 0 <= p.first and p.first + p.words <= r.size
            of_shard[r.source, p.shard] += p.words
            for k in range(p.first, p.first + p.words):
                times[k] += 1
        assert max(times, default=0) <= 2
        taken[r.source] += r.taken
    for s in sizes:
        key = "" if s is None else "=" + s
        assert taken[s] == block * order.count(key) and abs(taken[s] - target[s]) <= 2 * block
        for k in range(shards):
            assert of_shard[s, k] == block * order[k * blocks // shards : (k + 1) * blocks // shards].count(key)


def test_a_mix_of_awkward_and_of_no_rows(spark):
    weights = spark.createDataFrame([("s", 1.0), (None, 1.0), ("en", 2.0)], SOURCES)
    docs = spark.createDataFrame(awkward(), SCHEMA)
    got = mixing.mix(docs, weights).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in awkward())
    assert all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(docs.limit(0), weights).isEmpty()
    assert [r.taken for r in mixing.mix(docs.filter("doc_id IN (1, 2)"), weights).collect()] == [0, 0]


def test_registered_mix_comes_near_its_targets(spark):
    rows = QUERIES["op11_source_mix"](spark, "/root/testdata/sf0.01").collect()
    source = defaultdict(lambda: [0, 0.0, 0])
    for r in rows:
        at = source[r.source_size, r.target]
        at[0], at[1], at[2] = at[0] + r.taken, r.target, at[2] + r.size
        assert 0 <= r.taken <= 2 * r.size
    assert len(rows) == 1000 and all(abs(t - want) <= 2 * mixing.BLOCK_WORDS for t, want, _ in source.values())
    assert abs(sum(want for _, want, _ in source.values()) - 1.5 * sum(r.size for r in rows)) < 1
