from __future__ import annotations

import random

import pytest

from silverprint.llm import word_runs
from tests.llm.data import PLAIN, SCHEMA, awkward, rows_of


def brute_runs(words, least=6, power=4):
    n, found = len(words), {}
    for q in range(1, n // power + 1):
        i = q
        while i < n:
            k = i
            while k < n and words[k] == words[k - q]:
                k += 1
            if k - i + q >= max(least, power * q):
                found.setdefault((i - q, k - i + q), q)
            i = max(k, i) + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    words = []
    for _ in range(rng.randint(0, 6)):
        piece = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        words += piece * rng.randint(1, 7) + piece[: rng.randint(0, len(piece))]
    return words


@pytest.mark.parametrize("seed", range(40))
def test_runs_match_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(250):
        words = repetitive(rng) if rng.random() < 0.7 else [rng.choice("ab" if rng.random() < 0.9 else "abc") for _ in range(rng.randint(0, 70))]
        assert word_runs.find_runs(words) == brute_runs(words), words
        assert word_runs.find_runs(words, 4, 2) == brute_runs(words, 4, 2), words


def test_runs_within_runs():
    inner = ["a"] * 30 + ["b"]
    words = inner * 8 + ["c"] + ["a", "b"] * 9 + ["a"] * 11
    assert word_runs.find_runs(words) == brute_runs(words)
    long = (["x"] * 2_000 + ["y"]) * 5 + ["x"] * 50_000
    assert word_runs.find_runs(long) == [*[(k * 2_001, 2_000, 1) for k in range(5)][:1], (0, 5 * 2_001 + 2_000, 2_001), *[(k * 2_001, 2_000, 1) for k in range(1, 5)], (5 * 2_001, 50_000, 1)]


def test_kept_words_drop_all_but_the_first_period():
    rng = random.Random(3)
    for _ in range(300):
        words = repetitive(rng)
        runs = brute_runs(words)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert word_runs.kept_words(words, runs) == [w for i, w in enumerate(words) if i not in dropped]


def test_collapsed_documents(spark):
    rng = random.Random(8)
    texts = [" ".join(repetitive(rng)) for _ in range(200)] + ["go\tgo\ngo go GO go go go go go", " x  x"]
    docs = spark.createDataFrame([*rows_of(texts, 100), *awkward()], SCHEMA).selectExpr("*", "1 as runs", "2 as n_words").repartition(3)
    got = word_runs.collapse_runs(docs).collect()
    want = {}
    for row in [*rows_of(texts, 100), *awkward()]:
        words = PLAIN.findall(row[1] or "")
        runs = [(0, 60_000, 1)] if row[0] == 5 else brute_runs(words)
        want[row[0]] = (len(words), runs, " ".join(word_runs.kept_words(words, runs)))
    assert len(got) == len(texts) + len(awkward())
    for r in got:
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == want[r.doc_id]
    assert word_runs.collapse_runs(docs.limit(0)).isEmpty()
