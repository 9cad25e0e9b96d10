from __future__ import annotations

import random

import pytest

from silverprint.llm import near_dups
from tests.llm.data import PLAIN, SCHEMA, awkward, lowered, prose, rows_of, union_find


def shingles(text, size=5):
    words = PLAIN.findall(lowered(text))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows):
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    ids = sorted(sets)
    links = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    root = union_find(ids, links)
    return {i: (len(sets[i]), root[i], root[i] == i) for i in ids}


def result(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in frame.collect()}


def edited(text, edits, rng):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_components_match_brute_force_in_large_groups_at_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "SHORT", 8)  # so that the group takes the way of long lists
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    rng = random.Random(4)
    base = " ".join(prose(1, 9, words=2, vocabulary=300) + [f"b{i}" for i in range(120)])
    group = [edited(base, rng.randint(1, 6), rng) for _ in range(80)]
    second = [edited(g, 1, rng) for g in group[:25]]
    shared = " ".join(f"p{i}" for i in range(40))
    passages = [f"{t} {shared} {t}" for t in prose(40, 11, words=80)]
    texts = [*group, *second, *passages, *prose(60, 12), *group[:10], None, "", " ", "one", "One", "two words"]
    rows = rows_of(texts)
    assert result(near_dups.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_awkward_rows_and_clashing_columns(spark):
    rows = awkward()
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as component_id", "'x' as node", "2 as n")
    got = near_dups.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].component_id is None and by_id[None].kept
    assert by_id[6].component_id == 6 and by_id[0].n_shingles == 0 and by_id[5].n_shingles == 1
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in by_id.items() if i is not None} == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, "alone in the table", "en", "s", 1)]])
def test_empty_and_single(spark, rows):
    assert result(near_dups.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_long_words_of_two_letters_share_nothing(spark):
    """Two words on which sums of powers modulo 2^64 agree, whatever the base."""
    word = lambda flip: "".join("ab"[(i.bit_count() + flip) % 2] for i in range(512))
    rows = rows_of([word(0), word(1), word(0) + " x", word(0)])
    assert result(near_dups.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
