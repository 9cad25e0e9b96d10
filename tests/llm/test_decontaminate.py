from __future__ import annotations

import random

import pytest

from silverprint.llm import decontaminate
from tests.llm.data import CONTENT, SCHEMA, awkward, lowered, prose, rows_of


def brute(docs, items, window):
    held = {}
    for item, text in items:
        words = CONTENT.findall(lowered(text))
        n = min(window, len(words))
        for at in range(len(words) - n + 1 if n else 0):
            held.setdefault(tuple(words[at : at + n]), set()).add(str(item))
    out = []
    for row in docs:
        words, hit, found = CONTENT.findall(lowered(row[1])), set(), set()
        for n in {len(k) for k in held}:
            for at in range(len(words) - n + 1):
                if (key := tuple(words[at : at + n])) in held:
                    hit.update(range(at, at + n))
                    found |= held[key]
        out.append((row[0], len(words), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def result(frame):
    return sorted(
        ((r.doc_id, r.n_words, sum(s["last"] - s["first"] + 1 for s in r.spans), tuple(r["items"])) for r in frame.collect()), key=repr
    )


@pytest.mark.parametrize("window, block", [(3, 10**6), (5, 10**6), (10, 10**6), (4, 25)])
def test_spans_and_items_match_brute_force(spark, monkeypatch, window, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rng = random.Random(window)
    line = lambda n: " ".join(rng.choice("aBc") for _ in range(n))
    items = [(i, line(rng.choice([0, 1, 2, 3, 4, 5, 7, 9]))) for i in range(12)] + [(50, None), (3, "x")]
    docs = [(i, line(rng.randint(0, 60))) for i in range(150)] + [(900, None), (901, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = result(decontaminate.find_overlaps(frame, spark.createDataFrame(items, "item_id long, text string"), window))
    assert got == brute(docs, items, window)


def test_awkward_rows_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA).selectExpr("*", "'x' as items", "1 as n_words")
    items = spark.createDataFrame([(1, "a document without id has words of its own", 5)], "item_id long, text string, spans int")
    got = decontaminate.find_overlaps(docs, items)
    assert got.count() == len(awkward())
    assert {r.doc_id for r in got.filter("size(spans) > 0").collect()} == {None, 6}
    assert decontaminate.find_overlaps(docs, items.limit(0)).filter("size(spans) > 0").isEmpty()
    assert decontaminate.find_overlaps(docs.limit(0), items).isEmpty()


def test_cut_removes_spans_and_drops_covered_documents(spark):
    base = prose(40, 5)
    item = " ".join(f"item{i}" for i in range(30))
    texts = [*base, f"{base[0]}\n{item}\n{base[1]} tail of the text", item, None, ""]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.cut_overlaps(docs, items, max_coverage=0.9).collect()}
    assert 41 not in got and got[40].text == f"{base[0]}\n{base[1]} tail of the text"
    assert all(got[i].text == texts[i] for i in got if i != 40) and len(got) == len(texts) - 1


def test_cut_is_repeated_where_both_sides_meet(spark):
    words = [f"w{i}" for i in range(12)]
    inner = " ".join(f"v{i}" for i in range(12))
    doc = " ".join(words[:6]) + " " + inner + " " + " ".join(words[6:]) + " " + " ".join(f"z{i}" for i in range(60))
    items = spark.createDataFrame([(1, " ".join(words)), (2, inner)], "item_id long, text string")
    got = decontaminate.cut_overlaps(spark.createDataFrame([(1, doc)], "doc_id long, text string"), items).collect()
    assert got[0].text.split() == [f"z{i}" for i in range(60)]


@pytest.mark.parametrize("seed", [1, 2])
def test_cut_does_not_depend_on_the_blocks_of_items(spark, monkeypatch, seed):
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choice("aBcd") for _ in range(n))
    items = spark.createDataFrame([(i, line(rng.choice([2, 4, 5, 7, 9]))) for i in range(14)], "item_id long, text string")
    rows = [(i, line(rng.randint(0, 60)), [i]) for i in range(200)] + [(900, None, [1]), (901, "", [2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans array<int>")
    cut = lambda: sorted((r.doc_id, r.text, r.spans) for r in decontaminate.cut_overlaps(docs, items, 4, 0.7).select(*docs.columns).collect())
    whole = cut()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 25)
    assert len(decontaminate.automata(items, 4)) > 1
    assert cut() == whole and 20 < len(whole) < len(rows)
