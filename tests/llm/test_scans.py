from __future__ import annotations

import hashlib
import random
import re

import pytest

from silverprint.llm import fingerprints, licenses
from tests.llm.data import CONTENT, SCHEMA, awkward, lowered, prose, rows_of


def brute_license(text):
    words = CONTENT.findall(lowered(text))
    starts, base, own, best = [], set(), set(), 0.0
    for t in (*licenses.PHRASES, *licenses.NOTICES):
        k = len(t.words)
        at = [i for i in range(len(words) - k + 1) if tuple(words[i : i + k]) == t.words]
        if t.phrase and at:
            starts += at
            base.add(t.label)
            best = 1.0
        for b in range(len(words)):
            common = len(t.tokens & set(words[b : b + 2 * k]))
            if not t.phrase and common >= t.needed:
                own.add(t.label)
                best = max(best, common / len(t.tokens))
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), best)


def test_license_scan_matches_brute_force(spark):
    rng = random.Random(2)
    pool = "gnu General public license LICENSE apache cc by mit licensed under the version 2 0 4 nc released x é".split()
    texts = [" ".join(rng.choice(pool) + rng.choice(["", ",", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(250)]
    texts += ["MIT\nLicense", "Licensed under CC BY-NC 4.0.", "GNU\x00General Public License", "cc by cc by", None]
    rows = rows_of(texts, 100) + [r for r in awkward() if r[0] not in (None, 4)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as words", "2 as blocks", "3 as labels")
    got = {r[0]: tuple(r)[1:] for r in licenses.scan(docs).collect()}
    assert got == {r[0]: brute_license(r[1]) for r in rows}


def test_a_notice_is_found_at_every_place_of_a_text(spark):
    text = "licensed under the terms of the cc by nc 4 0"
    rows = rows_of([" ".join(f"w{i}" for i in range(start)) + f" {text} and more of it" for start in range(30)])
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in got if "cc-by-nc-4.0" in r.labels and r.score == 1.0} == set(range(30))


def test_license_scan_of_an_empty_table_and_repeated_rows(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).isEmpty()
    assert licenses.scan(spark.createDataFrame(awkward(), SCHEMA)).count() == len(awkward())


def test_license_scan_runs_no_python(spark):
    plan = licenses.scan(spark.createDataFrame(rows_of(["mit license"]), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def jaccard(a, b):
    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("partitions", ["1", "8", "50"])
def test_fingerprints_estimate_jaccard_and_follow_descending_ids(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        texts = [*prose(120, 6, words=200), None, "", "one", "two words", "é" * 7]
        texts += [texts[0], texts[1] + " with a tail"]
        rows = [(7 * i - 60, t) for i, t in enumerate(texts)]
        got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ordered = sorted(((i, t or "") for i, t in rows), reverse=True)
    errors = []
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors += [abs(got[i].near_edited - jaccard(text, edited)), abs(got[i].near_next - jaccard(text, following))]
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.03
    assert got[rows[0][0]].fingerprint == got[rows[-2][0]].fingerprint
    assert len(got[rows[0][0]].fingerprint) == 2 * fingerprints.BINS


def test_fingerprints_of_awkward_rows(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA).selectExpr("*", "1 as print", "2 as next_text", "3 as _k")
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(awkward())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert {r.fingerprint for r in got if r.doc_id in (0, 1, 2)} == {""}
    assert fingerprints.fingerprints(docs.limit(0)).isEmpty()
    alone = fingerprints.fingerprints(spark.createDataFrame([(1, "the only text there is in here")], "doc_id long, text string")).collect()
    assert alone[0].near_next == 1.0
