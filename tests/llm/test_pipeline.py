from __future__ import annotations

import hashlib

import corpus_pipeline
from silverprint.llm import quality_rank, surrogates, word_bpe
from silverprint.llm.queries import QUERIES, SURROGATE_KEY, vocabulary
from tests.llm.test_decontaminate import brute as brute_spans
from tests.llm.test_near_dups import brute as brute_groups

SF_DIR = "/root/testdata/sf0.001"


def test_stages_match_plain_versions(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialise(stage(spark, docs, SF_DIR), "stage")
        assert after.columns == columns
        kept[name] = ({r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in after.collect()})
        docs = after
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    before, after = kept["quality classifier"]
    wrong = [i for i in before if i in labels and (i in after) != bool(labels[i])]
    assert len(wrong) <= 0.05 * len(labels)
    before, after = kept["near-dedup"]
    assert set(after) == {i for i, (_, _, own) in brute_groups([(i, t) for i, t in before.items()]).items() if own}
    before, after = kept["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    spans = {i: n for i, _, n, _ in brute_spans(list(before.items()), items, 10)}
    assert all(after[i] == before[i] for i in after if not spans[i]) and all(i in after for i in before if not spans[i])
    assert not any(n for _, _, n, _ in brute_spans(list(after.items()), items, 10))
    before, after = kept["personal data"]
    assert set(before) == set(after)
    for i, text in before.items():
        found = surrogates.detect(text)
        assert (after[i] == text) == (not found)
        assert not any(text[a:b] in after[i] for _, _, a, b in found)
    model = word_bpe.tokenizer(vocabulary("word_bpe_49k.json"))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert {r.doc_id for r in last} == set(after)
    for r in last:
        ids = model.encode(after[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_whole_run_equals_its_stages(spark):
    assert corpus_pipeline.run(spark, SF_DIR).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_every_operator_is_registered_and_runs(spark):
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    for name in ("op4_sharding", "op5_domain_scores", "op7_surrogates", "op9_quality_rank"):
        assert QUERIES[name](spark, SF_DIR).count() == rows
    assert quality_rank.CUT_SCORE == 0.3 and SURROGATE_KEY
