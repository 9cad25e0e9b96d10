from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from silverprint.llm import domain_scores, quality_rank, shards, surrogates
from tests.llm.data import CONTENT, SCHEMA, awkward, lowered, prose, rows_of


# sharding


@pytest.mark.parametrize("n, count", [(0, 5), (3, 5), (997, 24)])
def test_shards_are_exact_and_slots_have_no_gap(spark, n, count):
    rows = spark.range(n, numPartitions=7).selectExpr("id", "id % 3 as shard", "'x' as slot")
    got = shards.shuffle_into(rows, count, seed=3).collect()
    assert sorted(r.id for r in got) == list(range(n))
    sizes = Counter(r.shard for r in got)
    assert all(sizes[s] == n // count + (s < n % count) for s in range(count))
    for s in range(count):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_shuffle_is_uniform_and_repeated_rows_stay(spark):
    rows = spark.createDataFrame(awkward(), SCHEMA)
    got = shards.shuffle_into(rows, 4)
    assert got.count() == len(awkward()) and got.columns[:5] == rows.columns
    placed = Counter()
    for seed in range(12):
        for r in shards.shuffle_into(spark.range(400, numPartitions=4), 2, seed).collect():
            placed[r.id // 100, r.shard, r.slot // 100] += 1
    # 4 sources by 4 ranges of places: 300 each
    assert all(220 < placed[source, shard, part] < 380 for source in range(4) for shard in range(2) for part in range(2))


def test_hypergeometric_has_the_right_law_and_no_size_limit():
    rng = np.random.default_rng(1)
    drawn = Counter(shards.hypergeometric(rng, 6, 9, 5) for _ in range(20_000))
    for k in range(6):
        assert abs(drawn[k] / 20_000 - math.comb(6, k) * math.comb(9, 5 - k) / math.comb(15, 5)) < 0.015
    large = [shards.hypergeometric(rng, 10**11, 3 * 10**11, 10**9) for _ in range(50)]
    assert abs(np.mean(large) / 2.5e8 - 1) < 1e-3
    matrix = np.array(shards.communication_matrix([50, 0, 30, 21], [34, 34, 33], 2))
    assert matrix.sum(1).tolist() == [50, 0, 30, 21] and matrix.sum(0).tolist() == [34, 34, 33]


def test_written_shards_read_back(spark, tmp_path):
    path = str(tmp_path / "shards")
    shards.write_shards(spark.createDataFrame(rows_of(prose(50, 1)), SCHEMA), path, 3)
    back = spark.read.parquet(path)
    assert back.count() == 50 and sorted(Counter(r.shard for r in back.collect()).values()) == [16, 17, 17]


def test_the_query_shuffles_documents_with_their_texts(spark, monkeypatch):
    from silverprint.llm import queries

    placed = []
    shuffle = shards.shuffle_into
    monkeypatch.setattr(queries.shards, "shuffle_into", lambda rows, n: placed.append(shuffle(rows, n)) or placed[0])
    got = {(r.doc_id, r.size, r.text_crc32) for r in queries.op4(spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in placed[0].collect()}
    assert got == {(i, len(t) + 8, zlib.crc32(t)) for i, t in texts.items()}


# domain scores


def test_domain_scores_match_a_plain_model(spark):
    texts = [*prose(60, 1, words=30, vocabulary=40), None, "", "--", "lone"]
    rows = [(i, t, i % 3 == 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good boolean")
    model = domain_scores.fit(docs, "good", vocabulary=20)
    counts = Counter(w for _, t, _ in rows for w in CONTENT.findall(lowered(t)))
    known = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:20]]
    assert {w.encode() for w in known} == set(model.ids)

    def codes(text):
        return ["<s>", *(w if w in known else "<other>" for w in CONTENT.findall(lowered(text)))]

    def plain(chosen):
        pairs = Counter(p for _, t, g in rows if chosen(g) for p in zip(codes(t), codes(t)[1:]))
        ends, after, kinds = Counter(), Counter(), Counter()
        for (h, w), n in pairs.items():
            ends[w] += n
            after[h] += n
            kinds[h] += 1
        total = sum(ends.values()) + 21
        return lambda h, w: -math.log((pairs[h, w] + max(kinds[h], 1) * (ends[w] + 1) / total) / (after[h] + max(kinds[h], 1)))

    wanted, everything = plain(bool), plain(lambda g: True)
    for r in domain_scores.score(docs, model).collect():
        c = codes(r.text)
        n = len(c) - 1
        a, b = (sum(loss(h, w) for h, w in zip(c, c[1:])) / max(n, 1) for loss in (wanted, everything))
        assert r.n_tokens == n
        assert r.target_loss == pytest.approx(a, rel=1e-4, abs=1e-9) and r.score == pytest.approx(b - a, rel=1e-2, abs=1e-4)


def test_domain_scores_prefer_the_target(spark):
    good, other = prose(80, 1, vocabulary=60), prose(160, 2, vocabulary=60)
    docs = spark.createDataFrame([(i, t, i < 60) for i, t in enumerate([*good, *other])], "doc_id long, text string, good boolean")
    scores = {r.doc_id: r.score for r in domain_scores.score(docs, domain_scores.fit(docs, "good")).collect()}
    assert min(scores[i] for i in range(60, 80)) > max(scores[i] for i in range(80, 240)) - 1.0
    assert np.mean([scores[i] for i in range(60, 80)]) > np.mean([scores[i] for i in range(80, 240)]) + 0.5
    empty = docs.limit(0)
    assert domain_scores.score(empty, domain_scores.fit(empty, "good")).isEmpty()
    odd = spark.createDataFrame(awkward(), SCHEMA).selectExpr("*", "true as good", "1 as score")
    assert domain_scores.score(odd, domain_scores.fit(odd, "good")).count() == len(awkward())


def test_rare_words_have_losses_of_their_own(spark):
    common = " ".join(f"c{i}" for i in range(2100))
    rows = [(i, f"{common} {common}", False) for i in range(2)] + [(2, "rare steel", True), (3, "rare steel", False), (4, "other wool", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good boolean")
    model = domain_scores.fit(docs, "good")
    got = {r.doc_id: r.score for r in domain_scores.score(docs, model).collect()}
    assert got[2] == got[3] > got[4] + 1
    assert got == pytest.approx({r.doc_id: r.score for r in domain_scores.score(docs, model, seen=True, keep_text=False).collect()})
    new = docs.limit(0).union(spark.createDataFrame([(5, "never seen rare", None)], docs.schema))
    assert domain_scores.score(new, model).first().background_loss > 0


@pytest.mark.parametrize("group, partitions", [(domain_scores.GROUP, 1), (domain_scores.GROUP, 5), (40, 5), (3, 4)])
def test_own_scores_are_those_of_fit_and_score(spark, group, partitions):
    common = [f"the of {t} the the {t[:9]} of" for t in prose(80, 3, vocabulary=90)]
    rows = [*awkward(), *rows_of([*prose(150, 4, vocabulary=300), *common, None, "", "the the", "only here"], 100)]
    # made-up frequent words, so that some are spread over groups; a chosen id without a document and one with two
    docs = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    chosen = spark.createDataFrame([(i,) for i in [None, 4, 4, 9999, 333, *range(100, 320, 3)]], "doc_id long")
    marked = docs.join(chosen.distinct().withColumn("good", F.lit(True)), "doc_id", "left")
    plain = domain_scores.score(marked, domain_scores.fit(marked, "good")).collect()
    got = domain_scores.score_own(docs.withColumn("score", F.lit("x")), chosen, group=group)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "target_loss", "background_loss", "score"]

    def ordered(found):
        return sorted(found, key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.n_tokens))

    got, plain = ordered(got.collect()), ordered(plain)
    assert len(got) == len(rows) and sum(r.n_tokens == 0 for r in got) >= 5
    assert [r[:5] for r in got] == [(r.doc_id, r.lang, r.source, r.n_chars, r.n_tokens) for r in plain]
    for c in ("target_loss", "background_loss", "score"):
        assert [r[c] for r in got] == pytest.approx([r[c] for r in plain], rel=1e-5, abs=1e-6)


def test_own_scores_of_nothing_and_of_no_words(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert domain_scores.score_own(empty, empty).isEmpty()
    blank = spark.createDataFrame(rows_of([None, "", "--"]), SCHEMA)
    assert [tuple(r)[4:] for r in domain_scores.score_own(blank, blank).collect()] == [(0, 0.0, 0.0, 0.0)] * 3
    texts = spark.createDataFrame(rows_of(["a b", "b a"]), SCHEMA)
    assert all(r.target_loss > 0 for r in domain_scores.score_own(texts, empty).collect())


def test_packed_numbers_of_any_size_come_back():
    values = np.array([0, 127, 128, 1 << 28, 5, (1 << 62) + 3, 1], np.int64)
    packed = domain_scores._packed(values, np.array([0, 2, 2, 6, 7]))
    assert [len(p) for p in packed] == [2, 0, 2 + 5 + 1 + 9, 1]
    numbers, offsets = domain_scores._unpacked(packed)
    assert numbers.tolist() == values.tolist() and offsets.tolist() == [0, 2, 2, 6, 7]


def test_query_moves_no_row_a_bigram_and_no_text(spark, monkeypatch):
    from silverprint.llm import queries

    tables = []
    store = domain_scores.materialise
    monkeypatch.setattr(domain_scores, "materialise", lambda rows, label: tables.append(store(rows, label)) or tables[-1])
    found = queries.op5(spark, "/root/testdata/sf0.001")
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    words = [CONTENT.findall(lowered(t)) for t in texts]
    bigrams = {p for of in words for p in zip(["", *of], of)}
    assert found.count() == len(texts)
    assert max(t.count() for t in tables) < len(bigrams)
    assert all("text" not in t.columns for t in tables)


# quality ranking


def labelled(n=700, seed=5):
    clean, rows, labels = prose(n, seed, words=80), [], []
    for i, text in enumerate(clean):
        bad = i % 4 == 0
        words = text.split()
        rows.append((i, " ".join(w + "$$$" for w in words) if bad and i % 8 else " | ".join(words[:1] * len(words)) if bad else text.capitalize() + "."))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_ranking_tells_held_out_documents_apart(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranking = quality_rank.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    scores = {r.doc_id: r.score for r in quality_rank.score(docs, ranking).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [(scores[i] >= quality_rank.CUT_SCORE) == bool(labels[i][1]) for i in held]
    assert len(held) > 80 and np.mean(right) > 0.95
    assert all(0 <= s <= 1 for s in scores.values())


def test_held_out_labels_change_nothing(spark):
    rows, labels = labelled(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    a, b = (quality_rank.fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned))
    assert np.allclose(a.weights, b.weights) and a.cut == b.cut


def test_ranking_without_pairs_and_awkward_rows(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA).selectExpr("*", "1 as score")
    none = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    ranking = quality_rank.fit(docs, none)
    assert all(r.score == pytest.approx(quality_rank.CUT_SCORE) for r in quality_rank.score(docs, ranking).collect())
    assert quality_rank.keep_good(docs.limit(0), ranking).isEmpty()
    assert quality_rank.score(docs, ranking).count() == len(awkward())


# surrogates

KEY = b"key of the tests"


def test_entities_are_found_in_their_kinds():
    text = (
        'Call +1 (017) 555-7713, mail Bob.Smith@mail7.example.com, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962", '
        "card 4111 1111 1111 1111, 10.2.3.4, 123-45-6789, Mrs. Anna Smith-Jones met Mr Ivan Petrov. Госпожа Анна Иванова. "
        "DE89 3704 0044 0532 0130 00. Version 2.0 of 2024-01-02 10:30 cost 3.14159 for 1234567 units."
    )
    assert [(k, text[a:b]) for k, _, a, b in surrogates.detect(text)] == [
        ("phone", "+1 (017) 555-7713"), ("email", "Bob.Smith@mail7.example.com"), ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"),
        ("card", "4111 1111 1111 1111"), ("ip", "10.2.3.4"), ("ssn", "123-45-6789"), ("person", "Anna Smith-Jones"),
        ("person", "Ivan Petrov"), ("person", "Анна Иванова"), ("iban", "DE89 3704 0044 0532 0130 00"),
    ]


@pytest.mark.parametrize(
    "text, names",
    [
        ("Mr. Smith and Mrs. Jones", ["Smith", "Jones"]),
        ("Mrs. Smith met Mr Petrov", ["Smith", "Petrov"]),
        ("Mr and Mrs Smith", ["Smith"]),
        ("Dear Mr Smith Mrs Jones Herr Weber", ["Smith", "Jones", "Weber"]),
        ("Prof. Dr. Anna Maria Schmidt came", ["Anna Maria Schmidt"]),
        ("Ms Anna-maria O'Neil and Dr. Éva Ágh", ["Anna-maria O'Neil", "Éva Ágh"]),
        ("Господин Петров и Госпожа Анна Иванова", ["Петров", "Анна Иванова"]),
    ],
)
def test_every_titled_person_is_found(text, names):
    assert [text[a:b] for kind, _, a, b in surrogates.detect(text) if kind == "person"] == names


def test_surrogates_keep_format_gender_script_and_coreference(spark):
    texts = [
        "Mrs. Anna Smith wrote to anna.smith@mail.example.com and ANNA.SMITH@mail.example.com",
        "Call +1 (017) 555-7713 or +1 017-555-7713 today", "4111 1111 1111 1111 is 4111111111111111",
        "Госпожа Анна Иванова", "nothing to see here", None, "", "x " * 50_000 + "12.34.56.78",
    ]
    rows = rows_of(texts) + [(None, texts[1], None, None, None), *rows_of([texts[1]], 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n_entities", "'k' as kind", "2 as uses")
    got = sorted(surrogates.replace_personal_data(docs, KEY).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert len(got) == len(rows) and set(got[0].asDict()) == set(docs.columns)
    by_id = {r.doc_id: r for r in got}
    first = by_id[0].text.split()
    assert "Anna" not in by_id[0].text and first[1].endswith("a") and first[5].lower() == first[7].lower() and first[7].split("@")[0].isupper() and first[5].islower()
    phones = [x for x in by_id[1].text.replace("(", "").replace(")", "").replace("Call ", "").replace(" today", "").split(" or ")]
    digits = ["".join(c for c in p if c.isdigit()) for p in phones]
    assert digits[0] == digits[1] != "10175557713" and by_id[1].text.startswith("Call +1 (") and by_id[None].text == by_id[1].text
    card = by_id[2].text.split(" is ")
    assert card[0].replace(" ", "") == card[1] and surrogates._luhn(card[1]) == 0 and card[1] != "4111111111111111"
    assert all("а" <= c.lower() <= "я" for c in by_id[3].text.split()[1])
    assert by_id[4].text == texts[4] and by_id[5].text is None and by_id[6].text == "" and by_id[7].text.startswith("x x ")
    assert by_id[4].n_entities == 0 and by_id[0].n_entities == 3
    assert surrogates.replace_personal_data(docs.limit(0), KEY).isEmpty()


def test_colliding_surrogates_are_drawn_again(spark, monkeypatch):
    def crowded(key, kind, norm, attempt):
        return str(10 + (int(norm) + attempt * 7) % (8 + 20 * attempt))

    monkeypatch.setattr(surrogates, "surrogate", crowded)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(surrogates)
    try:
        table = spark.createDataFrame([("card", str(10 + i), 1) for i in range(20)], "kind string, norm string, uses long")
        got = surrogates.surrogate_table(table, KEY).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(surrogates)
    assert len(got) == 20 and len({r.surrogate for r in got}) == 20
    assert not {r.surrogate for r in got} & {r.norm for r in got}


@pytest.mark.parametrize(
    "kind, norm",
    [("phone", "+1234"), ("phone", "+10000"), ("card", "4111111111111111"), ("ssn", "123456789"), ("iban", "de89370400440532013000"), ("ip", "1.2.3.4"), ("secret", "=" * 16), ("email", "a@b.com"), ("person", "f:a")],
)
def test_every_kind_has_more_room_with_each_attempt(kind, norm):
    lengths = [len(surrogates.surrogate(KEY, kind, norm, attempt)) for attempt in range(4, 20)]
    assert all(a < b for a, b in zip(lengths, lengths[1:]))


def test_surrogates_are_found_where_a_format_is_used_up(spark):
    texts = [*(f"see +12{i:02d} there" for i in range(100)), "key = ----------------"]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = [r.text for r in surrogates.replace_personal_data(docs, KEY).collect()]
    assert len(set(got)) == 101 and not set(got) & set(texts)
    assert sum(t.startswith("see +12") and t.endswith(" there") for t in got) == 100


def test_ranking_weights_are_those_of_a_plain_bradley_terry_fit():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 272)).astype(np.float32)
    better = x[:, :3].sum(1) + rng.normal(size=300) > 0.5
    got = quality_rank.rank(x, better, pairs=2_500)
    good, bad = np.flatnonzero(better), np.flatnonzero(~better)
    draw = np.random.default_rng(7)
    up = np.concatenate([draw.permutation(good) for _ in range(-(-2_500 // len(good)))])[:2_500]
    down = np.concatenate([draw.permutation(bad) for _ in range(-(-2_500 // len(bad)))])[:2_500]
    z = (x - x.mean(0)) / (x.std(0) + 1e-3)
    d = (z[up] - z[down]).astype(np.float64)
    w = np.zeros(272)
    for _ in range(40):  # gradient of the mean loss and its penalty, Newton steps on all pairs at once
        p = 1 / (1 + np.exp(-d @ w))
        w -= np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + quality_rank.PENALTY * np.eye(272), d.T @ (p - 1) / len(d) + quality_rank.PENALTY * w)
    assert np.allclose(got.weights, w, atol=1e-4)
