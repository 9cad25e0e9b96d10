"""Classification rules, text, path, time and vector expressions."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from silverprint.functions import paths, text, times, vectors
from silverprint.operators import classify, search, views
from silverprint.schema import enum_violations


def values(spark, inputs, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


SERVER = {
    "/lib/a/Screenshot_1.png": ("SCREENSHOT", "EPHEMERAL", 0.85),
    "/lib/screen shot 2.png": ("SCREENSHOT", "EPHEMERAL", 0.85),
    "/lib/My Screenshots old/x.png": ("SCREENSHOT", "EPHEMERAL", 0.85),
    "/lib/WhatsApp/Media/x.jpg": ("WHATSAPP_FORWARD", "EPHEMERAL", 0.7),
    "/lib/WHATSAPP/x.jpg": ("OTHER", "UNKNOWN", 0.0),
    "/lib/TelegramMedia/x.jpg": ("WHATSAPP_FORWARD", "EPHEMERAL", 0.7),
    "/lib/IMG-20240101-WA1.jpg": ("OTHER", "UNKNOWN", 0.0),
    "/lib/dcim/tax bill.jpg": ("PHOTO", "KEEP_LONG_TERM", 0.6),
    "/lib/100APPLE/x.jpg": ("PHOTO", "KEEP_LONG_TERM", 0.6),
    "/lib/Docs/receipt_2.jpg": ("OTHER", "UNKNOWN", 0.0),
    "/lib/Docs/receipt-2 scan.jpg": ("RECEIPT", "EPHEMERAL", 0.5),
    "/lib/Docs/PAN card.jpg": ("DOCUMENT", "EPHEMERAL", 0.5),
    "/lib/x/lol.gif": ("MEME", "EPHEMERAL", 0.5),
    "/lib/Download/x.jpg": ("OTHER", "EPHEMERAL", 0.3),
    "/lib/downloads/x.jpg": ("OTHER", "UNKNOWN", 0.0),
}
BROWSER = {
    "Screenshots/x.png": ("OTHER", "UNKNOWN", 0.0),
    "a/screenshots/x.png": ("SCREENSHOT", "EPHEMERAL", 0.85),
    "a/My Screenshots/x.png": ("OTHER", "UNKNOWN", 0.0),
    "WhatsApp/x.jpg": ("WHATSAPP_FORWARD", "EPHEMERAL", 0.75),
    "img-20240101-wa12.jpg": ("WHATSAPP_FORWARD", "EPHEMERAL", 0.75),
    "DCIM/tax bill.jpg": ("RECEIPT", "EPHEMERAL", 0.5),
    "DCIM/x.jpg": ("PHOTO", "KEEP_LONG_TERM", 0.6),
    "Downloads/x.jpg": ("OTHER", "EPHEMERAL", 0.3),
}


@pytest.mark.parametrize("rules, expected", [("server", SERVER), ("browser", BROWSER)])
def test_path_rules(spark, rules, expected):
    df = spark.createDataFrame([(p, p.split("/")[-1]) for p in expected], "path string, filename string")
    got = {r["path"]: (r["category"], r["intent"], r["category_confidence"]) for r in classify.with_path_class(df, rules).collect()}
    assert got == expected


def test_extensions_by_rule_set(spark):
    exts = [".JPG", ".nef", ".wmv", ".MTS", ".txt", ""]
    assert values(spark, exts, classify.classify_ext) == ["IMAGE", "IMAGE", "VIDEO", "VIDEO", "UNKNOWN", "UNKNOWN"]
    browser = values(spark, exts, lambda c: classify.classify_ext(c, "browser"))
    assert browser == ["IMAGE", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_filename_labels(spark):
    paths_ = ["/a/Screenshot.png", "/a/my INVOICE.pdf", "/WhatsApp/x.jpg", "/a/x.jpg"]
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate(paths_)], "media_id string, path string")
    got = [(r["category"], r["intent"], r["top_score"]) for r in classify.classify_filename_label(df).orderBy("media_id").collect()]
    assert got == [
        ("SCREENSHOT", "EPHEMERAL", 0.42),
        ("RECEIPT", "EPHEMERAL", 0.42),
        ("SCREENSHOT", "EPHEMERAL", 0.42),
        ("PHOTO", "KEEP_LONG_TERM", 0.42),
    ]


def test_zero_shot_ties_and_threshold(spark):
    items = spark.createDataFrame([("m1", [1.0, 0.0]), ("m2", [0.1, 0.1])], "media_id string, embedding array<float>")
    labels = spark.createDataFrame(
        [("a selfie", [3.0, 0.0]), ("a meme image", [0.0, 2.0]), ("something else", [0.0, 0.0])], "label string, vec array<double>"
    )
    got = {r["media_id"]: r for r in classify.zero_shot_classify(items, labels, classify.LABEL_MAP, top_k=2).collect()}
    assert (got["m1"]["top_label"], got["m1"]["category"], got["m1"]["intent"]) == ("a selfie", "SELFIE", "UNKNOWN")
    assert [t["label"] for t in got["m2"]["tags"]] == ["a meme image", "a selfie"]
    classified = classify.zero_shot_classify(items, labels, classify.LABEL_MAP)
    assert {r["media_id"] for r in classify.low_confidence_queue(classified, 0.5).collect()} == {"m2"}
    kept = {r["media_id"]: r["category"] for r in classify.apply_threshold(classified, 0.5).collect()}
    assert kept == {"m1": "SELFIE", "m2": "OTHER"}


def test_byte_texts(spark):
    sizes = [0, 1023, 1024, 1536, 102400, 1024**2, 1024**3, 1024**4, 150 * 1024**4]
    assert values(spark, sizes, text.fmt_bytes, "long")[:5] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "100.0 KB"]
    human = values(spark, sizes, text.human_bytes, "long")
    assert human == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "100 KB", "1.0 MB", "1.0 GB", "1.0 TB", "150 TB"]
    assert values(spark, [-1.0, math.nan, math.inf, None, 5.0], lambda c: text.human_bytes(c, guard=True), "double") == ["0 B"] * 4 + ["5 B"]
    assert values(spark, [0, 200 * 1024**2, 1024**3], text.hero_bytes, "long") == ["0.0 MB", "200 MB", "1.0 GB"]
    assert values(spark, [1234567], text.fmt_count, "long") == ["1,234,567"]


def test_labels_and_plurals(spark):
    assert values(spark, ["IMG_a-b.tar.gz", "x" * 50 + ".jpg"], text.group_label) == ["IMG a b.tar", "x" * 36]
    assert values(spark, [1, 2], lambda c: text.plural(c, "copy", "copies"), "long") == ["copy", "copies"]


def test_natural_order_ignores_case_and_accents(spark):
    names = ["img10.jpg", "IMG2.jpg", "Ímg1.jpg", "img2a.jpg", "img002.jpg"]
    df = spark.createDataFrame([(f"{i}", n) for i, n in enumerate(names)], "media_id string, filename string")
    df = df.withColumns({"last_modified": F.current_timestamp(), "size_bytes": F.lit(1)})
    got = [r["filename"] for r in views.sort_items(df, "name-asc").collect()]
    assert got == ["Ímg1.jpg", "IMG2.jpg", "img002.jpg", "img2a.jpg", "img10.jpg"]


def test_path_parts(spark):
    names = ["/a/b.tar.GZ", "/a/.hidden", "/a/none", "/a/.x.y"]
    assert values(spark, names, paths.extname) == [".GZ", "", "", ".y"]
    assert values(spark, names, paths.ext_of) == [".gz", ".hidden", "", ".y"]
    assert values(spark, names, paths.basename) == ["b.tar.GZ", ".hidden", "none", ".x.y"]
    assert values(spark, names, paths.dirname) == ["/a"] * 4


@pytest.mark.parametrize("size, side, want", [((4032, 3024), 256, (256, 192)), ((100, 50), 256, (100, 50)), ((5000, 1), 1024, (1024, 1))])
def test_fit_inside_never_enlarges(spark, size, side, want):
    row = spark.range(1).select(paths.fit_inside(F.lit(size[0]), F.lit(size[1]), F.lit(side)).alias("s")).head()["s"]
    assert (row["width"], row["height"]) == want


def test_times(spark):
    texts = ["2024:05:11 10:20:30", "0000:00:00 00:00:00", "yesterday", None]
    got = values(spark, texts, times.exif_timestamp)
    assert str(got[0]) == "2024-05-11 10:20:30" and got[1:] == [None, None, None]
    at = spark.sql("select timestamp'2024-01-31 23:05:06' as t")
    row = at.select(
        times.member_when(F.col("t")).alias("w"),
        times.month_of(F.col("t")).alias("m"),
        times.trash_bucket_name(F.col("t")).alias("b"),
        times.trash_bucket_time(times.trash_bucket_name(F.col("t"))).alias("p"),
        times.expires_at(F.col("t")).alias("e"),
    ).head()
    assert (row["w"], row["m"], row["b"]) == ("01/31/2024 23:05", "January 2024", "2024-01-31T23-05-06")
    assert str(row["p"]) == "2024-01-31 23:05:06" and str(row["e"]) == "2024-03-01 23:05:06"


def test_vectors_use_the_shorter_length_and_keep_zero(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 1.0, 9.0])], "a array<float>, b array<float>")
    row = df.select(
        vectors.dot(F.col("a"), F.col("b")).alias("d"),
        vectors.l2_distance(F.col("a"), F.col("b")).alias("l"),
        vectors.l2_normalize(F.col("a")).alias("n"),
        vectors.l2_normalize(F.array(F.lit(0.0))).alias("z"),
    ).head()
    assert row["d"] == 7.0 and row["l"] == pytest.approx(13**0.5) and row["n"] == pytest.approx([0.6, 0.8]) and row["z"] == [0.0]


def test_tokens_and_lexical_match(spark):
    assert values(spark, ["My-Trip_2024.ab.JPG", "constructor.png", "a b.jpg"], search.tokenize) == [["trip", "2024"], ["constructor"], []]
    tags = F.array(F.lit("red car"))
    hit = values(spark, ["x.jpg"], lambda c: search.lexical_match("CAR", c, tags))
    miss = values(spark, ["x.jpg"], lambda c: search.lexical_match("bus", c, tags, F.lit("On the Bus")))
    assert hit == [True] and miss == [True]


def test_search_tiers(spark):
    rows = [("m1", "u1", "trip one.jpg"), ("m2", "u1", "trip one copy.jpg"), ("m3", "u2", "triptych.jpg")]
    view = spark.createDataFrame(rows, "id string, uid string, filename string")
    nothing = spark.createDataFrame([], "media_id string, score double")
    found = spark.createDataFrame([("m3", 0.5)], "media_id string, score double")

    def ids(semantic, q):
        return sorted((r["id"], r["tier"]) for r in search.search_fallback(view, semantic, q).collect())

    assert ids(found, "trip") == [("m3", 1)]
    assert ids(nothing, " TRIP ") == [("m1", 2)]  # byte-identical copies show once
    assert ids(None, "trip one") == [("m1", 3), ("m2", 3)]
    assert ids(None, "zebra") == []


def test_semantic_search_cuts_before_it_filters(spark):
    rows = [(f"m{i}", [i / 100, 0.0]) for i in range(100)] + [("none", None), ("empty", [])]
    items = spark.createDataFrame(rows, "media_id string, embedding array<double>")
    got = search.semantic_search(items, [1.0, 0.0], top=90).collect()
    assert len(got) == 84 and got[0]["media_id"] == "m99" and min(r["score"] for r in got) > 0.15


def test_flags_tiny_and_large(spark):
    schema = "media_id string, kind string, size_bytes long, width int, height int, quality_score double, brightness double, color_variance double"
    rows = [
        ("a", "IMAGE", 1, 800, 800, 29.9, 0.17, 199.0),
        ("b", "IMAGE", 1, 800, 801, 30.0, 0.93, 200.0),
        ("c", "VIDEO", 500 * 1024 * 1024 + 1, 1, 1, None, None, None),
        ("d", "VIDEO", 500 * 1024 * 1024, None, None, None, 0.92, None),
    ]
    df = spark.createDataFrame(rows, schema)
    flags = {r["media_id"]: (r["blurry"], r["dark"], r["overexposed"], r["blank"]) for r in views.quality_flags(df).collect()}
    assert flags["a"] == (True, True, False, True) and flags["b"] == (False, False, True, False)
    assert flags["c"] == (None,) * 4 and flags["d"][2] is False
    assert [r["media_id"] for r in views.large_videos(df).collect()] == ["c"]
    assert views.tiny_images(df).count() == 0 and views.tiny_images(df, at_least=1).count() == 1


def test_enum_violations(spark):
    df = spark.createDataFrame([("a", "IMAGE"), ("b", "PDF"), ("c", None)], "id string, kind string")
    assert {r["id"] for r in enum_violations(df, {"kind": ("IMAGE", "VIDEO")}).collect()} == {"b", "c"}


def test_natural_order_has_no_digit_limit(spark):
    names = ["a5", "a1234567890123456789012345", "a1234567890123456789012346", "a00012", "b1", "a99999999999999999999"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(text.natural_key(F.col("n"))).collect()]
    assert got == ["a5", "a00012", "a99999999999999999999", "a1234567890123456789012345", "a1234567890123456789012346", "b1"]


def test_hybrid_search_fuses_whole_lists(spark):
    import random

    rng = random.Random(6)
    ids = [f"m{i:05d}" for i in range(3000)]
    lists = [[(i, rng.randrange(400) / 7) for i in ids if rng.random() < share] for share in (0.9, 0.7)]
    lists[0] += [("only lexical", 99.0)]
    place = [{i: p for p, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)} for rows in lists]
    score = {i: sum(1 / (60 + p[i]) for p in place if i in p) for i in {i for p in place for i in p}}
    want = [(i, place[0].get(i), place[1].get(i)) for i in sorted(score, key=lambda i: (-score[i], i))[:60]]
    frames = [spark.createDataFrame(rows, "media_id string, score double") for rows in lists]
    got = [(r.media_id, r.lexical_rank, r.semantic_rank) for r in search.hybrid_search(*frames).collect()]
    assert got == want and max(p for _, a, b in want for p in (a or 0, b or 0)) > 1000
    empty = frames[0].limit(0)
    assert search.hybrid_search(empty, empty).count() == 0
    assert search.hybrid_search(empty, frames[1]).count() == 60
