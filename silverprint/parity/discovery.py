"""Search, people, model classes and capture events."""

from __future__ import annotations

from pyspark.sql import functions as F

from silverprint.operators import classify, dedup, events, people, search, text_index, todo, vector_index, vector_pairs, views
from silverprint.parity.catalog import VIEW_SQL
from silverprint.parity.registry import query, with_
from silverprint.parity.shared import L, M, SCORE_SQL
from silverprint.parity.tables import Tables
from silverprint.workspace import new_table_path


def _dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"


# -- search -------------------------------------------------------------------------------------

TOKENS_SQL = r"""
tokens AS (SELECT DISTINCT token, uid FROM (SELECT unnest(regexp_split_to_array(regexp_replace(lower(filename), '\.[^.]+$', ''), '[\s_\-./]+')) AS token, uid FROM view)
  WHERE len(token) >= 3)"""


@query("token_index", with_(M, VIEW_SQL, TOKENS_SQL) + "SELECT * FROM tokens")
def _(t: Tables):
    return search.token_index(views.photo_view(t.media))


@query(
    "search_uid_resolve",
    with_(M, VIEW_SQL, TOKENS_SQL) + "SELECT uid, min(id) AS id FROM view WHERE uid IN (SELECT uid FROM tokens WHERE token = 'receipt') GROUP BY uid",
)
def _(t: Tables):
    view = views.photo_view(t.media)
    return search.search_uid_resolve(search.token_index(view).filter("token = 'receipt'"), view)


@query("lexical_match", with_(M) + "SELECT media_id, filename FROM media WHERE contains(lower(filename), 'meme') OR contains(lower(library_id), 'meme')")
def _(t: Tables):
    hit = search.lexical_match(" Meme ", F.col("filename"), F.array(F.col("lang")), F.col("library_id"))
    return t.files.filter(hit).select("media_id", "filename")


SEMANTIC_SQL = f"""
qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 3),
sem AS (SELECT media_id, {_dot_sql('embedding', 'q')} AS score FROM media, qv),
hits AS (SELECT media_id, score FROM (SELECT * FROM sem ORDER BY score DESC, media_id LIMIT 60) WHERE score > 0.15e0)"""


def _query_vector(t: Tables) -> list[float]:
    return search.unit(t.raw("embeddings").filter("vec_id = 3").select("embedding").head()[0])


@query("semantic_search", with_(M, SEMANTIC_SQL) + "SELECT media_id, round(score, 6) AS score FROM hits")
def _(t: Tables):
    return search.semantic_search(t.media, _query_vector(t)).withColumn("score", F.round("score", 6))


@query(
    "search_fallback",
    with_(M, VIEW_SQL, TOKENS_SQL) + """SELECT min(v.id) AS id, 2 AS tier FROM view v WHERE v.uid IN (SELECT uid FROM tokens WHERE token = 'passport') GROUP BY v.uid""",
)
def _(t: Tables):
    view = views.photo_view(t.media)
    nothing = search.semantic_search(t.media, _query_vector(t), min_score=2.0)
    return search.search_fallback(view, nothing, "Passport")


@query(
    "search_fallback_text",
    with_(M, VIEW_SQL) + "SELECT id, 3 AS tier FROM view WHERE contains(lower(filename), 'passport scan')",
)
def _(t: Tables):
    return search.search_fallback(views.photo_view(t.media), None, "passport scan")


BM25_SQL = r"""
tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda x: len(x) > 0) AS t FROM documents),
mea AS (SELECT doc_id, len(t) AS dl, len(list_filter(t, lambda x: x = 'the')) AS f1, len(list_filter(t, lambda x: x = 'license')) AS f2 FROM tok),
sta AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2 FROM mea),
lex AS (SELECT 'm' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS media_id,
  ln(1 + (n - d1 + 0.5e0) / (d1 + 0.5e0)) * f1 * 2.2e0 / (f1 + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))
  + ln(1 + (n - d2 + 0.5e0) / (d2 + 0.5e0)) * f2 * 2.2e0 / (f2 + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl)) AS score
  FROM mea, sta WHERE f1 > 0 OR f2 > 0)"""


def _lexical(t: Tables):
    key = F.concat(F.lit("m"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    docs = t.raw("documents").select(key.alias("media_id"), "text")
    return search.lexical_search(docs, "the license", "media_id", "text")


@query("lexical_search", with_(BM25_SQL) + "SELECT media_id, round(score, 6) AS score FROM lex")
def _(t: Tables):
    return _lexical(t).withColumn("score", F.round("score", 6))


INDEX_SQL = r"""
named AS (SELECT media_id, regexp_split_to_array(lower(filename || ' ' || text || ' ' || source || ' ' || lang), '[^\p{L}\p{Nd}]+') AS raw FROM placed),
tok AS (SELECT media_id, list_filter(raw, lambda x: len(x) > 0) AS t FROM named),
mea AS (SELECT media_id, len(t) AS dl, len(list_filter(t, lambda x: x = 'passport')) AS f1, len(list_filter(t, lambda x: x = 'the')) AS f2 FROM tok),
sta AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2 FROM mea),
lex AS (SELECT media_id,
  ln(1 + (n - d1 + 0.5e0) / (d1 + 0.5e0)) * f1 * 2.2e0 / (f1 + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))
  + ln(1 + (n - d2 + 0.5e0) / (d2 + 0.5e0)) * f2 * 2.2e0 / (f2 + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl)) AS score
  FROM mea, sta WHERE f1 > 0 OR f2 > 0)"""


def _text_index(t: Tables) -> str:
    """Names, texts and tags of all items, indexed in two batches."""
    path = new_table_path(t.spark, "text_index")
    items = t.files_with("text", "source").withColumn("tags", F.array("source", "lang"))
    for batch in (0, 1):
        text_index.add_batch(items.filter(F.col("doc_id") % 2 == batch), path, batch, "media_id", ["filename", "text", "tags"])
    return path


@query("lexical_index_scores", with_(M, INDEX_SQL) + "SELECT media_id, round(score, 6) AS score FROM lex")
def _(t: Tables):
    scores = text_index.Search(t.spark, _text_index(t), "The passport").scores()
    return scores.select(F.col("id").alias("media_id"), F.round("score", 6).alias("score"))


@query(
    "lexical_index_top",
    with_(M, INDEX_SQL) + "SELECT media_id, round(score, 6) AS score FROM lex ORDER BY lex.score DESC, media_id LIMIT 60",
)
def _(t: Tables):
    best = text_index.Search(t.spark, _text_index(t), "The passport").best(60)
    return best.select(F.col("id").alias("media_id"), F.round("score", 6).alias("score"))


@query("semantic_index_search", with_(M, SEMANTIC_SQL) + "SELECT media_id, round(score, 6) AS score FROM hits")
def _(t: Tables):
    path = new_table_path(t.spark, "vector_index")
    vector_index.build(t.media, path)
    return vector_index.VectorIndex(t.spark, path).search(_query_vector(t)).withColumn("score", F.round("score", 6))


@query(
    "hybrid_search",
    with_(M, SEMANTIC_SQL, BM25_SQL) + """, a AS (SELECT media_id, row_number() OVER (ORDER BY round(score, 9) DESC, media_id) AS r FROM lex),
    b AS (SELECT media_id, row_number() OVER (ORDER BY round(score, 9) DESC, media_id) AS r FROM sem),
    f AS (SELECT COALESCE(a.media_id, b.media_id) AS media_id, a.r AS lexical_rank, b.r AS semantic_rank,
      COALESCE(1e0 / (60 + a.r), 0e0) + COALESCE(1e0 / (60 + b.r), 0e0) AS score FROM a FULL JOIN b ON a.media_id = b.media_id)
    SELECT media_id, lexical_rank, semantic_rank, round(score, 9) AS score FROM f ORDER BY f.score DESC, media_id LIMIT 60""",
)
def _(t: Tables):
    semantic = t.media.select("media_id", F.round(search.dot_with(F.col("embedding"), _query_vector(t)), 9).alias("score"))
    fused = search.hybrid_search(_lexical(t).withColumn("score", F.round("score", 9)), semantic)
    return fused.select("media_id", F.col("lexical_rank").cast("long"), F.col("semantic_rank").cast("long"), F.round("score", 9).alias("score"))


# -- people -------------------------------------------------------------------------------------

LOOSE_EPS = 1.1
L2_SQL = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) * (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))))"
FACES_SQL = f"""
faces AS (SELECT vec_id, embedding, 'm' || lpad(CAST(vec_id // 2 AS VARCHAR), 8, '0') AS media_id, CAST(vec_id % 2 AS INTEGER) AS face_idx,
  'm' || lpad(CAST(vec_id // 2 AS VARCHAR), 8, '0') || '#' || lpad(CAST(vec_id % 2 AS VARCHAR), 6, '0') AS face_id FROM embeddings),
fpairs AS (SELECT a.face_id AS a, b.face_id AS b, {L2_SQL} AS distance FROM faces a JOIN faces b ON a.vec_id < b.vec_id WHERE {L2_SQL} < {LOOSE_EPS}e0),
fedge AS (SELECT a AS s, b AS d FROM fpairs UNION ALL SELECT b, a FROM fpairs),
freach(node, lab) AS (SELECT DISTINCT s, s FROM fedge UNION SELECT e.d, r.lab FROM freach r JOIN fedge e ON e.s = r.node WHERE r.lab < e.d),
fcomp AS (SELECT node, min(lab) AS component FROM freach GROUP BY node),
ftag AS (SELECT f.face_id, f.media_id, f.face_idx, c.component FROM faces f JOIN fcomp c ON c.node = f.face_id),
fclus AS (SELECT component, count(*) AS face_count, count(DISTINCT media_id) AS size, arg_min(media_id, face_id) AS representative_item_id,
  arg_min(face_idx, face_id) AS representative_face_idx, 'person-' || row_number() OVER (ORDER BY count(*) DESC, component) AS id FROM ftag GROUP BY component)"""


@query("face_pairs", with_(FACES_SQL) + "SELECT a, b, round(distance, 6) AS distance FROM fpairs")
def _(t: Tables):
    pairs = people.face_pairs(people.explode_faces(t.face_items), LOOSE_EPS)
    return pairs.withColumn("distance", F.round("distance", 6))


def _tagged(t: Tables):
    return people.tag_clusters(people.explode_faces(t.face_items), LOOSE_EPS)


@query(
    "face_clusters",
    with_(FACES_SQL) + "SELECT id, component, representative_item_id, representative_face_idx, face_count, size FROM fclus",
)
def _(t: Tables):
    return people.face_clusters(_tagged(t))


@query("face_cluster_rank", with_(FACES_SQL) + "SELECT id, face_count FROM fclus")
def _(t: Tables):
    return people.face_clusters(_tagged(t)).select("id", "face_count")


@query("cluster_item_set", with_(FACES_SQL) + "SELECT DISTINCT c.id, f.media_id FROM ftag f JOIN fclus c ON c.component = f.component")
def _(t: Tables):
    tagged = _tagged(t)
    return people.cluster_item_set(tagged, people.face_clusters(tagged))


@query("solo_faces", with_(FACES_SQL) + "SELECT DISTINCT media_id FROM faces WHERE media_id NOT IN (SELECT media_id FROM ftag)")
def _(t: Tables):
    return people.solo_faces(t.face_items, _tagged(t)).select("media_id")


@query("faces_total", "SELECT count(*) AS faces FROM embeddings")
def _(t: Tables):
    return people.faces_total(t.face_items)


@query("people_count", with_(FACES_SQL) + "SELECT count(*) AS people FROM fclus")
def _(t: Tables):
    return _tagged(t).agg(F.countDistinct("component").alias("people"))


COSINE_SQL = f"({_dot_sql('a.embedding', 'b.embedding')} / sqrt({_dot_sql('a.embedding', 'a.embedding')} * {_dot_sql('b.embedding', 'b.embedding')}))"


@query(
    "similar_pairs",
    f"""SELECT a.vec_id AS a, b.vec_id AS b, round({COSINE_SQL}, 6) AS cosine
    FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COSINE_SQL} >= 0.4e0""",
)
def _(t: Tables):
    from silverprint.functions.vectors import l2_normalize

    unit = t.raw("embeddings").select("vec_id", l2_normalize(F.col("embedding")).alias("embedding"))
    pairs = vector_pairs.similar_pairs(unit, "vec_id", "embedding", 0.4)
    return pairs.select("a", "b", F.round("cosine", 6).alias("cosine"))


SIMILAR_SQL = f"""
svec AS (SELECT DISTINCT vec_id, embedding FROM media),
sedge AS (SELECT a.vec_id AS s, b.vec_id AS d FROM svec a JOIN svec b ON a.vec_id <> b.vec_id WHERE {COSINE_SQL} >= 0.4e0),
sreach(node, lab) AS (SELECT vec_id, vec_id FROM svec UNION SELECT e.d, r.lab FROM sreach r JOIN sedge e ON e.s = r.node WHERE r.lab < e.d),
scomp AS (SELECT node, min(lab) AS root FROM sreach GROUP BY node),
srow AS (SELECT m.*, c.root, {SCORE_SQL} AS score, count(*) OVER (PARTITION BY c.root) AS n,
    row_number() OVER (PARTITION BY c.root ORDER BY {SCORE_SQL} DESC, size_bytes DESC, media_id) AS rn FROM media m JOIN scomp c ON c.node = m.vec_id)"""


@query(
    "similar_groups",
    with_(M, SIMILAR_SQL) + """SELECT 'sg_' || min(media_id) AS group_id, 'SIMILAR' AS kind, count(*) AS member_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes,
    min(media_id) FILTER (rn = 1) AS best_media_id, CAST(sum(size_bytes) FILTER (rn > 1) AS BIGINT) AS recoverable_bytes FROM srow WHERE n > 1 GROUP BY root""",
)
def _(t: Tables):
    return dedup.similar_groups(t.media, 0.4)[0]


@query(
    "similar_members",
    with_(M, SIMILAR_SQL) + """SELECT 'sg_' || min(media_id) OVER (PARTITION BY root) AS group_id, media_id,
    CASE WHEN rn = 1 THEN 'best of group' ELSE 'similar to best' END AS reason FROM srow WHERE n > 1""",
)
def _(t: Tables):
    return dedup.similar_groups(t.media, 0.4)[1]


# -- model classes ------------------------------------------------------------------------------

PATCH_SQL = """
patches AS (SELECT m.media_id, CASE WHEN l.toxic = 1 THEN NULL ELSE m.brightness END AS brightness, CASE WHEN l.toxic = 1 THEN 'decode failed' END AS error
  FROM media m JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = m.doc_id WHERE m.kind = 'IMAGE')"""


def _patches(t: Tables):
    marks = t.raw("labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = views.model_targets(t.media).join(marks, "doc_id")
    failed = F.col("toxic") == 1
    return rows.select(
        "media_id",
        F.when(~failed, F.col("brightness")).alias("brightness"),
        F.when(~failed, F.col("embedding")).alias("embedding"),
        F.when(failed, "decode failed").alias("error"),
    )


@query(
    "ai_patch",
    with_(M, PATCH_SQL) + """SELECT m.media_id, CASE WHEN p.media_id IS NOT NULL THEN p.brightness ELSE m.brightness END AS brightness
    FROM media m LEFT JOIN patches p ON p.media_id = m.media_id""",
)
def _(t: Tables):
    from silverprint.operators.merge import patch

    return patch(t.media.select("media_id", "brightness"), _patches(t).select("media_id", "brightness"), ["media_id"])


@query(
    "ai_run_summary",
    with_(M, PATCH_SQL) + """SELECT count(*) AS analysed, count(*) FILTER (error IS NULL) AS embedded,
    CAST(COALESCE(sum(CASE WHEN d * 2 + 1 < (SELECT n FROM nv) THEN 2 WHEN d * 2 < (SELECT n FROM nv) THEN 1 ELSE 0 END), 0) AS BIGINT) AS faces,
    count(error) AS errors FROM (SELECT *, CAST(substr(media_id, 2) AS BIGINT) AS d FROM patches)""",
)
def _(t: Tables):
    return todo.model_run_summary(_patches(t).join(t.face_items, "media_id", "left"))


LABEL_NAMES = sorted(classify.LABEL_MAP)
ZERO_SQL = f"""
lv AS (SELECT ({LABEL_NAMES})[label + 1] AS label, list_transform(range(1, 65), lambda i: avg_at[i]) AS v FROM (
  SELECT label, list(m ORDER BY pos) AS avg_at FROM (SELECT label, pos, avg(x) AS m FROM (
    SELECT label, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, pos) GROUP BY label)),
lvn AS (SELECT label, v, sqrt({_dot_sql('v', 'v')}) AS len FROM lv),
zs AS (SELECT m.media_id, l.label, {_dot_sql('m.embedding', 'l.v')} / l.len AS score FROM media m, lvn l),
zt AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY score DESC, label) AS r FROM zs),
lmap AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{c}', '{i}')" for k, (c, i) in classify.LABEL_MAP.items())}) AS x(label, category, intent)),
zc AS (SELECT z.media_id, z.label AS top_label, z.score AS top_score, m.category, m.intent FROM zt z JOIN lmap m ON m.label = z.label WHERE z.r = 1)"""


def _zero_shot(t: Tables):
    names = F.array(*[F.lit(n) for n in LABEL_NAMES])
    means = (
        t.raw("embeddings")
        .select(F.element_at(names, F.col("label") + 1).alias("label"), F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy("label")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("vec"))
    )
    return classify.zero_shot_classify(t.media, means, classify.LABEL_MAP)


@query(
    "zero_shot_classify",
    with_(M, ZERO_SQL) + """SELECT c.media_id, c.top_label, round(c.top_score, 6) AS top_score, c.category, c.intent, g.tags FROM zc c
    JOIN (SELECT media_id, string_agg(label, '; ' ORDER BY r) AS tags FROM zt WHERE r <= 3 GROUP BY media_id) g ON g.media_id = c.media_id""",
)
def _(t: Tables):
    return _zero_shot(t).select(
        "media_id",
        "top_label",
        F.round("top_score", 6).alias("top_score"),
        "category",
        "intent",
        F.array_join(F.transform("tags", lambda x: x["label"]), "; ").alias("tags"),
    )


@query(
    "low_confidence_queue",
    with_(M, ZERO_SQL) + "SELECT media_id, top_label, 'OTHER' AS category, 'UNKNOWN' AS intent FROM zc WHERE top_score < 0.2e0",
)
def _(t: Tables):
    return classify.low_confidence_queue(_zero_shot(t), 0.2).select("media_id", "top_label", "category", "intent")


@query(
    "receipt_text_rule",
    with_(M) + r"""SELECT m.media_id, CASE WHEN hit THEN 'RECEIPT' ELSE category END AS category, CASE WHEN hit THEN 'EPHEMERAL' ELSE intent END AS intent FROM (
    SELECT *, category IN ('SCREENSHOT', 'DOCUMENT', 'OTHER') AND regexp_matches(text, '(?i)\b(total|gst)\b|\d+\.\d{2}\b') AS hit FROM media) m""",
)
def _(t: Tables):
    key = F.concat(F.lit("m"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    ocr = t.raw("documents").select(key.alias("media_id"), "text")
    return classify.receipt_text_rule(t.media, ocr, ["SCREENSHOT", "DOCUMENT", "OTHER"])


@query(
    "heuristic_extra",
    with_(M, L) + r""", x AS (SELECT m.*, c.media_id IS NOT NULL AS has_make, s.media_id IS NOT NULL AND c.media_id IS NOT NULL AS front
      FROM media m LEFT JOIN chosen c ON c.media_id = m.media_id LEFT JOIN staged s ON s.media_id = m.media_id),
    y AS (SELECT *, COALESCE((width * 1080 = height * 1920) OR (width * 1920 = height * 1080), false) AND NOT has_make AS scr FROM x)
    SELECT media_id, scr AS screen_shaped,
      CASE WHEN front THEN 'SELFIE' WHEN regexp_matches(path, '[\\/]DCIM[\\/]Camera[\\/]') AND has_make THEN 'PHOTO' WHEN scr THEN 'SCREENSHOT'
        WHEN regexp_matches(filename, '^IMG_') AND NOT has_make THEN 'PHOTO' ELSE category END AS category,
      CASE WHEN front THEN 'UNKNOWN' WHEN regexp_matches(path, '[\\/]DCIM[\\/]Camera[\\/]') AND has_make THEN 'KEEP_LONG_TERM' WHEN scr THEN 'EPHEMERAL'
        WHEN regexp_matches(filename, '^IMG_') AND NOT has_make THEN 'UNKNOWN' ELSE intent END AS intent FROM y""",
)
def _(t: Tables):
    front = t.labelled("toxic", 1).withColumn("lens", F.lit("Front Camera"))
    exif = t.labelled("quality", 0).join(front, "media_id", "left").withColumns({"make": F.lit("Maker"), "model": F.lit("One")})
    return classify.heuristic_extra(t.media, exif, [(1920, 1080)])


# -- events -------------------------------------------------------------------------------------

TIMES_SQL = """
photos AS (SELECT 'p' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS media_id, user_id AS library_id, ts AS taken_at, value, event_type FROM events),
gaps AS (SELECT *, CASE WHEN lag(taken_at) OVER w IS NULL OR taken_at - lag(taken_at) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh
  FROM photos WINDOW w AS (PARTITION BY library_id ORDER BY taken_at, media_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY library_id ORDER BY taken_at, media_id) AS no FROM gaps),
evs AS (SELECT library_id, no, min(taken_at) AS start_at, max(taken_at) AS end_at, count(*) AS photos FROM numbered GROUP BY library_id, no HAVING count(*) >= 3),
emem AS (SELECT n.media_id, n.library_id, n.taken_at, n.value, n.event_type, e.start_at, e.photos AS event_size FROM numbered n JOIN evs e ON e.library_id = n.library_id AND e.no = n.no)"""


@query("event_time_clusters", with_(TIMES_SQL) + "SELECT library_id, start_at, end_at, photos FROM evs")
def _(t: Tables):
    return events.event_time_clusters(t.photo_times)


@query("event_members", with_(TIMES_SQL) + "SELECT media_id, library_id, start_at, event_size FROM emem")
def _(t: Tables):
    return events.event_members(t.photo_times).select("media_id", "library_id", "start_at", "event_size")


CITIES_SQL = """
cities AS (SELECT n_name AS city, CAST(n_nationkey AS DOUBLE) * 4 - 48 AS lat, CAST((n_nationkey * 37) % 25 AS DOUBLE) * 14 - 170 AS lon FROM nation),
points AS (SELECT media_id, library_id, taken_at, event_type, CAST(event_n % 25 AS DOUBLE) * 4 - 48 + value / 1e3 AS lat,
  CAST(((event_n % 25) * 37) % 25 AS DOUBLE) * 14 - 170 + value / 1e3 AS lon FROM (SELECT *, CAST(floor(value) AS BIGINT) + library_id AS event_n FROM photos)),
near_city AS (SELECT p.media_id, c.city, 2 * 6371 * asin(sqrt(least(1e0, pow(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - p.lon) / 2), 2)))) AS km FROM points p, cities c),
geo AS (SELECT p.*, n.city, n.km AS city_km FROM points p LEFT JOIN (SELECT media_id, arg_min(city, km) AS city, min(km) AS km FROM near_city WHERE km <= 100 GROUP BY media_id) n ON n.media_id = p.media_id)"""


def _cities(t: Tables):
    key = F.col("n_nationkey")
    return t.raw("nation").select(
        F.col("n_name").alias("city"),
        (key.cast("double") * 4 - 48).alias("lat"),
        (((key * 37) % 25).cast("double") * 14 - 170).alias("lon"),
    )


def _points(t: Tables):
    n = (F.floor("value") + F.col("library_id")) % 25
    return t.photo_times.select(
        "media_id",
        "library_id",
        "taken_at",
        "event_type",
        (n.cast("double") * 4 - 48 + F.col("value") / 1000).alias("lat"),
        (((n * 37) % 25).cast("double") * 14 - 170 + F.col("value") / 1000).alias("lon"),
    )


@query("reverse_geocode", with_(TIMES_SQL, CITIES_SQL) + "SELECT media_id, city, round(city_km, 6) AS city_km FROM geo")
def _(t: Tables):
    located = events.reverse_geocode(_points(t), _cities(t))
    return located.select("media_id", "city", F.round("city_km", 6).alias("city_km"))


REFINE_SQL = """
gm AS (SELECT g.*, e.start_at FROM geo g JOIN emem e ON e.media_id = g.media_id),
cen AS (SELECT library_id, start_at, avg(lat) AS mlat, avg(lon) AS mlon FROM gm GROUP BY library_id, start_at),
away AS (SELECT g.library_id, g.start_at, 2 * 6371 * asin(sqrt(least(1e0, pow(sin(radians(c.mlat - g.lat) / 2), 2) + cos(radians(g.lat)) * cos(radians(c.mlat)) * pow(sin(radians(c.mlon - g.lon) / 2), 2)))) AS km
  FROM gm g JOIN cen c ON c.library_id = g.library_id AND c.start_at = g.start_at),
wide AS (SELECT library_id, start_at, quantile_disc(km, 0.5) > 50 AS wide FROM away GROUP BY library_id, start_at),
bycity AS (SELECT library_id, start_at, COALESCE(city, '') AS city, min(taken_at) AS first, max(taken_at) AS last, count(*) AS photos FROM gm GROUP BY library_id, start_at, COALESCE(city, '')),
mainc AS (SELECT library_id, start_at, city AS main FROM (SELECT *, row_number() OVER (PARTITION BY library_id, start_at ORDER BY photos DESC, city) AS r FROM bycity) WHERE r = 1),
parts AS (SELECT b.library_id, b.start_at, CASE WHEN w.wide THEN b.city ELSE m.main END AS city, min(first) AS first, max(last) AS last, CAST(sum(photos) AS BIGINT) AS photos
  FROM bycity b JOIN wide w ON w.library_id = b.library_id AND w.start_at = b.start_at JOIN mainc m ON m.library_id = b.library_id AND m.start_at = b.start_at GROUP BY ALL),
pg AS (SELECT *, max(last) OVER (PARTITION BY library_id, city ORDER BY first, start_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM parts),
pn AS (SELECT *, sum(CASE WHEN reached IS NULL OR first - reached >= INTERVAL 2 DAY OR city = '' THEN 1 ELSE 0 END) OVER (PARTITION BY library_id, city ORDER BY first, start_at) AS no FROM pg)"""


@query(
    "event_location_refine",
    with_(TIMES_SQL, CITIES_SQL, REFINE_SQL) + """SELECT library_id, city, min(first) AS event_start, max(last) AS event_end, CAST(sum(photos) AS BIGINT) AS photos, count(*) AS parts
    FROM pn GROUP BY library_id, city, no""",
)
def _(t: Tables):
    located = events.reverse_geocode(_points(t), _cities(t))
    return events.event_location_refine(events.event_members(located))


REFINED_SQL = """
pe AS (SELECT *, min(first) OVER (PARTITION BY library_id, city, no) AS event_start FROM pn),
rmem AS (SELECT g.library_id, p.city, p.event_start, g.media_id, g.taken_at, g.lat, g.lon FROM gm g
  JOIN wide w ON w.library_id = g.library_id AND w.start_at = g.start_at JOIN mainc m ON m.library_id = g.library_id AND m.start_at = g.start_at
  JOIN pe p ON p.library_id = g.library_id AND p.start_at = g.start_at AND p.city = CASE WHEN w.wide THEN COALESCE(g.city, '') ELSE m.main END)"""


@query("event_member", with_(TIMES_SQL, CITIES_SQL, REFINE_SQL, REFINED_SQL) + "SELECT library_id, city, event_start, media_id FROM rmem")
def _(t: Tables):
    located = events.reverse_geocode(_points(t), _cities(t))
    return events.event_member(events.event_members(located)).select("library_id", "city", "event_start", "media_id")


@query(
    "event_group",
    with_(TIMES_SQL, CITIES_SQL, REFINE_SQL, REFINED_SQL) + """SELECT library_id, city, event_start, max(taken_at) AS event_end, count(*) AS photos,
    arg_min(media_id, (taken_at, media_id)) AS cover, round(avg(lat) + 0.0000001e0, 4) AS centroid_lat, round(avg(lon) + 0.0000001e0, 4) AS centroid_lon FROM rmem GROUP BY library_id, city, event_start""",
)
def _(t: Tables):
    located = events.reverse_geocode(_points(t), _cities(t))
    found = events.event_group(events.event_member(events.event_members(located)))
    # the shift keeps means that end in a half from being rounded either way
    return found.withColumns({c: F.round(F.col(c) + 0.0000001, 4) for c in ("centroid_lat", "centroid_lon")})


@query(
    "event_outliers",
    with_(M) + f""", ax AS (SELECT library_id, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM media),
    ce AS (SELECT library_id, list(m ORDER BY pos) AS c FROM (SELECT library_id, pos, avg(x) AS m FROM ax GROUP BY library_id, pos) GROUP BY library_id),
    co AS (SELECT m.library_id, m.media_id, {_dot_sql('m.embedding', 'ce.c')} / (sqrt({_dot_sql('m.embedding', 'm.embedding')}) * sqrt({_dot_sql('ce.c', 'ce.c')})) AS cosine
      FROM media m JOIN ce ON ce.library_id = m.library_id)
    SELECT library_id, media_id, round(cosine, 6) AS cosine, cosine >= 0.1e0 AS stays FROM co""",
)
def _(t: Tables):
    return events.event_outliers(t.media, "library_id", 0.1).withColumn("cosine", F.round("cosine", 6))


LABELS_SQL = """
ev AS (SELECT g.media_id, g.library_id || '@' || strftime(e.start_at, '%Y%m%d%H%M%S') AS event_id, g.event_type AS label, g.city, g.taken_at FROM geo g JOIN emem e ON e.media_id = g.media_id),
topl AS (SELECT event_id, string_agg(label, ', ' ORDER BY r) AS labels FROM (SELECT event_id, label, row_number() OVER (PARTITION BY event_id ORDER BY count(*) DESC, label) AS r FROM ev GROUP BY event_id, label) WHERE r <= 3 GROUP BY event_id),
topc AS (SELECT event_id, city FROM (SELECT event_id, city, row_number() OVER (PARTITION BY event_id ORDER BY count(*) DESC, city) AS r FROM ev WHERE city IS NOT NULL GROUP BY event_id, city) WHERE r = 1),
span AS (SELECT event_id, min(taken_at) AS start_at, max(taken_at) AS end_at FROM ev GROUP BY event_id)"""


@query(
    "event_label",
    with_(TIMES_SQL, CITIES_SQL, LABELS_SQL) + """SELECT s.event_id, concat_ws(' · ', l.labels, c.city,
      CASE WHEN strftime(start_at, '%Y-%m-%d') = strftime(end_at, '%Y-%m-%d') THEN strftime(start_at, '%Y-%m-%d')
        ELSE strftime(start_at, '%Y-%m-%d') || ' – ' || strftime(end_at, '%Y-%m-%d') END) AS label, start_at, end_at
    FROM span s LEFT JOIN topl l ON l.event_id = s.event_id LEFT JOIN topc c ON c.event_id = s.event_id""",
)
def _(t: Tables):
    members = events.event_members(events.reverse_geocode(_points(t), _cities(t)))
    event = F.concat(F.col("library_id").cast("string"), F.lit("@"), F.date_format("start_at", "yyyyMMddHHmmss"))
    return events.event_label(members.select("media_id", event.alias("event_id"), F.col("event_type").alias("label"), "city", "taken_at"))


@query(
    "intent_infer",
    with_(M, L) + """, g AS (SELECT *, lag(taken_at) OVER (PARTITION BY lang ORDER BY taken_at, media_id) AS prev FROM media WHERE taken_at IS NOT NULL),
    n AS (SELECT *, sum(CASE WHEN prev IS NULL OR taken_at - prev > INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY lang ORDER BY taken_at, media_id) AS no FROM g),
    s AS (SELECT media_id, count(*) OVER (PARTITION BY lang, no) AS event_size FROM n),
    f AS (SELECT m.*, COALESCE(CASE WHEN s.event_size >= 3 THEN s.event_size END, 0) AS event_size, k.media_id IS NOT NULL AS locked, c.media_id IS NOT NULL AS fav,
      m.doc_id * 2 < (SELECT n FROM nv) AS has_face FROM media m LEFT JOIN s ON s.media_id = m.media_id LEFT JOIN staged k ON k.media_id = m.media_id LEFT JOIN chosen c ON c.media_id = m.media_id)
    SELECT media_id, CASE WHEN locked THEN intent WHEN fav OR (category = 'PHOTO' AND has_face) OR event_size > 5 THEN 'KEEP_LONG_TERM'
      WHEN category IN ('RECEIPT', 'TRANSACTIONAL') OR (category = 'SCREENSHOT' AND width = 1920) THEN 'EPHEMERAL' ELSE 'UNKNOWN' END AS intent FROM f""",
)
def _(t: Tables):
    faces = t.face_items.select("media_id", F.size("faces").alias("face_count"))
    locked = t.labelled("toxic", 1).withColumn("_locked", F.lit(True))
    favourite = t.labelled("quality", 0).withColumn("_fav", F.lit(True))
    items = (
        t.media.drop("is_favorite")
        .join(faces, "media_id", "left")
        .join(locked, "media_id", "left")
        .join(favourite, "media_id", "left")
        .withColumns(
            {
                "user_intent_locked": F.coalesce("_locked", F.lit(False)),
                "is_favorite": F.coalesce("_fav", F.lit(False)),
                "is_code_or_confirmation": F.col("width") == 1920,
            }
        )
    )
    return classify.intent_infer(items, events.event_members(t.files, group="lang"))
