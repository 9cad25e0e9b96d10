"""Projections, filters, aggregates, sorts and set operations on the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from silverprint.functions import hashing, paths, text, times
from silverprint.operators import classify, ranking, selection, staging, todo, views
from silverprint.parity.registry import query, with_
from silverprint.parity.shared import L, M, fmt_bytes_sql, hero_bytes_sql, human_bytes_sql
from silverprint.parity.tables import Tables

IMAGE_LIST = ", ".join(f"'{e}'" for e in classify.SERVER_IMAGE_EXTS)
VIDEO_LIST = ", ".join(f"'{e}'" for e in classify.SERVER_VIDEO_EXTS)


@query(
    "classify_ext",
    with_(M) + f"""SELECT media_id, CASE WHEN lower(ext) IN ({IMAGE_LIST}) THEN 'IMAGE' WHEN lower(ext) IN ({VIDEO_LIST})
    THEN 'VIDEO' ELSE 'UNKNOWN' END AS kind FROM media""",
)
def _(t: Tables):
    return t.files.select("media_id", classify.classify_ext(F.upper("ext")).alias("kind"))


@query(
    "classify_path_server",
    with_(M) + r"""SELECT media_id, v.category, v.intent, CAST(v.confidence AS DOUBLE) AS confidence, v.reason FROM (
    SELECT media_id, CASE
      WHEN regexp_matches(lname, '^(screenshot|screen\s?shot|scr_|capture_)') OR contains(lower(regexp_replace(path, '/[^/]*$', '')), 'screenshot')
        THEN {'category': 'SCREENSHOT', 'intent': 'EPHEMERAL', 'confidence': 0.85, 'reason': 'filename matches screenshot pattern'}
      WHEN regexp_matches(path, '[\\/](whatsapp|WhatsApp)[\\/]') OR regexp_matches(path, '[\\/](Telegram|TelegramMedia)[\\/]')
        THEN {'category': 'WHATSAPP_FORWARD', 'intent': 'EPHEMERAL', 'confidence': 0.7, 'reason': 'path contains messenger media directory'}
      WHEN regexp_matches(path, '(?i)[\\/](DCIM|Camera|100[A-Z]+)[\\/]')
        THEN {'category': 'PHOTO', 'intent': 'KEEP_LONG_TERM', 'confidence': 0.6, 'reason': 'path looks like camera directory'}
      WHEN regexp_matches(lname, '\b(receipt|invoice|bill|gst|tax)\b')
        THEN {'category': 'RECEIPT', 'intent': 'EPHEMERAL', 'confidence': 0.5, 'reason': 'filename suggests transactional content'}
      WHEN regexp_matches(lname, '\b(scan|doc|document|aadhaar|passport|pan|license)\b')
        THEN {'category': 'DOCUMENT', 'intent': 'EPHEMERAL', 'confidence': 0.5, 'reason': 'filename suggests transactional content'}
      WHEN regexp_matches(lname, '\b(meme|funny|lol|reddit|9gag)\b')
        THEN {'category': 'MEME', 'intent': 'EPHEMERAL', 'confidence': 0.5, 'reason': 'filename suggests meme'}
      WHEN regexp_matches(path, '[\\/]Downloads?[\\/]')
        THEN {'category': 'OTHER', 'intent': 'EPHEMERAL', 'confidence': 0.3, 'reason': 'file is in Downloads — likely ephemeral'}
      ELSE {'category': 'OTHER', 'intent': 'UNKNOWN', 'confidence': 0.0, 'reason': NULL} END AS v FROM media)""",
)
def _(t: Tables):
    rows = classify.with_path_class(t.files, "server")
    return rows.select("media_id", "category", "intent", F.col("category_confidence").alias("confidence"), "reason")


@query(
    "classify_path_browser",
    with_(M) + """SELECT media_id, category, intent, CAST(CASE WHEN category = 'SCREENSHOT' THEN 0.85 WHEN category = 'WHATSAPP_FORWARD' THEN 0.75
    WHEN category IN ('RECEIPT', 'DOCUMENT', 'MEME') THEN 0.5 WHEN category = 'PHOTO' THEN 0.6
    WHEN intent = 'EPHEMERAL' THEN 0.3 ELSE 0.0 END AS DOUBLE) AS confidence FROM media""",
)
def _(t: Tables):
    return t.media.select("media_id", "category", "intent", F.col("category_confidence").alias("confidence"))


@query(
    "classify_filename_label",
    with_(M) + """SELECT media_id, top_label, CASE WHEN top_label LIKE '%chat%' THEN 'SCREENSHOT' WHEN top_label LIKE '%receipt%' THEN 'RECEIPT' ELSE 'PHOTO' END AS category,
    CASE WHEN top_label = 'a photo of people' THEN 'KEEP_LONG_TERM' ELSE 'EPHEMERAL' END AS intent, 0.42e0 AS top_score FROM (
    SELECT media_id, CASE WHEN contains(lname, 'screenshot') THEN 'a screenshot of a chat message'
      WHEN contains(lname, 'receipt') OR contains(lname, 'invoice') THEN 'a photo of a receipt or invoice'
      WHEN contains(lower(path), 'whatsapp') THEN 'a screenshot of a chat message' ELSE 'a photo of people' END AS top_label FROM media)""",
)
def _(t: Tables):
    return classify.classify_filename_label(t.files)


VIEW_CAT_SQL = """CASE WHEN kind = 'VIDEO' THEN 'video' WHEN category = 'SCREENSHOT' THEN 'screenshot' WHEN category = 'MEME' THEN 'meme'
    WHEN category IN ('DOCUMENT', 'RECEIPT', 'TRANSACTIONAL') THEN 'document' WHEN category = 'WHATSAPP_FORWARD' THEN 'whatsapp' ELSE 'photo' END"""
VIEW_SQL = f"""
view AS (SELECT media_id AS id, substr(sha256, 1, 16) AS uid, {VIEW_CAT_SQL} AS cat, filename, size_bytes AS size,
  COALESCE(width, 0) AS width, COALESCE(height, 0) AS height, strftime(last_modified, '%Y-%m-%d') AS date,
  0.7e0 AS quality, 0.6e0 AS aesthetic, false AS blurry, false AS dark, false AS burst FROM media)"""


@query("photo_view", with_(M, VIEW_SQL) + "SELECT * FROM view")
def _(t: Tables):
    return views.photo_view(t.media)


@query("category_filter", with_(M, VIEW_SQL) + "SELECT * FROM view WHERE cat = 'document'")
def _(t: Tables):
    return views.category_filter(views.photo_view(t.media), "document")


@query(
    "quality_flags",
    with_(M) + """SELECT media_id, quality_score < 30e0 AS blurry, brightness < 0.18e0 AS dark, brightness > 0.92e0 AS overexposed,
    color_variance < 200e0 AS blank FROM media""",
)
def _(t: Tables):
    return views.quality_flags(t.media)


@query(
    "tiny_images",
    with_(M) + """, tiny AS (SELECT media_id, width, height FROM media WHERE kind = 'IMAGE' AND width <= 800 AND height <= 800)
    SELECT * FROM tiny WHERE (SELECT count(*) FROM tiny) >= 3""".replace("WITH RECURSIVE\n", ""),
)
def _(t: Tables):
    return views.tiny_images(t.media).select("media_id", "width", "height")


@query("large_videos", with_(M) + "SELECT media_id, size_bytes FROM media WHERE kind = 'VIDEO' AND size_bytes > 524288000")
def _(t: Tables):
    return views.large_videos(t.media).select("media_id", "size_bytes")


@query("ai_targets", with_(M) + "SELECT media_id, path FROM media WHERE kind = 'IMAGE'")
def _(t: Tables):
    return views.model_targets(t.media).select("media_id", "path")


@query(
    "near_candidates_filter",
    with_(M) + "SELECT media_id, sha256, dhash_hex FROM media WHERE kind = 'IMAGE' AND dhash_hex <> '0000000000000000' AND library_id = 'src0'",
)
def _(t: Tables):
    from silverprint.operators.hamming_pairs import near_candidates

    return near_candidates(t.media, "src0").select("media_id", "sha256", "dhash_hex")


JOBS_SQL = """
jobs AS (SELECT event_id AS id, event_type AS type, (['PENDING', 'RUNNING', 'DONE', 'FAILED', 'CANCELLED'])[event_id % 5 + 1] AS status,
  CAST(floor(value) AS BIGINT) % 10 AS priority, ts AS scheduled_at, ts AS created_at FROM events)"""


@query("job_list", with_(JOBS_SQL) + "SELECT id, type, status, created_at FROM jobs WHERE status = 'FAILED' AND type = 'error' ORDER BY created_at DESC, id LIMIT 100")
def _(t: Tables):
    return todo.job_list(t.jobs, "FAILED", "error").select("id", "type", "status", "created_at")


@query("job_stats", with_(JOBS_SQL) + "SELECT status, type, count(*) AS n FROM jobs GROUP BY status, type")
def _(t: Tables):
    return todo.job_stats(t.jobs)


@query(
    "job_next",
    with_(JOBS_SQL) + """SELECT id, type, priority, scheduled_at FROM jobs WHERE status = 'PENDING' AND scheduled_at <= TIMESTAMP '2024-01-15 00:00:00'
    ORDER BY priority DESC, scheduled_at, id LIMIT 1""",
)
def _(t: Tables):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return todo.job_next(t.jobs, now).select("id", "type", "priority", "scheduled_at")


@query(
    "sort_items",
    with_(M) + r""", keyed AS (SELECT media_id, filename, regexp_replace(regexp_replace(strip_accents(lower(filename)), '(\d+)', '00000000000000000000\1', 'g'),
      '0*(\d{20})(\D|$)', '\1\2', 'g') AS k0 FROM media),
    ordered AS (SELECT media_id, filename, translate(k0, ' _-.', chr(1) || chr(2) || chr(3) || chr(4)) AS k FROM keyed)
    SELECT media_id, filename, row_number() OVER (ORDER BY k, media_id) AS position FROM ordered""",
)
def _(t: Tables):
    ranked = ranking.global_rank(t.files.select("media_id", "filename"), views.sort_order("name-asc"), "position")
    return ranked.select("media_id", "filename", "position")


for _key, _order in {
    "date_desc": "last_modified DESC",
    "date_asc": "last_modified ASC",
    "size_desc": "size_bytes DESC",
    "size_asc": "size_bytes ASC",
}.items():

    @query(
        f"sort_items_{_key}",
        with_(M) + f"SELECT media_id, row_number() OVER (ORDER BY {_order}, media_id) AS position FROM media",
    )
    def _(t: Tables, key=_key.replace("_", "-")):
        rows = t.files.select("media_id", "last_modified", "size_bytes", "filename")
        return ranking.global_rank(rows, views.sort_order(key), "position").select("media_id", "position")


@query(
    "month_groups",
    with_(M) + """SELECT strftime(date_trunc('month', last_modified), '%B %Y') AS month, count(*) AS count, max(last_modified) AS newest
    FROM media GROUP BY date_trunc('month', last_modified)""",
)
def _(t: Tables):
    return views.month_groups(t.files)


@query(
    "category_counts",
    with_(M, VIEW_SQL) + "SELECT COALESCE(cat, 'all') AS cat, count(*) AS count FROM view GROUP BY ROLLUP (cat)",
)
def _(t: Tables):
    return views.category_counts(views.photo_view(t.media))


@query("keyset_page", with_(M) + "SELECT media_id, path FROM media WHERE media_id > 'm00000050' ORDER BY media_id LIMIT 200")
def _(t: Tables):
    return views.keyset_page(t.files, "m00000050").select("media_id", "path")


@query(
    "work_batches",
    with_(M) + """SELECT media_id, (row_number() OVER (ORDER BY media_id) - 1) // 50 AS batch FROM media
    WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def _(t: Tables):
    return todo.work_batches(todo.hash_todo(t.files, t.hashes), todo.BATCH_SIZES["hash"])


@query(
    "library_counts",
    with_(M) + """SELECT library_id, count(*) AS item_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, max(last_modified) AS last_seen
    FROM media GROUP BY library_id""",
)
def _(t: Tables):
    return views.library_counts(t.files)


@query(
    "library_list",
    with_(M) + """SELECT library_id, library_id AS name, '/lib/' || library_id AS root_path, count(*) AS item_count,
    CAST(CAST(sum(size_bytes) AS BIGINT) AS VARCHAR) AS total_bytes, min(last_modified) AS created_at FROM media GROUP BY library_id""",
)
def _(t: Tables):
    libraries = t.files.groupBy("library_id").agg(
        F.count(F.lit(1)).alias("item_count"), F.sum("size_bytes").alias("total_bytes"), F.min("last_modified").alias("created_at")
    )
    named = libraries.withColumns({"name": F.col("library_id"), "root_path": F.concat(F.lit("/lib/"), "library_id")})
    return views.library_list(named)


@query(
    "hash_distinct_check",
    with_(M) + """SELECT count(DISTINCT sha256) AS distinct_sha, count(*) AS rows, count(*) FILTER (filename LIKE 'IMG%') AS like_rows,
    count(*) FILTER (filename NOT LIKE 'IMG%') AS unlike_rows FROM media""",
)
def _(t: Tables):
    return views.hash_distinct_check(t.files, "IMG%")


@query(
    "quantile_items",
    with_(M) + """, v AS (SELECT media_id, quality_score AS value, row_number() OVER (ORDER BY quality_score, media_id) AS position,
      count(*) OVER () AS n FROM media WHERE quality_score IS NOT NULL AND isfinite(quality_score))
    SELECT 'sharpness' AS rule, media_id, value, position FROM v WHERE position <= least(n, greatest(3, ceil(n * 0.05e0)))""",
)
def _(t: Tables):
    return ranking.quantile_items(t.media, [ranking.QuantileRule("sharpness", "quality_score", 0.05)])


@query(
    "quantile_members",
    with_(M) + """, q(rule, share, high) AS (VALUES ('blurred', 0.05e0, false), ('bright', 0.02e0, true), ('large', 0.3e0, true)),
    usable AS (SELECT rule, share, high, media_id, CASE rule WHEN 'blurred' THEN quality_score WHEN 'bright' THEN brightness ELSE CAST(width AS DOUBLE) END AS value FROM media, q),
    v AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY CASE WHEN high THEN -value ELSE value END, media_id) AS position, count(*) OVER (PARTITION BY rule) AS n
      FROM usable WHERE value IS NOT NULL AND isfinite(value))
    SELECT rule, media_id, value FROM v WHERE position <= least(n, greatest(3, ceil(n * share)))""",
)
def _(t: Tables):
    rules = [("blurred", "quality_score", 0.05, "low"), ("bright", "brightness", 0.02, "high"), ("large", "width", 0.3, "high")]
    return selection.quantile_members(t.media, [ranking.QuantileRule(*rule) for rule in rules])


@query(
    "diagnostics_bright",
    with_(M) + """, v AS (SELECT media_id, brightness, row_number() OVER (ORDER BY brightness DESC, media_id) AS position, count(*) OVER () AS n
      FROM media WHERE brightness IS NOT NULL)
    SELECT media_id, brightness AS value, position, CASE WHEN position <= least(n, greatest(3, ceil(n * 0.02e0))) THEN 'top' ELSE 'compatible' END AS level
    FROM v WHERE position <= least(n, greatest(3, ceil(n * 0.98e0)))""",
)
def _(t: Tables):
    rules = [
        ranking.QuantileRule("top", "brightness", 0.02, "high"),
        ranking.QuantileRule("compatible", "brightness", 0.98, "high"),
    ]
    taken = ranking.quantile_items(t.media, rules)
    best = taken.groupBy("media_id", "value", "position").agg(F.max("rule").alias("level"))
    return best.select("media_id", "value", "position", "level")


# -- joins and open work ------------------------------------------------------------------------

HASHES_SQL = "hashes AS (SELECT media_id, sha256, dhash_hex FROM media WHERE doc_id IN (SELECT doc_id FROM labels))"


@query(
    "item_hash_join",
    with_(M, HASHES_SQL) + "SELECT m.media_id, m.path, h.sha256, h.dhash_hex FROM media m JOIN hashes h ON h.media_id = m.media_id WHERE m.library_id = 'src1'",
)
def _(t: Tables):
    rows = t.files.select("media_id", "library_id", "path")
    return todo.item_hash_join(rows, t.hashes, "src1").select("media_id", "path", "sha256", "dhash_hex")


@query("hash_todo", with_(M, HASHES_SQL) + "SELECT media_id, path FROM media WHERE media_id NOT IN (SELECT media_id FROM hashes)")
def _(t: Tables):
    return todo.hash_todo(t.files, t.hashes).select("media_id", "path")


@query("exif_todo", with_(M, L) + "SELECT media_id, path FROM media WHERE kind = 'IMAGE' AND media_id NOT IN (SELECT media_id FROM chosen)")
def _(t: Tables):
    return todo.exif_todo(t.files, t.labelled("quality", 0)).select("media_id", "path")


@query(
    "thumb_todo",
    with_(M, L, HASHES_SQL) + "SELECT media_id FROM hashes WHERE media_id NOT IN (SELECT media_id FROM chosen)",
)
def _(t: Tables):
    return todo.thumb_todo(t.hashes, t.labelled("quality", 0)).select("media_id")


THUMB_SQL = "substr(sha256, 1, 2) || '/' || substr(sha256, 3, 2) || '/' || sha256 || '.' || variant || '.webp'"


@query(
    "thumbnail_plan",
    with_(M, L) + f""", present AS (SELECT DISTINCT sha256, 'thumb256' AS variant FROM media WHERE media_id IN (SELECT media_id FROM labelled)),
    wanted AS (SELECT media_id, sha256, width, height, variant, side FROM media,
      (VALUES ('thumb256', 256), ('thumb1024', 1024)) AS v(variant, side) WHERE kind = 'IMAGE')
    SELECT 'tn_' || media_id || '_' || variant AS id, media_id, variant, {THUMB_SQL} AS path,
      greatest(1, CAST(floor(width * least(1e0, CAST(side AS DOUBLE) / greatest(width, height)) + 0.5e0) AS INTEGER)) AS width,
      greatest(1, CAST(floor(height * least(1e0, CAST(side AS DOUBLE) / greatest(width, height)) + 0.5e0) AS INTEGER)) AS height
    FROM wanted WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.sha256 = wanted.sha256 AND p.variant = wanted.variant)""",
)
def _(t: Tables):
    have = t.hashes.select("sha256", F.lit("thumb256").alias("variant"))
    return todo.thumbnail_plan(t.files, have)


@query("thumbnail_lookup", with_(M) + f"SELECT media_id, variant, {THUMB_SQL} AS path FROM (SELECT *, 'thumb256' AS variant FROM media WHERE media_id = 'm00000007')")
def _(t: Tables):
    variant = F.explode(F.array(*[F.lit(v) for v in paths.THUMB_VARIANTS]))
    thumbs = t.files.select("media_id", "sha256", variant.alias("variant")).select(
        "media_id", "variant", paths.thumb_path(F.col("sha256"), F.col("variant")).alias("path")
    )
    return views.thumbnail_lookup(thumbs, "m00000007")


# -- staging ------------------------------------------------------------------------------------


@query("stage", with_(L) + "SELECT media_id FROM staged UNION SELECT media_id FROM chosen")
def _(t: Tables):
    return staging.stage(t.labelled("toxic", 1), t.labelled("quality", 0))


@query("unstage", with_(L) + "SELECT media_id FROM staged EXCEPT SELECT media_id FROM chosen")
def _(t: Tables):
    return staging.unstage(t.labelled("toxic", 1), t.labelled("quality", 0))


@query("clear_staging", with_(L) + "SELECT media_id FROM staged WHERE false")
def _(t: Tables):
    return staging.clear_staging(t.labelled("toxic", 1))


@query("staged_items", with_(M, L) + "SELECT media_id, path, size_bytes FROM media WHERE media_id IN (SELECT media_id FROM staged)")
def _(t: Tables):
    return staging.staged_items(t.files, t.labelled("toxic", 1)).select("media_id", "path", "size_bytes")


@query(
    "invert_staging",
    with_(L) + "(SELECT media_id FROM staged EXCEPT SELECT media_id FROM chosen) UNION (SELECT media_id FROM chosen EXCEPT SELECT media_id FROM staged)",
)
def _(t: Tables):
    return staging.invert_staging(t.labelled("toxic", 1), t.labelled("quality", 0))


FOCUS_SQL = """
subset AS (SELECT m.media_id, m.filename, m.size_bytes, s.media_id IS NOT NULL AS is_staged
  FROM media m JOIN chosen c ON c.media_id = m.media_id LEFT JOIN staged s ON s.media_id = m.media_id)"""


@query("focus_subset", with_(M, L, FOCUS_SQL) + "SELECT * FROM subset")
def _(t: Tables):
    rows = views.focus_subset(t.files, t.labelled("quality", 0), t.labelled("toxic", 1))
    return rows.select("media_id", "filename", "size_bytes", "is_staged")


@query(
    "focus_totals",
    with_(M, L, FOCUS_SQL) + """SELECT count(*) AS items, CAST(COALESCE(sum(size_bytes), 0) AS BIGINT) AS total_bytes, count(*) FILTER (is_staged) AS staged,
    CAST(COALESCE(sum(size_bytes) FILTER (is_staged), 0) AS BIGINT) AS staged_bytes FROM subset""",
)
def _(t: Tables):
    return views.focus_totals(views.focus_subset(t.files, t.labelled("quality", 0), t.labelled("toxic", 1)))


@query(
    "bucket_select",
    with_(M, L) + """, entries AS (SELECT media_id AS id, library_id AS bucket FROM media),
    one AS (SELECT id FROM entries WHERE bucket = 'src3'), whole AS (SELECT count(*) = 0 AS w FROM one WHERE id NOT IN (SELECT media_id FROM staged))
    SELECT media_id AS id FROM staged WHERE NOT (SELECT w FROM whole) OR media_id NOT IN (SELECT id FROM one)
    UNION SELECT id FROM one WHERE NOT (SELECT w FROM whole)""",
)
def _(t: Tables):
    entries = t.files.select(F.col("media_id").alias("id"), F.col("library_id").alias("bucket"))
    return staging.bucket_select(entries, t.labelled("toxic", 1).withColumnRenamed("media_id", "id"), "src3")


# -- scalar functions ---------------------------------------------------------------------------


@query(
    "hash_functions",
    with_(M) + """SELECT media_id, dhash_hex, dhash AS from_hex, printf('%016x', dhash) AS to_hex,
    bit_count(xor(dhash, CAST(6148914691236517205 AS BIGINT))) AS distance FROM media""",
)
def _(t: Tables):
    pattern = F.lit(6148914691236517205).cast("long")
    parsed = hashing.hash_from_hex(F.col("dhash_hex"))
    return t.hashed.select(
        "media_id",
        "dhash_hex",
        parsed.alias("from_hex"),
        hashing.hash_to_hex(parsed).alias("to_hex"),
        hashing.hamming(parsed, pattern).alias("distance"),
    )


@query(
    "vector_functions",
    """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS squared,
      round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(q[i] AS DOUBLE))), 6) AS dot,
      round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(embedding[i] AS DOUBLE) - CAST(q[i] AS DOUBLE)) * (CAST(embedding[i] AS DOUBLE) - CAST(q[i] AS DOUBLE))))), 6) AS l2,
      round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS first
    FROM embeddings, q""",
)
def _(t: Tables):
    from silverprint.functions import vectors

    e = t.raw("embeddings")
    q = e.filter("vec_id = 0").select("embedding").scalar()
    rows = e.withColumn("q", q)
    v = F.col("embedding")
    return rows.select(
        "vec_id",
        F.round(vectors.norm(v) * vectors.norm(v), 6).alias("squared"),
        F.round(vectors.dot(v, F.col("q")), 6).alias("dot"),
        F.round(vectors.l2_distance(v, F.col("q")), 6).alias("l2"),
        F.round(vectors.l2_normalize(v)[0], 6).alias("first"),
    )


@query(
    "path_functions",
    with_(M) + r"""SELECT media_id, regexp_extract(path, '([^/]*)$', 1) AS base, regexp_replace(path, '/[^/]*$', '') AS dir,
    regexp_extract(path, '^.+?(\.[^./]*)$', 1) AS ext, lower(regexp_extract(upper(path), '(\.[^.]*)$', 1)) AS lower_ext,
    '/home/trash/op_1/' || substr(sha1(path), 1, 16) || '/' || filename AS trash,
    substr(sha256, 1, 2) || '/' || substr(sha256, 3, 2) || '/' || sha256 || '.thumb256.webp' AS thumb FROM media""",
)
def _(t: Tables):
    p = F.col("path")
    return t.files.select(
        "media_id",
        paths.basename(p).alias("base"),
        paths.dirname(p).alias("dir"),
        paths.extname(p).alias("ext"),
        paths.ext_of(F.upper(p)).alias("lower_ext"),
        paths.trash_target("/home/trash", F.lit("op_1"), p).alias("trash"),
        paths.thumb_path(F.col("sha256"), F.lit("thumb256")).alias("thumb"),
    )


@query(
    "text_functions",
    with_(M) + rf"""SELECT media_id, {fmt_bytes_sql('size_bytes')} AS fmt, {human_bytes_sql('size_bytes')} AS human,
    {hero_bytes_sql('size_bytes')} AS hero,
    format('{{:,}}', size_bytes) AS counted, CASE WHEN doc_id = 1 THEN 'photo' ELSE 'photos' END AS noun,
    substr(regexp_replace(regexp_replace(filename, '\.[^.]+$', ''), '[_-]', ' ', 'g'), 1, 36) AS label FROM media""",
)
def _(t: Tables):
    n = F.col("size_bytes")
    return t.files.select(
        "media_id",
        text.fmt_bytes(n).alias("fmt"),
        text.human_bytes(n).alias("human"),
        text.hero_bytes(n).alias("hero"),
        text.fmt_count(n).alias("counted"),
        text.plural(F.col("doc_id"), "photo", "photos").alias("noun"),
        text.group_label(F.col("filename")).alias("label"),
    )


@query(
    "time_functions",
    with_(M) + """SELECT media_id, strftime(last_modified, '%Y-%m-%d') AS day, strftime(last_modified, '%B %Y') AS month,
    strftime(last_modified, '%m/%d/%Y %H:%M') AS shown, last_modified + INTERVAL 30 DAY AS expires, strftime(last_modified, '%Y-%m-%dT%H-%M-%S') AS bucket,
    last_modified AS parsed, CAST(epoch_ms(last_modified) AS BIGINT) AS millis FROM media""",
)
def _(t: Tables):
    at = F.col("last_modified")
    return t.files.select(
        "media_id",
        times.iso_date(at).alias("day"),
        times.month_of(at).alias("month"),
        times.member_when(at).alias("shown"),
        times.expires_at(at).alias("expires"),
        times.trash_bucket_name(at).alias("bucket"),
        times.trash_bucket_time(times.trash_bucket_name(at)).alias("parsed"),
        times.epoch_millis(at).alias("millis"),
    )


@query(
    "json_bigint_safe",
    with_(M) + """SELECT media_id, '{"mediaId":"' || media_id || '","sizeBytes":"' || size_bytes || '"}' AS json FROM media""",
)
def _(t: Tables):
    entry = text.json_text(F.col("media_id").alias("mediaId"), F.col("size_bytes").cast("string").alias("sizeBytes"))
    return t.files.select("media_id", entry.alias("json"))


@query("enum_violations", with_(JOBS_SQL) + "SELECT id, 'status' AS \"column\", status AS value FROM jobs WHERE status NOT IN ('PENDING', 'RUNNING', 'DONE') ")
def _(t: Tables):
    from silverprint.schema import enum_violations

    return enum_violations(t.jobs.select("id", "status"), {"status": ("PENDING", "RUNNING", "DONE")}).select("id", "column", "value")
