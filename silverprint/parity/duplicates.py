"""Duplicate groups, the views on them, cleanup and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from silverprint.operators import cleanup, dedup, hamming_pairs, staging, views
from silverprint.operators.components import connected_components
from silverprint.operators.standing_groups import StandingGroups
from silverprint.parity.registry import query, with_
from silverprint.parity.shared import A, E, L, M, N, SCORE_SQL, fmt_bytes_sql, group_tables, groups_and_members, hero_bytes_sql
from silverprint.parity.tables import Tables
from silverprint.workspace import new_table_path

GROUP_COLUMNS = "group_id, kind, member_count, total_bytes, best_media_id, recoverable_bytes"


@query("exact_dup_groups", with_(M, E) + f"SELECT {GROUP_COLUMNS} FROM exact_groups")
def _(t: Tables):
    return dedup.exact_dup_groups(t.files)


@query("exact_dup_members", with_(M, E) + "SELECT * FROM exact_members")
def _(t: Tables):
    return dedup.exact_dup_members(t.files)


@query(
    "exact_dup_groups_all_libraries",
    with_(M) + f""", f AS (SELECT sha256 FROM media WHERE lang = 'en' GROUP BY sha256 HAVING count(*) > 1),
    r AS (SELECT m.*, row_number() OVER (PARTITION BY sha256 ORDER BY {SCORE_SQL} DESC, size_bytes DESC, media_id) AS rn,
      count(*) OVER (PARTITION BY sha256) AS member_count, CAST(sum(size_bytes) OVER (PARTITION BY sha256) AS BIGINT) AS total_bytes
      FROM media m WHERE sha256 IN (SELECT sha256 FROM f))
    SELECT 'dg_' || sha256 AS group_id, 'EXACT' AS kind, member_count, total_bytes, media_id AS best_media_id,
      total_bytes - size_bytes AS recoverable_bytes FROM r WHERE rn = 1""",
)
def _(t: Tables):
    by_language = t.files.withColumn("library_id", F.col("lang"))
    return dedup.exact_dup_groups(by_language, "en", members_scope="all")


@query(
    "dup_totals",
    with_(M, E) + """SELECT count(*) AS groups, CAST(COALESCE(sum(member_count), 0) AS BIGINT) AS members,
    CAST(COALESCE(sum(recoverable_bytes), 0) AS BIGINT) AS bytes_recoverable FROM exact_groups""",
)
def _(t: Tables):
    return dedup.dup_totals(dedup.exact_dup_groups(t.files))


@query(
    "pick_best",
    with_(M) + f""", r AS (SELECT library_id, media_id, {SCORE_SQL} AS score,
      row_number() OVER (PARTITION BY library_id ORDER BY {SCORE_SQL} DESC, size_bytes DESC, media_id) AS rn FROM media)
    SELECT library_id, media_id AS best_media_id, round(score, 4) AS score FROM r WHERE rn = 1""",
)
def _(t: Tables):
    return dedup.pick_best(t.files, "library_id").withColumn("score", F.round("score", 4))


@query("near_window_pairs", with_(M, N) + "SELECT media_id_a, media_id_b, rank_b - rank_a AS gap, distance FROM npairs")
def _(t: Tables):
    ranked = hamming_pairs.rank_by_hash(hamming_pairs.near_candidates(t.media))
    pairs = hamming_pairs.near_window_pairs(ranked)
    return pairs.select("media_id_a", "media_id_b", (F.col("rank_b") - F.col("rank_a")).alias("gap"), "distance")


BANDED_SQL = """
hg AS (SELECT dhash, min(sha256) AS lo, max(sha256) AS hi, count(*) AS copies FROM media WHERE kind = 'IMAGE' AND dhash <> 0 GROUP BY dhash),
bpairs AS (SELECT a.dhash AS dhash_a, b.dhash AS dhash_b, bit_count(xor(a.dhash, b.dhash)) AS distance
  FROM hg a JOIN hg b ON a.dhash < b.dhash
  WHERE bit_count(xor(a.dhash, b.dhash)) <= 6 AND NOT (a.lo = a.hi AND b.lo = b.hi AND a.lo = b.lo))"""


@query("near_banded_pairs", with_(M, BANDED_SQL) + "SELECT * FROM bpairs")
def _(t: Tables):
    return hamming_pairs.near_banded_pairs(hamming_pairs.hash_groups(hamming_pairs.near_candidates(t.media)))


BANDED_TAG_SQL = """
bedge AS (SELECT dhash_a AS s, dhash_b AS d FROM bpairs UNION ALL SELECT dhash_b, dhash_a FROM bpairs),
breach(node, lab) AS (SELECT DISTINCT s, s FROM bedge UNION SELECT e.d, r.lab FROM breach r JOIN bedge e ON e.s = r.node WHERE r.lab < e.d),
bcomp AS (SELECT node, min(lab) AS component FROM breach GROUP BY node
  UNION SELECT dhash, dhash FROM hg WHERE lo <> hi AND dhash NOT IN (SELECT s FROM bedge))"""


NEAR_BANDED = with_(M, BANDED_SQL, BANDED_TAG_SQL) + f""", r AS (SELECT c.component, media_id, size_bytes,
      row_number() OVER (PARTITION BY c.component ORDER BY {SCORE_SQL} DESC, dhash_hex, media_id) AS rn,
      count(*) OVER (PARTITION BY c.component) AS member_count, CAST(sum(size_bytes) OVER (PARTITION BY c.component) AS BIGINT) AS total_bytes
      FROM media m JOIN bcomp c ON c.node = m.dhash WHERE m.kind = 'IMAGE')
    SELECT 'ng_' || component || '_' || right(media_id, 8) AS group_id, 'NEAR' AS kind, member_count, total_bytes, media_id AS best_media_id,
      total_bytes - size_bytes AS recoverable_bytes FROM r WHERE rn = 1"""


@query(
    "near_dup_groups_banded",
    NEAR_BANDED,
)
def _(t: Tables):
    return dedup.near_dedup(t.media, mode="banded")[0]


@query("near_dup_groups_standing", NEAR_BANDED)
def _(t: Tables):
    """The whole catalog in three batches by a hash of the id; the groups are those of one full run."""
    standing = StandingGroups(t.spark, new_table_path(t.spark, "standing"), parts=16)
    third = F.pmod(F.xxhash64("media_id"), F.lit(3))
    for batch in range(3):
        standing.add(t.media.filter(third == batch))
    return standing.groups(t.media)[0]


@query("near_dup_groups", with_(M, N) + f"SELECT {GROUP_COLUMNS} FROM near_groups")
def _(t: Tables):
    return dedup.near_dedup(t.media)[0]


@query("near_dup_members", with_(M, N) + "SELECT group_id, media_id, score, reason FROM near_members")
def _(t: Tables):
    return dedup.near_dedup(t.media)[1]


@query(
    "near_dedup",
    with_(M, N) + """SELECT count(*) AS groups, CAST(COALESCE(sum(member_count), 0) AS BIGINT) AS members,
    CAST(COALESCE(sum(recoverable_bytes), 0) AS BIGINT) AS bytes_recoverable FROM near_groups""",
)
def _(t: Tables):
    return dedup.dup_totals(dedup.near_dedup(t.media)[0])


@query(
    "connected_components",
    with_(M, N) + "SELECT r.media_id, c.component FROM ncomp c JOIN nranked r ON r.rank = c.node",
)
def _(t: Tables):
    ranked = hamming_pairs.rank_by_hash(hamming_pairs.near_candidates(t.media))
    pairs = hamming_pairs.near_window_pairs(ranked)
    labels = connected_components(pairs, "rank_a", "rank_b").withColumnRenamed("node", "rank")
    return labels.join(ranked.select("rank", "media_id"), "rank").select("media_id", "component")


@query("dedup_recompute", with_(M, E, N, A) + "SELECT * FROM all_members")
def _(t: Tables):
    return dedup.dedup_recompute(t.media)[1]


@query("all_dup_groups", with_(M, E, N) + f"SELECT {GROUP_COLUMNS} FROM exact_groups UNION ALL SELECT {GROUP_COLUMNS} FROM near_groups")
def _(t: Tables):
    return dedup.all_dup_groups(dedup.exact_dup_groups(t.files), dedup.near_dedup(t.media)[0])


@query(
    "dup_member_view",
    with_(M, E, N, A) + r""", f AS (SELECT group_id, min(media_id) AS first_id FROM member_rows GROUP BY group_id)
    SELECT r.group_id, r.media_id, substr(r.sha256, 1, 16) AS uid, r.filename, r.size_bytes AS size, COALESCE(r.width, 0) AS width, COALESCE(r.height, 0) AS height,
      strftime(r.last_modified, '%m/%d/%Y %H:%M') AS "when",
      CASE WHEN r.media_id = r.best_media_id THEN 'Best candidate' WHEN r.kind = 'EXACT' THEN 'Byte-identical' ELSE 'Near duplicate' END AS note,
      CASE WHEN r.kind = 'EXACT' THEN 1e0 ELSE 0.9e0 END AS confidence,
      substr(regexp_replace(regexp_replace(i.filename, '\.[^.]+$', ''), '[_-]', ' ', 'g'), 1, 36) AS label
    FROM member_rows r JOIN f ON f.group_id = r.group_id JOIN media i ON i.media_id = f.first_id""",
)
def _(t: Tables):
    groups, members = groups_and_members(t)
    return dedup.dup_member_view(groups, members, t.files)


@query(
    "dup_recommended_by_size",
    with_(M, E, N, A) + """, r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY size_bytes DESC, media_id) AS rn FROM member_rows)
    SELECT group_id, media_id AS recommended_id, size_bytes FROM r WHERE rn = 1""",
)
def _(t: Tables):
    groups, members = groups_and_members(t)
    return dedup.dup_recommended_by_size(dedup.member_rows(groups, members, t.files))


@query(
    "dup_list_totals",
    with_(M, E, N, A) + "SELECT group_id, count(*) AS copies, CAST(COALESCE(sum(size_bytes), 0) AS BIGINT) AS bytes FROM member_rows GROUP BY ROLLUP (group_id)",
)
def _(t: Tables):
    groups, members = groups_and_members(t)
    return dedup.dup_list_totals(dedup.member_rows(groups, members, t.files))


@query(
    "dup_filename_resolve",
    with_(M, E, N, A) + """, l AS (SELECT filename, max(media_id) AS resolved_id FROM media GROUP BY filename)
    SELECT r.group_id, r.media_id, r.filename, l.resolved_id FROM member_rows r JOIN l ON l.filename = r.filename""",
)
def _(t: Tables):
    groups, members = groups_and_members(t)
    rows = dedup.member_rows(groups, members, t.files).select("group_id", "media_id", "filename")
    return staging.resolve_filenames(rows, t.files)


@query(
    "group_label_index",
    with_(M, E) + "SELECT group_id, 'dg_real_' || (row_number() OVER (ORDER BY group_id) - 1) AS view_id FROM exact_groups",
)
def _(t: Tables):
    from silverprint.operators.ranking import global_rank

    ranked = global_rank(dedup.exact_dup_groups(t.files).select("group_id"), [F.col("group_id")], "n")
    return ranked.select("group_id", F.concat(F.lit("dg_real_"), (F.col("n") - 1).cast("string")).alias("view_id"))


# -- group actions and removal ------------------------------------------------------------------

ACTIONS_SQL = """
big AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY size_bytes DESC, media_id) AS rn FROM member_rows),
actions AS (SELECT b.group_id, b.media_id, b.size_bytes,
  CASE WHEN s.media_id IS NULL AND b.rn = 1 THEN 'keep' ELSE 'trash' END AS action FROM big b LEFT JOIN staged s ON s.media_id = b.media_id)"""


def _actions(t: Tables):
    groups, members = groups_and_members(t)
    return staging.stage_group_actions(dedup.member_rows(groups, members, t.files), t.labelled("toxic", 1))


@query("stage_group_actions", with_(M, E, N, A, L, ACTIONS_SQL) + "SELECT * FROM actions")
def _(t: Tables):
    return _actions(t)


@query(
    "stage_group_totals",
    with_(M, E, N, A, L, ACTIONS_SQL) + """SELECT group_id, count(*) FILTER (action = 'trash') AS trashed, count(*) FILTER (action = 'keep') AS kept,
    CAST(COALESCE(sum(size_bytes) FILTER (action = 'trash'), 0) AS BIGINT) AS trashed_bytes FROM actions GROUP BY group_id""",
)
def _(t: Tables):
    return staging.action_totals(_actions(t))


@query(
    "stage_group_apply",
    with_(M, E, N, A, L, ACTIONS_SQL) + """SELECT media_id FROM staged WHERE media_id NOT IN (SELECT media_id FROM actions WHERE action = 'keep')
    UNION SELECT media_id FROM actions WHERE action = 'trash'""",
)
def _(t: Tables):
    return staging.apply_group_actions(_actions(t), t.labelled("toxic", 1))


@query(
    "next_open_group",
    with_(M, E, L) + """SELECT min(group_id) AS group_id FROM exact_members WHERE group_id > 'dg_8' AND media_id NOT IN (SELECT media_id FROM staged)""",
)
def _(t: Tables):
    return staging.next_open_group(dedup.exact_dup_members(t.files), t.labelled("toxic", 1), "dg_8")


REMOVED_SQL = """
surv AS (SELECT e.group_id, e.media_id, i.size_bytes, g.best_media_id FROM exact_members e JOIN media i ON i.media_id = e.media_id
  JOIN exact_groups g ON g.group_id = e.group_id WHERE e.media_id NOT IN (SELECT media_id FROM chosen)),
rr AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN media_id = best_media_id THEN 0 ELSE 1 END, media_id) AS rn,
  count(*) OVER (PARTITION BY group_id) AS member_count, CAST(sum(size_bytes) OVER (PARTITION BY group_id) AS BIGINT) AS total_bytes FROM surv)"""


def _removed(t: Tables):
    return staging.remove_items(
        t.files, dedup.exact_dup_groups(t.files), dedup.exact_dup_members(t.files), t.labelled("toxic", 1), t.labelled("quality", 0)
    )


@query(
    "remove_items",
    with_(M, E, L, REMOVED_SQL) + """SELECT group_id, 'EXACT' AS kind, member_count, total_bytes, media_id AS best_media_id,
    total_bytes - size_bytes AS recoverable_bytes FROM rr WHERE rn = 1 AND member_count > 1""",
)
def _(t: Tables):
    return _removed(t)[1]


@query(
    "remove_items_members",
    with_(M, E, L, REMOVED_SQL) + "SELECT group_id, media_id FROM rr WHERE member_count > 1",
)
def _(t: Tables):
    return _removed(t)[2].select("group_id", "media_id")


@query("remove_items_catalog", with_(M, L) + "SELECT media_id FROM media WHERE media_id NOT IN (SELECT media_id FROM chosen)")
def _(t: Tables):
    return _removed(t)[0].select("media_id")


# -- cleanup ------------------------------------------------------------------------------------

TOTALS_SQL = """
xt AS (SELECT count(*) AS g, CAST(COALESCE(sum(member_count), 0) AS BIGINT) AS n, CAST(COALESCE(sum(recoverable_bytes), 0) AS BIGINT) AS b FROM exact_groups),
nt AS (SELECT count(*) AS g, CAST(COALESCE(sum(member_count), 0) AS BIGINT) AS n, CAST(COALESCE(sum(recoverable_bytes), 0) AS BIGINT) AS b FROM near_groups),
it AS (SELECT count(*) AS total, CAST(sum(size_bytes) AS BIGINT) AS used,
  count(*) FILTER (category = 'WHATSAPP_FORWARD') AS ws_n, CAST(COALESCE(sum(size_bytes) FILTER (category = 'WHATSAPP_FORWARD'), 0) AS BIGINT) AS ws_b,
  count(*) FILTER (category = 'SCREENSHOT') AS sh_n, CAST(COALESCE(sum(size_bytes) FILTER (category = 'SCREENSHOT'), 0) AS BIGINT) AS sh_b,
  count(*) FILTER (category IN ('DOCUMENT', 'RECEIPT', 'TRANSACTIONAL')) AS do_n,
  CAST(COALESCE(sum(size_bytes) FILTER (category IN ('DOCUMENT', 'RECEIPT', 'TRANSACTIONAL')), 0) AS BIGINT) AS do_b,
  count(*) FILTER (kind = 'VIDEO' AND size_bytes > 524288000) AS vi_n,
  CAST(COALESCE(sum(size_bytes) FILTER (kind = 'VIDEO' AND size_bytes > 524288000), 0) AS BIGINT) AS vi_b FROM media)"""
BUCKETS_SQL = """
buckets AS (
  SELECT 'dups' AS id, 'Exact & visual duplicates' AS label, xt.n + nt.n AS count, xt.b + nt.b AS size, 'Same photo saved multiple times. We picked the best copy of each.' AS "desc", 0.98e0 AS confidence, 'review' AS recommended FROM it, xt, nt
  UNION ALL SELECT 'ws', 'WhatsApp & messenger media', ws_n, ws_b, 'Forwarded memes, low-res copies, and chat thumbnails.', 0.85e0, 'review' FROM it
  UNION ALL SELECT 'shots', 'Screenshots', sh_n, sh_b, 'Captured for a moment in time — most are older than what they referenced.', 0.92e0, 'review' FROM it
  UNION ALL SELECT 'blur', 'Documents & receipts', do_n, do_b, 'Ephemeral by intent — receipts, parking spots, IDs, QR codes.', 0.8e0, 'review' FROM it
  UNION ALL SELECT 'burst', 'Near duplicates', nt.n, nt.b, nt.g || ' near-duplicate cluster(s) — resizes, recompresses, slight crops.', 0.85e0, 'review' FROM nt
  UNION ALL SELECT 'large', 'Large videos (>500 MB)', vi_n, vi_b, 'Long clips you may want to archive or compress.', 0.7e0, 'review' FROM it)"""


def _cleanup_inputs(t: Tables):
    return t.media, dedup.exact_dup_groups(t.files), dedup.near_dedup(t.media)[0]


@query(
    "cleanup_summary",
    with_(M, E, N, TOTALS_SQL) + f"SELECT total AS total_scanned, used AS photos_used, xt.b + nt.b + ws_b AS reclaim, {hero_bytes_sql('(xt.b + nt.b + ws_b)')} AS hero FROM it, xt, nt",
)
def _(t: Tables):
    from silverprint.functions.text import hero_bytes

    return cleanup.cleanup_summary(*_cleanup_inputs(t)).withColumn("hero", hero_bytes(F.col("reclaim")))


@query("cleanup_buckets", with_(M, E, N, TOTALS_SQL, BUCKETS_SQL) + "SELECT * FROM buckets")
def _(t: Tables):
    return cleanup.cleanup_buckets(*_cleanup_inputs(t))


@query("populated_buckets", with_(M, E, N, TOTALS_SQL, BUCKETS_SQL) + "SELECT * FROM buckets WHERE count > 0")
def _(t: Tables):
    return cleanup.populated_buckets(cleanup.cleanup_buckets(*_cleanup_inputs(t)))


@query(
    "storage_share",
    with_(M, E, N, TOTALS_SQL, BUCKETS_SQL) + "SELECT id, size, round(CAST(size AS DOUBLE) / (SELECT CAST(sum(size) AS DOUBLE) FROM buckets), 9) AS share FROM buckets WHERE count > 0",
)
def _(t: Tables):
    shares = cleanup.storage_share(cleanup.cleanup_buckets(*_cleanup_inputs(t)))
    return shares.withColumn("share", F.round("share", 9))


@query(
    "diagnostics",
    with_(M, E, N, TOTALS_SQL) + """SELECT count(*) AS total_files, count(*) FILTER (kind = 'IMAGE') AS total_images, count(*) FILTER (kind = 'VIDEO') AS total_videos,
    count(sha256) AS hashed, count(*) FILTER (dhash_hex <> '0000000000000000') AS with_dhash, count(quality_score) AS with_quality,
    CAST(least(count(quality_score), greatest(3, ceil(count(quality_score) * 0.05e0))) AS BIGINT) AS blurry_count,
    CAST(least(count(brightness), greatest(3, ceil(count(brightness) * 0.05e0))) AS BIGINT) AS dark_count,
    CAST(least(count(brightness), greatest(3, ceil(count(brightness) * 0.02e0))) AS BIGINT) AS bright_count,
    count(*) FILTER (category = 'SCREENSHOT') AS screenshots, count(*) FILTER (category = 'WHATSAPP_FORWARD') AS whatsapp,
    count(*) FILTER (category IN ('DOCUMENT', 'RECEIPT', 'TRANSACTIONAL')) AS transactional, count(embedding) AS embedded,
    count(*) FILTER (doc_id < (SELECT (n + 1) // 2 FROM nv)) AS with_faces,
    CAST(sum(CASE WHEN doc_id * 2 + 1 < (SELECT n FROM nv) THEN 2 WHEN doc_id * 2 < (SELECT n FROM nv) THEN 1 ELSE 0 END) AS BIGINT) AS total_faces,
    (SELECT g FROM xt) AS exact_groups, (SELECT n FROM xt) AS exact_files, (SELECT g FROM nt) AS near_groups, (SELECT n FROM nt) AS near_files FROM media""",
)
def _(t: Tables):
    items, exact, near = _cleanup_inputs(t)
    return cleanup.diagnostics(items.join(t.face_items, "media_id", "left"), exact, near)


@query("classified_counts", with_(M) + "SELECT category, count(*) AS count FROM media GROUP BY category")
def _(t: Tables):
    return cleanup.classified_counts(t.media)


@query(
    "scan_summary",
    with_(M, E) + """SELECT count(*) AS files, count(*) FILTER (kind = 'IMAGE') AS images, count(*) FILTER (kind = 'VIDEO') AS videos,
    CAST(sum(size_bytes) AS BIGINT) AS total_bytes, (SELECT count(*) FROM exact_groups) AS groups FROM media""",
)
def _(t: Tables):
    return views.scan_summary(t.files, dedup.exact_dup_groups(t.files))


SUGGEST_SQL = """
q AS (SELECT media_id, size_bytes, quality_score, brightness, color_variance,
    row_number() OVER (ORDER BY quality_score NULLS LAST, media_id) AS p1, count(quality_score) OVER () AS n1,
    row_number() OVER (ORDER BY brightness NULLS LAST, media_id) AS p2, count(brightness) OVER () AS n2,
    row_number() OVER (ORDER BY color_variance NULLS LAST, media_id) AS p3, count(color_variance) OVER () AS n3,
    row_number() OVER (ORDER BY brightness DESC NULLS LAST, media_id) AS p4 FROM media WHERE kind = 'IMAGE'),
smembers AS (
  SELECT 'dups-exact' AS suggestion_id, e.media_id, i.size_bytes AS bytes FROM exact_members e JOIN media i ON i.media_id = e.media_id WHERE e.reason <> 'best candidate'
  UNION ALL SELECT 'dups-near', e.media_id, i.size_bytes FROM near_members e JOIN media i ON i.media_id = e.media_id WHERE e.reason <> 'best of cluster'
  UNION ALL SELECT 'blurry', media_id, size_bytes FROM q WHERE p1 <= least(n1, greatest(3, ceil(n1 * 0.05e0)))
  UNION ALL SELECT 'dark', media_id, size_bytes FROM q WHERE p2 <= least(n2, greatest(3, ceil(n2 * 0.05e0)))
  UNION ALL SELECT 'blank', media_id, size_bytes FROM q WHERE p3 <= least(n3, greatest(3, ceil(n3 * 0.05e0)))
  UNION ALL SELECT 'blown', media_id, size_bytes FROM q WHERE p4 <= least(n2, greatest(3, ceil(n2 * 0.02e0)))
  UNION ALL SELECT 'screenshots', media_id, size_bytes FROM media WHERE category = 'SCREENSHOT'
  UNION ALL SELECT 'messenger', media_id, size_bytes FROM media WHERE category = 'WHATSAPP_FORWARD'
  UNION ALL SELECT 'transactional', media_id, size_bytes FROM media WHERE category IN ('DOCUMENT', 'RECEIPT', 'TRANSACTIONAL')
  UNION ALL SELECT 'tiny', media_id, size_bytes FROM media WHERE kind = 'IMAGE' AND width <= 800 AND height <= 800
  UNION ALL SELECT 'bigvideo', media_id, size_bytes FROM media WHERE kind = 'VIDEO' AND size_bytes > 524288000),
scount AS (SELECT suggestion_id AS id, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS b FROM smembers GROUP BY suggestion_id HAVING suggestion_id <> 'tiny' OR count(*) >= 3)"""


def _s(n: str) -> str:
    return f"CASE WHEN {n} = 1 THEN '' ELSE 's' END"


_XG, _NG, _FB = "(SELECT count(*) FROM exact_groups)", "(SELECT count(*) FROM near_groups)", fmt_bytes_sql("b")
SUGGESTIONS_SQL = f"""
SELECT id,
  CASE id WHEN 'dups-exact' THEN 'save' WHEN 'dups-near' THEN 'burst' WHEN 'blurry' THEN 'blur' WHEN 'dark' THEN 'dark' WHEN 'blank' THEN 'blank'
    WHEN 'blown' THEN 'dark' WHEN 'screenshots' THEN 'shot' WHEN 'messenger' THEN 'wa' WHEN 'transactional' THEN 'doc' WHEN 'tiny' THEN 'tiny' ELSE 'video' END AS icon,
  CASE id WHEN 'dups-exact' THEN 'Remove ' || n || ' exact-duplicate cop' || CASE WHEN n = 1 THEN 'y' ELSE 'ies' END
    WHEN 'dups-near' THEN 'Keep best frame of ' || {_NG} || ' near-duplicate cluster' || {_s(_NG)}
    WHEN 'blurry' THEN 'Review ' || n || ' least-sharp photo' || {_s('n')} WHEN 'dark' THEN 'Review ' || n || ' darkest photo' || {_s('n')}
    WHEN 'blank' THEN 'Review ' || n || ' likely blank or accidental photo' || {_s('n')} WHEN 'blown' THEN 'Review ' || n || ' overexposed photo' || {_s('n')}
    WHEN 'screenshots' THEN n || ' screenshot' || {_s('n')} || ' detected' WHEN 'messenger' THEN n || ' WhatsApp/messenger file' || {_s('n')}
    WHEN 'transactional' THEN n || ' ephemeral document' || {_s('n')} WHEN 'tiny' THEN n || ' low-resolution image' || {_s('n')}
    ELSE n || ' large video' || {_s('n')} || ' (>500 MB each)' END AS title,
  CASE id WHEN 'dups-exact' THEN {_XG} || ' duplicate group' || {_s(_XG)} || ' found by SHA-256 · recover ' || {_FB}
    WHEN 'dups-near' THEN n || ' extra copies found by perceptual hash · recover ' || {_FB}
    WHEN 'blurry' THEN 'Bottom 5% by Laplacian variance · ' || {_FB} || ' · likely blurry or out of focus'
    WHEN 'dark' THEN 'Bottom 5% by mean luma · ' || {_FB} || ' · likely underexposed or accidental pocket shots'
    WHEN 'blank' THEN 'Lowest 5% RGB variance · ' || {_FB} || ' · walls, lens-covered, near-monochrome — usually safe to delete'
    WHEN 'blown' THEN 'Top 2% brightness · ' || {_FB} || ' · mostly white frames'
    WHEN 'screenshots' THEN 'Matched filename pattern (Screenshot_*, /Screenshots/) · ' || {_FB}
    WHEN 'messenger' THEN 'Matched IMG-YYYYMMDD-WA* or /WhatsApp/Media/ path · ' || {_FB}
    WHEN 'transactional' THEN 'Receipts, QR codes, parking spots, IDs · ' || {_FB}
    WHEN 'tiny' THEN '≤800px on the long edge · ' || {_FB} || ' · typically shared/compressed copies'
    ELSE 'Often safe to archive or compress · ' || {_FB} || ' total' END AS body,
  n AS count, b AS bytes,
  CAST(CASE id WHEN 'dups-exact' THEN 1 WHEN 'dups-near' THEN 2 WHEN 'blurry' THEN 3 WHEN 'dark' THEN 4 WHEN 'blank' THEN 4.5 WHEN 'blown' THEN 5
    WHEN 'screenshots' THEN 6 WHEN 'messenger' THEN 7 WHEN 'transactional' THEN 8 WHEN 'tiny' THEN 9 ELSE 10 END AS DOUBLE) AS priority FROM scount"""


def _suggested(t: Tables):
    exact, exact_members, near, near_members = group_tables(t)
    return cleanup.suggestion_members(t.media, exact_members, near_members), exact, near


@query("suggestion_members", with_(M, E, N, SUGGEST_SQL) + "SELECT * FROM smembers")
def _(t: Tables):
    return _suggested(t)[0]


@query("suggestions", with_(M, E, N, SUGGEST_SQL) + SUGGESTIONS_SQL)
def _(t: Tables):
    return cleanup.suggestions(*_suggested(t))


@query(
    "suggestion_order",
    with_(M, E, N, SUGGEST_SQL) + f"SELECT id, row_number() OVER (ORDER BY priority) AS position FROM ({SUGGESTIONS_SQL})",
)
def _(t: Tables):
    from silverprint.operators.ranking import global_rank

    rows = cleanup.suggestions(*_suggested(t)).select("id", "priority")
    return global_rank(rows, [F.col("priority"), F.col("id")], "position").select("id", "position")


@query(
    "suggestion_totals",
    with_(M, E, N, SUGGEST_SQL) + "SELECT count(*) AS suggestions, CAST(sum(n) AS BIGINT) AS files, CAST(sum(b) AS BIGINT) AS bytes FROM scount WHERE id <> 'dark'",
)
def _(t: Tables):
    dismissed = t.spark.createDataFrame([("dark",)], "id string")
    return cleanup.suggestion_totals(cleanup.visible_suggestions(cleanup.suggestions(*_suggested(t)), dismissed))


@query(
    "suggestion_totals_distinct",
    with_(M, E, N, SUGGEST_SQL) + "SELECT count(*) AS files, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT media_id, max(bytes) AS b FROM smembers GROUP BY media_id)",
)
def _(t: Tables):
    return cleanup.suggestion_totals_distinct(_suggested(t)[0])


@query(
    "safe_suggestions",
    with_(M, E, N, SUGGEST_SQL) + "SELECT DISTINCT media_id FROM smembers WHERE suggestion_id IN ('dups-exact', 'dups-near')",
)
def _(t: Tables):
    dismissed = t.spark.createDataFrame([("dark",)], "id string")
    return cleanup.safe_suggestions(_suggested(t)[0], dismissed)


@query(
    "keep_score_full",
    with_(M, E) + f""", s AS (SELECT m.media_id, m.size_bytes, {SCORE_SQL} + CASE WHEN l.doc_id IS NOT NULL THEN 25e4 ELSE 0e0 END
        + COALESCE(l.quality, 0e0) * 1e5 - (len(string_split(path, '/')) - 1) * 1e3 AS score
      FROM media m LEFT JOIN (SELECT doc_id, CAST(max(quality) AS DOUBLE) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = m.doc_id),
    r AS (SELECT e.group_id, e.media_id, s.score, row_number() OVER (PARTITION BY group_id ORDER BY s.score DESC, s.size_bytes DESC, e.media_id) AS rn
      FROM exact_members e JOIN s ON s.media_id = e.media_id)
    SELECT a.group_id, a.media_id AS best_media_id, round(least(1e0, greatest(0e0, (a.score - b.score) / greatest(abs(a.score), 1e0))), 9) AS confidence
    FROM r a JOIN r b ON b.group_id = a.group_id AND b.rn = 2 WHERE a.rn = 1""",
)
def _(t: Tables):
    graded = t.raw("labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("aesthetic"))
    quality = t.files.select("doc_id", "media_id").join(graded, "doc_id").select("media_id", "aesthetic")
    scored = dedup.keep_score_full(t.files, quality, quality)
    kept = dedup.keep_with_confidence(scored, dedup.exact_dup_members(t.files))
    return kept.withColumn("confidence", F.round("confidence", 9))
