"""Inputs and SQL fragments used by several registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from silverprint.operators import dedup
from silverprint.parity.tables import LABELLED_SQL, MEDIA_SQL, Tables

SCORE_SQL = (
    "(COALESCE(CAST(width AS DOUBLE) * CAST(height AS DOUBLE), 0e0) + CAST(size_bytes AS DOUBLE) * 1e-4"
    " + CASE WHEN regexp_matches(path, '(?i)DCIM|Camera') THEN 1e6 ELSE 0e0 END"
    " - CASE WHEN regexp_matches(path, '(?i)WhatsApp|Sent|Copy') THEN 5e5 ELSE 0e0 END)"
)

EXACT_SQL = f"""
exact_f AS (SELECT sha256, count(*) AS member_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes
            FROM media GROUP BY sha256 HAVING count(*) > 1),
exact_r AS (SELECT m.*, f.member_count, f.total_bytes, {SCORE_SQL} AS score,
                   row_number() OVER (PARTITION BY m.sha256 ORDER BY {SCORE_SQL} DESC, size_bytes DESC, media_id) AS rn
            FROM media m JOIN exact_f f ON f.sha256 = m.sha256),
exact_groups AS (SELECT 'dg_' || sha256 AS group_id, 'EXACT' AS kind, member_count, total_bytes,
                        media_id AS best_media_id, total_bytes - size_bytes AS recoverable_bytes
                 FROM exact_r WHERE rn = 1),
exact_members AS (SELECT 'dg_' || sha256 AS group_id, media_id, 1e0 AS score,
                         CASE WHEN rn = 1 THEN 'best candidate' ELSE 'duplicate of best' END AS reason
                  FROM exact_r)
"""

NEAR_SQL = f"""
ncand AS (SELECT * FROM media WHERE kind = 'IMAGE' AND dhash_hex <> '0000000000000000'),
nranked AS (SELECT *, row_number() OVER (ORDER BY dhash_hex, media_id) AS rank FROM ncand),
npairs AS (SELECT a.rank AS rank_a, b.rank AS rank_b, a.media_id AS media_id_a, b.media_id AS media_id_b,
                  bit_count(xor(a.dhash, b.dhash)) AS distance
           FROM nranked a JOIN nranked b ON b.rank > a.rank AND b.rank < a.rank + 64
           WHERE a.sha256 <> b.sha256 AND bit_count(xor(a.dhash, b.dhash)) <= 6),
nedge AS (SELECT rank_a AS s, rank_b AS d FROM npairs UNION ALL SELECT rank_b, rank_a FROM npairs),
nreach(node, lab) AS (SELECT DISTINCT s, s FROM nedge
                      UNION SELECT e.d, r.lab FROM nreach r JOIN nedge e ON e.s = r.node WHERE r.lab < e.d),
ncomp AS (SELECT node, min(lab) AS component FROM nreach GROUP BY node),
ntag AS (SELECT r.*, c.component, {SCORE_SQL} AS score,
                row_number() OVER (PARTITION BY c.component ORDER BY {SCORE_SQL} DESC, dhash_hex, media_id) AS rn
         FROM nranked r JOIN ncomp c ON c.node = r.rank),
nbest AS (SELECT component, media_id AS best_media_id, dhash AS best_dhash, size_bytes AS best_size,
                 'ng_' || component || '_' || right(media_id, 8) AS group_id FROM ntag WHERE rn = 1),
near_groups AS (SELECT b.group_id, 'NEAR' AS kind, count(*) AS member_count, CAST(sum(t.size_bytes) AS BIGINT) AS total_bytes,
                       b.best_media_id, CAST(sum(t.size_bytes) - b.best_size AS BIGINT) AS recoverable_bytes
                FROM ntag t JOIN nbest b ON b.component = t.component GROUP BY b.group_id, b.best_media_id, b.best_size),
near_members AS (SELECT b.group_id, t.media_id, 1 - CAST(bit_count(xor(t.dhash, b.best_dhash)) AS DOUBLE) / 64 AS score,
                        CASE WHEN t.media_id = b.best_media_id THEN 'best of cluster'
                             ELSE 'hamming=' || bit_count(xor(t.dhash, b.best_dhash)) END AS reason
                 FROM ntag t JOIN nbest b ON b.component = t.component)
"""

FACTS_SQL = """
all_groups AS (SELECT * FROM exact_groups UNION ALL SELECT * FROM near_groups),
all_members AS (SELECT * FROM exact_members UNION ALL SELECT * FROM near_members),
member_rows AS (SELECT m.group_id, m.media_id, g.kind, g.best_media_id, i.filename, i.sha256, i.size_bytes,
                       i.width, i.height, i.last_modified
                FROM all_members m JOIN all_groups g ON g.group_id = m.group_id JOIN media i ON i.media_id = m.media_id)
"""


def _shown(x: str, digits: int) -> str:
    """Decimal text with ties rounded up."""
    scale = 10**digits
    return f"printf('%.{digits}f', floor(({x}) * {scale} + 0.5e0) / {scale})"


def fmt_bytes_sql(n: str) -> str:
    return (
        f"(CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < 1048576 THEN {_shown(f'{n} / 1024e0', 1)} || ' KB'"
        f" WHEN {n} < 1073741824 THEN {_shown(f'{n} / 1048576e0', 1)} || ' MB' ELSE {_shown(f'{n} / 1073741824e0', 1)} || ' GB' END)"
    )


def _three(x: str) -> str:
    return f"CASE WHEN {x} >= 100 THEN {_shown(x, 0)} ELSE {_shown(x, 1)} END"


def human_bytes_sql(n: str) -> str:
    return (
        f"(CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < 1048576 THEN {_three(f'{n} / 1024e0')} || ' KB'"
        f" WHEN {n} < 1073741824 THEN {_three(f'{n} / 1048576e0')} || ' MB'"
        f" WHEN {n} < 1099511627776 THEN {_three(f'{n} / 1073741824e0')} || ' GB' ELSE {_three(f'{n} / 1099511627776e0')} || ' TB' END)"
    )


def hero_bytes_sql(n: str) -> str:
    return (
        f"(CASE WHEN {n} >= 1073741824 THEN {_three(f'{n} / 1073741824e0')} || ' GB' ELSE {_three(f'{n} / 1048576e0')} || ' MB' END)"
    )


M, E, N, L, A = MEDIA_SQL, EXACT_SQL, NEAR_SQL, LABELLED_SQL, FACTS_SQL


def groups_and_members(t: Tables) -> tuple[DataFrame, DataFrame]:
    return dedup.dedup_recompute(t.media)


def group_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Exact groups and members, near groups and members."""
    near_groups, near_members = dedup.near_dedup(t.media)
    return dedup.exact_dup_groups(t.media), dedup.exact_dup_members(t.media), near_groups, near_members
