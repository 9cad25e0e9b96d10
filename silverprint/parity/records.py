"""Sources, merges, plans, undo and albums."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from silverprint.functions import models
from silverprint.operators import dedup, merge
from silverprint.parity import headers
from silverprint.parity.registry import query, with_
from silverprint.parity.shared import E, L, M, human_bytes_sql
from silverprint.parity.tables import Tables
from silverprint.plans import naming, operations
from silverprint.sources import exif as exif_source
from silverprint.sources import exif_bytes, images, listing, tables
from silverprint.sources.tree import file_system
from silverprint.sources.versions import VersionedTables
from silverprint.workspace import new_table_path

# -- listings -----------------------------------------------------------------------------------

DIRS = ["DCIM/", ".git/", "Trip/a/", "node_modules/x/", "@eaDir/", "Docs/", "System Volume Information/", "my.trash/"]
PREFIXES = ["", ".", "~$", "_"]
ENDINGS = [".JPG", ".txt", ".mp4", ".cr2", ".Heic", ".mts"]
TREE_SQL = f"""
tree AS (SELECT '/lib/' || source || '/' || ({DIRS})[doc_id % 8 + 1] || ({PREFIXES})[n_chars % 4 + 1] || 'file' || doc_id || ({ENDINGS})[doc_id % 6 + 1] AS path,
  octet_length(encode(text)) AS size_bytes FROM documents),
parted AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS filename, regexp_extract(path, '(\\.[^./]*)$', 1) AS ext, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS dirs FROM tree)"""


def _write_file(path: str, content) -> None:
    """Write a file below any file system that Arrow knows."""
    system, inner = file_system(path)
    system.create_dir(inner.rsplit("/", 1)[0])
    with system.open_output_stream(inner) as stream:
        stream.write(content)


def _write_files(batches):
    """Write each row's content to its path; contents stay in the Arrow batch and are not copied."""
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            _write_file(path.as_py(), content.as_buffer())
        yield batch.select(["path"])


def _tree(t: Tables) -> str:
    """Documents written as files into a tree with awkward names; the folder of the tree."""
    from silverprint.parity.tables import _pick

    root = re.sub("^file:(//)?(?=/)", "", new_table_path(t.spark, "lib"))
    d = F.col("doc_id")
    named = t.raw("documents").select(
        F.concat(
            F.lit(root + "/"), "source", F.lit("/"), _pick(DIRS, d % 8), _pick(PREFIXES, F.col("n_chars") % 4), F.lit("file"), d.cast("string"), _pick(ENDINGS, d % 6)
        ).alias("path"),
        F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"),
    )
    named.repartition(F.xxhash64("path")).mapInArrow(_write_files, "path string").write.format("noop").mode("overwrite").save()
    return root


def _below(root: str):
    """Paths as if the tree lay at /lib."""
    return F.concat(F.lit("/lib"), F.expr(f"substring(path, {len(root) + 1})")).alias("path")


@query(
    "scan_files",
    with_(TREE_SQL) + f"""SELECT path, filename, ext, CASE WHEN lower(ext) IN ('.mp4', '.mts') THEN 'VIDEO' ELSE 'IMAGE' END AS kind, size_bytes FROM parted
    WHERE ext <> '.txt' AND NOT list_has_any(dirs, {[*listing.IGNORED_DIRS, '.apphome']}) AND NOT starts_with(filename, '.') AND NOT starts_with(filename, '~$')""",
)
def _(t: Tables):
    root = _tree(t)
    return listing.scan_files(t.spark, root, (".apphome",)).select(_below(root), "filename", "ext", "kind", "size_bytes")


@query(
    "scan_files_unfiltered",
    with_(TREE_SQL) + """SELECT path, CASE WHEN lower(ext) = '.mp4' THEN 'VIDEO' ELSE 'IMAGE' END AS kind, size_bytes FROM parted WHERE lower(ext) IN ('.jpg', '.mp4', '.heic')""",
)
def _(t: Tables):
    root = _tree(t)
    return listing.scan_files_unfiltered(t.spark, root).select(_below(root), "kind", "size_bytes")


@query("content_hash", "SELECT 'm' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS media_id, sha256(COALESCE(text, '')) AS sha256 FROM documents")
def _(t: Tables):
    number = F.regexp_extract("path", r"file(\d+)\.[^./]*$", 1)
    return listing.content_hash(t.spark, _tree(t)).select(F.concat(F.lit("m"), F.lpad(number, 8, "0")).alias("media_id"), "sha256")


def _pictures(t: Tables):
    """Vectors as 8 by 8 grey pictures, in the shape Spark's image source gives."""
    hex_ = F.transform("embedding", lambda x: F.lpad(F.hex(F.floor((x.cast("double") + 1) * 127.5)), 2, "0"))
    return t.raw("embeddings").select(
        "vec_id",
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.lit(1).alias("nChannels"),
        F.unhex(F.array_join(hex_, "")).alias("data"),
    )


PIXELS_SQL = """
px AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5e0) AS INTEGER)) AS p FROM embeddings),
flat AS (SELECT vec_id, avg(v) / 255 AS brightness, var_pop(v) AS color_variance FROM (SELECT vec_id, unnest(p) AS v FROM px) GROUP BY vec_id),
wide AS (SELECT vec_id, y, list_transform(range(0, 9), lambda j: CAST(floor(list_sum(list_transform(range(0, 8), lambda i:
    greatest(0, least(9 * i + 9, 8 * j + 8) - greatest(9 * i, 8 * j)) * p[y * 8 + i + 1])) / 8e0 + 0.5e0) AS INTEGER)) AS g FROM px, range(0, 8) AS r(y)),
dh AS (SELECT vec_id, lpad(lower(to_hex(COALESCE(bit_or(CAST(1 AS UBIGINT) << CAST(63 - (y * 8 + x) AS UBIGINT)) FILTER (g[x + 1] < g[x + 2]), 0))), 16, '0') AS dhash_hex
  FROM wide, range(0, 8) AS c(x) GROUP BY vec_id),
lap AS (SELECT vec_id, var_pop((p[((y - 1) // 16) * 8 + x // 16 + 1] + p[((y + 1) // 16) * 8 + x // 16 + 1] + p[(y // 16) * 8 + (x - 1) // 16 + 1]
    + p[(y // 16) * 8 + (x + 1) // 16 + 1] - 4 * p[(y // 16) * 8 + x // 16 + 1]) / 255e0) * 1e6 AS quality_score
  FROM px, range(1, 127) AS a(y), range(1, 127) AS b(x) GROUP BY vec_id)"""


@query(
    "image_pixels",
    with_(PIXELS_SQL) + """SELECT f.vec_id, d.dhash_hex, round(l.quality_score, 6) AS quality_score, round(f.brightness, 9) AS brightness, round(f.color_variance, 6) AS color_variance
    FROM flat f JOIN dh d ON d.vec_id = f.vec_id JOIN lap l ON l.vec_id = f.vec_id""",
)
def _(t: Tables):
    return images.with_features(_pictures(t)).select(
        "vec_id",
        "dhash_hex",
        F.round("quality_score", 6).alias("quality_score"),
        F.round("brightness", 9).alias("brightness"),
        F.round("color_variance", 6).alias("color_variance"),
    )


@query(
    "quality_exposure",
    with_(PIXELS_SQL) + "SELECT vec_id, round(avg(CASE WHEN v / 255e0 BETWEEN 0.18e0 AND 0.92e0 THEN 1e0 ELSE 0e0 END), 6) AS exposure FROM (SELECT vec_id, unnest(p) AS v FROM px) GROUP BY vec_id",
)
def _(t: Tables):
    return images.with_features(_pictures(t)).select("vec_id", F.round("exposure", 6).alias("exposure"))


# -- the caller's models: tiny deterministic ones, to run the wrappers ----------------------------


def _vowel_counter():
    return lambda text: [text.count(v) for v in "aeiou"]


def _corner_face():
    def find(data: bytes) -> list[dict]:
        if data[0] < 128:
            return []
        return [{"x": data[0], "y": data[1], "w": 8, "h": 8, "descriptor": [float(v) for v in data]}]

    return find


def _pixel_reader():
    return lambda data: ("".join(chr(97 + v % 26) for v in data), "xx")


@query(
    "encode",
    f"""WITH c AS (SELECT doc_id, {", ".join(f"CAST(len(text) - len(replace(text, '{v}', '')) AS DOUBLE) AS {v}" for v in "aeiou")} FROM documents),
    l AS (SELECT *, sqrt(a * a + e * e + i * i + o * o + u * u) AS len FROM c),
    n AS (SELECT *, CASE WHEN len = 0 THEN 1e0 ELSE len END AS d FROM l)
    SELECT doc_id, round(CAST(CAST(a / d AS FLOAT) AS DOUBLE), 6) AS a, round(CAST(CAST(u / d AS FLOAT) AS DOUBLE), 6) AS u FROM n""",
)
def _(t: Tables):
    vectors = t.raw("documents").select("doc_id", models.encode(_vowel_counter)("text").alias("v"))
    return vectors.select("doc_id", *[F.round(F.col("v")[i].cast("double"), 6).alias(n) for i, n in ((0, "a"), (4, "u"))])


@query(
    "detect_faces",
    with_(PIXELS_SQL) + "SELECT vec_id, CASE WHEN p[1] < 128 THEN 0 ELSE 1 END AS faces, CASE WHEN p[1] >= 128 THEN p[2] END AS y, CASE WHEN p[1] >= 128 THEN list_sum(p) END AS total FROM px",
)
def _(t: Tables):
    found = _pictures(t).select("vec_id", models.detect_faces(_corner_face)("data").alias("f"))
    total = F.aggregate(F.try_element_at("f", F.lit(1))["descriptor"], F.lit(0.0), lambda a, x: a + x.cast("double"))
    return found.select(
        "vec_id", F.size("f").alias("faces"), F.try_element_at("f", F.lit(1))["y"].alias("y"), total.cast("long").alias("total")
    )


@query(
    "ocr",
    with_(PIXELS_SQL) + "SELECT vec_id, array_to_string(list_transform(p, lambda v: chr(97 + v % 26)), '') AS text, 'xx' AS language, len(p) AS char_count FROM px",
)
def _(t: Tables):
    return _pictures(t).select("vec_id", models.ocr(_pixel_reader)("data").alias("o")).select("vec_id", "o.*")


@query(
    "exif_normalize",
    with_(M) + """SELECT media_id, 'Maker ' || library_id AS make, CAST(doc_id % 100 * 100 AS INTEGER) AS iso, CAST(n_chars AS DOUBLE) / 10 AS f_number, CAST(width AS INTEGER) AS width,
    CASE WHEN lang <> 'en' THEN last_modified END AS taken_at FROM media""",
)
def _(t: Tables):
    records = t.files.select(
        "media_id",
        F.to_json(
            F.struct(
                F.concat(F.lit("Maker "), "library_id").alias("Make"),
                (F.col("doc_id") % 100 * 100).alias("ISO"),
                (F.col("size_bytes") / F.when(F.col("kind") == "VIDEO", 1_000_000).otherwise(10_000)).alias("FNumber"),
                F.col("width").alias("ImageWidth"),
                F.when(F.col("lang") != "en", F.date_format("last_modified", "yyyy:MM:dd HH:mm:ss"))
                .otherwise("0000:00:00 unknown")
                .alias("DateTimeOriginal"),
            )
        ).alias("raw_json"),
    )
    return exif_source.exif_normalize(records).select("media_id", "make", "iso", "f_number", "width", "taken_at")


def _photo(d: int, n: int, source: str, lang: str) -> bytes:
    """Image header for a row of documents: four formats, both byte orders, cut headers, and files that are no images."""
    order = "<>"[d % 2]
    taken = "0000:00:00 00:00:00" if lang == "en" else f"2024:01:{d % 28 + 1:02d} {d % 24:02d}:{d % 60:02d}:00"
    main = [(0x010F, 2, f"Maker {source}"), (0x0112, 3, d % 8 + 1)]
    exif = [(0x829D, 5, [n, 10]), (0x8827, 3, d % 100 * 100), (0x9003, 2, taken)]
    gps = [(1, 2, "NS"[d % 2]), (2, 5, [d % 90, 1, 30, 1, 0, 1])]
    width, height = n % 60_000 + 1, d % 60_000 + 1
    if d % 5 == 3:
        return headers.block(order, [*main, (0x0100, 4, width), (0x0101, 4, height)], exif, gps)
    if d % 5 == 4:
        return b"no image"
    tags = headers.block(order, main, exif, gps)
    tags = tags[:12] if d % 11 == 0 else tags  # the directory is cut
    return [headers.jpeg, headers.png, headers.webp][d % 5](width, height, tags)


def _write_photos(batches):
    """Write each row's image header to its path, one at a time."""
    for batch in batches:
        for path, d, n, source, lang in zip(*[batch[c] for c in ("path", "doc_id", "n_chars", "source", "lang")]):
            _write_file(path, bytes(_photo(d, n, source, lang)))
        yield batch[["path"]]


@query(
    "exif_from_files",
    """SELECT 'm' || doc_id AS media_id, CASE WHEN whole THEN 'Maker ' || source END AS make, CASE WHEN whole THEN CAST(doc_id % 100 * 100 AS INTEGER) END AS iso,
    CASE WHEN whole THEN CAST(n_chars AS DOUBLE) / 10 END AS f_number, CASE WHEN whole THEN CAST(doc_id % 8 + 1 AS INTEGER) END AS orientation,
    CASE WHEN whole THEN (doc_id % 90 + 0.5e0) * CASE WHEN doc_id % 2 = 1 THEN -1 ELSE 1 END END AS gps_lat,
    CAST(n_chars % 60000 + 1 AS INTEGER) AS width, CAST(doc_id % 60000 + 1 AS INTEGER) AS height,
    CASE WHEN whole AND lang <> 'en' THEN make_timestamp(2024, 1, doc_id % 28 + 1, doc_id % 24, doc_id % 60, 0) END AS taken_at
    FROM (SELECT *, doc_id % 5 = 3 OR doc_id % 11 <> 0 AS whole FROM documents) WHERE doc_id % 5 <> 4""",
)
def _(t: Tables):
    root = re.sub("^file:(//)?(?=/)", "", new_table_path(t.spark, "photos"))
    path = F.concat(F.lit(root + "/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".img"))
    docs = t.raw("documents").select("doc_id", "n_chars", "source", "lang", path.alias("path"))
    docs.repartition(F.xxhash64("path")).mapInPandas(_write_photos, "path string").write.format("noop").mode("overwrite").save()
    listed = listing.list_tree(t.spark, root).select(F.concat(F.lit("m"), F.regexp_extract("path", r"(\d+)\.img$", 1)).alias("media_id"), "path")
    return exif_bytes.read_exif(listed).select("media_id", "make", "iso", "f_number", "orientation", "gps_lat", "width", "height", "taken_at")


# -- merges -------------------------------------------------------------------------------------


@query(
    "library_upsert",
    r"""WITH known AS (SELECT source AS library_id, source AS name, '/lib/' || source AS root_path, TIMESTAMP '2024-01-01' AS created_at FROM documents GROUP BY source),
    roots AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages)
    SELECT * FROM known UNION ALL
    SELECT 'lib_' || sha1('/web/' || host), host, '/web/' || host, TIMESTAMP '2024-02-01' FROM roots""",
)
def _(t: Tables):
    first, later = (F.lit(d).cast("timestamp") for d in ("2024-01-01", "2024-02-01"))
    known = t.raw("documents").groupBy("source").agg(F.lit(1)).select(
        F.col("source").alias("library_id"), F.col("source").alias("name"), F.concat(F.lit("/lib/"), "source").alias("root_path"), first.alias("created_at")
    )
    hosts = t.raw("pages").select(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"))
    again = known.select(F.concat("root_path", F.lit("/")).alias("root_path"), F.lit("renamed").alias("name"), later.alias("created_at"))
    roots = hosts.select(
        F.concat(F.lit("/web/"), "host", F.lit("/")).alias("root_path"), F.lit(None).cast("string").alias("name"), later.alias("created_at")
    )
    return merge.library_upsert(known, roots.unionByName(again))


def _upsert_input(t: Tables):
    """A catalog, and a listing with changed and with new files."""
    media = t.media.withColumn("is_hashed", F.lit(True))
    seen = t.files.join(t.raw("labels").select("doc_id").distinct(), "doc_id", "left_semi").select(
        "path", "library_id", "filename", (F.col("size_bytes") + 1).alias("size_bytes"), "last_modified"
    )
    name = F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".jpg"))
    fresh = t.raw("pages").select(
        F.concat(F.lit("/lib/web/Screenshots/"), name).alias("path"),
        F.lit("web").alias("library_id"),
        name.alias("filename"),
        F.length("html").cast("long").alias("size_bytes"),
        F.lit("2024-05-01").cast("timestamp").alias("last_modified"),
    )
    return media, seen.unionByName(fresh)


MEDIA_UPSERT_SQL = with_(M, L) + """SELECT path, media_id, library_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, category,
      doc_id NOT IN (SELECT doc_id FROM labels) AS is_hashed FROM media
    UNION ALL SELECT '/lib/web/Screenshots/page' || page_id || '.jpg', 'm' || sha1('/lib/web/Screenshots/page' || page_id || '.jpg'), 'web', len(html), 'SCREENSHOT', false FROM pages"""
UPSERTED = ["path", "media_id", "library_id", "size_bytes", "category", "is_hashed"]


@query("media_upsert", MEDIA_UPSERT_SQL)
def _(t: Tables):
    return merge.media_upsert(*_upsert_input(t)).select(*UPSERTED)


@query("media_upsert_stored", MEDIA_UPSERT_SQL)
def _(t: Tables):
    """The same merge into a stored catalog, cut by folder: only the folders of the listing are written again."""
    media, seen = _upsert_input(t)
    catalog = VersionedTables(t.spark, new_table_path(t.spark, "catalog"))
    columns = [c for c in media.columns if c not in ("dhash", "embedding")]
    catalog.create("media", media.select(*columns), "pmod(xxhash64(regexp_replace(path, '/[^/]*$', '')), 64)")
    catalog.merge("media", seen, merge.media_upsert)
    return catalog.read("media").select(*UPSERTED)


@query("dup_rebuild_stored", with_(M, E) + "SELECT g.group_id, g.kind, g.member_count, m.media_id FROM exact_groups g JOIN exact_members m ON m.group_id = g.group_id")
def _(t: Tables):
    """Groups and members replaced in one commit."""
    catalog = VersionedTables(t.spark, new_table_path(t.spark, "catalog"))
    exact, members = dedup.exact_dup_groups(t.files), dedup.exact_dup_members(t.files).withColumn("kind", F.lit("EXACT"))
    stale = F.concat(F.lit("stale_"), "group_id")
    catalog.create("dup_group", exact.withColumn("group_id", stale), "kind")
    catalog.create("dup_member", members.withColumn("group_id", stale), "kind")
    catalog.replace({"dup_group": exact, "dup_member": members}, ["EXACT"])
    now = catalog.manifest()
    groups = catalog.read("dup_group", now).select("group_id", "kind", "member_count")
    return groups.join(catalog.read("dup_member", now).select("group_id", "media_id"), "group_id")


@query(
    "hash_upsert",
    with_(M) + """SELECT media_id, sha256(path) AS sha256, dhash_hex, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-01' END AS computed_at FROM media""",
)
def _(t: Tables):
    old = t.hashes.withColumn("computed_at", F.lit("2024-01-01").cast("timestamp"))
    new = t.hashed.select(
        "media_id", F.sha2("path", 256).alias("sha256"), "dhash_hex", F.lit("2024-02-01").cast("timestamp").alias("computed_at")
    )
    return merge.hash_upsert(old, new)


EXIF_SQL = """
read AS (SELECT m.media_id, 'New' AS make, CASE WHEN m.kind = 'VIDEO' THEN NULL ELSE 100 END AS w FROM media m JOIN chosen c ON c.media_id = m.media_id)"""


def _exif_tables(t: Tables):
    old = t.labelled("toxic", 1).join(t.files.select("media_id"), "media_id").withColumn("make", F.lit("Old"))
    read = t.files.join(t.labelled("quality", 0), "media_id").select(
        "media_id",
        F.lit("New").alias("make"),
        F.when(F.col("kind") != "VIDEO", 100).alias("width"),
        F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("timestamp").alias("taken_at"),
    )
    return merge.exif_replace(t.files, old, read)


@query(
    "exif_replace",
    with_(M, L, EXIF_SQL) + """SELECT media_id, make FROM read UNION ALL SELECT media_id, 'Old' FROM staged WHERE media_id IN (SELECT media_id FROM media) AND media_id NOT IN (SELECT media_id FROM read)""",
)
def _(t: Tables):
    return _exif_tables(t)[1]


@query(
    "exif_replace_items",
    with_(M, L, EXIF_SQL) + """SELECT m.media_id, CAST(CASE WHEN r.media_id IS NULL THEN m.width ELSE r.w END AS INTEGER) AS width,
    CASE WHEN r.media_id IS NULL THEN m.height END AS height, CASE WHEN r.media_id IS NULL THEN m.taken_at END AS taken_at
    FROM media m LEFT JOIN read r ON r.media_id = m.media_id""",
)
def _(t: Tables):
    return _exif_tables(t)[0].select("media_id", "width", "height", "taken_at")


@query(
    "thumbnail_upsert",
    with_(M, L) + """SELECT media_id, 'thumb256' AS variant, CASE WHEN media_id IN (SELECT media_id FROM chosen) THEN 'new' ELSE 'old' END AS path,
      256 AS width, 192 AS height, CASE WHEN media_id IN (SELECT media_id FROM chosen) THEN 2 ELSE 1 END AS bytes FROM media
    UNION ALL SELECT media_id, 'thumb1024', 'new', 256, 192, 2 FROM media WHERE media_id IN (SELECT media_id FROM chosen)""",
)
def _(t: Tables):
    def rows(ids, variants: list[str], path: str, size: int):
        return ids.select(
            "media_id",
            F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant"),
            F.lit(path).alias("path"),
            F.lit(256).alias("width"),
            F.lit(192).alias("height"),
            F.lit(size).alias("bytes"),
            F.lit("2024-01-01").cast("timestamp").alias("created_at"),
        )

    made = rows(t.files.join(t.labelled("quality", 0), "media_id", "left_semi"), ["thumb256", "thumb1024"], "new", 2)
    return merge.thumbnail_upsert(rows(t.files, ["thumb256"], "old", 1), made).drop("created_at")


@query(
    "dup_rebuild_sink",
    with_(M, E) + "SELECT group_id, kind, member_count FROM exact_groups UNION ALL SELECT 'near_' || source, 'NEAR', count(*) FROM documents GROUP BY source",
)
def _(t: Tables):
    path = new_table_path(t.spark, "dup_group")
    by_source = t.files.groupBy("library_id").agg(F.count(F.lit(1)).alias("member_count"))
    near = by_source.select(F.concat(F.lit("near_"), "library_id").alias("group_id"), F.lit("NEAR").alias("kind"), "member_count")
    stale = by_source.select(F.concat(F.lit("stale_"), "library_id").alias("group_id"), F.lit("EXACT").alias("kind"), "member_count")
    similar = stale.withColumn("kind", F.lit("SIMILAR"))
    tables.dup_rebuild_sink(near.unionByName(stale).unionByName(similar), path, ("EXACT", "NEAR", "SIMILAR"))
    # no similar group is left this time, which empties their kind
    exact = dedup.exact_dup_groups(t.files).select("group_id", "kind", "member_count")
    tables.dup_rebuild_sink(exact, path, ("EXACT", "SIMILAR"), dedup.exact_dup_members(t.files).withColumn("kind", F.lit("EXACT")))
    return t.spark.read.parquet(f"{path}/groups").select("group_id", "kind", "member_count")


@query("dup_rebuild_members", with_(M, E) + "SELECT group_id, media_id, 'EXACT' AS kind FROM exact_members")
def _(t: Tables):
    path = new_table_path(t.spark, "dup_group")
    exact, members = dedup.exact_dup_groups(t.files), dedup.exact_dup_members(t.files).withColumn("kind", F.lit("EXACT"))
    stale = members.withColumn("group_id", F.concat(F.lit("stale_"), "group_id"))
    tables.dup_rebuild_sink(exact, path, ("EXACT",), stale)
    tables.dup_rebuild_sink(exact, path, ("EXACT",), members)
    return t.spark.read.parquet(f"{path}/members").select("group_id", "media_id", "kind")


@query(
    "operation_log_sink",
    "SELECT 'op_' || source AS id, CASE WHEN source = 'src3' THEN 'EXECUTING' ELSE 'COMPLETED' END AS status, count(*) AS item_count FROM documents GROUP BY source",
)
def _(t: Tables):
    path = new_table_path(t.spark, "operation")
    counted = t.files.groupBy("library_id").agg(F.count(F.lit(1)).alias("item_count"))

    def state(status: str, seq: int):
        return counted.select(
            F.concat(F.lit("op_"), "library_id").alias("id"),
            F.lit(status).alias("status"),
            "item_count",
            F.lit("2024-03-01").cast("timestamp").alias("logged_at"),
            F.lit(seq).alias("seq"),
        )

    tables.operation_log_append(state("EXECUTING", 0), path)
    tables.operation_log_append(state("COMPLETED", 1).filter(F.col("id") != "op_src3"), path)
    return tables.operation_log_latest(tables.read_log(t.spark, path)).select("id", "status", "item_count")


# -- trash --------------------------------------------------------------------------------------

HOME = "/home/app"
TRASH = f"{HOME}/trash"
REASON = "cleanup"
REQUEST_SQL = """
requests AS (SELECT media_id FROM labelled UNION SELECT 'x' || page_id FROM pages),
listing AS (SELECT path FROM media WHERE media_id NOT IN (SELECT media_id FROM staged)),
looked AS (SELECT r.media_id, m.path, m.filename, m.size_bytes, h.sha256, l.path IS NOT NULL AS present FROM requests r LEFT JOIN media m ON m.media_id = r.media_id
  LEFT JOIN (SELECT media_id, sha256 FROM media WHERE media_id IN (SELECT media_id FROM chosen)) h ON h.media_id = r.media_id LEFT JOIN listing l ON l.path = m.path)"""
OPS_SQL = f"""
ops AS (SELECT media_id, path AS "from", '{TRASH}/op_1/' || substr(sha1(path), 1, 16) || '/' || filename AS "to", size_bytes, sha256, '{REASON}' AS note FROM looked WHERE present)"""


def _trash_inputs(t: Tables):
    labelled = t.raw("labels").select(F.concat(F.lit("m"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("media_id"))
    unknown = t.raw("pages").select(F.concat(F.lit("x"), F.col("page_id").cast("string")).alias("media_id"))
    hashes = t.files.join(t.labelled("quality", 0), "media_id", "left_semi").select("media_id", "sha256")
    present = t.files.join(t.labelled("toxic", 1), "media_id", "left_anti").select("path")
    return labelled.unionByName(unknown), t.files.withColumn("is_hidden", F.lit(False)), hashes, present


def _trash_plan(t: Tables) -> operations.Plan:
    requests, items, hashes, present = _trash_inputs(t)
    return operations.plan_trash(requests, items, hashes, present, "op_1", TRASH, REASON)


@query("plan_left_join", with_(M, L, REQUEST_SQL) + "SELECT media_id, path, size_bytes, sha256 FROM looked")
def _(t: Tables):
    requests, items, hashes, _ = _trash_inputs(t)
    return operations.plan_left_join(requests, items, hashes)


@query("plan_trash", with_(M, L, REQUEST_SQL, OPS_SQL) + "SELECT * FROM ops")
def _(t: Tables):
    return _trash_plan(t).ops


@query(
    "plan_trash_warnings",
    with_(M, L, REQUEST_SQL) + """SELECT count(*) || ' requested item(s) no longer exist in the DB' AS warning FROM looked WHERE path IS NULL HAVING count(*) > 0
    UNION ALL SELECT 'Source no longer on disk: ' || path FROM looked WHERE path IS NOT NULL AND NOT present""",
)
def _(t: Tables):
    return _trash_plan(t).warnings


@query(
    "plan_summary",
    with_(M, L, REQUEST_SQL, OPS_SQL) + f"""SELECT 'TRASH' AS kind, n, total_bytes, 'Move ' || n || ' file(s) to Trash · ' || {human_bytes_sql('total_bytes')} AS summary
    FROM (SELECT count(*) AS n, CAST(COALESCE(sum(size_bytes), 0) AS BIGINT) AS total_bytes FROM ops)""",
)
def _(t: Tables):
    return operations.plan_summary(_trash_plan(t))


@query(
    "op_safety_check",
    with_(M) + """SELECT media_id, CASE WHEN contains(path, 'DCIM') THEN 'path traversal' WHEN starts_with(path, '/lib/src1') THEN 'inside the application''s own folder'
    WHEN category = 'MEME' THEN 'target outside the trash' END AS violation FROM media WHERE contains(path, 'DCIM') OR starts_with(path, '/lib/src1') OR category = 'MEME'""",
)
def _(t: Tables):
    target = F.when(F.col("category") == "MEME", "/elsewhere/x").otherwise("/lib/src1/trash/x")
    ops = t.media.select("media_id", F.regexp_replace("path", "DCIM", "..").alias("from"), target.alias("to"))
    return operations.op_safety_check(ops, "/lib/src1").select("media_id", "violation")


@query("apply_trash", with_(M, L, REQUEST_SQL, OPS_SQL) + "SELECT media_id, media_id IN (SELECT media_id FROM ops) AS is_hidden FROM media")
def _(t: Tables):
    items = t.files.withColumn("is_hidden", F.lit(False))
    at = F.lit("2024-06-01").cast("timestamp")
    return operations.apply_trash(items, _trash_plan(t).ops, "op_1", at, HOME)[0].select("media_id", "is_hidden")


ENTRIES_SQL = """
entries AS (SELECT 'te_op_1_' || media_id AS id, media_id, "from" AS original_path, "to" AS trash_path, size_bytes, TIMESTAMP '2024-07-01' AS expires_at FROM ops)"""


def _entries(t: Tables):
    items = t.files.withColumn("is_hidden", F.lit(False))
    return operations.apply_trash(items, _trash_plan(t).ops, "op_1", F.lit("2024-06-01").cast("timestamp"), HOME)[1]


@query("trash_entries", with_(M, L, REQUEST_SQL, OPS_SQL, ENTRIES_SQL) + "SELECT * FROM entries")
def _(t: Tables):
    return _entries(t).select("id", "media_id", "original_path", "trash_path", "size_bytes", "expires_at")


@query("trash_expired", with_(M, L, REQUEST_SQL, OPS_SQL, ENTRIES_SQL) + "SELECT count(*) AS entries, CAST(COALESCE(sum(size_bytes), 0) AS BIGINT) AS bytes FROM entries WHERE expires_at <= TIMESTAMP '2024-07-02'")
def _(t: Tables):
    return operations.trash_totals(operations.trash_expired(_entries(t), F.lit("2024-07-02").cast("timestamp")))


BUCKET_SQL = """
bentries AS (SELECT 't' || strftime(last_modified, '%Y-%m-%dT%H-00-00') AS bucket, substr(path, 6) AS relative_path, filename, size_bytes FROM media)"""


def _bucket_entries(t: Tables):
    return t.files.select(
        F.concat(F.lit("t"), F.date_format("last_modified", "yyyy-MM-dd'T'HH-'00-00'")).alias("bucket"),
        F.substring("path", 6, 1 << 20).alias("relative_path"),
        "filename",
        "size_bytes",
    )


@query("trash_buckets", with_(M, BUCKET_SQL) + "SELECT bucket, count(*) AS entries, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM bentries GROUP BY ROLLUP (bucket)")
def _(t: Tables):
    return operations.trash_buckets(_bucket_entries(t))


@query("trash_browse_order", with_(M, BUCKET_SQL) + "SELECT bucket || '::' || relative_path AS id, bucket, size_bytes FROM bentries")
def _(t: Tables):
    return operations.trash_browse_order(_bucket_entries(t)).select("id", "bucket", "size_bytes")


@query(
    "trash_preview_todo",
    with_(M, BUCKET_SQL) + r"""SELECT bucket || '::' || relative_path AS id FROM (SELECT * FROM bentries ORDER BY bucket DESC, relative_path LIMIT 30)
    WHERE regexp_matches(filename, '(?i)\.(jpe?g|png|webp|gif|bmp|avif)$')""",
)
def _(t: Tables):
    return operations.trash_preview_todo(_bucket_entries(t)).select("id")


# -- rename -------------------------------------------------------------------------------------

# Every file of a folder asks for the same name, and some of its numbers are taken on disk already.
RENAME_SQL = r"""
asks AS (SELECT media_id, regexp_replace(path, '[^/]*$', '') || 'IMG.jpg' AS target FROM media),
occupied AS (SELECT path FROM media UNION SELECT regexp_replace(m.path, '[^/]*$', '') || 'IMG (' || l.n || ').jpg' FROM media m JOIN (SELECT doc_id, 1 + doc_id % 7 AS n FROM labels) l ON l.doc_id = m.doc_id
  UNION SELECT regexp_replace(path, '[^/]*$', '') || 'IMG.jpg' FROM media WHERE dir = 'Docs/'),
usedn AS (SELECT DISTINCT regexp_replace(path, ' \(\d+\)\.jpg$', '.jpg') AS target, CAST(regexp_extract(path, ' \((\d+)\)\.jpg$', 1) AS BIGINT) AS u FROM occupied WHERE regexp_matches(path, 'IMG \(\d+\)\.jpg$')),
usedj AS (SELECT target, u - row_number() OVER (PARTITION BY target ORDER BY u) AS place FROM usedn),
turns AS (SELECT a.media_id, a.target, row_number() OVER (PARTITION BY a.target ORDER BY a.media_id) - 1 + CASE WHEN a.target IN (SELECT path FROM occupied) THEN 1 ELSE 0 END AS turn FROM asks a),
finals AS (SELECT media_id, target, CASE WHEN turn = 0 THEN target ELSE regexp_replace(target, '\.jpg$', ' (' || (turn + (SELECT count(*) FROM usedj u WHERE u.target = t.target AND u.place < t.turn)) || ').jpg') END AS "final" FROM turns t)"""


def _folder(path: str = "path"):
    return F.regexp_replace(path, "[^/]*$", "")


def _occupied(t: Tables):
    numbered = t.files.join(t.raw("labels").select("doc_id").distinct(), "doc_id", "left_semi").select(
        F.concat(_folder(), F.lit("IMG ("), (1 + F.col("doc_id") % 7).cast("string"), F.lit(").jpg")).alias("path")
    )
    plain = t.files.filter(F.col("path").contains("/Docs/")).select(F.concat(_folder(), F.lit("IMG.jpg")).alias("path"))
    return t.files.select("path").unionByName(numbered).unionByName(plain)


@query("rename_collision", with_(M, RENAME_SQL) + 'SELECT media_id, target, "final", "final" <> target AS collided FROM finals')
def _(t: Tables):
    wanted = t.files.select("media_id", F.concat(_folder(), F.lit("IMG.jpg")).alias("target"))
    return naming.unique_targets(wanted, _occupied(t))


def _rename_plan(t: Tables) -> operations.Plan:
    unknown = t.raw("pages").select(F.concat(F.lit("x"), F.col("page_id").cast("string")).alias("media_id"))
    requests = t.files.select("media_id").unionByName(unknown).withColumn("new_name", F.lit("IMG.jpg"))
    return operations.plan_rename(requests, t.files, t.hashes, _occupied(t))


@query(
    "plan_rename",
    with_(M, RENAME_SQL) + """SELECT f.media_id, m.path AS "from", f."final" AS "to", m.size_bytes, CASE WHEN m.doc_id IN (SELECT doc_id FROM labels) THEN m.sha256 END AS sha256, 'rename' AS note
    FROM finals f JOIN media m ON m.media_id = f.media_id""",
)
def _(t: Tables):
    return _rename_plan(t).ops


@query(
    "plan_rename_warnings",
    with_(M, RENAME_SQL) + """SELECT 'Unknown media: x' || page_id AS warning FROM pages UNION ALL SELECT 'Collision: ' || target || ' → ' || "final" FROM finals WHERE "final" <> target""",
)
def _(t: Tables):
    return _rename_plan(t).warnings


@query("apply_rename", with_(M, RENAME_SQL) + """SELECT media_id, "final" AS path, regexp_extract("final", '([^/]*)$', 1) AS filename FROM finals""")
def _(t: Tables):
    return operations.apply_rename(t.files, _rename_plan(t).ops, HOME).select("media_id", "path", "filename")


@query(
    "restore_targets",
    with_(M, L) + r"""SELECT 'te_' || media_id AS id, path AS target, CASE WHEN media_id IN (SELECT media_id FROM staged)
      THEN regexp_replace(path, '(\.[^./]*)$', ' (1)\1') ELSE path END AS "final" FROM media WHERE media_id IN (SELECT media_id FROM labelled)""",
)
def _(t: Tables):
    labelled = t.raw("labels").select(F.concat(F.lit("m"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("media_id")).distinct()
    entries = t.files.join(labelled, "media_id").select(F.concat(F.lit("te_"), "media_id").alias("id"), F.col("path").alias("relative_path"))
    taken = t.files.join(t.labelled("toxic", 1), "media_id", "left_semi").select("path")
    return operations.restore_targets(entries, taken).select("id", "target", "final")


@query(
    "rename_template",
    with_(M, L) + r"""SELECT media_id, d || '-' || what || '-' || lpad(CAST(row_number() OVER (PARTITION BY folder, d, what ORDER BY moment, media_id) AS VARCHAR), 3, '0') || ext AS new_name FROM (
    SELECT media_id, ext, regexp_replace(path, '/[^/]*$', '') AS folder, strftime(COALESCE(taken_at, last_modified), '%Y-%m-%d') AS d, COALESCE(taken_at, last_modified) AS moment,
      lower(regexp_replace(CASE WHEN media_id IN (SELECT media_id FROM staged) THEN 'Summer trip' WHEN lang = 'en' THEN lang ELSE category END, '[^\p{L}\p{Nd}]+', '_', 'g')) AS what FROM media)""",
)
def _(t: Tables):
    event = t.labelled("toxic", 1).withColumn("event", F.lit("Summer trip"))
    facts = t.media.join(event, "media_id", "left").select(
        "media_id", "event", F.when(F.col("lang") == "en", F.col("lang")).alias("location"), F.col("category").alias("subject")
    )
    return operations.rename_template(t.files, facts)


# -- undo ---------------------------------------------------------------------------------------

UNDO_SQL = """
here AS (SELECT "to" AS path FROM ops WHERE sha256 IS NULL UNION ALL SELECT "from" FROM ops WHERE contains("from", '/Docs/')),
outcome AS (SELECT media_id, "from", "to", size_bytes, CASE WHEN "to" NOT IN (SELECT path FROM here) THEN 'gone' WHEN "from" IN (SELECT path FROM here) THEN 'occupied' ELSE 'restored' END AS outcome FROM ops)"""


def _operation(t: Tables):
    ops = _trash_plan(t).ops
    return operations.manifest_json(ops).select(
        F.lit("op_1").alias("id"), F.lit("COMPLETED").alias("status"), F.col("entry").alias("manifest")
    )


def _listing_for_undo(t: Tables):
    ops = _trash_plan(t).ops
    docs = ops.filter(F.col("from").contains("/Docs/")).select(F.col("from").alias("path"))
    return ops.filter(F.col("sha256").isNull()).select(F.col("to").alias("path")).unionByName(docs)


@query("manifest_parse", with_(M, L, REQUEST_SQL, OPS_SQL) + """SELECT 'op_1' AS operation_id, media_id, "from", "to", sha256, size_bytes FROM ops""")
def _(t: Tables):
    return operations.manifest_parse(_operation(t))


def _undo(t: Tables) -> operations.Undo:
    trashed, entries = operations.apply_trash(
        t.files.withColumn("is_hidden", F.lit(False)), _trash_plan(t).ops, "op_1", F.lit("2024-06-01").cast("timestamp"), HOME
    )
    operation = t.spark.createDataFrame([("op_1", "COMPLETED", "rows")], "id string, status string, manifest string")
    manifest = operations.manifest_parse(_operation(t)).drop("operation_id")
    at = F.lit("2024-06-02").cast("timestamp")
    return operations.apply_undo(operation, manifest, trashed, entries, _listing_for_undo(t), at, "TRASH")


@query("undo_outcome", with_(M, L, REQUEST_SQL, OPS_SQL, UNDO_SQL) + "SELECT media_id, outcome FROM outcome")
def _(t: Tables):
    return _undo(t).outcome.select("media_id", "outcome")


@query(
    "apply_undo",
    with_(M, L, REQUEST_SQL, OPS_SQL, UNDO_SQL) + """SELECT m.media_id, m.path, COALESCE(o.outcome <> 'restored', false) AS is_hidden FROM media m LEFT JOIN outcome o ON o.media_id = m.media_id""",
)
def _(t: Tables):
    return _undo(t).items.select("media_id", "path", "is_hidden")


@query(
    "undo_summary",
    with_(M, L, REQUEST_SQL, OPS_SQL, UNDO_SQL) + "SELECT count(*) FILTER (outcome = 'restored') AS restored, count(*) FILTER (outcome <> 'restored') AS failed FROM outcome",
)
def _(t: Tables):
    return operations.undo_summary(_undo(t).outcome)


@query(
    "undo_entries",
    with_(M, L, REQUEST_SQL, OPS_SQL, UNDO_SQL) + "SELECT media_id, CASE WHEN outcome = 'restored' THEN TIMESTAMP '2024-06-02' END AS restored_at FROM outcome",
)
def _(t: Tables):
    return _undo(t).entries.select("media_id", "restored_at")


@query(
    "op_status",
    """SELECT 'op_' || user_id AS operation_id, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed,
    CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'COMPLETED' WHEN count(*) FILTER (event_type <> 'error') = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS status FROM events GROUP BY user_id""",
)
def _(t: Tables):
    results = t.raw("events").select(F.concat(F.lit("op_"), F.col("user_id").cast("string")).alias("operation_id"), (F.col("event_type") != "error").alias("ok"))
    return operations.op_status(results)


@query(
    "op_log_inconsistent",
    with_(M, L, REQUEST_SQL, OPS_SQL) + """SELECT 'op_' || source AS operation_id, 'left executing' AS problem FROM documents WHERE lang = 'de' GROUP BY source
    UNION ALL SELECT 'op_1', count(*) || ' moved file(s) not found' FROM ops WHERE sha256 IS NOT NULL HAVING count(*) > 0""",
)
def _(t: Tables):
    stuck = t.raw("documents").filter("lang = 'de'").select(F.concat(F.lit("op_"), "source").alias("id"), F.lit("EXECUTING").alias("status")).distinct()
    done = t.spark.createDataFrame([("op_1", "COMPLETED")], "id string, status string")
    return operations.op_log_inconsistent(stuck.unionByName(done), operations.manifest_parse(_operation(t)), _listing_for_undo(t))


@query(
    "verify_copy",
    with_(M, L) + """SELECT path AS relative_path, CASE WHEN media_id IN (SELECT media_id FROM staged) THEN 'missing' WHEN media_id IN (SELECT media_id FROM chosen) THEN 'size differs' ELSE 'content differs' END AS problem
    FROM media WHERE media_id IN (SELECT media_id FROM staged) OR media_id IN (SELECT media_id FROM chosen) OR lang = 'fr'""",
)
def _(t: Tables):
    source = t.files.select("media_id", F.col("path").alias("relative_path"), "size_bytes", "sha256", "lang")
    shrunk = t.labelled("quality", 0).withColumn("_s", F.lit(1))
    copy = (
        source.join(t.labelled("toxic", 1), "media_id", "left_anti")
        .join(shrunk, "media_id", "left")
        .select(
            "relative_path",
            (F.col("size_bytes") - F.coalesce("_s", F.lit(0))).alias("size_bytes"),
            F.when(F.col("lang") == "fr", F.lit("x")).otherwise(F.col("sha256")).alias("sha256"),
        )
    )
    return operations.verify_copy(source, copy, with_hash=True).select("relative_path", "problem")


@query("smart_album", with_(M) + "SELECT media_id FROM media WHERE category IN ('PHOTO', 'MEME') AND size_bytes > 1000000 AND (width >= 1920 OR kind = 'VIDEO')")
def _(t: Tables):
    return operations.smart_album(t.media, "category in ('PHOTO', 'MEME') and size_bytes > 1000000 and (width >= 1920 or kind = 'VIDEO')")
