"""The driver's tables read as media tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silverprint.functions.hashing import gradient_hash, hash_to_hex
from silverprint.operators.classify import with_path_class

# One entry per kind of file; a document is given the entry of its number modulo their count.
SHAPES = [
    ("DCIM/Camera/", "IMG_", ".jpg"),
    ("WhatsApp/Media/", "IMG-20240101-WA", ".jpg"),
    ("Screenshots/", "Screenshot_", ".png"),
    ("Downloads/", "file-", ".webp"),
    ("Docs/", "my receipt ", ".jpg"),
    ("Docs/", "passport scan ", ".png"),
    ("Fun/", "lol meme ", ".gif"),
    ("Sent/", "Copy ", ".jpg"),
    ("DCIM/100APPLE/", "VID_", ".mp4"),
    ("Misc/", "photo-", ".heic"),
    ("Telegram/", "pic ", ".jpg"),
    ("DCIM/Camera/", "tax bill ", ".jpg"),
]
SIZES = [(4032, 3024), (4032, 3024), (3024, 4032), (1920, 1080), (640, 480)]

MEDIA_SQL = f"""
nv AS (SELECT count(*) AS n FROM embeddings),
shaped AS (
  SELECT doc_id, text, lang, source, n_chars,
         ({[s[0] for s in SHAPES]})[doc_id % 12 + 1] AS dir,
         ({[s[1] for s in SHAPES]})[doc_id % 12 + 1] AS stem,
         ({[s[2] for s in SHAPES]})[doc_id % 12 + 1] AS ext,
         ({[s[0] for s in SIZES]})[doc_id % 5 + 1] AS w,
         ({[s[1] for s in SIZES]})[doc_id % 5 + 1] AS h,
         doc_id % (SELECT n FROM nv) AS vec_id
  FROM documents),
placed AS (
  SELECT *, 'm' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS media_id, source AS library_id,
         stem || doc_id || ext AS filename,
         '/lib/' || source || '/' || dir || stem || doc_id || ext AS path,
         CASE WHEN ext = '.mp4' THEN 'VIDEO' ELSE 'IMAGE' END AS kind,
         n_chars * (CASE WHEN ext = '.mp4' THEN 100000 ELSE 1000 END) AS size_bytes,
         make_timestamp((1704067200000 + doc_id * 5400000) * 1000) AS last_modified,
         CAST(CASE WHEN ext <> '.mp4' THEN w END AS INTEGER) AS width,
         CAST(CASE WHEN ext <> '.mp4' THEN h END AS INTEGER) AS height,
         CASE WHEN dir LIKE 'DCIM%' THEN make_timestamp((1704067200000 + doc_id * 5400000) * 1000) END AS taken_at,
         sha256(text) AS sha256
  FROM shaped),
hashed AS (
  SELECT p.*, e.embedding,
         xor(CAST(list_sum(list_transform(range(0, 63), lambda i:
             CASE WHEN e.embedding[i + 1] < e.embedding[i + 2] THEN CAST(1 AS BIGINT) << (62 - i) ELSE CAST(0 AS BIGINT) END)) AS BIGINT),
             CAST(1 AS BIGINT) << CAST(p.doc_id % 61 AS BIGINT)) AS dhash
  FROM placed p JOIN embeddings e ON e.vec_id = p.vec_id),
scored AS (
  SELECT *, printf('%016x', dhash) AS dhash_hex,
         CASE WHEN ext NOT IN ('.mp4', '.heic') THEN (CAST(embedding[1] AS DOUBLE) + 1) / 2 END AS brightness,
         CASE WHEN ext NOT IN ('.mp4', '.heic') THEN abs(CAST(embedding[2] AS DOUBLE)) * 1000 END AS color_variance,
         CASE WHEN ext NOT IN ('.mp4', '.heic') THEN abs(CAST(embedding[3] AS DOUBLE)) * 100 END AS quality_score,
         lower(filename) AS lname
  FROM hashed),
media AS (
  SELECT *,
    CASE WHEN regexp_matches(lname, '^(screenshot|screen\\s?shot|scr_|capture_)') OR regexp_matches(path, '(?i)/screenshots?/') THEN 'SCREENSHOT'
         WHEN regexp_matches(path, '(?:^|/)(whatsapp|WhatsApp|Telegram|TelegramMedia)/') OR regexp_matches(filename, '(?i)^IMG-\\d{{8}}-WA\\d+') THEN 'WHATSAPP_FORWARD'
         WHEN regexp_matches(lname, '\\b(receipt|invoice|bill|gst|tax)\\b') THEN 'RECEIPT'
         WHEN regexp_matches(lname, '\\b(scan|doc|document|aadhaar|passport|pan|license)\\b') THEN 'DOCUMENT'
         WHEN regexp_matches(lname, '\\b(meme|funny|lol|reddit|9gag)\\b') THEN 'MEME'
         WHEN regexp_matches(path, '(?i)(?:^|/)(DCIM|Camera|100[A-Z]+)/') THEN 'PHOTO'
         ELSE 'OTHER' END AS category,
    CASE WHEN regexp_matches(lname, '^(screenshot|screen\\s?shot|scr_|capture_)') OR regexp_matches(path, '(?i)/screenshots?/') THEN 'EPHEMERAL'
         WHEN regexp_matches(path, '(?:^|/)(whatsapp|WhatsApp|Telegram|TelegramMedia)/') OR regexp_matches(filename, '(?i)^IMG-\\d{{8}}-WA\\d+') THEN 'EPHEMERAL'
         WHEN regexp_matches(lname, '\\b(receipt|invoice|bill|gst|tax|scan|doc|document|aadhaar|passport|pan|license|meme|funny|lol|reddit|9gag)\\b') THEN 'EPHEMERAL'
         WHEN regexp_matches(path, '(?i)(?:^|/)(DCIM|Camera|100[A-Z]+)/') THEN 'KEEP_LONG_TERM'
         WHEN regexp_matches(path, '(?:^|/)Downloads?/') THEN 'EPHEMERAL'
         ELSE 'UNKNOWN' END AS intent
  FROM scored)
"""


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


class Tables:
    """Media tables derived from one folder of driver tables; everything is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # the catalog keeps all times in UTC

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def files(self) -> DataFrame:
        """Documents as files: names, sizes, times and content digests."""
        return self.files_with()

    def files_with(self, *more: str) -> DataFrame:
        """The files with further columns of their documents."""
        d = self.raw("documents")
        k, s = F.col("doc_id") % len(SHAPES), F.col("doc_id") % len(SIZES)
        n = self.raw("embeddings").agg(F.count(F.lit(1)).alias("n")).scalar()
        video = F.col("ext") == ".mp4"
        modified = F.timestamp_millis(F.lit(1704067200000) + F.col("doc_id") * 5400000)
        return (
            d.withColumns(
                {
                    "dir": _pick([x[0] for x in SHAPES], k),
                    "stem": _pick([x[1] for x in SHAPES], k),
                    "ext": _pick([x[2] for x in SHAPES], k),
                    "vec_id": F.col("doc_id") % n,
                }
            )
            .withColumn("filename", F.concat("stem", F.col("doc_id").cast("string"), "ext"))
            .select(
                "doc_id",
                F.concat(F.lit("m"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("media_id"),
                F.col("source").alias("library_id"),
                F.concat(F.lit("/lib/"), "source", F.lit("/"), "dir", "filename").alias("path"),
                "filename",
                "ext",
                F.when(video, "VIDEO").otherwise("IMAGE").alias("kind"),
                (F.col("n_chars") * F.when(video, 100000).otherwise(1000)).alias("size_bytes"),
                modified.alias("last_modified"),
                F.when(~video, _pick([x[0] for x in SIZES], s)).alias("width"),
                F.when(~video, _pick([x[1] for x in SIZES], s)).alias("height"),
                F.when(F.col("dir").startswith("DCIM"), modified).alias("taken_at"),
                F.sha2("text", 256).alias("sha256"),
                "vec_id",
                "lang",
                *more,
            )
        )

    @cached_property
    def hashed(self) -> DataFrame:
        """Files with vectors, perceptual hash and quality values."""
        rows = self.files.join(self.raw("embeddings").select("vec_id", "embedding"), "vec_id")
        e = F.col("embedding")
        decoded = ~F.col("ext").isin(".mp4", ".heic")
        flip = F.expr("shiftleft(cast(1 as bigint), cast(doc_id % 61 as int))")
        return rows.withColumn("dhash", gradient_hash(e).bitwiseXOR(flip)).withColumns(
            {
                "dhash_hex": hash_to_hex(F.col("dhash")),
                "brightness": F.when(decoded, (e[0].cast("double") + 1) / 2),
                "color_variance": F.when(decoded, F.abs(e[1].cast("double")) * 1000),
                "quality_score": F.when(decoded, F.abs(e[2].cast("double")) * 100),
            }
        )

    @cached_property
    def media(self) -> DataFrame:
        """The catalog, classified by the browser's rules."""
        return with_path_class(self.hashed, "browser").drop("reason").withColumns(
            {"is_hidden": F.lit(False), "is_favorite": F.lit(False)}
        )

    @cached_property
    def hashes(self) -> DataFrame:
        """Digests of the files whose document has been labelled: the others are still to be hashed."""
        labelled = self.raw("labels").select("doc_id").distinct()
        return self.hashed.join(labelled, "doc_id", "left_semi").select("media_id", "sha256", "dhash_hex")

    @cached_property
    def face_items(self) -> DataFrame:
        """Two neighbouring vectors are the faces of one item."""
        face = F.struct(
            F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(32).alias("w"), F.lit(32).alias("h"), F.col("embedding").alias("descriptor")
        )
        return (
            self.raw("embeddings")
            .groupBy(F.floor(F.col("vec_id") / 2).alias("n"))
            .agg(F.array_sort(F.collect_list(F.struct("vec_id", face.alias("face")))).alias("_f"))
            .select(
                F.concat(F.lit("m"), F.lpad(F.col("n").cast("string"), 8, "0")).alias("media_id"),
                F.transform("_f", lambda f: f["face"]).alias("faces"),
            )
        )

    @cached_property
    def jobs(self) -> DataFrame:
        """Events as a job log."""
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.col("event_type").alias("type"),
            _pick(["PENDING", "RUNNING", "DONE", "FAILED", "CANCELLED"], F.col("event_id") % 5).alias("status"),
            (F.floor("value") % 10).alias("priority"),
            F.col("ts").alias("scheduled_at"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def photo_times(self) -> DataFrame:
        """Events as photos with a capture time; users are libraries."""
        return self.raw("events").select(
            F.concat(F.lit("p"), F.lpad(F.col("event_id").cast("string"), 10, "0")).alias("media_id"),
            F.col("user_id").alias("library_id"),
            F.col("ts").cast("timestamp").alias("taken_at"),
            "value",
            "event_type",
        )

    def labelled(self, column: str, value: int) -> DataFrame:
        """Ids of the files whose document carries a label."""
        rows = self.raw("labels").filter(F.col(column) == value)
        return rows.select(F.concat(F.lit("m"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("media_id")).distinct()


# Fixed for all staging queries: what is staged already, and what the user points at.
LABELLED_SQL = """
staged AS (SELECT DISTINCT 'm' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS media_id FROM labels WHERE toxic = 1),
chosen AS (SELECT DISTINCT 'm' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS media_id FROM labels WHERE quality = 0),
labelled AS (SELECT DISTINCT 'm' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS media_id FROM labels)
"""
