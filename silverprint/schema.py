"""Record schemas and the fixed vocabularies of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vocabularies of the enum-like text columns.
MEDIA_KINDS = ("IMAGE", "VIDEO", "UNKNOWN")
MEDIA_CATEGORIES = (
    "PHOTO",
    "VIDEO",
    "SCREENSHOT",
    "MEME",
    "DOCUMENT",
    "RECEIPT",
    "SELFIE",
    "WHATSAPP_FORWARD",
    "TRANSACTIONAL",
    "OTHER",
)
MEDIA_INTENTS = ("KEEP_LONG_TERM", "EPHEMERAL", "UNKNOWN")
DUPLICATE_KINDS = ("EXACT", "NEAR", "SIMILAR")
JOB_STATUSES = ("PENDING", "RUNNING", "DONE", "FAILED", "CANCELLED")
OPERATION_KINDS = ("TRASH", "RENAME", "MOVE", "RESTORE", "PURGE_TRASH")
OPERATION_STATUSES = ("PLANNED", "EXECUTING", "COMPLETED", "PARTIAL", "FAILED", "UNDONE")

# Categories treated as papers of passing use.
PAPER_CATEGORIES = ("DOCUMENT", "RECEIPT", "TRANSACTIONAL")

# Fixed value: the dHash text of an image that could not be decoded.
NO_DHASH = "0000000000000000"

# Fixed value: a video counts as large above this many bytes (500 MiB).
LARGE_VIDEO_BYTES = 500 * 1024 * 1024

FACE = T.StructType(
    [
        T.StructField("x", T.IntegerType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("w", T.IntegerType()),
        T.StructField("h", T.IntegerType()),
        T.StructField("descriptor", T.ArrayType(T.FloatType())),
    ]
)

MEDIA_ITEM = T.StructType(
    [
        T.StructField("media_id", T.StringType(), False),
        T.StructField("library_id", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("filename", T.StringType(), False),
        T.StructField("ext", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("size_bytes", T.LongType(), False),
        T.StructField("last_modified", T.TimestampType(), False),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("taken_at", T.TimestampType()),
        T.StructField("category", T.StringType(), False),
        T.StructField("intent", T.StringType(), False),
        T.StructField("category_confidence", T.DoubleType(), False),
        T.StructField("quality_score", T.DoubleType()),
        T.StructField("brightness", T.DoubleType()),
        T.StructField("color_variance", T.DoubleType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("faces", T.ArrayType(FACE)),
        T.StructField("is_hidden", T.BooleanType(), False),
        T.StructField("sha256", T.StringType()),
        T.StructField("dhash_hex", T.StringType()),
    ]
)

MANIFEST = T.ArrayType(
    T.StructType(
        [
            T.StructField("mediaId", T.StringType()),
            T.StructField("from", T.StringType()),
            T.StructField("to", T.StringType()),
            T.StructField("sha256", T.StringType()),
            T.StructField("sizeBytes", T.StringType()),
        ]
    )
)

TAG_SCORES = T.ArrayType(
    T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
)


def enum_violations(df: DataFrame, rules: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows whose enum-like columns hold a value outside the vocabulary, one row per violation."""
    checks: list[Column] = [
        F.when(
            F.col(name).isNull() | ~F.col(name).isin(*allowed),
            F.struct(F.lit(name).alias("column"), F.col(name).alias("value")),
        )
        for name, allowed in rules.items()
    ]
    return (
        df.withColumn("_bad", F.explode(F.array_compact(F.array(*checks))))
        .select(*df.columns, "_bad.column", "_bad.value")
    )
