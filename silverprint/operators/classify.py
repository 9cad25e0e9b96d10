"""Classification by extension, path rules, labels and model scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverprint.functions.paths import basename, dirname
from silverprint.functions.vectors import unit_vector

# Extensions by rule set.
SERVER_IMAGE_EXTS = (
    ".jpg",
    ".jpeg",
    ".png",
    ".webp",
    ".heic",
    ".heif",
    ".gif",
    ".bmp",
    ".tiff",
    ".tif",
    ".avif",
    ".dng",
    ".raw",
    ".cr2",
    ".cr3",
    ".nef",
    ".arw",
    ".rw2",
    ".orf",
    ".raf",
)
SERVER_VIDEO_EXTS = (
    ".mp4",
    ".mov",
    ".m4v",
    ".avi",
    ".mkv",
    ".webm",
    ".3gp",
    ".mts",
    ".wmv",
)
BROWSER_IMAGE_EXTS = (
    ".jpg",
    ".jpeg",
    ".png",
    ".webp",
    ".gif",
    ".bmp",
    ".avif",
    ".heic",
    ".heif",
    ".tiff",
    ".tif",
)
BROWSER_VIDEO_EXTS = (
    ".mp4",
    ".mov",
    ".m4v",
    ".webm",
    ".mkv",
    ".avi",
    ".3gp",
)
DECODABLE_IMAGE_EXTS = (
    ".jpg",
    ".jpeg",
    ".png",
    ".webp",
    ".gif",
    ".bmp",
    ".avif",
)

# Name and path patterns of the rules.
SCREENSHOT_NAME = r"^(screenshot|screen\s?shot|scr_|capture_)"
MEME_WORDS = r"\b(meme|funny|lol|reddit|9gag)\b"
RECEIPT_WORDS = r"\b(receipt|invoice|bill|gst|tax)\b"
DOCUMENT_WORDS = r"\b(scan|doc|document|aadhaar|passport|pan|license)\b"
MESSENGER_DIR = r"(whatsapp|WhatsApp|Telegram|TelegramMedia)"
CAMERA_DIR = r"(DCIM|Camera|100[A-Z]+)"
DOWNLOAD_DIR = r"Downloads?"
MESSENGER_NAME = r"(?i)^IMG-\d{8}-WA\d+"

# Category, intent, confidence and reason by rule, for both rule sets.
SERVER_VERDICTS = {
    "screenshot": ("SCREENSHOT", "EPHEMERAL", 0.85, "filename matches screenshot pattern"),
    "messenger": ("WHATSAPP_FORWARD", "EPHEMERAL", 0.7, "path contains messenger media directory"),
    "camera": ("PHOTO", "KEEP_LONG_TERM", 0.6, "path looks like camera directory"),
    "receipt": ("RECEIPT", "EPHEMERAL", 0.5, "filename suggests transactional content"),
    "document": ("DOCUMENT", "EPHEMERAL", 0.5, "filename suggests transactional content"),
    "meme": ("MEME", "EPHEMERAL", 0.5, "filename suggests meme"),
    "download": ("OTHER", "EPHEMERAL", 0.3, "file is in Downloads — likely ephemeral"),
}
BROWSER_VERDICTS = {
    "screenshot": ("SCREENSHOT", "EPHEMERAL", 0.85, None),
    "messenger": ("WHATSAPP_FORWARD", "EPHEMERAL", 0.75, None),
    "receipt": ("RECEIPT", "EPHEMERAL", 0.5, None),
    "document": ("DOCUMENT", "EPHEMERAL", 0.5, None),
    "meme": ("MEME", "EPHEMERAL", 0.5, None),
    "camera": ("PHOTO", "KEEP_LONG_TERM", 0.6, None),
    "download": ("OTHER", "EPHEMERAL", 0.3, None),
}
NO_VERDICT = ("OTHER", "UNKNOWN", 0.0, None)

# Labels of the zero-shot set with their category and intent.
LABEL_MAP = {
    "a photo of people": ("PHOTO", "KEEP_LONG_TERM"),
    "a landscape photo": ("PHOTO", "KEEP_LONG_TERM"),
    "a photo of food": ("PHOTO", "UNKNOWN"),
    "a photo of a pet or animal": ("PHOTO", "KEEP_LONG_TERM"),
    "a screenshot of a chat message": ("SCREENSHOT", "EPHEMERAL"),
    "a screenshot of a webpage": ("SCREENSHOT", "EPHEMERAL"),
    "a screenshot of a QR code": ("TRANSACTIONAL", "EPHEMERAL"),
    "a photo of a receipt or invoice": ("RECEIPT", "EPHEMERAL"),
    "a photo of a parking lot ticket": ("TRANSACTIONAL", "EPHEMERAL"),
    "a photo of a whiteboard with handwriting": ("TRANSACTIONAL", "EPHEMERAL"),
    "a photo of an ID card or document": ("DOCUMENT", "EPHEMERAL"),
    "a meme image": ("MEME", "EPHEMERAL"),
    "a photo of a product on a shelf": ("TRANSACTIONAL", "EPHEMERAL"),
    "a wedding photo": ("PHOTO", "KEEP_LONG_TERM"),
    "a selfie": ("SELFIE", "UNKNOWN"),
}
FILENAME_LABEL_SCORE = 0.42


def classify_ext(ext: Column, rules: str = "server") -> Column:
    images, videos = {
        "server": (SERVER_IMAGE_EXTS, SERVER_VIDEO_EXTS),
        "browser": (BROWSER_IMAGE_EXTS, BROWSER_VIDEO_EXTS),
    }[rules]
    e = F.lower(ext)
    return F.when(e.isin(*images), "IMAGE").when(e.isin(*videos), "VIDEO").otherwise("UNKNOWN")


def _verdict(entry: tuple) -> Column:
    category, intent, confidence, reason = entry
    return F.struct(
        F.lit(category).alias("category"),
        F.lit(intent).alias("intent"),
        F.lit(confidence).alias("confidence"),
        F.lit(reason).cast("string").alias("reason"),
    )


def _first_match(tests: dict[str, Column], verdicts: dict[str, tuple]) -> Column:
    """The verdict of the first rule that holds, in the order of the verdict table."""
    chain = F
    for rule, entry in verdicts.items():
        chain = chain.when(tests[rule], _verdict(entry))
    return chain.otherwise(_verdict(NO_VERDICT))


def _word_tests(name: Column) -> dict[str, Column]:
    return {
        "receipt": name.rlike(RECEIPT_WORDS),
        "document": name.rlike(DOCUMENT_WORDS),
        "meme": name.rlike(MEME_WORDS),
    }


def classify_path_server(path: Column, filename: Column | None = None) -> Column:
    """Scan-time rules on absolute paths: camera folders win over words in the name."""
    name = F.lower(filename if filename is not None else basename(path))
    tests = _word_tests(name) | {
        "screenshot": name.rlike(SCREENSHOT_NAME) | F.lower(dirname(path)).contains("screenshot"),
        "messenger": path.rlike(rf"[\\/]{MESSENGER_DIR}[\\/]"),
        "camera": path.rlike(rf"(?i)[\\/]{CAMERA_DIR}[\\/]"),
        "download": path.rlike(rf"[\\/]{DOWNLOAD_DIR}[\\/]"),
    }
    return _first_match(tests, SERVER_VERDICTS)


def classify_path_browser(path: Column) -> Column:
    """Rules on paths relative to the library: words in the name win over camera folders."""
    filename = basename(path)
    name = F.lower(filename)
    tests = _word_tests(name) | {
        "screenshot": name.rlike(SCREENSHOT_NAME) | path.rlike(r"(?i)/screenshots?/"),
        "messenger": path.rlike(rf"(?:^|/){MESSENGER_DIR}/") | filename.rlike(MESSENGER_NAME),
        "camera": path.rlike(rf"(?i)(?:^|/){CAMERA_DIR}/"),
        "download": path.rlike(rf"(?:^|/){DOWNLOAD_DIR}/"),
    }
    return _first_match(tests, BROWSER_VERDICTS)


def with_path_class(items: DataFrame, rules: str = "server") -> DataFrame:
    """Add category, intent, confidence and reasons by one of the two rule sets."""
    verdict = (
        classify_path_server(F.col("path"), F.col("filename")) if rules == "server" else classify_path_browser(F.col("path"))
    )
    return items.withColumn("_v", verdict).select(
        *[c for c in items.columns if c not in ("category", "intent", "category_confidence", "reason")],
        F.col("_v.category").alias("category"),
        F.col("_v.intent").alias("intent"),
        F.col("_v.confidence").alias("category_confidence"),
        F.col("_v.reason").alias("reason"),
    )


def label_table(df: DataFrame, labels: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """The label map as a table of a few rows."""
    rows = [(label, category, intent) for label, (category, intent) in (labels or LABEL_MAP).items()]
    return df.sparkSession.createDataFrame(rows, "label string, category string, intent string")


def classify_filename_label(items: DataFrame) -> DataFrame:
    """Top label guessed from the file name and path, with the category and intent it stands for."""
    name = F.lower(basename(F.col("path")))
    label = (
        F.when(name.contains("screenshot"), "a screenshot of a chat message")
        .when(name.contains("receipt") | name.contains("invoice"), "a photo of a receipt or invoice")
        .when(F.lower("path").contains("whatsapp"), "a screenshot of a chat message")
        .otherwise("a photo of people")
    )
    mapped = F.broadcast(label_table(items).withColumnRenamed("label", "top_label"))
    return (
        items.select("media_id", label.alias("top_label"))
        .join(mapped, "top_label")
        .withColumn("top_score", F.lit(FILENAME_LABEL_SCORE))
    )


def zero_shot_classify(
    items: DataFrame, label_vectors: DataFrame, labels: dict[str, tuple[str, str]], top_k: int = 3
) -> DataFrame:
    """Cosine of each item with each label vector, the ``top_k`` tags, and the class of the first.

    The label set is part of the query and travels with it. An item without vector has no tags.
    """
    rows = label_vectors.join(label_table(items, labels), "label", "left").orderBy("label").collect()  # the label set
    names = F.array(*[F.lit(r["label"]) for r in rows])
    classes = F.array(*[F.struct(F.lit(r["category"] or "OTHER"), F.lit(r["intent"] or "UNKNOWN")) for r in rows])
    best = _best_labels(F.col("embedding"), [unit_vector(r["vec"]) for r in rows], top_k)
    scored = items.select("media_id", best.alias("_best"))
    # pairs of label number and score, one after another
    tags = F.transform(
        F.sequence(F.lit(0), F.size("_best") - 2, F.lit(2)),
        lambda i: F.struct(F.get(names, F.get("_best", i).cast("int")).alias("label"), F.get("_best", i + 1).alias("score")),
    )
    first = F.get(classes, F.get("_best", F.lit(0)).cast("int"))
    return scored.select(
        "media_id", F.when(F.size("_best") > 0, tags).alias("tags"), first["col1"].alias("category"), first["col2"].alias("intent")
    ).select("media_id", F.get("tags", F.lit(0))["label"].alias("top_label"), F.get("tags", F.lit(0))["score"].alias("top_score"), "tags", "category", "intent")


def _best_labels(vector: Column, labels: list[list[float]], top_k: int) -> Column:
    """Number and score of the ``top_k`` labels, ties in the order of the labels; a batch of rows is one matrix product."""
    matrix = np.array(labels, np.float64).reshape(len(labels), -1)

    def best(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        for length, at in vectors.dropna().map(len).groupby(vectors.dropna().map(len)).groups.items():
            width = min(length, matrix.shape[1])
            products = np.stack([vectors[i][:width] for i in at]).astype(np.float64) @ matrix[:, :width].T
            order = np.argsort(-products, axis=1, kind="stable")[:, :top_k]
            pairs = np.stack([order, np.take_along_axis(products, order, axis=1)], axis=2).reshape(len(at), -1)
            for i, row in zip(at, pairs):
                out[i] = row
        return out

    return F.pandas_udf(best, "array<double>")(vector)


def low_confidence_queue(classified: DataFrame, threshold: float, score: str = "top_score") -> DataFrame:
    """Rows below the threshold, reset to OTHER / UNKNOWN, to be labelled by hand."""
    return classified.filter(F.col(score) < threshold).withColumns(
        {"category": F.lit("OTHER"), "intent": F.lit("UNKNOWN")}
    )


def apply_threshold(classified: DataFrame, threshold: float, score: str = "top_score") -> DataFrame:
    low = F.col(score) < threshold
    return classified.withColumns(
        {
            "category": F.when(low, F.lit("OTHER")).otherwise(F.col("category")),
            "intent": F.when(low, F.lit("UNKNOWN")).otherwise(F.col("intent")),
        }
    )


def heuristic_extra(items: DataFrame, exif: DataFrame, screens: list[tuple[int, int]]) -> DataFrame:
    """Signals from EXIF and shape: stills with the aspect ratio of one of ``screens``, front camera, camera folder with a make."""
    joined = items.join(exif.select("media_id", "make", "model", "lens"), "media_id", "left")
    w, h = F.col("width"), F.col("height")
    screen = F.lit(False)
    for a, b in screens:
        screen = screen | (w * b == h * a) | (w * a == h * b)
    no_camera = F.col("make").isNull() & F.col("model").isNull()
    front = F.lower("lens").contains("front")
    camera = F.col("path").rlike(r"[\\/]DCIM[\\/]Camera[\\/]") & ~no_camera
    numbered = F.col("filename").rlike("^IMG_") & no_camera
    return joined.select(
        "media_id",
        F.coalesce(screen & no_camera, F.lit(False)).alias("screen_shaped"),
        F.when(front, F.lit("SELFIE"))
        .when(camera, "PHOTO")
        .when(F.coalesce(screen, F.lit(False)) & no_camera, "SCREENSHOT")
        .when(numbered, "PHOTO")
        .otherwise(F.col("category"))
        .alias("category"),
        F.when(front, F.lit("UNKNOWN"))
        .when(camera, "KEEP_LONG_TERM")
        .when(F.coalesce(screen, F.lit(False)) & no_camera, "EPHEMERAL")
        .when(numbered, "UNKNOWN")
        .otherwise(F.col("intent"))
        .alias("intent"),
    )


def receipt_text_rule(classified: DataFrame, ocr: DataFrame, text_heavy: list[str]) -> DataFrame:
    """OCR text with a total, a tax mark or an amount turns text-heavy items into receipts."""
    receipt = F.col("text").rlike(r"(?i)\b(total|gst)\b|\d+\.\d{2}\b")
    joined = classified.join(ocr.select("media_id", "text"), "media_id", "left")
    hit = F.coalesce(receipt, F.lit(False)) & F.col("category").isin(text_heavy)
    return joined.select(
        "media_id",
        F.when(hit, "RECEIPT").otherwise(F.col("category")).alias("category"),
        F.when(hit, "EPHEMERAL").otherwise(F.col("intent")).alias("intent"),
    )


def intent_infer(items: DataFrame, event_sizes: DataFrame) -> DataFrame:
    """Intent from category, favourite mark, faces and event size; a user's own choice stays."""
    joined = items.join(event_sizes.select("media_id", "event_size"), "media_id", "left")
    faces = F.coalesce(F.col("face_count"), F.lit(0)) > 0
    keep = (
        F.col("is_favorite")
        | ((F.col("category") == "PHOTO") & faces)
        | (F.coalesce(F.col("event_size"), F.lit(0)) > 5)
    )
    passing = F.col("category").isin("RECEIPT", "TRANSACTIONAL") | (
        (F.col("category") == "SCREENSHOT") & F.coalesce(F.col("is_code_or_confirmation"), F.lit(False))
    )
    return joined.select(
        "media_id",
        F.when(F.col("user_intent_locked"), F.col("intent"))
        .when(keep, "KEEP_LONG_TERM")
        .when(passing, "EPHEMERAL")
        .otherwise("UNKNOWN")
        .alias("intent"),
    )
