"""EXIF tags and image sizes out of the bytes of JPEG, PNG, WebP and TIFF files.

Files are read in pieces and only where their headers are: pixels are passed over, and nothing larger than a directory or a
text of 64 KiB is held. The result is the tag record that :func:`silverprint.sources.exif.exif_normalize` takes.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverprint.sources.exif import exif_normalize
from silverprint.sources.tree import file_system

# Numbers of the tags in the main, the EXIF and the GPS directory, and the tags that point to the latter two.
MAIN_TAGS = {0x0100: "ImageWidth", 0x0101: "ImageHeight", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x8769: "exif", 0x8825: "gps"}
EXIF_TAGS = {
    0x829A: "ExposureTime",
    0x829D: "FNumber",
    0x8827: "ISO",
    0x9003: "DateTimeOriginal",
    0x920A: "FocalLength",
    0xA434: "LensModel",
}
GPS_TAGS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon", 5: "alt_ref", 6: "alt"}
# Struct codes of the value types; a rational is two integers.
VALUE_TYPES = {1: "B", 2: "s", 3: "H", 4: "L", 5: "LL", 6: "b", 7: "s", 8: "h", 9: "l", 10: "ll", 11: "f", 12: "d"}
# Tags that are whole numbers, and tags that are text.
WHOLE = {"ImageWidth", "ImageHeight", "Orientation", "ISO", "exif", "gps"}
TEXTS = {"Make", "Model", "LensModel", "DateTimeOriginal", "lat_ref", "lon_ref"}

_PIECE = 1 << 16
#: A value of more bytes than this is taken as damaged.
_LONGEST_VALUE = 1 << 16


class Damaged(ValueError):
    """The header ends early or points outside the file."""


class Pieces:
    """Bytes of a stream at any place, read a piece at a time; two pieces are kept."""

    def __init__(self, stream):
        self._stream, self._kept = stream, {}

    def _piece(self, n: int) -> bytes:
        if n not in self._kept:
            if len(self._kept) == 2:
                self._kept.pop(next(iter(self._kept)))
            self._stream.seek(n * _PIECE)
            self._kept[n] = self._stream.read(_PIECE)
        return self._kept[n]

    def head(self) -> bytes:
        return self._piece(0)

    def at(self, start: int, size: int) -> bytes:
        end, found, n = start + size, [], start // _PIECE
        while n * _PIECE < end:
            piece = self._piece(n)
            found.append(piece[max(0, start - n * _PIECE) : end - n * _PIECE])
            if len(piece) < _PIECE:
                break
            n += 1
        whole = b"".join(found)
        if len(whole) < size:
            raise Damaged
        return whole

    def unpack(self, form: str, start: int) -> tuple:
        return struct.unpack(form, self.at(start, struct.calcsize(form)))


def _value(pieces: Pieces, order: str, base: int, entry: int, name: str):
    """Text or number of a directory entry, the numbers of a GPS place; None where it cannot be read."""
    kind, count = pieces.unpack(order + "HL", entry + 2)
    code = VALUE_TYPES.get(kind)
    if code is None or count == 0 or (code == "s") != (name in TEXTS):
        return None
    width = struct.calcsize("=" + code)
    if width * count > _LONGEST_VALUE:
        return None
    place = entry + 8 if width * count <= 4 else base + pieces.unpack(order + "L", entry + 8)[0]
    try:
        data = pieces.at(place, width * count)
    except Damaged:
        return None
    if code == "s":
        return data.split(b"\0", 1)[0].decode("utf-8", "replace").strip() or None
    numbers = struct.unpack(f"{order}{code * count}", data)
    if len(code) == 2:
        numbers = tuple(a / b if b else math.nan for a, b in zip(numbers[::2], numbers[1::2]))
    if not all(map(math.isfinite, numbers)):
        return None
    if name in WHOLE:
        return int(numbers[0])
    return list(numbers) if name in ("lat", "lon") else numbers[0]


def _directory(pieces: Pieces, order: str, base: int, offset: int, names: dict[int, str]) -> dict:
    """Wanted values of one directory; what lies behind its damaged end is left out, the first entry of a tag counts."""
    found: dict = {}
    try:
        (entries,) = pieces.unpack(order + "H", base + offset)
        for i in range(entries):
            entry = base + offset + 2 + 12 * i
            name = names.get(pieces.unpack(order + "H", entry)[0])
            if name and name not in found:
                value = _value(pieces, order, base, entry, name)
                if value is not None:
                    found[name] = value
    except Damaged:
        pass
    return found


def _degrees(value: list | None, ref: str | None, negative: str) -> float | None:
    if not value:
        return None
    size = sum(float(part) / 60**i for i, part in enumerate(value[:3]))
    return -size if ref and ref.upper().startswith(negative) else size


def directory_tags(pieces: Pieces, base: int) -> dict:
    """Tags of the directories that start at ``base`` with their byte order; none where that header is damaged."""
    try:
        order = {b"II": "<", b"MM": ">"}.get(pieces.at(base, 2))
        if order is None or pieces.unpack(order + "H", base + 2) != (42,):
            return {}
        (first,) = pieces.unpack(order + "L", base + 4)
    except Damaged:
        return {}
    tags = _directory(pieces, order, base, first, MAIN_TAGS)
    if (offset := tags.pop("exif", None)) is not None:
        tags |= _directory(pieces, order, base, offset, EXIF_TAGS)
    if (offset := tags.pop("gps", None)) is not None:
        gps = _directory(pieces, order, base, offset, GPS_TAGS)
        height = gps.get("alt")
        tags |= {
            "GPSLatitude": _degrees(gps.get("lat"), gps.get("lat_ref"), "S"),
            "GPSLongitude": _degrees(gps.get("lon"), gps.get("lon_ref"), "W"),
            "GPSAltitude": -height if height is not None and gps.get("alt_ref") == 1 else height,
        }
    return {name: value for name, value in tags.items() if value is not None}


def _jpeg(pieces: Pieces) -> Iterator[tuple[str, dict]]:
    at = 2
    while True:
        (fill, marker) = pieces.unpack("BB", at)
        if fill != 0xFF:
            return
        if marker == 0xFF:  # filling
            at += 1
            continue
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:  # markers without content
            at += 2
            continue
        if marker in (0xD9, 0xDA):  # end, or pixels begin
            return
        (size,) = pieces.unpack(">H", at + 2)
        if size < 2:
            return
        if marker == 0xE1 and size >= 8 and pieces.at(at + 4, 6) == b"Exif\0\0":
            yield "tags", directory_tags(pieces, at + 10)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = pieces.unpack(">HH", at + 5)
            yield "size", {"ImageWidth": width, "ImageHeight": height}
        at += 2 + size


def _png(pieces: Pieces) -> Iterator[tuple[str, dict]]:
    at = 8
    while True:
        size, kind = pieces.unpack(">L4s", at)
        if kind == b"IHDR":
            width, height = pieces.unpack(">LL", at + 8)
            yield "size", {"ImageWidth": width, "ImageHeight": height}
        elif kind == b"eXIf":
            yield "tags", directory_tags(pieces, at + 8)
        elif kind == b"IEND":
            return
        at += 12 + size


def _webp(pieces: Pieces) -> Iterator[tuple[str, dict]]:
    at = 12
    while True:
        kind, size = pieces.unpack("<4sL", at)
        if kind == b"VP8X":
            a, b, c, d, e, f = pieces.unpack("6B", at + 12)
            yield "size", {"ImageWidth": 1 + a + (b << 8) + (c << 16), "ImageHeight": 1 + d + (e << 8) + (f << 16)}
        elif kind == b"VP8 ":
            width, height = pieces.unpack("<HH", at + 14)
            yield "size", {"ImageWidth": width & 0x3FFF, "ImageHeight": height & 0x3FFF}
        elif kind == b"VP8L":
            (bits,) = pieces.unpack("<L", at + 9)
            yield "size", {"ImageWidth": 1 + (bits & 0x3FFF), "ImageHeight": 1 + (bits >> 14 & 0x3FFF)}
        elif kind == b"EXIF":
            start = at + 8
            yield "tags", directory_tags(pieces, start + 6 if pieces.at(start, 6) == b"Exif\0\0" else start)
        at += 8 + size + size % 2


def image_tags(stream) -> dict | None:
    """Tag record of an image file open at any place; None if it is no image of a known kind.

    A frame's own size wins over the size that its EXIF directory states. A damaged header gives what was read before the
    damage.
    """
    pieces = Pieces(stream)
    start = pieces.head()[:12]
    if start[:4] in (b"II*\0", b"MM\0*"):
        return directory_tags(pieces, 0)
    if start[:3] == b"\xff\xd8\xff":
        found = _jpeg(pieces)
    elif start[:8] == b"\x89PNG\r\n\x1a\n":
        found = _png(pieces)
    elif start[:4] == b"RIFF" and start[8:] == b"WEBP":
        found = _webp(pieces)
    else:
        return None
    records: dict[str, dict] = {"size": {}, "tags": {}}
    try:
        for part, record in found:
            records[part] = record | records[part]  # the first one counts
    except Damaged:
        pass
    return records["tags"] | records["size"]


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for path in batch["path"]:
            tags = None
            if path is not None:
                try:
                    system, inner = file_system(path)
                    with system.open_input_file(inner) as stream:
                        tags = image_tags(stream)
                except OSError:  # gone or not readable
                    pass
            found.append(None if tags is None else json.dumps(tags, sort_keys=True))
        yield batch.assign(raw_json=found)


def with_tag_records(files: DataFrame) -> DataFrame:
    """``files`` with the tags of the image at ``path`` as ``raw_json``; null for a null path, an unreadable file or no image.

    Files are dealt to all tasks by their path, whatever folder they come from. A column called ``raw_json`` is replaced.
    """
    plain = files.drop("raw_json")
    schema = T.StructType([*plain.schema.fields, T.StructField("raw_json", T.StringType())])
    return plain.repartition(F.xxhash64("path")).mapInPandas(_records, schema)


def read_exif(files: DataFrame) -> DataFrame:
    """Typed EXIF rows of ``files (media_id, path)``; files without a tag record have no row, as none was read."""
    return exif_normalize(with_tag_records(files.select("media_id", "path")).filter("raw_json IS NOT NULL"))
