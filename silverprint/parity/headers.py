"""Image files that hold headers only, for queries that read them back."""

from __future__ import annotations

import struct
import zlib


def directory(order: str, entries: list[tuple[int, int, object]], start: int) -> bytes:
    """A directory at ``start`` of its block; values that need more than four bytes follow it."""
    entries = sorted(entries)
    head, tail = [struct.pack(order + "H", len(entries))], b""
    behind = start + 2 + 12 * len(entries) + 4
    for tag, kind, value in entries:
        if kind == 2:
            data, count = value.encode() + b"\0", len(value.encode()) + 1
        else:
            numbers = value if isinstance(value, (list, tuple)) else [value]
            data = struct.pack(order + {1: "B", 3: "H", 4: "L", 5: "L"}[kind] * len(numbers), *numbers)
            count = len(numbers) // (2 if kind == 5 else 1)
        if len(data) > 4:
            place, tail = struct.pack(order + "L", behind + len(tail)), tail + data + b"\0" * (len(data) % 2)
        else:
            place = data.ljust(4, b"\0")
        head.append(struct.pack(order + "HHL", tag, kind, count) + place)
    return b"".join(head) + b"\0\0\0\0" + tail


def block(order: str, main: list, exif: list, gps: list) -> bytes:
    """Byte order, main directory with its two pointers, EXIF and GPS directory."""
    fill = [*main, (0x8769, 4, 0), (0x8825, 4, 0)]
    exif_at = 8 + len(directory(order, fill, 8))
    second = directory(order, exif, exif_at)
    gps_at = exif_at + len(second)
    first = directory(order, [*main, (0x8769, 4, exif_at), (0x8825, 4, gps_at)], 8)
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HL", 42, 8) + first + second + directory(order, gps, gps_at)


def jpeg(width: int, height: int, tags: bytes) -> bytes:
    about = b"Exif\0\0" + tags
    frame = struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\0"
    segments = [(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), (0xE1, about), (0xC0, frame)]
    return b"\xff\xd8" + b"".join(struct.pack(">BBH", 255, m, len(b) + 2) + b for m, b in segments) + b"\xff\xda\0\2\xff\xd9"


def png(width: int, height: int, tags: bytes) -> bytes:
    chunks = [(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)), (b"IDAT", b"\0" * 70_000), (b"eXIf", tags), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in chunks)


def webp(width: int, height: int, tags: bytes) -> bytes:
    size = (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")
    chunks = b"".join(k + struct.pack("<L", len(b)) + b + b"\0" * (len(b) % 2) for k, b in [(b"VP8X", b"\x08\0\0\0" + size), (b"EXIF", tags)])
    return b"RIFF" + struct.pack("<L", 4 + len(chunks)) + b"WEBP" + chunks
