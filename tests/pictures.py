"""Small generated PNG files; nothing is committed."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np


def png(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return (
        b"\x89PNG\r\n\x1a\n"
        + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
        + chunk(b"IDAT", zlib.compress(raw))
        + chunk(b"IEND", b"")
    )


def scene(seed: int, width: int, height: int) -> np.ndarray:
    """Smooth colour waves that depend on the seed only, not on the size."""
    rng = np.random.default_rng(seed)
    fx, fy, phase = rng.uniform(1, 4, 3), rng.uniform(1, 4, 3), rng.uniform(0, 6, 3)
    y, x = np.mgrid[0:height, 0:width]
    u, v = (x + 0.5) / width, (y + 0.5) / height
    waves = [np.sin(6.283 * (fx[c] * u + fy[c] * v * 0.5) + phase[c]) for c in range(3)]
    return np.clip(np.stack(waves, axis=-1) * 100 + 128, 0, 255).astype(np.uint8)


def library(root: Path) -> dict[str, bytes]:
    """Eleven files: five scenes, two byte copies, two near copies, two screenshots."""
    files = {f"photo_{i}.png": png(scene(i, 200, 150)) for i in range(1, 6)}
    for i in (1, 2):
        files[f"photo_1_copy_{i}.png"] = files["photo_1.png"]
    files["photo_1_smaller.png"] = png(scene(1, 100, 75))
    noisy = scene(1, 200, 150).astype(int) + np.random.default_rng(0).integers(-2, 3, (150, 200, 3))
    files["photo_1_recompressed.png"] = png(np.clip(noisy, 0, 255))
    for day, seed in ((11, 101), (12, 102)):
        files[f"Screenshots/Screenshot_2024-05-{day}.png"] = png(scene(seed, 117, 253))
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return files
