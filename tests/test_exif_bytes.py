"""Image headers read from files that the tests write byte by byte."""

from __future__ import annotations

import io
import struct

import pytest

from silverprint.parity import headers
from silverprint.sources import exif_bytes

# Big-endian block written out by hand: Make "Ab", Orientation 6, pointer to an EXIF directory with FNumber 28/10.
BY_HAND = bytes.fromhex(
    "4d4d002a00000008"  # MM, 42, first directory at 8
    "0003"
    "010f000200000003" "41620000"
    "0112000300000001" "00060000"
    "8769000400000001" "00000032"
    "00000000"
    "0001"  # at 50
    "829d000500000001" "00000044"
    "00000000"
    "0000001c0000000a"  # at 68
)


def read(data: bytes) -> dict | None:
    return exif_bytes.image_tags(io.BytesIO(data))


def test_a_block_written_by_hand_in_every_format():
    want = {"Make": "Ab", "Orientation": 6, "FNumber": 2.8}
    assert read(BY_HAND) == want
    size = {"ImageWidth": 300, "ImageHeight": 200}
    for made in (headers.jpeg, headers.png, headers.webp):
        assert read(made(300, 200, BY_HAND)) == want | size


@pytest.mark.parametrize("order", ["<", ">"])
def test_places_heights_and_values_behind_the_directory(order):
    gps = [(1, 2, "S"), (2, 5, [10, 1, 30, 1, 36, 1]), (3, 2, "W"), (4, 5, [1, 1, 0, 1, 0, 1]), (5, 1, 1), (6, 5, [25, 2])]
    exif = [(0x829A, 5, [1, 8]), (0x8827, 3, [400, 800]), (0x9003, 2, "2024:05:11 10:20:30"), (0xA434, 2, "Lens é")]
    got = read(headers.block(order, [(0x0110, 2, "A long model name")], exif, gps))
    assert got == {
        "Model": "A long model name",
        "ExposureTime": 0.125,
        "ISO": 400,
        "DateTimeOriginal": "2024:05:11 10:20:30",
        "LensModel": "Lens é",
        "GPSLatitude": -(10 + 30 / 60 + 36 / 3600),
        "GPSLongitude": -1.0,
        "GPSAltitude": -12.5,
    }


def test_every_cut_of_a_header_gives_part_of_its_record():
    whole = headers.block("<", [(0x010F, 2, "A maker")], [(0x829D, 5, [28, 10])], [(1, 2, "N"), (2, 5, [1, 1, 0, 1, 0, 1])])
    for made in (lambda w, h, t: t, headers.jpeg, headers.webp):
        data = made(30, 20, whole)
        want = read(data)
        for end in range(len(data)):
            got = read(data[:end])
            assert got is None or got.items() <= want.items()
    assert read(b"") is None and read(b"text") is None and read(b"II*\0") == {}


def test_damaged_values_are_left_out_and_the_rest_is_read():
    main = headers.directory(">", [(0x010F, 2, "Ab"), (0x0112, 3, 6)], 8)
    start = b"MM" + struct.pack(">HL", 42, 8)
    # Make of an unknown type, far outside the file, or longer than any header
    for at, change in [(2 + 2, struct.pack(">H", 99)), (2 + 4, struct.pack(">L", 500)), (2 + 4, struct.pack(">L", 1 << 30))]:
        broken = main[:at] + change + main[at + len(change) :]
        assert read(start + broken) == {"Orientation": 6}
    zero = headers.block("<", [], [(0x829D, 5, [1, 0]), (0x8827, 3, 50)], [])
    assert read(zero) == {"ISO": 50}
    loop = b"II" + struct.pack("<HL", 42, 8) + headers.directory("<", [(0x8769, 4, 8)], 8)  # points to itself
    assert read(loop) == {}


def test_a_directory_beyond_the_first_piece():
    far = b"MM" + struct.pack(">HL", 42, 200_000) + b"\0" * 199_992 + headers.directory(">", [(0x0110, 2, "Far away")], 200_000)
    assert read(far) == {"Model": "Far away"}


def test_files_of_a_table(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(headers.jpeg(40, 30, BY_HAND))
    (tmp_path / "b.txt").write_text("no image")
    (tmp_path / "c.png").write_bytes(headers.png(5, 6, b""))
    rows = [(n, str(tmp_path / f"{n}.{e}") if e else None, "x") for n, e in [("a", "jpg"), ("b", "txt"), ("c", "png"), ("gone", "png"), ("none", None)]]
    files = spark.createDataFrame(rows, "media_id string, path string, raw_json string")
    records = {r.media_id: r.raw_json for r in exif_bytes.with_tag_records(files).collect()}
    assert records["b"] is records["gone"] is records["none"] is None
    got = {r.media_id: r for r in exif_bytes.read_exif(files).collect()}
    assert set(got) == {"a", "c"}
    assert (got["a"].make, got["a"].orientation, got["a"].f_number, got["a"].width, got["a"].height) == ("Ab", 6, 2.8, 40, 30)
    assert (got["c"].make, got["c"].width, got["c"].height, got["c"].taken_at) == (None, 5, 6, None)
    assert exif_bytes.read_exif(files.limit(0)).count() == 0


def test_files_of_a_batch_are_not_held_at_once(tmp_path):
    import tracemalloc

    import pandas as pd
    import pyarrow as pa

    from silverprint.parity import records

    ids = list(range(2_000))
    docs = pd.DataFrame({"path": [f"{tmp_path}/photos/{i}.img" for i in ids], "doc_id": ids, "n_chars": ids, "source": "web", "lang": "de"})
    texts = pa.record_batch({"path": [f"{tmp_path}/texts/{i}" for i in range(64)], "content": [b"%d" % (i % 10) * 1_000_000 for i in range(64)]})
    for write, batch, number, least in ((records._write_photos, docs, 2_000, 8_000_000), (records._write_files, texts, 64, 64_000_000)):
        tracemalloc.start()
        assert [len(p) for p in write(iter([batch]))] == [number]
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        written = [f.stat().st_size for f in (tmp_path / ("photos" if batch is docs else "texts")).iterdir()]
        assert len(written) == number and sum(written) >= least
        assert held < sum(written) / 8
