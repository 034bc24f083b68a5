"""Images from files: pixels, digests, sizes by header and EXIF, broken files."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from plumbline.operators import images as I
from plumbline.sources import images as S


def png(pixels, extra=b""):
    h, w = pixels.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    kind = 2 if pixels.ndim == 3 else 0
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def tiff(order, orientation, before=0):
    o = {"II": "<", "MM": ">"}[order]
    entries = b"".join(struct.pack(f"{o}HHII", 0x0100 + k, 4, 1, 9) for k in range(before)) + struct.pack(f"{o}HHIHH", 0x0112, 3, 1, orientation, 0)
    return order.encode() + struct.pack(f"{o}HIH", 42, 8, before + 1) + entries + b"\0\0\0\0"


def jpeg(w, h, exif=b"", frame=0xC0):
    app = b"\xff\xe1" + struct.pack(">H", len(exif) + 8) + b"Exif\0\0" + exif if exif else b""
    return b"\xff\xd8\xff\xe0\0\x04xx" + app + b"\xff\xdb\0\x05abc\xff" + b"\xff" + bytes([frame]) + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\1\x11\0"


@pytest.mark.parametrize("orientation", range(1, 9))
@pytest.mark.parametrize("order", ["II", "MM"])
def test_orientations(order, orientation):
    for frame in (0xC0, 0xC2):
        assert S.size_of(jpeg(40, 30, tiff(order, orientation, 2), frame)) == (40, 30, orientation)
    assert S.exif_orientation(tiff(order, orientation)) == orientation


def test_cut_off_and_odd_heads():
    whole = jpeg(40, 30, tiff("II", 6, 1))
    assert S.size_of(jpeg(40, 30)) == (40, 30, 1)
    for n in range(len(whole) - 6):
        assert S.size_of(whole[:n]) in (None, (40, 30, 6))
    assert S.size_of(b"") is None and S.size_of(None) is None and S.size_of(b"GIF89a") is None
    assert S.exif_orientation(tiff("II", 9)) == 1 and S.exif_orientation(b"II*\0\xff\xff\xff\xff") == 1
    eight = tiff("MM", 8)
    assert S.size_of(png(np.zeros((3, 5), np.uint8), struct.pack(">I", len(eight)) + b"eXIf" + eight + b"\0\0\0\0")) == (5, 3, 8)


def test_upright_is_the_inverse_of_each_turn():
    x = np.arange(6).reshape(2, 3, 1)
    want = {1: x, 2: x[:, ::-1], 3: x[::-1, ::-1], 4: x[::-1], 5: x.swapaxes(0, 1), 6: np.rot90(x, -1), 7: np.rot90(x, 2).swapaxes(0, 1), 8: np.rot90(x)}
    for k, v in want.items():
        assert (I.upright(x, k) == v).all(), k


def test_folder_to_fingerprints(spark, tmp_path):
    rng = np.random.default_rng(1)
    color, gray = rng.integers(0, 256, (40, 50, 3), np.uint8), rng.integers(0, 256, (9, 7), np.uint8)
    (tmp_path / "deep").mkdir()
    files = {"a.png": png(color), "copy.png": png(color), "deep/b.PNG": png(gray), "broken.png": png(color)[:70], "empty.jpg": b"x", "notes.txt": b"x"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r["filename"]: r for r in I.fingerprints(S.read_images(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.png", "copy.png", "b.PNG", "broken.png", "empty.jpg"}
    for name, r in got.items():
        data = files[name if name != "b.PNG" else "deep/b.PNG"]
        assert (r["sha256"], r["bytes"]) == (hashlib.sha256(data).hexdigest(), len(data))
        assert r["read_error"] == (name in ("broken.png", "empty.jpg"))
    a = got["a.png"]
    want = I.features_of(color)
    assert all(a[f] == pytest.approx(want[f]) for f in I.FEATURES) and (a["width"], a["height"]) == (50, 40)
    assert a["phash"] == I.perceptual_hash(I.gray_of(color)) == got["copy.png"]["phash"]
    assert np.allclose(a["gray"], I.gray_vector(I.gray_of(color))) and len(got["b.PNG"]["gray"]) == 128 * 128
    assert got["b.PNG"]["brightness"] == pytest.approx(gray.mean() / 255) and got["empty.jpg"]["phash"] is None
    sizes = {r["path"].rsplit("/", 1)[1]: (r["width"], r["height"]) for r in S.image_sizes(spark, str(tmp_path)).collect()}
    assert sizes["a.png"] == (50, 40) and sizes["b.PNG"] == (7, 9) and sizes["empty.jpg"] == (None, None)
    ok, failed = I.split_errors(I.fingerprints(S.read_images(spark, str(tmp_path))))
    assert (ok.count(), failed.count()) == (3, 2)
