"""Image forms, resizing, tiles, and the lossless text payload."""

import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from strandmill.llm import media


def bmp(image, bits, palette=None, flip=True):
    h, w = image.shape[:2]
    stride = (w * bits + 31) // 32 * 4
    rows = np.zeros((h, stride), np.uint8)
    if bits == 1:
        packed = np.packbits(image.astype(np.uint8), axis=1)
        rows[:, : packed.shape[1]] = packed
    elif bits == 4:
        even = np.zeros((h, (w + 1) // 2 * 2), np.uint8)
        even[:, :w] = image
        rows[:, : even.shape[1] // 2] = even[:, ::2] << 4 | even[:, 1::2]
    elif bits == 8:
        rows[:, :w] = image
    else:
        full = np.zeros((h, w, bits // 8), np.uint8)
        full[:, :, :3] = image[:, :, ::-1]
        rows[:, : w * bits // 8] = full.reshape(h, -1)
    if flip:
        rows = rows[::-1]
    table = b"".join(bytes((b, g, r, 0)) for r, g, b in palette or [])
    head = struct.pack("<IiiHHIIiiII", 40, w, h if flip else -h, 1, bits, 0, 0, 0, 0, len(palette or []), 0)
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + len(table)) + head + table + rows.tobytes()


rng = np.random.default_rng(1)


@pytest.mark.parametrize("bits", [1, 4, 8])
def test_palette_bitmaps(bits):
    palette = [tuple(int(v) for v in rng.integers(0, 256, 3)) for _ in range(1 << bits)]
    index = rng.integers(0, 1 << bits, (5, 7))
    want = np.array(palette, np.uint8)[index]
    for flip in (True, False):
        assert (media.decode(bmp(index, bits, palette, flip)) == want).all()


@pytest.mark.parametrize("bits", [24, 32])
def test_true_colour_bitmaps(bits):
    image = rng.integers(0, 256, (4, 5, 3)).astype(np.uint8)
    assert (media.decode(bmp(image, bits)) == image).all()


def test_netpbm():
    grey = rng.integers(0, 256, (3, 10)).astype(np.uint8)
    rgb = rng.integers(0, 256, (2, 3, 3)).astype(np.uint8)
    deep = rng.integers(0, 65536, (2, 3)).astype(">u2")
    bits = rng.integers(0, 2, (3, 10)).astype(np.uint8)
    text = lambda a: b" ".join(b"%d" % v for v in a.reshape(-1))
    assert (media.decode(b"P5 # a comment\n10 3\n255\n" + grey.tobytes()) == grey).all()
    assert (media.decode(b"P6\n3 2 255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode(b"P5\n3 2\n65535\n" + deep.tobytes()) == deep).all()
    assert (media.decode(b"P2\n10 3\n# more\n255\n" + text(grey)) == grey).all()
    assert (media.decode(b"P3\n3 2\n255\n" + text(rgb)) == rgb).all()
    assert (media.decode(b"P4\n10 3\n" + np.packbits(1 - bits, axis=1).tobytes()) == bits).all()
    assert (media.decode(b"P1\n10 3\n" + text(1 - bits)) == bits).all()
    for bad in (b"", b"P5", b"P5\n4 4\n255\nxx", b"P9\n1 1\n", b"BM", b"P5\n0 1\n255\n", b"P2\n2 2\n255\n1 2 3"):
        with pytest.raises((ValueError, struct.error)):
            media.decode(bad)


def test_area_resize_by_brute_force():
    image = rng.integers(0, 256, (7, 11)).astype(np.uint8)
    for h, w in ((3, 4), (7, 11), (14, 5), (1, 1)):
        # Every pixel as h x w equal parts gives exact cells.
        fine = np.repeat(np.repeat(image.astype(float), h, 0), w, 1)
        want = fine.reshape(h, 7, w, 11).mean((1, 3))
        assert np.allclose(media.area_resize(image, h, w), want)


def test_hash_and_tile():
    ramp = np.tile(np.arange(0, 256, 4, dtype=np.uint8), (40, 1))
    assert media.difference_hash(ramp) == "f" * 16
    assert media.difference_hash(ramp[:, ::-1]) == "0" * 16
    tile = np.load(io.BytesIO(media.npy_tile(ramp, 8, 8)))
    assert tile.shape == (8, 8) and tile.dtype == np.uint8


def test_tiles_of_a_column(spark):
    rows = [(1, media.encode_grey(bytes(64)), "x"), (2, None, "x"), (3, b"junk", "x"), (3, b"junk", "x")]
    out = {r["id"]: r for r in media.media_tiles(spark.createDataFrame(rows, "id long, media binary, tile string")).collect()}
    assert (out[1]["height"], out[1]["width"], out[1]["channels"], out[1]["error"]) == (1, 64, 1, None)
    assert out[2]["error"] == "no image" and out[3]["tile"] is None


def test_text_payloads(spark):
    texts = [None, "", "a", "x" * 64, "é" * 100, "long " * 40_000, "x" * 64]
    df = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    out = {r["doc_id"]: r for r in media.text_media(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(padded[-64:])
        stored = media.encode_grey(padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r["feature"] == media.difference_hash(np.frombuffer(padded, np.uint8).reshape(-1, 64))
    assert out[3].asDict() | {"doc_id": 6} == out[6].asDict()
    assert media.text_media(df.limit(0)).collect() == []


def test_tiles_keep_their_brightness():
    """A tile's grey is the image's share of white, whatever its depth and values."""
    tile = lambda data: np.load(io.BytesIO(media.npy_tile(*(lambda i, w: (i, 4, 4, w))(*media.decode_with_white(data)))))
    for value, white in ((250, 65535), (260, 65535), (40000, 65535), (60, 100), (1, 1), (200, 255)):
        form = "<u1" if white < 256 else ">u2"
        data = b"P5\n8 8\n%d\n" % white + np.full((8, 8), value, form).tobytes()
        assert (tile(data) == round(value * 255 / white)).all()
    assert (tile(b"P1\n8 8\n" + b"0 " * 64) == 255).all() and (tile(b"P1\n8 8\n" + b"1 " * 64) == 0).all()


def test_resize_in_strips(monkeypatch):
    image = rng.integers(0, 256, (57, 13, 3)).astype(np.uint8)
    whole = media.area_resize(image, 8, 9)
    monkeypatch.setattr(media, "_STRIP", 100)
    assert np.allclose(media.area_resize(image, 8, 9), whole, rtol=0, atol=1e-9)
    fine = np.repeat(np.repeat(image, 8, 0), 9, 1).reshape(8, 57, 9, 13, 3).mean((1, 3))
    assert np.allclose(whole, fine)
