from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from roadflow.llm import media, webp

rng = np.random.default_rng(7)


def image(h, w, k=256):
    a = rng.integers(0, k, (h, w, 4)).astype(np.uint8)
    a[:, w // 3 : 2 * w // 3] = a[:1, :1]
    return a


@pytest.mark.parametrize("size", [(1, 1), (3, 5), (17, 40), (33, 64)])
def test_every_tool_round_trips(size):
    h, w = size
    a = image(h, w)
    for tile in (2, 3):
        th, tw = -(-h // (1 << tile)), -(-w // (1 << tile))
        modes, cross = rng.integers(0, 14, (th, tw)), rng.integers(-128, 128, (th, tw, 3))
        for options in (
            {}, {"cache_bits": 1}, {"cache_bits": 6}, {"subtract_green": True}, {"predictor": (modes, tile)}, {"cross": (cross, tile)},
            {"predictor": (modes, tile), "cross": (cross, tile), "subtract_green": True, "cache_bits": 7},
        ):
            assert (webp.decode(webp.encode(a, **options)) == a).all(), options


@pytest.mark.parametrize("mode", [1, 2, 3, 4])
@pytest.mark.parametrize("size", [(1, 1), (1, 7), (9, 1), (9, 2), (8, 30)])
def test_rows_are_predicted_as_pixels_are(mode, size):
    a = image(*size)
    modes = np.full((1, 1), mode)
    mixed = np.array([[mode, 5]])  # an unused tile keeps the slow way
    slow = webp.predict(a, mixed, 9, False)
    assert (webp.predict(a, modes, 9, False) == slow).all() and (webp.predict(slow, modes, 9, True) == a).all()


def test_copies_are_real_back_references():
    text = (b"the quick brown fox jumps over the lazy dog, and " * 3 + b"something else; " + b"quick brown fox ") * 4
    a = np.frombuffer(text, np.uint8).astype(np.uint32) << 8
    start, length, far = webp._copies(a)
    assert len(start) and (far > 0).all() and (length >= webp.LEAST_COPY).all() and (start[1:] >= (start + length)[:-1]).all()
    for s, n, d in zip(start.tolist(), length.tolist(), far.tolist()):
        assert all(a[i] == a[i - d] for i in range(s, s + n))
    assert len(media.store(media.pad(text))) < 0.35 * len(text)


def test_the_writer_chooses_tools_by_size(spark, sf_dir):
    texts = ["", "abba" * 300, "".join(map(chr, range(32, 127))) * 60, "the cat sat on the mat and the cat sat on the mat again"]
    for t in texts:
        tools = []
        payload = media.pad(t.encode())
        stored = media.store(payload, tools)
        assert payload == b"".join(map(media.payload_of, media.images(stored)))
        for plan in ({}, {"palette": True}) if len(set(payload)) <= 16 else ({},):
            rgba = np.repeat(np.frombuffer(payload, np.uint8).reshape(-1, 192)[..., None], 4, 2).copy()
            rgba[..., 3] = 255
            plain = webp.encode(rgba, subtract_green=not plan, prior=media.text_codes(), **plan)
            assert len(stored) <= len(plain)
            assert plan or plain == webp.encode_grey(rgba[..., 0], prior=media.text_codes())
    from roadflow.llm import queries

    used = {t for r in queries.op1_webp_media(spark, sf_dir).select("tools").distinct().collect() for t in r["tools"].split(",")}
    assert used >= {"copies", "shared codes", "own codes", "subtract-green"}, used


@pytest.mark.parametrize("k", [1, 2, 3, 9, 16, 17, 200])
def test_palettes(k):
    colours = rng.integers(0, 256, (k, 4)).astype(np.uint8)
    a = colours[rng.integers(0, k, (19, 23))]
    assert (webp.decode(webp.encode(a, palette=True)) == a).all()
    assert (webp.decode(webp.encode(a, palette=True, cache_bits=3)) == a).all()


def test_several_code_groups_and_length_codes():
    """A stream written by hand: two groups of codes by an entropy image, and a back-reference to the row above."""
    w = webp._Writer()
    for value, n in ((0x2F, 8), (7, 14), (7, 14), (0, 1), (0, 3), (0, 1), (0, 1), (1, 1), (0, 3)):
        w.put(value, n)  # 8 x 8, no transform, no cache, groups by tiles of 4 x 4
    webp._write_image(w, np.array([0, 1, 1, 0], np.uint32) << 8, False)
    one = lambda s: np.eye(1, 256, s, dtype=np.int32)[0]
    green = np.zeros(280, np.int32)
    green[[10, 20]] = 1
    back = np.zeros(280, np.int32)
    back[[10, 30, 256 + 5]] = 1, 2, 2
    distance = np.zeros(40, np.int32)
    distance[0] = 1  # the row above
    codes = [[webp._write_code(w, x) for x in (g, one(1), one(2), one(255), distance)] for g in (green, back)]
    expected = np.zeros((8, 8), int)
    for i in range(64):
        y, x = divmod(i, 8)
        group = int((y // 4 + x // 4) % 2)
        v = 10 if (i * 7) % 3 else (20, 30)[group]
        expected[y, x] = v
        w.put(int(codes[group][0][0][v]), int(codes[group][0][1][v]))
    body = w.value.to_bytes((w.n + 7) // 8, "little")
    body += bytes(len(body) & 1)
    data = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
    got = webp.decode(data)
    assert (got[..., 1] == expected).all() and (got[..., 0] == 1).all() and (got[..., 3] == 255).all()


def test_bad_bytes_raise():
    good = webp.encode(image(8, 8))
    with pytest.raises(webp.BadImage):
        webp.decode(b"not an image at all, certainly")
    with pytest.raises(webp.BadImage):
        webp.decode(good[:20] + b"\x00" + good[21:])
    with pytest.raises(webp.BadImage):
        webp.decode(good[: len(good) // 2])


def test_texts(spark):
    long = "x" * (192 * webp.MOST_SIDE) + "tail of more than one image"
    texts = [None, "", "a", "é" * 97, "word " * 5000, " " * 192, "A\nB\tC", long, "a"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    got = {r["doc_id"]: r for r in media.stored_texts(df, with_image=True).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert b"".join(map(media.payload_of, media.images(bytes(r["media"])))) == payload
    assert got[2]["feature"] == got[8]["feature"] and media.stored_texts(df.limit(0)).count() == 0
