"""Media columns: texts as lossless WebP images and back.

A text's UTF-8 bytes are padded with blanks to a positive multiple of 192 and become the rows of a grey image, 192 samples wide. A
payload of more rows than an image may have fills several images; the stored form is their RIFF files back to back. Reading decodes
the stored bytes again; every figure but the text's own size is computed from what was read. The writer measures: of the sets of tools that the
samples speak for (palette, predictors, none) it keeps the smallest, with back-references wherever twelve bytes came before, and with codes of the
image's own wherever these save two fifths. One rule for texts of every size.

Defined results: NULL counts as an empty text (192 blanks). Texts of any length are stored whole; memory follows one image at a
time (16,384 rows). Equal texts give equal values. Stored bytes that are no such image raise ``webp.BadImage``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.llm import webp
from roadflow.llm.common import blocks, ship_package, strings_of

WIDTH = 192
# Letters by how often they occur in a language, the blank first, and the share of its bytes that begin a letter of Latin-1.
LETTERS = {
    "English": (" etaoinshrdlcumwfgypbvkjxqz", 0.0005),
    "German": (" enisratdhulcgmobwfkzpvjyxq", 0.03),
    "French": (" esaitnrulodcpmvqfbghjxyzkw", 0.03),
    "Spanish": (" eaosrnidlctumpbgvyqhfzjxkw", 0.03),
}


@lru_cache(1)
def text_codes() -> tuple[tuple[bytes, ...], ...]:
    """Code lengths for text in each language: letters decline by a seventh from rank to rank, capitals are rare, other signs rarer; copies are short and come from afar."""
    out = []
    for rank, latin in LETTERS.values():
        counts = np.ones(256 + webp.LENGTH_CODES)
        counts[32:127], counts[48:58] = 12, 20
        for r, c in enumerate(rank.encode()):
            share = 14_500 * 0.86**r
            counts[c] = max(share, 40)
            if r:
                counts[c - 32] = max(0.03 * share, 30)
        for sign, share in ((".", 1500), (",", 1200), ("\n", 400), ("'", 200), ("-", 200)):
            counts[ord(sign)] = share
        counts[195], counts[160:192] = 100_000 * latin, 100_000 * latin / 32
        counts[256 + 6], counts[256 + 7 : 256 + 16] = 800, 30
        distances = np.ones(webp.DISTANCE_CODES)
        distances[1], distances[12:32] = 60, 100 * np.minimum(np.arange(1, 21), np.arange(20, 0, -1))
        out.append(webp.one_channel(counts.astype(np.int64).tobytes(), distances.astype(np.int64).tobytes()))
    return tuple(out)


def pad(text: bytes) -> bytes:
    return text.ljust(max(WIDTH, -(-len(text) // WIDTH) * WIDTH), b" ")


def _plans(grey: np.ndarray) -> list[dict]:
    """The sets of tools that may give the smallest image: the plain one, and others where a count of the samples speaks for them."""
    plans: list[dict] = [{}]
    flat = grey.ravel()
    if np.count_nonzero(np.bincount(flat, minlength=256)) <= 16:  # several samples fit a byte
        plans.append({"palette": True})
    for mode, back in ((1, 1), (2, grey.shape[1])):
        if 2 * np.count_nonzero(flat[back:] == flat[:-back]) > len(flat):  # most samples are like the one before or above
            plans.append({"predictor": (np.full((-(-grey.shape[0] // 512), -(-grey.shape[1] // 512)), mode), 9)})
    return plans


def store(payload: bytes, told: list[str] | None = None) -> bytes:
    """The stored form of a payload of whole rows: of the plans for each image the one that takes the fewest bytes. told: gets the tools used."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    out = []
    for at in range(0, len(rows), webp.MOST_SIDE):
        part = rows[at : at + webp.MOST_SIDE]
        best = None
        for plan in _plans(part):
            tools: list[str] = []
            if plan:
                rgba = np.repeat(part[..., None], 4, 2)
                rgba[..., 3] = 255
                done = webp.encode(rgba, subtract_green="palette" not in plan, prior=text_codes(), told=tools, **plan)
            else:
                done = webp.encode_grey(part, prior=text_codes(), told=tools)
            if best is None or len(done) < len(best[0]):
                best = done, tools
        out.append(best[0])
        if told is not None:
            told += best[1]
    return b"".join(out)


def images(stored: bytes) -> Iterator[np.ndarray]:
    at = 0
    while at < len(stored):
        size = 8 + struct.unpack("<I", stored[at + 4 : at + 8])[0]
        yield webp.decode(stored[at : at + size])
        at += size


def payload_of(image: np.ndarray) -> bytes:
    return image[..., 1].tobytes()


def described(stored: bytes) -> dict:
    """What the stored bytes hold: size, digest and last 16 bytes of the payload, and features of its samples."""
    sha, size, tail, counts, height = hashlib.sha256(), 0, b"", np.zeros(256, np.int64), 0
    for image in images(stored):
        part = payload_of(image)
        sha.update(part)
        size += len(part)
        tail = (tail + part)[-16:]
        counts += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        height += image.shape[0]
    mean = float(counts @ np.arange(256)) / size
    spread = (float(counts @ (np.arange(256) ** 2)) / size - mean * mean) ** 0.5
    bins = counts.reshape(16, 16).sum(1) * 1000 // size
    return {
        "payload_bytes": size,
        "payload_sha256": sha.hexdigest(),
        "tail_crc32": zlib.crc32(tail),
        "feature": f"{WIDTH}x{height} mean={mean:.4f} sd={spread:.4f} bins={'/'.join(map(str, bins.tolist()))}",
    }


def stored_texts(docs: DataFrame, *, id_col: str = "doc_id", with_image: bool = False) -> DataFrame:
    """id, n_bytes, the digests and features of what was read back, and (``with_image``) the stored bytes."""
    ship_package(docs.sparkSession)
    kinds = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "tools": "string"}
    if with_image:
        kinds["media"] = "binary"
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1):
            rows = []
            for text in strings_of(block.column(1)):
                tools: list[str] = []
                stored = store(pad(text), tools)
                rows.append({"n_bytes": len(text), "tools": ",".join(sorted(set(tools))), "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "media": stored} | described(stored))
            yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array([r[k] for r in rows], arrow[t]) for k, t in kinds.items())], [id_col, *kinds])

    schema = docs.select(id_col).schema
    for k, t in kinds.items():
        schema = schema.add(k, t)
    return docs.select(id_col, F.col("text").alias("__text")).mapInArrow(run, schema)
