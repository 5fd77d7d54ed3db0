"""Operator 2, media columns: PNG images in binary columns and a low-frequency cosine hash of them.

``encode_png`` writes 8-bit grey samples as a PNG: signature, IHDR, IDAT with the zlib stream, IEND, each chunk
with its CRC; every row takes the filter (none, Sub or Up) that leaves the smallest sum of differences.
``decode_png`` walks the chunks, tests every checksum (a damaged chunk raises ``ValueError``), inflates
and takes all five row filters back in numpy, runs of rows of one kind at once. ``cosine_hash`` averages
the samples to 24 x 24, takes the two-dimensional cosine transform, and sets a bit for each of the
8 x 8 lowest frequencies that lies above their median; equal images give equal hashes and slight
changes flip few bits.

``stored_media`` fills the binary column and ``media_features`` reads it back; the query writes the column to
a table between the two. Everything happens inside one row, so there is no exchange; rows flow through
in Arrow batches.

Cases. Null or empty text: the payload is 576 bytes of 255. Repeated rows give equal values. Long texts are
one tall image. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import documents, written

# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY = 0
FILTER_NONE, FILTER_SUB, FILTER_UP, FILTER_AVERAGE, FILTER_PAETH = range(5)

#: Payloads are multiples of ``UNIT`` bytes; the least is a square image.
UNIT, WIDTH = 576, 24
PAD = b"\xff"
LEVEL = 6


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def filtered(samples: np.ndarray) -> np.ndarray:
    """Rows (height, 1 + width): the kind of filter, then none, Sub or Up, whichever leaves the smallest sum of differences."""
    left, above = np.zeros_like(samples), np.zeros_like(samples)
    left[:, 1:], above[1:] = samples[:, :-1], samples[:-1]
    choices = samples, samples - left, samples - above  # modulo 256, as the format has it
    cost = np.stack([np.abs(c.view(np.int8).astype(np.int16)).sum(axis=1) for c in choices])
    kind = np.argmin(cost, axis=0)  # in the order of FILTER_NONE, FILTER_SUB, FILTER_UP
    return np.hstack([kind.astype(np.uint8)[:, None], np.choose(kind[:, None], choices)])


def encode_png(samples: np.ndarray, level: int = LEVEL) -> bytes:
    """8-bit grey samples (height, width)."""
    height, width = samples.shape
    head = struct.pack(">IIBBBBB", width, height, 8, GREY, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered(samples).tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and data of each chunk, its checksum tested."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("cut off")
        (n,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if len(data) < n or png[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(data, zlib.crc32(kind))):
            raise ValueError(f"checksum of {kind!r}")
        yield kind, data
        if kind == b"IEND":
            return
        at += 12 + n
    raise ValueError("no end")


def _predicted(out: np.ndarray, kinds: np.ndarray, above: np.ndarray) -> None:
    """Take back rows of the kinds Average and Paeth, in place: a pixel needs its left, upper and corner ones, so all of one diagonal go at once."""
    height, width = out.shape
    padded = np.zeros((height + 1, width + 1), np.int16)
    padded[0, 1:] = above
    average = (kinds == FILTER_AVERAGE).astype(bool)
    for s in range(height + width - 1):
        y = np.arange(max(0, s - width + 1), min(height, s + 1))
        x = s - y
        left, up, corner = padded[y + 1, x], padded[y, x + 1], padded[y, x]
        guess = left + up - corner
        near = np.stack([np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)])
        paeth = np.choose(np.argmin(near, axis=0), (left, up, corner))  # the first of the nearest
        padded[y + 1, x + 1] = (out[y, x] + np.where(average[y], (left + up) // 2, paeth)) & 255
    out[:] = padded[1:, 1:]


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Samples of filtered rows (height, 1 + width) with one byte a pixel."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if len(kinds) and kinds.max() > FILTER_PAETH:
        raise ValueError(f"filter {kinds.max()}")
    group = np.minimum(kinds, FILTER_AVERAGE)  # Average and Paeth are taken back together
    starts = np.nonzero(np.concatenate([[True], group[1:] != group[:-1]]))[0].tolist() if len(kinds) else []
    for s, e in zip(starts, [*starts[1:], len(kinds)], strict=True):
        part, above = out[s:e], out[s - 1] if s else np.zeros(out.shape[1], np.uint8)
        if group[s] == FILTER_SUB:
            np.cumsum(part, axis=1, dtype=np.uint8, out=part)
        elif group[s] == FILTER_UP:
            part[0] += above
            np.cumsum(part, axis=0, dtype=np.uint8, out=part)
        elif group[s] == FILTER_AVERAGE:
            _predicted(part, kinds[s:e], above)
    return out


def decode_png(png: bytes) -> np.ndarray:
    found: dict[bytes, list[bytes]] = {}
    for kind, data in chunks(png):
        found.setdefault(kind, []).append(data)
    width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", found[b"IHDR"][0])
    if (depth, colour, *rest) != (8, GREY, 0, 0, 0):
        raise ValueError("only 8-bit grey without interlace")
    raw = zlib.decompress(b"".join(found[b"IDAT"]))
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


@functools.lru_cache(maxsize=4)
def _averaging(n: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edges = np.arange(to + 1) * n / to
    low = np.minimum(edges.astype(np.int64), n - 1)
    return edges, low, edges - low


def _averaged(x: np.ndarray, to: int) -> np.ndarray:
    """``x`` (n, m) averaged over ``to`` equal stretches of the first axis, with fractions of rows."""
    edges, low, part = _averaging(len(x), to)
    total = np.vstack([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=np.float64)])
    at = total[low] + part[:, None] * x[low]
    return np.diff(at, axis=0) / np.diff(edges)[:, None]


@functools.lru_cache(maxsize=4)
def _cosines(n: int, keep: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * np.arange(keep)[:, None] / (2 * n))


def cosine_hash(samples: np.ndarray, side: int = 24, keep: int = 8) -> str:
    """Hash in hexadecimal: which of the ``keep`` x ``keep`` lowest frequencies lie above their median."""
    small = _averaged(_averaged(samples, side).T, side).T
    low = np.round(_cosines(side, keep) @ small @ _cosines(side, keep).T, 6)
    return np.packbits((low > np.median(low)).ravel()).tobytes().hex()


def payload(text: bytes, unit: int = UNIT) -> bytes:
    return text + PAD * (max(unit, -(-len(text) // unit) * unit) - len(text))


def to_media(text: bytes) -> bytes:
    return encode_png(np.frombuffer(payload(text), np.uint8).reshape(-1, WIDTH))


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) of every row: ``media`` is a binary column of PNGs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            texts = x["text"]
            media = pa.array((to_media(t.as_py()) for t in texts), pa.binary())
            yield pa.record_batch([x["id"], pc.binary_length(texts).cast(pa.int64()), media], names=["id", "n_bytes", "media"])

    text = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    return docs.select(docs[id_col].alias("id"), text.alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")


def media_features(stored: DataFrame) -> DataFrame:
    """(id, n_bytes) with what reading the binary column ``media`` back gives, and the hash of the image."""
    kind = stored.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [f.split()[0] for f in READ.split(", ")]
        for x in batches:
            out: list[list] = [[] for _ in kinds]
            for png in x["media"]:
                data = png.as_py()
                samples = decode_png(data)
                back = samples.tobytes()
                values = len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield pa.record_batch([x["id"], x["n_bytes"], *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["id", "n_bytes", *names])

    return stored.select("id", "n_bytes", "media").mapInArrow(run, f"id {kind}, n_bytes long, {READ}")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(written(stored_media(documents(spark, sf_dir)), "media")).withColumnRenamed("id", "doc_id")
