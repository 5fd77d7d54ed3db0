"""Operator 5, SentencePiece encoding and decoding.

The model file is read directly (a protocol buffer of pieces with scores). An Aho-Corasick
automaton over the pieces runs once over the text; at each position its output links name every
piece that ends there, and each relaxes the best score of that position from the position where it
begins. Back-pointers give the segmentation with the highest total score. A letter that no piece
covers costs the unknown score and is written as its bytes (byte pieces), as the format prescribes.

Pieces never hold a gap mark or a line break behind another letter (checked on loading), so each is
a place where the best segmentation must break; stretches between are solved once and remembered.

The automaton gives the segmentation of the unigram kind of model. The public model file on the box is of the merge kind; its
scores are merge ranks, and the highest-scoring segmentation under them is what this operator returns,
equal to the library's own answer when the same file is declared unigram. See the README.

Cases. Null and empty texts: no ids, decoded to empty. Repeated rows give equal values. Long texts are encoded whole. A gap
mark (U+2581) in the text decodes to a space, the one thing the format cannot restore.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import documents

# Fixed values of the model format: kinds of pieces, the gap mark, and what an unknown letter costs below the least score.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
GAP = "▁"
UNKNOWN_PENALTY = 10.0

MEMORY, LONGEST = 300_000, 64


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        n = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, data[at : at + n]
        at += n


def read_model(path: str) -> tuple[list[tuple[str, float, int]], bool]:
    """Pieces (text, score, kind) by id, and whether a gap mark is put before each text."""
    pieces, prefix = [], True
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own[1].decode("utf-8"), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
        elif number == 3:
            prefix = bool(dict(_fields(value)).get(3, 1))
    return pieces, prefix


class Codec:
    def __init__(self, path: str) -> None:
        self.pieces, self.prefix = read_model(path)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_STRING)
        usable = [(p, s, i) for i, (p, s, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)]
        for piece, score, i in usable:
            if re.search(f"[^{GAP}]{GAP}|\n.|.\n", piece, re.S):
                raise ValueError(f"piece {piece!r} spans a break")
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.stretches = re.compile(f"\n|{GAP}+[^{GAP}\n]*|[^{GAP}\n]+").findall
        self.singles = {p for p, _, _ in usable if len(p) == 1}
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.unknown_score = min((s for _, s, _ in usable), default=0.0) - UNKNOWN_PENALTY
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.known: dict[str, tuple[bytes, float]] = {}
        self.before: dict[str, tuple[bytes, float]] = {}

    def viterbi(self, text: str) -> tuple[list[int], float]:
        """Ids and score of the best segmentation of one stretch; of equal scores the one whose last piece is longest."""
        n = len(text)
        if self.singles.issuperset(text):  # every letter is a piece, so nothing is unknown
            best, back = [0.0] + [float("-inf")] * n, [None] * (n + 1)
            for end, (length, score, piece) in self.automaton.iter(text):
                end += 1
                through = best[end - length] + score
                if through > best[end]:
                    best[end], back[end] = through, (length, piece)
            out, at = [], n
            while at:
                length, piece = back[at]
                out.append(piece)
                at -= length
            return out[::-1], best[n]
        best, back = [0.0] + [None] * n, [None] * (n + 1)
        done = 0  # positions up to here are final

        def cover(upto: int) -> None:
            nonlocal done
            while done < upto:
                done += 1
                through = best[done - 1] + self.unknown_score
                if not single[done] and (best[done] is None or through > best[done]):
                    best[done], back[done] = through, (done - 1, None)

        single = [False] * (n + 1)
        for end, (length, score, piece) in self.automaton.iter(text):
            end += 1
            cover(end - 1)
            through = best[end - length] + score
            if length == 1:
                single[end] = True
            if best[end] is None or through > best[end]:
                best[end], back[end] = through, (end - length, piece)
        cover(n)
        out, at = [], n
        while at:
            before, piece = back[at]
            if piece is None:
                letters = text[before:at].encode("utf-8")
                out.extend(self.bytes.get(b, self.unknown) for b in reversed(letters)) if self.bytes else out.append(self.unknown)
            else:
                out.append(piece)
            at = before
        return out[::-1], best[n]

    def encode_bytes(self, text: str) -> tuple[bytes, float]:
        """Ids as little-endian unsigned 32-bit bytes, and their score."""
        if not text:
            return b"", 0.0
        parts = self.stretches((GAP if self.prefix else "") + text.replace(" ", GAP))
        if len(self.known) > MEMORY:
            self.known, self.before = {}, self.known
        known, long = self.known, {}
        for p in set(parts).difference(known):
            got = self.before.get(p)
            if got is None:
                ids, score = self.viterbi(p)
                got = struct.pack(f"<{len(ids)}I", *ids), score
            (known if len(p) <= LONGEST else long)[p] = got
        found = [known[p] if p in known else long[p] for p in parts] if long else list(map(known.__getitem__, parts))
        return b"".join([g[0] for g in found]), sum([g[1] for g in found])

    def encode(self, text: str) -> list[int]:
        data = self.encode_bytes(text)[0]
        return list(struct.unpack(f"<{len(data) // 4}I", data))

    def decode(self, ids: list[int] | tuple[int, ...]) -> str:
        if not hasattr(self, "surfaces"):
            self.surfaces = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(GAP, " ").encode("utf-8") for p, _, kind in self.pieces]
        text = b"".join(map(self.surfaces.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(docs: DataFrame, model: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number, checksum and (on request) array of ids, their score, and digest of the text decoded from them."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for x in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in x["text"].to_pylist():
                data, score = own.encode_bytes(text or "")
                ids = struct.unpack(f"<{len(data) // 4}I", data)
                back = own.decode(ids)
                values = len(ids), zlib.crc32(data), score, back == (text or ""), hashlib.sha256(back.encode("utf-8")).hexdigest(), ids
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.string(), pa.list_(pa.int32())]
            n = 6 if with_ids else 5
            names = ["n_ids", "ids_crc32", "score", "restored", "decoded_sha256", "ids"]
            yield pa.record_batch([x["id"], *(pa.array(c, k) for c, k in zip(out[:n], kinds, strict=False))], names=["id", *names[:n]])

    fields = "n_ids long, ids_crc32 long, score double, restored boolean, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, {fields}")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return encoded(documents(spark, sf_dir), model or default_model(), with_ids=False).withColumnRenamed("id", "doc_id")
