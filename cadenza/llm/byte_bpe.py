"""Byte-level BPE through sentencepiece: the rank file becomes a BPE model of byte-mapped pieces.

Every rank's bytes are written as one character per byte (printable ones as themselves, the rest above U+0100) and
become a piece whose score is the negative rank, so that the highest score is the lowest rank. The model has the
identity normalisation and adds no prefix. The text's pre-tokens are encoded one by one and ids are decoded by the
inverse mapping.

A null text counts as empty. Each row gives one row; ids play no part, and other columns are ignored. A bounded
table of pre-tokens that were encoded before saves most of the work; it is emptied when full.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_characters() -> list[str]:
    """A printable character for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The bytes of each rank, from 0."""
    with open(path, "rb") as lines:
        ranks = {int(n): base64.b64decode(token) for token, n in map(bytes.split, filter(bytes.strip, lines))}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = b""
    while True:
        n, low = n >> 7, n & 127
        if not n:
            return out + bytes([low])
        out += bytes([low | 128])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes, a whole number or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model; ids are ranks, with one unknown piece after them."""
    chars = byte_characters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, -float(rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    off = (1 << 64) - 1  # -1: no such piece
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + _field(41, off) + _field(42, off) + _field(43, off)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


class Codec:
    """Encodes texts to ids (little-endian unsigned 32-bit) and back."""

    def __init__(self, path: str, pattern: str, most: int = 300_000) -> None:
        import regex
        from sentencepiece import SentencePieceProcessor

        self.tokens = read_ranks(path)
        self.pieces = SentencePieceProcessor(model_proto=model(self.tokens))
        self.find = regex.compile(pattern).findall
        self.chars = dict(enumerate(byte_characters()))
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(self.tokens)}
        self.known: dict[str, bytes] = {}
        self.units: dict[str, bytes | None] = {}
        self.most = most

    def pre_token(self, token: str) -> bytes:
        found = self.known.get(token)
        if found is None:
            raw = token.encode()
            found = self.whole.get(raw)
            if found is None:
                ids = self.pieces.encode(raw.decode("latin-1").translate(self.chars))
                found = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[token] = found
        return found

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.pre_token, self.find(text)))

    def encode(self, text: str) -> bytes:
        """Ids of ``text``.

        Between a character and a single space before another character a pre-token always ends, so what lies
        between such places is encoded on its own and remembered.
        """
        head, *rest = text.split(" ")
        if not rest:
            return self.plain(text)
        if not head or head[-1].isspace():
            return self.plain(text)
        out = [self.plain(head)]
        get = self.units.get
        for part in rest:
            ids = get(part)
            if ids is None:
                if not part or part[0].isspace() or part[-1].isspace():
                    return self._mixed(text)
                if len(self.units) >= self.most:
                    self.units.clear()
                ids = self.units[part] = self.plain(" " + part)
            out.append(ids)
        return b"".join(out)

    def _mixed(self, text: str) -> bytes:
        """For texts with white space beside single spaces: such parts stay with their neighbours."""
        out, held = [], ""
        for i, part in enumerate(text.split(" ")):
            if i and held and part and not held[-1].isspace() and not part[0].isspace():
                out.append(self.plain(held))
                held = " " + part
            else:
                held = held + " " + part if i else part
        return b"".join([*out, self.plain(held)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: number of ids and SHA-256 of the ids and of the bytes decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in sliced(batches):
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text) if text else b""
                n.append(len(ids) // 4)
                ids_sha.append(sha(ids))
                text_sha.append(sha(codec.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
