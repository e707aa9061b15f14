"""Byte-level BPE through a sentencepiece model that is written from the vocabulary.

The model's pieces are the vocabulary's byte strings with each byte as a printable
character, in rank order (so a piece's id is its rank), scored by the negative
rank: sentencepiece merges the pair of the highest score first, the ranks say the
lowest rank first. Normalisation is the identity. Pre-tokens that are a piece are
taken whole, as in the ranks' own library; the others go through the model.
Decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import slices
from foliomill.llm.tokens import BYTE_CHARACTERS, SegmentEncoder, byte_mapped


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file (base64, rank), by rank."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _message(field: int, content: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(content)) + content


def model_bytes(pieces: list[bytes]) -> bytes:
    """The serialised model. The field numbers and enumerations of the public
    model format (pieces 1, trainer 2, normaliser 3; BPE is type 2, an unknown piece 2)."""
    out = bytearray()
    for rank, piece in enumerate(pieces):
        text = "".join(BYTE_CHARACTERS[b] for b in piece).encode()
        out += _message(1, _message(1, text) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, 1))
    out += _message(1, _message(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(pieces) + 1) + _number(40, len(pieces))
    trainer += b"".join(_number(f, -1) for f in (41, 42, 43))  # no begin, end or padding
    out += _message(2, trainer)
    out += _message(3, _message(1, b"identity") + b"".join(_number(f, 0) for f in (3, 4, 5)))
    return bytes(out)


_LOADED: dict[tuple[str, str], tuple[SegmentEncoder, list[bytes]]] = {}


def sp_encoder(path: str, pattern: str) -> tuple[SegmentEncoder, list[bytes]]:
    """Encoder and byte strings by id, kept by the worker between tasks."""
    if (path, pattern) not in _LOADED:
        import regex
        import sentencepiece

        pieces = read_ranks(path)
        model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(pieces))
        known = {p: i for i, p in enumerate(pieces)}
        cut = regex.compile(pattern).findall

        def merge(token: str) -> list[int]:
            rank = known.get(token.encode())
            return [rank] if rank is not None else model.encode(byte_mapped(token))

        def whole(text: str) -> list[int]:
            return [i for token in cut(text) for i in merge(token)]

        _LOADED[path, pattern] = SegmentEncoder(cut, merge, whole), pieces
    return _LOADED[path, pattern]


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and
    decoded_sha256 (the bytes decoded from the ids). A null or empty text has no ids.
    No shuffle: each row is on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces = sp_encoder(path, pattern)
        decimal = [b"%d" % i for i in range(len(pieces))]
        for batch in batches:
            for rows in slices(batch, "text"):
                counts, hashed, decoded = [], [], []
                for text in rows["text"].to_pylist():
                    ids = np.frombuffer(encoder.encode(text), "<u2").tolist()
                    counts.append(len(ids))
                    hashed.append(hashlib.sha256(b",".join(map(decimal.__getitem__, ids))).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(map(pieces.__getitem__, ids))).hexdigest())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": rows["doc_id"],
                        "n_tokens": pa.array(counts, pa.int64()),
                        "ids_sha256": pa.array(hashed, pa.string()),
                        "decoded_sha256": pa.array(decoded, pa.string()),
                    }
                )

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return columns.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
