"""Token-id files of directly addressable codes.

An id is cut into chunks of ``bits`` bits, lowest first. Level 0 holds the first
chunk of every token and a bitmap that says which tokens go on; level 1 holds the
next chunk of those, and so on. A rank directory (ones before every 512 bits)
finds a token's place in the next level with one lookup and a popcount, so any
token is read without decoding what stands before it.

File, all little-endian: ``MAGIC``, then as u64 the number of tokens, documents,
levels and bits; for each document its id (i64), a flag for a missing id (u8) and
the end of its tokens (u64); then for each level the number of entries (u64), the
chunks (u8), the bitmap (padded to 64 bytes) and its directory (u64).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm.common import load_file, new_folder, save_file, slices
from foliomill.llm.tokens import SegmentEncoder
from foliomill.session import written

#: Fixed value: the first bytes of a file.
MAGIC = b"FMTOKDA1"
BLOCK = 512


def _bitmap(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits in blocks of 512, and the ones before each block."""
    bits = np.packbits(flags, bitorder="little")
    bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
    ones = np.bitwise_count(bits.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint64)
    return bits, np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)])[:-1]


def encode_file(doc_ids: list[int | None], documents: list[np.ndarray], bits: int = 8) -> bytes:
    ids = np.concatenate([np.zeros(0, np.uint32), *documents]).astype(np.uint32)
    ends = np.cumsum([len(d) for d in documents], dtype=np.uint64)
    levels, rest = [], ids
    while True:
        chunk, rest = (rest & ((1 << bits) - 1)).astype(np.uint8), rest >> bits
        more = rest > 0
        levels.append((chunk, *_bitmap(more)))
        rest = rest[more]
        if not len(rest):
            break
    out = [MAGIC, struct.pack("<4Q", len(ids), len(documents), len(levels), bits)]
    out.append(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    out.append(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    out.append(ends.astype("<u8").tobytes())
    for chunk, bitmap, directory in levels:
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes(), bitmap.tobytes(), directory.astype("<u8").tobytes()]
    return b"".join(out)


class TokenFile:
    """Random access to the content of a file; nothing is decoded in advance."""

    def __init__(self, content: bytes) -> None:
        if content[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n_tokens, n_docs, n_levels, self.bits = struct.unpack_from("<4Q", content, 8)
        at = 40

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            values = np.frombuffer(content, dtype, count, at)
            at += values.nbytes
            return values

        ids, missing = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if m else int(d) for d, m in zip(ids, missing, strict=True)]
        self.ends = take("<u8", n_docs).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            (count,) = take("<u8", 1)
            blocks = -(-int(count) // BLOCK)
            self.levels.append((take("u1", int(count)), take("u1", blocks * BLOCK // 8), take("<u8", blocks)))

    def tokens(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, in any order."""
        out = np.zeros(len(places), np.uint32)
        where, place = np.arange(len(places)), np.asarray(places, np.int64)
        for level, (chunk, bitmap, directory) in enumerate(self.levels):
            out[where] |= chunk[place].astype(np.uint32) << np.uint32(self.bits * level)
            on = (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            where, place = where[on], place[on]
            if not len(place):
                break
            # ones before the block, in the whole words before the place, and in its own word
            words, block = bitmap.view("<u8"), place >> 9
            low = int(block.min())
            counts = np.bitwise_count(words[low * 8 : int(block.max() + 1) * 8]).astype(np.int64)
            before = np.cumsum(counts) - counts
            inside = before[(place >> 6) - low * 8] - before[(block - low) << 3]
            mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            place = directory[block].astype(np.int64) + inside + np.bitwise_count(words[place >> 6] & mask)
        return out

    def token(self, place: int) -> int:
        """One id, by its chunk on each level."""
        value = 0
        for level, (chunk, bitmap, directory) in enumerate(self.levels):
            value |= int(chunk[place]) << (self.bits * level)
            if not bitmap[place >> 3] >> (place & 7) & 1:
                break
            block = place >> 9
            head = np.unpackbits(bitmap[block * 64 : (place >> 3) + 1], bitorder="little")[: place - block * BLOCK]
            place = int(directory[block]) + int(head.sum())
        return value

    def document(self, number: int) -> np.ndarray:
        start = int(self.ends[number - 1]) if number else 0
        return self.tokens(np.arange(start, int(self.ends[number])))


FILES = "part int, seq int, path string, n_docs long, n_tokens long"


def write_token_files(
    docs: DataFrame, encoder: Callable[[], SegmentEncoder], end_id: int, partitions: int, file_tokens: int = 4 << 20
) -> DataFrame:
    """Write ``docs`` (doc_id, text) in ascending doc_id to files; a row per file.

    Rows are dealt by ranges of doc_id, a null id first and repeated ids by the hash
    of their text, so one id can't fill a task. A task holds one file's tokens.
    A null text is an empty one: just the end id. No rows: no files.
    """
    folder = new_folder(docs.sparkSession, "token-files")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange(partitions, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder().encode, TaskContext.get().partitionId()
        doc_ids, tokens, held, seq = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            path = save_file(folder, f"ids-{part:06d}-{seq:05d}", ".dac", encode_file(doc_ids, tokens))
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [path], "n_docs": [len(doc_ids)], "n_tokens": [held]}
            )

        for batch in batches:
            for rows in slices(batch, "text"):
                for doc_id, text in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), strict=True):
                    ids = np.frombuffer(encode(text), "<u2")
                    doc_ids.append(doc_id)
                    tokens.append(np.append(ids, np.uint16(end_id)))
                    held += len(ids) + 1
                    if held >= file_tokens:
                        yield flush()
                        doc_ids, tokens, held, seq = [], [], 0, seq + 1
        if doc_ids:
            yield flush()

    return written(ordered.mapInArrow(save, FILES), "token-file-list")


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document its place among all ids (``start``), its count and the CRC-32 of its ids,
    read back from the files. ``files`` has a row per file, so summing up their tokens is small."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist(), strict=True):
                content = TokenFile(load_file(path))
                starts = np.concatenate([[0], content.ends[:-1]])
                crcs, first = [], 0
                while first < len(starts):  # a few documents at a time
                    last = max(first + 1, int(np.searchsorted(content.ends, starts[first] + (1 << 20))))
                    ids = content.tokens(np.arange(starts[first], content.ends[last - 1])).astype("<u4")
                    cuts = (content.ends[first : last - 1] - starts[first]).astype(int)
                    crcs += [zlib.crc32(x.tobytes()) for x in np.split(ids, cuts)]
                    first = last
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(content.doc_ids, pa.int64()),
                        "start": pa.array(starts + base, pa.int64()),
                        "n_tokens": pa.array(content.ends - starts, pa.int64()),
                        "ids_crc32": pa.array(crcs, pa.int64()),
                    }
                )

    spread = placed.repartition(max(1, files.count()), "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
