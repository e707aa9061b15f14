"""Texts packed into chunk files in the shared folder, and the hashes of their words.

Operators that need the texts more than once read the chunk files again by path
inside their tasks, so that whole texts never cross a shuffle; what is shuffled are
hashes, dealt to parts, and answers per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from foliomill.llm.common import load_file, new_folder, save_file, slices
from foliomill.session import written

CHUNK_BYTES = 3 << 20


def save_chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Pack rows into files of about ``chunk_bytes`` of text; a row per file with its path and words."""
    folder = new_folder(docs.sparkSession, "chunks")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for batch in pa.Table.from_batches(held).combine_chunks().to_batches():
                    out.write_batch(batch)
            words = sum(t.count(" ") + 1 for b in held for t in b["text"].to_pylist() if t)  # near enough for sizes
            path = save_file(folder, "chunk", ".arrows", sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_pydict({"chunk": [path], "n_words": [words]})

        for batch in batches:
            for rows in slices(batch, "text", chunk_bytes // 4):
                held.append(rows)
                size += rows["text"].nbytes
                if size >= chunk_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return written(docs.mapInArrow(save, "chunk string, n_words long"), "chunk-list")


def load_chunk(path: str) -> pa.Table:
    return pa.ipc.open_stream(load_file(path)).read_all()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


WORD_HASHES = _Hashes()


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the values are in ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def by_part(hashes: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    part = ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    for p, own in zip(*groups_of(part[order], hashes[order]), strict=True):
        yield int(p), own


def groups_of(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.split(values, first[1:]) if len(first) else []
