"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from foliomill.session import load_file, new_folder, save_file  # noqa: F401  operators take them from here

#: Fixed value: words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8: ``bytes.split`` cuts at just the six characters of WORD."""
    return text.encode().split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """The words with A-Z in lower case and all else unchanged."""
    return text.encode().translate(_LOWER).split() if text else []


def slices(batch: pa.RecordBatch, column: str, budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose text takes about ``budget`` bytes, so that
    what a task unpacks at a time is bounded (by one text at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held + size > budget and i > start:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size + 64
    if start < len(sizes):
        yield batch.slice(start)


def pack_arrays(**arrays: np.ndarray | list) -> bytes:
    """Arrays and lists of numbers (which may hold None) as one compressed stream."""
    columns = {k: pa.array([v], pa.list_(pa.int64())) if isinstance(v, list) else pa.array([v.tobytes()], pa.large_binary()) for k, v in arrays.items()}
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def load_arrays(path: str, **types: str) -> dict:
    """The named arrays of a file that :func:`pack_arrays` made, by type; ``list`` gives a list."""
    row = pa.ipc.open_stream(load_file(path)).read_all()
    return {k: row[k][0].as_py() if t == "list" else np.frombuffer(row[k][0].as_buffer(), t) for k, t in types.items()}
