"""Remove passages of ``window`` or more words that occur more than once.

Fixed-block anchors: every document is cut into blocks of (window + 1) // 2 words,
and their hashes are indexed. Any window of the given length holds a whole block
of its own document, so wherever its words occur again, a rolling window of the
block's length hits that block. All rolling windows probe the index. Hits are then
extended: each window around a hit is counted over the corpus, and those that
occur twice are, joined, the maximal exact repeats.

Documents are packed once into chunk files in the shared folder. What is shuffled
are the distinct hashes of a chunk, dealt by hash to parts (four bytes an entry for
probes, eight for windows); the chunks get back which of them hit. A passage that
most documents hold costs one entry per chunk and part, not one per document, and no pairs are formed.
Two windows are held equal if 64 bits of their hash are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.chunks import WORD_HASHES, among, by_part, groups_of, load_chunk, save_chunks
from foliomill.llm.common import slices, words_of

WINDOW = 35
PART_WORDS = 8 << 20  # words whose hashes one task of the index may hold


_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            _POWERS[k] = np.multiply.accumulate(powers)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """The hashes of the words of some documents, end to end, and of their windows. Words
    themselves are not kept: they take ten times the memory of their text."""

    def __init__(self, texts: list[str | None], shortest: int) -> None:
        sizes, parts, self.used = [], [np.zeros(0, np.uint64)], []
        for i, text in enumerate(texts):
            words = words_of(text)
            sizes.append(len(words))
            if len(words) >= shortest:
                self.used.append(i)
                parts.append(np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words)))
        self.sizes = np.array(sizes, np.int64)
        lengths = self.sizes[self.used]
        total = int(lengths.sum())
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        hashes = np.concatenate(parts)
        power, self._inverse = _powers(total + 1)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:total], dtype=np.uint64)])
        self._end_of = np.repeat(self.ends, lengths)
        self._start_of = np.repeat(self.starts, lengths)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows that stay in their document start, and their hashes."""
        at = np.flatnonzero(np.arange(len(self._end_of)) + length <= self._end_of)
        return at, _mixed((self._sums[at + length] - self._sums[at]) * self._inverse[at])

    def place(self, at: np.ndarray) -> np.ndarray:
        """Positions within the document."""
        return at - self._start_of[at]


def _once_and_again(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, counts = np.unique(hashes, return_counts=True)
    return values[counts == 1], values[counts > 1]


SENT = "part int, chunk string, kind int, hashes binary"
INDEXED, ONCE, AGAIN, FOUND, ALL = range(5)


def _rows(rows: list[tuple[int, str, int, np.ndarray]]) -> pa.RecordBatch:
    part, chunk, kind, hashes = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(chunk, pa.string()), pa.array(kind, pa.int32()), pa.array([h.tobytes() for h in hashes], pa.binary())],
        ["part", "chunk", "kind", "hashes"],
    )


def _exchange(sent: DataFrame, wide: bool) -> DataFrame:
    """Bring equal hashes of all chunks together and tell each chunk which of its own are repeated.
    Narrow hashes are 32 bits beside their part and must be in the index too."""
    dtype = "<u8" if wide else "<u4"

    def meet(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        rows = [
            (c, k, np.frombuffer(h, dtype))
            for c, k, h in zip(table["chunk"].to_pylist(), table["kind"].to_pylist(), table["hashes"].to_pylist(), strict=True)
        ]
        own = [h for _, k, h in rows if k in (ONCE, AGAIN)]
        values, counts = np.unique(np.concatenate([np.zeros(0, dtype), *own]), return_counts=True)
        again = np.unique(np.concatenate([np.zeros(0, dtype), values[counts > 1], *(h for _, k, h in rows if k == AGAIN)]))
        if not wide:
            again = np.intersect1d(again, np.concatenate([np.zeros(0, dtype), *(h for _, k, h in rows if k == INDEXED)]))
        out = []
        for chunk, kind, hashes in rows:
            if kind in (ONCE, AGAIN):
                found = hashes[among(hashes, again)]
                if len(found):
                    out.append((part, chunk, FOUND, found))
        return pa.Table.from_batches([_rows(out)])

    return sent.groupBy("part").applyInArrow(meet, SENT)


def _found(table: pa.Table, dtype: str) -> dict[int, np.ndarray]:
    out: dict[int, list[np.ndarray]] = {}
    for p, k, h in zip(table["part"].to_pylist(), table["kind"].to_pylist(), table["hashes"].to_pylist(), strict=True):
        if k == FOUND:
            out.setdefault(p, []).append(np.frombuffer(h, dtype))
    return {p: np.sort(np.concatenate(h)) for p, h in out.items()}


def _member(hashes: np.ndarray, found: dict[int, np.ndarray], parts: int, dtype: str) -> np.ndarray:
    """Which of the hashes were found, by part."""
    part = ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    key = hashes.astype(dtype)
    out, order = np.zeros(len(hashes), bool), np.argsort(part, kind="stable")
    numbers, groups = groups_of(part[order], order)
    for p, rows in zip(numbers.tolist(), groups, strict=True):
        if p in found:
            out[rows] = among(key[rows], found[p])
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs``: the given columns, n_words, n_removed and ``kept``, the words left.

    ``kept`` is the text as it was where nothing is removed, else the words joined by one
    space. A word goes if a window that covers it starts anywhere else too, in the same
    document or another; all windows are judged on the input. Null and empty texts have no
    words and come back as they are. Repeated rows are each other's repeats. Extra columns
    are not read unless asked for. Columns named like those of the result are refused.
    """
    clash = set(columns) & {"text", "n_words", "n_removed", "kept"}
    if clash:
        raise ValueError(f"columns with names of the result: {sorted(clash)}")
    block = (window + 1) // 2
    narrow = docs.select(*columns, F.col("text").cast("string").alias("text"))
    chunks = save_chunks(narrow)
    spark = docs.sparkSession
    total = chunks.agg(F.sum("n_words"), F.count("*")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total[0] or 0) // PART_WORDS))
    spread = chunks.select("chunk").repartition(max(1, min(total[1], 100_000)), "chunk")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["chunk"].to_pylist():
                chunk = Chunk(load_chunk(path)["text"].to_pylist(), window)
                at, hashes = chunk.windows(block)
                out = []
                for p, own in by_part(hashes[chunk.place(at) % block == 0], parts):
                    out.append((p, path, INDEXED, np.unique(own.astype("<u4"))))
                for p, own in by_part(hashes, parts):
                    once, again = _once_and_again(own.astype("<u4"))
                    out += [(p, path, ONCE, once), (p, path, AGAIN, again)]
                yield _rows([r for r in out if len(r[3])])

    hits = _exchange(spread.mapInArrow(probe, SENT), wide=False)

    def extend(table: pa.Table) -> pa.Table:
        path = table["chunk"][0].as_py()
        chunk = Chunk(load_chunk(path)["text"].to_pylist(), window)
        at, hashes = chunk.windows(block)
        hit = np.zeros(len(chunk._end_of) + 1, np.int64)
        hit[at[_member(hashes, _found(table, "<u4"), parts, "<u4")]] = 1
        before = np.concatenate([[0], np.cumsum(hit)])
        starts, whole = chunk.windows(window)
        near = before[starts + window - block + 1] > before[starts]  # a hit lies inside the window
        out = []
        for p, own in by_part(whole[near], parts):
            once, again = _once_and_again(own)
            out += [(p, path, ONCE, once), (p, path, AGAIN, again)]
        return pa.Table.from_batches([_rows([r for r in out if len(r[3])])])

    repeated = _exchange(hits.groupBy("chunk").applyInArrow(extend, SENT), wide=True)
    every = chunks.select(F.lit(0).alias("part"), "chunk", F.lit(ALL).alias("kind"), F.lit(None).cast("binary").alias("hashes"))

    def finish(table: pa.Table) -> pa.Table:
        rows = load_chunk(table["chunk"][0].as_py())
        texts = rows["text"].to_pylist()
        chunk = Chunk(texts, window)
        starts, whole = chunk.windows(window)
        gone = np.zeros(len(chunk._end_of) + 1, np.int64)
        found = starts[_member(whole, _found(table, "<u8"), parts, "<u8")]
        np.add.at(gone, found, 1)
        np.add.at(gone, found + window, -1)
        keep = np.cumsum(gone)[:-1] == 0
        removed = np.zeros(len(texts), np.int64)
        for i, a, b in zip(chunk.used, chunk.starts.tolist(), chunk.ends.tolist(), strict=True):
            left = keep[a:b]
            if not left.all():
                removed[i] = int((~left).sum())
                texts[i] = b" ".join([w for w, k in zip(words_of(texts[i]), left.tolist(), strict=True) if k]).decode()
        out = rows.drop_columns(["text"])
        for name, values in (("n_words", pa.array(chunk.sizes)), ("n_removed", pa.array(removed)), ("kept", pa.array(texts, pa.string()))):
            out = out.append_column(name, values)
        return out

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields if f.name != "text"]
    schema = ", ".join([*fields, "n_words long, n_removed long, kept string"])
    return repeated.unionByName(every).groupBy("chunk").applyInArrow(finish, schema)


def digests(kept: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "kept"):
                hashed = [hashlib.sha256(b" ".join(words_of(t))).hexdigest() for t in rows["kept"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], rows["n_words"], rows["n_removed"], pa.array(hashed, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    return kept.select("doc_id", "n_words", "n_removed", "kept").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )


SQL = r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), windows AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM texts)
), repeated AS (
  SELECT r, i FROM windows SEMI JOIN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1) USING (h)
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM repeated
), removed AS (
  SELECT r, count(*) AS n FROM gone GROUP BY r
), words AS (
  SELECT r, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM texts
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
"""
