"""Align the tokens of two tokenizers in every document and weigh the links by their counts.

Both tokenisations of a text spell the same bytes, so they are compared by the byte
offsets where their tokens end. The shorter list of ends drives a galloping search of
the longer: from where the last search stopped, steps double until they are past the wanted
end, then a binary search finds it. The driving list moves in short runs, so that the
binary searches of a run are one call. Offsets that both lists hold are common ends; their ranks
cut either list into groups, and the differences of ranks are the ranges of
tokens that overlap. A link is a pair of tokens that end together.

Counts of linked ids are summed over the corpus: a chunk of documents sends its
distinct pairs with their numbers, sums are combined by pair, and the sums of its
pairs come back to each chunk. What a document's links are stays in the chunk's file in
the shared folder. Neither texts nor single links are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm.common import load_arrays, new_folder, pack_arrays, save_file, slices
from foliomill.llm.tokens import byte_level_encoder, token_bytes
from foliomill.session import written

RUN = 256  # driving ends that are looked up together
CHUNKS = "chunk long, path string, pairs array<int>, n array<int>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@dataclass(frozen=True)
class Side:
    """One tokenizer: ids of a text, and the bytes of each id."""

    encode: Callable[[str], np.ndarray]
    tokens: list[bytes]


def gallop(driving: np.ndarray, searched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in both sorted lists of the values they share."""
    mine, theirs, low = [], [], 0
    for start in range(0, len(driving), RUN):
        run = driving[start : start + RUN]
        last, step = run[-1], 1
        while low + step < len(searched) and searched[low + step] < last:
            step *= 2
        window = searched[low : low + step + 1]
        at = np.searchsorted(window, run)
        hit = np.flatnonzero(window[np.minimum(at, len(window) - 1)] == run) if len(window) else np.zeros(0, np.int64)
        mine.append(hit + start)
        theirs.append(at[hit] + low)
        low += int(at[-1])
        if low >= len(searched):
            break
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *mine]), np.concatenate([none, *theirs])


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in ``a`` and in ``b`` of the ends they share; the shorter list drives."""
    if len(a) <= len(b):
        return gallop(a, b)
    in_b, in_a = gallop(b, a)
    return in_a, in_b


@dataclass(frozen=True)
class Aligned:
    """The alignment of a run of texts. Groups and links are numbered through; ``first_*`` cut them by text."""

    a: np.ndarray
    b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    first_group: np.ndarray
    group_a: np.ndarray  # rank of each group's last token
    group_b: np.ndarray

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of a and of b in each group: differences of the ranks of common ends."""
        return np.diff(self.group_a, prepend=-1), np.diff(self.group_b, prepend=-1)

    def spelled(self) -> list[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``; nothing without tokens."""
        size_a, size_b = self.ranges()
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        after = np.full(len(ids), ord(","), np.uint8)
        place_a = np.arange(len(self.a)) + np.repeat(self.group_b + 1 - size_b, size_a)
        place_b = np.arange(len(self.b)) + np.repeat(self.group_a + 1, size_b)
        ids[place_a], ids[place_b] = self.a, self.b
        after[place_a[self.group_a]] = ord("|")
        after[place_b[self.group_b]] = ord(";")
        digits = np.empty((len(ids), 6), np.uint8)
        kept = np.ones((len(ids), 6), bool)
        digits[:, :5], kept[:, :5] = _DIGITS[ids], _SHOWN[ids]
        digits[:, 5] = after
        ends = np.concatenate([[0], np.cumsum(kept.sum(axis=1))])
        cuts = ends[self.first_a + self.first_b].tolist()
        raw = digits[kept].tobytes()
        return [raw[lo : max(lo, hi - 1)] for lo, hi in zip(cuts, cuts[1:], strict=False)]


_NUMBERS = np.arange(1 << 16)
_DIGITS = (_NUMBERS[:, None] // 10 ** np.arange(4, -1, -1) % 10 + ord("0")).astype(np.uint8)
_SHOWN = (_NUMBERS[:, None] >= 10 ** np.arange(4, -1, -1)) | (np.arange(5) == 4)


def align(texts: list[str | None], a: Side, b: Side, prefix: str = " ") -> Aligned:
    """Texts that are null or empty, or whose tokens on either side don't spell the prefix and the text, have no tokens."""
    ids: tuple[list, list] = [], []
    for text in texts:
        found = [np.zeros(0, np.int64)] * 2
        if text:
            whole = (prefix + text).encode()
            both = [side.encode(text) for side in (a, b)]
            if all(b"".join(map(s.tokens.__getitem__, x.tolist())) == whole for s, x in zip((a, b), both, strict=True)):
                found = both
        for own, x in zip(ids, found, strict=True):
            own.append(x)
    first = [np.cumsum([0, *(len(x) for x in own)]) for own in ids]
    flat = [np.concatenate([np.zeros(0, np.int64), *own]).astype(np.int64) for own in ids]
    lengths = [np.fromiter(map(len, side.tokens), np.int64, len(side.tokens)) for side in (a, b)]
    in_a, in_b = common_ends(*(np.cumsum(n[x]) for n, x in zip(lengths, flat, strict=True)))
    return Aligned(flat[0], flat[1], first[0], first[1], np.searchsorted(in_a, first[0]), in_a, in_b)


def save_alignments(docs: DataFrame, sides: Callable[[], tuple[Side, Side]]) -> DataFrame:
    """Align the texts in chunks. A row per chunk has its distinct linked pairs of ids (b in the upper
    16 bits) with their numbers; its file holds the numbers of each document and its links as places in that list."""
    folder = new_folder(docs.sparkSession, "alignments")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        a, b = sides()
        for batch in batches:
            for rows in slices(batch, "text"):
                found = align(rows["text"].to_pylist(), a, b)
                pairs = (found.b[found.group_b] << 16 | found.a[found.group_a]).astype(np.int32)
                distinct, link, n = np.unique(pairs, return_inverse=True, return_counts=True)
                digests = b"".join(hashlib.sha256(s).digest() for s in found.spelled())
                content = pack_arrays(
                    doc_id=rows["doc_id"].to_pylist(),
                    first_a=found.first_a.astype("<i8"),
                    first_b=found.first_b.astype("<i8"),
                    first=found.first_group.astype("<i8"),
                    link=link.astype("<u4"),
                    digests=np.frombuffer(digests, np.uint8),
                )
                path = save_file(folder, "chunk", ".arrows", content)
                lists = [pa.array([x], pa.list_(pa.int32())) for x in (distinct, n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([path]), *lists], ["chunk", "path", "pairs", "n"])
                chunk += 1

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(columns.mapInArrow(save, CHUNKS), "alignment-list")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, count, best) over all chunks; best if no other pair of its b is linked more often.

    Sums are combined before they are shuffled. A window holds the pairs of one b, of
    which there are no more than ids of a.
    """
    summed = chunks.select(F.explode(F.arrays_zip("pairs", "n")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.n").alias("count"))
    of_b = Window.partitionBy(F.shiftright("pair", 16))
    return summed.withColumn("best", F.col("count") == F.max("count").over(of_b))


def aligned_documents(docs: DataFrame, sides: Callable[[], tuple[Side, Side]]) -> DataFrame:
    """Per row of ``docs``: numbers of tokens, groups and links, how many links are to the id most often
    linked to their b, the sum of their pairs' counts, and the digest of the groups.

    Texts without tokens (null, empty, or not spelled alike by both sides) give zeros and an empty digest.
    Null and repeated ids and rows are rows like others, and repeats count. Empty in, empty out.
    """
    chunks = save_alignments(docs, sides)
    counts = written(pair_counts(chunks), "pair-counts")
    # Each pair of a chunk asks once; a pair that all chunks hold is a row per chunk, which skew joins split.
    asked = chunks.select("chunk", F.posexplode("pairs").alias("at", "of"))
    answers = asked.join(counts, F.col("of") == F.col("pair")).select("chunk", "at", "count", "best")

    def finish(key: tuple, answer: pa.Table, chunk: pa.Table) -> pa.Table:
        total = {f: [] for f in _NAMES}
        order = np.argsort(answer["at"].to_numpy())
        count = answer["count"].to_numpy()[order]
        best = answer["best"].to_numpy()[order].astype(np.int64)
        for path in chunk["path"].to_pylist():
            file = load_arrays(path, doc_id="list", first_a="<i8", first_b="<i8", first="<i8", link="<u4", digests="u1")
            groups = np.diff(file["first"])
            raw = file["digests"].tobytes()
            total["doc_id"] += file["doc_id"]
            total["n_a"] += np.diff(file["first_a"]).tolist()
            total["n_b"] += np.diff(file["first_b"]).tolist()
            total["n_groups"] += groups.tolist()
            total["n_links"] += groups.tolist()
            for name, values in (("n_best", best), ("count_sum", count)):
                sums = np.concatenate([[0], np.cumsum(values[file["link"]])])
                total[name] += np.diff(sums[file["first"]]).tolist()
            total["groups_sha256"] += [raw[32 * i : 32 * i + 32].hex() if n else "" for i, n in enumerate(groups.tolist())]
        types = [pa.string() if f == "groups_sha256" else pa.int64() for f in _NAMES]
        return pa.table([pa.array(total[f], t) for f, t in zip(_NAMES, types, strict=True)], names=_NAMES)

    files = chunks.select(F.col("chunk").alias("own"), "path")
    return answers.groupBy("chunk").cogroup(files.groupBy("own")).applyInArrow(finish, RESULT)


_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def byte_and_piece_sides(byte_level: str, pattern: str, pieces: str) -> tuple[Side, Side]:
    """A byte-level tokenizer given the text behind a space, and a sentencepiece model that adds it."""
    import sentencepiece

    encoder = byte_level_encoder(byte_level, pattern)
    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    spelled = [
        bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else p.replace("▁", " ").encode()
        for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))
    ]
    a = Side(lambda text: np.frombuffer(encoder.encode(" " + text), "<u2"), token_bytes(byte_level))
    return a, Side(lambda text: np.array(model.encode(text), np.int64), spelled)
