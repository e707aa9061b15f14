"""Pack documents into training windows with lexically near neighbours.

Whole windows of a document stand alone. What is left of each document (less than
a window) is packed: a seed's window is filled with the unused remainders that
BM25 ranks highest for it, the last one cut so that the window is full. The
inverted index is sharded: rows are ordered by content, cut into shards of about
``shard_rows``, and each shard's index lives in one task. The order is that of a
few terms drawn from each remainder by weight (its idf) with the same random number
for a term everywhere, so remainders that share rare terms tend to lie side by
side, however many shards there are. Document frequencies and the mean length
are those of all remainders; terms are token ids, so their table is bounded by
the vocabulary. What a shard has left at its end is cut into sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import slices
from foliomill.llm.tokens import SegmentEncoder
from foliomill.session import written

K1, B = 1.2, 0.75
KEYS = 4  # terms that order a remainder
SHARDS_PER_TASK = 32

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenised(docs: DataFrame, encoder: Callable[[], SegmentEncoder], end_id: int, window: int) -> DataFrame:
    """Per document the CRCs of its whole windows and the ids of the remainder (u16)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder().encode
        for batch in batches:
            for rows in slices(batch, "text"):
                counts, crcs, rest = [], [], []
                for text in rows["text"].to_pylist():
                    ids = np.append(np.frombuffer(encode(text), "<u2"), np.uint16(end_id))
                    whole = len(ids) // window * window
                    counts.append(len(ids))
                    crcs.append([_crc(ids[i : i + window]) for i in range(0, whole, window)])
                    rest.append(ids[whole:].tobytes())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": rows["doc_id"],
                        "doc_tokens": pa.array(counts, pa.int64()),
                        "crcs": pa.array(crcs, pa.list_(pa.int64())),
                        "rest": pa.array(rest, pa.binary()),
                    }
                )

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return columns.mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>, rest binary")


def term_statistics(rests: DataFrame, vocabulary: int) -> tuple[np.ndarray, int, float]:
    """Document frequency of each id, number of remainders and their mean length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows, tokens = np.zeros(vocabulary, np.int64), 0, 0
        for batch in batches:
            for rest in batch["rest"].to_pylist():
                ids = np.frombuffer(rest, "<u2")
                df[np.unique(ids)] += 1
                rows, tokens = rows + 1, tokens + len(ids)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": np.append(term, [-1, -2]), "n": np.append(df[term], [rows, tokens])})

    summed = rests.select("rest").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df, rows, tokens = np.zeros(vocabulary, np.int64), 0, 0
    for term, n in summed.collect():  # the vocabulary and two totals at most
        if term == -1:
            rows = n
        elif term == -2:
            tokens = n
        else:
            df[term] = n
    return df, rows, tokens / max(1, rows)


def draws(vocabulary: int, df: np.ndarray, rows: int) -> np.ndarray:
    """For each term an exponential number of rate idf. The least of a document's terms is a draw by
    weight that documents with common terms share; a term of a single document comes after all others."""
    idf = np.log1p((rows - df + 0.5) / (df + 0.5))
    number = np.random.default_rng(17).exponential(size=vocabulary) / np.maximum(idf, 1e-12)
    return np.where(df > 1, number, np.inf)


def order_terms(ids: np.ndarray, drawn: np.ndarray) -> list[int]:
    """The KEYS terms drawn first, -1 where there are none left."""
    terms = np.unique(ids)
    terms = terms[np.argsort(drawn[terms], kind="stable")[:KEYS]]
    found = terms[np.isfinite(drawn[terms])].tolist()
    return found + [-1] * (KEYS - len(found))


class ShardIndex:
    """BM25 over the remainders of one shard."""

    def __init__(self, documents: list[np.ndarray], df: np.ndarray, rows: int, mean: float) -> None:
        terms, where, weights = [], [], []
        self.terms = []
        for i, ids in enumerate(documents):
            term, tf = np.unique(ids, return_counts=True)
            idf = np.log1p((rows - df[term] + 0.5) / (df[term] + 0.5))
            weights.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean)))
            terms.append(term)
            where.append(np.full(len(term), i, np.int32))
            self.terms.append(term)
        term = np.concatenate(terms)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = np.concatenate(where)[order], np.concatenate(weights)[order]
        self.first = np.searchsorted(term[order], np.arange(len(df) + 1))
        self.unused = np.ones(len(documents), bool)

    def scores(self, query: int) -> np.ndarray:
        """The score of every unused remainder for the terms of one; used ones get -inf."""
        start, end = self.first[self.terms[query]], self.first[self.terms[query] + 1]
        n = end - start
        entries = np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)
        out = np.bincount(self.doc[entries], self.weight[entries], len(self.unused))
        return np.where(self.unused, out, -np.inf)


def fill_windows(index: ShardIndex, lengths: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token of the shard once.

    Seeds are taken in order; equal scores fall to the first. A cut neighbour stays
    unused with what is left of it. Only the last sequences may be short, each of a
    power of two.
    """
    sequences, done, seed = [], [0] * len(lengths), 0
    left = sum(lengths)
    while left:
        while not index.unused[seed]:
            seed += 1
        room, pieces, scores = window, [], None
        chosen = seed
        while True:
            take = min(room, lengths[chosen] - done[chosen])
            pieces.append((chosen, done[chosen], take))
            done[chosen] += take
            room, left = room - take, left - take
            if done[chosen] == lengths[chosen]:
                index.unused[chosen] = False
            if not room or not left:
                break
            if scores is None:
                scores = index.scores(seed)
            scores[chosen] = -np.inf
            chosen = int(np.argmax(scores))
        sequences += [pieces] if not room else _powers(pieces)
    return sequences


def _powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cut a short sequence into ones whose lengths are powers of two, longest first."""
    total, out, rest = sum(p[2] for p in pieces), [], list(pieces)
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            room, own = 1 << bit, []
            while room:
                doc, start, length = rest.pop(0)
                take = min(room, length)
                own.append((doc, start, take))
                room -= take
                if take < length:
                    rest.insert(0, (doc, start + take, length - take))
            out.append(own)
    return out


def pack(
    docs: DataFrame,
    encoder: Callable[[], SegmentEncoder],
    end_id: int,
    vocabulary: int,
    window: int = 1024,
    shard_rows: int = 512,
) -> DataFrame:
    """A row per piece of a document: where it lies in its document and in its sequence.

    Every token is in one piece; a null text is empty and has just the end id; null and
    repeated ids and rows are documents of their own. Shards are ranges of the order by
    content and then by row number, so no key or group of copies can make one large, and a
    shard holds about ``shard_rows`` remainders. Whole windows get even sequence ids, shards odd ones.
    """
    rows = written(tokenised(docs, encoder, end_id, window), "pack-tokens")
    df, n_rows, mean = term_statistics(rows, vocabulary)
    whole = rows.select("doc_id", "doc_tokens", F.posexplode("crcs").alias("at", "ids_crc32")).select(
        "doc_id",
        (F.col("at") * window).cast("long").alias("start"),
        F.lit(window).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.monotonically_increasing_id() * 2).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    shards = max(1, -(-n_rows // shard_rows))
    spark = docs.sparkSession
    statistics = spark.sparkContext.broadcast((df, n_rows, mean))  # a number per vocabulary entry
    numbered = rows.filter(F.octet_length("rest") > 0).select("doc_id", "doc_tokens", "rest", F.monotonically_increasing_id().alias("row"))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = draws(vocabulary, *statistics.value[:2])
        for batch in batches:
            keys = np.array([order_terms(np.frombuffer(x, "<u2"), drawn) for x in batch["rest"].to_pylist()], np.int32).reshape(-1, KEYS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(k) for k in keys.T)], [*batch.schema.names, *names])

    names = [f"k{i}" for i in range(KEYS)]
    schema = "doc_id long, doc_tokens long, rest binary, row long, " + ", ".join(f"{k} int" for k in names)
    # written, as the ranges are sampled first
    ordered = written(numbered.mapInArrow(order, schema), "pack-order")
    ranges = -(-shards // SHARDS_PER_TASK)
    remainders = ordered.repartitionByRange(ranges, *names, "row").sortWithinPartitions(*names, "row")
    remainders = remainders.select("doc_id", "doc_tokens", "rest")

    def shard(rows: list[tuple], number: int, first: int) -> list[tuple]:
        doc_ids, totals, rests = zip(*rows, strict=True)
        ids = [np.frombuffer(x, "<u2") for x in rests]
        sequences = fill_windows(ShardIndex(ids, *statistics.value), [len(x) for x in ids], window)
        out = []
        for k, pieces in enumerate(sequences, first):
            offset = 0
            for i, start, length in pieces:
                base = totals[i] - len(ids[i])
                out.append((doc_ids[i], base + start, length, _crc(ids[i][start : start + length]), totals[i], (number << 24 | k) * 2 + 1, offset))
                offset += length
        return out

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, first, held = TaskContext.get().partitionId(), 0, []
        fields = [c.split()[0] for c in PIECES.split(", ")]

        def flush() -> pa.RecordBatch:
            nonlocal first
            out = shard(held, number, first)
            first = (out[-1][5] >> 1 & (1 << 24) - 1) + 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], fields)

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("doc_id", "doc_tokens", "rest")), strict=True):
                held.append(row)
                if len(held) >= shard_rows:
                    yield flush()
        if held:
            yield flush()

    return whole.unionByName(remainders.mapInArrow(fill, PIECES))
