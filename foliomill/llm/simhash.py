"""Near duplicates by SimHash fingerprints.

Pigeonhole blocks: fingerprints are split into ``blocks`` blocks, and two that
differ in ``radius`` bits at most agree on at least ``blocks - radius`` of them.
Each fingerprint is filed under every choice of so many blocks; those that meet
are compared, and linked if their distance is within the radius. Copies are one
fingerprint. A bucket gives each member one link to its group's first, not all
pairs. A bucket over ``BUCKET`` is split by the same rule on the bits that its
key left open; what then shares a key can differ in 12 bits, so it holds 4096
different fingerprints at most and no bucket is unbounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import lower_words_of, slices
from foliomill.llm.components import components
from foliomill.session import written

SEED = 42
RADIUS = 3
BUCKET = 4096


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The hashes of all ``width``-word shingles, repeats included; all words where there are fewer."""
    words = lower_words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, width: int) -> int:
    """Majority bits of the hashes of all ``width``-word shingles, repeats included."""
    return majority(shingle_hashes(text, width))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    if not len(hashes):
        return 0
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, digest, fp): the hash of each row's text and its fingerprint as a signed long. No words: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                fps = np.array([fingerprint(t, width) for t in rows["text"].to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["digest"], pa.array(fps)], ["doc_id", "digest", "fp"])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    return columns.mapInArrow(run, "doc_id long, digest long, fp long")


def _split(bits: list[int], blocks: int) -> list[int]:
    """Masks of nearly equal blocks of the given bits."""
    cuts = [round(i * len(bits) / blocks) for i in range(blocks + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _choices(bits: list[int], blocks: int, radius: int) -> list[int]:
    return [sum(c) for c in combinations(_split(bits, blocks), blocks - radius)]


_MASKS = _choices(list(range(64)), 6, RADIUS)


def block_keys(fp: int) -> list[int]:
    """What is left of a fingerprint for each choice of three of six blocks; two within the radius agree on at least one."""
    return [fp & m for m in _MASKS]


def _keys(masks: list[int]) -> Column:
    return F.explode(
        F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for t, m in enumerate(masks)))
    ).alias("key")


def _met(filed: DataFrame) -> DataFrame:
    """The rows whose key others share, with their number ``n``."""
    counts = filed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("k"), "n")
    return filed.join(counts, F.col("key") == F.col("k")).drop("k")


def bucket_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, first) for the groups that links within one bucket form."""
    group = np.arange(len(fps))
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps[i:] ^ fps[i]) <= radius) + i
        if len(near) > 1:
            own = np.unique(group[near])
            if len(own) > 1:
                group[np.isin(group, own)] = own[0]
    return [(int(fps[i]), int(fps[g])) for i, g in enumerate(group.tolist()) if i != g]


def _linked(met: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for fps in batch["fps"].to_pylist():
                found += bucket_links(np.sort(np.array(fps, np.int64)), radius)
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    lists = met.groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    return lists.mapInArrow(run, "a long, b long")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, blocks: int = 6) -> DataFrame:
    """Links (a, b) that connect just those of the distinct ``fps`` (fp) that chains of
    distances within the radius connect. Keys have 64 * (blocks - radius) / blocks bits:
    take more blocks where fingerprints outnumber the keys."""
    masks = _choices(list(range(64)), blocks, radius)
    met = written(_met(fps.select("fp", _keys(masks))), "simhash-buckets")
    small = _linked(met.filter(F.col("n") <= BUCKET), radius)
    large = met.filter(F.col("n") > BUCKET)
    open_bits = {t: [b for b in range(64) if not m >> b & 1] for t, m in enumerate(masks)}
    again = None
    if large.limit(1).count():
        for t, bits in open_bits.items():
            inner = max(radius + 1, round(len(bits) * radius / 12))  # leaves 12 bits open
            filed = large.filter(F.col("key.t") == t).select("fp", F.col("key.bits").alias("outer"), _keys(_choices(bits, inner, radius)))
            filed = filed.select("fp", F.struct(F.lit(t).alias("of"), "outer", "key.t", "key.bits").alias("key"))
            again = filed if again is None else again.unionByName(filed)
    return small if again is None else small.unionByName(_linked(_met(again).drop("n"), radius))


def _grouped(docs: DataFrame, width: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest, fp), and (of, component, component_id) for each fingerprint that more
    than one row has or that is linked. Others are groups of their own and left out."""
    rows = written(fingerprints(docs, width), "simhash-rows")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-classes")
    groups = written(components(fingerprint_links(classes.select("fp"), radius)), "simhash-groups")
    members = classes.join(groups, F.col("fp") == F.col("node"), "left").withColumn("component", F.coalesce("component", "fp"))
    shared = members.filter((F.col("n") > 1) | F.col("node").isNotNull())
    least = shared.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows, shared.select(F.col("fp").alias("of"), "component").join(least, "component").select("of", "component", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits) and component_id,
    the smallest doc_id that links reach. A null or empty text has fingerprint zero and
    is linked like any other. A null doc_id gets its group's smallest; with no other
    document it stays null. Repeated rows come back each. Empty in, empty out."""
    rows, groups = _grouped(docs, width, radius)
    return rows.join(groups, F.col("fp") == F.col("of"), "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )
