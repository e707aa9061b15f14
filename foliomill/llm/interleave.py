"""Shards that all have the mixture of the whole: proportional stratified interleaving.

The rows of each source are put in a seeded random order. The row of rank r
(from 0) of a source of n rows stands at the fraction (r + u) / n, with u in
[0, 1) drawn from the source, so that sources of a few rows are spread too.
Sorting all rows by fraction interleaves the sources in proportion; equal runs
of that order are the shards: their row counts differ by one at most, and each
holds its share of every source but for a row or two.

Neither order is made by one task. Within sources, rows go to ranges of
(source, hash, row number), which cut a source or a row that is repeated without end
like any other; ranks are places in a range plus the rows of the source in earlier
ranges. Fractions are even by construction, so the second order is cut into
slices of equal width and slices are numbered on from each other. Only narrow rows
are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.session import discard, written

SLICE_ROWS = 50_000  # rows sorted together
HASH_DIGITS, DRAW_DIGITS = 15, 13  # hexadecimal: 60 bits for the order, 52 for a double in [0, 1)


def _hexadecimal(digest, digits: int):
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def assign_shards(docs: DataFrame, shards: int = 8, seed: int = 13, stratum: str = "source", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, size (bytes of the text and one), text_crc32, law (``rows``: shards
    differ by one row at most), shard, slot (its place there, gapless from 0), and grown_shard,
    null under this law.

    A null text has size 1 and the CRC of no bytes. A null source is a source of its own.
    Null and repeated ids are rows like others; rows alike in id, size and CRC are ordered by
    their place in the input, which shows in no column. Copies of a text are dealt like any rows:
    keeping them together would break both the mixture and the equal counts. With fewer rows
    than shards some shards are empty; empty in, empty out.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(F.col(f"`{stratum}`").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(f"`{stratum}`").cast("string"))).alias("stratum"),
    )
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text_crc32"))
    narrow = narrow.withColumn("hash", _hexadecimal(F.md5(key.cast("binary")), HASH_DIGITS)).withColumn("row", F.monotonically_increasing_id())
    # Written, as the ranges are sampled first: texts are read once.
    narrow = written(narrow, "interleave-rows")
    total = narrow.count()
    slices = max(1, -(-total // slice_rows))

    order = ["stratum", "hash", "doc_id", "text_crc32", "size", "row"]
    ranged = narrow.repartitionByRange(slices, *order).sortWithinPartitions(*order)
    # The number of a row is its partition in the upper bits and its place there in the lower 33.
    number = F.monotonically_increasing_id()
    ranged = written(ranged.select("doc_id", "size", "text_crc32", "stratum", number.alias("number")), "interleave-ranges")
    part, place = F.shiftright("number", 33), F.col("number").bitwiseAND(F.lit((1 << 33) - 1))
    spans = ranged.groupBy(part.alias("part"), F.col("stratum").alias("of")).agg(F.min(place).alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        "part",
        "of",
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy("of")).alias("of_all"),
        (_hexadecimal(F.md5(F.concat(F.lit(f"{seed}:"), F.col("of")).cast("binary")), DRAW_DIGITS) / F.lit(float(1 << 4 * DRAW_DIGITS))).alias("draw"),
    )
    spans = written(spans, "interleave-spans")  # a row per source and range it lies in
    ranked = ranged.join(spans, (part == F.col("part")) & (F.col("stratum") == F.col("of")))
    rank = place + F.col("shift")
    fraction = (rank + F.col("draw")) / F.col("of_all")
    ranked = ranked.select("doc_id", "size", "text_crc32", "stratum", rank.alias("rank"), fraction.alias("fraction"))

    # The slice of a fraction: at most one row of a source more or less than the width promises.
    cut = F.least(F.floor(F.col("fraction") * slices), F.lit(slices - 1)).cast("long")
    inside = Window.partitionBy("slice").orderBy("fraction", "stratum", "rank")
    ranked = ranked.withColumn("slice", cut)
    ordered = written(ranked.select("doc_id", "size", "text_crc32", "slice", (F.row_number().over(inside) - 1).alias("at")), "interleave-order")
    discard(narrow, ranged, spans)
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    counts = ordered.groupBy("slice").agg(F.count("*").alias("n"))
    starts = counts.select(F.col("slice").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    at = ordered.join(starts, F.col("slice") == F.col("of")).withColumn("at", F.col("at") + F.col("start"))
    shard = F.expr(f"at * {shards} div {max(1, total)}")
    return at.withColumn("own", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("own").cast("int").alias("shard"),
        (F.col("at") - F.expr(f"(own * {total} + {shards - 1}) div {shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


SQL = f"""
WITH codes AS (
  SELECT list(v ORDER BY i) AS code FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
    FROM range(256) t(i))
), bytes AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS stratum,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b
  FROM documents
), narrow AS (
  SELECT doc_id, stratum, len(b) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda x, y: xor(x >> 8, code[1 + (xor(x, y) & 255)])), 4294967295) AS text_crc32
  FROM bytes, codes
), hashed AS (
  SELECT *, ('0x' || substr(md5('13:' || coalesce(doc_id::VARCHAR, '') || ':' || text_crc32), 1, {HASH_DIGITS}))::BIGINT AS hash,
    ('0x' || substr(md5('13:' || stratum), 1, {DRAW_DIGITS}))::BIGINT::DOUBLE / {float(1 << 4 * DRAW_DIGITS)!r}::DOUBLE AS draw
  FROM narrow
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY hash, doc_id, text_crc32, size) - 1 AS rank,
    count(*) OVER (PARTITION BY stratum) AS of_all
  FROM hashed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (rank::DOUBLE + draw) / of_all::DOUBLE, stratum, rank) - 1 AS spot, count(*) OVER () AS total
  FROM ranked
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (spot * 8 // total)::INTEGER AS shard,
  (spot - (spot * 8 // total * total + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""
