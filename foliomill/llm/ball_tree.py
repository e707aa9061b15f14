"""Exact ranked lexical search with ball trees over sparse document vectors.

A document's vector holds for each term ``(10^9 tf) div (1000 tf + 20 m)``, an
item's the terms' weights; a score is their inner product. Documents are indexed
in blocks of bounded size, and a block's vectors, cut to the terms that a group of
items asks for, form a ball tree. For a node with centroid c and radius R every
vector x below it has ``q x <= q c + |q| R`` (Cauchy-Schwarz); axes are scaled by the
root of the weights, which leaves inner products alone. As coordinates are never
negative, the centroid also says how far each of them can be from it: not at all for a term
that the node lacks. Terms that can go less far than the ball allows are taken
at that distance, and ``|q| R`` is left for the others. Bounds are computed in
doubles and enlarged beyond any rounding error, so a subtree is passed over only if no
document in it can reach the score still needed; scores at the leaves are exact
integers. Nodes are opened best bound first.

Every tree first scores its best leaf for each item. The k-th best of those scores
over all trees is a lower bound of the item's k-th best score, so trees without
good documents are left at their root, however many there are. Items are dealt to
groups, and each pair of a block and a group is a piece of work of its own; neither side
is sent whole to anyone. Terms are told by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm.chunks import WORD_HASHES, among
from foliomill.llm.common import load_arrays, new_folder, pack_arrays, save_file, slices
from foliomill.session import discard, written

BLOCK_DOCS = 4096
BLOCK_ENTRIES = 4_000_000  # of (document, term): long texts close a block earlier
GROUP_ITEMS = 512
LEAF_DOCS = 32
SEEDS = 10  # scores of its best leaf that a tree reports for an item
PAIRS_PER_TASK = 2
MOST = 1_000_000  # impacts are smaller

#: Terms are runs of ASCII letters and digits and of all non-ASCII characters; A-Z are lower-cased.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

BLOCKS = "block string, documents long, terms long"
TREES = "tree string, grp int, path string, seeds array<array<long>>"
FOUND = "grp int, item int, item_id long, doc_id long, score long"


def term_hashes(text: str | None) -> np.ndarray:
    words = text.encode().translate(_TERMS).split() if text else []
    return np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))


def save_blocks(docs: DataFrame) -> DataFrame:
    """Index files of documents with terms: for each its id, length, and its terms' places in the
    block's sorted dictionary with their frequencies. One row per file."""
    folder = new_folder(docs.sparkSession, "term-blocks")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, terms, counts = [], [], [], []

        def flush() -> pa.RecordBatch:
            dictionary, place = np.unique(np.concatenate(terms), return_inverse=True)
            first = np.cumsum([0, *(len(t) for t in terms)])
            content = pack_arrays(
                ids=list(ids),
                lengths=np.array(lengths, "<i8"),
                first=first.astype("<i8"),
                term=place.astype("<u4"),
                tf=np.concatenate(counts).astype("<u4"),
                dictionary=dictionary,
            )
            row = {"block": [save_file(folder, "block", ".arrows", content)], "documents": [len(ids)], "terms": [sum(lengths)]}
            for held in (ids, lengths, terms, counts):
                held.clear()
            return pa.RecordBatch.from_pydict(row)

        entries = 0
        for batch in batches:
            for rows in slices(batch, "text"):
                for doc_id, text in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), strict=True):
                    hashes = term_hashes(text)
                    if not len(hashes):
                        continue
                    term, tf = np.unique(hashes, return_counts=True)
                    ids.append(doc_id)
                    lengths.append(len(hashes))
                    terms.append(term)
                    counts.append(tf)
                    entries += len(term)
                    if len(ids) >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                        yield flush()
                        entries = 0
        if ids:
            yield flush()

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(columns.mapInArrow(save, BLOCKS), "term-block-list")


def save_groups(items: DataFrame) -> list[str]:
    """Files of up to GROUP_ITEMS items each: their ids and distinct terms. The paths, one per group,
    come to the driver: they name the pieces of work."""
    folder = new_folder(items.sparkSession, "item-groups")
    rows = written(items.select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates(), "items")
    groups = -(-rows.count() // GROUP_ITEMS)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms = [], []

        def flush() -> pa.RecordBatch:
            first = np.cumsum([0, *(len(t) for t in terms)])
            content = pack_arrays(ids=list(ids), first=first.astype("<i8"), terms=np.concatenate(terms))
            ids.clear()
            terms.clear()
            return pa.RecordBatch.from_pydict({"path": [save_file(folder, "group", ".arrows", content)]})

        for batch in batches:
            for item_id, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids.append(item_id)
                terms.append(np.unique(term_hashes(text)))
                if len(ids) >= GROUP_ITEMS:
                    yield flush()
        if ids:
            yield flush()

    if not groups:
        return []
    saved = written(rows.repartition(groups).mapInArrow(save, "path string"), "item-group-list")
    paths = sorted(r["path"] for r in saved.collect())
    discard(rows, saved)
    return paths


def _group(path: str) -> tuple[list, list[np.ndarray]]:
    file = load_arrays(path, ids="list", first="<i8", terms="<u8")
    return file["ids"], np.split(file["terms"], file["first"][1:-1])


def _restricted(path: str, vocabulary: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """A block, a mask of its entries whose term is in the sorted vocabulary, and their places there."""
    block = load_arrays(path, ids="list", lengths="<i8", first="<i8", term="<u4", tf="<u4", dictionary="<u8")
    wanted = among(block["dictionary"], vocabulary)
    mask = wanted[block["term"]]
    return block, mask, np.searchsorted(vocabulary, block["dictionary"])[block["term"][mask]]


def weighted_groups(pairs: DataFrame, groups: list[str], documents: int) -> dict[int, str]:
    """For each group a file of its sorted terms and their weights, from document frequencies over all blocks."""
    folder = new_folder(pairs.sparkSession, "item-weights")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, grp in zip(batch["block"].to_pylist(), batch["grp"].to_pylist(), strict=True):
                if grp not in held:
                    vocabulary = np.unique(np.concatenate(_group(groups[grp])[1]))
                    held[grp] = vocabulary, np.zeros(len(vocabulary), np.int64)
                vocabulary, df = held[grp]
                df += np.bincount(_restricted(block, vocabulary)[2], minlength=len(vocabulary))
        for grp, (vocabulary, df) in held.items():
            yield pa.RecordBatch.from_pydict({"grp": pa.array([grp] * len(df), pa.int32()), "term": vocabulary.view(np.int64), "df": df})

    def weigh(table: pa.Table) -> pa.Table:
        grp = table["grp"][0].as_py()
        terms = table["term"].to_numpy().view(np.uint64)
        order = np.argsort(terms)
        weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in table["df"].to_pylist()]
        content = pack_arrays(terms=terms[order], weights=np.array(weights, "<i8")[order])
        return pa.table({"grp": pa.array([grp], pa.int32()), "path": [save_file(folder, "weights", ".arrows", content)]})

    counted = pairs.mapInArrow(count, "grp int, term long, df long").groupBy("grp", "term").agg(F.sum("df").alias("df"))
    saved = counted.groupBy("grp").applyInArrow(weigh, "grp int, path string").collect()  # a row per group
    return {r["grp"]: r["path"] for r in saved}


class BallTree:
    """Rows of a sparse matrix (first, column, value) under nodes with centroid and radius.

    Node 0 is the root; a node's children stand behind it, and it covers the rows ``start`` to
    ``end`` of ``order``. Centroids are kept by column, so that a query touches only its terms.
    """

    def __init__(self, first: np.ndarray, column: np.ndarray, value: np.ndarray, width: int) -> None:
        self.order = np.arange(len(first) - 1)
        self.start, self.end, self.left, self.right, self.radius = [], [], [], [], []
        centres: list[tuple[np.ndarray, np.ndarray]] = []
        norms = np.add.reduceat(value * value, first[:-1])
        dense = np.zeros(width)

        def entries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = first[rows + 1] - first[rows]
            ends = np.cumsum(n)
            return np.arange(ends[-1]) + np.repeat(first[rows] - ends + n, n), ends - n

        def products(at: np.ndarray, starts: np.ndarray, vector: np.ndarray) -> np.ndarray:
            return np.add.reduceat(value[at] * vector[column[at]], starts)

        stack = [(0, len(self.order), -1, False)]
        while stack:
            start, end, parent, is_right = stack.pop()
            node = len(self.start)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            rows = self.order[start:end]
            at, starts = entries(rows)
            centre = np.bincount(column[at], value[at], width) / len(rows)
            touched = np.flatnonzero(centre)
            along = products(at, starts, centre)
            size = float(centre @ centre)
            # Enlarged by far more than the rounding of its parts.
            squares = np.maximum(norms[rows] - 2 * along + size, 0) + 1e-9 * (norms[rows] + size)
            self.start.append(start)
            self.end.append(end)
            self.left.append(-1)
            self.right.append(-1)
            self.radius.append(math.sqrt(squares.max()) * (1 + 1e-9))
            centres.append((touched, centre[touched]))
            if len(rows) > LEAF_DOCS:
                # Two rows far apart span the line that the rows are halved along.
                one = rows[int(np.argmax(squares))]
                dense[column[first[one] : first[one + 1]]] = value[first[one] : first[one + 1]]
                to_one = products(at, starts, dense)
                dense[column[first[one] : first[one + 1]]] = 0
                other = rows[int(np.argmax(norms[rows] - 2 * to_one))]
                dense[column[first[other] : first[other + 1]]] = value[first[other] : first[other + 1]]
                side = to_one - products(at, starts, dense)
                dense[column[first[other] : first[other + 1]]] = 0
                self.order[start:end] = rows[np.argsort(side, kind="stable")]
                middle = (start + end) // 2
                stack += [(middle, end, node, True), (start, middle, node, False)]
        nodes = np.repeat(np.arange(len(centres)), [len(c[0]) for c in centres])
        columns = np.concatenate([c[0] for c in centres])
        by_column = np.argsort(columns, kind="stable")
        self.node = nodes[by_column]
        self.share = np.concatenate([c[1] for c in centres])[by_column]
        self.of_column = np.searchsorted(columns[by_column], np.arange(width + 1))


def _gather(first: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of the keys, and how many each key has."""
    n = first[keys + 1] - first[keys]
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[keys] - ends + n, n), n


class Searcher:
    """A saved tree with its documents, ready for the items of its group."""

    FIELDS = dict(
        ids="list", first="<i8", column="<u4", impact="<i8", start="<i8", end="<i8", left="<i8", right="<i8",
        radius="<f8", node="<i4", share="<f8", of_column="<i8",
    )

    def __init__(self, weights: np.ndarray, fields: dict) -> None:
        self.weights, self.roots = weights, np.sqrt(weights)
        self.__dict__.update(fields)
        self.dense = np.zeros(len(weights), np.int64)

    @classmethod
    def build(cls, ids: list, first: np.ndarray, column: np.ndarray, impact: np.ndarray, weights: np.ndarray) -> "Searcher":
        """From rows of (column, impact); every row has at least one."""
        tree = BallTree(first, column, impact * np.sqrt(weights)[column], len(weights))
        at, n = _gather(first, tree.order)
        fields = {k: np.array(getattr(tree, k), t) for k, t in cls.FIELDS.items() if hasattr(tree, k)}
        fields |= {"ids": [ids[i] for i in tree.order], "first": np.concatenate([[0], np.cumsum(n)]), "column": column[at], "impact": impact[at]}
        return cls(weights, fields)

    def save(self, folder: str) -> str:
        content = {k: getattr(self, k) if t == "list" else np.asarray(getattr(self, k), t) for k, t in self.FIELDS.items()}
        return save_file(folder, "tree", ".arrows", pack_arrays(**content))

    def bounds(self, columns: np.ndarray) -> np.ndarray:
        """For every node a number that no score below it exceeds."""
        at, n = _gather(self.of_column, columns)
        node, centre, q = self.node[at], self.share[at], np.repeat(self.roots[columns], n)
        count = len(self.radius)
        # A coordinate is at most the sum over the node's rows, and at most its term's largest impact.
        spare = np.minimum((self.end - self.start)[node] * centre, MOST * q) * (1 + 1e-9) - centre
        inner = np.bincount(node, q * centre, count)
        free, fixed = np.ones(len(at), bool), np.zeros(count)
        best = np.full(count, np.inf)
        for _ in range(4):
            length = np.sqrt(np.bincount(node, q * q * free, count))
            best = np.minimum(best, inner + fixed + length * self.radius)
            # Along the ball's best direction these would go further than they can.
            steep = (self.radius / np.maximum(length, 1e-9))[node]
            free &= spare >= q * steep
            fixed = np.bincount(node, q * spare * ~free, count)
        return best * (1 + 1e-9) + 1

    def leaf(self, node: int, columns: np.ndarray) -> np.ndarray:
        """The exact scores of a leaf's documents; ``dense`` holds the weights of the columns."""
        start, end = self.start[node], self.end[node]
        lo, hi = self.first[start], self.first[end]
        return np.add.reduceat(self.dense[self.column[lo:hi]] * self.impact[lo:hi], self.first[start:end] - lo)

    def best_leaf(self, columns: np.ndarray) -> np.ndarray:
        """The scores above 0 of the leaf down the better bounds."""
        bounds, node = self.bounds(columns), 0
        while self.left[node] >= 0:
            left, right = self.left[node], self.right[node]
            node = left if bounds[left] >= bounds[right] else right
        self.dense[columns] = self.weights[columns]
        scores = self.leaf(node, columns)
        self.dense[columns] = 0
        return scores[scores > 0]

    def search(self, columns: np.ndarray, k: int, needed: int) -> list[tuple[int, int | None]]:
        """The k best (score, id) of at least ``needed`` and above 0; equal scores by id, null last."""
        bounds = self.bounds(columns)
        self.dense[columns] = self.weights[columns]
        needed, best, found = max(needed, 1), [], []
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= needed:
            bound, node = heappop(heap)
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    own = min(-bound, bounds[child])
                    if own >= needed:
                        heappush(heap, (-own, child))
                continue
            scores = self.leaf(node, columns)
            for i in np.flatnonzero(scores >= needed).tolist():
                score = int(scores[i])
                found.append((score, self.ids[self.start[node] + i]))
                if len(best) < k:
                    heappush(best, score)
                else:
                    heappushpop(best, score)
                if len(best) == k:
                    needed = max(needed, best[0])
        self.dense[columns] = 0
        return sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))[:k]


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """Per item (item_id, text) its k best documents: item_id, rank, doc_id, score.

    A null or empty text has no terms, so such a document isn't counted and never found, and
    such an item finds nothing. Equal rows of items count once; different texts under one id
    are ranked each on their own, under that id. Null ids are ids like others; a document without one comes last
    among equal scores. Repeated documents are documents of their own. Empty in, empty out.
    """
    spark = docs.sparkSession
    nothing = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    groups = save_groups(items)
    blocks = save_blocks(docs)
    total = blocks.agg(F.count("*"), F.sum("documents"), F.sum("terms")).first()
    if not groups or not total[0]:
        return nothing
    n_blocks, n_docs, n_terms = total
    # A stated set of items in groups meets all documents in blocks: rows here are names of files.
    pairs = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(len(groups) - 1))).alias("grp"))
    tasks = -(-n_blocks * len(groups) // PAIRS_PER_TASK)
    pairs = pairs.repartition(tasks)
    weights = weighted_groups(pairs, groups, n_docs)
    folder = new_folder(spark, "ball-trees")
    held: dict[str, tuple] = {}

    def group(grp: int) -> tuple[list, list[np.ndarray], np.ndarray, np.ndarray]:
        """Ids, columns of each item, sorted terms and weights; the last few groups stay loaded."""
        if grp not in held:
            if len(held) > 4:
                held.clear()
            file = load_arrays(weights[grp], terms="<u8", weights="<i8")
            ids, terms = _group(groups[grp])
            held[grp] = ids, [np.searchsorted(file["terms"], t) for t in terms], file["terms"], file["weights"]
        return held[grp]

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, grp in zip(batch["block"].to_pylist(), batch["grp"].to_pylist(), strict=True):
                if grp not in weights:  # its items have no terms
                    continue
                _, items_of, vocabulary, weight = group(grp)
                block, mask, column = _restricted(path, vocabulary)
                own = np.add.reduceat(mask, block["first"][:-1], dtype=np.int64)
                if not own.any():
                    continue
                mass = np.array([50 + 50 * n * n_docs // n_terms for n in block["lengths"].tolist()], np.int64)
                tf = block["tf"][mask].astype(np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(mass, own))
                ids = [i for i, n in zip(block["ids"], own.tolist(), strict=True) if n]
                first = np.concatenate([[0], np.cumsum(own[own > 0])])
                tree = Searcher.build(ids, first, column, impact, weight)
                seeds = [np.sort(tree.best_leaf(c))[: -SEEDS - 1 : -1].tolist() if len(c) else [] for c in items_of]
                yield pa.RecordBatch.from_pydict(
                    {
                        "tree": [tree.save(folder)],
                        "grp": pa.array([grp], pa.int32()),
                        "path": [path],
                        "seeds": pa.array([seeds], pa.list_(pa.list_(pa.int64()))),
                    }
                )

    trees = written(pairs.mapInArrow(plant, TREES), "ball-tree-list")
    scores = trees.select("grp", F.posexplode("seeds").alias("item", "seed")).select("grp", "item", F.explode("seed").alias("score"))
    placed = scores.withColumn("place", F.row_number().over(Window.partitionBy("grp", "item").orderBy(F.desc("score"))))
    floor = placed.filter(F.col("place") <= k).filter(F.col("place") == k).select("grp", F.struct("item", "score").alias("floor"))
    floors = floor.groupBy(F.col("grp").alias("of")).agg(F.collect_list("floor").alias("floors"))  # one per item of a group at most
    # Dealt out after the join, which may bring all trees of a group together: these rows are names and floors.
    work = trees.select("tree", "grp").join(floors, F.col("grp") == F.col("of"), "left").select("tree", "grp", "floors").repartition(tasks)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, grp, floors in zip(*(batch[c].to_pylist() for c in ("tree", "grp", "floors")), strict=True):
                ids, items_of, _, weight = group(grp)
                needed = {f["item"]: f["score"] for f in floors or []}
                tree = Searcher(weight, load_arrays(path, **Searcher.FIELDS))
                out = []
                for i, columns in enumerate(items_of):
                    if len(columns):
                        out += [(grp, i, ids[i], doc_id, score) for score, doc_id in tree.search(columns, k, needed.get(i, 0))]
                if out:
                    arrays = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FOUND, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=_FOUND)

    best = Window.partitionBy("grp", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = work.mapInArrow(find, FOUND).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_FOUND = pa.schema([("grp", pa.int32()), ("item", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

SQL = f"""
WITH asked AS (
  SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all({_LOWER.format("text")}, {_TERM})) AS terms
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
), texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("text")}, {_TERM}) AS terms FROM documents
), sized AS (
  SELECT r, doc_id, terms, len(terms) AS n FROM texts WHERE len(terms) > 0
), totals AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sized
), masses AS (
  SELECT r, 50 + (50 * n * n_docs) // n_terms AS m FROM sized, totals
), counts AS (
  SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(terms) AS term FROM sized) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term
), scored AS (
  SELECT item, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM (SELECT item, item_id, unnest(terms) AS term FROM asked) JOIN counts USING (term) JOIN weights USING (term) JOIN masses USING (r)
  GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) <= 50
"""
