"""Nearest neighbours through learned partitions.

On a bounded sample a graph of exact nearest neighbours is cut into balanced parts;
a small network learns which part a vector's neighbours lie in. Every vector is
filed under its most probable part. A query goes to its most probable parts, as many
as find enough neighbours of sample rows that the network was not trained on. There
it is compared with all vectors, in blocks; each block returns a few candidates and
the best of all are ranked by cosines of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.session import written

SAMPLE = 6000  # vectors that the partitioning is fitted on, at most
PARTS = 16  # at least; doubled while a part would hold more than ROWS rows, up to MAX_PARTS
MAX_PARTS = 128
ROWS = 65_536
RECALL = 0.93  # share of held-out rows' neighbours that the probed parts must hold
BLOCK = 4096


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k most similar rows of each row of unit vectors, itself left out."""
    out = np.zeros((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        near = x[at : at + 1024] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at : at + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def _halve(x: np.ndarray, rows: np.ndarray, graph: np.ndarray, sweeps: int) -> np.ndarray:
    """Cut a subset of the graph into two halves of equal size with few edges between them.

    Starts from the median of the main direction of the vectors. A sweep takes the
    rows of each side that would gain most by changing it, in pairs, so that the
    halves stay equal, while a pair gains.
    """
    own = x[rows] - x[rows].mean(axis=0)
    main = np.linalg.eigh(own.T @ own)[1][:, -1]
    side = np.zeros(len(rows), bool)
    side[np.argsort(own @ main, kind="stable")[len(rows) // 2 :]] = True
    place = np.full(len(x), -1)
    place[rows] = np.arange(len(rows))
    ends = place[graph[rows]]
    a = np.repeat(np.arange(len(rows)), graph.shape[1])[(ends >= 0).ravel()]
    b = ends.ravel()[(ends >= 0).ravel()]
    for _ in range(sweeps):
        cross = (side[a] != side[b]) * 2.0 - 1
        gain = np.bincount(a, cross, len(rows)) + np.bincount(b, cross, len(rows))
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left = left[np.argsort(-gain[left], kind="stable")]
        right = right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right))
        good = int((gain[left[:n]] + gain[right[:n]] > 0).sum()) // 4
        if not good:
            break
        side[left[:good]], side[right[:good]] = True, False
    return side


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 30) -> np.ndarray:
    """A part for each row, all of equal size give or take one, by repeated halving."""
    label = np.zeros(len(x), np.int64)
    width = parts
    while width > 1:
        for part in range(0, parts, width):
            rows = np.flatnonzero(label == part)
            if len(rows) > 1:
                label[rows[_halve(x, rows, graph, sweeps)]] = part + width // 2
        width //= 2
    return label


class Router:
    """One hidden layer; gives each part's probability."""

    def __init__(self, dimension: int, parts: int, hidden: int = 128, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.w = [
            rng.normal(0, 1.0, (dimension, hidden)),
            np.zeros(hidden),
            rng.normal(0, hidden**-0.5, (hidden, parts)),
            np.zeros(parts),
        ]

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.w[0] + self.w[1], 0)
        z = h @ self.w[2] + self.w[3]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return h, p / p.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[1]

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = 25, rate: float = 0.003, seed: int = 7) -> None:
        """Adam on the cross-entropy with the neighbours' distribution over parts."""
        rng = np.random.default_rng(seed)
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                rows = order[at : at + 256]
                h, p = self._forward(x[rows])
                dz = (p - target[rows]) / len(rows)
                dh = dz @ self.w[2].T * (h > 0)
                step += 1
                for i, g in enumerate((x[rows].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                    g = g + 1e-4 * self.w[i]
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)


def train_router(x: np.ndarray, parts: int = PARTS, neighbours: int = 10, recall: float = RECALL) -> tuple[Router, int]:
    """The network, and how many parts a query must be sent to. A fifth of the sample, from
    50 rows on, is kept from training to tell; smaller samples ask for all parts."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    router = Router(x.shape[1], parts)
    if len(x) <= neighbours + 1:
        return router, parts
    graph = neighbour_graph(x, neighbours)
    label = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    for k in range(neighbours):
        target[np.arange(len(x)), label[graph[:, k]]] += 0.5 / neighbours
    target[np.arange(len(x)), label] += 0.5
    seen = np.arange(len(x)) % 5 > 0
    router.fit(x[seen], target[seen])
    held = np.flatnonzero(~seen)
    if len(held) < 50:
        return router, parts
    p = router.probabilities(x)
    filed = p.argmax(axis=1)
    order = np.argsort(-p[held], axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each part in a row's order
    found = np.sort(np.take_along_axis(place, filed[graph[held]], axis=1).ravel())
    return router, int(found[min(len(found) - 1, int(np.ceil(recall * len(found))))]) + 1


def _usable(vector: Column) -> Column:
    """Neither null nor zero, and every component a finite number."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0)


def _rows(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, dimension)


def exact_cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """In double precision; equal vectors get equal results wherever they stand."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def best(query: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and cosines of the k best rows, ties to the smaller id. ``near`` are cosines up to
    rounding; all rows that could be among the best by them are ranked exactly."""
    near = np.where(ids == own, -np.inf, near)
    cut = np.partition(near, len(near) - k)[len(near) - k] if len(near) > k else -np.inf
    rows = np.flatnonzero(near >= cut - 1e-9) if cut > -np.inf else np.flatnonzero(near > -np.inf)
    scores = exact_cosines(query, x[rows])
    order = np.lexsort((ids[rows], -scores))[:k]
    return ids[rows[order]], scores[order]


def search(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    parts: int | None = None,
    probes: int | None = None,
    sample: int = SAMPLE,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose vec_id ``every`` divides.

    Vectors that are null, zero, or hold null or non-finite components take no part,
    nor do those of another length than the most frequent one of the sample. Every
    other row is filed, but for those without an id, which no result could name. Rows with the query's id
    aren't its candidates; repeated rows count each as candidates and once as a query. Different vectors
    under one id are queries of their own, ranked each under that id. A part's rows are dealt to blocks by hash of the id, as are its
    queries, so no task holds a part; blocks of rows meet blocks of queries. Where ``parts`` isn't given it
    grows with the rows, and where ``probes`` isn't given the sample's held-out rows decide.
    """
    schema = "query_id long, asked long, vec_id long, score double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(sample).select("v").toPandas()["v"].tolist()
    lengths = [len(v) for v in drawn]
    dimension = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 1
    if parts is None:
        parts, n = PARTS, rows.count()
        while parts < MAX_PARTS and parts * ROWS < n:
            parts *= 2
    router, enough = train_router(np.array([v for v in drawn if len(v) == dimension], np.float64).reshape(-1, dimension), parts)
    probes = probes or enough
    rows = rows.filter(F.size("v") == dimension)
    weights = vectors.sparkSession.sparkContext.broadcast(router)  # its size is set by dimension and parts

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch["v"], dimension)
            p = weights.value.probabilities(x / np.linalg.norm(x, axis=1, keepdims=True))
            order = np.argsort(-p, axis=1, kind="stable")[:, :probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["v"], pa.array(list(order), pa.list_(pa.int32()))], ["vec_id", "v", "routes"]
            )

    filed = written(rows.mapInArrow(route, "vec_id long, v array<double>, routes array<int>"), "ann-index")
    asking = F.col("vec_id") % every == 0
    queries = filed.filter(asking).dropDuplicates(["vec_id", "v"])
    held = filed.groupBy(F.col("routes")[0].alias("part")).agg(F.count("*").alias("n")).collect()  # a row per part
    asked = queries.select(F.explode("routes").alias("part")).groupBy("part").agg(F.count("*").alias("n")).collect()
    cuts = {r.part: -(-r.n // block) for r in held}
    turns = {r.part: -(-r.n // block) for r in asked}

    def number(table: dict[int, int], part: Column) -> Column:
        return F.coalesce(F.element_at(F.array(*(F.lit(table.get(p, 1)) for p in range(parts))), part + 1), F.lit(1))

    part = F.col("routes")[0]
    every_turn = F.explode(F.sequence(F.lit(0), number(turns, part) - 1))
    index = filed.select("vec_id", "v", part.alias("part"), every_turn.alias("turn")).withColumn(
        "cut", F.pmod(F.xxhash64("vec_id", "v"), number(cuts, F.col("part"))).cast("int")
    )
    probed = queries.select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("asked"), "v", F.explode("routes").alias("part"))
    every_cut = F.explode(F.sequence(F.lit(0), number(cuts, F.col("part")) - 1))
    probed = probed.select(
        "query_id", "asked", "v", "part", F.pmod(F.xxhash64("query_id", "asked"), number(turns, F.col("part"))).cast("int").alias("turn"), every_cut.alias("cut")
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int, float]] = []
        if left.num_rows and right.num_rows:
            ids, x = np.asarray(left["vec_id"].combine_chunks()), _rows(left["v"], dimension)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            q = _rows(right["v"], dimension)
            for i, (query_id, asked) in enumerate(zip(right["query_id"].to_pylist(), right["asked"].to_pylist(), strict=True)):
                near = unit @ (q[i] / np.linalg.norm(q[i]))
                found += ((query_id, asked, int(a), float(b)) for a, b in zip(*best(q[i], query_id, ids, x, near, k), strict=True))
        columns = zip(*found, strict=True) if found else ((), (), (), ())
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["query_id", "asked", "vec_id", "score"])

    keys = ("part", "turn", "cut")
    candidates = index.groupBy(*keys).cogroup(probed.groupBy(*keys)).applyInArrow(compare, schema)
    order = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    ranked = candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
