"""Queries over feature vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.functions.numeric import rounded
from foliomill.operators import neighbours as nb
from foliomill.operators import oversample as ov
from foliomill.operators import quantiles as qt
from foliomill.plans import tables as tb
from foliomill.plans.registry import query


def _points(spark, sf_dir):
    return tb.table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vec")
    )


@query(
    """WITH long AS (
      SELECT unnest(range(0, len(embedding))) AS feature, unnest(embedding)::DOUBLE AS v FROM embeddings
    )
    SELECT CAST(feature AS INTEGER) AS feature, round(quantile_cont(v, 0.25), 6) AS q25,
           round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75
    FROM long GROUP BY feature"""
)
def feature_quantiles(spark, sf_dir):
    quantiles = qt.feature_quantiles(_points(spark, sf_dir), "vec")
    return quantiles.select("feature", *[rounded(F.col(q)).alias(q) for q in ("q25", "q50", "q75")])


_NEAR_SQL = """
points AS (SELECT vec_id, label, embedding::DOUBLE[] AS vec FROM embeddings),
distances AS (
  SELECT a.vec_id, a.label, b.vec_id AS neighbour_id,
         round(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS d2
  FROM points a JOIN points b ON b.label = a.label AND b.vec_id <> a.vec_id
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, neighbour_id) AS place FROM distances
),
near AS (SELECT * FROM placed WHERE place <= 5)"""


@query(
    f"""WITH {_NEAR_SQL}
    SELECT vec_id, label, neighbour_id, CAST(place AS INTEGER) AS place, round(d2, 6) AS distance2 FROM near"""
)
def knn_within_class(spark, sf_dir):
    near = nb.knn_within_class(_points(spark, sf_dir), "vec_id", "label", "vec", k=5)
    return near.withColumn("distance2", rounded(F.col("distance2")))


@query(
    f"""WITH {_NEAR_SQL}
    SELECT vec_id, label, neighbour_id, CAST(place AS INTEGER) AS place, round(d2, 6) AS distance2 FROM near"""
)
def knn_by_descent(spark, sf_dir):
    """The neighbour graph by descent. It is exact, and so equals the SQL, while classes have up to 512 rows;
    a test measures the recall in larger ones."""
    near = nb.knn_within_class(_points(spark, sf_dir), "vec_id", "label", "vec", k=5, method="descent")
    return near.withColumn("distance2", rounded(F.col("distance2")))


@query(
    f"""WITH {_NEAR_SQL},
    counts AS (SELECT label, count(*) AS n, max(count(*)) OVER () - count(*) AS needed FROM points GROUP BY label),
    ranked AS (
      SELECT vec_id, label, vec,
             row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) - 1 AS rank
      FROM points
    ),
    numbered AS (SELECT label, n, unnest(range(0, needed)) AS pick FROM counts WHERE needed > 0),
    picked AS (
      SELECT label, n, pick, md5('42:' || label || ':' || pick) AS h FROM numbered
    ),
    choice AS (
      SELECT label, pick, ('0x' || substr(h, 1, 8))::BIGINT % n AS rank,
             ('0x' || substr(h, 9, 8))::BIGINT % greatest(least(5, n - 1), 1) + 1 AS place,
             ('0x' || substr(h, 17, 8))::BIGINT / 4294967296.0::DOUBLE AS step
      FROM picked
    ),
    ends AS (
      SELECT c.label, c.pick, c.step, r.vec AS x, coalesce(p.vec, r.vec) AS y
      FROM choice c JOIN ranked r ON r.label = c.label AND r.rank = c.rank
      LEFT JOIN near k ON k.vec_id = r.vec_id AND k.place = c.place
      LEFT JOIN points p ON p.vec_id = k.neighbour_id
    )
    SELECT label, pick, unnest(range(0, len(x))) AS position,
           round(unnest(list_transform(list_zip(x, y), lambda z: z[1] + step * (z[2] - z[1]))), 6) + 0.0::DOUBLE AS value
    FROM ends"""
)
def oversample(spark, sf_dir):
    made = ov.oversample(_points(spark, sf_dir), "vec_id", "label", "vec")
    return made.select("label", "pick", F.posexplode("vec").alias("position", "value")).select(
        "label", "pick", F.col("position").cast("bigint").alias("position"), rounded(F.col("value")).alias("value")
    )
