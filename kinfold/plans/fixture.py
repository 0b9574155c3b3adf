"""The planted fixture: face and body vectors derived from the ``embeddings`` table (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V

N_PROTOTYPES = 20


def modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, path, face, body, has_face, has_body, label (the given one; -1: none)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", V.doubles(F.col("embedding")).alias("v"), F.col("label").alias("L"))
    last = e.agg(F.max("vec_id")).first()[0] or 0
    p = e.where(F.col("vec_id") < N_PROTOTYPES)  # at most 20 rows
    proto = lambda k, n: F.broadcast(p.select(F.col("vec_id").alias(k), F.col("v").alias(n)))
    r = e.where(F.col("vec_id") >= N_PROTOTYPES).withColumns({"ev": F.col("L") - F.col("L") % 2})
    r = r.withColumns({"b": F.when(F.col("L") == 9, 19).otherwise(10 + F.col("ev")).cast("long"), "w": F.when(F.col("L").isin(5, 7), 0.35).otherwise(0.0), "k1": F.col("L").cast("long"), "k2": F.col("ev").cast("long"), "rev": F.lit(last + N_PROTOTYPES) - F.col("vec_id")})
    r = r.join(proto("k1", "p1"), "k1").join(proto("k2", "p2"), "k2").join(proto("b", "pb"), "b")
    r = r.join(e.select(F.col("vec_id").alias("rev"), F.col("v").alias("vr")), "rev")
    near = V.normalise(F.zip_with("p1", "p2", lambda x, y: x + F.col("w") * y))
    r = r.withColumn("near", near)
    face = F.when(F.col("vec_id") % 11 == 0, F.col("v")).otherwise(V.normalise(F.zip_with("near", "v", lambda x, y: x + F.lit(0.5) * y)))
    body = V.normalise(F.zip_with("pb", "vr", lambda x, y: x + F.lit(0.5) * y))
    r = r.withColumns({"has_face": (F.col("vec_id") % 5 != 0) & (F.col("L") != 9), "has_body": F.col("vec_id") % 7 != 0})
    zero = lambda c: F.transform(c, lambda x: F.lit(0.0))
    path = F.concat(F.lit("img/"), (F.col("vec_id") % 3).cast("string"), F.lit("/"), F.lpad((F.col("vec_id") % 50).cast("string"), 3, "0"), F.lit(".jpg"))
    given = F.when(F.col("has_face") & (F.col("vec_id") % 11 != 0), F.col("L")).otherwise(-1).cast("int")
    return r.select(F.col("vec_id").alias("idx"), path.alias("path"), F.when(F.col("has_face"), face).otherwise(zero(F.col("v"))).alias("face"), F.when(F.col("has_body"), body).otherwise(zero(F.col("v"))).alias("body"), "has_face", "has_body", given.alias("label"))


#: The same in SQL. Every norm is staged, else it is evaluated once per element.
SQL = """
e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label AS L FROM embeddings),
r0 AS MATERIALIZED (SELECT e.*, L - L % 2 AS ev, CASE WHEN L = 9 THEN 19 ELSE 10 + L - L % 2 END AS b, CASE WHEN L IN (5, 7) THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END AS w,
    (SELECT max(vec_id) FROM embeddings) + 20 - vec_id AS rev FROM e WHERE vec_id >= 20),
r1 AS MATERIALIZED (SELECT r0.*, p2.v AS p2, p1.v AS p1, pb.v AS pb, vr.v AS vr FROM r0 JOIN e p1 ON p1.vec_id = r0.L JOIN e p2 ON p2.vec_id = r0.ev
    JOIN e pb ON pb.vec_id = r0.b JOIN e vr ON vr.vec_id = r0.rev),
r2 AS MATERIALIZED (SELECT *, list_transform(list_zip(p1, p2), lambda z: z[1] + w * z[2]) AS m0, list_transform(list_zip(pb, vr), lambda z: z[1] + 0.5::DOUBLE * z[2]) AS b0 FROM r1),
r3 AS MATERIALIZED (SELECT *, sqrt(list_dot_product(m0, m0)) AS mn, sqrt(list_dot_product(b0, b0)) AS bn FROM r2),
r4 AS MATERIALIZED (SELECT *, list_transform(list_zip(m0, v), lambda z: z[1] / mn + 0.5::DOUBLE * z[2]) AS f0 FROM r3),
r5 AS MATERIALIZED (SELECT *, sqrt(list_dot_product(f0, f0)) AS fn FROM r4),
rows AS MATERIALIZED (SELECT vec_id AS idx, 'img/' || (vec_id % 3) || '/' || lpad(CAST(vec_id % 50 AS VARCHAR), 3, '0') || '.jpg' AS path,
    (vec_id % 5 <> 0 AND L <> 9) AS has_face, vec_id % 7 <> 0 AS has_body,
    CASE WHEN vec_id % 5 <> 0 AND L <> 9 THEN CASE WHEN vec_id % 11 = 0 THEN v ELSE list_transform(f0, lambda x: x / fn) END ELSE list_transform(v, lambda x: 0.0::DOUBLE) END AS face,
    CASE WHEN vec_id % 7 <> 0 THEN list_transform(b0, lambda x: x / bn) ELSE list_transform(v, lambda x: 0.0::DOUBLE) END AS body,
    CASE WHEN vec_id % 5 <> 0 AND L <> 9 AND vec_id % 11 <> 0 THEN CAST(L AS INT) ELSE -1 END AS label FROM r5)
"""
