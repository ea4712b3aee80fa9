"""Queries of vectors and matrices over the embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import matrices as M
from quern.functions import vectors as V

from .common import query, table

LONG = "x AS (SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
PAIR = LONG + ", y AS (SELECT a.vec_id, a.i, a.x, b.x AS y FROM x a JOIN x b ON b.vec_id = a.vec_id + 1 AND b.i = a.i)"


def vecs(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))


def pairs(spark, d) -> DataFrame:
    """Each vector v with the next one, w."""
    a = vecs(spark, d)
    return a.select("vec_id", "v").join(a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")


def spread(df: DataFrame, **columns) -> DataFrame:
    """(vec_id, i, ...) of columns that are vectors of one length."""
    d = df.select("vec_id", *(c.alias(k) for k, c in columns.items())).select("vec_id", F.posexplode(F.arrays_zip(*columns)).alias("i", "z"))
    return d.select("vec_id", F.col("i").cast("long").alias("i"), *(F.round(F.col(f"z.{k}"), 6).alias(k) for k in columns))


@query(f"WITH {LONG} SELECT vec_id, count(*) AS length, count(CASE WHEN x <> 0 THEN 1 END) AS active, CAST(0 AS BIGINT) AS zeros, count(*) AS sparse_size FROM x GROUP BY 1")
def vec_shape(spark, d):
    v = F.col("v")
    zeros = V.active_size(V.dense_zeros(8))
    return vecs(spark, d).select("vec_id", *(c.cast("long").alias(k) for k, c in (("length", V.length(v)), ("active", V.active_size(v)), ("zeros", zeros), ("sparse_size", V.length(V.to_dense(V.to_sparse(v)))))))


@query(f"WITH {LONG} SELECT vec_id, round(max(CASE WHEN i = 3 THEN x END), 6) AS third, round(sum(CASE WHEN i = 3 THEN 2.5::DOUBLE ELSE x END), 4) AS total FROM x GROUP BY 1")
def vec_get_set(spark, d):
    total = F.aggregate(V.put(F.col("v"), 3, 2.5), F.lit(0.0), lambda s, x: s + x)
    return vecs(spark, d).select("vec_id", F.round(V.get(F.col("v"), 3), 6).alias("third"), F.round(total, 4).alias("total"))


@query(f"WITH {PAIR} SELECT vec_id, i - 4 AS i, round(x, 6) + 0::DOUBLE AS x FROM y WHERE i >= 4 AND i < 12 UNION ALL SELECT vec_id, i + 8, round(y, 6) + 0::DOUBLE FROM y")
def vec_slice_concat(spark, d):
    return spread(pairs(spark, d), x=V.concat(V.cut(F.col("v"), 4, 12), F.col("w")))


@query(f"WITH {LONG} SELECT vec_id, i, round(x + 1.5::DOUBLE, 6) AS plus, round(x - 0.25::DOUBLE, 6) AS minus, round(x * 3::DOUBLE, 6) + 0::DOUBLE AS scaled, round(x / 8::DOUBLE, 6) + 0::DOUBLE AS divided FROM x")
def vec_scalar_ops(spark, d):
    v = F.col("v")
    return spread(vecs(spark, d), plus=V.add_scalar(v, 1.5), minus=V.sub_scalar(v, 0.25), scaled=V.scale(v, 3.0), divided=V.div(v, 8.0))


@query(f"WITH {PAIR} SELECT vec_id, i, round(x + y, 6) AS plus, round(x - y, 6) AS minus FROM y")
def vec_vec_ops(spark, d):
    return spread(pairs(spark, d), plus=V.add(F.col("v"), F.col("w")), minus=V.sub(F.col("v"), F.col("w")))


@query(f"WITH {PAIR} SELECT vec_id, i, round(y + 0.5::DOUBLE * x, 6) AS y FROM y")
def vec_axpy(spark, d):
    return spread(pairs(spark, d), y=V.axpy(0.5, F.col("v"), F.col("w")))


@query(f"WITH {PAIR} SELECT vec_id, round(sum(x * y), 5) AS dot, round(sum(x * x), 5) AS own FROM y GROUP BY 1")
def vec_dot(spark, d):
    return pairs(spark, d).select("vec_id", F.round(V.dot(F.col("v"), F.col("w")), 5).alias("dot"), F.round(V.dot(F.col("v"), F.col("v")), 5).alias("own"))


@query(f"WITH {LONG} SELECT vec_id, i, round(x, 6) + 0::DOUBLE AS x FROM x")
def vec_explode(spark, d):
    return vecs(spark, d).select("vec_id", V.entries(F.col("v"))).select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


MAT = "m AS (SELECT vec_id AS i, unnest(range(len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def mat(spark, d) -> DataFrame:
    return M.from_rows(table(spark, d, "embeddings"), "vec_id", "embedding")


def rounded(m: DataFrame, places: int = 5) -> DataFrame:
    return m.select("i", "j", F.round("v", places).alias("v"))


@query(f"WITH {MAT} SELECT max(i) + 1 AS n_rows, max(j) + 1 AS n_cols, count(CASE WHEN v <> 0 THEN 1 END) AS active FROM m")
def mat_shape(spark, d):
    return M.shape(mat(spark, d))


@query(f"WITH {MAT} SELECT i - 5 AS i, j - 2 AS j, round(v, 5) + 0::DOUBLE AS v FROM m WHERE i >= 5 AND i < 1000000 AND j >= 2 AND j < 7")
def mat_slice(spark, d):
    return rounded(M.slice_columns(M.slice_rows(mat(spark, d), 5, 1_000_000), 2, 7))


@query(f"WITH {MAT} SELECT i, j, round(CASE WHEN j = 3 THEN -v ELSE v END, 5) + 0::DOUBLE AS v FROM m")
def mat_put(spark, d):
    m = mat(spark, d)
    return rounded(M.put(m, M.with_scalar(m.where("j = 3"), lambda v: -v)))


@query(f"WITH {MAT} SELECT j AS i, i AS j, round(v, 5) + 0::DOUBLE AS v FROM m")
def mat_transpose(spark, d):
    return rounded(M.transpose(mat(spark, d)))


@query(f"WITH {MAT} SELECT i, j, round(((v + 2::DOUBLE) * 3::DOUBLE - 1::DOUBLE) / 4::DOUBLE, 5) AS v FROM m")
def mat_scalar_ops(spark, d):
    return rounded(M.with_scalar(mat(spark, d), lambda v: ((v + 2.0) * 3.0 - 1.0) / 4.0))


@query(f"WITH {MAT}, n AS (SELECT i + 1 AS i, j, v FROM m) SELECT i, j, round(coalesce(m.v, 0) + 2 * coalesce(n.v, 0), 5) + 0::DOUBLE AS v, round(coalesce(m.v, 0) * coalesce(n.v, 0), 5) + 0::DOUBLE AS product FROM m FULL JOIN n USING (i, j)")
def mat_elementwise(spark, d):
    m = mat(spark, d)
    n = m.withColumn("i", F.col("i") + 1)
    both = M.elementwise(m, n, lambda x, y: F.struct(F.round(x + 2 * y, 5).alias("v"), F.round(x * y, 5).alias("product")))
    return both.select("i", "j", "v.v", "v.product")


@query(f"WITH {MAT} SELECT i, round(sum(v * (j + 1)), 4) AS v FROM m GROUP BY 1")
def mat_vec_mul(spark, d):
    m = mat(spark, d)
    x = m.select("j").distinct().select("j", (F.col("j") + 1).cast("double").alias("x"))
    return M.times_vector(m, x).select("i", F.round("v", 4).alias("v"))


@query(f"WITH {MAT} SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 4) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY 1, 2")
def mat_mat_mul(spark, d):
    m = mat(spark, d)
    return rounded(M.times(M.transpose(m), m), 4)


@query(f"WITH {MAT}, s AS (SELECT max(i) + 1 AS r, max(j) + 1 AS c FROM m), w AS (SELECT i, j, v FROM m UNION ALL SELECT i, j + c, v FROM m, s) SELECT i, j, round(v, 5) + 0::DOUBLE AS v FROM w UNION ALL SELECT i + r, j, round(v, 5) + 0::DOUBLE FROM w, s")
def mat_concat(spark, d):
    m = mat(spark, d)
    rows, columns, _ = M.shape(m).first()
    wide = M.beside(m, m, columns)
    return rounded(M.below(wide, wide, rows))
