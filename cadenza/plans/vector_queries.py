"""Registered queries of the vector operators and rotations, on embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import reps, vectors
from .tables import r, rounded, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))


@query(f"WITH e AS (SELECT label, unnest(embedding)::DOUBLE v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT CAST(label AS BIGINT) AS label, CAST(pos AS BIGINT) AS pos, {r('avg(v)')} AS v, count(*) AS n FROM e GROUP BY 1, 2")
def vector_template_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reps.template(_vectors(spark, sf_dir), ["label"], "v")
    out = found.select("label", F.posexplode("template").alias("pos", "v"), F.col("n_profiles").alias("n"))
    return rounded(out.select("label", F.col("pos").cast("long").alias("pos"), "v", "n"))


@query(f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] v, len(embedding) n, unnest(generate_series(0, 95)) k FROM embeddings), a AS (SELECT *, k * (n - 1) / 95.0::DOUBLE p, least(floor(k * (n - 1) / 95.0::DOUBLE), n - 2)::INT f FROM e) SELECT vec_id, CAST(k AS BIGINT) AS pos, {r('v[f + 1] + (v[f + 2] - v[f + 1]) * (p - f)')} AS v FROM a")
def vector_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components on 96 points."""
    df = _vectors(spark, sf_dir)
    df = df.select("vec_id", F.posexplode(vectors.resampled(F.col("v"), 96)).alias("pos", "v"))
    return rounded(df.select("vec_id", F.col("pos").cast("long").alias("pos"), "v"))


@query(f"WITH m AS (SELECT vec_id, embedding::DOUBLE[] v, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) p FROM embeddings), u AS (SELECT vec_id, p, unnest(v) x, generate_subscripts(v, 1) - 1 AS pos FROM m) SELECT vec_id, CAST(pos AS BIGINT) AS pos, {r('CASE WHEN p > 1e-9 THEN x / p ELSE x END')} AS v FROM u")
def vector_unit_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir).select("vec_id", F.posexplode(vectors.unit_peak(F.col("v"))).alias("pos", "v"))
    return rounded(df.select("vec_id", F.col("pos").cast("long").alias("pos"), "v"))


@query()
def vector_dtw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warping distance of the first half of each vector to its second half, without SQL."""
    half = F.floor(F.size("v") / 2).cast("int")
    df = _vectors(spark, sf_dir)
    return rounded(df.select("vec_id", vectors.dtw_distance(F.slice("v", F.lit(1), half), F.slice("v", half + 1, F.size("v") - half)).alias("distance")))


@query()
def vector_dtw_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warping distance of each whole vector to its label's mean."""
    df = _vectors(spark, sf_dir)
    both = df.join(reps.template(df, ["label"], "v"), "label")
    return rounded(both.select("vec_id", vectors.dtw_distance("v", "template").alias("distance")))


@query()
def vector_sparc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors.smoothness(_vectors(spark, sf_dir), "vec_id", "v", 100.0))


ROTATED = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), n AS (SELECT vec_id, v[5] x, v[6] y, v[7] z, sqrt(v[1]*v[1]+v[2]*v[2]+v[3]*v[3]+v[4]*v[4]) m, v[1]/m w, v[2]/m a, v[3]/m b, v[4]/m c FROM e)"


@query(f"{ROTATED} SELECT vec_id, {r('(1-2*(b*b+c*c))*x + 2*(a*b-w*c)*y + 2*(a*c+w*b)*z')} AS x, {r('2*(a*b+w*c)*x + (1-2*(a*a+c*c))*y + 2*(b*c-w*a)*z')} AS y, {r('2*(a*c-w*b)*x + 2*(b*c+w*a)*y + (1-2*(a*a+b*b))*z')} AS z FROM n")
def quaternion_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = [F.col("v")[k] for k in range(7)]
    x, y, z = columns.rotate(tuple(v[:4]), tuple(v[4:7]))
    return rounded(_vectors(spark, sf_dir).select("vec_id", x.alias("x"), y.alias("y"), z.alias("z")))


@query(f"{ROTATED} SELECT vec_id, {r('x')} AS x, {r('y')} AS y, {r('z')} AS z, {r('1.0::DOUBLE')} AS w FROM n")
def quaternion_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotated there and back; w is the scalar of the unit quaternion times its conjugate."""
    v = [F.col("v")[k] for k in range(7)]
    q = tuple(v[:4])
    x, y, z = columns.rotate_inverse(q, columns.rotate(q, tuple(v[4:7])))
    unit = columns.quat_normalize(q)
    w = columns.quat_multiply(unit, columns.quat_conjugate(unit))[0]
    return rounded(_vectors(spark, sf_dir).select("vec_id", x.alias("x"), y.alias("y"), z.alias("z"), w.alias("w")))
