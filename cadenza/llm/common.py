"""What several operators share: the folder all executors see, written stages, and graph components."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path below the cluster's shared folder (``spark.checkpoint.dir``).

    Only where that setting is missing and the master is local, as in a test, a temporary folder stands in for it; on a
    cluster executors would not see each other's files there, so the setting is asked for.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.get(spark.sparkContext.applicationId)
        if base is None:
            base = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="cadenza-")
    path = f"{base.rstrip('/')}/cadenza-{purpose}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended before
        pass


def written(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet and read it again: cuts the lineage and survives lost executors."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what Python holds at once stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def release() -> None:
    """Give memory that ended tasks freed back to the system: Python workers live on from stage to stage, and what they
    keep counts against their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def components(edges: DataFrame, purpose: str = "components", most: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has the long columns ``u`` and ``v``. Returns ``id, component`` with the smallest id of each
    component, a row per vertex that has an edge to another one. Every step is a grouped minimum (combined
    before the shuffle) and a join back, so a vertex with very many neighbours is split like any skewed join.
    No edge or label comes to the driver; only a count and a checksum do.
    """
    spark = edges.sparkSession
    base = shared_dir(spark, purpose)
    cur = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{base}/0")
    state = _state(cur)
    for step in range(1, most):
        if state[0] == 0:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        cur = written(small.where("u <> v").distinct(), f"{base}/{step}")
        before, state = state, _state(cur)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
