"""The raw layer: immutable Parquet, partitioned so that a reader of one set opens one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .contract import KEYS, RAW, ContractError, validate


def path_of(root: str, user_id: str, date: str, session_id: str, set_index: int) -> str:
    """The folder of one set."""
    return f"{root}/user_id={user_id}/date={date}/session_id={session_id}/set_index={set_index}"


def write(df: DataFrame, root: str, overwrite: bool = False) -> None:
    """Validate and add sets; an error if one is there already, unless ``overwrite`` replaces just those."""
    df = validate(df)
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not overwrite and at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        there = spark.read.schema(RAW).parquet(root).select(*KEYS).distinct()
        if not df.select(*KEYS).distinct().join(there, list(KEYS), "left_semi").isEmpty():
            raise FileExistsError(f"{root} has such a set already; the raw layer is immutable")
    dealt = df.repartition(*KEYS).sortWithinPartitions(*KEYS, "t_ns")
    writer = dealt.write.partitionBy(*KEYS)
    if overwrite:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)
    else:
        writer.mode("append").parquet(root)


def read(spark: SparkSession, root: str, check: bool = True, **keys: str | int) -> DataFrame:
    """Samples of the sets with these partition keys (all without any), in canonical order; checked again."""
    if bad := set(keys) - set(KEYS):
        raise ContractError(f"not a partition key: {', '.join(sorted(bad))}")
    df = spark.read.schema(RAW).parquet(root)
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    return validate(df) if check else df.select(*[f.name for f in RAW])
