"""Metadata tables: upserts by primary key, point look-ups, foreign keys, and the feature blob as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .contract import REP_FEATURES, REPS, SESSIONS, SETS

TABLES = {"sessions": (SESSIONS, "session_id"), "sets": (SETS, "set_id"), "reps": (REPS, "rep_id"), "rep_features": (REP_FEATURES, "rep_id")}
FOREIGN = (("sets", "session_id", "sessions"), ("reps", "set_id", "sets"), ("rep_features", "rep_id", "reps"))


def latest(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """The last written row of each key."""
    w = Window.partitionBy(key).orderBy(F.col(sequence).desc())
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def rep_id(set_id: Column, rep_index: Column) -> Column:
    return F.format_string("%s:rep%03d", set_id, rep_index)


def set_id(session_id: Column, set_index: Column) -> Column:
    return F.format_string("%s:set%03d", session_id, set_index)


def orphans(child: DataFrame, key: str, parent: DataFrame) -> DataFrame:
    """Rows whose key the parent table lacks."""
    return child.join(parent.select(key), key, "left_anti")


class MetadataStore:
    """Four append-only Parquet tables below ``root``; a read takes the last write of each key.

    Usable as a context manager, for symmetry with stores that hold a connection; nothing is held here.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def __enter__(self) -> MetadataStore:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        pass

    def _raw(self, name: str) -> DataFrame:
        schema = f"{TABLES[name][0]}, written_seq long"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def table(self, name: str) -> DataFrame:
        return latest(self._raw(name), TABLES[name][1], "written_seq").drop("written_seq")

    def add(self, name: str, rows: DataFrame) -> None:
        """Insert or replace; rows whose parent is missing are an error."""
        for child, key, parent in FOREIGN:
            if child == name and not orphans(rows, key, self.table(parent)).isEmpty():
                raise ValueError(f"{name} refers to a {key} that {parent} lacks")
        names = [c.strip().split(" ")[0] for c in TABLES[name][0].split(",")]
        seq = (self._raw(name).agg(F.max("written_seq")).first()[0] or 0) + 1
        rows.select(*names, F.lit(seq).cast("long").alias("written_seq")).write.mode("append").parquet(f"{self.root}/{name}")

    def add_sessions(self, rows: DataFrame) -> None:
        self.add("sessions", rows)

    def add_sets(self, rows: DataFrame) -> None:
        self.add("sets", rows)

    def add_reps(self, rows: DataFrame) -> None:
        self.add("reps", rows.withColumn("rep_id", rep_id(F.col("set_id"), F.col("rep_index"))))

    def add_rep_features(self, rows: DataFrame) -> None:
        """``rows`` has rep_id and the features as further columns."""
        self.add("rep_features", rows.select("rep_id", F.to_json(F.struct(*[c for c in rows.columns if c != "rep_id"])).alias("features")))

    def session(self, session_id: str) -> DataFrame:
        return self.table("sessions").where(F.col("session_id") == session_id)

    def set(self, set_id: str) -> DataFrame:
        return self.table("sets").where(F.col("set_id") == set_id)

    def sets_of(self, session_id: str) -> DataFrame:
        return self.table("sets").where(F.col("session_id") == session_id).orderBy("set_index")

    def reps_of(self, set_id: str) -> DataFrame:
        return self.table("reps").where(F.col("set_id") == set_id).orderBy("rep_index")

    def features_of(self, rep_id: str, schema: str) -> DataFrame:
        return self.table("rep_features").where(F.col("rep_id") == rep_id).select("rep_id", F.from_json("features", schema).alias("f")).select("rep_id", "f.*")
