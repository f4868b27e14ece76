"""The driver's tables in the shape the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded for comparison, without negative zeros. What is added first settles exact halves the same way
    whatever the last bits are."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((F.round(c + F.lit(3.1e-9), special.get(name, digits)) + F.lit(0.0)).alias(name) if kind in ("double", "float") else c)
    return df.select(*out)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, i (place in time order), t (seconds), value, event_type, event_id, props."""
    df = table(spark, sf_dir, "events")
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) / 1e6")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    return df.select("user_id", i.alias("i"), t.alias("t"), "value", "event_type", "event_id", "props")


#: The same in DuckDB, for the head of a query.
EVENTS = "ev AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, epoch_us(ts) / 1e6 AS t, value, event_type, event_id, props FROM events)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as repetitions: set_id, rep_index from 1, completed, four channels, velocity."""
    df = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return df.select(
        F.col("l_orderkey").alias("set_id"),
        F.row_number().over(w).cast("long").alias("rep_index"),
        (F.col("l_returnflag") != "R").alias("completed"),
        F.col("l_quantity").alias("rom"),
        (F.col("l_discount") + 0.01).alias("path"),
        (F.col("l_extendedprice") / 1000.0).alias("ecc"),
        (F.col("l_tax") + 0.01).alias("tremor"),
        F.col("l_partkey").alias("part_id"),
    )


LINES = "li AS (SELECT l_orderkey AS set_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS rep_index, l_returnflag <> 'R' AS completed, l_quantity AS rom, l_discount + 0.01::DOUBLE AS path, l_extendedprice / 1000.0::DOUBLE AS ecc, l_tax + 0.01::DOUBLE AS tremor, l_partkey AS part_id FROM lineitem)"


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as sets: set_id, user_id, exercise, failed, day, load."""
    df = table(spark, sf_dir, "orders")
    return df.select(F.col("o_orderkey").alias("set_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("exercise"), (F.col("o_orderstatus") == "F").alias("failed"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("load"))


SETS = "se AS (SELECT o_orderkey AS set_id, o_custkey AS user_id, o_orderpriority AS exercise, o_orderstatus = 'F' AS failed, CAST(o_orderdate AS DATE) AS day, o_totalprice AS load FROM orders)"


def r(expr: str, digits: int = 6) -> str:
    """DuckDB's twin of :func:`rounded`."""
    return f"(round({expr} + 3.1e-9, {digits}) + 0.0)"
