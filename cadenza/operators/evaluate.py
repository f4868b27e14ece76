"""Evaluation: splits by user, calibration, rank statistics, concordance, accuracy and collinearity."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_by_user(df: DataFrame, user: str, test_users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of users that aren't and that are in ``test_users``: an anti and a semi join."""
    return df.join(test_users, user, "left_anti"), df.join(test_users, user, "left_semi")


def draw_users(users: list, share: float = 0.3, seed: int = 0) -> list:
    """Users held out: the first max(1, round(n share)) of a seeded shuffle of the sorted list."""
    order = np.random.default_rng(seed).permutation(len(users))
    names = sorted(users)
    return [names[i] for i in order[: max(1, round(len(names) * share))]]


def standardized(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds z_<column>: less the mean, over the population deviation (1 where that is below 1e-9)."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    df = df.crossJoin(F.broadcast(stats))  # a single row
    return df.withColumns({f"z_{c}": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-9, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}).drop(*stats.columns)


def calibration(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Per bin that has rows: their number, mean prediction and share of events."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long").alias("bin")
    return df.groupBy(b).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed"))


def calibration_mad(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    return calibration(df, p, y, bins).agg(F.avg(F.abs(F.col("predicted") - F.col("observed"))).alias("mad"))


def auc(df: DataFrame, score: str, y: str, ranges: int = 256) -> DataFrame:
    """One row: the chance that an event scores higher than another row, ties counting half.

    Counts per score come first; distinct scores are then cut into ``ranges`` by approximate quantiles, each range adds up
    its own, and what lies in lower ranges is added from their totals, a row each.
    """
    per = df.groupBy(F.col(score).cast("double").alias("_score")).agg(F.count("*").alias("_n"), F.sum((F.col(y) == 1).cast("long")).alias("_p"))
    cuts = sorted(set(per.agg(F.percentile_approx("_score", [k / ranges for k in range(1, ranges)])).first()[0] or []))
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("_score"))) if cuts else F.lit(0)
    per = per.withColumn("_range", at)
    below = F.sum(F.col("_n") - F.col("_p"))
    lower = per.groupBy("_range").agg(below.alias("_own")).withColumn("_lower", F.coalesce(F.sum("_own").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_own")
    within = Window.partitionBy("_range").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_below", F.coalesce(below.over(within), F.lit(0))).join(F.broadcast(lower), "_range").withColumn("_below", F.col("_below") + F.col("_lower"))
    pairs = F.sum(F.col("_p") * F.col("_below") + 0.5 * F.col("_p") * (F.col("_n") - F.col("_p")))
    return per.agg((pairs / (F.sum("_p") * F.sum(F.col("_n") - F.col("_p")))).alias("auc"))


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def concordance(df: DataFrame, group: str, truth: str, predicted: str) -> DataFrame:
    """Per group: pairs of different truth whose predictions agree in order (near ties count half), over all of them.

    Groups are sets, so pairs within one are few.
    """
    a, b = df.alias("a"), df.alias("b")
    pairs = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{truth}") < F.col(f"b.{truth}")))
    x, y = F.col(f"a.{predicted}"), F.col(f"b.{predicted}")
    gain = F.when(close(x, y), 0.5).when(x < y, 1.0).otherwise(0.0)
    return pairs.groupBy(F.col(f"a.{group}").alias(group)).agg(F.count("*").alias("pairs"), F.avg(gain).alias("concordance"))


def within(df: DataFrame, truth: str, predicted: str, tolerance: float = 1.0) -> Column:
    return F.avg((F.abs(F.col(predicted) - F.col(truth)) <= tolerance + 1e-9).cast("double"))


def majority(df: DataFrame, level: str, order: str) -> DataFrame:
    """The most frequent level, the first seen of equals."""
    per = df.groupBy(level).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return per.orderBy(F.col("n").desc(), "_first").limit(1).select(level, "n")


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation, 0 where either hardly varies; an error below three rows."""
    row = df.agg(F.count("*").alias("n"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"), F.corr(a, b).alias("r"))
    r = F.when(F.col("n") < 3, F.raise_error(F.lit("correlation needs three rows")).cast("double")).when((F.col("sa") < 1e-12) | (F.col("sb") < 1e-12), 0.0).otherwise(F.col("r"))
    return row.select(r.alias("r"))


def vif(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Variance inflation of each column: the diagonal of the inverted correlation matrix, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs]).first()
    m = np.eye(len(columns))
    for a, b in pairs:
        i, j = columns.index(a), columns.index(b)
        m[i, j] = m[j, i] = row[f"{a}|{b}"] or 0.0
    d = np.diag(np.linalg.pinv(m, rcond=1e-12))
    return {c: float(min(max(x, 1.0), 1e9)) for c, x in zip(columns, d, strict=True)}


def gates(metrics: list[DataFrame]) -> DataFrame:
    """All metrics in one table with ``passed``; null thresholds pass or fail nothing."""
    return reduce(DataFrame.unionByName, metrics).withColumn("passed", F.when(F.col("threshold").isNotNull(), F.when(F.col("higher_is_better"), F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))))


def all_passed(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"))
