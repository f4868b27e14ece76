"""Operators on ordered sequences. ``key`` separates sequences, ``order`` has no ties within one, ``x`` is the signal.

Each is one exchange on ``key``; every later window and aggregate of the same key reuses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(key: str, *order: str | Column):
    return Window.partitionBy(key).orderBy(*order)


def numbered(df: DataFrame, key: str, *order: str, name: str = "i") -> DataFrame:
    """Adds the place of each row in its sequence, from 0."""
    return df.withColumn(name, F.row_number().over(_by(key, *order)).cast("long") - 1)


def steps(df: DataFrame, key: str, order: str, limit: float | None = None) -> DataFrame:
    """Adds ``dt``, the step from the row before, and ``gap``, whether it exceeds ``limit``."""
    df = df.withColumn("dt", F.col(order) - F.lag(order).over(_by(key, order)))
    return df if limit is None else df.withColumn("gap", F.coalesce(F.col("dt") > limit, F.lit(False)))


def gap_intervals(df: DataFrame, key: str, order: str, limit: float) -> DataFrame:
    """Key, start and end of every step longer than ``limit``."""
    df = df.withColumn("gap_start", F.lag(order).over(_by(key, order)))
    return df.where(F.col(order) - F.col("gap_start") > limit).select(key, "gap_start", F.col(order).alias("gap_end"))


def in_intervals(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Points in any interval of their key, both ends included."""
    p, s = points.alias("p"), spans.alias("s")
    return p.join(s, (F.col(f"p.{key}") == F.col(f"s.{key}")) & F.col(f"p.{at}").between(F.col(f"s.{start}"), F.col(f"s.{end}")), "left_semi")


def lerp(df: DataFrame, key: str, at: str, known_at: str, columns: list[str]) -> DataFrame:
    """Linear interpolation, flat beyond the ends, where ``columns`` are null.

    ``known_at`` is ``at`` on rows that know the columns and null elsewhere: an as-of look-up in both directions by two
    windows over the same exchange. The one ahead runs from the end, as a frame that shrinks would be added up anew for
    every row; of rows at the same place those that know come first in either.
    """
    back = Window.partitionBy(key).orderBy(F.col(at), F.col(known_at).isNull()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(known_at).isNull()).rowsBetween(Window.unboundedPreceding, 0)
    here = F.col(at)
    df = df.withColumns({"_t0": F.last(known_at, ignorenulls=True).over(back), "_t1": F.last(known_at, ignorenulls=True).over(ahead)})
    ends = {}
    for c in columns:
        ends |= {f"_{c}0": F.last(c, ignorenulls=True).over(back), f"_{c}1": F.last(c, ignorenulls=True).over(ahead)}
    df = df.withColumns(ends)
    t0, t1 = F.col("_t0"), F.col("_t1")
    for c in columns:
        a, b = F.col(f"_{c}0"), F.col(f"_{c}1")
        df = df.withColumn(c, F.when(t0.isNull() | t1.isNull() | (t0 == t1), F.coalesce(a, b)).otherwise(a + (b - a) * (here - t0) / (t1 - t0)))
    return df.drop("_t0", "_t1", *ends)


def resample(df: DataFrame, key: str, at: str, columns: list[str], step: float) -> DataFrame:
    """Columns on the uniform grid first, first + step, ... of each key, by linear interpolation."""
    bounds = df.groupBy(key).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    grid = bounds.select(key, F.explode(F.expr(f"sequence(0L, cast(floor((_b - _a) / {step}) as long))")).alias("n"), "_a")
    grid = grid.select(key, "n", (F.col("_a") + F.col("n") * F.lit(step)).alias(at), *[F.lit(None).cast("double").alias(c) for c in columns], F.lit(None).cast("double").alias("_k"))
    known = df.select(key, F.lit(None).cast("long").alias("n"), F.col(at).cast("double").alias(at), *columns, F.col(at).cast("double").alias("_k"))
    return lerp(known.unionByName(grid), key, at, "_k", columns).where("n is not null").select(key, "n", at, *columns)


def trapezoid(df: DataFrame, key: str, order: str, x: str, name: str, dt: Column | float) -> DataFrame:
    """Adds the running integral of ``x``, 0 at the first row; ``dt`` is the step before a row."""
    w = _by(key, order)
    part = (F.col(x) + F.lag(x).over(w)) / 2 * dt
    return df.withColumn("_part", F.coalesce(part, F.lit(0.0))).withColumn(name, F.sum("_part").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_part")


def zero_velocity(df: DataFrame, key: str, order: str, x: str, anchor: str, dt: float) -> DataFrame:
    """Adds ``velocity``, the integral of ``x`` less its drift at anchors (interpolated, flat beyond them), and
    ``displacement``, the integral of that. Without anchors nothing is subtracted."""
    df = trapezoid(df, key, order, x, "_raw", dt)
    df = df.withColumns({"_drift": F.when(F.col(anchor), F.col("_raw")), "_at": F.when(F.col(anchor), F.col(order).cast("double"))})
    df = lerp(df, key, order, "_at", ["_drift"])
    df = df.withColumn("velocity", F.col("_raw") - F.coalesce("_drift", F.lit(0.0)))
    return trapezoid(df, key, order, "velocity", "displacement", dt).drop("_raw", "_drift", "_at")


def rolling_rms(df: DataFrame, key: str, order: str, x: str, size: int, name: str = "rms") -> DataFrame:
    """Adds the centred rolling root mean square over ``size`` rows; edge values stand in for rows beyond the ends."""
    pad = size // 2
    w, whole = _by(key, order), Window.partitionBy(key)
    df = df.withColumns({"_i": F.row_number().over(w), "_n": F.count("*").over(whole), "_s": F.col(x) * F.col(x)})
    frame, all_ = w.rowsBetween(-pad, size - pad - 1), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.greatest(F.lit(pad) - (F.col("_i") - 1), F.lit(0))
    after = F.greatest(F.col("_i") + size - pad - 1 - F.col("_n"), F.lit(0))
    total = F.sum("_s").over(frame) + before * F.first("_s").over(all_) + after * F.last("_s").over(all_)
    return df.withColumn(name, F.sqrt(total / size)).drop("_i", "_n", "_s")


def runs(df: DataFrame, key: str, order: str, flag: str, least: int = 1) -> DataFrame:
    """Runs of rows where ``flag`` holds: start and end place (from 0, inclusive), middle place and length."""
    w = _by(key, order)
    df = df.withColumn("_i", F.row_number().over(w).cast("long") - 1).where(F.col(flag))
    df = df.withColumn("_g", F.col("_i") - F.row_number().over(w))
    found = df.groupBy(key, "_g").agg(F.min("_i").alias("run_start"), F.max("_i").alias("run_end"))
    found = found.withColumn("length", F.col("run_end") - F.col("run_start") + 1).where(F.col("length") >= least)
    return found.select(key, "run_start", "run_end", F.floor((F.col("run_start") + F.col("run_end")) / 2).cast("long").alias("middle"), "length")


def bridged(spans: DataFrame, key: str, max_gap: Column | int) -> DataFrame:
    """Merges runs whose start is at most ``max_gap`` after the end of all before."""
    w = _by(key, "run_start", "run_end")
    before = F.max("run_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_new", F.coalesce((F.col("run_start") - before > max_gap).cast("int"), F.lit(1)))
    spans = spans.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy(key, "_g").agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end")).select(key, "run_start", "run_end", (F.col("run_end") - F.col("run_start") + 1).alias("length"))


def longest(spans: DataFrame, key: str) -> DataFrame:
    """The longest run of each key, the first of equals."""
    w = Window.partitionBy(key).orderBy(F.col("length").desc(), "run_start")
    return spans.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def first_extremes(df: DataFrame, key: str, order: str, x: str) -> DataFrame:
    """Per key the first place of the largest and of the smallest value."""
    return df.groupBy(key).agg(F.min_by(order, F.struct(-F.col(x), F.col(order))).alias("argmax"), F.max(x).alias("max"), F.min_by(order, F.struct(F.col(x), F.col(order))).alias("argmin"), F.min(x).alias("min"))


def local_maxima(df: DataFrame, key: str, order: str, x: str) -> DataFrame:
    """Rows higher than the one before and after; of a plateau the middle row, the earlier of two."""
    w = _by(key, order)
    df = df.withColumn("_i", F.row_number().over(w).cast("long") - 1).withColumn("_new", F.coalesce((F.col(x) != F.lag(x).over(w)).cast("int"), F.lit(1)))
    df = df.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    flat = df.groupBy(key, "_g").agg(F.min("_i").alias("a"), F.max("_i").alias("b"), F.first(x).alias("height"))
    v = Window.partitionBy(key).orderBy("_g")
    flat = flat.withColumns({"l": F.lag("height").over(v), "r": F.lead("height").over(v)})
    return flat.where("height > l and height > r").select(key, F.floor((F.col("a") + F.col("b")) / 2).cast("long").alias("i"), "height")


def percentiles(df: DataFrame, key: str, x: str, at: list[float]) -> DataFrame:
    """Exact percentiles by linear interpolation, named p5, p50, ..."""
    return df.groupBy(key).agg(*[F.expr(f"percentile({x}, {p})").alias(f"p{round(100 * p)}") for p in at])
