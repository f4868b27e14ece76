"""Trends of a channel over the repetitions of a set: slope, curvature, total change relative
to the first, largest deviation from the line, breakpoint and what two lines gain over one.

Nulls are dropped first and the places 0, 1, ... run over what is left. A channel with a non-finite value has no
summaries; nor has one that is too short for them (slope and total change need 2 values, curvature 3, a breakpoint 4). Places
need a set's rows in order, so rows are shuffled once by their set; the work on them is linear.

Whole-set (``retro``) and to-date (``causal``) summaries are different tables: the latter see only the repetitions up to
their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUMMARIES = ("slope", "curvature", "total_change", "max_dev", "breakpoint", "breakpoint_gain")
CHANNELS = ("conc_mean_vel", "ecc_duration", "rom_vertical", "path_dtw_baseline", "tremor_power_8_12")


def _sse(x: Column, y: Column) -> Column:
    """Squared error of the best line; 0 with fewer than two points."""
    rest = F.regr_syy(y, x) - F.pow(F.regr_sxy(y, x), F.lit(2)) / F.regr_sxx(y, x)
    return F.when(F.regr_count(y, x) < 2, F.lit(0.0)).otherwise(F.greatest(rest, F.lit(0.0)))


def _part_sse(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column, syy: Column) -> Column:
    """The same for a part with these sums."""
    own = lambda a, b: F.try_divide(a * b, n)
    return F.greatest(syy - own(sy, sy) - F.try_divide(F.pow(sxy - own(sx, sy), F.lit(2)), sxx - own(sx, sx)), F.lit(0.0))


def summarize(df: DataFrame, keys: list[str], order: list[str], y: str) -> DataFrame:
    """One row per group with the six summaries of ``y``; groups without a value have a row of nulls.

    One exchange on ``keys``: places and running sums are windows over it and all else is one aggregate. A cut's left
    part has the running sums; as values are centred on their group, the right part has the totals less those.
    """
    every = Window.partitionBy(*keys)
    run = every.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    pts = df.select(*keys, *order, F.col(y).cast("double").alias("_y")).withColumn("_has", F.col("_y").isNotNull().cast("int"))
    pts = pts.withColumns({"_k": F.sum("_has").over(run), "_n": F.sum("_has").over(every), "_mean": F.avg("_y").over(every)})
    x, y_ = F.col("_x"), F.col("_y")
    pts = pts.withColumn("_x", F.when(F.col("_has") == 1, (F.col("_k") - 1).cast("double")))
    cx, cy = x - (F.col("_n") - 1) / 2, y_ - F.col("_mean")
    sums = {"x": cx, "y": cy, "xx": cx * cx, "xy": cx * cy, "yy": cy * cy}
    pts = pts.withColumns({f"_l{c}": F.sum(v).over(run) for c, v in sums.items()} | {f"_t{c}": F.sum(v).over(every) for c, v in sums.items()})
    left, total = ({c: F.col(f"_{side}{c}") for c in sums} for side in "lt")
    one = F.greatest(total["yy"] - F.try_divide(F.pow(total["xy"], F.lit(2)), total["xx"]), F.lit(0.0))
    two = _part_sse(F.col("_k"), *left.values()) + _part_sse(F.col("_n") - F.col("_k"), *[total[c] - left[c] for c in sums])
    # A line that fits but for rounding leaves nothing to gain; nor may rounding decide between equally good breaks.
    cut = (F.col("_has") == 1) & F.col("_k").between(2, F.col("_n") - 2) & (one > 0)
    pts = pts.withColumn("_two", F.when(cut, two))
    pts = pts.withColumn("_rank", F.when(cut, F.struct(F.round(F.try_divide("_two", one), 9).alias("two"), F.col("_k").alias("k"))))
    pts = pts.withColumn("_off", F.abs(cy - F.try_divide(total["xy"], total["xx"]) * cx))
    xx = x * x
    curve = (F.var_pop(x) * F.covar_pop(xx, y_) - F.covar_pop(x, xx) * F.covar_pop(x, y_)) / (F.var_pop(x) * F.var_pop(xx) - F.pow(F.covar_pop(x, xx), F.lit(2)))
    finite = ~F.isnan(y_) & (F.abs(y_) < F.lit(float("inf")))
    out = pts.groupBy(*keys).agg(
        F.max((F.col("_y").isNotNull() & ~finite).cast("int")).alias("_bad"),
        F.count(y_).alias("_n"),
        F.regr_slope(y_, x).alias("_slope"),
        F.when(F.count(y_) >= 3, curve).alias("_curvature"),
        F.min_by(y_, x).alias("_first"),
        F.max_by(y_, x).alias("_last"),
        _sse(x, y_).alias("_one"),
        F.regr_syy(y_, x).alias("_syy"),
        F.max("_off").alias("_dev"),
        F.min_by("_k", "_rank").alias("_cut"),
        F.min_by("_two", "_rank").alias("_two"),
    )
    ok = F.col("_bad") == 0
    broken = ok & (F.col("_n") >= 4) & (F.col("_one") > 1e-12 * F.greatest(F.col("_syy"), F.lit(1.0)))
    return out.select(
        *keys,
        F.when(ok & (F.col("_n") >= 2), F.col("_slope")).alias("slope"),
        F.when(ok, F.col("_curvature")).alias("curvature"),
        F.when(ok & (F.col("_n") >= 2) & (F.abs("_first") > 1e-12), (F.col("_last") - F.col("_first")) / F.col("_first")).alias("total_change"),
        F.when(ok & (F.col("_n") >= 2), F.col("_dev")).alias("max_dev"),
        F.when(broken, F.col("_cut") + 1).cast("long").alias("breakpoint"),
        F.when(broken, F.greatest(1 - F.col("_two") / F.col("_one"), F.lit(0.0))).alias("breakpoint_gain"),
    )


def _to_date(y: np.ndarray) -> np.ndarray:
    """The six summaries of each beginning of ``y``, a row for each; NaN where there is none. Each beginning's cuts are
    one pass over prefix sums, of values centred on the whole."""
    n = len(y)
    out = np.full((n, 6), np.nan)
    x, c = np.arange(n, dtype=float), y - y.mean()
    sums = [np.cumsum(v) for v in (x, c, x * x, x * c, c * c)]

    def sse(count, sx, sy, sxx, sxy, syy):
        return np.maximum(syy - sy * sy / count - (sxy - sx * sy / count) ** 2 / (sxx - sx * sx / count), 0)

    for last in range(1, n):
        m = last + 1
        sx, sy, sxx, sxy, syy = (s[last] for s in sums)
        vx, vxy = sxx - sx * sx / m, sxy - sx * sy / m
        slope = vxy / vx
        out[last, 0] = slope
        out[last, 3] = np.abs(c[:m] - sy / m - slope * (x[:m] - sx / m)).max()
        if abs(y[0]) > 1e-12:
            out[last, 2] = (y[last] - y[0]) / y[0]
        if m >= 3:
            u, v = x[:m] - sx / m, c[:m] - sy / m
            q = u * u - (u * u).mean()
            out[last, 1] = (q @ v) / (q @ q)  # the squares of centred places are uncorrelated with the places
        if m >= 4:
            spread, one = syy - sy * sy / m, sse(m, sx, sy, sxx, sxy, syy)
            if one > 1e-12 * max(spread, 1.0):
                k = np.arange(2, m - 1)
                left = [s[k - 1] for s in sums]
                two = sse(k, *left) + sse(m - k, *(s[last] - p for s, p in zip(sums, left, strict=True)))
                best = int(np.round(two / one, 9).argmin())
                out[last, 4:] = k[best] + 1, max(1 - two[best] / one, 0)
    return out


def to_date(df: DataFrame, keys: list[str], order: str, y: str) -> DataFrame:
    """One row per input row: keys, ``up_to``, and the six summaries of ``y`` over the rows up to it. A group's breakpoints
    take time with the square of its rows and no more than its rows of memory."""
    schema = ", ".join([f"{c} {dict(df.dtypes)[c]}" for c in keys] + [f"up_to {dict(df.dtypes)[order]}"] + [f"{c} {'long' if c == 'breakpoint' else 'double'}" for c in SUMMARIES])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        values = group[y].to_numpy(float)
        some = group["_has"].to_numpy(bool)
        bad = np.maximum.accumulate(some & ~np.isfinite(values))
        sound = some & ~bad
        found = np.vstack([np.full((1, 6), np.nan), _to_date(values[sound]) if sound.any() else np.empty((0, 6))])
        rows = found[np.cumsum(sound)]
        rows[bad] = np.nan
        out = group[[*keys, order]].rename(columns={order: "up_to"}).reset_index(drop=True)
        for k, c in enumerate(SUMMARIES):
            out[c] = pd.array(rows[:, k], dtype="Float64") if c != "breakpoint" else pd.array([None if np.isnan(v) else int(v) for v in rows[:, k]], dtype="Int64")
            if c != "breakpoint":
                out[c] = [None if np.isnan(v) else v for v in rows[:, k]]
        return out

    rows = df.select(*keys, order, F.coalesce(F.col(y).cast("double"), F.lit(0.0)).alias(y), F.col(y).isNotNull().alias("_has"))
    return rows.groupBy(*keys).applyInPandas(run, schema)


def long_channels(df: DataFrame, keys: list[str], channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Keys, channel, value: one row per channel of each row."""
    return df.unpivot(keys, [F.col(c).cast("double").alias(c) for c in channels], "channel", "value")


def retrospective(reps: DataFrame, key: str, rep: str, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """One row per set with ``retro_<channel>_<summary>``."""
    found = summarize(long_channels(reps, [key, rep], channels), [key, "channel"], [rep], "value")
    wide = found.groupBy(key).pivot("channel", list(channels)).agg(*[F.first(s).alias(s) for s in SUMMARIES])
    return wide.select(key, *[F.col(f"{c}_{s}").alias(f"retro_{c}_{s}") for c in channels for s in SUMMARIES])


def causal(reps: DataFrame, key: str, rep: str, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """One row per repetition with ``causal_<channel>_<summary>`` over the repetitions up to it."""
    found = to_date(long_channels(reps, [key, rep], channels), [key, "channel"], rep, "value")
    wide = found.groupBy(key, F.col("up_to").alias("up_to_rep")).pivot("channel", list(channels)).agg(*[F.first(s).alias(s) for s in SUMMARIES])
    return wide.select(key, "up_to_rep", *[F.col(f"{c}_{s}").alias(f"causal_{c}_{s}") for c in channels for s in SUMMARIES])


def running_slope(df: DataFrame, key: str, order: list[str], y: str) -> DataFrame:
    """Adds slope_to_date and change_to_date by one running window, for callers that need no more."""
    w = Window.partitionBy(key).orderBy(*order)
    df = df.withColumn("_x", (F.row_number().over(w) - 1).cast("double"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"slope_to_date": F.regr_slope(y, "_x").over(run), "change_to_date": F.when((F.col("_x") >= 1) & (F.abs(F.first(y).over(run)) > 1e-12), F.col(y) / F.first(y).over(run) - 1)}).drop("_x")
