"""Operators on repetitions: aggregates of sample slices, survival rows, baselines and their templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REFERENCE_REPS = 3
LOAD_BAND = 0.10


def slice_aggregates(samples: DataFrame, reps: DataFrame, key: str, rep: str, i: str, lo: str, hi: str, x: str, tremor: str, fs: float) -> DataFrame:
    """Per repetition: mean and peak of abs(x), range, root mean square jerk and mean squared ``tremor``.

    Samples join their repetitions by key and band, i between lo and hi; a slice without length has a tremor of 0.
    """
    s, r = samples.alias("s"), reps.alias("r")
    w = Window.partitionBy(f"{key}", rep).orderBy(i)
    both = r.join(s, (F.col(f"r.{key}") == F.col(f"s.{key}")) & F.col(f"s.{i}").between(F.col(f"r.{lo}"), F.col(f"r.{hi}")))
    both = both.select(F.col(f"r.{key}").alias(key), F.col(f"r.{rep}").alias(rep), F.col(f"s.{i}").alias(i), F.col(f"s.{x}").alias("x"), F.col(f"s.{tremor}").alias("tremor"), (F.col(f"r.{hi}") > F.col(f"r.{lo}")).alias("long"))
    both = both.withColumn("jerk", (F.col("x") - F.lag("x").over(w)) * fs)
    return both.groupBy(key, rep).agg(
        F.count("*").alias("n_samples"),
        F.avg(F.abs("x")).alias("mean_abs"),
        F.max(F.abs("x")).alias("peak_abs"),
        (F.max("x") - F.min("x")).alias("extent"),
        F.coalesce(F.sqrt(F.avg(F.col("jerk") * F.col("jerk"))), F.lit(0.0)).alias("jerk_rms"),
        F.when(F.first("long"), F.avg(F.col("tremor") * F.col("tremor"))).otherwise(F.lit(0.0)).alias("tremor_power"),
    )


def path_metrics(samples: DataFrame, keys: list[str], i: str, xyz: tuple[str, str, str]) -> DataFrame:
    """Arc length of a path and the largest horizontal distance from its start; z is vertical."""
    w = Window.partitionBy(*keys).orderBy(i)
    x, y, z = (F.col(c) for c in xyz)
    step = sum(((c - F.lag(c).over(w)) * (c - F.lag(c).over(w)) for c in (y, z)), (x - F.lag(x).over(w)) * (x - F.lag(x).over(w)))
    x0, y0 = F.first(xyz[0]).over(w), F.first(xyz[1]).over(w)
    rows = samples.withColumns({"_step": F.sqrt(step), "_away": F.sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0))})
    return rows.groupBy(*keys).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("path_length"), F.max("_away").alias("horizontal_excursion"))


def pauses(points: DataFrame, runs: DataFrame, key: str, at: str, fs: float) -> DataFrame:
    """Adds ``pause``: the seconds of the stationary run that contains the point, else 0. Runs of a key don't overlap."""
    p, r = points.alias("p"), runs.alias("r")
    both = p.join(r, (F.col(f"p.{key}") == F.col(f"r.{key}")) & F.col(f"p.{at}").between(F.col("r.run_start"), F.col("r.run_end")), "left")
    return both.select("p.*", F.coalesce((F.col("r.run_end") - F.col("r.run_start") + 1) / fs, F.lit(0.0)).alias("pause"))


def safe_ratio(a: Column, b: Column, least: float = 1e-9) -> Column:
    """a / b, or 0 where b is hardly above 0."""
    return F.when(b > least, a / b).otherwise(F.lit(0.0))


def with_remaining(reps: DataFrame, key: str, rep: str) -> DataFrame:
    """Adds ``n_reps``, ``reps_remaining`` (never negative) and ``is_last``."""
    w = Window.partitionBy(key)
    reps = reps.withColumn("n_reps", F.count("*").over(w))
    return reps.withColumns({"reps_remaining": F.greatest(F.col("n_reps") - F.col(rep), F.lit(0)), "is_last": F.col(rep) == F.max(rep).over(w)})


def person_period(reps: DataFrame, sets: DataFrame, key: str, rep: str, failed: str) -> DataFrame:
    """Survival rows: each repetition with ``y``, 1 only on the last one of a set that reached failure."""
    rows = with_remaining(reps, key, rep).join(sets, key)
    return rows.withColumn("y", F.when(F.col(failed) & F.col("is_last"), F.lit(1)).otherwise(F.lit(0)))


def reference_block(reps: DataFrame, key: str, rep: str, completed: str, n: int = REFERENCE_REPS) -> DataFrame:
    """Completed repetitions with their rank among such and whether it is one of the first ``n``."""
    w = Window.partitionBy(key).orderBy(rep)
    reps = reps.where(F.col(completed)).withColumn("completed_rank", F.row_number().over(w).cast("long"))
    return reps.withColumn("is_reference", F.col("completed_rank") <= n)


def in_load_band(load: Column, target: Column, band: float = LOAD_BAND) -> Column:
    """Within the band around the target; any load will do where the target is null or not positive."""
    return F.coalesce(target <= 0, F.lit(True)) | (F.abs(load - target) / target <= band)


def template(profiles: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Element-wise mean of equally long vectors, in order, and their number."""
    parts = profiles.select(*keys, F.posexplode(vector).alias("pos", "v"))
    means = parts.groupBy(*keys, "pos").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("template"), F.max("n").alias("n_profiles"))


def baseline_tiers(sets: DataFrame, reps: DataFrame, key: str, user: str, exercise: str, session: str, order: str, load: str, warmup: str, completed: str, least: int = 2) -> DataFrame:
    """The source of each set's baseline and how many repetitions it rests on.

    First choice: completed repetitions of the user's earlier sessions in the same exercise within the load band; then of
    earlier warm-ups of the same session whatever their load; then the set's first three; each needs ``least``. One
    row per set. Sessions and sets are ordered by ``session`` and ``order``.
    """
    done = reps.where(F.col(completed)).groupBy(key).agg(F.count("*").alias("_done"))
    own = sets.join(done, key, "left").withColumn("_done", F.coalesce("_done", F.lit(0)))
    a, b = own.alias("a"), own.where("_done > 0").alias("b")
    same = (F.col(f"a.{user}") == F.col(f"b.{user}")) & (F.col(f"a.{exercise}") == F.col(f"b.{exercise}"))
    earlier = F.col(f"b.{session}") < F.col(f"a.{session}")
    history = F.when(earlier & in_load_band(F.col(f"b.{load}"), F.col(f"a.{load}")), F.col("b._done"))
    warm = F.when((F.col(f"b.{session}") == F.col(f"a.{session}")) & (F.col(f"b.{order}") < F.col(f"a.{order}")) & F.col(f"b.{warmup}"), F.col("b._done"))
    found = a.join(b, same & (earlier | (F.col(f"b.{session}") == F.col(f"a.{session}"))), "left").groupBy(F.col(f"a.{key}").alias(key)).agg(F.coalesce(F.sum(history), F.lit(0)).alias("n_history"), F.coalesce(F.sum(warm), F.lit(0)).alias("n_warmup"), F.least(F.max("a._done"), F.lit(REFERENCE_REPS)).alias("n_early"))
    source = F.when(F.col("n_history") >= least, "cross_session").when(F.col("n_warmup") >= least, "warmup").when(F.col("n_early") >= least, "early_set").otherwise("none")
    n = F.when(F.col("n_history") >= least, F.col("n_history")).when(F.col("n_warmup") >= least, F.col("n_warmup")).when(F.col("n_early") >= least, F.col("n_early")).otherwise(F.lit(0))
    return found.withColumns({"source": source, "n_reps": n})
