"""The two heads: a discrete-time hazard of failing at the next repetition, and an ordinal model of reported effort.

Both are penalised logistic fits, done by MLlib over distributed rows. Its one penalty stands for several: a
column scaled by c is penalised as if its coefficient had the ridge over c squared, so user columns are scaled to have
their own penalty and threshold columns to have hardly any.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import RPE_LEVELS, pmf_from_cumulative, sigmoid
from ..operators.scoring import rir_pmf

HAZARD_COLUMNS = ("rep_index", "load_kg", "conc_mean_vel", "path_dtw_baseline", "vel_loss_to_date", "ecc_change_to_date", "tremor_change_to_date")
RPE_COLUMNS = ("reported_reps", "load_kg", "retro_conc_mean_vel_total_change", "retro_rom_vertical_total_change", "retro_ecc_duration_total_change", "retro_tremor_power_8_12_total_change")
RIDGE, USER_RIDGE = 0.5, 1.0
HORIZON, DAMPING = 8, 0.75
FREE = 1000.0


@dataclass(frozen=True)
class Linear:
    """Coefficients of standardised columns and exercises, an intercept or thresholds, and the users' table (user_id, effect)."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    sd: tuple[float, ...]
    beta: tuple[float, ...]
    exercises: dict[str, float]
    intercept: float
    thresholds: tuple[float, ...]
    users: DataFrame

    def score(self, values: dict[str, Column] | None = None) -> Column:
        """The linear predictor but for the user's effect; an unknown exercise counts as the reference."""
        values = values or {}
        z = F.lit(self.intercept)
        for c, m, s, b in zip(self.columns, self.mean, self.sd, self.beta, strict=True):
            z = z + (values.get(c, F.col(c)) - m) / s * b
        effect = F.lit(0.0)
        for name, b in self.exercises.items():
            effect = F.when(F.col("exercise") == name, F.lit(b)).otherwise(effect)
        return z + effect

    def with_users(self, df: DataFrame) -> DataFrame:
        """Adds user_effect, 0 for users that the fit hasn't seen."""
        return df.join(self.users, "user_id", "left").withColumn("user_effect", F.coalesce("effect", F.lit(0.0))).drop("effect")


def _fit(df: DataFrame, columns: tuple[str, ...], ordinal: bool) -> Linear:
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.sort_array(F.collect_set("exercise")).alias("exercises"), F.count("*").alias("n")).first()
    mean = tuple(stats[f"m_{c}"] for c in columns)
    sd = tuple(1.0 if stats[f"s_{c}"] < 1e-9 else stats[f"s_{c}"] for c in columns)
    others = stats["exercises"][1:]
    rows = df.select("user_id", "exercise", *[((F.col(c) - m) / s).alias(f"z_{c}") for c, m, s in zip(columns, mean, sd, strict=True)], *[(F.col("exercise") == e).cast("double").alias(f"x_{k}") for k, e in enumerate(others)], F.col("y").cast("double").alias("y"))
    fixed = [f"z_{c}" for c in columns] + [f"x_{k}" for k in range(len(others))]
    levels = len(RPE_LEVELS) - 1
    if ordinal:
        rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("y", (F.col("y") > F.col("k")).cast("double"))
        rows = rows.select("*", *[F.when(F.col("k") == k, -FREE).otherwise(0.0).alias(f"t_{k}") for k in range(levels)])
        fixed += [f"t_{k}" for k in range(levels)]
    indexer = StringIndexer(inputCol="user_id", outputCol="user_index", stringOrderType="alphabetAsc").fit(rows)
    users = list(indexer.labels)
    rows = OneHotEncoder(inputCol="user_index", outputCol="user_vector", dropLast=False).fit(indexer.transform(rows)).transform(indexer.transform(rows))
    scale = math.sqrt(RIDGE / USER_RIDGE)
    rows = ElementwiseProduct(scalingVec=Vectors.dense([scale] * len(users)), inputCol="user_vector", outputCol="user_scaled").transform(rows)
    rows = VectorAssembler(inputCols=[*fixed, "user_scaled"], outputCol="features").transform(rows).select("features", F.col("y").alias("label")).persist()
    n = rows.count()
    made = LogisticRegression(standardization=False, elasticNetParam=0.0, regParam=RIDGE / n, maxIter=500, tol=1e-10, fitIntercept=not ordinal).fit(rows)
    rows.unpersist()
    w = made.coefficients.toArray().tolist()
    beta, exercises, rest = w[: len(columns)], w[len(columns) : len(columns) + len(others)], w[len(columns) + len(others) :]
    thresholds, effects = ([FREE * x for x in rest[:levels]], rest[levels:]) if ordinal else ([], rest)
    for k in range(1, len(thresholds)):  # a level without examples leaves two of them equal
        thresholds[k] = max(thresholds[k], thresholds[k - 1])
    table = df.sparkSession.createDataFrame([(u, scale * x) for u, x in zip(users, effects, strict=True)], "user_id string, effect double")
    return Linear(columns, mean, sd, tuple(beta), dict(zip(others, exercises, strict=True)), float(made.intercept), tuple(thresholds), table)


def fit_hazard(rows: DataFrame) -> Linear:
    """``rows``: user_id, exercise, the hazard columns, y (1: this repetition failed)."""
    return _fit(rows, HAZARD_COLUMNS, ordinal=False)


def fit_rpe(rows: DataFrame) -> Linear:
    """``rows``: user_id, exercise, the effort columns, y (level 0 to 8)."""
    return _fit(rows, RPE_COLUMNS, ordinal=True)


def hazards(model: Linear, rows: DataFrame) -> DataFrame:
    """Adds hazard."""
    return model.with_users(rows).withColumn("hazard", sigmoid(model.score() + F.col("user_effect")))


def reserve(model: Linear, rows: DataFrame) -> DataFrame:
    """Adds pmf (repetitions in reserve 0 to 8), expected_rir and rir_sd, from the hazards of the next eight repetitions:
    velocity follows its slope, damped and not below 0.001, changes go on at their rate, the rest stays."""
    rows = model.with_users(rows)
    ahead = []
    for j in range(1, HORIZON + 1):
        reach = j**DAMPING
        moved = {"rep_index": F.col("rep_index") + j, "conc_mean_vel": F.greatest(F.col("conc_mean_vel") + F.col("vel_slope") * reach, F.lit(1e-3))}
        moved |= {c: F.col(c) * (1 + reach / F.col("rep_index")) for c in ("vel_loss_to_date", "ecc_change_to_date", "tremor_change_to_date")}
        ahead.append(sigmoid(model.score(moved) + F.col("user_effect")))
    rows = rows.withColumn("ahead", F.array(*ahead)).withColumn("pmf", rir_pmf(F.col("ahead"))).drop("ahead")
    moment = lambda power: F.aggregate(F.transform("pmf", lambda p, k: p * F.pow(k.cast("double"), F.lit(power))), F.lit(0.0), lambda a, b: a + b)
    rows = rows.withColumn("expected_rir", moment(1.0))
    return rows.withColumn("rir_sd", F.sqrt(F.greatest(moment(2.0) - F.col("expected_rir") * F.col("expected_rir"), F.lit(0.0)))).withColumn("is_confident", F.col("expected_rir") <= 3.0)


def efforts(model: Linear, rows: DataFrame) -> DataFrame:
    """Adds rpe_pmf, expected_rpe and level."""
    from ..functions.columns import expected, first_argmax

    rows = model.with_users(rows).withColumn("z", model.score() + F.col("user_effect"))
    at_most = F.array(*[1 - sigmoid(F.col("z") - t) for t in model.thresholds], F.lit(1.0))
    rows = rows.withColumn("rpe_pmf", pmf_from_cumulative(at_most)).drop("z")
    return rows.withColumns({"expected_rpe": expected(F.col("rpe_pmf")), "level": first_argmax(F.col("rpe_pmf"))})
