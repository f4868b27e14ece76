"""The recording contract: schemas, vocabularies and checks. A check is one pass that returns the violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_RATE = 100.0
CHANNELS = ("lin_acc_x", "lin_acc_y", "lin_acc_z", "rot_rate_x", "rot_rate_y", "rot_rate_z", "quat_w", "quat_x", "quat_y", "quat_z", "grav_x", "grav_y", "grav_z")
KEYS = ("user_id", "date", "session_id", "set_index")
EXERCISES = ("bench_press", "back_squat", "deadlift", "overhead_press", "barbell_row", "dumbbell_curl")
ACTIVE_EXERCISES = EXERCISES[:2]
SET_TYPES = ("warmup", "working", "backoff")
WRISTS = ("left", "right")

#: Samples of one set; t_ns is the device's monotonic clock, not a time of day.
SAMPLES = T.StructType([T.StructField("t_ns", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in CHANNELS]])
RAW = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("date", T.StringType()), T.StructField("session_id", T.StringType()), T.StructField("set_index", T.IntegerType()), *SAMPLES])
SESSIONS = "session_id string, user_id string, started_at timestamp, device_model string, wrist string"
SETS = "set_id string, session_id string, set_index int, exercise string, load_kg double, set_type string, reported_reps int, reported_rpe double, reached_failure boolean, raw_path string"
REPS = "rep_id string, set_id string, rep_index int, t_start double, t_bottom double, t_end double, completed boolean"
REP_FEATURES = "rep_id string, features string"


class ContractError(ValueError):
    """A table that breaks the contract."""


def schema_problems(df: DataFrame, schema: T.StructType = SAMPLES) -> list[str]:
    """Missing, unexpected and wrongly typed columns."""
    want, have = {f.name: f.dataType for f in schema}, {f.name: f.dataType for f in df.schema}
    out = [f"missing column {c}" for c in want if c not in have] + [f"unexpected column {c}" for c in have if c not in want]
    return out + [f"{c} is {have[c].simpleString()}, not {want[c].simpleString()}" for c in want if c in have and have[c] != want[c]]


def clock_violations(df: DataFrame, keys: list[str], order: list[str], t: str = "t_ns") -> DataFrame:
    """Per recording: rows, and rows whose clock doesn't exceed that of the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_back", F.coalesce(F.col(t) <= F.lag(t).over(w), F.lit(False))).groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if("_back").alias("n_back"))


def validate(df: DataFrame, keys: list[str] | None = None, arrival: str | None = None) -> DataFrame:
    """``df`` in canonical column order; an error if its schema differs, it is empty, or a clock doesn't rise strictly.

    ``arrival`` orders rows as recorded; without it equal clock values are what can be seen.
    """
    keys = keys or [k for k in KEYS if k in df.columns]
    schema = RAW if keys else SAMPLES
    body = df.drop(arrival) if arrival else df
    if found := schema_problems(body, schema):
        raise ContractError("; ".join(found))
    one = df if keys else df.withColumn("_all", F.lit(0))
    state = clock_violations(one, keys or ["_all"], [arrival or "t_ns"]).agg(F.sum("n_rows").alias("n"), F.sum("n_back").alias("back")).first()
    if not state["n"]:
        raise ContractError("the recording is empty")
    if state["back"]:
        raise ContractError(f"t_ns does not rise strictly in {state['back']} rows")
    return body.select(*[f.name for f in schema])


def metadata_violations(sets: DataFrame) -> DataFrame:
    """Sets with an unknown exercise or type, or a reported effort outside 6 to 10; one row per problem."""
    checks = F.array_compact(
        F.array(
            F.when(~F.col("exercise").isin(*EXERCISES), "exercise"),
            F.when(~F.col("set_type").isin(*SET_TYPES), "set_type"),
            F.when(~F.col("reported_rpe").between(6, 10), "reported_rpe"),
        )
    )
    return sets.select("set_id", F.explode(checks).alias("problem"))
