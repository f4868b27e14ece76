"""From raw samples to repetitions, baselines, trends, form and effort.

A set's samples meet in one grouped task (a set is some tens of seconds, so a group is bounded by nature) that
conditions, segments and measures; from there on everything is joins, windows and aggregates over small rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signals
from ..operators import reps as R
from ..operators import scoring, trajectory
from ..operators.vectors import dtw_distance
from ..sources.contract import CHANNELS

FEATURES = ("conc_mean_vel", "conc_peak_vel", "ecc_mean_vel", "rom_vertical", "ecc_duration", "conc_duration", "bottom_pause", "tempo_ratio", "jerk_rms", "sparc", "tremor_power_8_12", "path_length", "horiz_excursion", "path_efficiency", "min_vel_position", "min_vel_value")
PLACES = ("i_start int", "i_bottom int", "i_end int", "t_start double", "t_bottom double", "t_end double", "completed boolean", "recovery double")
REP_COLUMNS = "set_id string, rep_index int, " + ", ".join(PLACES) + ", " + ", ".join(f"{f} double" for f in FEATURES) + ", profile array<double>"
SAMPLE_COLUMNS = "set_id string, i int, t double, a_vert double, a_h1 double, a_h2 double, v_vert double, v_h1 double, v_h2 double, d_vert double, d_h1 double, d_h2 double, tremor double, stationary boolean, is_anchor boolean"
QUALITY_COLUMNS = "set_id string, n_samples int, n_anchors int, flags array<string>, low_confidence boolean, i0 int, i1 int, active_fraction double"


def _conditioned(group: pd.DataFrame) -> signals.Conditioned:
    group = group.sort_values("t_ns")
    n = group["reported_reps"].iloc[0]
    return signals.condition(group["t_ns"].to_numpy(), group[list(CHANNELS)].to_numpy(float), None if pd.isna(n) else int(n))


def _with_sets(samples: DataFrame, sets: DataFrame) -> DataFrame:
    return samples.select("set_id", "t_ns", *CHANNELS).join(sets.select("set_id", "exercise", "reached_failure", F.col("reported_reps").cast("int").alias("reported_reps")), "set_id")


def conditioned_samples(samples: DataFrame, sets: DataFrame) -> DataFrame:
    """World-frame signals of every set on its uniform grid."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        c = _conditioned(group)
        anchor = pd.Series(False, index=range(len(c.t)))
        anchor.iloc[c.anchors] = True
        return pd.DataFrame({"set_id": group["set_id"].iloc[0], "i": range(len(c.t)), "t": c.t, "a_vert": c.a_vert, "a_h1": c.a_horiz[:, 0], "a_h2": c.a_horiz[:, 1], "v_vert": c.v_vert, "v_h1": c.v_horiz[:, 0], "v_h2": c.v_horiz[:, 1], "d_vert": c.d_vert, "d_h1": c.d_horiz[:, 0], "d_h2": c.d_horiz[:, 1], "tremor": c.tremor, "stationary": c.still, "is_anchor": anchor})

    return _with_sets(samples, sets).groupBy("set_id").applyInPandas(run, SAMPLE_COLUMNS)


def set_quality(samples: DataFrame, sets: DataFrame) -> DataFrame:
    """Per set: quality flags and the active window."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        c = _conditioned(group)
        a, b, share = signals.active_window(c)
        return pd.DataFrame([{"set_id": group["set_id"].iloc[0], "n_samples": len(c.t), "n_anchors": len(c.anchors), "flags": c.flags, "low_confidence": bool(c.flags), "i0": a, "i1": b, "active_fraction": share}])

    return _with_sets(samples, sets).groupBy("set_id").applyInPandas(run, QUALITY_COLUMNS)


def repetitions(samples: DataFrame, sets: DataFrame, trim: bool = True) -> DataFrame:
    """Per repetition: boundaries, features and the unit velocity profile; sets without any give no row."""
    names = [c.strip().split(" ")[0] for c in REP_COLUMNS.split(", ")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        c = _conditioned(group)
        found = signals.segment(c, group["exercise"].iloc[0], bool(group["reached_failure"].iloc[0]), trim)
        rows = [{**r, **f} for r, f in zip(found, signals.rep_features(c, found), strict=True)]
        return pd.DataFrame(rows).assign(set_id=group["set_id"].iloc[0])[names] if rows else pd.DataFrame(columns=names)

    return _with_sets(samples, sets).groupBy("set_id").applyInPandas(run, REP_COLUMNS)


def baselines(reps: DataFrame, sets: DataFrame, least: int = 2) -> DataFrame:
    """Per set: template, source and number of repetitions, by the order of preference of the baseline tiers."""
    done = reps.where("completed").join(sets.select("set_id", "user_id", "session_id", "date", "set_index", "exercise", "load_kg", "set_type"), "set_id")
    a, b = sets.alias("a"), done.alias("b")
    earlier = (F.col("b.date") < F.col("a.date")) & (F.col("b.session_id") != F.col("a.session_id"))
    warm = (F.col("b.session_id") == F.col("a.session_id")) & (F.col("b.set_index") < F.col("a.set_index")) & (F.col("b.set_type") == "warmup")
    rank = Window.partitionBy("set_id").orderBy("rep_index")
    early = done.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= R.REFERENCE_REPS).select("set_id", F.lit(3).alias("tier"), "profile")
    pairs = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.exercise") == F.col("b.exercise")) & (earlier | warm))
    tier = F.when(warm, 2).when(R.in_load_band(F.col("b.load_kg"), F.col("a.load_kg")), 1)
    pooled = pairs.select(F.col("a.set_id").alias("set_id"), tier.alias("tier"), F.col("b.profile").alias("profile")).where("tier is not null")
    found = R.template(pooled.unionByName(early), ["set_id", "tier"], "profile").where(F.col("n_profiles") >= least)
    best = found.withColumn("k", F.row_number().over(Window.partitionBy("set_id").orderBy("tier"))).where("k = 1")
    source = F.when(F.col("tier") == 1, "cross_session").when(F.col("tier") == 2, "warmup").when(F.col("tier") == 3, "early_set").otherwise("none")
    return sets.select("set_id").join(best.select("set_id", "tier", "template", "n_profiles"), "set_id", "left").select("set_id", "template", source.alias("source"), F.coalesce("n_profiles", F.lit(0)).alias("n_reps"))


def with_path_dtw(reps: DataFrame, base: DataFrame) -> DataFrame:
    """Adds path_dtw_baseline: the warping distance of each profile to the set's template; null without one."""
    return reps.join(base.select("set_id", "template"), "set_id", "left").withColumn("path_dtw_baseline", dtw_distance("profile", "template")).drop("template")


def hazard_rows(reps: DataFrame, sets: DataFrame, causal: DataFrame | None = None) -> DataFrame:
    """Person-period rows with the seven to-date features, velocity slope and y."""
    causal = trajectory.causal(reps, "set_id", "rep_index") if causal is None else causal
    to_date = causal.select("set_id", F.col("up_to_rep").alias("rep_index"), F.col("causal_conc_mean_vel_total_change").alias("vel_loss_to_date"), F.col("causal_ecc_duration_total_change").alias("ecc_change_to_date"), F.col("causal_tremor_power_8_12_total_change").alias("tremor_change_to_date"), F.col("causal_conc_mean_vel_slope").alias("vel_slope"))
    rows = R.person_period(reps, sets.select("set_id", "user_id", "exercise", "load_kg", "reached_failure"), "set_id", "rep_index", "reached_failure")
    rows = rows.join(to_date, ["set_id", "rep_index"], "left").fillna(0.0, ["path_dtw_baseline", "vel_loss_to_date", "ecc_change_to_date", "tremor_change_to_date", "vel_slope"])
    return rows.select("set_id", "user_id", "exercise", F.col("rep_index").cast("double").alias("rep_index"), "load_kg", "conc_mean_vel", "path_dtw_baseline", "vel_loss_to_date", "ecc_change_to_date", "tremor_change_to_date", "vel_slope", "completed", "reached_failure", "reps_remaining", "y")


def rpe_rows(sets: DataFrame, retro: DataFrame) -> DataFrame:
    """One row per set with the six whole-set features and the level of the reported effort."""
    from ..functions.columns import level_index

    names = [f"retro_{c}_total_change" for c in ("conc_mean_vel", "rom_vertical", "ecc_duration", "tremor_power_8_12")]
    rows = sets.where("reported_rpe is not null").join(retro.select("set_id", *names), "set_id", "left").fillna(0.0, names)
    return rows.withColumns({"reported_reps": F.col("reported_reps").cast("double"), "y": level_index(F.col("reported_rpe"))})


def form(reps: DataFrame, retro: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subscores and pointers of every set."""
    subs = scoring.form_subscores(reps, "set_id", "rep_index", "completed")
    trends = F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"retro_{c}_total_change").alias("total_change"), F.col(f"retro_{c}_slope").alias("slope"), F.col(f"retro_{c}_breakpoint").alias("breakpoint")) for name, c, _, _ in scoring.SUBSCORES])
    return subs, scoring.pointers(subs, retro.select("set_id", F.explode(trends).alias("t")).select("set_id", "t.*"), "set_id")
