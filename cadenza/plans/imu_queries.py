"""Registered queries over generated recordings. There is no SQL for filters and fits, so their rows are held against the
generator's truth in the tests. Sizes are those of the populations, not cuts of a table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluate, scoring, trajectory
from ..sources import generator
from . import imu, models
from .tables import rounded

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def corpus(spark: SparkSession, params: list[generator.Recording]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parameters, sets, and repetitions with their distance to the baseline; cached, as every later table uses them."""
    table = generator.params_table(spark, params)
    sets = generator.sets_of(table).cache()
    reps = imu.repetitions(generator.samples_of(table), sets)
    reps = imu.with_path_dtw(reps, imu.baselines(reps, sets)).cache()
    return table, sets, reps


@query
def imu_conditioned_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = generator.params_table(spark, generator.session(session_id="s1"))
    return rounded(imu.set_quality(generator.samples_of(table), generator.sets_of(table)).withColumn("flags", F.concat_ws(",", "flags")))


@query
def imu_conditioned_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = generator.params_table(spark, generator.session(session_id="s1"))
    return rounded(imu.conditioned_samples(generator.samples_of(table), generator.sets_of(table)))


@query
def imu_repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, reps = corpus(spark, generator.session(session_id="s1"))
    return rounded(reps.drop("profile"))


@query
def imu_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sets, reps = corpus(spark, generator.session(session_id="s1"))
    return imu.baselines(reps, sets).select("set_id", "source", "n_reps", F.size("template").alias("template_size"))


@query
def imu_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, reps = corpus(spark, generator.session(session_id="s1"))
    return rounded(trajectory.retrospective(reps, "set_id", "rep_index"))


@query
def imu_trends_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, reps = corpus(spark, generator.session(session_id="s1"))
    return rounded(trajectory.causal(reps, "set_id", "rep_index"))


def session_cards(spark: SparkSession, params: list[generator.Recording], model: models.Linear | None = None) -> DataFrame:
    """One row per set: form, effort, agreement, total and both texts."""
    _, sets, reps = corpus(spark, params)
    retro = trajectory.retrospective(reps, "set_id", "rep_index")
    subs, points = imu.form(reps, retro)
    cards = sets.select("set_id", "set_index", "exercise", "set_type", "load_kg", "reported_reps", "reported_rpe")
    cards = cards.join(imu.baselines(reps, sets).select("set_id", F.col("source").alias("baseline")), "set_id").join(scoring.form_score(subs, "set_id"), "set_id", "left").join(scoring.execution_narrative(subs, points, "set_id").withColumnRenamed("narrative", "execution"), "set_id", "left")
    if model is None:
        cards = cards.withColumns({"expected_rir": F.lit(None).cast("double"), "direction": F.lit(None).cast("string"), "effort_text": F.lit("Effort estimate unavailable.")})
    else:
        rows = imu.hazard_rows(reps, sets).where("completed")
        last = rows.groupBy("set_id").agg(F.max("rep_index").alias("rep_index"))
        ahead = models.reserve(model, rows.join(last, ["set_id", "rep_index"])).join(sets.select("set_id", F.col("reported_rpe").alias("rpe")), "set_id")
        ahead = scoring.divergence(ahead, "pmf", "rpe").join(scoring.rir_range(ahead, "set_id", "pmf"), "set_id")
        ahead = scoring.effort_narrative(ahead, "lo", "hi", "rpe").select("set_id", "expected_rir", "direction", F.col("narrative").alias("effort_text"))
        cards = cards.join(ahead, "set_id", "left")
    return scoring.composite(cards, "form_score", "expected_rir", "reported_rpe")


def _hazard_model(spark: SparkSession, seed: int = 5, users: int = 10, sets: int = 5) -> tuple[models.Linear, DataFrame, DataFrame]:
    """A fit on seven tenths of the users; the model and the rows of either part."""
    _, sets_, reps = corpus(spark, generator.population(users, sets, seed=seed))
    rows = imu.hazard_rows(reps, sets_).cache()
    test = evaluate.draw_users([f"user_{u:03d}" for u in range(users)])
    train, held = evaluate.split_by_user(rows, "user_id", spark.createDataFrame([(u,) for u in test], "user_id string"))
    return models.fit_hazard(train), train, held


@query
def imu_session_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(session_cards(spark, generator.session(session_id="s1")))


@query
def imu_session_cards_with_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _, _ = _hazard_model(spark)
    return rounded(session_cards(spark, generator.session(session_id="s1"), model))


@query
def rir_hazard_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hazards and expected reserve of the held-out users of each corpus of the evaluation."""

    def one(seed: int) -> DataFrame:
        model, _, held = _hazard_model(spark, seed, 24, 6)
        rows = models.reserve(model, models.hazards(model, held).drop("user_effect"))
        return rows.select(F.lit(seed).alias("seed"), "set_id", "rep_index", "hazard", "expected_rir", "rir_sd", "is_confident", "reps_remaining", "y")

    return rounded(reduce(DataFrame.unionByName, map(one, SEEDS)), 4)


def _rpe_model(spark: SparkSession, seed: int = 5, users: int = 12, sets: int = 6) -> tuple[models.Linear, DataFrame, DataFrame]:
    _, sets_, reps = corpus(spark, generator.rpe_population(users, sets, seed=seed))
    rows = imu.rpe_rows(sets_, trajectory.retrospective(reps, "set_id", "rep_index")).cache()
    test = evaluate.draw_users([f"user_{u:03d}" for u in range(users)])
    train, held = evaluate.split_by_user(rows, "user_id", spark.createDataFrame([(u,) for u in test], "user_id string"))
    return models.fit_rpe(train), train, held


@query
def rpe_ordinal_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effort of the held-out users of each corpus of the evaluation."""

    def one(seed: int) -> DataFrame:
        model, _, held = _rpe_model(spark, seed, 24, 6)
        return models.efforts(model, held).select(F.lit(seed).alias("seed"), "set_id", "expected_rpe", "level", "y")

    return rounded(reduce(DataFrame.unionByName, map(one, SEEDS)), 4)


def metrics(spark: SparkSession, users: int = 12, sets: int = 6, seed: int = 5) -> DataFrame:
    """Seven gates on one corpus: layer, name, value, threshold, higher_is_better, passed."""
    params = generator.population(users, sets, seed=seed)
    table, sets_, reps = corpus(spark, params)
    truth = generator.truth_of(table)

    def metric(layer: str, name: str, df: DataFrame, threshold: float, higher: bool) -> DataFrame:
        return df.select(F.lit(layer).alias("layer"), F.lit(name).alias("name"), F.col(f"`{df.columns[0]}`").cast("double").alias("value"), F.lit(threshold).alias("threshold"), F.lit(higher).alias("higher_is_better"))

    done = reps.where("completed").groupBy("set_id").agg(F.count("*").alias("found"))
    exact = sets_.join(done, "set_id", "left").agg(F.avg((F.coalesce("found", F.lit(0)) == F.col("reported_reps")).cast("double")))
    both = reps.where("completed").select("set_id", "rep_index", "rom_vertical").join(truth.where("completed"), ["set_id", "rep_index"])
    rom = both.agg(F.avg(F.abs(F.col("rom_vertical") - F.col("rom_true_m")) / F.col("rom_true_m")))
    rows = imu.hazard_rows(reps, sets_).cache()
    held_users = spark.createDataFrame([(u,) for u in evaluate.draw_users([f"user_{u:03d}" for u in range(users)])], "user_id string")
    train, held = evaluate.split_by_user(rows, "user_id", held_users)
    hazard = models.fit_hazard(train)
    scored = models.reserve(hazard, models.hazards(hazard, held).drop("user_effect")).cache()
    failing = scored.where("reached_failure and completed").withColumn("left", F.col("reps_remaining") - 1)
    agree = evaluate.concordance(failing, "exercise", "left", "expected_rir").agg(F.sum(F.col("concordance") * F.col("pairs")) / F.sum("pairs"))
    rpe, _, rpe_held = _rpe_model(spark, seed)
    told = models.efforts(rpe, rpe_held).withColumn("told", 6 + F.col("level") * 0.5)
    found = [
        metric("conditioning", "mean_rom_error", rom, 0.15, False),
        metric("segmentation", "exact_count", exact, 0.95, True),
        metric("rir", "c_index", evaluate.auc(scored, "hazard", "y"), 0.65, True),
        metric("rir", "calibration_mad", evaluate.calibration_mad(scored, "hazard", "y"), 0.30, False),
        metric("rir", "completed_concordance", agree, 0.65, True),
        metric("rir", "expected_rir_mae", failing.agg(F.avg(F.abs(F.col("expected_rir") - F.col("left")))), 2.5, False),
        metric("rpe", "within_one", told.agg(evaluate.within(told, "reported_rpe", "told")), 0.55, True),
    ]
    return evaluate.gates(found)


SEEDS = (5, 11, 23)
GRADES = {
    "clean": {},
    "mild": {"slowing": 0.35, "shortening": 0.12, "tremor_growth": 2.5},
    "moderate": {"slowing": 0.45, "shortening": 0.20, "tremor_growth": 3.0, "hurry": 0.35, "sway_m": 0.03},
    "hard": {"slowing": 0.55, "shortening": 0.28, "tremor": 0.4, "tremor_growth": 3.5, "hurry": 0.4, "sway_m": 0.04},
}
FORMS = {"clean": {"slowing": 0.08, "shortening": 0.02, "tremor_growth": 1.1, "hurry": 0.05}, "degraded": {"slowing": 0.5, "shortening": 0.25, "tremor_growth": 3.2, "hurry": 0.35}}
GATES = "layer string, name string, value double, threshold double, higher_is_better boolean, passed boolean"


def _conditioning_gates(spark: SparkSession) -> list[tuple]:
    """Range within each true repetition's time, against its true range."""
    table = generator.params_table(spark, [generator.recording(session_id=f"range{s}", able=10, spare=2, fails=False, seed=s) for s in (1, 2, 3)])
    truth = generator.truth_of(table).where("completed").select(F.col("set_id"), "rep_index", "t_start", "t_end", "rom_true_m")
    both = imu.conditioned_samples(generator.samples_of(table), generator.sets_of(table)).join(truth, "set_id").where("t between t_start and t_end")
    error = both.groupBy("set_id", "rep_index").agg((F.abs(F.max("d_vert") - F.min("d_vert") - F.first("rom_true_m")) / F.first("rom_true_m")).alias("e"))
    mean, worst = error.agg(F.avg("e"), F.max("e")).first()
    return [("conditioning", "mean_rom_error", mean, 0.15, False, mean < 0.15), ("conditioning", "worst_rom_error", worst, 0.15, False, worst < 0.15)]


def _segmentation_gates(spark: SparkSession) -> list[tuple]:
    """Exact counts by grade: the mean of the three operating grades, and the degraded one apart."""
    params = [
        generator.recording(user_id=grade, session_id=f"{grade}:{exercise}:{capacity}:{fails}:{seed}", exercise=exercise, range_m=rom, able=capacity, spare=0 if fails else 2, fails=fails, seed=seed, **traits)
        for grade, traits in GRADES.items() for exercise, rom in (("bench_press", 0.45), ("back_squat", 0.55)) for capacity in (6, 10) for fails in (True, False) for seed in (1, 2, 3)
    ]
    table = generator.params_table(spark, params)
    sets = generator.sets_of(table)
    done = imu.repetitions(generator.samples_of(table), sets).where("completed").groupBy("set_id").agg(F.count("*").alias("found"))
    exact = sets.join(done, "set_id", "left").groupBy("user_id").agg(F.avg((F.coalesce("found", F.lit(0)) == F.col("reported_reps")).cast("double")))
    rate = dict(map(tuple, exact.collect()))
    usual, hard = sum(rate[g] for g in ("clean", "mild", "moderate")) / 3, rate["hard"]
    return [("segmentation", "exact_count", usual, 0.95, True, usual >= 0.95), ("segmentation", "exact_count_degraded", hard, 0.75, True, hard >= 0.75)]


def _form_gates(spark: SparkSession) -> list[tuple]:
    """Every clean set must score above every degraded one; the value is the gap of the means."""
    params = [generator.recording(user_id=f"{kind}{s}", session_id=f"{kind}{s}", able=10, load_kg=80.0, seed=s, **traits) for kind, traits in FORMS.items() for s in (1, 2, 3)]
    _, _, reps = corpus(spark, params)
    subs, _ = imu.form(reps, trajectory.retrospective(reps, "set_id", "rep_index"))
    scores = {r["set_id"]: r["form_score"] for r in scoring.form_score(subs, "set_id").collect()}
    clean, degraded = ([x for k, x in scores.items() if k.startswith(kind)] for kind in FORMS)
    return [("form", "clean_degraded_gap", sum(clean) / len(clean) - sum(degraded) / len(degraded), 0.0, True, min(clean) > max(degraded))]


def _hazard_corpus(spark: SparkSession, seed: int, users: int, sets: int) -> tuple[dict[str, float], DataFrame]:
    """The figures of one corpus, and the last completed repetition of each held-out set to failure."""
    model, _, held = _hazard_model(spark, seed, users, sets)
    scored = models.reserve(model, models.hazards(model, held).drop("user_effect")).withColumn("last", F.max("rep_index").over(Window.partitionBy("set_id"))).cache()
    failing = scored.where("reached_failure and completed").select("set_id", "rep_index", "pmf", "expected_rir", (F.col("last") - F.col("rep_index")).alias("left"), (-F.col("hazard")).alias("safety"), F.lit("all").alias("all"))
    out = {
        "c_index": evaluate.auc(scored, "hazard", "y").first()[0],
        "calibration_mad": evaluate.calibration_mad(scored, "hazard", "y").first()[0],
        "completed_concordance": evaluate.concordance(failing, "all", "left", "safety").first()["concordance"],
        "expected_rir_mae": failing.agg(F.avg(F.abs(F.col("expected_rir") - F.col("left")))).first()[0],
    }
    return out, _last(failing)


def _last(failing: DataFrame) -> DataFrame:
    """The last repetition of each set."""
    return failing.withColumn("k", F.row_number().over(Window.partitionBy("set_id").orderBy(F.col("rep_index").desc()))).where("k = 1").drop("k")


def _rpe_corpus(spark: SparkSession, seed: int, users: int, sets: int) -> dict[str, float]:
    model, train, held = _rpe_model(spark, seed, users, sets)
    told = models.efforts(model, held).withColumn("told", 6 + F.col("level") * 0.5).withColumn("truth", 6 + F.col("y") * 0.5)
    most = evaluate.majority(train, "y", "set_id").first()["y"]
    bias = train.groupBy("user_id").agg(F.first("rpe_bias").alias("injected")).join(model.users, "user_id")
    told = told.withColumn("most", F.lit(6 + most * 0.5))
    row = told.agg(evaluate.within(told, "truth", "told").alias("within_one"), evaluate.within(told, "truth", "most").alias("majority_within_one")).first().asDict()
    return row | {"bias_recovery": evaluate.pearson(bias, "effect", "injected").first()[0]}


def full_metrics(spark: SparkSession, users: int = 24, sets: int = 6, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """The thirteen gates of all six layers and the C-index; those of the models are means over a corpus for each seed, but the
    divergence layer is that of the first. A null threshold passes or fails nothing."""
    found = _conditioning_gates(spark) + _segmentation_gates(spark) + _form_gates(spark)
    # The fits are many short jobs one after another, so the corpora go side by side.
    with ThreadPoolExecutor(2 * len(seeds)) as pool:
        hazard = [pool.submit(_hazard_corpus, spark, seed, users, sets) for seed in seeds]
        effort = [pool.submit(_rpe_corpus, spark, seed, users, sets) for seed in seeds]
        rir, last = zip(*[f.result() for f in hazard], strict=True)
        rpe = [f.result() for f in effort]
    mean = lambda rows, name: sum(r[name] for r in rows) / len(rows)
    for rows, layer, name, threshold, higher in (
        (rir, "rir", "c_index", 0.65, True), (rir, "rir", "completed_concordance", 0.65, True), (rir, "rir", "calibration_mad", 0.30, False), (rir, "rir", "expected_rir_mae", 2.0, False),
        (rpe, "rpe", "within_one", 0.55, True), (rpe, "rpe", "majority_within_one", None, True), (rpe, "rpe", "bias_recovery", 0.55, True),
    ):
        value = mean(rows, name)
        found.append((layer, name, value, threshold, higher, None if threshold is None else value >= threshold if higher else value <= threshold))
    under = lambda rpe: scoring.divergence(last[0].withColumn("rpe", F.lit(rpe)), "pmf", "rpe").agg(F.avg((F.col("direction") == "under_reporting").cast("double"))).first()[0]
    planted, false = under(6.5), under(10.0)
    found += [("divergence", "planted_mismatch", planted, 0.80, True, planted >= 0.80), ("divergence", "false_flag", false, planted, False, false < planted)]
    return spark.createDataFrame(found, GATES)


@query
def evaluation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(full_metrics(spark), 4)
