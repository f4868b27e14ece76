"""Form, effort and their agreement: subscores with pointers, the composite, divergence, readiness and the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import LN3, plain_number, proximity, signed_percent, squash

MIN_BEYOND_REFERENCE = 2
Z_NOTABLE = 1.5
#: Subscore, channel, scale of a notable deviation, and the sign with which a rise counts.
SUBSCORES = (
    ("rom_completeness", "rom_vertical", 0.15, -1),
    ("path_consistency", "path_dtw_baseline", 0.60, 1),
    ("tempo_control", "ecc_duration", 0.30, -1),
    ("stability", "tremor_power_8_12", 1.50, 1),
)
WEIGHTS = {"rir": 0.25, "rpe": 0.25, "form": 0.5}


def _mean(values: Column) -> Column:
    """Mean of an array's values that aren't null, added from the first on. An aggregate that falls back to sorting adds
    parts of a group for themselves, which changes last bits, and with them ties."""
    there = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))


def form_subscores(reps: DataFrame, key: str, rep: str, completed: str, channels: dict[str, str] | None = None, norm_ref: DataFrame | None = None, n_ref: int = 3) -> DataFrame:
    """Long table: key, name, score (null without a reference), provisional, reference, mean, deviation, n_short, n_completed.

    ``channels`` maps a subscore to its column. ``norm_ref`` (name, ref_mean, ref_std) replaces the fixed scales by
    z-scores where its deviation is above 0. Nulls of a channel are left out of its means.
    """
    channels = channels or {name: channel for name, channel, _, _ in SUBSCORES}
    w = Window.partitionBy(key).orderBy(rep)
    done = reps.where(F.col(completed)).withColumn("_k", F.row_number().over(w))
    first = F.col("_k") <= n_ref
    held = F.array_sort(F.collect_list(F.struct("_k", first.alias("_first"), *(F.col(channels[name]).cast("double").alias(name) for name, _, _, _ in SUBSCORES))))
    means = {}
    for name, _, _, _ in SUBSCORES:
        means[f"_ref_{name}"] = _mean(F.filter("_held", lambda x: x["_first"])[name])
        means[f"_mean_{name}"] = _mean(F.col("_held")[name])
    done_sets = done.groupBy(key).agg(F.count("*").alias("_n"), held.alias("_held")).withColumns(means).drop("_held")
    sets = reps.select(key).distinct().join(done_sets, key, "left")
    rom = channels["rom_completeness"]
    short = done.join(sets.select(key, F.col("_ref_rom_completeness").alias("_ref")), key).groupBy(key).agg(F.sum((F.col(rom) < 0.9 * F.col("_ref")).cast("long")).alias("_short"))
    sets = sets.join(short, key, "left")
    rows = [
        F.struct(F.lit(name).alias("name"), F.col(f"_ref_{name}").alias("reference"), F.col(f"_mean_{name}").alias("mean"), F.lit(scale).alias("scale"), F.lit(float(sign)).alias("sign"), F.lit(1e-12 if sign > 0 else 0.0).alias("least"))
        for name, _, scale, sign in SUBSCORES
    ]
    long = sets.select(key, F.coalesce("_n", F.lit(0)).alias("n_completed"), "_short", F.explode(F.array(*rows)).alias("s")).select(key, "n_completed", "_short", "s.*")
    usable = (F.col("n_completed") >= n_ref + MIN_BEYOND_REFERENCE) & F.col("reference").isNotNull() & F.when(F.col("sign") > 0, F.col("reference") > F.col("least")).otherwise(F.col("reference") != 0)
    long = long.withColumn("deviation", F.when(usable, F.col("sign") * (F.col("mean") / F.col("reference") - 1)))
    fixed = 200 * (1 - 1 / (1 + F.exp(F.lit(-LN3) * F.greatest("deviation", F.lit(0.0)) / F.col("scale"))))
    if norm_ref is None:
        long = long.withColumns({"score": F.when(F.col("deviation").isNotNull(), fixed), "provisional": F.lit(True)})
    else:
        # A row for each subscore at most, so a small side; a second row for one is an error.
        once = lambda c: F.when(F.count("*") == 1, F.first(c)).otherwise(F.raise_error(F.lit("a subscore has more than one reference")).cast("double")).alias(c)
        norm = norm_ref.where(F.col("name").isin([name for name, *_ in SUBSCORES])).groupBy("name").agg(once("ref_mean"), once("ref_std"))
        long = long.join(F.broadcast(norm), "name", "left")
        z = (F.col("deviation") - F.coalesce("ref_mean", F.lit(0.0))) / F.col("ref_std")
        long = long.withColumns({"score": F.when(F.col("deviation").isNotNull(), F.when(F.col("ref_std") > 1e-12, squash(z, Z_NOTABLE)).otherwise(fixed)), "provisional": F.lit(False)})
    n_short = F.when(F.col("name") == "rom_completeness", F.col("_short"))
    return long.select(key, "name", "score", "provisional", "reference", "mean", "deviation", n_short.alias("n_short"), F.col("n_completed").cast("long").alias("n_completed"))


def pointers(subscores: DataFrame, trends: DataFrame, key: str) -> DataFrame:
    """One row per pointer: key, name, pos, text, magnitude, onset; only for scored rows.

    ``trends`` has key, name, total_change, slope and breakpoint of the subscore's channel.
    """
    rows = subscores.where("score is not null").join(trends, [key, "name"], "left")
    change, onset, dev = F.col("total_change"), F.col("breakpoint").cast("long"), F.col("deviation")
    whole = lambda c: F.bround(100 * c, 0).cast("long").cast("string")
    clause = lambda word: F.when(onset.isNull(), "").otherwise(F.concat(F.lit(f" {word} rep "), onset.cast("string")))
    text = (
        F.when((F.col("name") == "rom_completeness") & change.isNotNull(), F.concat(F.lit("Depth changed "), signed_percent(change), F.lit(" from first to last rep.")))
        .when(F.col("name") == "rom_completeness", F.concat(F.lit("Average depth was "), whole(1 - dev), F.lit("% of the opening reps.")))
        .when(F.col("name") == "path_consistency", F.concat(F.lit("Bar path diverged from baseline"), clause("starting"), F.lit(".")))
        .when((F.col("name") == "tempo_control") & change.isNotNull(), F.concat(F.lit("Eccentric duration changed "), signed_percent(change), F.lit(" across the set.")))
        .when(F.col("name") == "tempo_control", F.concat(F.lit("Eccentric duration changed "), signed_percent(-dev), F.lit(" from the opening reps.")))
        .when(change.isNotNull(), F.concat(F.lit("Tremor rose "), whole(change), F.lit("%"), clause("after"), F.lit(".")))
        .otherwise(F.concat(F.lit("Tremor rose "), whole(dev), F.lit("% from the opening reps.")))
    )
    magnitude = (
        F.when(F.col("name") == "path_consistency", F.coalesce(F.abs("slope"), F.greatest(dev, F.lit(0.0))))
        .when(change.isNotNull(), F.abs(change))
        .when(F.col("name") == "stability", F.greatest(dev, F.lit(0.0)))
        .otherwise(F.abs(dev))
    )
    main = F.struct(F.lit(0).alias("pos"), text.alias("text"), magnitude.alias("magnitude"), onset.alias("onset"))
    short = F.struct(F.lit(1).alias("pos"), F.concat(F.col("n_short").cast("string"), F.lit(" of "), F.col("n_completed").cast("string"), F.lit(" reps fell short of the opening depth.")).alias("text"), (F.col("n_short") / F.greatest("n_completed", F.lit(1))).alias("magnitude"), F.lit(None).cast("long").alias("onset"))
    both = F.when(F.col("n_short") > 0, F.array(main, short)).otherwise(F.array(main))
    return rows.select(key, "name", F.explode(both).alias("p")).select(key, "name", "p.*")


def form_score(subscores: DataFrame, key: str) -> DataFrame:
    """Mean of the subscores that there are, and whether it is provisional."""
    place = F.array_position(F.array(*[F.lit(name) for name, *_ in SUBSCORES]), F.col("name"))
    held = F.array_sort(F.collect_list(F.struct(place.alias("at"), F.col("score").alias("score"))))
    return subscores.groupBy(key).agg(_mean(F.transform(held, lambda x: x["score"])).alias("form_score"), F.bool_or("provisional").alias("provisional"))


def execution_narrative(subscores: DataFrame, points: DataFrame, key: str, most: int = 3, deficit: float = 15.0) -> DataFrame:
    """Key and text: the score, then the worst subscores' leading pointers, worst first and by name on ties."""
    top = Window.partitionBy(key, "name").orderBy(F.col("magnitude").desc(), "pos")
    lead = points.withColumn("_k", F.row_number().over(top)).where("_k = 1").select(key, "name", "text")
    low = subscores.where(F.lit(100.0) - F.col("score") >= deficit).join(lead, [key, "name"])
    rank = Window.partitionBy(key).orderBy(F.col("score"), "name")
    low = low.withColumn("_k", F.row_number().over(rank)).where(F.col("_k") <= most)
    body = low.groupBy(key).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("_k", "text"))), lambda s: s["text"])).alias("_body"))
    rows = form_score(subscores, key).join(body, key, "left")
    first = F.when(F.col("form_score").isNull(), "Form score unavailable (no reference).").otherwise(F.concat(F.lit("Form score "), F.bround("form_score", 0).cast("long").cast("string"), F.when(F.col("provisional"), " (provisional).").otherwise(".")))
    return rows.select(key, F.concat(first, F.lit(" "), F.coalesce("_body", F.lit("Form held across the set."))).alias("narrative"))


def composite(df: DataFrame, form: str, rir: str, rpe: str, target_rir: float = 0.0, target_rpe: float = 10.0, rir_tolerance: float = 3.0, rpe_tolerance: float = 3.0, gap: float = 30.0) -> DataFrame:
    """Adds rir_score, rpe_score, effort, total and divergent; what is missing leaves its weight to the rest."""
    parts = {"rir": proximity(F.col(rir), target_rir, rir_tolerance), "rpe": proximity(F.col(rpe), target_rpe, rpe_tolerance)}
    df = df.withColumns({f"{k}_score": F.when(F.col(c).isNotNull(), v) for (k, v), c in zip(parts.items(), (rir, rpe), strict=True)})
    there = lambda c, v: F.when(F.col(c).isNotNull(), v).otherwise(F.lit(0.0))
    columns = {"rir": "rir_score", "rpe": "rpe_score", "form": form}
    weight = sum((there(c, F.lit(WEIGHTS[k])) for k, c in columns.items()), F.lit(0.0))
    total = sum((there(c, F.col(c) * WEIGHTS[k]) for k, c in columns.items()), F.lit(0.0))
    n = there("rir_score", F.lit(1.0)) + there("rpe_score", F.lit(1.0))
    effort = F.when(n > 0, (there("rir_score", F.col("rir_score")) + there("rpe_score", F.col("rpe_score"))) / n)
    df = df.withColumns({"effort": effort, "total": F.when(weight > 0, total / weight)})
    return df.withColumn("divergent", F.coalesce(F.abs(F.col("effort") - F.col(form)) > gap, F.lit(False)))


def divergence(df: DataFrame, pmf: str, rpe: str, low: float = 0.10, high: float = 0.90) -> DataFrame:
    """Adds percentile (mid-P), mechanical_rpe, direction and alert; level k of the distribution is an RPE of 10 - k.

    Sums take the last level first, the rest, and then the levels in order, as the SQL does when run by one thread: where
    a percentile is at a bound but for rounding, the order decides."""
    turned = lambda v: F.concat(F.slice(v, -1, 1), F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))))
    add = lambda v: F.aggregate(turned(v), F.lit(0.0), lambda a, b: a + b)
    mass = add(F.col(pmf))
    p = F.transform(pmf, lambda x: x / mass)
    level = F.transform(pmf, lambda x, k: F.lit(10.0) - k)
    close = lambda x: F.abs(x - F.col(rpe)) <= 1e-8 + 1e-5 * F.abs(F.col(rpe))
    share = F.zip_with(p, level, lambda a, x: a * (F.when(x < F.col(rpe), 1.0).otherwise(0.0) + F.when(close(x), 0.5).otherwise(0.0)))
    valid = F.when(mass > 0, add(share)).otherwise(F.raise_error(F.lit("the distribution has no mass")).cast("double"))
    df = df.withColumns({"percentile": valid, "mechanical_rpe": add(F.zip_with(p, level, lambda a, x: a * x))})
    direction = F.when(F.col("percentile") < low, "under_reporting").when(F.col("percentile") > high, "over_reporting").otherwise("aligned")
    return df.withColumn("direction", direction).withColumn("alert", F.col("direction") != "aligned")


def rir_pmf(hazards: Column) -> Column:
    """Distribution of repetitions in reserve 0..K from the hazards of the next K: S(m) p(m+1), the rest at K."""
    start = F.struct(F.lit(1.0).alias("s"), F.array().cast("array<double>").alias("d"))
    walked = F.aggregate(hazards, start, lambda a, p: F.struct((a["s"] * (1 - p)).alias("s"), F.concat(a["d"], F.array(a["s"] * p)).alias("d")))
    return F.concat(walked["d"], F.array(walked["s"]))


def rir_range(df: DataFrame, key: str, pmf: str, mass: float = 0.6) -> DataFrame:
    """Key, lo, hi: the tightest interval of levels with at least ``mass``, the first of equals."""
    total = F.aggregate(pmf, F.lit(0.0), lambda a, b: a + b)
    levels = df.select(key, F.posexplode(F.transform(pmf, lambda p: p / total)).alias("_level", "_p"))
    w = Window.partitionBy(key, "_lo").orderBy("_level").rowsBetween(Window.unboundedPreceding, 0)
    spans = levels.join(levels.select(key, F.col("_level").alias("_lo")), key).where("_level >= _lo").withColumn("_m", F.sum("_p").over(w))
    full = spans.where(F.col("_m") >= mass).groupBy(key, "_lo").agg(F.min("_level").alias("_hi"))
    best = full.groupBy(key).agg(F.min(F.struct((F.col("_hi") - F.col("_lo")).alias("width"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))).alias("_b"))
    sizes = df.select(key, (F.size(pmf) - 1).alias("_k"))
    return sizes.join(best, key, "left").select(key, F.coalesce("_b.lo", F.lit(0)).cast("long").alias("lo"), F.coalesce("_b.hi", "_k").cast("long").alias("hi"))


def reps_left(lo: Column, hi: Column, k: int) -> Column:
    lo_, hi_ = lo.cast("string"), hi.cast("string")
    return (
        F.when(lo >= k, f"{k}+ reps left")
        .when(hi >= k, F.concat(lo_, F.lit("+ reps left")))
        .when((lo == 0) & (hi == 0), "no reps left")
        .when(lo == hi, F.concat(F.lit("about "), lo_, F.when(lo == 1, " rep left").otherwise(" reps left")))
        .otherwise(F.concat(lo_, F.lit("-"), hi_, F.lit(" reps left")))
    )


def effort_narrative(df: DataFrame, lo: str, hi: str, rpe: str, k: int = 8) -> DataFrame:
    """Adds ``narrative`` from a range (or nulls) and :func:`divergence`'s columns."""
    first = F.concat(F.lit("Estimated "), reps_left(F.col(lo), F.col(hi), k), F.lit(" at set end."))
    said, moved = plain_number(F.col(rpe)), F.bround("mechanical_rpe", 0).cast("long").cast("string")
    second = (
        F.when(F.col("direction") == "under_reporting", F.concat(F.lit("You reported RPE "), said, F.lit("; movement suggested closer to "), moved, F.lit(".")))
        .when(F.col("direction") == "over_reporting", F.concat(F.lit("You reported RPE "), said, F.lit(", above the "), moved, F.lit(" the movement suggested.")))
        .when(F.col("direction") == "aligned", "Reported effort matched the movement.")
    )
    text = F.concat_ws(" ", first, second)
    return df.withColumn("narrative", F.when(text == "", "Effort estimate unavailable.").otherwise(text))


def readiness(sets: DataFrame, failed: str, least: int = 15, settled: int = 30) -> DataFrame:
    """One row: n_sets, n_failure_sets, state, sets_needed and the sentence about it."""
    row = sets.agg(F.count("*").alias("n_sets"), F.count_if(F.col(failed)).alias("n_failure_sets"))
    n = F.col("n_failure_sets")
    state = F.when(n < least, "withheld").when(n < settled, "provisional").otherwise("settled")
    row = row.withColumns({"state": state, "sets_needed": F.greatest(F.lit(least) - n, F.lit(0)).cast("long")})
    need = F.col("sets_needed")
    text = (
        F.when(n < least, F.concat(F.lit("Reps-in-reserve needs "), need.cast("string"), F.when(need == 1, " more set").otherwise(" more sets"), F.lit(" taken to failure before it can be estimated ("), n.cast("string"), F.lit(f" of {least} so far).")))
        .when(n < settled, F.concat(F.lit("Reps-in-reserve is provisional: estimated from "), n.cast("string"), F.lit(f" failure sets, against {settled} for a settled estimate.")))
        .otherwise(F.concat(F.lit("Reps-in-reserve estimated from "), n.cast("string"), F.lit(" failure sets.")))
    )
    return row.withColumn("explanation", text)
