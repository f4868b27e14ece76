"""Registered queries of the operators on sets, users and models, on orders and their lines, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import RPE_LEVELS, expected, first_argmax, level_index, pmf_from_cumulative, round_half
from ..operators import evaluate, reps, scoring, trajectory
from ..sources import metadata
from .sequence_queries import STATS
from .tables import EVENTS, LINES, SETS, events, lines, r, rounded, sets, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {LINES} SELECT set_id, rep_index, count(*) OVER (PARTITION BY set_id) - rep_index AS reps_remaining, rep_index = max(rep_index) OVER (PARTITION BY set_id) AS is_last FROM li")
def rep_reps_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reps.with_remaining(lines(spark, sf_dir), "set_id", "rep_index").select("set_id", "rep_index", "reps_remaining", "is_last")


@query(f"WITH {LINES}, {SETS} SELECT set_id, user_id, exercise, rep_index, rom, CASE WHEN failed AND rep_index = max(rep_index) OVER (PARTITION BY set_id) THEN 1 ELSE 0 END AS y FROM li JOIN se USING (set_id)")
def rep_person_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reps.person_period(lines(spark, sf_dir), sets(spark, sf_dir), "set_id", "rep_index", "failed")
    return df.select("set_id", "user_id", "exercise", "rep_index", "rom", "y")


@query(f"WITH {LINES}, d AS (SELECT set_id, rep_index, row_number() OVER (PARTITION BY set_id ORDER BY rep_index) AS completed_rank FROM li WHERE completed) SELECT *, completed_rank <= 3 AS is_reference FROM d")
def rep_reference_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reps.reference_block(lines(spark, sf_dir), "set_id", "rep_index", "completed").select("set_id", "rep_index", "completed_rank", "is_reference")


CHANNELS = {"rom_completeness": "rom", "path_consistency": "path", "tempo_control": "ecc", "stability": "tremor"}
FORM = f"""{LINES}, dn AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY rep_index) k FROM li WHERE completed),
ag AS (SELECT set_id, count(*) n, avg(rom) FILTER (WHERE k <= 3) r1, avg(rom) m1, avg(path) FILTER (WHERE k <= 3) r2, avg(path) m2, avg(ecc) FILTER (WHERE k <= 3) r3, avg(ecc) m3, avg(tremor) FILTER (WHERE k <= 3) r4, avg(tremor) m4 FROM dn GROUP BY 1),
sh AS (SELECT dn.set_id, sum((rom < 0.9::DOUBLE * r1)::INT) sh FROM dn JOIN ag USING (set_id) GROUP BY 1),
al AS (SELECT DISTINCT set_id FROM li), wi AS (SELECT al.set_id, coalesce(n, 0) n_completed, ag.* EXCLUDE (set_id, n), sh FROM al LEFT JOIN ag USING (set_id) LEFT JOIN sh USING (set_id)),
lo AS (SELECT set_id, n_completed, sh, 'rom_completeness' AS name, r1 AS reference, m1 AS mean, 0.15::DOUBLE sc, -1 sg FROM wi UNION ALL SELECT set_id, n_completed, NULL, 'path_consistency', r2, m2, 0.6, 1 FROM wi UNION ALL SELECT set_id, n_completed, NULL, 'tempo_control', r3, m3, 0.3, -1 FROM wi UNION ALL SELECT set_id, n_completed, NULL, 'stability', r4, m4, 1.5, 1 FROM wi),
dv AS (SELECT *, CASE WHEN n_completed >= 5 AND reference IS NOT NULL THEN sg * (mean / reference - 1) END AS deviation FROM lo),
sb AS (SELECT *, CASE WHEN deviation IS NOT NULL THEN 200 * (1 - 1 / (1 + exp(-ln(3.0::DOUBLE) * greatest(deviation, 0) / sc))) END AS score FROM dv)"""


def _subscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.form_subscores(lines(spark, sf_dir), "set_id", "rep_index", "completed", CHANNELS)


@query(f"WITH {FORM} SELECT set_id, name, {r('score')} AS score, true AS provisional, {r('reference')} AS reference, {r('mean')} AS mean, {r('deviation')} AS deviation, CAST(sh AS BIGINT) AS n_short, n_completed FROM sb")
def form_subscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_subscores(spark, sf_dir))


@query(f"WITH {FORM} SELECT set_id, {r('avg(score)')} AS form_score, true AS provisional FROM sb GROUP BY 1")
def form_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.form_score(_subscores(spark, sf_dir), "set_id"))


def _trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = trajectory.long_channels(lines(spark, sf_dir), ["set_id", "rep_index"], tuple(CHANNELS.values()))
    names = F.create_map(*[F.lit(x) for k, v in CHANNELS.items() for x in (v, k)])
    found = trajectory.summarize(long, ["set_id", "channel"], ["rep_index"], "value")
    return found.select("set_id", names[F.col("channel")].alias("name"), "total_change", "slope", "breakpoint")


HALF_EVEN = "CAST(round_even({0}, 0) AS BIGINT)"
POINTERS = f"""{FORM}, un AS (SELECT set_id, rep_index, 'rom_completeness' AS name, rom v FROM li UNION ALL SELECT set_id, rep_index, 'path_consistency', path FROM li UNION ALL SELECT set_id, rep_index, 'tempo_control', ecc FROM li UNION ALL SELECT set_id, rep_index, 'stability', tremor FROM li),
src AS (SELECT (set_id, name) g, rep_index o, v y FROM un), {STATS},
tr AS (SELECT g[1] AS set_id, g[2] AS name, CASE WHEN n >= 2 AND abs(first) > 1e-12 THEN (last - first) / first END AS ch, CASE WHEN n >= 2 THEN slope END AS slope, CASE WHEN n >= 4 AND one > 1e-12 * greatest(syy, 1) THEN bk + 1 END AS bp FROM s LEFT JOIN b USING (g)),
jo AS (SELECT sb.*, ch, slope, bp FROM sb LEFT JOIN tr USING (set_id, name) WHERE score IS NOT NULL),
po AS (SELECT set_id, name, 0 AS pos,
 CASE WHEN name = 'rom_completeness' AND ch IS NOT NULL THEN 'Depth changed ' || printf('%+d', {HALF_EVEN.format('100 * ch')}) || '% from first to last rep.'
 WHEN name = 'rom_completeness' THEN 'Average depth was ' || {HALF_EVEN.format('100 * (1 - deviation)')} || '% of the opening reps.'
 WHEN name = 'path_consistency' THEN 'Bar path diverged from baseline' || coalesce(' starting rep ' || bp, '') || '.'
 WHEN name = 'tempo_control' AND ch IS NOT NULL THEN 'Eccentric duration changed ' || printf('%+d', {HALF_EVEN.format('100 * ch')}) || '% across the set.'
 WHEN name = 'tempo_control' THEN 'Eccentric duration changed ' || printf('%+d', {HALF_EVEN.format('-100 * deviation')}) || '% from the opening reps.'
 WHEN ch IS NOT NULL THEN 'Tremor rose ' || {HALF_EVEN.format('100 * ch')} || '%' || coalesce(' after rep ' || bp, '') || '.'
 ELSE 'Tremor rose ' || {HALF_EVEN.format('100 * deviation')} || '% from the opening reps.' END AS text,
 CASE WHEN name = 'path_consistency' THEN coalesce(abs(slope), greatest(deviation, 0)) WHEN ch IS NOT NULL THEN abs(ch) WHEN name = 'stability' THEN greatest(deviation, 0) ELSE abs(deviation) END AS magnitude, CAST(bp AS BIGINT) AS onset FROM jo
UNION ALL SELECT set_id, name, 1, sh || ' of ' || n_completed || ' reps fell short of the opening depth.', sh / greatest(n_completed, 1), NULL FROM jo WHERE sh > 0)"""


@query(f"WITH {POINTERS} SELECT set_id, name, pos, text, {r('magnitude')} AS magnitude, onset FROM po")
def form_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.pointers(_subscores(spark, sf_dir), _trends(spark, sf_dir), "set_id"))


@query(f"""WITH {POINTERS}, tp AS (SELECT set_id, name, text FROM po QUALIFY row_number() OVER (PARTITION BY set_id, name ORDER BY magnitude DESC, pos) = 1),
lw AS (SELECT sb.set_id, text, row_number() OVER (PARTITION BY sb.set_id ORDER BY score, name) k FROM sb JOIN tp USING (set_id, name) WHERE 100 - score >= 15),
bo AS (SELECT set_id, string_agg(text, ' ' ORDER BY k) body FROM lw WHERE k <= 3 GROUP BY 1), fs AS (SELECT set_id, avg(score) f FROM sb GROUP BY 1)
SELECT set_id, CASE WHEN f IS NULL THEN 'Form score unavailable (no reference).' ELSE 'Form score ' || {HALF_EVEN.format('f')} || ' (provisional).' END || ' ' || coalesce(body, 'Form held across the set.') AS narrative FROM fs LEFT JOIN bo USING (set_id)""")
def narrative_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = _subscores(spark, sf_dir)
    return scoring.execution_narrative(subs, scoring.pointers(subs, _trends(spark, sf_dir), "set_id"), "set_id")


BASE = f"""{LINES}, {SETS}, dn AS (SELECT set_id, count(*) d FROM li WHERE completed GROUP BY 1), ow AS (SELECT se.*, coalesce(d, 0) d FROM se LEFT JOIN dn USING (set_id)),
jn AS (SELECT a.set_id, a.d own, b.d, b.day < a.day earlier, b.day = a.day AND b.set_id < a.set_id AND b.exercise <> '' same, coalesce(a.load <= 0, true) OR abs(b.load - a.load) / a.load <= 0.1 band FROM ow a LEFT JOIN ow b ON a.user_id = b.user_id AND a.exercise = b.exercise AND b.d > 0 AND b.day <= a.day),
ti AS (SELECT set_id, CAST(coalesce(sum(d) FILTER (WHERE earlier AND band), 0) AS BIGINT) AS n_history, CAST(coalesce(sum(d) FILTER (WHERE same), 0) AS BIGINT) AS n_warmup, least(max(own), 3) AS n_early FROM jn GROUP BY 1)"""


@query(f"WITH {BASE} SELECT *, CASE WHEN n_history >= 2 THEN 'cross_session' WHEN n_warmup >= 2 THEN 'warmup' WHEN n_early >= 2 THEN 'early_set' ELSE 'none' END AS source, CASE WHEN n_history >= 2 THEN n_history WHEN n_warmup >= 2 THEN n_warmup WHEN n_early >= 2 THEN n_early ELSE 0 END AS n_reps FROM ti")
def baseline_tier_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sets(spark, sf_dir).withColumn("warmup", F.lit(True))
    found = reps.baseline_tiers(df, lines(spark, sf_dir), "set_id", "user_id", "exercise", "day", "set_id", "load", "warmup", "completed")
    return found.select("set_id", *[F.col(c).cast("long").alias(c) for c in ("n_history", "n_warmup", "n_early", "n_reps")], "source")


@query(f"WITH {SETS} SELECT a.set_id, count(*) AS n_in_band FROM se a JOIN se b ON a.user_id = b.user_id AND abs(b.load - a.load) / a.load <= 0.1 WHERE b.set_id <> a.set_id GROUP BY 1")
def baseline_load_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = sets(spark, sf_dir).alias("a"), sets(spark, sf_dir).alias("b")
    both = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.set_id") != F.col("b.set_id")) & reps.in_load_band(F.col("b.load"), F.col("a.load")))
    return both.groupBy(F.col("a.set_id").alias("set_id")).agg(F.count("*").alias("n_in_band"))


COMPOSITE = f"""{SETS}, vi AS (SELECT set_id, CASE WHEN set_id % 5 <> 0 THEN (set_id % 101)::DOUBLE END AS form, CASE WHEN set_id % 3 <> 0 THEN (set_id % 9)::DOUBLE / 2 END AS rir, CASE WHEN set_id % 7 <> 0 THEN 6 + (set_id % 9) / 2.0::DOUBLE END AS rpe FROM se),
sc AS (SELECT *, least(greatest(100 * (1 - abs(rir - 0) / 3), 0), 100) a, least(greatest(100 * (1 - abs(rpe - 10) / 3), 0), 100) b FROM (SELECT * FROM vi)), sd AS (SELECT set_id, form, CASE WHEN rir IS NOT NULL THEN a END a, CASE WHEN rpe IS NOT NULL THEN b END b FROM sc),
co AS (SELECT *, (coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0) AS effort, (coalesce(a * 0.25::DOUBLE, 0) + coalesce(b * 0.25::DOUBLE, 0) + coalesce(form * 0.5::DOUBLE, 0)) / nullif(0.25::DOUBLE * (a IS NOT NULL)::INT + 0.25::DOUBLE * (b IS NOT NULL)::INT + 0.5::DOUBLE * (form IS NOT NULL)::INT, 0) AS total FROM sd)"""


@query(f"WITH {COMPOSITE} SELECT set_id, {r('a')} AS rir_score, {r('b')} AS rpe_score, {r('effort')} AS effort, {r('total')} AS total, coalesce(abs(effort - form) > 30, false) AS divergent FROM co")
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("set_id")
    df = sets(spark, sf_dir).select("set_id", F.when(k % 5 != 0, (k % 101).cast("double")).alias("form"), F.when(k % 3 != 0, (k % 9).cast("double") / 2).alias("rir"), F.when(k % 7 != 0, 6 + (k % 9) / F.lit(2.0)).alias("rpe"))
    df = scoring.composite(df, "form", "rir", "rpe")
    return rounded(df.select("set_id", "rir_score", "rpe_score", "effort", "total", "divergent"))


HAZARD = f"""{EVENTS}, hz AS (SELECT user_id, i, least(greatest(value / 200, 0.02), 0.9) h FROM ev WHERE i < 8),
sv AS (SELECT user_id, i AS k, h, coalesce(product(1 - h) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) s FROM hz),
pm AS (SELECT user_id, k, s * h AS p FROM sv UNION ALL SELECT user_id, 8, product(1 - h) FROM hz GROUP BY 1)"""


def _pmfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.least(F.greatest(F.col("value") / 200, F.lit(0.02)), F.lit(0.9))
    per = events(spark, sf_dir).where("i < 8").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", h.alias("h")))), lambda s: s["h"]).alias("hazards"))
    return per.select("user_id", scoring.rir_pmf(F.col("hazards")).alias("pmf"), (6 + (F.col("user_id") % 9) / F.lit(2.0)).alias("rpe"))


@query(f"WITH {HAZARD} SELECT user_id, CAST(k AS BIGINT) AS k, {r('p')} AS p FROM pm")
def rir_survival_pmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _pmfs(spark, sf_dir).select("user_id", F.posexplode("pmf").alias("k", "p"))
    return rounded(df.select("user_id", F.col("k").cast("long").alias("k"), "p"))


RANGE = f"""{HAZARD}, cu AS (SELECT a.user_id, a.k lo, b.k hi, sum(b.p) OVER (PARTITION BY a.user_id, a.k ORDER BY b.k ROWS UNBOUNDED PRECEDING) m FROM pm a JOIN pm b ON a.user_id = b.user_id AND b.k >= a.k),
rg AS (SELECT user_id, lo, min(hi) hi FROM cu WHERE m >= 0.6 GROUP BY 1, 2), rr AS (SELECT user_id, lo, hi FROM rg QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY hi - lo, lo) = 1)"""


@query(f"WITH {RANGE} SELECT user_id, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM rr")
def rir_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rir_range(_pmfs(spark, sf_dir), "user_id", "pmf")


DIVERGENCE = f"""{RANGE}, rp AS (SELECT pm.*, 6 + (user_id % 9) / 2.0::DOUBLE AS rpe, sum(p) OVER (PARTITION BY user_id) t FROM pm),
pc AS (SELECT user_id, any_value(rpe) rpe, sum(p / t * CASE WHEN 10 - k < rpe AND abs(10 - k - rpe) > 1e-4 THEN 1 WHEN abs(10 - k - rpe) <= 1e-4 THEN 0.5 ELSE 0 END) AS percentile, sum(p / t * (10 - k)) AS mechanical_rpe FROM rp GROUP BY 1),
dr AS (SELECT *, CASE WHEN percentile < 0.1 THEN 'under_reporting' WHEN percentile > 0.9 THEN 'over_reporting' ELSE 'aligned' END AS direction FROM pc)"""


@query(f"WITH {DIVERGENCE} SELECT user_id, {r('percentile')} AS percentile, {r('mechanical_rpe')} AS mechanical_rpe, direction, direction <> 'aligned' AS alert FROM dr")
def divergence_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scoring.divergence(_pmfs(spark, sf_dir), "pmf", "rpe")
    return rounded(df.select("user_id", "percentile", "mechanical_rpe", "direction", "alert"))


SAID = "regexp_replace(CAST(rpe AS VARCHAR), '\\.0$', '')"


@query(f"""WITH {DIVERGENCE} SELECT user_id, 'Estimated ' || CASE WHEN lo >= 8 THEN '8+ reps left' WHEN hi >= 8 THEN lo || '+ reps left' WHEN lo = 0 AND hi = 0 THEN 'no reps left' WHEN lo = hi THEN 'about ' || lo || CASE WHEN lo = 1 THEN ' rep left' ELSE ' reps left' END ELSE lo || '-' || hi || ' reps left' END || ' at set end. ' ||
CASE direction WHEN 'under_reporting' THEN 'You reported RPE ' || {SAID} || '; movement suggested closer to ' || {HALF_EVEN.format('mechanical_rpe')} || '.' WHEN 'over_reporting' THEN 'You reported RPE ' || {SAID} || ', above the ' || {HALF_EVEN.format('mechanical_rpe')} || ' the movement suggested.' ELSE 'Reported effort matched the movement.' END AS narrative FROM dr JOIN rr USING (user_id)""")
def narrative_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _pmfs(spark, sf_dir)
    df = scoring.divergence(df, "pmf", "rpe").join(scoring.rir_range(df, "user_id", "pmf"), "user_id")
    return scoring.effort_narrative(df, "lo", "hi", "rpe").select("user_id", "narrative")


@query(f"WITH {SETS} SELECT exercise, count(*) AS n_failure_sets FROM se WHERE failed GROUP BY 1")
def readiness_by_exercise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets(spark, sf_dir).where("failed").groupBy("exercise").agg(F.count("*").alias("n_failure_sets"))


@query(f"WITH {SETS}, n AS (SELECT count(*) AS n_sets, count(*) FILTER (WHERE failed) AS n_failure_sets FROM se) SELECT *, CASE WHEN n_failure_sets < 15 THEN 'withheld' WHEN n_failure_sets < 30 THEN 'provisional' ELSE 'settled' END AS state, CAST(greatest(15 - n_failure_sets, 0) AS BIGINT) AS sets_needed, CASE WHEN n_failure_sets < 15 THEN 'Reps-in-reserve needs ' || (15 - n_failure_sets) || CASE WHEN n_failure_sets = 14 THEN ' more set' ELSE ' more sets' END || ' taken to failure before it can be estimated (' || n_failure_sets || ' of 15 so far).' WHEN n_failure_sets < 30 THEN 'Reps-in-reserve is provisional: estimated from ' || n_failure_sets || ' failure sets, against 30 for a settled estimate.' ELSE 'Reps-in-reserve estimated from ' || n_failure_sets || ' failure sets.' END AS explanation FROM n")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.readiness(sets(spark, sf_dir), "failed")


SCORED = f"{EVENTS}, sc AS (SELECT user_id, event_id, least(value / 100, 1) AS p, (event_type IN ('error', 'purchase'))::INT AS y FROM ev)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("user_id", "event_id", F.least(F.col("value") / 100, F.lit(1.0)).alias("p"), F.col("event_type").isin("error", "purchase").cast("int").alias("y"))


CALIBRATION = f"{SCORED}, bi AS (SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, avg(p) AS predicted, avg(y) AS observed FROM sc GROUP BY 1)"


@query(f"WITH {CALIBRATION} SELECT bin, n, {r('predicted')} AS predicted, {r('observed')} AS observed FROM bi")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.calibration(_scored(spark, sf_dir), "p", "y"))


@query(f"WITH {CALIBRATION} SELECT {r('avg(abs(predicted - observed))')} AS mad FROM bi")
def calibration_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.calibration_mad(_scored(spark, sf_dir), "p", "y"))


@query(f"WITH {SCORED}, rk AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS k FROM sc) SELECT {r('(sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))')} AS auc FROM rk")
def auc_average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.auc(_scored(spark, sf_dir), "p", "y"))


@query(f"WITH {EVENTS}, v AS (SELECT user_id, i, value FROM ev) SELECT a.user_id, count(*) AS pairs, {r('avg(CASE WHEN abs(a.value - b.value) <= 1e-8 + 1e-5 * abs(b.value) THEN 0.5 WHEN a.value < b.value THEN 1 ELSE 0 END)')} AS concordance FROM v a JOIN v b ON a.user_id = b.user_id AND a.i < b.i GROUP BY 1")
def completed_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all pairs of a user's events."""
    df = events(spark, sf_dir).select("user_id", F.col("i").alias("truth"), "value")
    return rounded(evaluate.concordance(df, "user_id", "truth", "value"))


@query("SELECT round(avg((abs(l_discount * 100 - l_tax * 100) <= 1 + 1e-9)::INT), 6) + 0.0 AS accuracy FROM lineitem")
def accuracy_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 100).alias("a"), (F.col("l_tax") * 100).alias("b"))
    return rounded(df.agg(evaluate.within(df, "a", "b").alias("accuracy")))


@query(f"WITH {SETS} SELECT exercise, count(*) AS n FROM se GROUP BY 1 ORDER BY n DESC, min(set_id) LIMIT 1")
def majority_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.majority(sets(spark, sf_dir), "exercise", "set_id")


@query(f"WITH m AS (SELECT avg(l_quantity) a, stddev_pop(l_quantity) b, avg(l_extendedprice) c, stddev_pop(l_extendedprice) d FROM lineitem) SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {r('(l_quantity - a) / b')} AS z_l_quantity, {r('(l_extendedprice - c) / d')} AS z_l_extendedprice FROM lineitem, m")
def standardize_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evaluate.standardized(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return rounded(df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "z_l_quantity", "z_l_extendedprice"))


@query(f"SELECT {r('corr(l_quantity, l_extendedprice)')} AS r FROM lineitem")
def pearson_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.pearson(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"))


@query(f"WITH c AS (SELECT l_quantity a, l_extendedprice b, l_discount c FROM lineitem), q AS (SELECT corr(a, b) x, corr(a, c) y, corr(b, c) z FROM c), t AS (SELECT *, 1 + 2 * x * y * z - x * x - y * y - z * z d FROM q) SELECT name, {r('v')} AS vif FROM t, LATERAL (VALUES ('l_quantity', (1 - z * z) / d), ('l_extendedprice', (1 - y * y) / d), ('l_discount', (1 - x * x) / d)) u(name, v)")
def vif_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.vif(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(spark.createDataFrame(list(found.items()), "name string, vif double"))


@query("SELECT CASE WHEN c_custkey % 10 < 3 THEN 'test' ELSE 'train' END AS part, count(*) AS n, count(DISTINCT o_custkey) AS users FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def split_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "user_id")
    held = table(spark, sf_dir, "customer").where("c_custkey % 10 < 3").select(F.col("c_custkey").alias("user_id"))
    train, test = evaluate.split_by_user(orders, "user_id", held)
    count = lambda df, part: df.agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return count(train, "train").unionByName(count(test, "test"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def metadata_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def metadata_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return metadata.orphans(orders, "k", table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))).select(F.col("k").alias("o_orderkey"))


@query(f"WITH {LINES} SELECT set_id, rep_index, printf('%d:rep%03d', set_id, rep_index) AS rep_id FROM li ORDER BY 1, 2")
def metadata_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the repetitions of every set."""
    df = lines(spark, sf_dir)
    return df.select("set_id", "rep_index", metadata.rep_id(F.col("set_id").cast("string"), F.col("rep_index")).alias("rep_id")).orderBy("set_id", "rep_index")


@query(f"""WITH q AS (SELECT o_orderkey, 5.5 + (o_orderkey % 53) / 10.0::DOUBLE AS rpe FROM orders) SELECT o_orderkey, CAST(least(greatest(ceil((rpe - 6.0) / 0.5 - 0.5), 0), 8) AS INT) AS level, round_even(2 * rpe, 0) / 2 AS half FROM q""")
def rpe_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", (F.lit(5.5) + (F.col("o_orderkey") % 53) / F.lit(10.0)).alias("rpe"))
    return df.select("o_orderkey", level_index(F.col("rpe")).alias("level"), round_half(F.col("rpe")).alias("half"))


@query(f"""WITH z AS (SELECT o_orderkey, k, CASE WHEN k = 8 THEN 1 ELSE 1 - 1 / (1 + exp(-((o_orderkey % 41) / 10.0::DOUBLE - 2 - k / 2.0::DOUBLE))) END c FROM orders, unnest(generate_series(0, 8)) t(k)),
d AS (SELECT *, greatest(c - coalesce(lag(c) OVER (PARTITION BY o_orderkey ORDER BY k), 0), 0) p FROM z), n AS (SELECT o_orderkey, k, p / sum(p) OVER (PARTITION BY o_orderkey) p FROM d)
SELECT o_orderkey, {r('sum(p * (6 + k / 2.0::DOUBLE))')} AS expected_rpe, CAST(min_by(k, (-round(p, 9), k)) AS BIGINT) AS level FROM n GROUP BY 1""")
def rpe_pmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.columns import sigmoid

    z = (F.col("o_orderkey") % 41) / F.lit(10.0) - 2
    at_most = F.array(*[1 - sigmoid(z - k / 2.0) for k in range(8)], F.lit(1.0))
    df = table(spark, sf_dir, "orders").select("o_orderkey", at_most.alias("c")).select("o_orderkey", pmf_from_cumulative(F.col("c")).alias("p"))
    level = first_argmax(F.transform("p", lambda p: F.round(p, 9)))
    return rounded(df.select("o_orderkey", expected(F.col("p"), RPE_LEVELS).alias("expected_rpe"), level.cast("long").alias("level")))
