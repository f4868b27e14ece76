"""Registered queries of the sequence operators, on the events of each user, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reps, sequence, trajectory
from .tables import EVENTS, events, r, rounded

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


STATS = """
p AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY o) - 1.0::DOUBLE AS x, y FROM src WHERE y IS NOT NULL),
s AS (SELECT g, count(*) n, regr_slope(y, x) slope, regr_intercept(y, x) icept, min_by(y, x) first, max_by(y, x) last, regr_syy(y, x) syy,
  (var_pop(x) * covar_pop(x * x, y) - covar_pop(x, x * x) * covar_pop(x, y)) / nullif(var_pop(x) * var_pop(x * x) - pow(covar_pop(x, x * x), 2), 0) curv,
  greatest(regr_syy(y, x) - pow(regr_sxy(y, x), 2) / nullif(regr_sxx(y, x), 0), 0) one FROM p GROUP BY g),
d AS (SELECT g, max(abs(y - slope * x - icept)) dev FROM p JOIN s USING (g) GROUP BY g),
k AS (SELECT g, k, x, y FROM p JOIN s USING (g), unnest(generate_series(2, n - 2)) t(k) WHERE n >= 4),
h AS (SELECT g, k, x < k AS l, greatest(regr_syy(y, x) - pow(regr_sxy(y, x), 2) / nullif(regr_sxx(y, x), 0), 0) sse FROM k GROUP BY ALL),
b AS (SELECT g, min_by(k, (round(sse / one, 9), k)) bk, min_by(sse, (round(sse / one, 9), k)) two FROM (SELECT g, k, sum(sse) sse FROM h GROUP BY ALL) JOIN s USING (g) WHERE one > 1e-12 * greatest(syy, 1) GROUP BY g)
"""
SUMMARY = f"""{r('CASE WHEN n >= 2 THEN slope END')} AS slope, {r('CASE WHEN n >= 3 THEN curv END')} AS curvature, {r('CASE WHEN n >= 2 AND abs(first) > 1e-12 THEN (last - first) / first END')} AS total_change,
 {r('CASE WHEN n >= 2 THEN dev END')} AS max_dev, CASE WHEN n >= 4 AND one > 1e-12 * greatest(syy, 1) THEN bk + 1 END AS breakpoint, {r('CASE WHEN n >= 4 AND one > 1e-12 * greatest(syy, 1) THEN greatest(1 - two / one, 0) END')} AS breakpoint_gain"""


@query(f"WITH {EVENTS}, src AS (SELECT user_id g, i o, value y FROM ev), {STATS} SELECT g AS user_id, {SUMMARY} FROM s LEFT JOIN d USING (g) LEFT JOIN b USING (g)")
def seq_retro_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trajectory.summarize(events(spark, sf_dir), ["user_id"], ["i"], "value"))


@query(f"WITH {EVENTS} SELECT user_id, i, {r('regr_slope(value, i::DOUBLE) OVER w')} AS slope_to_date, {r('CASE WHEN i >= 1 AND abs(first(value) OVER w) > 1e-12 THEN value / first(value) OVER w - 1 END')} AS change_to_date FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING)")
def seq_causal_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectory.running_slope(events(spark, sf_dir), "user_id", ["i"], "value")
    return rounded(df.select("user_id", "i", "slope_to_date", "change_to_date"))


@query(f"WITH {EVENTS}, c AS (SELECT user_id, i, value FROM ev), src AS (SELECT (a.user_id, a.i) g, b.i o, b.value y FROM c a JOIN c b ON a.user_id = b.user_id AND b.i <= a.i), {STATS} SELECT g[1] AS user_id, g[2] AS up_to_rep, {SUMMARY} FROM s LEFT JOIN d USING (g) LEFT JOIN b USING (g)")
def seq_prefix_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To-date summaries of each sequence at every one of its values."""
    df = events(spark, sf_dir).select("user_id", "i", "value")
    return rounded(trajectory.to_date(df, ["user_id"], "i", "value").withColumnRenamed("up_to", "up_to_rep"))


@query(f"WITH {EVENTS}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY i) AS dt FROM ev) SELECT user_id, event_id, {r('dt', 3)} AS dt, coalesce(dt > 86400, false) AS gap FROM g")
def seq_gap_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sequence.steps(events(spark, sf_dir), "user_id", "t", 86400.0)
    return rounded(df.select("user_id", "event_id", "dt", "gap"), 3)


GRID = f"""WITH {EVENTS}, b AS (SELECT user_id, min(t) a, max(t) z FROM ev GROUP BY 1),
g AS (SELECT user_id, n, a + n * 43200.0::DOUBLE AS t FROM b, unnest(generate_series(0, CAST(floor((z - a) / 43200) AS BIGINT))) u(n)),
l AS (SELECT g.*, ev.t t0, ev.value v0 FROM g ASOF JOIN ev ON g.user_id = ev.user_id AND ev.t <= g.t),
f AS (SELECT l.*, ev.t t1, ev.value v1 FROM l ASOF LEFT JOIN ev ON l.user_id = ev.user_id AND ev.t >= l.t),
q AS (SELECT user_id, n, t, CASE WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END AS value FROM f)"""


@query(f"{GRID} SELECT user_id, n, {r('value', 5)} AS value FROM q")
def seq_uniform_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sequence.resample(events(spark, sf_dir), "user_id", "t", ["value"], 43200.0)
    return rounded(df.select("user_id", "n", "value"), 5)


@query(f"{GRID}, x AS (SELECT user_id, lag(t) OVER (PARTITION BY user_id ORDER BY i) a, t z FROM ev) SELECT DISTINCT q.user_id, n FROM q JOIN x ON q.user_id = x.user_id AND q.t BETWEEN x.a AND x.z WHERE z - a > 86400")
def seq_points_in_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    grid = sequence.resample(ev, "user_id", "t", ["value"], 43200.0)
    return sequence.in_intervals(grid, sequence.gap_intervals(ev, "user_id", "t", 86400.0), "user_id", "t", "gap_start", "gap_end").select("user_id", "n")


@query(f"WITH {EVENTS}, a AS (SELECT user_id, i, coalesce((value + lag(value) OVER (PARTITION BY user_id ORDER BY i)) / 2 * 0.01::DOUBLE, 0) p FROM ev) SELECT user_id, i, {r('sum(p) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING)', 6)} AS integral FROM a")
def seq_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sequence.trapezoid(events(spark, sf_dir), "user_id", "i", "value", "integral", 0.01)
    return rounded(df.select("user_id", "i", "integral"))


@query(f"""WITH {EVENTS}, c AS (SELECT *, value - 50 AS a, event_type = 'error' AS anchor FROM ev),
p AS (SELECT *, coalesce((a + lag(a) OVER w) / 2 * 0.01::DOUBLE, 0) s FROM c WINDOW w AS (PARTITION BY user_id ORDER BY i)),
v AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) raw FROM p),
k AS (SELECT user_id, i, raw FROM v WHERE anchor),
l AS (SELECT v.user_id, v.i, v.raw, k.i i0, k.raw r0 FROM v ASOF LEFT JOIN k ON v.user_id = k.user_id AND k.i <= v.i),
m AS (SELECT l.*, k.i i1, k.raw r1 FROM l ASOF LEFT JOIN k ON l.user_id = k.user_id AND k.i >= l.i),
z AS (SELECT user_id, i, raw - coalesce(CASE WHEN i0 IS NULL OR i1 IS NULL OR i0 = i1 THEN coalesce(r0, r1) ELSE r0 + (r1 - r0) * (i - i0) / (i1 - i0)::DOUBLE END, 0) AS velocity FROM m),
d AS (SELECT *, coalesce((velocity + lag(velocity) OVER (PARTITION BY user_id ORDER BY i)) / 2 * 0.01::DOUBLE, 0) s FROM z)
SELECT user_id, i, {r('velocity', 6)} AS velocity, {r('sum(s) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING)', 6)} AS displacement FROM d""")
def seq_zupt_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumns({"a": F.col("value") - 50, "anchor": F.col("event_type") == "error"})
    df = sequence.zero_velocity(df, "user_id", "i", "a", "anchor", 0.01)
    return rounded(df.select("user_id", "i", "velocity", "displacement"))


@query(f"""WITH {EVENTS}, e AS (SELECT user_id, min_by(value, i) a, max_by(value, i) z, count(*) n FROM ev GROUP BY 1),
o AS (SELECT user_id, i, j, CASE WHEN j < 0 THEN a WHEN j >= n THEN z END edge FROM ev JOIN e USING (user_id), unnest(generate_series(i - 3, i + 3)) u(j))
SELECT o.user_id, o.i, {r('sqrt(sum(pow(coalesce(edge, v.value), 2)) / 7)')} AS rms FROM o LEFT JOIN ev v ON o.user_id = v.user_id AND o.j = v.i GROUP BY 1, 2""")
def seq_rolling_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sequence.rolling_rms(events(spark, sf_dir), "user_id", "i", "value", 7)
    return rounded(df.select("user_id", "i", "rms"))


ISLANDS = f"WITH {EVENTS}, f AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) g FROM ev WHERE value < 60), u AS (SELECT user_id, min(i) run_start, max(i) run_end FROM f GROUP BY user_id, g HAVING count(*) >= 2)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.runs(events(spark, sf_dir).withColumn("low", F.col("value") < 60), "user_id", "i", "low", 2)


@query(f"{ISLANDS} SELECT user_id, run_start, run_end, (run_start + run_end) // 2 AS middle, run_end - run_start + 1 AS length FROM u")
def seq_stationary_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


BRIDGED = f"{ISLANDS}, x AS (SELECT *, coalesce(run_start - max(run_end) OVER (PARTITION BY user_id ORDER BY run_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 2, true) n FROM u), y AS (SELECT *, sum(n::INT) OVER (PARTITION BY user_id ORDER BY run_start ROWS UNBOUNDED PRECEDING) h FROM x), m AS (SELECT user_id, min(run_start) run_start, max(run_end) run_end, max(run_end) - min(run_start) + 1 AS length FROM y GROUP BY user_id, h)"


@query(f"{BRIDGED} SELECT user_id, run_start, run_end, length FROM m")
def seq_bridged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.bridged(_runs(spark, sf_dir), "user_id", 2)


@query(f"{BRIDGED} SELECT user_id, run_start, run_end, length FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, run_start) = 1")
def seq_longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.longest(sequence.bridged(_runs(spark, sf_dir), "user_id", 2), "user_id")


@query(f"SELECT user_id, {r('quantile_cont(value, 0.05)')} AS p5, {r('quantile_cont(value, 0.5)')} AS p50, {r('quantile_cont(value, 0.95)')} AS p95, {r('quantile_cont(value, 0.95) - quantile_cont(value, 0.05)')} AS span FROM events GROUP BY user_id")
def seq_percentile_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sequence.percentiles(events(spark, sf_dir), "user_id", "value", [0.05, 0.5, 0.95])
    return rounded(df.withColumn("span", F.col("p95") - F.col("p5")))


@query(f"WITH {EVENTS} SELECT user_id, min_by(i, (-value, i)) AS argmax, max(value) AS max, min_by(i, (value, i)) AS argmin, min(value) AS min FROM ev GROUP BY user_id")
def seq_argmax_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.first_extremes(events(spark, sf_dir), "user_id", "i", "value")


@query(f"""WITH {EVENTS}, v AS (SELECT user_id, i, round(value / 5) * 5 AS x FROM ev),
n AS (SELECT *, coalesce(x <> lag(x) OVER (PARTITION BY user_id ORDER BY i), true) c FROM v), g AS (SELECT *, sum(c::INT) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) h FROM n),
f AS (SELECT user_id, h, min(i) a, max(i) b, any_value(x) height FROM g GROUP BY 1, 2), w AS (SELECT *, lag(height) OVER q l, lead(height) OVER q z FROM f WINDOW q AS (PARTITION BY user_id ORDER BY h))
SELECT user_id, (a + b) // 2 AS i, height + 0.0 AS height FROM w WHERE height > l AND height > z""")
def seq_local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumn("x", F.round(F.col("value") / 5) * 5)
    return sequence.local_maxima(df, "user_id", "i", "x")


REP = f"{BRIDGED}, rp AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY run_start) AS rep, run_start lo, run_end hi FROM m)"


def _reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = sequence.bridged(_runs(spark, sf_dir), "user_id", 2)
    return sequence.numbered(spans, "user_id", "run_start", name="rep").select("user_id", (F.col("rep") + 1).alias("rep"), F.col("run_start").alias("lo"), F.col("run_end").alias("hi"))


@query(f"""{REP}, s AS (SELECT r.user_id, rep, lo, hi, i, value x, value - lag(value) OVER (PARTITION BY r.user_id, rep ORDER BY i) j FROM rp r JOIN ev ON r.user_id = ev.user_id AND i BETWEEN lo AND hi)
SELECT user_id, rep, count(*) AS n_samples, {r('avg(abs(x))')} AS mean_abs, {r('max(abs(x))')} AS peak_abs, {r('max(x) - min(x)')} AS extent, {r('coalesce(sqrt(avg(j * j * 10000)), 0)', 4)} AS jerk_rms, {r('CASE WHEN hi > lo THEN avg(x * x) ELSE 0 END', 7)} AS tremor_power FROM s GROUP BY user_id, rep, lo, hi""")
def rep_interval_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reps.slice_aggregates(events(spark, sf_dir), _reps(spark, sf_dir), "user_id", "rep", "i", "lo", "hi", "value", "value", 100.0)
    return rounded(df, jerk_rms=4, tremor_power=7)


@query(f"""{REP}, s AS (SELECT r.user_id, rep, i, value x, t / 86400 - 19723 y, event_id / 1000.0 z FROM rp r JOIN ev ON r.user_id = ev.user_id AND i BETWEEN lo AND hi),
d AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) st, sqrt(pow(x - first(x) OVER w, 2) + pow(y - first(y) OVER w, 2)) aw FROM s WINDOW w AS (PARTITION BY user_id, rep ORDER BY i))
SELECT user_id, rep, {r('coalesce(sum(st), 0)', 4)} AS path_length, {r('max(aw)', 4)} AS horizontal_excursion FROM d GROUP BY 1, 2""")
def rep_path_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, rp = events(spark, sf_dir), _reps(spark, sf_dir)
    both = rp.join(ev, "user_id").where("i between lo and hi").select("user_id", "rep", "i", F.col("value").alias("x"), (F.col("t") / 86400 - 19723).alias("y"), (F.col("event_id") / 1000.0).alias("z"))
    return rounded(reps.path_metrics(both, ["user_id", "rep"], "i", ("x", "y", "z")), 4)


@query(f"{ISLANDS} SELECT ev.user_id, ev.i, {r('coalesce((run_end - run_start + 1) / 100.0, 0)')} AS pause FROM ev LEFT JOIN u ON ev.user_id = u.user_id AND ev.i BETWEEN run_start AND run_end")
def rep_bottom_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reps.pauses(events(spark, sf_dir).select("user_id", "i"), _runs(spark, sf_dir), "user_id", "i", 100.0)
    return rounded(df)


@query(f"WITH {EVENTS}, c AS (SELECT user_id, event_id, value <= lag(value) OVER (PARTITION BY user_id ORDER BY i) b FROM ev) SELECT user_id, count(*) AS n_rows, count(*) FILTER (WHERE b) AS n_back FROM c GROUP BY 1")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.contract import clock_violations

    return clock_violations(events(spark, sf_dir), ["user_id"], ["i"], "value")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS features FROM events")
def json_feature_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).select("event_id", F.from_json("props", "k long").alias("f"))
    df = df.select("event_id", F.to_json("f").alias("features"))
    return df.select("event_id", F.from_json("features", "k long")["k"].alias("k"), "features")
