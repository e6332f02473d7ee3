"""Queries on experiment curves, telemetry, capacity and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import experiments, sampling, telemetry
from .base import CURVE, Tables, query, rounded

C = f"WITH {CURVE}"


@query(f"{C} SELECT run, b.step AS best_step, b.wer AS best, b.cer AS cer FROM (SELECT run, min({{'wer': wer, 'step': step, 'cer': cer}}) AS b FROM c GROUP BY ALL)")
def best_by_metric(t: Tables) -> DataFrame:
    return experiments.best_steps(t.curve(), "run", "step", "wer", "cer")


@query(f"""{C}, b AS (SELECT run, min({{'wer': wer, 'step': step, 'cer': cer}}) AS b FROM c GROUP BY ALL) SELECT run, row_number() OVER (ORDER BY b.wer, b.cer, run) AS rank FROM b""")
def experiment_rank(t: Tables) -> DataFrame:
    best = experiments.best_steps(t.curve(), "run", "step", "wer", "cer").withColumn("_one", F.lit(1.0))
    ranked = sampling.running(best, ["best", "cer", "run"], "_one", "_before")
    return ranked.select("run", (F.col("_before") + 1).cast("long").alias("rank"))


@query(f"""{C}, b AS (SELECT *, min(wer) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM c) SELECT run, step, wer, p IS NULL OR wer < p AS is_best FROM b""")
def best_so_far(t: Tables) -> DataFrame:
    return experiments.so_far(t.curve(), "run", "step", "wer").select("run", "step", "wer", "is_best")


@query(f"""{C} SELECT run, step, coalesce(wer > lag(wer) OVER w AND lag(wer) OVER w > lag(wer, 2) OVER w, false) AS worsening, cer >= 0.05 AND round(cer - lag(cer, 1, 0) OVER w, 9) >= 0.03 AS jumped FROM c WINDOW w AS (PARTITION BY run ORDER BY step)""")
def early_stop(t: Tables) -> DataFrame:
    curve = t.curve()
    out = experiments.early_stop(curve, "run", "step", "wer", "cer", 0.05, 0.03 - 1e-10)
    return out.select("run", "step", "worsening", "jumped")


@query(f"""{C}, i AS (SELECT *, cer > 0.04 AS bad, sum(CASE WHEN cer > 0.04 THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY step) AS island FROM c)
SELECT run, step, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY run, island ORDER BY step) AS BIGINT) AS in_a_row, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY run, island ORDER BY step) >= 3 AS stop FROM i""")
def patience_islands(t: Tables) -> DataFrame:
    return experiments.violations_in_a_row(t.curve(), "run", "step", F.col("cer") > 0.04, 3).select("run", "step", "in_a_row", "stop")


@query(f"""{C}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS u, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS d FROM c),
 m AS (SELECT run, count(*) AS losses, quantile_cont(loss, 0.5) FILTER (WHERE u <= 3) AS a, quantile_cont(loss, 0.5) FILTER (WHERE d <= 3) AS b FROM r GROUP BY ALL)
SELECT run, losses, round(a, 6) AS first_median, round(b, 6) AS last_median, losses >= 6 AND b > greatest(1.5 * a, a + 5) AS diverged FROM m""")
def loss_divergence(t: Tables) -> DataFrame:
    out = experiments.divergence(t.curve(), "run", "step", "loss")
    return out.withColumns({"first_median": rounded("first_median"), "last_median": rounded("last_median")})


@query(f"""{C}, b AS (SELECT run, avg(wer) AS wer, avg(cer) AS cer, max(loss) AS rate FROM c GROUP BY ALL HAVING count(*) >= 7), o AS (SELECT *, row_number() OVER (ORDER BY wer, cer, run) AS r FROM b)
SELECT CASE WHEN abs(y.wer - x.wer) < 0.003 AND CASE WHEN abs(y.cer - x.cer) >= 0.001 THEN y.cer < x.cer ELSE y.rate < x.rate END THEN y.run ELSE x.run END AS run,
 CASE WHEN abs(y.wer - x.wer) >= 0.003 THEN 'lowest_wer' WHEN abs(y.cer - x.cer) >= 0.001 THEN 'lower_cer' ELSE 'lower_rate' END AS reason FROM o x JOIN o y ON x.r = 1 AND y.r = 2""")
def tie_break_winner(t: Tables) -> DataFrame:
    runs = t.curve().groupBy("run").agg(F.avg("wer").alias("wer"), F.avg("cer").alias("cer"), F.max("loss").alias("rate"), F.count("*").alias("n")).where("n >= 7")
    return experiments.winner(runs, "run", "wer", "cer", "rate")


@query(f"""{C}, b AS (SELECT run, avg(wer) AS wer, max(cer) AS cer FROM c GROUP BY ALL)
SELECT run, array_to_string(list_filter([CASE WHEN cer >= 0.07 THEN 'hallucination' END, CASE WHEN wer >= 0.07 THEN 'language_confusion' END], lambda x: x IS NOT NULL), '|') AS unstable,
 CASE WHEN wer > 2 THEN 'wer_too_high' WHEN cer > 0.05 THEN 'hallucination' WHEN wer > 0.05 THEN 'language_confusion' ELSE 'ok' END AS note FROM b""")
def run_stability(t: Tables) -> DataFrame:
    b = t.averages(wer=F.avg("wer"), cer=F.max("cer"))
    wer, cer = F.col("wer"), F.col("cer")
    reasons = experiments.stability(cer, wer, limit=0.07)
    # As in the SQL, a run without a rate passes the gates on it.
    return b.select("run", F.array_join(reasons, "|").alias("unstable"), experiments.first_failure(F.coalesce(wer, F.lit(0.0)), cer, wer).alias("note"))


@query(f"""{C}, b AS (SELECT run, avg(wer) AS wer, avg(cer) AS cer FROM c GROUP BY ALL) SELECT run, wer < 0.05 - 0.003 OR (abs(wer - 0.05) <= 0.003 AND cer < 0.04 - 0.001) AS better FROM b""")
def materially_better(t: Tables) -> DataFrame:
    b = t.averages(wer=F.avg("wer"), cer=F.avg("cer"))
    return b.select("run", experiments.materially_better(F.col("wer"), F.col("cer"), F.lit(0.05), F.lit(0.04)).alias("better"))


@query(f"""{C}, b AS (SELECT run, avg(wer) AS wer, avg(cer) AS cer FROM c GROUP BY ALL) SELECT run, round(wer, 6) AS wer FROM b WHERE wer <= 0.05 ORDER BY b.wer, cer, run LIMIT 2""")
def top_two(t: Tables) -> DataFrame:
    """The two best of the runs that pass a gate go on to the next phase."""
    b = t.curve().groupBy("run").agg(F.avg("wer").alias("wer"), F.avg("cer").alias("cer"))
    return b.where("wer <= 0.05").orderBy("wer", "cer", "run").limit(2).select("run", rounded("wer").alias("wer"))


@query(f"""WITH g(v) AS (VALUES (1e-6), (5e-6), (1e-5)) SELECT a.v AS a, b.v AS b, d.v AS d FROM g a, g b, g d WHERE a.v <= b.v AND b.v <= d.v""")
def candidate_grid(t: Tables) -> DataFrame:
    """Learning rates that do not fall from block to block."""
    return experiments.candidates(t.spark.range(1).drop("id"), {k: [1e-6, 5e-6, 1e-5] for k in ("a", "b", "d")})


@query("SELECT p_partkey, replace(printf('%.0e', p_retailprice / 1e8), '-', 'm') AS label FROM part")
def rate_labels(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", experiments.learning_rate_label(F.col("p_retailprice") / 1e8).alias("label"))


@query("SELECT o_custkey, max(o_orderkey) AS step, arg_max(concat('run/checkpoint-', o_orderkey), o_orderkey) AS path FROM orders GROUP BY ALL")
def latest_checkpoint(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", F.concat(F.lit("run/checkpoint-"), "o_orderkey").alias("path"))
    return experiments.latest_checkpoint(rows, "path", "o_custkey")


@query("SELECT event_type, count(value) AS samples, round(avg(value), 6) AS average, max(value) AS peak FROM events GROUP BY ALL")
def telemetry_summary(t: Tables) -> DataFrame:
    return telemetry.summary(t.events, "value", "event_type").withColumn("average", rounded("average"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY ALL")
def latency_percentiles(t: Tables) -> DataFrame:
    out = telemetry.percentiles(t.events, "value", [0.5, 0.95, 0.99], "event_type")
    return out.select("event_type", *[rounded(c).alias(c) for c in ("p50", "p95", "p99")])


@query("SELECT event_type, round(sum(value), 4) AS audio_seconds, round(sum(value + 1), 4) AS wall_seconds, round(sum(value + 1) / sum(value), 6) AS rtf, round(sum(value) / sum(value + 1), 6) AS speed, round(avg(value + 1), 6) AS average_latency FROM events GROUP BY ALL")
def throughput(t: Tables) -> DataFrame:
    out = telemetry.throughput(t.events.withColumn("wall", F.col("value") + 1), "value", "wall", "event_type")
    return out.select("event_type", rounded("audio_seconds", 4).alias("audio_seconds"), rounded("wall_seconds", 4).alias("wall_seconds"), *[rounded(c).alias(c) for c in ("rtf", "speed", "average_latency")])


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(value) AS samples, round(avg(value), 6) AS average, max(value) AS peak FROM events GROUP BY ALL")
def telemetry_tumbling(t: Tables) -> DataFrame:
    out = t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("value").alias("samples"), rounded(F.avg("value")).alias("average"), F.max("value").alias("peak"))
    return out.select(F.col("w.start").alias("start"), "event_type", "samples", "average", "peak")


@query("SELECT b - to_minutes(30 * k) AS start, count(value) AS samples, round(avg(value), 6) AS average FROM (SELECT time_bucket(INTERVAL '30 minutes', ts) AS b, value, unnest([0, 1]) AS k FROM events) GROUP BY ALL")
def telemetry_sliding(t: Tables) -> DataFrame:
    out = t.events.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("value").alias("samples"), rounded(F.avg("value")).alias("average"))
    return out.select(F.col("w.start").alias("start"), "samples", "average")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL '30 minutes' THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS rows FROM s GROUP BY user_id, k""")
def event_sessions(t: Tables) -> DataFrame:
    out = t.events.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("rows"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows")


@query("""WITH i AS (SELECT *, value < 50 AS good, sum(CASE WHEN value < 50 THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY event_id) AS b FROM events)
SELECT event_id, CAST(sum(CASE WHEN good THEN 1 ELSE 0 END) OVER w AS BIGINT) AS run, sum(CASE WHEN good THEN 1 ELSE 0 END) OVER w >= 3 AS ready FROM i WINDOW w AS (PARTITION BY event_type, b ORDER BY event_id)""")
def idle_gate(t: Tables) -> DataFrame:
    return telemetry.islands(t.events, "event_type", "event_id", F.col("value") < 50, 3).select("event_id", "run", "ready")


SCENARIOS = [(100, 1.0), (1000, 1.25), (10000, 1.25)]


@query("""WITH h AS (SELECT p_partkey, p_size / 5.0 AS speed, 0.7 AS utilization, 1 + p_size % 8 AS gpus_a_server, p_retailprice / 1000 AS hourly FROM part), s(streams, redundancy) AS (VALUES (100, 1.0), (1000, 1.25), (10000, 1.25)),
 x AS (SELECT *, greatest(CAST(speed AS DOUBLE) * 0.7, 1e-9) AS e FROM h, s), g AS (SELECT *, CAST(ceil(streams * CAST(redundancy AS DOUBLE) / e) AS BIGINT) AS gpus FROM x)
SELECT p_partkey, streams, gpus, CAST(ceil(gpus / gpus_a_server) AS BIGINT) AS servers, round(gpus * hourly * 730, 4) AS monthly_cost, round(gpus * hourly * 730 * 12, 4) AS annual_cost, round(hourly / e, 6) AS cost_per_audio_hour FROM g""")
def capacity_plan(t: Tables) -> DataFrame:
    c = F.col
    hardware = t.part.select("p_partkey", (c("p_size") / 5.0).alias("speed"), F.lit(0.7).alias("utilization"), (1 + c("p_size") % 8).alias("gpus_a_server"), (c("p_retailprice") / 1000).alias("hourly"))
    scenarios = t.spark.createDataFrame(SCENARIOS, "streams int, redundancy double")
    out = telemetry.capacity_plan(hardware, scenarios)
    return out.select("p_partkey", "streams", "gpus", "servers", rounded("monthly_cost", 4).alias("monthly_cost"), rounded("annual_cost", 4).alias("annual_cost"), rounded("cost_per_audio_hour").alias("cost_per_audio_hour"))


@query("SELECT p_brand, arg_min(p_partkey, (p_retailprice, p_partkey)) AS cheapest, arg_max(p_partkey, (p_size, p_partkey)) AS fastest FROM part GROUP BY ALL")
def best_hardware(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("cheapest"), F.max_by("p_partkey", F.struct("p_size", "p_partkey")).alias("fastest"))


@query("SELECT p_partkey, CAST(1 + CASE WHEN p_size > 10 THEN 0.15 ELSE 0 END + CASE WHEN p_size > 20 THEN 0.3 ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 0.05 ELSE 0 END AS DOUBLE) AS multiplier, format('${:,.2f}', p_retailprice) AS price FROM part")
def pipeline_multiplier(t: Tables) -> DataFrame:
    s = F.col("p_size")
    return t.part.select("p_partkey", numeric.multiplier((s > 10, 0.15), (s > 20, 0.3), (s % 2 == 0, 0.05)).alias("multiplier"), text.money(F.col("p_retailprice")).alias("price"))


@query("SELECT l_orderkey, l_linenumber, round(100.0 * l_linenumber / 7, 6) AS percent, round(l_quantity / l_linenumber * (7 - l_linenumber), 6) AS eta_seconds FROM lineitem")
def training_eta(t: Tables) -> DataFrame:
    p = numeric.progress(F.col("l_linenumber"), F.lit(7), F.col("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", rounded(p["percent"]).alias("percent"), rounded(p["eta_seconds"]).alias("eta_seconds"))


RECORDS = """WITH RECURSIVE o AS (SELECT l_suppkey AS g, l_quantity AS d, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS i FROM lineitem),
 r(g, i, d, n, s) AS (SELECT g, i, d, CAST(0 AS BIGINT), d FROM o WHERE i = 1 UNION ALL SELECT o.g, o.i, o.d, CASE WHEN r.s >= 1800 THEN r.n + 1 ELSE r.n END, CASE WHEN r.s >= 1800 THEN o.d ELSE r.s + o.d END FROM r JOIN o ON o.g = r.g AND o.i = r.i + 1)
SELECT g AS l_suppkey, CAST(n AS INTEGER) AS recording, count(*) AS clips, round(sum(d), 6) AS seconds FROM r GROUP BY ALL"""


@query(RECORDS)
def virtual_recordings(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("at"), "l_quantity", "l_orderkey")
    out = telemetry.recordings(rows, "l_suppkey", "at", "l_quantity", "l_orderkey", 1800.0)
    return out.select("l_suppkey", "recording", "clips", rounded("seconds").alias("seconds"))


@query("SELECT event_id, CAST(strftime(ts, '%Y-%m-%dT%H:%M:%S') AS VARCHAR) AS iso, isfinite(value) AS finite FROM events")
def iso_timestamps(t: Tables) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return t.events.select("event_id", F.when(F.try_to_timestamp(iso).isNotNull(), iso).alias("iso"), numeric.finite(F.col("value")).alias("finite"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS rows FROM lineitem GROUP BY ALL")
def large_aggregate(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), rounded(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), rounded(F.avg("l_discount")).alias("avg_discount"), F.count("*").alias("rows")
    )


@query(f"""{C} SELECT run, count(loss) AS losses, count(wer) AS evaluations, min({{'wer': wer, 'step': step, 'cer': cer}}).step AS best_step, min(wer) AS best_wer FROM c GROUP BY ALL""")
def metrics_collation(t: Tables) -> DataFrame:
    """Curves and the best evaluation of each run, from its log entries."""
    entry = F.struct("step", "loss", F.col("wer").alias("eval_loss"), F.col("wer").alias("eval_wer"), F.col("cer").alias("eval_cer"))
    logs = t.curve().groupBy("run").agg(F.array_sort(F.collect_list(entry)).alias("history"))
    out = experiments.collate(logs, "history")
    return out.select("run", F.size("train_loss_curve").cast("long").alias("losses"), F.size("validation_curve").cast("long").alias("evaluations"), F.col("best_validation.step").alias("best_step"), F.col("best_validation.wer").alias("best_wer"))


@query(f"""{C}, b AS (SELECT run, avg(wer) AS wer, avg(cer) AS cer FROM c GROUP BY ALL HAVING count(*) >= 7), r AS (SELECT *, row_number() OVER (ORDER BY wer, run) AS r FROM b WHERE cer <= 0.05 AND wer <= 0.06)
SELECT b.run, CASE WHEN r.r <= 2 THEN 'promote' WHEN b.cer <= 0.05 AND b.wer <= 0.06 THEN 'eligible' ELSE 'reject' END AS decision FROM b LEFT JOIN r USING (run)""")
def promotion_phases(t: Tables) -> DataFrame:
    b = t.curve().groupBy("run").agg(F.avg("wer").alias("wer"), F.avg("cer").alias("cer"), F.count("*").alias("n")).where("n >= 7").drop("n")
    return experiments.phases(b, F.col("cer") <= 0.05, F.col("wer") <= 0.06, 2, F.col("wer"), F.col("run")).select("run", "decision")
