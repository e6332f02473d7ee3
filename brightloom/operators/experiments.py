"""Comparing runs: best steps, ranks, stability, ties and early stops over curves of (run, step, metric ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sampling

WER_TIE, CER_TIE = 0.003, 0.001


def best_steps(curve: DataFrame, run: str, step: str, metric: str, *others: str) -> DataFrame:
    """For each run its least metric, the first step that has it, and other columns at that step."""
    best = F.min(F.struct(F.col(metric), F.col(step), *[F.col(c) for c in others])).alias("b")
    return curve.where(F.col(metric).isNotNull()).groupBy(run).agg(best).select(run, F.col(f"b.{step}").alias("best_step"), F.col(f"b.{metric}").alias("best"), *[F.col(f"b.{c}") for c in others])


def means(curve: DataFrame, run: str, order: list[str], **metrics: Column) -> DataFrame:
    """For each run aggregates such as averages, whose rows are added one by one in `order`. A sum of doubles depends on the order of
    its terms, and so does whether it reaches a threshold; partial sums would be merged as tasks happen to hold them."""
    w = Window.partitionBy(run).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = curve.select("*", *[x.over(upto).alias(f"_m_{name}") for name, x in metrics.items()], F.lead(F.lit(1)).over(w).isNull().alias("_last"))
    return rows.where("_last").select(run, *[F.col(f"_m_{name}").alias(name) for name in metrics])


def so_far(curve: DataFrame, run: str, step: str, metric: str) -> DataFrame:
    """Adds best_before and is_best (strictly better than every step before)."""
    w = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    return curve.withColumn("best_before", F.min(metric).over(w)).withColumn("is_best", F.col("best_before").isNull() | (F.col(metric) < F.col("best_before")))


def early_stop(curve: DataFrame, run: str, step: str, metric: str, signal: str, least: float = 0.1, jump: float = 0.05) -> DataFrame:
    """Adds worsening (two steps in a row worse than the one before) and jumped (the signal high and up by `jump`)."""
    w = Window.partitionBy(run).orderBy(step)
    x, before, earlier = F.col(metric), F.lag(metric, 1).over(w), F.lag(metric, 2).over(w)
    rise = F.col(signal) - F.lag(signal, 1, 0.0).over(w)
    return curve.withColumns({"worsening": F.coalesce((x > before) & (before > earlier), F.lit(False)), "jumped": (F.col(signal) >= least) & (rise >= jump)})


def violations_in_a_row(df: DataFrame, run: str, step: str, bad: Column, patience: int) -> DataFrame:
    """Adds in_a_row (violations up to this step since the last good one) and stop."""
    w = Window.partitionBy(run).orderBy(step)
    df = df.withColumn("_bad", F.coalesce(bad, F.lit(False))).withColumn("_island", F.sum((~F.col("_bad")).cast("int")).over(w))
    count = F.sum(F.col("_bad").cast("int")).over(Window.partitionBy(run, "_island").orderBy(step))
    return df.withColumn("in_a_row", count).withColumn("stop", F.col("in_a_row") >= patience).drop("_bad", "_island")


def divergence(curve: DataFrame, run: str, step: str, loss: str) -> DataFrame:
    """Medians of each run's first and last three losses; diverged if the last is over 1.5 times, and at least 5 over, the first."""
    curve = curve.where(F.col(loss).isNotNull())
    up, down = Window.partitionBy(run).orderBy(step), Window.partitionBy(run).orderBy(F.desc(step))
    ranked = curve.withColumns({"_up": F.row_number().over(up), "_down": F.row_number().over(down)})
    out = ranked.groupBy(run).agg(F.count("*").alias("losses"), F.percentile(F.when(F.col("_up") <= 3, F.col(loss)), 0.5).alias("first_median"), F.percentile(F.when(F.col("_down") <= 3, F.col(loss)), 0.5).alias("last_median"))
    return out.withColumn("diverged", (F.col("losses") >= 6) & (F.col("last_median") > F.greatest(1.5 * F.col("first_median"), F.col("first_median") + 5)))


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """Adds the rank by the columns, ascending and nulls last; ties by the order of their hash."""
    keys = [F.struct(F.col(c).isNull(), F.col(c)).alias(f"_o{i}") for i, c in enumerate(order)]
    keyed = df.select("*", *keys, F.xxhash64(*df.columns).alias("_h"), F.lit(1.0).alias("_one"))
    out = sampling.running(keyed, [*[f"_o{i}" for i in range(len(order))], "_h"], "_one", "_before")
    return out.select((F.col("_before") + 1).cast("long").alias("rank"), *df.columns)


def stability(hallucination: Column, confusion: Column, *finite: Column, limit: float = 0.10) -> Column:
    """Reasons why a run is unstable, as an array."""
    checks = [("nonfinite_metric", ~x) for x in finite] + [("hallucination", hallucination >= limit), ("language_confusion", confusion >= limit)]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks]))


def first_failure(wer: Column, hallucination: Column, confusion: Column) -> Column:
    """The first gate that a run fails, else ok."""
    return F.when(wer.isNull(), "missing_wer").when(wer > 2, "wer_too_high").when(hallucination > 0.05, "hallucination").when(confusion > 0.05, "language_confusion").otherwise("ok")


def materially_better(wer: Column, cer: Column, control_wer: Column, control_cer: Column) -> Column:
    return (wer < control_wer - WER_TIE) | ((F.abs(wer - control_wer) <= WER_TIE) & (cer < control_cer - CER_TIE))


def winner(df: DataFrame, run: str, wer: str, cer: str, rate: str) -> DataFrame:
    """The best run by word error rate. If the next one is within WER_TIE, the lower character rate wins if they
    differ by CER_TIE or more, else the lower learning rate: (run, reason)."""
    order = (F.asc_nulls_last(wer), F.asc_nulls_last(cer), F.col(run))
    w = Window.orderBy(*order)
    top = df.orderBy(*order).limit(2)
    pairs = top.withColumns({f"_{c}": F.lead(c).over(w) for c in (run, wer, cer, rate)} | {"_r": F.row_number().over(w)}).where("_r = 1")
    tie = F.coalesce(F.abs(F.col(f"_{wer}") - F.col(wer)) < WER_TIE, F.lit(False))
    material = F.abs(F.col(f"_{cer}") - F.col(cer)) >= CER_TIE
    other = tie & F.when(material, F.col(f"_{cer}") < F.col(cer)).otherwise(F.col(f"_{rate}") < F.col(rate))
    reason = F.when(~tie, "lowest_wer").when(material, "lower_cer").otherwise("lower_rate")
    return pairs.select(F.when(other, F.col(f"_{run}")).otherwise(F.col(run)).alias(run), reason.alias("reason"))


def collate(df: DataFrame, history: str) -> DataFrame:
    """Adds train_loss_curve, validation_curve and best_validation (least wer, the earliest on ties) from an array of log entries
    (step, loss, eval_loss, eval_wer, eval_cer): entries with a loss, and entries with an evaluation."""
    h = F.col(history)
    losses = F.transform(F.filter(h, lambda e: e["loss"].isNotNull()), lambda e: F.struct(e["step"].alias("step"), e["loss"].alias("loss")))
    evaluations = F.filter(h, lambda e: e["eval_loss"].isNotNull())
    ranked = F.transform(F.filter(evaluations, lambda e: e["eval_wer"].isNotNull()), lambda e: F.struct(e["eval_wer"].alias("wer"), e["step"].alias("step"), e["eval_cer"].alias("cer")))
    return df.withColumns({"train_loss_curve": losses, "validation_curve": evaluations, "best_validation": F.array_min(ranked)})


def promoted(df: DataFrame, stable: Column, n: int, *order: Column) -> DataFrame:
    """The n best stable runs; raises if there is none."""
    out = df.where(F.coalesce(stable, F.lit(False))).orderBy(*order).limit(n)
    if out.isEmpty():
        raise ValueError("no stable run to promote")
    return out


def phases(df: DataFrame, screen: Column, final: Column, n: int, *order: Column) -> DataFrame:
    """Decision of each run after a screen and a full phase: reject, eligible or promote."""
    kept = promoted(df.where(F.coalesce(screen, F.lit(False))), final, n, *order)
    ids = kept.select(*df.columns).withColumn("_p", F.lit(True))
    marks = df.join(F.broadcast(ids), df.columns, "left")  # at most n rows
    return marks.withColumn("decision", F.when(F.col("_p"), "promote").when(screen & final, "eligible").otherwise("reject")).drop("_p")


def learning_rate_label(x: Column) -> Column:
    """Like 1m05 for 1e-05."""
    return F.replace(F.format_string("%.0e", x), F.lit("-"), F.lit("m"))


def candidates(base: DataFrame, grids: dict[str, list[float]]) -> DataFrame:
    """Every combination of the grids' rates that does not fall from block to block; grids are configuration, so the product is small."""
    out = base
    for name, values in grids.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    names = list(grids)
    for low, high in zip(names[:-1], names[1:], strict=True):
        out = out.where(F.col(low) <= F.col(high))
    return out


BLOCKS = ("encoder_block_a_lr", "encoder_block_b_lr", "encoder_block_c_lr", "encoder_block_d_lr")
# What a run's configuration must name, and its modes.
REQUIRED = ("model_name", "data_dir", "tuning_mode", "decoder_learning_rate", "per_device_batch_size", "gradient_accumulation_steps", "eval_steps", "save_steps")
MODES = ("decoder_only", "encoder_24_31_plus_decoder", "encoder_16_31_plus_decoder", "blockwise_encoder_lr")


def config_violations(config: dict, language: str = "uz", task: str = "transcribe") -> list[str]:
    """Names of the rules that a run's configuration breaks; those that need missing values are not checked."""
    if missing := [k for k in REQUIRED if config.get(k) is None]:
        return [f"missing:{k}" for k in missing]
    mode, rates = config["tuning_mode"], [float(config.get(k) or 0.0) for k in BLOCKS]
    blockwise = mode == "blockwise_encoder_lr"
    checks = {
        "unknown_tuning_mode": mode not in MODES,
        "decoder_rate_not_positive": float(config["decoder_learning_rate"]) <= 0,
        "block_rate_negative": blockwise and min(rates) < 0,
        "block_rates_fall": blockwise and rates != sorted(rates),
        "last_block_rate_not_positive": blockwise and rates[-1] <= 0,
        "encoder_rate_not_positive": not blockwise and mode != "decoder_only" and float(config.get("encoder_learning_rate") or 0) <= 0,
        "save_steps_no_multiple": int(config["save_steps"]) % int(config["eval_steps"]) != 0,
        "precision": not config.get("bf16") or bool(config.get("fp16")),
        "language_or_task": config.get("language") != language or config.get("task") != task,
        "test_split_used": bool(config.get("evaluate_test_after_training", True)) or bool(config.get("load_test_split", True)),
    }
    return [name for name, broken in checks.items() if broken]


def latest_checkpoint(df: DataFrame, path: str, run: str) -> DataFrame:
    """The path of the greatest number at its end, for each run."""
    step = F.nullif(F.regexp_extract(path, r"checkpoint-(\d+)$", 1), F.lit("")).try_cast("long")
    return df.withColumn("_step", step).where("_step IS NOT NULL").groupBy(run).agg(F.max_by(path, "_step").alias("path"), F.max("_step").alias("step"))


def collapse(df: DataFrame, group: str, flag: str) -> DataFrame:
    """all, none or mixed for each group."""
    state = F.when(F.bool_and(flag), "all").when(~F.bool_or(flag), "none").otherwise("mixed")
    return df.groupBy(group).agg(F.count("*").alias("parameters"), state.alias("state"))
