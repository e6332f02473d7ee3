"""Reports on runs, subsets and documents: schedules, comparisons, totals, and checks that give rows of problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import writers
from . import experiments

# The encoder's blocks and the layers in them, the columns of their rates, signs of failure in a log.
LAYERS = {"encoder_0_7": (0, 7), "encoder_8_15": (8, 15), "encoder_16_23": (16, 23), "encoder_24_31": (24, 31)}
RATES = dict(zip(experiments.BLOCKS, LAYERS, strict=True)) | {"decoder_learning_rate": "decoder"}
FAILURES = ("safety_stop", "cuda oom", "non-finite loss")
WARNING = "safety_warning"


def parameter_group(name: Column, blockwise: bool) -> Column:
    """The rate group of a model parameter; a layer beyond the last block is an error."""
    layer = F.nullif(F.regexp_extract(name, r"^model\.encoder\.layers\.(\d+)\.", 1), F.lit("")).cast("int")
    group = F.when(layer.isNull(), "encoder_other")
    for block, (first, last) in LAYERS.items():
        group = group.when(layer.between(first, last), block)
    group = group.otherwise(F.raise_error(F.concat(F.lit("no block for "), name)).cast("string")) if blockwise else F.lit("encoder")
    return F.when(name.startswith("model.encoder."), group).otherwise("other")


def parameter_totals(df: DataFrame, size: str, trainable: str, *group: str) -> DataFrame:
    """Parameters, trainable ones and their percentage (0 if there are none)."""
    total, own = F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(F.col(trainable), F.col(size))), F.lit(0))
    share = F.when(total > 0, own / total * 100.0).otherwise(0.0)
    return df.groupBy(*group).agg(total.alias("total_parameters"), own.alias("trainable_parameters"), share.alias("trainable_percent"))


def startup_rates(config: dict) -> dict[str, float]:
    """The rate of each block and the decoder that a configuration starts with."""
    decoder = float(config.get("decoder_learning_rate", config.get("learning_rate")))
    if config.get("tuning_mode") == "blockwise_encoder_lr":
        rates = [float(config.get(c) or 0.0) for c in experiments.BLOCKS]
    else:
        rates = [float(config.get("encoder_learning_rate", config.get("learning_rate")))] * len(LAYERS)
    return dict(zip(LAYERS, rates, strict=True)) | {"decoder": decoder}


def overrides(name: str, rates: list[float], decoder: float, max_steps: int | None = None) -> dict:
    """What a candidate sets in its run's configuration."""
    out = {"experiment_name": name, **dict(zip(experiments.BLOCKS, rates, strict=True)), "decoder_learning_rate": decoder, "learning_rate": decoder}
    return out if max_steps is None else out | {"max_steps": max_steps}


def log_signs(df: DataFrame, log: str, failures: tuple[str, ...] = FAILURES, warning: str = WARNING) -> DataFrame:
    """Adds stability_failures (the signs that the log has, in their order) and safety_warning_count, whatever the case; a null log has none."""
    low = F.lower(F.coalesce(F.col(log), F.lit("")))
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(x)), F.lit(x)) for x in failures]))
    count = (F.length(low) - F.length(F.replace(low, F.lit(warning), F.lit("")))) / len(warning)
    return df.withColumns({"stability_failures": found, "safety_warning_count": count.cast("long")})


def schedule(rates: dict[str, Column]) -> Column:
    """A schedule struct: a rate for each block and the decoder; blocks that are not named stay at 0."""
    return F.struct(*[F.coalesce(rates.get(k, F.lit(0.0)), F.lit(0.0)).cast("double").alias(k) for k in RATES.values()])


def run_rows(df: DataFrame, schedule_col: str = "blockwise_schedule") -> DataFrame:
    """`df` with each rate column taken from the schedule where it is null, and runtime_hours."""
    rates = {c: F.coalesce(F.col(c), F.col(schedule_col)[field]) for c, field in RATES.items()}
    return df.withColumns(rates | {"runtime_hours": F.coalesce(F.col("runtime_seconds"), F.lit(0.0)) / 3600})


def ranked_rows(df: DataFrame, wer: str = "wer", cer: str = "cer", stable: str = "stable") -> DataFrame:
    """Adds rank: by word error rate, then character error rate (nulls last), then stable runs first."""
    out = experiments.ranked(df.withColumn("_unstable", ~F.coalesce(F.col(stable), F.lit(False))), wer, cer, "_unstable")
    return out.drop("_unstable")


def best_schedule(df: DataFrame, run: str, wer: str, cer: str, rate: str, decoder: str) -> DataFrame:
    """The best run (least wer, cer, then name) with its single encoder rate as a schedule of the last block; raises without any."""
    top = df.where(F.col(wer).isNotNull()).orderBy(wer, F.asc_nulls_last(cer), run).limit(1)
    if top.isEmpty():
        raise ValueError("no completed run to take a schedule from")
    return top.withColumn("blockwise_schedule", schedule({"encoder_24_31": F.col(rate), "decoder": F.col(decoder)}))


def comparison(references: DataFrame, metrics: DataFrame, run: str) -> DataFrame:
    """references(name, run, dataset) with each run's wer and cer as strings: of the test where there is one, else of
    the validation; `unavailable` for runs without metrics."""
    value = lambda k: F.coalesce(F.col(f"test_{k}"), F.col(k)).cast("string")
    joined = references.join(metrics.withColumn("_there", F.lit(True)), run, "left")
    says = lambda k: F.when(F.col("_there"), value(k)).otherwise("unavailable").alias(k)
    notes = F.when(F.col("_there"), "see source metrics").otherwise("unavailable").alias("notes")
    return joined.select("name", "dataset", says("wer"), says("cer"), notes)


def recommendation(title: str, selected: dict, compared: DataFrame) -> str:
    """A Markdown report: the schedule, the winning run's figures and the comparison."""
    rates = selected.get("blockwise_schedule") or {}
    lines = [f"# {title}", "", "## Recommended schedule", ""]
    lines += [f"- {field} = `{rates.get(field, selected.get(column))}`" for column, field in reversed(RATES.items())]
    lines += ["", "## Evidence", ""] + [f"- {k}: `{v}`" for k, v in selected.items() if k not in ("blockwise_schedule", *RATES)]
    return "\n".join([*lines, "", "## Comparison", "", writers.markdown(compared)])


def status(step: int, kind: str, facts: dict, samples: list[dict] = (), stop_reason: str | None = None) -> tuple[dict, str]:
    """A run's status as a payload and as Markdown."""
    payload = {"type": kind, "step": step, **facts, "samples": list(samples), "stop_reason": stop_reason}
    lines = [f"# Status: step {step}", "", f"- Type: `{kind}`", *[f"- {k}: `{v}`" for k, v in facts.items()]]
    lines += [f"- Stop reason: `{stop_reason}`"] if stop_reason else []
    for x in samples:
        lines += ["", f"### Sample {x['index']}", *[f"- {k}: `{v}`" for k, v in x.items() if k != "index"]]
    return payload, "\n".join(lines) + "\n"


def sample_predictions(df: DataFrame, ident: str, prediction: str, reference: str, signs: dict[str, Column], n: int) -> list[dict]:
    """The first n predictions (a sample for a report) with their indicators."""
    rows = df.orderBy(ident).limit(n).select(F.col(ident).alias("index"), F.col(prediction).alias("prediction"), F.col(reference).alias("reference"), F.struct(*[c.alias(k) for k, c in signs.items()]).alias("indicators"))
    return [r.asDict(recursive=True) for r in rows.collect()]


def subset_report(df: DataFrame, shares: dict[str, float], source: str = "dataset_id", duration: str = "duration") -> DataFrame:
    """(source, hours, share, samples, target_share) for each source that has a target; 0 where nothing was taken."""
    targets = df.sparkSession.createDataFrame(list(shares.items()), f"{source} string, target_share double")
    have = df.groupBy(source).agg((F.sum(duration) / 3600).alias("hours"), F.count("*").alias("samples"))
    total = df.agg((F.coalesce(F.sum(duration), F.lit(0.0)) / 3600).alias("_all"))
    rows = targets.join(have, source, "left").crossJoin(F.broadcast(total)).na.fill({"hours": 0.0, "samples": 0})  # one row
    return rows.select(source, "hours", F.when(F.col("_all") > 0, F.col("hours") / F.col("_all")).otherwise(0.0).alias("share"), "samples", "target_share")


def export_summary(df: DataFrame, datasets: list[str], dataset: str = "dataset_id", split: str = "split", reason: str = "reason") -> DataFrame:
    """For the chosen datasets and each split: rows, accepted and rejected ones."""
    bad = F.count_if(F.coalesce(F.col(reason), F.lit("")) != "")
    return df.where(F.col(dataset).isin(datasets)).groupBy(dataset, split).agg(F.count("*").alias("rows"), (F.count("*") - bad).alias("accepted"), bad.alias("rejected"))


def hash_violations(actual: DataFrame, expected: DataFrame, key: str, value: str = "sha256") -> DataFrame:
    """(key, expected, actual) where a pinned hash is not what is there now; actual is null for what has gone."""
    a, e = actual.select(key, F.col(value).alias("actual")), expected.select(key, F.col(value).alias("expected"))
    return e.join(a, key, "left").where(~F.col("expected").eqNullSafe(F.col("actual"))).select(key, "expected", "actual")


def document_problems(
    files: DataFrame, required: list[str], least: int = 800, allowed: list[str] | None = None, index: str | None = None, phrases: list[str] = (), protected: list[str] = ()
) -> DataFrame:
    """(problem, subject) over files(name, length, text): missing or short required files, files that are not allowed, files
    that the index does not name, phrases that no file has, missing protected files."""
    spark = files.sparkSession
    listed = lambda names: spark.createDataFrame([(x,) for x in names], "subject string")
    named = files.select(F.col("name").alias("subject"), "length", "text")
    there = listed(required).join(named, "subject", "left")
    problems = [
        there.where("length IS NULL").select(F.lit("missing").alias("problem"), "subject"),
        there.where(F.col("length") < least).select(F.lit("too_short").alias("problem"), "subject"),
        listed(protected).join(named, "subject", "left_anti").select(F.lit("protected_missing").alias("problem"), "subject"),
    ]
    if allowed is not None:
        problems.append(named.join(listed(allowed), "subject", "left_anti").select(F.lit("unexpected").alias("problem"), "subject"))
    if index is not None:
        text = named.where(F.col("subject") == index).agg(F.coalesce(F.max("text"), F.lit("")).alias("_index"))  # one row
        names = listed([x for x in required if x != index]).crossJoin(F.broadcast(text))
        problems.append(names.where(~F.contains("_index", "subject")).select(F.lit("not_in_index").alias("problem"), "subject"))
    if phrases:
        seen = named.agg(*[F.coalesce(F.max(F.contains(F.col("text"), F.lit(x))), F.lit(False)).alias(str(i)) for i, x in enumerate(phrases)])
        pairs = F.array(*[F.struct(F.lit(x).alias("subject"), F.col(str(i)).alias("has")) for i, x in enumerate(phrases)])
        problems.append(seen.select(F.inline(pairs)).where("NOT has").select(F.lit("phrase_missing").alias("problem"), "subject"))
    out = problems[0]
    for p in problems[1:]:
        out = out.unionByName(p)
    return out
