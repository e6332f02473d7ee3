"""Leakage audits, governance checks and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stats(df: DataFrame, *group: str) -> DataFrame:
    """rows, hours, distinct non-blank speakers and mean quality of each group."""
    measures = [F.count("*").alias("rows"), (F.sum("duration") / 3600).alias("hours"), F.count_distinct(F.nullif(F.col("speaker_id"), F.lit(""))).alias("speakers")]
    return df.groupBy(*group).agg(*measures)


def class_histogram(df: DataFrame, group: str, column: str) -> DataFrame:
    """One map of class to rows for each group."""
    counts = df.groupBy(group, column).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias("classes"))


def split_summary(df: DataFrame, split: str = "split", dataset: str = "dataset_id") -> DataFrame:
    """Rows and hours of each split and dataset, with subtotals (null dataset) and the total."""
    return df.rollup(split, dataset).agg(F.count("*").alias("rows"), (F.sum("duration") / 3600).alias("hours"))


def leaks(df: DataFrame, keys: dict[str, list[str]], split: str = "split") -> DataFrame:
    """(check, violations): how many keys of each kind occur in more than one split. Only distinct (key, split) pairs are exchanged."""
    out = None
    for name, columns in keys.items():
        ok = F.coalesce(F.col(columns[0]).cast("string"), F.lit("")) != ""
        many = df.where(ok).select(*columns, split).distinct().groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
        row = many.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("status", F.when(F.col("violations") == 0, "pass").otherwise("fail"))


def shared(df: DataFrame, key: Column, a: str, b: str, split: str = "split") -> DataFrame:
    """Keys that occur in both splits."""
    keyed = df.select(key.alias("key"), split)
    return keyed.where(F.col(split) == a).select("key").intersect(keyed.where(F.col(split) == b).select("key"))


def composition(df: DataFrame, targets: dict[str, float], dataset: str = "dataset_id", tolerance: float = 0.015) -> DataFrame:
    """Share of hours of each dataset against its target."""
    goal = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
    hours = df.groupBy(dataset).agg((F.sum("duration") / 3600).alias("hours"))
    total = hours.agg(F.sum("hours").alias("_all"))
    shares = hours.crossJoin(F.broadcast(total)).withColumn("share", F.try_divide("hours", "_all"))  # one row
    target = F.coalesce(goal[F.col(dataset)], F.lit(0.0))
    return shares.withColumn("target", target).withColumn("ok", F.abs(F.col("share") - F.col("target")) <= tolerance).drop("_all")


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require(df: DataFrame, required: list[str]) -> DataFrame:
    if lost := missing_columns(df, required):
        raise ValueError(f"missing columns: {lost}")
    return df


def matches(actual: DataFrame, expected: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Expected values that the actual ones miss by more than the tolerance, or that are not there."""
    both = expected.select(key, F.col(value).alias("expected")).join(actual.select(key, F.col(value).alias("actual")), key, "left")
    return both.where(F.col("actual").isNull() | (F.abs(F.col("actual") - F.col("expected")) > tolerance))


def flags(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c)).alias(c) for c in columns])


def share_of_total(df: DataFrame, value: str) -> Column:
    return F.col(value) / F.sum(value).over(Window.partitionBy())


def changed(actual: DataFrame, expected: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys whose digest is not the expected one, or that are gone: a guard for files that must stay as they are."""
    both = expected.select(key, F.col(digest).alias("expected")).join(actual.select(key, F.col(digest).alias("actual")), key, "left")
    return both.where(~F.col("actual").eqNullSafe(F.col("expected")))
