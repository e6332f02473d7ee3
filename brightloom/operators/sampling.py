"""Splits, budgets, strata and weighted samples.

Random orders are hash orders (`stable_key`), so that the same rows are taken on any cluster. A prefix sum over a
whole corpus does not run in one task: `running` sums over ranges of the order first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric
from .storage import cut


def stable_key(seed: int, *parts: Column | str) -> Column:
    """16 hex digits of SHA-256 over the seed and the parts, joined by zero bytes; orders like the unsigned number."""
    return F.substring(F.sha2(F.concat_ws("\0", F.lit(str(seed)), *[F.col(p) if isinstance(p, str) else p for p in parts]), 256), 1, 16)


def running(df: DataFrame, order: list[str], value: str, out: str, by: list[str] | None = None, ranges: int = 64) -> DataFrame:
    """Adds the sum of `value` over the rows before each (0 for the first), within `by`, in the order.

    Rows are dealt by ranges of (by, order): sums of the ranges are taken first, then a window runs within each
    range, so neither the whole table nor a large group meets in one task."""
    by = by or []
    ranged = cut(df.repartitionByRange(ranges, *by, *order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "_range").agg(F.sum(value).alias("_sum"))
    upto = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_range_of"), F.coalesce(F.sum("_sum").over(upto), F.lit(0.0)).alias("_until"))
    same = [F.col("_range") == F.col("_range_of"), *[F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]]
    w = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(before if by else F.broadcast(before), same)  # without `by` one row a range: at most `ranges`
    return joined.withColumn(out, F.col("_until") + F.coalesce(F.sum(value).over(w), F.lit(0.0))).drop("_range", "_range_of", "_until", *[f"_by_{c}" for c in by])


def budget(df: DataFrame, order: list[str], value: str, target: float, by: list[str] | None = None) -> DataFrame:
    """Rows in order until their sum reaches the target; the row that crosses it is taken."""
    return running(df, order, value, "_before_it", by).where(F.col("_before_it") < target).drop("_before_it")


def hours_budget(df: DataFrame, hours: float, seed: int, ident: str, duration: str = "duration", speaker: str = "speaker_id") -> DataFrame:
    """Rows of the rarest speakers first, short before long, until the hours are full."""
    counts = df.groupBy(speaker).agg(F.count("*").alias("_rank"))
    ranked = df.join(counts, speaker).withColumn("_key", stable_key(seed, F.col(ident).cast("string")))
    return budget(ranked, ["_rank", duration, "_key"], duration, hours * 3600).drop("_rank", "_key")


def floor_quantiles(df: DataFrame, value: str, bins: int, by: list[str]) -> DataFrame:
    """(by, boundaries): the values at rank floor(n * i / bins), from 0, for i = 1 to bins - 1."""
    n = df.groupBy(*by).agg(F.count("*").alias("_n"))
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy(value)
    upto = counts.withColumn("_upto", F.sum("_c").over(w)).join(n, by)
    ranks = upto.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(bins - 1))))
    at = F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.col("_i") / bins))
    hit = ranks.where((at < F.col("_upto")) & (at >= F.col("_upto") - F.col("_c")))
    return hit.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col(value).alias("_v")))), lambda x: x["_v"]).alias("boundaries"))


def stratified(df: DataFrame, targets: dict[str, float], seed: int, ident: str, source: str = "dataset_id", duration: str = "duration", length: str = "words") -> DataFrame:
    """A sample of each source of about its target seconds, spread over 5 duration by 4 length strata.

    Within a stratum rows are taken in hash order up to its share, without the crossing row if that is closer; then the
    source is filled from the rest, and its last row dropped if that is closer."""
    goal = reduce(lambda acc, kv: F.when(F.col(source) == kv[0], kv[1]).otherwise(acc), targets.items(), F.lit(None).cast("double"))
    rows = df.withColumn("_goal", goal).where("_goal IS NOT NULL")
    for value, bins, name in ((duration, 5, "_d"), (length, 4, "_l")):
        edges = floor_quantiles(rows, value, bins, [source]).withColumnRenamed("boundaries", f"{name}b")
        rows = rows.join(edges, source).withColumn(name, numeric.bin_index(F.col(value), F.col(f"{name}b"))).drop(f"{name}b")
    path = F.col(ident).cast("string")
    stratum = F.format_string("(%d, %d)", F.col("_d"), F.col("_l"))
    rows = rows.withColumns({"_key": stable_key(seed, F.col(source), stratum, path), "_fill": stable_key(seed, F.col(source), F.lit("fill"), path)})
    per = rows.groupBy(source, "_d", "_l").agg(F.sum(duration).alias("_s"))
    whole = rows.groupBy(source).agg(F.sum(duration).alias("_t"))
    rows = rows.join(per, [source, "_d", "_l"]).join(whole, source).withColumn("_share", F.col("_goal") * F.col("_s") / F.col("_t"))
    key = [source, "_d", "_l"]
    rows = running(rows, ["_key"], duration, "_b", key)
    taken = rows.withColumn("_in", F.col("_b") < F.col("_share"))
    after = F.col("_b") + F.col(duration)
    last = F.max(F.when(F.col("_in"), F.struct("_b", "_key"))).over(Window.partitionBy(*key))
    is_last = F.col("_in") & (F.struct("_b", "_key") == last)
    closer = F.abs(F.col("_b") - F.col("_share")) < F.abs(after - F.col("_share"))
    taken = cut(taken.withColumn("_in", F.col("_in") & ~(is_last & closer)))
    have = taken.groupBy(source).agg(F.coalesce(F.sum(F.when(F.col("_in"), F.col(duration))), F.lit(0.0)).alias("_have"))
    rest = running(taken.where("NOT _in").join(have, source), ["_fill"], duration, "_f", [source])
    fill = rest.where(F.col("_have") + F.col("_f") < F.col("_goal")).withColumn("_order", F.concat(F.lit("2"), F.col("_fill")))
    first = taken.where("_in").withColumn("_order", F.concat(F.lit("1"), F.col("_d").cast("string"), F.col("_l").cast("string"), F.col("_key")))
    keep = [*df.columns, "_goal", "_order"]
    both = first.select(*keep).unionByName(fill.select(*keep))
    sums = both.groupBy(source).agg(F.sum(duration).alias("_sum"), F.max(F.struct("_order", F.col(duration).alias("_last"))).alias("_m"))
    both = both.join(sums, source)
    drop = (F.col("_order") == F.col("_m._order")) & (F.abs(F.col("_sum") - F.col("_m._last") - F.col("_goal")) < F.abs(F.col("_sum") - F.col("_goal")))
    return both.where(~drop).select(*df.columns)


def speaker_split(df: DataFrame, seed: int, speaker: str = "speaker_id", official: str | None = "split", least_speakers: int = 20, ident: str = "audio_path", duration: str = "duration") -> DataFrame:
    """Adds new_split and strategy: the official split if all three parts are there, else by speakers if there are enough, else by duration strata, 90/5/5."""
    if official and official in df.columns:
        parts = {r[0] for r in df.select(official).where(F.col(official).isin("train", "val", "test")).distinct().collect()}
        if parts == {"train", "val", "test"}:
            return df.where(F.col(official).isin("train", "val", "test")).withColumns({"new_split": F.col(official), "strategy": F.lit("official_split")})
    name = lambda rank, n: F.when(rank < F.ceil(n * 0.9), "train").when(rank < F.ceil(n * 0.95), "val").otherwise("test")
    if speaker in df.columns and df.select(speaker).distinct().limit(least_speakers).count() >= least_speakers:
        people = df.select(speaker).where(F.col(speaker).isNotNull()).distinct()
        keyed = people.withColumns({"_k": stable_key(seed, F.col(speaker)), "_one": F.lit(1.0)})
        ranked = running(keyed, ["_k"], "_one", "_r").withColumn("new_split", name(F.col("_r"), F.lit(people.count())))
        return df.join(ranked.select(speaker, "new_split"), speaker).withColumn("strategy", F.lit("speaker_independent"))
    n = df.count()
    edges = df.agg(F.percentile(duration, F.array(*[F.lit(i / min(10, max(2, n // 100))) for i in range(1, min(10, max(2, n // 100)))])).alias("_e"))
    rows = df.crossJoin(F.broadcast(edges)).withColumn("_bin", F.size(F.filter("_e", lambda b: F.col(duration) > b))).drop("_e")
    w = Window.partitionBy("_bin").orderBy(stable_key(seed, F.col(ident).cast("string")))
    rows = rows.withColumns({"_r": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy("_bin"))})
    return rows.withColumns({"new_split": name(F.col("_r"), F.col("_n")), "strategy": F.lit("duration_stratified_random")}).drop("_r", "_n", "_bin")


def head_per_group(df: DataFrame, group: str, order: list[Column | str], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def weighted_draws(df: DataFrame, weight: str, ident: str, draws: int, seed: int) -> DataFrame:
    """`draws` rows with replacement, in proportion to the weight: (draw, ident). Draw i looks up u_i in the cumulative weights.

    Both sides are dealt by their rounded place on the cumulative line, so the range lookup is an equi-join."""
    total = df.agg(F.sum(weight)).first()[0] or 0.0
    if total <= 0 or draws <= 0:
        return df.limit(0).select(F.lit(0).cast("long").alias("draw"), ident)
    cells = max(1, draws)
    line = running(df.where(F.col(weight) > 0).withColumn("_k", stable_key(seed, F.col(ident).cast("string"))), ["_k", ident], weight, "_from")
    line = line.select(ident, F.col("_from"), (F.col("_from") + F.col(weight)).alias("_to"))
    cell = lambda x: F.least(F.floor(x / total * cells), F.lit(cells - 1)).cast("long")
    line = line.withColumn("_cell", F.explode(F.sequence(cell(F.col("_from")), cell(F.col("_to")))))
    u = F.conv(F.substring(F.sha2(F.concat_ws("\0", F.lit(str(seed)), F.lit("draw"), F.col("id").cast("string")), 256), 1, 13), 16, 10).cast("double") / float(16**13)
    picks = df.sparkSession.range(draws).select(F.col("id").alias("draw"), (u * total).alias("_u")).withColumn("_cell", cell(F.col("_u")))
    return picks.join(line, "_cell").where((F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_to"))).select("draw", ident)


def bucketed_order(df: DataFrame, seed: int, ident: str, length: str, size: int) -> DataFrame:
    """Adds bucket and place: buckets of `size` rows in hash order, each sorted long to short, buckets in hash order."""
    keyed = df.withColumns({"_k": stable_key(seed, F.col(ident).cast("string")), "_one": F.lit(1.0)})
    dealt = running(keyed, ["_k", ident], "_one", "_i").withColumn("bucket", F.floor(F.col("_i") / size).cast("long"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc(length), ident))
    return dealt.withColumns({"place": within, "bucket_key": stable_key(seed, F.lit("bucket"), F.col("bucket").cast("string"))}).drop("_k", "_one", "_i")


def by_modulo(df: DataFrame, order: str, shards: int) -> DataFrame:
    """Adds shard = (rank of the row, from 0) mod shards, for a dense integer order column."""
    return df.withColumn("shard", F.pmod(F.col(order), F.lit(shards)))


def mini_splits(df: DataFrame, hours: dict[str, float], seed: int, ident: str = "audio_path", duration: str = "duration", speaker: str = "speaker_id", split: str = "split") -> DataFrame:
    """For each split the rows that fill its hours, rarest speakers first; the splits' seeds follow each other."""
    parts = [hours_budget(df.where(F.col(split) == name), h, seed + i, ident, duration, speaker) for i, (name, h) in enumerate(hours.items())]
    return reduce(DataFrame.unionByName, parts)


def seeded_subsets(df: DataFrame, jobs: dict[str, dict[str, float]], shares: dict[str, float], seed: int, ident: str, **columns: str) -> DataFrame:
    """For each job (name to the hours of its splits) a stratified sample of every split, with columns job and split:
    sources by their shares of the hours, seeds 100 apart for jobs and 1 for splits."""
    out = []
    for j, (job, hours) in enumerate(jobs.items()):
        for i, (split, h) in enumerate(hours.items()):
            goals = {source: share * h * 3600 for source, share in shares.items()}
            part = stratified(df.where(F.col("split") == split), goals, seed + 100 * j + i, ident, **columns)
            out.append(part.withColumn("job", F.lit(job)))
    return reduce(DataFrame.unionByName, out)
