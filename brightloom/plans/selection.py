"""Queries on splits, budgets, strata, weights and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import longform, sampling, scoring
from ..sources import readers
from .base import UTTERANCES, Tables, query, rounded

U = f"WITH {UTTERANCES}"


def key(seed: int, *parts: str) -> str:
    return f"left(sha256(concat('{seed}', " + ", ".join(f"chr(0), {p}" for p in parts) + ")), 16)"


@query(f"{U} SELECT doc_id, {key(42, 'audio_path')} AS stable_key, row_number() OVER (ORDER BY {key(42, 'audio_path')}) - 1 AS place FROM u")
def stable_hash_order(t: Tables) -> DataFrame:
    keyed = t.utterances().withColumns({"stable_key": sampling.stable_key(42, "audio_path"), "_one": F.lit(1.0)})
    return sampling.running(keyed, ["stable_key"], "_one", "place").select("doc_id", "stable_key", F.col("place").cast("long").alias("place"))


BUDGET = f"""{U}, r AS (SELECT *, count(*) OVER (PARTITION BY speaker_id) AS n FROM u), b AS (SELECT *, coalesce(sum(duration) OVER (ORDER BY n, duration, {key(42, 'audio_path')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)"""


@query(f"{BUDGET} SELECT doc_id, duration FROM b WHERE round(before, 6) < 3600.0")
def hours_budget(t: Tables) -> DataFrame:
    return sampling.hours_budget(t.utterances(), 1.0, 42, "audio_path").select("doc_id", "duration")


BINS = """nb AS (SELECT dataset_id, list_sort(list(duration)) AS ds, list_sort(list(CAST(words AS BIGINT))) AS ws, count(*) AS n FROM uw GROUP BY ALL),
 e AS (SELECT dataset_id, list_transform(range(1, 5), lambda i: ds[least(n - 1, n * i // 5) + 1]) AS db, list_transform(range(1, 4), lambda i: ws[least(n - 1, n * i // 4) + 1]) AS wb FROM nb),
 s AS (SELECT uw.*, len(list_filter(db, lambda x: duration > x)) AS d, len(list_filter(wb, lambda x: words > x)) AS l FROM uw JOIN e USING (dataset_id))"""
WORDS = f"{U}, uw AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words FROM u)"


@query(f"{WORDS}, {BINS} SELECT doc_id, d AS duration_bin, l AS length_bin FROM s")
def quantile_bins(t: Tables) -> DataFrame:
    rows = t.utterances().withColumn("words", text.word_count(F.col("text")))
    for value, bins, name in (("duration", 5, "duration_bin"), ("words", 4, "length_bin")):
        edges = sampling.floor_quantiles(rows, value, bins, ["dataset_id"])
        rows = rows.join(edges, "dataset_id").withColumn(name, numeric.bin_index(F.col(value), F.col("boundaries")).cast("long")).drop("boundaries")
    return rows.select("doc_id", "duration_bin", "length_bin")


TARGETS = {"src0": 500.0, "src1": 400.0, "src2": 100.0}
STRATA = f"""{WORDS}, {BINS}, g AS (SELECT *, CASE dataset_id WHEN 'src0' THEN 500.0 WHEN 'src1' THEN 400.0 WHEN 'src2' THEN 100.0 END AS goal,
  {key(7, "dataset_id", "concat('(', d, ', ', l, ')')", "audio_path")} AS k, {key(7, "dataset_id", "'fill'", "audio_path")} AS fk FROM s WHERE dataset_id IN ('src0', 'src1', 'src2')),
 h AS (SELECT *, goal * sum(duration) OVER (PARTITION BY dataset_id, d, l) / sum(duration) OVER (PARTITION BY dataset_id) AS share,
  coalesce(sum(duration) OVER (PARTITION BY dataset_id, d, l ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g),
 i AS (SELECT *, b < share AS taken, row_number() OVER (PARTITION BY dataset_id, d, l, b < share ORDER BY k DESC) = 1 AS final FROM h),
 j AS (SELECT *, taken AND NOT (final AND abs(b - share) < abs(b + duration - share)) AS inside FROM i),
 m AS (SELECT *, coalesce(sum(duration) FILTER (WHERE inside) OVER (PARTITION BY dataset_id), 0) AS have FROM j),
 f AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY dataset_id ORDER BY fk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fb FROM m WHERE NOT inside),
 a AS (SELECT doc_id, dataset_id, duration, goal, concat('1', d, l, k) AS o FROM m WHERE inside UNION ALL SELECT doc_id, dataset_id, duration, goal, concat('2', fk) FROM f WHERE have + fb < goal),
 z AS (SELECT *, sum(duration) OVER (PARTITION BY dataset_id) AS total, row_number() OVER (PARTITION BY dataset_id ORDER BY o DESC) = 1 AS final FROM a)"""


@query(f"{STRATA} SELECT doc_id, dataset_id, duration FROM z WHERE NOT (final AND abs(total - duration - goal) < abs(total - goal))")
def stratified_subset(t: Tables) -> DataFrame:
    rows = t.utterances().withColumn("words", text.word_count(F.col("text")))
    return sampling.stratified(rows, TARGETS, 7, "audio_path").select("doc_id", "dataset_id", "duration")


@query(f"""{STRATA}, q AS (SELECT * FROM z WHERE NOT (final AND abs(total - duration - goal) < abs(total - goal)))
SELECT dataset_id, count(*) AS samples, round(sum(duration) / 3600, 6) AS hours, round(avg(duration), 6) AS average, min(duration) AS least, max(duration) AS most FROM q GROUP BY ALL""")
def subset_summary(t: Tables) -> DataFrame:
    return stratified_subset(t).groupBy("dataset_id").agg(
        F.count("*").alias("samples"), rounded(F.sum("duration") / 3600).alias("hours"), rounded(F.avg("duration")).alias("average"), F.min("duration").alias("least"), F.max("duration").alias("most")
    )


SPEAKERS = f"""{U}, k AS (SELECT speaker_id, row_number() OVER (ORDER BY {key(42, 'speaker_id')}) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT speaker_id FROM u)),
 p AS (SELECT speaker_id, CASE WHEN r < ceil(n * 0.9) THEN 'train' WHEN r < ceil(n * 0.95) THEN 'val' ELSE 'test' END AS new_split FROM k)"""


@query(f"{SPEAKERS} SELECT doc_id, new_split, 'speaker_independent' AS strategy FROM u JOIN p USING (speaker_id)")
def speaker_split(t: Tables) -> DataFrame:
    return sampling.speaker_split(t.utterances(), 42, official=None).select("doc_id", "new_split", "strategy")


@query(f"{U} SELECT doc_id, split AS new_split, 'official_split' AS strategy FROM u")
def official_split(t: Tables) -> DataFrame:
    return sampling.speaker_split(t.utterances(), 42).select("doc_id", "new_split", "strategy")


@query(f"""{U} SELECT doc_id, round(CASE tier WHEN 'gold' THEN 4.0 WHEN 'silver' THEN 1.5 ELSE 1.0 END * CASE dataset_id WHEN 'src1' THEN 0.5 WHEN 'src2' THEN 2.0 ELSE 1.0 END * greatest(0.1, least(1.25, duration * 5 / 100)), 6) AS sampling_weight FROM u""")
def sampling_weight(t: Tables) -> DataFrame:
    w = scoring.sampling_weight(F.col("tier"), F.col("duration") * 5, F.col("dataset_id"), {"src1": 0.5, "src2": 2.0})
    return t.utterances().select("doc_id", rounded(w).alias("sampling_weight"))


@query()
def weighted_sample(t: Tables) -> DataFrame:
    """As many draws as rows, with replacement, by tier weight; a draw is a random point on the cumulative weights."""
    u = t.utterances().withColumn("w", scoring.trust_weight(F.col("tier")))
    return sampling.weighted_draws(u, "w", "doc_id", u.count(), 11)


@query(f"""{U}, k AS (SELECT doc_id, duration, audio_path, (row_number() OVER (ORDER BY {key(5, 'audio_path')}) - 1) // 64 AS bucket FROM u)
SELECT doc_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY duration DESC, audio_path) AS place, {key(5, "'bucket'", "CAST(bucket AS VARCHAR)")} AS bucket_key FROM k""")
def duration_bucket_order(t: Tables) -> DataFrame:
    return sampling.bucketed_order(t.utterances(), 5, "audio_path", "duration", 64).select("doc_id", "bucket", F.col("place").cast("long").alias("place"), "bucket_key")


@query(f"{U} SELECT doc_id, speaker_id FROM (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY duration DESC, doc_id) AS r FROM u) WHERE r <= 3")
def head_n_per_group(t: Tables) -> DataFrame:
    return sampling.head_per_group(t.utterances(), "speaker_id", [F.desc("duration"), "doc_id"], 3).select("doc_id", "speaker_id")


@query(f"{U} SELECT doc_id, duration FROM u ORDER BY duration DESC, doc_id LIMIT 500")
def top_longest(t: Tables) -> DataFrame:
    """A top-k report: the 500 longest."""
    return t.utterances().orderBy(F.desc("duration"), "doc_id").limit(500).select("doc_id", "duration")


@query(f"{U} SELECT doc_id, duration FROM u ORDER BY {key(3, 'audio_path')} LIMIT 200")
def random_sample(t: Tables) -> DataFrame:
    """A sample of 200 without replacement, in hash order."""
    return t.utterances().orderBy(sampling.stable_key(3, "audio_path")).limit(200).select("doc_id", "duration")


@query(f"{U} SELECT doc_id, doc_id % 4 AS shard FROM u")
def modulo_shards(t: Tables) -> DataFrame:
    return sampling.by_modulo(t.utterances(), "doc_id", 4).select("doc_id", "shard")


@query(f"{U}, f AS (SELECT * FROM u WHERE duration BETWEEN 100 AND 200) SELECT doc_id FROM f UNION ALL SELECT doc_id FROM u WHERE NOT EXISTS (SELECT 1 FROM f)")
def range_or_all(t: Tables) -> DataFrame:
    """Rows of a duration range, or all rows if there are none."""
    u = t.utterances()
    inside = u.where(F.col("duration").between(100, 200))
    return (u if inside.isEmpty() else inside).select("doc_id")


@query("SELECT page_id, CASE split_part(path, '/', 1) WHEN 'en' THEN 'train' WHEN 'training' THEN 'train' ELSE NULL END AS split FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]+/', '') AS path FROM pages) WHERE false UNION ALL SELECT page_id, NULL FROM pages")
def split_of_path(t: Tables) -> DataFrame:
    """Urls name no split, so every page has none; tests cover paths that do."""
    return t.pages.select("page_id", readers.split_of_path(F.col("url")).alias("split"))


@query("SELECT c_custkey, CASE WHEN contains(c_name, '_data_') THEN split_part(c_name, '_data_', 1) ELSE split_part(c_name, '_', 1) END AS speaker FROM customer")
def speaker_of_stem(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", readers.speaker_of_stem(F.col("c_name")).alias("speaker"))


@query(f"""{U} SELECT audio_path, text, duration, speaker_id, split, to_json({{'dataset_id': dataset_id, 'tier': tier}}) AS source_metadata, dataset_id, tier, CASE tier WHEN 'gold' THEN 4.0 WHEN 'silver' THEN 1.5 ELSE 1.0 END AS trust_weight FROM u""")
def json_metadata(t: Tables) -> DataFrame:
    """The canonical projection, with metadata as JSON."""
    u = t.utterances()
    return u.select("audio_path", "text", "duration", "speaker_id", "split", F.to_json(F.struct("dataset_id", "tier")).alias("source_metadata"), "dataset_id", "tier", scoring.trust_weight(F.col("tier")).alias("trust_weight"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_fields(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query(f"""{U}, g AS (SELECT audio_path, text, duration, speaker_id, split, dataset_id, tier, 4.0 AS trust_weight, 0 AS origin FROM u WHERE tier = 'gold'),
 s AS (SELECT audio_path, text, duration, speaker_id, 'train' AS split, dataset_id, tier, 1.5 AS trust_weight, 1 AS origin FROM u WHERE tier = 'silver' AND sha1(text) NOT IN (SELECT sha1(text) FROM u WHERE tier = 'gold'))
SELECT audio_path, text, duration, speaker_id, split, dataset_id, tier, CAST(trust_weight AS DOUBLE) AS trust_weight, origin FROM g UNION ALL SELECT audio_path, text, duration, speaker_id, split, dataset_id, tier, CAST(trust_weight AS DOUBLE), origin FROM s""")
def combined_manifest(t: Tables) -> DataFrame:
    """The trusted rows first, then the train-only candidate rows that do not repeat one of their texts."""
    u = t.utterances().withColumn("trust_weight", scoring.trust_weight(F.col("tier")))
    columns = ["audio_path", "text", "duration", "speaker_id", "split", "dataset_id", "tier", "trust_weight"]
    gold = u.where("tier = 'gold'")
    silver = u.where("tier = 'silver'").withColumn("_k", F.sha1("text")).join(gold.select(F.sha1("text").alias("_k")).distinct(), "_k", "left_anti").withColumn("split", F.lit("train"))
    return gold.select(*columns, F.lit(0).alias("origin")).unionByName(silver.select(*columns, F.lit(1).alias("origin")))


@query(f"{U} SELECT audio_path, split, dataset_id, duration FROM u ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, dataset_id, audio_path")
def corpus_order(t: Tables) -> DataFrame:
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    return t.utterances().orderBy(rank, "dataset_id", "audio_path").select("audio_path", "split", "dataset_id", "duration")


@query(f"{U} SELECT dataset_id, min(doc_id) AS first_doc FROM u GROUP BY ALL")
def distinct_in_order(t: Tables) -> DataFrame:
    return t.utterances().groupBy("dataset_id").agg(F.min("doc_id").alias("first_doc"))


@query(f"{U} SELECT dataset_id AS missing FROM (SELECT DISTINCT dataset_id FROM u) EXCEPT SELECT dataset_id FROM u WHERE tier = 'silver'")
def set_except(t: Tables) -> DataFrame:
    u = t.utterances()
    return u.select("dataset_id").distinct().subtract(u.where("tier = 'silver'").select("dataset_id")).withColumnRenamed("dataset_id", "missing")


@query(f"{U} SELECT dataset_id, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test FROM u GROUP BY ALL")
def split_pivot(t: Tables) -> DataFrame:
    return t.utterances().groupBy("dataset_id").pivot("split", ["train", "val", "test"]).agg(F.count(F.lit(1))).na.fill(0)



GROUPS = [("short", [5.0], 0.05), ("medium", [30.0], 0.1), ("long", [300.0, 600.0, 900.0, 1200.0], 0.5)]


@query()
def longform_composition(t: Tables) -> DataFrame:
    """Recordings of each group put together from clips of one speaker after the other; a cursor's walk, which SQL cannot express."""
    out = longform.summary(longform.compose(t.utterances(), ["speaker_id", "duration", "audio_path"], GROUPS, "audio_path"))
    return out.select("group", "recordings", rounded("seconds").alias("seconds"), rounded("mean").alias("mean"))


@query(f"""{U}, w AS (SELECT * FROM u WHERE duration BETWEEN 2 AND 12), h AS (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY duration, {key(1, 'audio_path')}) AS r FROM w),
 k AS (SELECT * FROM h WHERE r <= (SELECT greatest(1, ceil(count(*) / greatest(1, count(DISTINCT speaker_id)))) FROM w)),
 b AS (SELECT *, coalesce(sum(duration) OVER (ORDER BY {key(12, 'audio_path')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k) SELECT doc_id, duration FROM b WHERE round(before, 6) < 720""")
def benchmark_groups(t: Tables) -> DataFrame:
    return longform.benchmark_group(t.utterances(), 0.2, 1, 2.0, 12.0).select("doc_id", "duration")
