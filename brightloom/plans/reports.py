"""Queries on reports: parameter groups, run tables, comparisons, subsets, hashes and document checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import experiments, reports, sampling
from .base import CURVE, UTTERANCES, Tables, query, rounded
from .selection import BUDGET, TARGETS, key

U, C = f"WITH {UTTERANCES}", f"WITH {CURVE}"

PARAMETERS = """p AS (SELECT CASE WHEN l_linenumber = 1 THEN 'proj_out.weight' WHEN l_linenumber = 2 THEN 'model.encoder.conv1.weight'
  ELSE concat('model.encoder.layers.', l_orderkey % 32, '.fc', l_linenumber, '.weight') END AS name, l_orderkey % 32 AS layer, l_linenumber, l_partkey AS size, l_returnflag = 'R' AS trainable FROM lineitem)"""
GROUPED = """g AS (SELECT *, CASE WHEN l_linenumber = 1 THEN 'other' WHEN l_linenumber = 2 THEN 'encoder_other' WHEN layer < 8 THEN 'encoder_0_7' WHEN layer < 16 THEN 'encoder_8_15'
  WHEN layer < 24 THEN 'encoder_16_23' ELSE 'encoder_24_31' END AS "group" FROM p)"""


def parameters(t: Tables) -> DataFrame:
    """Line items as model parameters."""
    layer = F.concat(F.lit("model.encoder.layers."), F.col("l_orderkey") % 32, F.lit(".fc"), "l_linenumber", F.lit(".weight"))
    name = F.when(F.col("l_linenumber") == 1, "proj_out.weight").when(F.col("l_linenumber") == 2, "model.encoder.conv1.weight").otherwise(layer)
    return t.lineitem.select(name.alias("name"), F.col("l_partkey").alias("size"), (F.col("l_returnflag") == "R").alias("trainable"))


@query(f"""WITH {PARAMETERS}, {GROUPED} SELECT "group", sum(size) AS total_parameters, coalesce(sum(size) FILTER (WHERE trainable), 0) AS trainable_parameters,
 round(coalesce(sum(size) FILTER (WHERE trainable), 0) / sum(size) * 100.0, 6) AS trainable_percent FROM g GROUP BY ALL""")
def parameter_groups(t: Tables) -> DataFrame:
    rows = parameters(t).withColumn("group", reports.parameter_group(F.col("name"), blockwise=True))
    return reports.parameter_totals(rows, "size", "trainable", "group").withColumn("trainable_percent", rounded("trainable_percent"))


@query("""SELECT page_id, array_to_string(list_filter([CASE WHEN contains(h, 'track') THEN 'track' END, CASE WHEN contains(h, '<script') THEN '<script' END, CASE WHEN contains(h, 'no such sign') THEN 'no such sign' END], lambda x: x IS NOT NULL), '|') AS signs,
 CAST((length(h) - length(replace(h, '<p', ''))) / 2 AS BIGINT) AS warnings FROM (SELECT page_id, lower(coalesce(html, '')) AS h FROM pages)""")
def log_signs(t: Tables) -> DataFrame:
    out = reports.log_signs(t.pages, "html", ("track", "<script", "no such sign"), "<p")
    return out.select("page_id", F.array_join("stability_failures", "|").alias("signs"), F.col("safety_warning_count").alias("warnings"))


RUNS = """m AS (SELECT run, round(avg(wer), 9) AS wer, round(avg(cer), 9) AS cer, count(*) AS n, CASE WHEN run % 2 = 0 THEN max(loss) END AS d, max(loss) + 1 AS sd, sum(loss) * 60 AS s FROM c GROUP BY run)"""


def runs(t: Tables) -> DataFrame:
    """Curves as runs: some name their rates in columns, all in a schedule."""
    m = t.curve().groupBy("run").agg(rounded(F.avg("wer"), 9).alias("wer"), rounded(F.avg("cer"), 9).alias("cer"), F.count("*").alias("n"), F.max("loss").alias("_l"), (F.sum("loss") * 60).alias("runtime_seconds"))
    own = {c: F.lit(None).cast("double") for c in experiments.BLOCKS} | {"encoder_block_d_lr": F.when(F.col("run") % 2 == 0, F.col("_l")), "decoder_learning_rate": F.lit(None).cast("double")}
    m = m.withColumns(own | {"blockwise_schedule": reports.schedule({"encoder_24_31": F.col("_l") + 1, "decoder": F.col("_l") / 2}), "stable": F.col("n") > 2})
    return m.drop("_l")


@query(f"""{C}, {RUNS} SELECT run, row_number() OVER (ORDER BY wer, cer, NOT n > 2, run) AS rank, coalesce(d, sd) AS block_d, (sd - 1) / 2 AS decoder, 0.0 AS block_a, round(s / 3600, 6) AS runtime_hours FROM m""")
def run_report(t: Tables) -> DataFrame:
    out = experiments.ranked(reports.run_rows(runs(t)).withColumn("_u", ~F.col("stable")), "wer", "cer", "_u", "run")
    return out.select("run", "rank", F.col("encoder_block_d_lr").alias("block_d"), F.col("decoder_learning_rate").alias("decoder"), F.col("encoder_block_a_lr").alias("block_a"), rounded("runtime_hours").alias("runtime_hours"))


@query(f"""{C}, {RUNS}, b AS (SELECT * FROM m WHERE n >= 7 ORDER BY wer, cer, run LIMIT 1) SELECT run, coalesce(d, sd) AS block_d, 0.0 AS block_c FROM b""")
def best_schedule(t: Tables) -> DataFrame:
    rows = reports.run_rows(runs(t)).where("n >= 7")
    out = reports.best_schedule(rows, "run", "wer", "cer", "encoder_block_d_lr", "decoder_learning_rate")
    return out.select("run", F.col("blockwise_schedule.encoder_24_31").alias("block_d"), F.col("blockwise_schedule.encoder_16_23").alias("block_c"))


@query("""SELECT concat('order ', o_orderkey) AS name, o_orderpriority AS dataset, CASE WHEN c_custkey IS NULL THEN 'unavailable' ELSE CAST(coalesce(CASE WHEN c_nationkey = 3 THEN 7 END, c_nationkey) AS VARCHAR) END AS wer,
 CASE WHEN c_custkey IS NULL THEN 'unavailable' ELSE CAST(c_custkey AS VARCHAR) END AS cer, CASE WHEN c_custkey IS NULL THEN 'unavailable' ELSE 'see source metrics' END AS notes
 FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON o_custkey = c_custkey""")
def reference_comparison(t: Tables) -> DataFrame:
    """References of which some have no metrics, and some a test result beside the validation's."""
    references = t.orders.select(F.concat(F.lit("order "), "o_orderkey").alias("name"), F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("dataset"))
    test = F.when(F.col("c_nationkey") == 3, 7)
    metrics = t.customer.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("run"), F.col("c_nationkey").alias("wer"), F.col("c_custkey").alias("cer"), test.alias("test_wer"), F.lit(None).cast("long").alias("test_cer"))
    return reports.comparison(references, metrics, "run")


SHARES = {"src0": 0.5, "src1": 0.4, "src9": 0.1}


@query(f"""{U}, s AS (SELECT * FROM (VALUES ('src0', 0.5), ('src1', 0.4), ('src9', 0.1)) v(dataset_id, target_share))
SELECT s.dataset_id, round(coalesce(sum(duration), 0) / 3600, 6) AS hours, round(coalesce(sum(duration), 0) / (SELECT sum(duration) FROM u), 6) AS share, count(duration) AS samples, CAST(target_share AS DOUBLE) AS target_share
FROM s LEFT JOIN u USING (dataset_id) GROUP BY s.dataset_id, target_share""")
def subset_report(t: Tables) -> DataFrame:
    return reports.subset_report(t.utterances(), SHARES).withColumns({"hours": rounded("hours"), "share": rounded("share")})


def _budget(split: str, seconds: float, seed: int) -> str:
    cte = BUDGET.removeprefix(f"{U}, ").replace("FROM u)", f"FROM u WHERE split = '{split}')").replace(key(42, "audio_path"), key(seed, "audio_path"))
    return f"SELECT doc_id, split FROM (WITH {cte} SELECT * FROM b WHERE round(before, 6) < {seconds})"


@query(f"{U} {_budget('train', 1800.0, 42)} UNION ALL {_budget('val', 300.0, 43)} UNION ALL {_budget('test', 300.0, 44)}")
def mini_splits(t: Tables) -> DataFrame:
    return sampling.mini_splits(t.utterances(), {"train": 0.5, "val": 1 / 12, "test": 1 / 12}, 42).select("doc_id", "split")


@query()
def seeded_subsets(t: Tables) -> DataFrame:
    """Two jobs of three seeded stratified samples; each is `stratified_subset`'s query over one split, which tests compare."""
    rows = t.utterances().withColumn("words", text.word_count(F.col("text")))
    jobs = {"coarse": {"train": 0.1, "val": 0.02, "test": 0.02}, "main": {"train": 0.2, "val": 0.02, "test": 0.02}}
    shares = {k: v / sum(TARGETS.values()) for k, v in TARGETS.items()}
    return sampling.seeded_subsets(rows, jobs, shares, 1729, "audio_path").select("job", "split", "doc_id")


@query(f"{U} SELECT dataset_id, split, count(*) AS rows, count(*) FILTER (WHERE duration <= 30) AS accepted, count(*) FILTER (WHERE duration > 30) AS rejected FROM u WHERE dataset_id IN ('src0', 'src2') GROUP BY ALL")
def export_summary(t: Tables) -> DataFrame:
    reason = F.when(F.col("duration") > 30, "duration_too_long")
    return reports.export_summary(t.utterances().withColumn("reason", reason), ["src0", "src2"])


@query("""WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 5 > 0), e AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE sha256(text) END AS h FROM documents)
SELECT doc_id, e.h AS expected, a.h AS actual FROM e LEFT JOIN a USING (doc_id) WHERE e.h IS DISTINCT FROM a.h""")
def hash_guard(t: Tables) -> DataFrame:
    """Pinned hashes against the texts: some have changed, some have gone."""
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))
    pinned = d.withColumn("sha256", F.when(F.col("doc_id") % 7 == 0, "changed").otherwise(F.col("sha256")))
    return reports.hash_violations(d.where("doc_id % 5 > 0"), pinned, "doc_id")


@query("""WITH f AS (SELECT concat('doc', doc_id) AS name, length(text) AS length, text FROM documents), r(name) AS (VALUES ('doc1'), ('doc2'), ('doc3'), ('no such file'))
SELECT 'missing' AS problem, name AS subject FROM r WHERE name NOT IN (SELECT name FROM f) UNION ALL SELECT 'too_short', name FROM f WHERE name IN (SELECT name FROM r) AND length < 800
UNION ALL SELECT 'protected_missing', 'gone' UNION ALL SELECT 'not_in_index', name FROM r WHERE name <> 'doc1' AND NOT contains((SELECT text FROM f WHERE name = 'doc1'), name)
UNION ALL SELECT 'phrase_missing', p FROM (VALUES ('the'), ('no such phrase')) v(p) WHERE p NOT IN (SELECT 'the' FROM f WHERE contains(text, 'the'))""")
def document_checks(t: Tables) -> DataFrame:
    files = t.documents.select(F.concat(F.lit("doc"), "doc_id").alias("name"), F.length("text").alias("length"), "text")
    return reports.document_problems(files, ["doc1", "doc2", "doc3", "no such file"], index="doc1", phrases=["the", "no such phrase"], protected=["gone"])
