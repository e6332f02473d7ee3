"""Queries on scoring, cleaning, statistics and audits of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, signal, text
from ..operators import audit, cleaning, scoring
from . import sqltext as S
from .base import UTTERANCES, WAVES, Tables, query, rounded

U = f"WITH {UTTERANCES}"
SCORED = f"{U}, {S.SCORED}"


@query(f"{SCORED} SELECT doc_id, score AS quality_score, decision, array_to_string(reasons, '|') AS reasons, round(CASE WHEN duration > 0 THEN length(s) / duration END, 6) AS chars_per_second, length(s) AS transcript_chars FROM scored")
def quality_score(t: Tables) -> DataFrame:
    out = scoring.score_samples(t.utterances())
    return out.select("doc_id", F.col("score").alias("quality_score"), "decision", F.array_join("reasons", "|").alias("reasons"), rounded("chars_per_second").alias("chars_per_second"), "transcript_chars")


@query(f"{SCORED} SELECT dataset_id, decision, reason, count(*) AS rows FROM (SELECT dataset_id, decision, unnest(CASE WHEN len(reasons) > 0 THEN reasons ELSE ['none'] END) AS reason FROM scored) GROUP BY ALL")
def reason_histogram(t: Tables) -> DataFrame:
    """Flagship: decisions and their reasons by dataset."""
    out = scoring.score_samples(t.utterances())
    reasons = F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("none")))
    return out.select("dataset_id", "decision", F.explode(reasons).alias("reason")).groupBy("dataset_id", "decision", "reason").agg(F.count("*").alias("rows"))


@query(f"{SCORED} SELECT dataset_id, decision, count(*) AS rows, round(sum(duration) / 3600, 6) AS hours FROM scored GROUP BY ALL")
def decision_hours(t: Tables) -> DataFrame:
    out = scoring.score_samples(t.utterances())
    return out.groupBy("dataset_id", "decision").agg(F.count("*").alias("rows"), rounded(F.sum("duration") / 3600).alias("hours"))


CLEAN = f"""{U}, n AS (SELECT *, trim(audio_path) AS p, {S.legacy("text")} AS c FROM u),
 r AS (SELECT *, CASE WHEN length(c) = 0 THEN 'empty_transcript' WHEN length(c) < 2 THEN 'transcript_too_short' WHEN length(c) > 500 THEN 'transcript_too_long' WHEN p = '' THEN 'missing_audio'
  WHEN duration <= 0 THEN 'corrupted_audio' WHEN duration < 1 THEN 'duration_too_short' WHEN duration > 30 THEN 'duration_too_long' END AS reason FROM n),
 f AS (SELECT *, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY p, c, reason IS NULL ORDER BY doc_id) > 1 THEN 'duplicate_sample' END) AS why FROM r)"""


@query(f"{CLEAN} SELECT coalesce(why, 'kept') AS reason, count(*) AS rows, round(sum(duration) / 3600, 6) AS hours FROM f GROUP BY ALL")
def cleaning_cascade(t: Tables) -> DataFrame:
    out = cleaning.report(cleaning.cascade(t.utterances(), "doc_id"))
    return out.select(F.coalesce("reason", F.lit("kept")).alias("reason"), "rows", rounded("hours").alias("hours"))


# The same cascade with paths shared by documents of one source, so that repeats occur.
@query(CLEAN.replace("trim(audio_path) AS p", "dataset_id AS p") + " SELECT doc_id, coalesce(why, 'kept') AS reason FROM f")
def cleaning_rows(t: Tables) -> DataFrame:
    out = cleaning.cascade(t.utterances().withColumn("audio_path", F.col("dataset_id")), "doc_id")
    return out.select("doc_id", F.coalesce("reason", F.lit("kept")).alias("reason"))


FILTER = f"""{SCORED}, d AS (SELECT *, row_number() OVER (PARTITION BY audio_path ORDER BY doc_id) > 1 AS dp, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) > 1 AS dt FROM scored),
 m AS (SELECT doc_id, dataset_id, duration, least(CASE WHEN dp THEN least(score, 50) ELSE score END, CASE WHEN dt THEN 75.0 ELSE 100.0 END) AS quality_score,
  CASE WHEN dp THEN 'reject' WHEN dt AND decision = 'keep' THEN 'suspicious' ELSE decision END AS quality_decision,
  {S.joined("list_concat(reasons, list_filter([CASE WHEN dp THEN 'duplicate_audio_path' END, CASE WHEN dt THEN 'duplicate_transcript' END], lambda r: r IS NOT NULL))")} AS quality_reasons FROM d)"""


@query(f"{FILTER} SELECT doc_id, quality_score, quality_decision, quality_reasons FROM m")
def filter_manifest(t: Tables) -> DataFrame:
    return scoring.filter_manifest(t.utterances(), "doc_id").select("doc_id", "quality_score", "quality_decision", "quality_reasons")


@query(f"{FILTER} SELECT quality_decision, count(*) AS rows FROM m GROUP BY ALL")
def decision_counts(t: Tables) -> DataFrame:
    return scoring.filter_manifest(t.utterances(), "doc_id").groupBy("quality_decision").agg(F.count("*").alias("rows"))


@query(f"{FILTER} SELECT doc_id, quality_reasons FROM m WHERE quality_decision <> 'keep'")
def rejected_rows(t: Tables) -> DataFrame:
    return scoring.filter_manifest(t.utterances(), "doc_id").where("quality_decision <> 'keep'").select("doc_id", "quality_reasons")


@query(f"{FILTER} SELECT reason, count(*) AS rows FROM (SELECT unnest(string_split(CASE WHEN quality_reasons = '' THEN 'unspecified' ELSE quality_reasons END, '|')) AS reason FROM m) GROUP BY ALL")
def rejection_counts(t: Tables) -> DataFrame:
    return scoring.reason_histogram(scoring.filter_manifest(t.utterances(), "doc_id"), "quality_reasons")


@query(f"{FILTER} SELECT reason, rows FROM (SELECT reason, count(*) AS rows FROM (SELECT unnest(string_split(quality_reasons, '|')) AS reason FROM m) GROUP BY ALL) WHERE regexp_matches(reason, 'duplicate|overlap')")
def duplicate_reasons(t: Tables) -> DataFrame:
    return scoring.reason_histogram(scoring.filter_manifest(t.utterances(), "doc_id"), "quality_reasons").where(F.col("reason").rlike("duplicate|overlap"))


@query(f"{FILTER} SELECT CASE WHEN quality_score >= 95 THEN '95-100' WHEN quality_score >= 90 THEN '90-94' WHEN quality_score >= 85 THEN '85-89' ELSE '80-84' END AS band, count(*) AS rows FROM m GROUP BY ALL")
def quality_bands(t: Tables) -> DataFrame:
    out = scoring.filter_manifest(t.utterances(), "doc_id")
    return out.groupBy(scoring.quality_band(F.col("quality_score")).alias("band")).agg(F.count("*").alias("rows"))


def _frame_db(f: str) -> str:
    return f"20 * log10(sqrt(list_sum(list_transform({f}, lambda v: CAST(v AS DOUBLE) * v)) / len({f}) + 1e-12) + 1e-12)"


WAVE_STATS = f"""{WAVES}, ws AS (SELECT vec_id, {_frame_db("wave")} AS db, list_max(list_transform(wave, lambda v: abs(v))) AS peak,
 len(list_filter(range(0, 4), lambda i: {_frame_db("wave[i * 16 + 1 : i * 16 + 16]")} < -40)) / 4.0 AS silence FROM w)"""


@query(f"WITH {WAVE_STATS} SELECT vec_id, round(db, 5) AS rms_db, round(CAST(peak AS DOUBLE), 7) AS peak, round(greatest(0, least(60, db + 40)), 5) AS snr_proxy_db FROM ws")
def wave_rms_peak(t: Tables) -> DataFrame:
    w = t.waves()
    db = signal.rms_db(F.col("wave"))
    return w.select("vec_id", rounded(db, 5).alias("rms_db"), rounded(signal.peak(F.col("wave")).cast("double"), 7).alias("peak"), rounded(signal.snr_proxy(db), 5).alias("snr_proxy_db"))


@query(f"WITH {WAVE_STATS} SELECT vec_id, CAST(silence AS DOUBLE) AS silence_pct FROM ws")
def wave_silence(t: Tables) -> DataFrame:
    return t.waves().select("vec_id", signal.silence_share(F.col("wave"), 16).alias("silence_pct"))


def _with_signal(t: Tables) -> DataFrame:
    w = t.waves().select(F.col("vec_id").alias("doc_id"), signal.silence_share(F.col("wave"), 16).alias("silence_pct"), signal.snr_proxy(signal.rms_db(F.col("wave"))).alias("snr_proxy_db"))
    return t.utterances().join(w, "doc_id", "left")


CORPUS_RULES = [("high_silence", "silence > 0.65", 15), ("low_snr_proxy", "greatest(0, least(60, db + 40)) < 10", 15), ("audio_read_error", "silence IS NULL", 25)]


@query(f"""{SCORED}, {WAVE_STATS}, q AS (SELECT doc_id, tier, {S.score(CORPUS_RULES, "score")} AS quality_score, {S.joined(f"list_concat(reasons, {S.reasons(CORPUS_RULES)})")} AS quality_reasons FROM scored LEFT JOIN ws ON doc_id = vec_id)
SELECT doc_id, quality_score, quality_reasons, CASE WHEN quality_score < 55 THEN 'reject' WHEN quality_score < 75 THEN 'bronze' WHEN tier = 'gold' AND quality_score >= 85 THEN 'gold' ELSE 'silver' END AS quality_class,
 CASE WHEN quality_score < 55 THEN 'reject' ELSE 'keep' END AS quality_decision FROM q""")
def corpus_quality_class(t: Tables) -> DataFrame:
    return scoring.corpus_quality(_with_signal(t), "silence_pct", "snr_proxy_db", "tier").select("doc_id", "quality_score", "quality_reasons", "quality_class", "quality_decision")


@query(f"""WITH {WAVES} SELECT vec_id, sha1(CAST('16000' AS BLOB) || unhex(array_to_string(list_transform(list_transform(wave, lambda v: (CAST(trunc(CAST(greatest(-1::FLOAT, least(1::FLOAT, v)) * 32767::FLOAT AS FLOAT)) AS INTEGER) + 65536) % 65536), lambda x: printf('%02x%02x', x % 256, x // 256)), ''))) AS audio_sha1 FROM w""")
def pcm_hash(t: Tables) -> DataFrame:
    return t.waves().select("vec_id", signal.pcm_sha1(F.col("wave"), 16000).alias("audio_sha1"))


@query(f"WITH {WAVES} SELECT vec_id, len(list_filter(range(0, 4), lambda i: len(wave[i * 20 + 1 : i * 20 + 20]) >= 5)) AS pieces, CAST(list_sum(list_transform(range(0, 4), lambda i: CASE WHEN len(wave[i * 20 + 1 : i * 20 + 20]) >= 5 THEN len(wave[i * 20 + 1 : i * 20 + 20]) ELSE 0 END)) AS BIGINT) AS samples FROM w")
def wave_chunks(t: Tables) -> DataFrame:
    pieces = signal.chunks(F.col("wave"), 20, 5)
    return t.waves().select("vec_id", F.size(pieces).cast("long").alias("pieces"), F.aggregate(pieces, F.lit(0).cast("long"), lambda acc, p: acc + F.size(p)).alias("samples"))


@query(f"""{U} SELECT doc_id, CAST(i AS INTEGER) AS clip, CAST(i * 30 AS DOUBLE) AS "start", least((i + 1) * 30.0, length(text) / 20.0) AS "end" FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil(length(text) / 20.0 / 30), 1) AS BIGINT))) AS i FROM u)""")
def clip_windows(t: Tables) -> DataFrame:
    seconds = F.length("text") / 20.0
    out = t.utterances().select("doc_id", F.posexplode(signal.windows(seconds, 30.0)).alias("clip", "w"))
    return out.select("doc_id", "clip", F.col("w.start").alias("start"), F.col("w.end").alias("end"))


@query(f"{U} SELECT doc_id, CAST(round_even(duration / 0.1, 0) AS INTEGER) AS bucket_100ms, CAST(round_even(duration / 0.4, 0) AS INTEGER) AS bucket_400ms FROM u")
def duration_bucket(t: Tables) -> DataFrame:
    d = F.col("duration")
    return t.utterances().select("doc_id", numeric.bucket(d).alias("bucket_100ms"), numeric.bucket(d, 0.4).alias("bucket_400ms"))


@query(f"{U} SELECT dataset_id, count(*) AS rows, round(sum(duration) / 3600, 6) AS hours, count(DISTINCT nullif(speaker_id, '')) AS speakers, round(avg(length(text)), 6) AS mean_chars FROM u GROUP BY ALL")
def dataset_stats(t: Tables) -> DataFrame:
    u = t.utterances()
    mean = u.groupBy("dataset_id").agg(rounded(F.avg(F.length("text"))).alias("mean_chars"))
    return audit.stats(u, "dataset_id").withColumn("hours", rounded("hours")).join(mean, "dataset_id")


@query(f"{U}, k AS (SELECT dataset_id, tier, count(*) AS n FROM u GROUP BY ALL) SELECT dataset_id, string_agg(concat(tier, '=', n), ',' ORDER BY tier) AS classes FROM k GROUP BY ALL")
def class_histogram(t: Tables) -> DataFrame:
    out = audit.class_histogram(t.utterances(), "dataset_id", "tier")
    return out.select("dataset_id", F.array_join(F.transform(F.map_entries("classes"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("classes"))


@query(f"{U} SELECT split, dataset_id, count(*) AS rows, round(sum(duration) / 3600, 6) AS hours FROM u GROUP BY ROLLUP (split, dataset_id)")
def split_rollup(t: Tables) -> DataFrame:
    return audit.split_summary(t.utterances()).withColumn("hours", rounded("hours"))


@query(f"""{U}, k AS (SELECT 'path' AS "check", audio_path AS key, split FROM u UNION ALL SELECT 'text', sha1(text), split FROM u UNION ALL SELECT 'speaker', concat(dataset_id, ':', speaker_id), split FROM u),
 v AS (SELECT "check", key FROM k GROUP BY ALL HAVING count(DISTINCT split) > 1), n AS (SELECT c AS "check", (SELECT count(*) FROM v WHERE v."check" = c) AS violations FROM (VALUES ('path'), ('text'), ('speaker')) AS x(c))
SELECT "check", violations, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM n""")
def leakage_audit(t: Tables) -> DataFrame:
    u = t.utterances().withColumns({"_text": F.sha1("text"), "_who": F.concat_ws(":", "dataset_id", "speaker_id")})
    return audit.leaks(u, {"path": ["audio_path"], "text": ["_text"], "speaker": ["_who"]})


@query(f"{U} SELECT key FROM (SELECT DISTINCT sha1({S.collapsed('lower(text)')}) AS key FROM u WHERE split = 'train' INTERSECT SELECT DISTINCT sha1({S.collapsed('lower(text)')}) FROM u WHERE split = 'test')")
def split_intersect(t: Tables) -> DataFrame:
    return audit.shared(t.utterances(), F.sha1(text.audit_form(F.col("text"))), "train", "test")


TARGETS = {"src0": 0.5, "src1": 0.4, "src2": 0.1}


@query(f"""{U}, h AS (SELECT dataset_id, sum(duration) / 3600 AS hours FROM u GROUP BY ALL), s AS (SELECT *, hours / sum(hours) OVER () AS share, CASE dataset_id WHEN 'src0' THEN 0.5 WHEN 'src1' THEN 0.4 WHEN 'src2' THEN 0.1 ELSE 0.0 END AS target FROM h)
SELECT dataset_id, round(hours, 6) AS hours, round(share, 6) AS share, CAST(target AS DOUBLE) AS target, abs(share - target) <= 0.015 AS ok FROM s""")
def subset_validation(t: Tables) -> DataFrame:
    return audit.composition(t.utterances(), TARGETS).withColumns({"hours": rounded("hours"), "share": rounded("share")})


@query(f"{U} SELECT count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE tier = 'gold') AS gold, count(*) FILTER (WHERE duration > 30) AS long FROM u")
def flag_counts(t: Tables) -> DataFrame:
    u = t.utterances().select((F.col("toxic") == 1).alias("toxic"), (F.col("tier") == "gold").alias("gold"), (F.col("duration") > 30).alias("long"))
    return audit.flags(u, "toxic", "gold", "long")


@query("WITH e AS (SELECT l.doc_id, l.quality AS expected, d.n_chars FROM labels l JOIN documents d USING (doc_id)) SELECT count(*) AS differing FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def unlabelled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").exceptAll(t.labels.select("doc_id")).agg(F.count("*").alias("differing"))


@query("SELECT d.doc_id AS name, CAST(d.n_chars AS DOUBLE) AS expected, CAST(length(d.text) AS DOUBLE) AS actual FROM documents d WHERE abs(length(d.text) - d.n_chars) > 0.5")
def report_mismatches(t: Tables) -> DataFrame:
    d = t.documents
    expected = d.select(F.col("doc_id").alias("name"), F.col("n_chars").cast("double").alias("v"))
    actual = d.select(F.col("doc_id").alias("name"), F.length("text").cast("double").alias("v"))
    return audit.matches(actual, expected, "name", "v", 0.5)


@query(f"""SELECT vec_id, CASE WHEN bool_and(v > 0) THEN 'all' WHEN NOT bool_or(v > 0) THEN 'none' ELSE 'mixed' END AS state, count(*) AS parameters FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings) GROUP BY ALL""")
def state_collapse(t: Tables) -> DataFrame:
    from ..operators.experiments import collapse

    return collapse(t.embeddings.select("vec_id", F.explode("embedding").alias("v")).withColumn("on", F.col("v") > 0), "vec_id", "on")

