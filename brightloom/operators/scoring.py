"""Rule-based quality scoring: a table of (reason, condition, penalty), declared once and evaluated natively."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric, text

Rule = tuple[str, Column, float]


def stripped(t: Column) -> Column:
    return F.btrim(F.coalesce(t, F.lit("")), F.lit(" \t\n\x0b\f\r" + text.SPACES))


def reasons_of(rules: list[Rule]) -> Column:
    """Names of the rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c, _ in rules]))


def score_of(rules: list[Rule], start: float | Column = 100.0) -> Column:
    total = F.lit(start) if isinstance(start, float) else start
    for _, c, penalty in rules:
        total = total - F.when(F.coalesce(c, F.lit(False)), F.lit(penalty)).otherwise(0.0)
    return total


def sample_rules(s: Column, duration: Column, similarity: Column | None = None, cer: Column | None = None, wer: Column | None = None) -> list[Rule]:
    known = F.when(~F.isnan(duration), duration)  # NaN would count as larger than any number
    chars, cps = F.length(s), numeric.per_second(F.length(s), known)
    rules = [
        ("empty_transcript", s == "", 80.0), ("invalid_duration", ~numeric.finite(duration) | (duration <= 0), 80.0), ("long_utterance", known > 30, 10.0),
        ("low_chars_per_second", cps < 2, 30.0), ("high_chars_per_second", cps > 35, 30.0), ("suspicious_symbols", text.suspicious(text.normalize(s)), 15.0),
        ("low_character_diversity", (chars > 10) & text.few_distinct(s), 25.0),
    ]
    for name, value, bad, penalty in (("low_asr_similarity", similarity, lambda v: v < 0.70, 35.0), ("high_asr_cer", cer, lambda v: v > 0.35, 25.0), ("high_asr_wer", wer, lambda v: v > 0.80, 20.0)):
        if value is not None:
            rules.append((name, bad(value), penalty))
    return rules


def decision(score: Column, reasons: Column) -> Column:
    return F.when(score < 60, "reject").when((score < 80) | (F.size(reasons) > 0), "suspicious").otherwise("keep")


def score_samples(df: DataFrame, t: str = "text", duration: str = "duration", **agreement: str) -> DataFrame:
    """Adds score, decision, reasons (array), chars_per_second and transcript_chars."""
    df = df.withColumn("_s", stripped(F.col(t)))
    rules = sample_rules(F.col("_s"), F.col(duration), **{k: F.col(v) for k, v in agreement.items()})
    df, rules = flagged(df, rules)
    df = df.withColumns({"reasons": reasons_of(rules), "score": numeric.clamp(score_of(rules), 0.0, 100.0)})
    df = df.withColumns({"decision": decision(F.col("score"), F.col("reasons")), "chars_per_second": numeric.per_second(F.length("_s"), F.col(duration)), "transcript_chars": F.length("_s")})
    return df.drop("_s", *[f"_rule{i}" for i in range(len(rules))])


def flagged(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, list[Rule]]:
    """The rules' conditions as columns, so that each is evaluated once for both reasons and score."""
    df = df.withColumns({f"_rule{i}": F.coalesce(c, F.lit(False)) for i, (_, c, _) in enumerate(rules)})
    return df, [(name, F.col(f"_rule{i}"), penalty) for i, (name, _, penalty) in enumerate(rules)]


def pipe_joined(reasons: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(reasons)), "|")


def later_of(key: list[str], order: str) -> Column:
    """Whether an earlier row has the same key."""
    return F.row_number().over(Window.partitionBy(*key).orderBy(order)) > 1


def filter_manifest(df: DataFrame, order: str, path: str = "audio_path", t: str = "text", duration: str = "duration") -> DataFrame:
    """Sample scores with repeated paths (rejected, at most 50) and repeated transcripts (at most 75, suspicious)."""
    df = score_samples(df, t, duration).withColumn(t, F.coalesce(t, F.lit("")))
    df = df.withColumns({"_path": later_of([path], order), "_text": later_of([t], order)})
    score = F.when(F.col("_path"), F.least("score", F.lit(50.0))).otherwise(F.col("score"))
    score = F.when(F.col("_text"), F.least(score, F.lit(75.0))).otherwise(score)
    says = F.when(F.col("_path"), "reject").when(F.col("_text") & (F.col("decision") == "keep"), "suspicious").otherwise(F.col("decision"))
    added = F.array_compact(F.array(F.when(F.col("_path"), F.lit("duplicate_audio_path")), F.when(F.col("_text"), F.lit("duplicate_transcript"))))
    df = df.withColumns({"quality_score": score, "quality_decision": says, "quality_reasons": pipe_joined(F.concat("reasons", added))})
    return df.drop("_path", "_text", "score", "decision", "reasons")


def tier_class(score: Column, hint: Column) -> Column:
    return F.when(score < 55, "reject").when(score < 75, "bronze").when((hint == "gold") & (score >= 85), "gold").otherwise("silver")


def corpus_quality(df: DataFrame, silence: str, snr: str, tier: str, t: str = "text", duration: str = "duration") -> DataFrame:
    """Sample score, less for silence and noise; null signal columns mean that the signal could not be read."""
    rules = [("high_silence", F.col(silence) > 0.65, 15.0), ("low_snr_proxy", F.col(snr) < 10, 15.0), ("audio_read_error", F.col(silence).isNull(), 25.0)]
    df = score_samples(df, t, duration)
    df = df.withColumn("quality_score", numeric.clamp(score_of(rules, F.col("score")), 0.0, 100.0))
    df = df.withColumn("quality_reasons", pipe_joined(F.concat("reasons", reasons_of(rules))))
    return df.withColumns({"quality_class": tier_class(F.col("quality_score"), F.col(tier)), "quality_decision": F.when(F.col("quality_score") < 55, "reject").otherwise("keep")}).drop("score", "decision", "reasons")


@dataclass(frozen=True)
class Gates:
    """Thresholds of the prefilter."""

    min_duration: float = 1.0
    max_duration: float = 30.0
    min_cps: float = 2.0
    max_cps: float = 30.0
    max_silence: float = 0.65
    min_snr: float = 8.0
    least_score: float = 70.0


# Reasons that reject whatever the score.
HARD = (
    "duration_too_short", "duration_too_long", "reading_speed_too_low", "reading_speed_too_high", "excessive_silence", "low_snr_proxy", "upstream_reported", "upstream_votes_negative",
    "exact_audio_overlap_gold", "near_audio_overlap_gold", "text_duration_overlap_gold", "transcript_overlap_locked_eval",
    "exact_audio_duplicate_silver", "near_audio_duplicate_silver", "text_duration_duplicate_silver",
)


def gate_rules(duration: Column, chars: Column, silence: Column, snr: Column, gates: Gates = Gates()) -> list[Rule]:
    cps = F.when(duration > 0, chars / duration).otherwise(0.0)
    return [
        ("duration_too_short", duration < gates.min_duration, 0.0), ("duration_too_long", duration > gates.max_duration, 0.0), ("reading_speed_too_low", cps < gates.min_cps, 0.0),
        ("reading_speed_too_high", cps > gates.max_cps, 0.0), ("excessive_silence", silence > gates.max_silence, 20.0), ("low_snr_proxy", snr < gates.min_snr, 15.0),
    ]


def hard(reasons: Column) -> Column:
    """Whether a reason, up to its first colon, rejects by itself."""
    return F.arrays_overlap(F.transform(reasons, lambda r: F.substring_index(r, ":", 1)), F.array(*map(F.lit, HARD)))


def prefilter(df: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """Gates over (text, duration, silence_pct, snr_proxy_db, and optionally overlap_reason, duplicate_reason, upstream reasons array):
    normalized text, its hash, score, reasons and decision."""
    df = df.withColumn("normalized_text", text.normalize(F.col("text")))
    df = score_samples(df, "normalized_text", "duration")
    rules = gate_rules(F.col("duration"), F.length("normalized_text"), F.col("silence_pct"), F.col("snr_proxy_db"), gates)
    reasons = F.concat(F.col("reasons"), reasons_of(rules))
    for extra in ("upstream_reasons", "overlap_reason", "duplicate_reason"):
        if extra in df.columns:
            part = F.col(extra) if extra == "upstream_reasons" else F.array_compact(F.array(F.nullif(F.col(extra), F.lit(""))))
            reasons = F.concat(reasons, F.coalesce(part, F.array().cast("array<string>")))
    df = df.withColumns({"_all": reasons, "heuristic_quality_score": numeric.clamp(score_of(rules, F.col("score")), 0.0, 100.0), "transcript_sha1": F.sha1("normalized_text")})
    says = F.when(hard(F.col("_all")) | (F.col("heuristic_quality_score") < gates.least_score), "reject").otherwise("teacher_candidate")
    return df.withColumns({"prefilter_decision": says, "rejection_reasons": pipe_joined(F.col("_all"))}).drop("_all", "score", "decision", "reasons")


def teacher_agreement(df: DataFrame, similarity: str, wer: str, cer: str, score: str, least_similarity: float = 0.85, most_wer: float = 0.35, most_cer: float = 0.15, least_score: float = 80.0) -> DataFrame:
    """Keeps rows on which a second transcript agrees; missing measures count as full disagreement."""
    s, w, c = F.coalesce(similarity, F.lit(0.0)), F.coalesce(wer, F.lit(10.0)), F.coalesce(cer, F.lit(10.0))
    rules = [("low_teacher_similarity", s < least_similarity, 30.0), ("high_teacher_wer", w > most_wer, 20.0), ("high_teacher_cer", c > most_cer, 20.0)]
    df = df.withColumns({"_reasons": reasons_of(rules), "teacher_quality_score": numeric.clamp(score_of(rules, F.col(score)), 0.0, 100.0)})
    says = F.when((F.size("_reasons") == 0) & (F.col("teacher_quality_score") >= least_score), "keep").otherwise("reject")
    return df.withColumns({"teacher_decision": says, "teacher_rejection_reasons": F.array_join("_reasons", "|")}).drop("_reasons")


# Weights of the tiers.
TIER_WEIGHTS = {"gold": 4.0, "silver": 1.5, "bronze": 1.0}


def trust_weight(tier: Column) -> Column:
    out = F.lit(1.0)
    for name, weight in TIER_WEIGHTS.items():
        out = F.when(F.lower(tier) == name, weight).otherwise(out)
    return out


def sampling_weight(tier: Column, quality: Column | None = None, dataset: Column | None = None, dataset_weights: dict[str, float] | None = None) -> Column:
    """Tier weight, times the dataset's, times quality / 100 between 0.1 and 1.25."""
    out = trust_weight(F.coalesce(F.nullif(tier, F.lit("")), F.lit("bronze")))
    for name, weight in (dataset_weights or {}).items():
        out = out * F.when(dataset == name, weight).otherwise(1.0)
    return out if quality is None else out * F.coalesce(numeric.clamp(quality / 100.0, 0.1, 1.25), F.lit(1.0))


def quality_band(score: Column) -> Column:
    """Everything under 85 falls in the last band."""
    return F.when(score >= 95, "95-100").when(score >= 90, "90-94").when(score >= 85, "85-89").otherwise("80-84")


def reason_histogram(df: DataFrame, *columns: str) -> DataFrame:
    """(reason, rows) of the first non-blank pipe-joined column; rows without any count as unspecified."""
    value = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit("unspecified"))
    parts = F.filter(F.split(value, r"\|"), lambda r: r != "")
    return df.select(F.explode(parts).alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))
