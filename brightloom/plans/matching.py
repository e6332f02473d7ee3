"""Queries on duplicates, overlaps between corpora and text similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, similarity, text
from ..operators import dedup, overlap, scoring
from . import corpus, sqltext as S
from .base import UTTERANCES, Tables, query, rounded

U = f"WITH {UTTERANCES}"

# A document's text stands for the signal; its first line for the head of it.
HASHED = f"""{U}, k AS (SELECT *, sha1(text) AS audio_sha1, sha1(string_split(text, chr(10))[1]) AS audio_head_sha1, sha1({S.normalized("text")}) AS transcript_sha1, CAST(round_even(duration / 0.1, 0) AS INTEGER) AS duration_bucket FROM u)"""


def hashed(t: Tables) -> DataFrame:
    head = F.get(F.split("text", "\n"), F.lit(0))
    return t.utterances().withColumns({"audio_sha1": F.sha1("text"), "audio_head_sha1": F.sha1(head), "transcript_sha1": text.text_hash(F.col("text")), "duration_bucket": numeric.bucket(F.col("duration"))})


def keyed(t: Tables) -> DataFrame:
    """The keys without the texts, computed once: several joins and aggregates read them."""
    return dedup.cut(hashed(t).withColumn("chars", F.length("text")).drop("text"))


@query(f"""{HASHED} SELECT transcript_sha1, count(*) AS rows, array_to_string(list_slice(list_sort(list(doc_id)), 1, 20), '|') AS members FROM k GROUP BY ALL HAVING count(*) > 1""")
def exact_dup_groups(t: Tables) -> DataFrame:
    return dedup.group_members(hashed(t), ["transcript_sha1"], "doc_id")


@query(f"""{HASHED} SELECT doc_id, count(*) OVER (PARTITION BY audio_sha1) > 1 AS duplicate_audio, count(*) OVER (PARTITION BY audio_head_sha1, duration_bucket) > 1 AS near_duplicate_audio,
 count(*) OVER (PARTITION BY transcript_sha1, duration_bucket) > 1 AS text_duration_overlap, count(*) OVER (PARTITION BY transcript_sha1) > 1 AS duplicate_transcript FROM k""")
def overlap_groups(t: Tables) -> DataFrame:
    keys = {"duplicate_audio": ["audio_sha1"], "near_duplicate_audio": ["audio_head_sha1", "duration_bucket"], "text_duration_overlap": ["transcript_sha1", "duration_bucket"], "duplicate_transcript": ["transcript_sha1"]}
    return dedup.group_sizes(keyed(t), keys).select("doc_id", *keys)


@query(f"""{HASHED}, g AS (SELECT transcript_sha1, list(doc_id) AS a FROM k GROUP BY ALL), h AS (SELECT audio_head_sha1, list(doc_id) AS b FROM k GROUP BY ALL)
SELECT doc_id, array_to_string(list_slice(list_sort(list_distinct(list_concat(CASE WHEN len(a) > 1 THEN a ELSE [] END, CASE WHEN len(b) > 1 THEN b ELSE [] END))), 1, 20), '|') AS members
FROM k JOIN g USING (transcript_sha1) JOIN h USING (audio_head_sha1) WHERE len(a) > 1 OR len(b) > 1""")
def combined_overlap(t: Tables) -> DataFrame:
    """Members of a row's transcript and head groups together: of each group only the first 20 ids are ever kept."""
    rows = keyed(t)
    out = rows.select("doc_id", "transcript_sha1", "audio_head_sha1")
    for key, name in (("transcript_sha1", "a"), ("audio_head_sha1", "b")):
        groups = dedup.group_members(rows, [key], "doc_id").select(key, F.split("members", r"\|").alias(name))
        out = out.join(groups, key, "left")
    both = F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("a", "b")]))
    ids = F.slice(F.array_sort(F.transform(both, lambda x: x.cast("long"))), 1, 20)
    return out.withColumn("members", F.array_join(F.transform(ids, lambda x: x.cast("string")), "|")).where("members <> ''").select("doc_id", "members")


def _gold(t: Tables) -> tuple[DataFrame, DataFrame]:
    return keyed(t).where("tier = 'gold'"), hashed(t).where("tier <> 'gold'")


GOLD = f"""{HASHED}, g AS (SELECT * FROM k WHERE tier = 'gold'), s AS (SELECT * FROM k WHERE tier <> 'gold'),
 ia AS (SELECT audio_sha1, arg_max(split, doc_id) AS sa FROM g GROUP BY ALL), ih AS (SELECT audio_head_sha1, duration_bucket, arg_max(split, doc_id) AS sh FROM g GROUP BY ALL),
 it AS (SELECT transcript_sha1, duration_bucket, arg_max(split, doc_id) AS st FROM g GROUP BY ALL), il AS (SELECT transcript_sha1, arg_max(split, doc_id) AS sl FROM g WHERE split IN ('val', 'test') GROUP BY ALL),
 o AS (SELECT s.*, CASE WHEN sa IS NOT NULL THEN 'exact_audio_overlap_gold' WHEN sh IS NOT NULL THEN 'near_audio_overlap_gold' WHEN st IS NOT NULL THEN 'text_duration_overlap_gold' WHEN sl IS NOT NULL THEN 'transcript_overlap_locked_eval' ELSE '' END AS overlap_reason,
  coalesce(sa, sh, st, sl, '') AS overlap_split FROM s LEFT JOIN ia USING (audio_sha1) LEFT JOIN ih USING (audio_head_sha1, duration_bucket) LEFT JOIN it USING (transcript_sha1, duration_bucket) LEFT JOIN il USING (transcript_sha1))"""


@query(f"{GOLD} SELECT doc_id, overlap_reason, overlap_split FROM o")
def gold_overlap_join(t: Tables) -> DataFrame:
    gold, silver = _gold(t)
    return overlap.lookup(silver, gold, "doc_id").select("doc_id", "overlap_reason", "overlap_split")


@query(f"{GOLD} SELECT doc_id FROM s WHERE transcript_sha1 NOT IN (SELECT transcript_sha1 FROM g)")
def gold_anti_join(t: Tables) -> DataFrame:
    gold, silver = _gold(t)
    return overlap.without(silver, gold, "locked").select("doc_id")


FIRST = """CASE WHEN row_number() OVER (PARTITION BY audio_sha1 ORDER BY doc_id) > 1 THEN 'exact_audio_duplicate_silver' WHEN row_number() OVER (PARTITION BY audio_head_sha1, duration_bucket ORDER BY doc_id) > 1 THEN 'near_audio_duplicate_silver'
 WHEN row_number() OVER (PARTITION BY transcript_sha1, duration_bucket ORDER BY doc_id) > 1 THEN 'text_duration_duplicate_silver' ELSE '' END"""


@query(f"{HASHED} SELECT doc_id, {FIRST} AS duplicate_reason FROM k")
def first_seen_dups(t: Tables) -> DataFrame:
    return overlap.first_seen(hashed(t), "doc_id").select("doc_id", "duplicate_reason")


GATES = [
    ("duration_too_short", "duration < 1", 0), ("duration_too_long", "duration > 30", 0), ("reading_speed_too_low", "length(s) / duration < 2", 0), ("reading_speed_too_high", "length(s) / duration > 30", 0),
    ("excessive_silence", "silence > 0.65", 20), ("low_snr_proxy", "greatest(0, least(60, db + 40)) < 8", 15),
]
PREFILTER = f"""{GOLD}, {corpus.WAVE_STATS}, x AS (SELECT o.* EXCLUDE (text), text, {FIRST} AS duplicate_reason FROM o),
 y AS (SELECT *, {S.stripped("nt")} AS s, {S.normalized("nt")} AS n FROM (SELECT x.*, {S.normalized("text")} AS nt, silence, db FROM x LEFT JOIN ws ON doc_id = vec_id)),
 z AS (SELECT *, list_concat({S.reasons(S.rules())}, {S.reasons(GATES)}, list_filter([CASE WHEN toxic = 1 THEN 'upstream_reported' END, nullif(overlap_reason, ''), nullif(duplicate_reason, '')], lambda r: r IS NOT NULL)) AS why, {S.score(GATES, S.score(S.rules()))} AS sc FROM y)
SELECT doc_id, sc AS heuristic_quality_score, {S.joined("why")} AS rejection_reasons, CASE WHEN sc < 70 OR len(list_filter(why, lambda r: r IN ({", ".join(f"'{h}'" for h in scoring.HARD)}))) > 0 THEN 'reject' ELSE 'teacher_candidate' END AS prefilter_decision FROM z"""


@query(PREFILTER)
def prefilter_decision(t: Tables) -> DataFrame:
    """The candidate corpus through all gates: sample rules, thresholds, overlap with the trusted corpus and first-seen repeats."""
    gold, silver = _gold(t)
    signal = corpus._with_signal(t).select("doc_id", "silence_pct", "snr_proxy_db")
    rows = overlap.first_seen(overlap.lookup(silver, gold, "doc_id"), "doc_id").join(signal, "doc_id", "left")
    reported = F.array_compact(F.array(F.when(F.col("toxic") == 1, F.lit("upstream_reported"))))
    rows = rows.drop("transcript_sha1").withColumn("upstream_reasons", reported)
    return scoring.prefilter(rows).select("doc_id", "heuristic_quality_score", "rejection_reasons", "prefilter_decision")


@query()
def fuzzy_pairs(t: Tables) -> DataFrame:
    """Pairs of different documents whose normalized texts share 12 characters at the start and are nearly equal."""
    return dedup.fuzzy_pairs(t.documents, "doc_id", text.normalize(F.col("text"))).withColumn("ratio", rounded("ratio"))


STAR = f"""{HASHED}, e AS (SELECT doc_id AS b, min(doc_id) OVER (PARTITION BY transcript_sha1) AS a FROM k UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY audio_head_sha1, dataset_id) FROM k),
 d AS (SELECT a AS x, b AS y FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
 r AS (SELECT node, min(label) AS component FROM (WITH RECURSIVE l(node, label) AS (SELECT DISTINCT x, x FROM d UNION SELECT d.y, l.label FROM l JOIN d ON l.node = d.x) SELECT * FROM l) GROUP BY node)"""


def _components(rows: DataFrame) -> DataFrame:
    return dedup.components(dedup.star_edges(rows, "doc_id", ["transcript_sha1"], ["audio_head_sha1", "dataset_id"]))


@query(f"{STAR} SELECT node, component FROM r")
def dup_components(t: Tables) -> DataFrame:
    return _components(keyed(t))


@query(f"""{STAR}, c AS (SELECT k.doc_id, component, row_number() OVER w = 1 AS kept, first_value(k.doc_id) OVER w AS kept_id FROM k JOIN r ON k.doc_id = r.node
 WINDOW w AS (PARTITION BY component ORDER BY CASE split WHEN 'test' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, -length(text), k.doc_id)) SELECT doc_id, component, kept, kept_id FROM c""")
def component_winner(t: Tables) -> DataFrame:
    rows = keyed(t)
    rows = rows.join(_components(rows).withColumnRenamed("node", "doc_id"), "doc_id")
    rank = F.when(F.col("split") == "test", 0).when(F.col("split") == "val", 1).otherwise(2)
    rows = rows.withColumns({"_rank": rank, "_long": -F.col("chars")})
    out = dedup.winners(rows, "component", F.col("_rank"), F.col("_long"), F.col("doc_id"))
    return out.select("doc_id", "component", "kept", F.col("_best.doc_id").alias("kept_id"))


PAIRS = f"""p AS (SELECT a.conv_id, a.turn, {S.normalized("a.text", False)} AS ref, {S.normalized("b.text", False)} AS hyp
 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""
# DuckDB's levenshtein counts bytes: every other letter becomes a capital one, which the normalized forms do not have.
CODED = f"""{PAIRS}, l AS (SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS other FROM (SELECT DISTINCT unnest(string_split(ref || hyp, '')) AS c FROM p) WHERE NOT regexp_matches(c, '^[ -~]*$')),
 q AS (SELECT conv_id, turn, length(ref) AS n, levenshtein(translate(ref, other, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), translate(hyp, other, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS e FROM p, l)"""
# Words of one side match nothing on the other, so only shared ones need a character of their own; chr(1) and chr(2) stand for the rest.
WORDED = f"""{PAIRS}, w AS (SELECT conv_id, turn, {S.words("ref")} AS x, {S.words("hyp")} AS y FROM p), k AS (SELECT *, list_distinct(list_intersect(x, y)) AS known FROM w),
 v AS (SELECT conv_id, turn, len(x) AS n, CAST(levenshtein(array_to_string(list_transform(x, lambda a: CASE WHEN list_contains(known, a) THEN chr(2 + list_position(known, a)) ELSE chr(1) END), ''),
  array_to_string(list_transform(y, lambda a: CASE WHEN list_contains(known, a) THEN chr(2 + list_position(known, a)) ELSE chr(2) END), '')) AS BIGINT) AS e FROM k)"""


def pairs(t: Tables) -> DataFrame:
    """Each turn of a conversation with the next one, as reference and hypothesis, in the form in which transcripts are compared."""
    c = t.conversations.select("conv_id", "turn", similarity.agreement(F.col("text")).alias("ref"))
    return c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ref").alias("hyp")), ["conv_id", "turn"])


@query(f"WITH {CODED} SELECT conv_id, turn, CAST(e AS BIGINT) AS edits, round(e / nullif(n, 0), 6) AS cer FROM q")
def cer_pairs(t: Tables) -> DataFrame:
    r, h = F.col("ref"), F.col("hyp")
    return pairs(t).select("conv_id", "turn", similarity.char_edits(r, h).cast("long").alias("edits"), rounded(similarity.cer(r, h)).alias("cer"))


@query(f"WITH {CODED} SELECT sum(e) AS edits, sum(n) AS chars, round(sum(e) / sum(n), 6) AS cer FROM q")
def cer_corpus(t: Tables) -> DataFrame:
    e, n = F.sum(similarity.char_edits(F.col("ref"), F.col("hyp"))), F.sum(F.length("ref"))
    return pairs(t).agg(e.alias("edits"), n.alias("chars"), rounded(e / n).alias("cer"))


@query(f"WITH {WORDED} SELECT conv_id, turn, e AS word_edits, round(e / nullif(n, 0), 6) AS wer FROM v")
def wer_pairs(t: Tables) -> DataFrame:
    r, h = F.col("ref"), F.col("hyp")
    return pairs(t).select("conv_id", "turn", similarity.word_edits(r, h).cast("long").alias("word_edits"), rounded(similarity.wer(r, h)).alias("wer"))


@query(f"WITH {WORDED} SELECT sum(e) AS word_edits, sum(n) AS words, round(sum(e) / sum(n), 6) AS wer FROM v")
def wer_corpus(t: Tables) -> DataFrame:
    e, n = F.sum(similarity.word_edits(F.col("ref"), F.col("hyp")).cast("long")), F.sum(F.size(text.words(F.col("ref"))))
    return pairs(t).agg(e.alias("word_edits"), n.alias("words"), rounded(e / n).alias("wer"))


@query()
def similarity_ratio(t: Tables) -> DataFrame:
    """Ratcliff-Obershelp and Indel ratio of each pair; no SQL has them, so tests hold them against difflib and a dynamic program."""
    out = pairs(t).withColumns({"ratcliff": similarity.ratcliff("ref", "hyp"), "indel": similarity.indel_ratio("ref", "hyp")})
    return out.select("conv_id", "turn", rounded("ratcliff").alias("ratcliff"), rounded("indel").alias("indel"))


def measured(t: Tables) -> DataFrame:
    """Pairs with their three measures; a reference without words counts as wholly wrong."""
    r, h = F.col("ref"), F.col("hyp")
    rates = {"wer": F.coalesce(similarity.wer(r, h), F.lit(10.0)), "cer": F.coalesce(similarity.cer(r, h), F.lit(10.0))}
    return pairs(t).withColumns({"sim": similarity.ratcliff("ref", "hyp"), **rates, "base": F.lit(95.0)})


AGREE = [("low_teacher_similarity", "sim < 0.85", 30), ("high_teacher_wer", "wer > 0.35", 20), ("high_teacher_cer", "cer > 0.15", 20)]
AGREED = ("conv_id", "turn", "teacher_quality_score", "teacher_rejection_reasons", "teacher_decision")


@query()
def teacher_agreement(t: Tables) -> DataFrame:
    """The agreement gate over similarity, word and character error rate of each pair; tests hold it against plain Python."""
    return scoring.teacher_agreement(measured(t), "sim", "wer", "cer", "base").select(*AGREED)


@query(f"""WITH {CODED}, {WORDED[len(PAIRS) + 2 :]}, m AS (SELECT q.conv_id, q.turn, coalesce(q.e / nullif(q.n, 0), 10) AS cer, coalesce(v.e / nullif(v.n, 0), 10) AS wer, 95.0 AS base FROM q JOIN v USING (conv_id, turn)),
 x AS (SELECT *, {S.reasons(AGREE)} AS why, {S.score(AGREE, "base")} AS sc FROM (SELECT *, 1 - cer AS sim FROM m))
SELECT conv_id, turn, sc AS teacher_quality_score, array_to_string(why, '|') AS teacher_rejection_reasons, CASE WHEN len(why) = 0 AND sc >= 80 THEN 'keep' ELSE 'reject' END AS teacher_decision FROM x""")
def teacher_gate(t: Tables) -> DataFrame:
    """The same gate where the similarity is what the character error rate leaves, which SQL can express."""
    return scoring.teacher_agreement(measured(t).withColumn("sim", 1 - F.col("cer")), "sim", "wer", "cer", "base").select(*AGREED)


@query(f"SELECT doc_id, sha1({S.normalized('text')}) AS normalized_sha1 FROM documents")
def normalize_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.text_hash(F.col("text")).alias("normalized_sha1"))


@query(f"SELECT doc_id, sha1({S.legacy('text')}) AS legacy_sha1, sha1({S.collapsed('lower(text)')}) AS audit_sha1, length({S.legacy('text')}) BETWEEN 2 AND 500 AS valid FROM documents")
def legacy_normalize(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.documents.select("doc_id", F.sha1(text.normalize_legacy(x)).alias("legacy_sha1"), F.sha1(text.audit_form(x)).alias("audit_sha1"), text.valid(x).alias("valid"))


@query(f"SELECT doc_id, sha1({S.normalized('text', False)}) AS agreement_sha1 FROM documents")
def agreement_form(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha1(similarity.agreement(F.col("text"))).alias("agreement_sha1"))


@query(f"SELECT doc_id, {S.distinct_chars('text')} AS distinct_chars, len({S.words('text')}) AS words, {S.suspicious('text')} AS suspicious FROM documents")
def char_diversity(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.documents.select("doc_id", text.distinct_chars(x).cast("long").alias("distinct_chars"), text.word_count(x).alias("words"), text.suspicious(x).alias("suspicious"))


W = r"[^\p{L}\p{M}\p{N}_]"
CONFUSED = f"""SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '(^|{W})(?i:ve|değil|için|çok|şimdi|olarak|gibi|kadar)($|{W})|[ğşİı]') THEN 'turkish_like' END,
 CASE WHEN regexp_matches(text, '[әіңүұқөһ]|(^|{W})(?i:jane|bolyp|ushin|qazaq)($|{W})') THEN 'kazakh_like' END, CASE WHEN regexp_matches(text, '[А-Яа-яЁё]') THEN 'russian_cyrillic' END,
 CASE WHEN regexp_matches(text, '(^|{W})(?i:the|and|is|are|with|for|this|that|you|not)($|{W})') THEN 'english_like' END], lambda x: x IS NOT NULL) AS labels FROM documents"""


@query(f"SELECT doc_id, array_to_string(labels, '|') AS labels FROM ({CONFUSED})")
def language_confusion(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(text.confusion_labels(F.col("text")), "|").alias("labels"))


@query(f"SELECT label, count(*) AS rows, round(count(*) / greatest(1, (SELECT count(*) FROM documents)), 6) AS rate FROM (SELECT unnest(labels) AS label FROM ({CONFUSED})) GROUP BY ALL")
def confusion_rates(t: Tables) -> DataFrame:
    d = t.documents
    n = d.agg(F.greatest(F.lit(1), F.count("*")).alias("n"))
    counts = d.select(F.explode(text.confusion_labels(F.col("text"))).alias("label")).groupBy("label").agg(F.count("*").alias("rows"))
    return counts.crossJoin(F.broadcast(n)).select("label", "rows", rounded(F.col("rows") / F.col("n")).alias("rate"))  # one row


RUN5 = "len(w) >= 8 AND len(list_filter(range(1, len(w) - 3), lambda i: w[i] = w[i + 1] AND w[i] = w[i + 2] AND w[i] = w[i + 3] AND w[i] = w[i + 4])) > 0"


@query(f"SELECT doc_id, {RUN5} AS repeated FROM (SELECT doc_id, {S.words('lower(text)')} AS w FROM documents)")
def ngram_repetition(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.repeated_phrase(F.col("text")).alias("repeated"))


@query(f"""WITH {PAIRS}, s AS (SELECT conv_id, turn, greatest(length(trim(hyp)), 1) AS n, greatest(length(trim(ref)), 1) AS m, hyp, {S.words("hyp")} AS w FROM p)
SELECT conv_id, turn, n AS prediction_length, m AS reference_length, round(n / m, 6) AS length_ratio, regexp_matches(hyp, '[{text.FOREIGN_LETTERS}]') AS language_confusion,
 array_to_string(list_slice(list_sort(list_distinct(list_filter(string_split(hyp, ''), lambda c: c <> '' AND NOT contains('{text.KNOWN_LETTERS.replace("'", "''")}', c)))), 1, 20), ' ') AS unexpected_chars, n / m > 3 OR ({RUN5}) AS hallucination FROM s""")
def prediction_signs(t: Tables) -> DataFrame:
    s = text.prediction_signs(F.col("hyp"), F.col("ref"))
    s |= {"length_ratio": rounded(s["length_ratio"]), "unexpected_chars": F.array_join(s["unexpected_chars"], " "), "prediction_length": s["prediction_length"].cast("long"), "reference_length": s["reference_length"].cast("long")}
    return pairs(t).select("conv_id", "turn", *[c.alias(k) for k, c in s.items()])


@query(f"""WITH {PAIRS}, s AS (SELECT greatest(length(trim(hyp)), 1) / greatest(length(trim(ref)), 1) > 3 AS h, regexp_matches(hyp, '[{text.FOREIGN_LETTERS}]') AS f FROM p)
SELECT round(avg(CASE WHEN h THEN 1.0 ELSE 0 END), 6) AS long_rate, round(avg(CASE WHEN f THEN 1.0 ELSE 0 END), 6) AS confusion_rate FROM s""")
def indicator_rates(t: Tables) -> DataFrame:
    s = text.prediction_signs(F.col("hyp"), F.col("ref"))
    return pairs(t).agg(rounded(F.avg((s["length_ratio"] > 3).cast("double"))).alias("long_rate"), rounded(F.avg(s["language_confusion"].cast("double"))).alias("confusion_rate"))


@query(f"""WITH d AS (SELECT doc_id, {S.words("lower(text)")} AS w FROM documents), b AS (SELECT item_id, {S.words("lower(text)")} AS w FROM benchmark),
 dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: md5(array_to_string(w[i : i + 12], ' ')))) AS g FROM d WHERE len(w) >= 13),
 bg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 11), lambda i: md5(array_to_string(w[i : i + 12], ' ')))) AS g FROM b WHERE len(w) >= 13)
SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN bg USING (g) GROUP BY ALL""")
def contamination_scan(t: Tables) -> DataFrame:
    """Documents that share 13-word sequences with a benchmark item, by an equi-join on the sequences' hash."""

    def grams(df: DataFrame, ident: str) -> DataFrame:
        w = F.col("w")
        df = df.select(ident, text.words(F.lower("text")).alias("w"))
        at = F.when(F.size(w) >= 13, F.sequence(F.lit(1), F.size(w) - 12)).otherwise(F.array().cast("array<int>"))
        return df.select(ident, F.explode(F.array_distinct(F.transform(at, lambda i: F.md5(F.array_join(F.slice(w, i, 13), " "))))).alias("g"))

    return grams(t.documents, "doc_id").join(grams(t.benchmark, "item_id"), "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS transcript, count(*) AS turns FROM conversations GROUP BY ALL")
def transcript_concat(t: Tables) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("transcript"), F.count("*").alias("turns"))


@query("SELECT page_id, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS links, len(regexp_extract_all(html, '\\[[^\\]]+\\]\\(([^)]+)\\)', 1)) AS markdown_links, len(regexp_extract_all(html, 'track')) AS tokens FROM pages")
def page_links(t: Tables) -> DataFrame:
    anchors = F.regexp_extract_all(F.col("html"), F.lit('<a href="([^"]*)"'), F.lit(1))
    return t.pages.select("page_id", F.size(anchors).cast("long").alias("links"), F.size(text.links(F.col("html"))).cast("long").alias("markdown_links"), F.regexp_count("html", F.lit("track")).cast("long").alias("tokens"))


@query(f"{HASHED} SELECT doc_id FROM k WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = k.doc_id)")
def resume_anti_join(t: Tables) -> DataFrame:
    return overlap.unfinished(hashed(t), t.labels, "doc_id").select("doc_id")


@query("SELECT o_orderkey, o_totalprice, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def detail_join(t: Tables) -> DataFrame:
    """Every order with its customer's details; an order without one would be an error."""
    details = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey", F.col("c_custkey").alias("_row"))
    return overlap.details(t.orders.select("o_orderkey", "o_totalprice", "o_custkey"), details, "o_custkey", "_row").select("o_orderkey", "o_totalprice", "c_name", "c_nationkey")

