import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.functions import similarity
from brightloom.operators import audit, cleaning, dedup, experiments, longform, overlap, reports, sampling, scoring, storage


def manifest(spark, n=300, seed=1):
    import random

    r = random.Random(seed)
    rows = [(i, f"p{i}", r.choice(["a", "b", "c"]), f"s{r.randrange(25)}", round(r.uniform(0.5, 20), 2), r.randint(1, 40)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id int, audio_path string, dataset_id string, speaker_id string, duration double, words long")


def test_scores_at_the_limits(spark):
    # text, duration, reasons, score
    cases = [
        ("", 1.0, ["empty_transcript", "low_chars_per_second"], 0.0), ("abc def", 0.0, ["invalid_duration"], 20.0), ("abcdefgh", 4.0, [], 100.0), ("abcdefgh", 4.01, ["low_chars_per_second"], 70.0),
        ("a" * 7 + "bcd", 10 / 35, [], 100.0), ("aaaaaaaaaaa", 1.0, ["low_character_diversity"], 75.0), ("salom dunyo " * 7, 30.0, [], 100.0), ("salom dunyo " * 7, 30.01, ["long_utterance"], 90.0), ("salom © dunyo", 1.0, ["suspicious_symbols"], 85.0),
        (None, float("nan"), ["empty_transcript", "invalid_duration"], 0.0),
    ]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, text string, duration double")
    for r in scoring.score_samples(df).collect():
        assert (r["reasons"], r["score"]) == cases[r["i"]][2:], cases[r["i"]]
        assert r["decision"] == ("reject" if r["score"] < 60 else "suspicious" if r["reasons"] or r["score"] < 80 else "keep")


def test_tiers_and_weights(spark):
    df = spark.createDataFrame([(54.9, "gold"), (55.0, "gold"), (75.0, "gold"), (85.0, "gold"), (85.0, "silver")], "q double, t string")
    got = df.select(scoring.tier_class(F.col("q"), F.col("t")).alias("c"), scoring.sampling_weight(F.col("t"), F.col("q") * 2).alias("w")).collect()
    assert [r["c"] for r in got] == ["reject", "bronze", "silver", "gold", "silver"] and got[3]["w"] == 4.0 * 1.25 and got[4]["w"] == 1.5 * 1.25


def test_first_seen_leaves_one_of_each_key(spark):
    rows = [(i, f"a{i % 4}", f"h{i % 3}", f"t{i % 2}", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, audio_sha1 string, audio_head_sha1 string, transcript_sha1 string, duration_bucket int")
    got = {r["i"]: r["duplicate_reason"] for r in overlap.first_seen(df, "i").collect()}
    audio, head, text = set(), set(), set()
    for i, a, h, t, b in rows:
        want = "exact_audio_duplicate_silver" if a in audio else "near_audio_duplicate_silver" if (h, b) in head else "text_duration_duplicate_silver" if (t, b) in text else ""
        audio.add(a), head.add((h, b)), text.add((t, b))
        assert got[i] == want


def test_cascade_counts_repeats_among_survivors(spark):
    rows = [(0, "x", "fine text", 0.5), (1, "x", "fine text", 2.0), (2, "x", "fine text", 3.0), (3, " ", "fine text", 2.0), (4, "y", None, 2.0), (5, "y", "z" * 501, 2.0), (6, "y", "q", 2.0), (7, "y", "ok ok", 31.0), (8, "y", "ok ok", None)]
    got = {r["i"]: r["reason"] for r in cleaning.cascade(spark.createDataFrame(rows, "i int, audio_path string, text string, duration double"), "i").collect()}
    assert list(got[i] for i in range(9)) == ["duration_too_short", None, "duplicate_sample", "missing_audio", "empty_transcript", "transcript_too_long", "transcript_too_short", "duration_too_long", "corrupted_audio"]


def test_archive_names(spark):
    df = spark.createDataFrame([("a/b.wav",), ("/etc/x",), ("a/../../x",), ("..",), ("a..b/c",), ("C:\\x",)], "n string")
    assert [r[0] for r in df.select(cleaning.safe_member(F.col("n"))).collect()] == [True, False, False, False, True, False]


def test_components_and_winners(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6), (6, 10)], "left long, right long")
    got = {r["node"]: r["component"] for r in dedup.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 6, 10: 6}
    assert dedup.components(edges.limit(0)).count() == 0


def test_fuzzy_pairs(spark):
    base = "the same beginning of a longer text with many words in it for the ratio to count"
    rows = [(0, base), (1, base + "s"), (2, base[:-20] + "x" * 20), (3, base.replace("many", "mani")), (4, "other"), (5, base)]
    got = {(r["left"], r["right"]) for r in dedup.fuzzy_pairs(spark.createDataFrame(rows, "i int, t string"), "i", "t").collect()}
    assert got == {(0, 1), (0, 3), (1, 3)}


@pytest.mark.parametrize("rows_a_block", [512, 7])
def test_fuzzy_pairs_write_no_text_for_each_pair(spark, monkeypatch, rows_a_block):
    """Near copies in one block: all pairs are found whatever the blocks' size, and what is checkpointed does not grow with them."""
    import pathlib
    import random

    monkeypatch.setattr(dedup, "CELL_ROWS", rows_a_block, raising=False)
    r = random.Random(5)
    base = "one and the same " + "".join(r.choice("abcdefgh ") for _ in range(2000))
    texts = {}
    for i in range(40):
        cut = r.randrange(20, 1500)
        texts[i] = base[:cut] + "x" * r.randrange(90) + base[cut + r.randrange(140) :]
    rows = [*texts.items(), (3, texts[3]), (90, texts[5]), (None, texts[7]), (None, base), (91, None), (92, ""), (93, "one and the other")]
    want = {}
    for i, a in texts.items():
        for j in range(i + 1, 40):
            b = texts[j]
            if abs(len(a) - len(b)) <= 0.04 * (len(a) + len(b)):
                ratio = 200.0 * similarity.common_subsequence(a, b) / (len(a) + len(b))
                if ratio >= 96:
                    want[i, j] = ratio
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    got = dedup.fuzzy_pairs(spark.createDataFrame(rows, "i int, t string").repartition(3), "i", "t").collect()
    assert {(x["left"], x["right"]): x["ratio"] for x in got} == want and len(got) == len(want) > 100
    assert size() - before < 40 * 2000


def test_indel_ratios_of_many_pairs():
    """Measured together they are what one by one gives, also where texts are of several words of bits and edits lie at the threshold."""
    import random

    r = random.Random(1)
    for n in (30, 64, 65, 900, 4000):
        base, texts = [r.choice("abcdefgh éя\U0001f600") for _ in range(n)], []
        for _ in range(20):
            x = list(base)
            for _ in range(r.randrange(max(2, n // r.choice([14, 200])))):
                k = r.randrange(len(x))
                x[k : k + r.randrange(2)] = r.choice(["", "x", "yz"])
            texts.append("".join(x))
        left, right = (np.array(x) for x in zip(*[(i, j) for i in range(20) for j in range(i)], strict=True))
        want = [similarity.indel(texts[i], texts[j]) for i, j in zip(left, right, strict=True)]
        assert similarity.indel_ratios(texts, left, right, 96.0).tolist() == [x if x >= 96 else 0.0 for x in want]


def key(seed, *parts):
    return hashlib.sha256("\0".join([str(seed), *parts]).encode()).hexdigest()[:16]


def test_budget_stops_at_the_target(spark):
    rows, df = manifest(spark)
    got = sampling.budget(df.withColumn("k", sampling.stable_key(3, "audio_path")), ["k"], "duration", 500.0).collect()
    order = sorted(rows, key=lambda r: key(3, r[1]))
    want, total = [], 0.0
    for r in order:
        if total >= 500:
            break
        want.append(r[0])
        total += r[4]
    assert {r["doc_id"] for r in got} == set(want)


def stratified(rows, goal, seed, source):
    rows = [r for r in rows if r[2] == source]

    def edges(values, k):
        v = sorted(values)
        return [v[min(len(v) - 1, len(v) * i // k)] for i in range(1, k)]

    d, w = edges([r[4] for r in rows], 5), edges([r[5] for r in rows], 4)
    strata = collections.defaultdict(list)
    for r in rows:
        strata[sum(r[4] > x for x in d), sum(r[5] > x for x in w)].append(r)
    total = sum(r[4] for r in rows)
    taken = []
    for k in sorted(strata):
        part = sorted(strata[k], key=lambda r: key(seed, source, str(k), r[1]))
        share = goal * sum(r[4] for r in part) / total
        run, mine = 0.0, []
        for r in part:
            if run >= share:
                break
            mine.append(r)
            run += r[4]
        if mine and abs(run - mine[-1][4] - share) < abs(run - share):
            mine.pop()
        taken += mine
    have = sum(r[4] for r in taken)
    for r in sorted((r for r in rows if r not in taken), key=lambda r: key(seed, source, "fill", r[1])):
        if have >= goal:
            break
        taken.append(r)
        have += r[4]
    if taken and abs(have - taken[-1][4] - goal) < abs(have - goal):
        taken.pop()
    return {r[0] for r in taken}


@pytest.mark.parametrize("goal", [150.0, 600.0])
def test_stratified(spark, goal):
    rows, df = manifest(spark)
    got = {r["doc_id"] for r in sampling.stratified(df, {"a": goal, "b": goal / 2}, 7, "audio_path").collect()}
    assert got == stratified(rows, goal, 7, "a") | stratified(rows, goal / 2, 7, "b")


def test_speaker_split_keeps_speakers_apart(spark):
    _, df = manifest(spark)
    out = sampling.speaker_split(df, 1, official=None)
    assert out.groupBy("speaker_id").agg(F.count_distinct("new_split").alias("n")).where("n > 1").count() == 0 and out.first()["strategy"] == "speaker_independent"
    few = df.withColumn("speaker_id", F.lit("x"))
    out = sampling.speaker_split(few, 1, official=None)
    assert out.count() == 300 and out.first()["strategy"] == "duration_stratified_random"
    one_missing = df.withColumn("split", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("val"))
    assert sampling.speaker_split(one_missing, 1).first()["strategy"] == "speaker_independent"


def test_weighted_draws(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 3.0)], "k string, w double")
    got = collections.Counter(r["k"] for r in sampling.weighted_draws(df, "w", "k", 4000, 5).collect())
    assert sum(got.values()) == 4000 and got["b"] == 0 and abs(got["c"] / 4000 - 0.75) < 0.03


def test_leaks_and_composition(spark):
    df = spark.createDataFrame([("p1", "train", "a", 3600.0), ("p1", "test", "a", 3600.0), ("", "train", "b", 1800.0), ("", "test", "b", 0.0)], "k string, split string, dataset_id string, duration double")
    assert [tuple(r) for r in audit.leaks(df, {"k": ["k"]}).collect()] == [("k", 1, "fail")]
    shares = {r["dataset_id"]: (r["share"], r["ok"]) for r in audit.composition(df, {"a": 0.8, "b": 0.5}).collect()}
    assert shares["a"] == (0.8, True) and shares["b"][1] is False and math.isclose(sum(s for s, _ in shares.values()), 1)
    with pytest.raises(ValueError, match="missing"):
        audit.require(df, ["nothing"])


def test_runs(spark):
    curve = spark.createDataFrame([(1, i, x, 0.0) for i, x in enumerate([5.0, 4.0, 4.0, 4.5, 4.6, 3.0])], "run int, step int, wer double, cer double")
    got = [r["is_best"] for r in experiments.so_far(curve, "run", "step", "wer").orderBy("step").collect()]
    assert got == [True, True, False, False, False, True]
    assert [r["worsening"] for r in experiments.early_stop(curve, "run", "step", "wer", "cer").orderBy("step").collect()] == [False, False, False, False, True, False]
    runs = lambda *rows: spark.createDataFrame(rows, "run int, wer double, cer double, rate double")
    best = lambda *rows: tuple(experiments.winner(runs(*rows), "run", "wer", "cer", "rate").first())
    assert best((1, 0.1, 0.02, 1e-4), (2, 0.102, 0.0205, 1e-5)) == (2, "lower_rate")
    assert best((1, 0.1, 0.02, 1e-4), (2, 0.102, 0.0215, 1e-5)) == (1, "lower_cer")
    assert best((1, 0.1, 0.02, 1e-4), (2, 0.102, 0.018, 1e-3)) == (2, "lower_cer")
    assert best((1, 0.1, 0.02, 1e-4), (2, 0.104, 0.01, 1e-5)) == (1, "lowest_wer")
    assert best((7, 0.1, 0.02, 1e-4)) == (7, "lowest_wer")
    with pytest.raises(ValueError, match="no stable"):
        experiments.promoted(curve, F.col("wer") < 0, 2, F.col("wer"))


def test_longform_walks_on(spark):
    rows = [(f"p{i:03d}", 1.0 + i % 7) for i in range(40)] + [("short", 0.5)]
    df = spark.createDataFrame(rows, "audio_path string, duration double")
    groups = [("a", [10.0], 0.01), ("b", [20.0, 60.0], 0.05)]
    got = longform.compose(df, ["audio_path"], groups, "audio_path").orderBy("group", "number", "place").collect()
    cursor, want = 0, []
    for name, targets, hours in groups:
        made, n = 0.0, 0
        while made < hours * 3600:
            target, seconds, place = targets[n % len(targets)], 0.0, 0
            while seconds + 0.15 * place < target:
                want.append((name, n, place, rows[cursor % 40][0]))
                seconds += rows[cursor % 40][1]
                cursor, place = cursor + 1, place + 1
            made, n = made + min(target, seconds + 0.15 * place), n + 1
    assert [(r["group"], r["number"], r["place"], r["ident"]) for r in got] == want and cursor > 40


def test_details_must_be_complete(spark):
    master = spark.createDataFrame([("a",), ("b",)], "k string")
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "k string, i int, v string")
    with pytest.raises(ValueError, match="no details"):
        overlap.details(master, rows, "k", "i")
    assert overlap.details(master.where("k = 'a'"), rows, "k", "i").first()["v"] == "new"


def test_prefix_sums_of_large_groups(spark):
    import random

    r = random.Random(4)
    rows = [(i, None if i % 7 == 0 else f"g{i % 3 if i % 2 else 0}", r.randint(0, 50), float(r.randint(1, 9))) for i in range(900)]
    df = spark.createDataFrame(rows, "i int, g string, k int, v double").repartition(5)
    got = {x["i"]: x["before"] for x in sampling.running(df, ["k", "i"], "v", "before", ["g"], ranges=9).collect()}
    sums = collections.Counter()
    for i, g, _, v in sorted(rows, key=lambda x: (x[2], x[0])):
        assert got[i] == sums[g]
        sums[g] += v


def test_members_are_bounded_lists(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 > 0, "a").when(F.col("id") % 9 == 0, "").otherwise(F.concat(F.lit("b"), F.col("id") % 100)).alias("k"), F.col("id"))
    got = {r["k"]: (r["rows"], r["members"].split("|")) for r in dedup.group_members(df, ["k"], "id", 5).collect()}
    assert got["a"] == (333, ["1", "2", "4", "5", "7"]) and "" not in got and all(n > 1 and len(m) == min(n, 5) for n, m in got.values())


def test_tables_need_a_shared_folder_on_a_cluster(monkeypatch):
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()
        sparkContext = type("Context", (), {"master": "yarn", "getCheckpointDir": staticmethod(lambda: None)})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.cut(type("Frame", (), {"sparkSession": Session()})())


def test_configurations_and_schedules(spark):
    config = {"tuning_mode": "blockwise_encoder_lr", "encoder_block_d_lr": 2e-6, "learning_rate": 1e-5}
    assert reports.startup_rates(config) == {"encoder_0_7": 0.0, "encoder_8_15": 0.0, "encoder_16_23": 0.0, "encoder_24_31": 2e-6, "decoder": 1e-5}
    assert set(reports.startup_rates({"encoder_learning_rate": 3e-6, "learning_rate": 1e-5, "decoder_learning_rate": 2e-5}).values()) == {3e-6, 2e-5}
    assert reports.overrides("x", [0.0, 0.0, 0.0, 1e-6], 8e-6, 300) == {"experiment_name": "x", "encoder_block_a_lr": 0.0, "encoder_block_b_lr": 0.0, "encoder_block_c_lr": 0.0, "encoder_block_d_lr": 1e-6, "decoder_learning_rate": 8e-6, "learning_rate": 8e-6, "max_steps": 300}
    names = spark.createDataFrame([("model.encoder.layers.31.fc1.weight",), ("model.encoder.layers.8.x",), ("model.encoder.conv1.bias",), ("model.decoder.layers.3.x",)], "n string")
    assert [r[0] for r in names.select(reports.parameter_group(F.col("n"), True)).collect()] == ["encoder_24_31", "encoder_8_15", "encoder_other", "other"]
    assert [r[0] for r in names.select(reports.parameter_group(F.col("n"), False)).collect()] == ["encoder"] * 3 + ["other"]
    with pytest.raises(Exception, match="no block for"):
        spark.createDataFrame([("model.encoder.layers.32.x",)], "n string").select(reports.parameter_group(F.col("n"), True)).collect()


def test_ranked_runs_and_their_reports(spark):
    rows = [("a", None, None, True, 3600.0), ("b", 0.2, 0.1, False, 1800.0), ("c", 0.2, 0.1, True, None), ("d", 0.1, None, True, 60.0)]
    df = spark.createDataFrame(rows, "run string, wer double, cer double, stable boolean, runtime_seconds double")
    ranked = {r["run"]: r["rank"] for r in reports.ranked_rows(df).collect()}
    assert ranked == {"d": 1, "c": 2, "b": 3, "a": 4}
    assert not set(reports.ranked_rows(df).columns) & {"_unstable", "_one", "_h"}
    best = reports.best_schedule(df.withColumns({"rate": F.lit(5e-6), "decoder": F.lit(8e-6)}), "run", "wer", "cer", "rate", "decoder").first()
    assert best["run"] == "d" and best["blockwise_schedule"].asDict() == {"encoder_0_7": 0.0, "encoder_8_15": 0.0, "encoder_16_23": 0.0, "encoder_24_31": 5e-6, "decoder": 8e-6}
    with pytest.raises(ValueError, match="no completed run"):
        reports.best_schedule(df.where("wer IS NULL"), "run", "wer", "cer", "run", "run")
    references = spark.createDataFrame([("Winner", "d", "proxy"), ("Gone", "zz", "proxy"), ("Baseline", "b", "test")], "name string, run string, dataset string")
    metrics = df.withColumns({"test_wer": F.when(F.col("run") == "b", 0.05), "test_cer": F.lit(None).cast("double")})
    compared = reports.comparison(references, metrics, "run")
    assert {r["name"]: (r["wer"], r["cer"]) for r in compared.collect()} == {"Winner": ("0.1", None), "Gone": ("unavailable", "unavailable"), "Baseline": ("0.05", "0.1")}
    text = reports.recommendation("Pick", {"run": "d", "wer": 0.1, "blockwise_schedule": best["blockwise_schedule"].asDict()}, compared)
    assert "- encoder_24_31 = `5e-06`" in text and "- wer: `0.1`" in text and "| Gone | proxy | unavailable |" in text


def test_status_reports(spark):
    df = spark.createDataFrame([(i, "salom dunyo " * (1 + 9 * (i == 1)), "salom dunyo") for i in range(5)], "i int, p string, r string")
    from brightloom.functions import text

    samples = reports.sample_predictions(df, "i", "p", "r", text.prediction_signs(F.col("p"), F.col("r")), 2)
    assert [x["index"] for x in samples] == [0, 1] and samples[1]["indicators"]["hallucination"] is True and samples[0]["indicators"]["hallucination"] is False
    payload, page = reports.status(500, "eval", {"eval_wer": 0.2}, samples, "worse twice")
    assert payload["step"] == 500 and payload["stop_reason"] == "worse twice" and "- eval_wer: `0.2`" in page and page.count("### Sample") == 2


def test_logs_hashes_and_documents(spark):
    logs = spark.createDataFrame([(1, "CUDA OOM ... safety_warning SAFETY_WARNING"), (2, None), (3, "Non-finite loss, safety_stop")], "i int, log string")
    got = {r["i"]: (r["stability_failures"], r["safety_warning_count"]) for r in reports.log_signs(logs, "log").collect()}
    assert got == {1: (["cuda oom"], 2), 2: ([], 0), 3: (["safety_stop", "non-finite loss"], 0)}
    actual, pinned = spark.createDataFrame([("a", "1"), ("b", "2")], "p string, sha256 string"), spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "p string, sha256 string")
    assert sorted(tuple(r) for r in reports.hash_violations(actual, pinned, "p").collect()) == [("b", "3", "2"), ("c", "4", None)]
    files = spark.createDataFrame([("README.md", 900, "see A.md and the phrase"), ("A.md", 900, "x"), ("B.md", 10, "y"), ("old.md", 900, "z")], "name string, length long, text string")
    found = reports.document_problems(files, ["README.md", "A.md", "B.md", "C.md"], allowed=["README.md", "A.md", "B.md", "C.md"], index="README.md", phrases=["the phrase", "another"], protected=["model.bin", "A.md"])
    assert {tuple(r) for r in found.collect()} == {("missing", "C.md"), ("too_short", "B.md"), ("unexpected", "old.md"), ("not_in_index", "B.md"), ("not_in_index", "C.md"), ("phrase_missing", "another"), ("protected_missing", "model.bin")}


def test_seeded_subsets_are_the_single_samples(spark):
    rows, df = manifest(spark, 600)
    df = df.withColumn("split", F.when(F.col("doc_id") % 4 == 0, "val").otherwise("train"))
    jobs, shares = {"x": {"train": 0.1, "val": 0.02}, "y": {"train": 0.2, "val": 0.02}}, {"a": 0.6, "b": 0.4}
    got = collections.defaultdict(set)
    for r in sampling.seeded_subsets(df, jobs, shares, 1729, "audio_path").collect():
        got[r["job"], r["split"]].add(r["doc_id"])
    for job, split, hours, seed in (("x", "train", 0.1, 1729), ("y", "val", 0.02, 1830)):
        one = sampling.stratified(df.where(F.col("split") == split), {k: v * hours * 3600 for k, v in shares.items()}, seed, "audio_path")
        assert got[job, split] == {r["doc_id"] for r in one.collect()}
    report = {r["dataset_id"]: r for r in reports.subset_report(df.where("dataset_id = 'a'"), shares).collect()}
    assert report["a"]["share"] == pytest.approx(1.0) and (report["b"]["samples"], report["b"]["hours"], report["b"]["target_share"]) == (0, 0.0, 0.4)
