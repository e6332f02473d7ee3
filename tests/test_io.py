import hashlib
import io
import json
import struct
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from brightloom.functions.register import register
from brightloom.operators import audit, experiments
from brightloom.sources import readers, schemas, writers
from brightloom.streaming import monitor


def test_detect():
    assert readers.detect(["ID", "Sentence", "text_raw"], readers.TEXT_COLUMNS) == "Sentence"
    assert readers.detect(["id", "text_raw", "my_sentence"], readers.TEXT_COLUMNS) == "text_raw"
    assert readers.detect(["id"], readers.TEXT_COLUMNS) is None
    assert readers.with_config({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}, "b": 1}
    assert readers.override("a=b=c") == ("a", "b=c")
    with pytest.raises(ValueError):
        readers.override("novalue")


def test_named_datasets(spark, tmp_path):
    (tmp_path / "set.csv").write_text("a\n1\n")
    assert readers.named(spark, "set", str(tmp_path)) == f"{tmp_path}/set.csv"
    assert readers.named(spark, f"{tmp_path}/set.csv", "/nowhere") == f"{tmp_path}/set.csv"
    with pytest.raises(FileNotFoundError):
        readers.named(spark, "other", str(tmp_path))


def test_manifests_of_several_formats(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.csv").write_text('path,sentence,client_id\nx.wav,"hello, you",s1\n')
    (tmp_path / "b.tsv").write_text("audio\ttranscript\ny.wav\tyes\n")
    (tmp_path / "c.json").write_text(json.dumps([{"file": "z.wav", "text": "zed"}]))
    (tmp_path / "d" / "e.jsonl").write_text('{"wav": "q.wav", "transcription": "cue"}\n')
    (tmp_path / "d" / "skip.csv").write_text("a,b\n1,2\n")
    rows = {r["audio_path"]: (r["text"], r["speaker_id"]) for r in readers.flexible(spark, str(tmp_path)).collect()}
    assert rows == {"x.wav": ("hello, you", "s1"), "y.wav": ("yes", None), "z.wav": ("zed", None), "q.wav": ("cue", None)}


def test_sidecars(spark, tmp_path):
    for name, text in (("train/s1_data_1.wav", ""), ("train/s1_data_1.txt", " first "), ("train/s1_data_1.lab", "second"), ("dev/s2_2.flac", ""), ("dev/s2_2.trans.txt", "third"), ("x/none.wav", ""), ("x/blank.wav", ""), ("x/blank.txt", "  ")):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text or "RIFF")
    rows = sorted((r["text"], r["speaker_id"], r["split"]) for r in readers.flexible(spark, str(tmp_path)).collect())
    assert rows == [("first", "s1", "train"), ("third", "s2", "val")]
    found = readers.files(spark, str(tmp_path), "wav")
    asked = spark.createDataFrame([("s1_data_1.wav",), ("/abs.wav",), ("x/none.wav",), ("gone.wav",)], "audio_path string")
    got = [r["resolved_path"] for r in readers.resolved(asked, found, str(tmp_path / "dev"), str(tmp_path)).collect()]
    assert sorted(got) == sorted([f"{tmp_path}/train/s1_data_1.wav", "/abs.wav", f"{tmp_path}/x/none.wav", f"{tmp_path}/dev/gone.wav"])
    assert readers.profile(spark, str(tmp_path)).first()["extension"] in (".wav", ".txt")


def test_archives_and_headers(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/data.tsv", "﻿audio\ttext\nx\ty\n")
    assert [r["line"] for r in readers.zipped_tables(spark, f"{tmp_path}/*.zip", "data.tsv").orderBy("number").collect()] == ["audio\ttext", "x\ty"]
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(struct.pack("<800h", *[0] * 800))
    (tmp_path / "ok.wav").write_bytes(buffer.getvalue())
    (tmp_path / "bad.wav").write_bytes(b"no")
    rows = {r["path"].rpartition("/")[2]: r for r in readers.wave_header(spark, f"{tmp_path}/*.wav").collect()}
    assert (rows["ok.wav"]["rate"], rows["ok.wav"]["seconds"]) == (8000, 0.1) and rows["bad.wav"]["error"]


def test_results_and_experiments(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"performance": {"speed": 5.5}}))
    (tmp_path / "2.json").write_text(json.dumps({"performance": {"speed": 0}}))
    (tmp_path / "3.json").write_text("{not json")
    assert [r["performance"]["speed"] for r in readers.results(spark, f"{tmp_path}/*.json").collect()] == [5.5]
    (tmp_path / "m.exp").write_text(json.dumps({"experiment_id": "e", "stable": True, "validation_curve": [{"step": 1, "eval_wer": 0.5}]}))
    row = readers.experiments(spark, f"{tmp_path}/*.exp", schemas.EXPERIMENT).select("experiment_id", F.col("validation_curve")[0]["eval_wer"].alias("w")).first()
    assert tuple(row) == ("e", 0.5)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "test")], "id int, v string, split string")
    writers.csv(df, f"{tmp_path}/csv", ["v", "nothing", "id"])
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()) == [("a", "1"), ("b", "2")]
    writers.split_manifests(df, f"{tmp_path}/s", {"full": lambda d: d, "short": lambda d: d.select("id", "split")})
    assert spark.read.parquet(f"{tmp_path}/s/short/split=test").columns == ["id"]
    assert writers.append_new(df, f"{tmp_path}/t", "id") == 2 and writers.append_new(df.unionByName(df.limit(1).withColumn("id", F.lit(9))), f"{tmp_path}/t", "id") == 1
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
    writers.snapshot(df, f"{tmp_path}/live")
    writers.snapshot(df.limit(1), f"{tmp_path}/live")
    assert (spark.read.parquet(f"{tmp_path}/live").count(), spark.read.parquet(f"{tmp_path}/live.old").count()) == (1, 2)
    writers.header_only(spark, schemas.TRAINING, f"{tmp_path}/h")
    assert spark.read.option("header", True).csv(f"{tmp_path}/h").columns[0] == "audio_path"
    assert writers.markdown(df.limit(1)).count("\n") == 3
    once = writers.section("top\n", "s", "one")
    assert writers.section(once, "s", "two") == "top\n\n<!-- s:start -->\ntwo\n<!-- s:end -->\n"


EVENTS = "/root/testdata/sf0.001"


def stream(spark):
    return monitor.source(spark, EVENTS, schemas.EVENTS, glob="events.parquet")


def events(spark):
    return spark.read.parquet(f"{EVENTS}/events.parquet")


def test_windows_of_a_stream(spark, tmp_path):
    monitor.run_once(monitor.windowed(stream(spark), "ts", "value", "1 hour", None, "10 minutes", "event_type"), "tumbling", str(tmp_path / "a"))
    batch = events(spark).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("value").alias("samples"), F.max("value").alias("peak"))
    last = events(spark).agg(F.max("ts")).first()[0]
    want = {(r["w"]["start"], r["event_type"], r["samples"], r["peak"]) for r in batch.collect() if (last - r["w"]["end"]).total_seconds() >= 600}
    got = {(r["start"], r["event_type"], r["samples"], r["peak"]) for r in spark.table("tumbling").collect()}
    assert want <= got and len(got) > 0
    monitor.run_once(monitor.sessions(stream(spark), "ts", "30 minutes", "10 minutes", "user_id"), "sessions", str(tmp_path / "b"))
    assert spark.table("sessions").count() > 0


def test_state_of_a_stream(spark, tmp_path):
    monitor.run_once(monitor.best_so_far(stream(spark), "event_type", "event_id", "value"), "best", str(tmp_path / "a"))
    want = experiments.so_far(events(spark), "event_type", "event_id", "value").select("event_id", "is_best").collect()
    assert sorted(want) == sorted(spark.table("best").select("event_id", "is_best").collect())
    monitor.run_once(monitor.patience(stream(spark), "event_type", "event_id", "value", 50.0, 3), "patience", str(tmp_path / "b"))
    want = experiments.violations_in_a_row(events(spark), "event_type", "event_id", F.col("value") > 50, 3).select("event_id", "in_a_row", "stop").collect()
    assert sorted(want) == sorted(spark.table("patience").select("event_id", "in_a_row", "stop").collect())
    monitor.run_once(monitor.worsening(stream(spark), "event_type", "event_id", "value"), "worse", str(tmp_path / "c"))
    want = experiments.early_stop(events(spark).withColumn("s", F.lit(0.0)), "event_type", "event_id", "value", "s").select("event_id", "worsening").collect()
    assert sorted(want) == sorted(spark.table("worse").select("event_id", "worsening").collect())


def test_first_seen_files_and_milestones(spark, tmp_path):
    monitor.run_once(monitor.first_seen(stream(spark), "ts", "400 days", "user_id"), "seen", str(tmp_path / "a"))
    assert spark.table("seen").count() == events(spark).select("user_id").distinct().count()
    for _ in range(2):  # a second run finds nothing new
        monitor.to_files(stream(spark).select("event_id"), str(tmp_path / "out"), str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "out")).count() == events(spark).count()
    seen = []
    monitor.milestones(stream(spark), "event_id", [1, 5], lambda df, n: seen.extend(r[0] for r in df.select("event_id").collect()), str(tmp_path / "c"))
    assert sorted(seen) == sorted(r[0] for r in events(spark).where("event_id IN (1, 5)").select("event_id").collect())


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT nfkc('ﬁ') AS a, ratcliff_ratio('tide', 'diet') AS b, indel_ratio('abcd', 'abxd') AS c").first()
    assert tuple(row) == ("fi", 0.25, 75.0)
    assert [tuple(r) for r in spark.sql("SELECT * FROM tokens(' a  b ')").collect()] == [(0, "a"), (1, "b")]
    assert [list(r["frame"]) for r in spark.sql("SELECT * FROM frames(array(cast(1 as float), cast(2 as float), cast(3 as float)), 2)").collect()] == [[1.0, 2.0]]


def test_files_that_must_stay(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    before = readers.file_hashes(spark, f"{tmp_path}/*.txt").collect()
    assert {r["sha256"] for r in before} == {hashlib.sha256(x).hexdigest() for x in (b"one", b"two")}
    expected = spark.createDataFrame(before)
    (tmp_path / "b.txt").write_text("three")
    assert [r["path"].rpartition("/")[2] for r in audit.changed(readers.file_hashes(spark, f"{tmp_path}/*.txt"), expected, "path", "sha256").collect()] == ["b.txt"]


def test_config_rules():
    good = dict.fromkeys(experiments.REQUIRED, "x") | {"tuning_mode": "blockwise_encoder_lr", "decoder_learning_rate": 1e-5, "eval_steps": 10, "save_steps": 20, "encoder_block_c_lr": 1e-6, "encoder_block_d_lr": 2e-6}
    good |= {"bf16": True, "language": "uz", "task": "transcribe", "evaluate_test_after_training": False, "load_test_split": False}
    assert experiments.config_violations(good) == []
    assert experiments.config_violations(good | {"encoder_block_a_lr": 3e-6, "save_steps": 15}) == ["block_rates_fall", "save_steps_no_multiple"]
    assert experiments.config_violations(good | {"model_name": None}) == ["missing:model_name"]
    assert experiments.config_violations(good | {"load_test_split": True, "fp16": True, "tuning_mode": "all"}) == ["unknown_tuning_mode", "encoder_rate_not_positive", "precision", "test_split_used"]


def test_flattened(spark):
    df = spark.createDataFrame([({"speed": 2.0},)], "performance struct<speed: double>")
    assert tuple(readers.flattened(df, speed="performance.speed", rtf="performance.rtf").first()) == (2.0, None)
