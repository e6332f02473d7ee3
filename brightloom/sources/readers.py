"""Scans: manifests in several formats, column detection, sidecar texts, archives, result files.

Paths are Hadoop paths throughout; files are listed and read by Spark, never by the driver's file system.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names under which manifests hold the columns, in order of preference.
TEXT_COLUMNS = ("text", "transcript", "sentence", "transcription")
AUDIO_COLUMNS = ("audio", "audio_path", "audio_filepath", "path", "file", "file_path", "filepath", "filename", "wav", "flac", "mp3")
SPEAKER_COLUMNS = ("speaker", "speaker_id", "speakerid", "client_id", "clientid", "utt_spk")
SPLITS = {"train": "train", "training": "train", "dev": "val", "val": "val", "valid": "val", "validation": "val", "test": "test", "testing": "test"}
SUFFIXES = ("csv", "tsv", "json", "jsonl", "parquet")
SIDECARS = (".txt", ".lab", ".trans.txt", ".normalized.txt")


def detect(columns: Iterable[str], candidates: Iterable[str]) -> str | None:
    """The column that equals a candidate (in the candidates' order), else the first that contains one; case is ignored."""
    columns, candidates = list(columns), list(candidates)
    by_name = {c.lower(): c for c in columns}
    exact = next((by_name[c] for c in candidates if c in by_name), None)
    return exact or next((c for c in columns if any(x in c.lower() for x in candidates)), None)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, kind: str | None = None) -> DataFrame:
    """A CSV, TSV, JSON (array or lines) or Parquet table, by suffix; text formats without a schema give strings."""
    kind = kind or path.rstrip("/").rpartition(".")[2].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("csv", "tsv"):
        return reader.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("multiLine", True).option("escape", '"').option("mode", "FAILFAST" if schema else "PERMISSIVE").csv(path)
    if kind == "json":
        return reader.option("multiLine", True).json(path)
    return reader.json(path) if kind == "jsonl" else reader.parquet(path)


def named(spark: SparkSession, dataset: str, folder: str) -> str:
    """The path itself if there is one, else the CSV of that name in the folder; raises if there is neither."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in (dataset, f"{folder.rstrip('/')}/{dataset}.csv"):
        at = hadoop(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return path
    raise FileNotFoundError(f"no dataset {dataset}, neither by path nor in {folder}")


def shards(spark: SparkSession, root: str, split: str) -> DataFrame:
    """data/{split}-*.parquet under the root; Spark raises if there are none."""
    return spark.read.parquet(f"{root.rstrip('/')}/data/{split}-*.parquet")


def files(spark: SparkSession, root: str, suffix: str = "*") -> DataFrame:
    """(path, length, modified) of all files under the root with the suffix; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(root)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def file_hashes(spark: SparkSession, glob: str) -> DataFrame:
    """(path, sha256) of each file."""
    return spark.read.format("binaryFile").load(glob).select("path", F.sha2("content", 256).alias("sha256"))


def profile(spark: SparkSession, root: str) -> DataFrame:
    """(extension, files, bytes), most files first."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files(spark, root).groupBy(ext.alias("extension")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).orderBy(F.desc("files"), "extension")


def detected(df: DataFrame, source: str) -> DataFrame | None:
    """(audio_path, text, source_metadata, speaker_id) by detected columns; None if there is no audio or text column."""
    audio, text, speaker = (detect(df.columns, names) for names in (AUDIO_COLUMNS, TEXT_COLUMNS, SPEAKER_COLUMNS))
    if not audio or not text:
        return None
    who = F.col(f"`{speaker}`").cast("string") if speaker else F.lit(None).cast("string")
    return df.select(F.col(f"`{audio}`").alias("audio_path"), F.col(f"`{text}`").alias("text"), F.lit(source).alias("source_metadata"), who.alias("speaker_id"))


def manifests(spark: SparkSession, root: str) -> DataFrame | None:
    """The union of all metadata files under the root, sorted by path; those that are empty or without the columns are skipped."""
    out = None
    for suffix in SUFFIXES:
        paths = sorted(r[0] for r in files(spark, root, suffix).select("path").collect())  # metadata files: a few names
        for path in paths:
            frame = read_table(spark, path)
            part = None if frame.isEmpty() else detected(frame, path)
            if part is not None:
                out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def canonical_split(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in SPLITS.items():
        out = F.when(F.lower(name) == k, v).otherwise(out)
    return out


def split_of_path(path: Column) -> Column:
    """The first part of a path that names a split."""
    return F.get(F.filter(F.transform(F.split(path, "/"), canonical_split), lambda x: x.isNotNull()), F.lit(0))


def speaker_of_stem(stem: Column) -> Column:
    """What stands before `_data_`, else before the first underscore."""
    return F.when(F.instr(stem, "_data_") > 0, F.substring_index(stem, "_data_", 1)).otherwise(F.substring_index(stem, "_", 1))


def sidecars(spark: SparkSession, root: str, audio_suffixes: tuple[str, ...] = ("wav", "flac", "mp3", "m4a", "ogg", "opus", "aac")) -> DataFrame:
    """Audio files with the transcript beside them, by order of SIDECARS; audio without one is left out."""
    found = files(spark, root)
    audio = found.where(F.lower(F.substring_index("path", ".", -1)).isin(*audio_suffixes)).select(F.col("path").alias("audio_path"), F.regexp_replace("path", r"\.[^./]+$", "").alias("stem"))
    texts = spark.read.option("recursiveFileLookup", True).option("wholetext", True).option("pathGlobFilter", "*.{txt,lab}").text(root).select(F.col("_metadata.file_path").alias("p"), F.trim("value").alias("t"))
    rank, stem = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, suffix in enumerate(SIDECARS):  # longer suffixes later, so that .trans.txt is not taken for .txt
        rank, stem = F.when(F.col("p").endswith(suffix), i).otherwise(rank), F.when(F.col("p").endswith(suffix), F.expr(f"left(p, length(p) - {len(suffix)})")).otherwise(stem)
    plain = F.regexp_replace("stem", r"^file:/+", "/")
    best = texts.select(stem.alias("stem"), rank.alias("rank"), "t").withColumn("stem", plain).groupBy("stem").agg(F.min_by("t", "rank").alias("text")).where("text <> ''")
    name = F.substring_index("stem", "/", -1)
    return audio.withColumn("stem", plain).join(best, "stem").select("audio_path", "text", speaker_of_stem(name).alias("speaker_id"), split_of_path(F.col("stem")).alias("split"), F.lit("sidecar").alias("source_metadata"))


def flexible(spark: SparkSession, root: str) -> DataFrame:
    """Manifests under the root, else audio with sidecars, else an error."""
    found = manifests(spark, root)
    if found is None or found.isEmpty():
        found = sidecars(spark, root)
    if found.isEmpty():
        raise ValueError(f"no metadata with audio and text columns, and no audio with transcripts, under {root}")
    return found


def resolved(df: DataFrame, listing: DataFrame, base: str, root: str, path: str = "audio_path") -> DataFrame:
    """Adds resolved_path: absolute paths as they are, else the file under base, under root, or of that name anywhere (the first by path)."""
    plain = F.regexp_replace("path", r"^file:/+", "/")
    known = listing.select(plain.alias("_p"))
    names = known.groupBy(F.substring_index("_p", "/", -1).alias("_name")).agg(F.min("_p").alias("_any"))
    p = F.col(path)
    df = df.withColumns({"_a": F.concat(F.lit(base.rstrip("/") + "/"), p), "_b": F.concat(F.lit(root.rstrip("/") + "/"), p), "_n": F.substring_index(p, "/", -1)})
    df = df.join(known.withColumnRenamed("_p", "_pa"), F.col("_a") == F.col("_pa"), "left").join(known.withColumnRenamed("_p", "_pb"), F.col("_b") == F.col("_pb"), "left").join(names, F.col("_n") == F.col("_name"), "left")
    best = F.when(p.startswith("/"), p).otherwise(F.coalesce("_pa", "_pb", "_any", "_a"))
    return df.withColumn("resolved_path", best).drop("_a", "_b", "_n", "_pa", "_pb", "_name", "_any")


def aliases(df: DataFrame, **names: tuple[str, ...]) -> DataFrame:
    """Each new column is the first non-blank of its aliases that the table has."""
    pick = {new: F.coalesce(*[F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in old if c in df.columns], F.lit(None).cast("string")) for new, old in names.items()}
    return df.withColumns(pick)


def concatenated(spark: SparkSession, paths: list[str], least: float = 1.0) -> DataFrame:
    """Several manifests with source_csv, the file that a row comes from; rows under `least` seconds are left out."""
    out = None
    for path in paths:
        part = read_table(spark, path).withColumn("source_csv", F.lit(path))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.where(F.col("duration").try_cast("double") >= least)


def zipped_tables(spark: SparkSession, glob: str, member: str) -> DataFrame:
    """(path, line) of the named text member of each zip archive; unsafe member names are refused."""
    archives = spark.read.format("binaryFile").load(glob).select("path", "content")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.startswith(("/", "\\")) or ".." in name.replace("\\", "/").split("/"):
                            raise ValueError(f"unsafe member {name} in {path}")
                        if name.rpartition("/")[2] == member:
                            text = z.read(name).decode("utf-8-sig").splitlines()
                            yield pd.DataFrame({"path": path, "number": range(len(text)), "line": text})

    return archives.mapInPandas(lines, "path string, number long, line string")


def results(spark: SparkSession, glob: str) -> DataFrame:
    """Result JSON files with a truthy speed; unreadable ones are dropped."""
    found = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(glob)
    speed = F.col("performance.speed") if "performance" in found.columns else F.lit(None).cast("double")
    return found.withColumn("source", F.col("_metadata.file_path")).where(F.coalesce(speed.cast("double"), F.lit(0.0)) != 0)


def flattened(df: DataFrame, **paths: str) -> DataFrame:
    """One column for each nested field that the table has; null for the others."""

    def there(path: str) -> bool:
        kind = df.schema
        for part in path.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return False
            kind = kind[part].dataType
        return True

    return df.select(*[(F.col(p) if there(p) else F.lit(None).cast("string")).alias(name) for name, p in paths.items()])


def experiments(spark: SparkSession, glob: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(glob)


def samples(df: DataFrame) -> DataFrame:
    """Evaluation samples: the text column that is there, segments split at pipes, a missing duration as 0."""
    text = detect(df.columns, ("text", "transcript", "sentence"))
    segments = F.filter(F.split(F.coalesce("segments", F.lit("")), r"\|"), lambda s: s != "") if "segments" in df.columns else F.array().cast("array<string>")
    duration = F.coalesce(F.col("duration").try_cast("double"), F.lit(0.0)) if "duration" in df.columns else F.lit(0.0)
    return df.withColumns({"reference": F.coalesce(F.col(f"`{text}`"), F.lit("")) if text else F.lit(""), "segments": segments, "duration": duration})


def wave_header(spark: SparkSession, glob: str) -> DataFrame:
    """(path, rate, channels, seconds, error) of WAV files, from their headers."""
    found = spark.read.format("binaryFile").load(glob).select("path", "content")

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import wave

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        rows.append((path, w.getframerate(), w.getnchannels(), w.getnframes() / w.getframerate(), None))
                except (wave.Error, EOFError) as error:
                    rows.append((path, None, None, None, repr(error)))
            yield pd.DataFrame(rows, columns=["path", "rate", "channels", "seconds", "error"])

    return found.mapInPandas(probe, "path string, rate int, channels int, seconds double, error string")


def with_config(base: dict, *layers: dict) -> dict:
    """Configurations over each other, nested ones merged; the last wins."""
    out = dict(base)
    for layer in layers:
        for k, v in layer.items():
            out[k] = with_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def override(text: str) -> tuple[str, str]:
    """KEY=VALUE."""
    key, sign, value = text.partition("=")
    if not sign or not key:
        raise ValueError(f"not KEY=VALUE: {text}")
    return key, value
