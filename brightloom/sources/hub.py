"""A hub dataset as a Spark data source: spark.read.format("hub").option("name", ...).option("split", ...).load()."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import AUDIO_COLUMNS, SPEAKER_COLUMNS, TEXT_COLUMNS, detect

SCHEMA = "audio_path string, text string, source_metadata string, speaker_id string"


class HubReader(DataSourceReader):
    """Rows by column detection; needs the optional `datasets` library where it runs. One partition for each of `shards`."""

    def __init__(self, options: dict[str, str]):
        self.name, self.split, self.shards = options["name"], options.get("split", "train"), int(options.get("shards", "1"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.shards)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from datasets import load_dataset

        table = load_dataset(self.name, split=self.split).shard(self.shards, partition.value).data.table
        audio, text, speaker = (detect(table.column_names, names) for names in (AUDIO_COLUMNS, TEXT_COLUMNS, SPEAKER_COLUMNS))
        if not audio or not text:
            raise ValueError(f"no audio and text columns in {table.column_names}")
        for batch in table.to_batches():
            path = batch.column(audio)
            path = path.field("path") if pa.types.is_struct(path.type) else path
            who = batch.column(speaker).cast(pa.string()) if speaker else pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([path.cast(pa.string()), batch.column(text).cast(pa.string()), pa.array([self.name] * batch.num_rows), who], ["audio_path", "text", "source_metadata", "speaker_id"])


class HubSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hub"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return HubReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HubSource)
