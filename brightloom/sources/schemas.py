"""Table contracts, declared once."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "l": T.LongType(), "i": T.IntegerType(), "b": T.BooleanType(), "t": T.TimestampType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (f.split(":") for f in spec.split())])


CANONICAL = _struct("audio_path:s text:s duration:d speaker_id:s split:s source_metadata:s dataset_id:s tier:s trust_weight:d")
MASTER = _struct("audio_path:s transcript:s dataset_name:s duration_sec:d speaker_id:s split:s quality_score:d")
TRAINING = _struct("audio_path:s text:s duration:d speaker_id:s split:s source_metadata:s")
WEIGHTED = _struct("audio_path:s text:s duration:d speaker_id:s split:s source_metadata:s dataset_id:s tier:s trust_weight:d quality_score:d sampling_weight:d")
TELEMETRY = _struct("timestamp:t gpu_util_percent:d vram_used_mib:d vram_total_mib:d power_w:d temp_c:d")
VALIDATION = _struct("timestamp_utc:t step:i epoch:d val_loss:d val_wer:d val_cer:d is_best:b")
ARCHIVE = _struct("audio:s text_latin:s text_cyrillic:s duration:d words_count:l")
CURVE = T.ArrayType(_struct("step:i eval_loss:d eval_wer:d eval_cer:d eval_hallucination_rate:d eval_language_confusion_rate:d"))
EXPERIMENT = T.StructType([
    *_struct("experiment_id:s experiment_name:s status:s return_code:i started_at_utc:t runtime_seconds:d tuning_mode:s encoder_learning_rate:d decoder_learning_rate:d dataset:s stable:b safety_warning_count:i").fields,
    T.StructField("stability_failures", T.ArrayType(T.StringType())), T.StructField("train_loss_curve", T.ArrayType(_struct("step:i loss:d"))), T.StructField("validation_curve", CURVE),
])
EVENTS = _struct("event_id:l ts:t user_id:l event_type:s value:d props:s")
