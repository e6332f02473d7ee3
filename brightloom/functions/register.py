"""SQL names for what needs Python, and table functions: after `register(spark)` they work in spark.sql."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .similarity import common_subsequence


class Tokens:
    """tokens(text): one row (place, token) for each word between white space."""

    def eval(self, text: str):
        for i, w in enumerate(re.split(r"\s+", (text or "").strip())):
            if w:
                yield i, w


class Frames:
    """frames(samples, n): one row (place, frame) for each whole frame of n samples."""

    def eval(self, samples, n: int):
        for i in range(len(samples or []) // n):
            yield i, list(samples[i * n : (i + 1) * n])


def register(spark: SparkSession) -> None:
    def composed(form: str):
        return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else unicodedata.normalize(form, x)), "string")

    def ratcliff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([1.0 if not x and not y else 0.0 if not x or not y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype="float64")

    def indel(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([200.0 * common_subsequence(x, y) / (len(x) + len(y)) if x or y else 100.0 for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype="float64")

    spark.udf.register("nfkc", composed("NFKC"))
    spark.udf.register("nfc", composed("NFC"))
    spark.udf.register("ratcliff_ratio", F.pandas_udf(ratcliff, "double"))
    spark.udf.register("indel_ratio", F.pandas_udf(indel, "double"))
    spark.udtf.register("tokens", F.udtf(Tokens, returnType="place int, token string"))
    spark.udtf.register("frames", F.udtf(Frames, returnType="place int, frame array<float>"))
