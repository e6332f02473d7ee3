import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from brightloom.functions import numeric, signal, similarity, text
from brightloom.operators import telemetry


def one(spark, column, **values):
    row = {k: v for k, v in values.items()}
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()]).select(column.alias("x")).first()["x"]


# The normalizer's published examples.
@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Ўзбекистон — катта давлат.", "o'zbekiston - katta davlat."),
        ("Ғишт, Қўқон, Ҳамза", "g'isht, qo'qon, hamza"),
        ("Oʻzbekiston va g‘alaba", "o'zbekiston va g'alaba"),
        ("  Salom   dunyo !  ", "salom dunyo!"),
        ("Ш, Ч, шahar", "sh, ch, shahar"),
        (None, ""),
        ("", ""),
        ("3.5…", "3. 5. .."),
        ("ﬁx ＡＢＣ", "fix abc"),
        ("Ⅳ ①x² ｱ", "iv 1x2 ア"),
        ("e\u0301lan и\u0306", "élan y"),
    ],
)
def test_normalizer(spark, raw, want):
    assert one(spark, text.normalize(F.col("t").cast("string")), t=raw) == want


def test_stable_characters_are_not_changed_by_composition():
    runs = re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", text.UNSTABLE)
    whole = "".join(chr(c) for a, b in runs for c in range(int(a, 16), int(b, 16) + 1))
    assert len(whole) > 1000
    assert unicodedata.normalize("NFKC", whole) == whole and unicodedata.normalize("NFC", whole) == whole


def test_guards_pass_no_character_that_the_normalizer_maps(spark):
    """And they are fast: Java is some hundred times slower on a class of three ranges and more than on one of two."""
    mapped = [*text.SPACES, *text.APOSTROPHES, *text.PUNCTUATION, *text.CYRILLIC, *"".join(text.CYRILLIC).upper()]
    rows = spark.createDataFrame([(c,) for c in mapped], "t string")
    assert rows.where(~F.col("t").rlike(text.MAPPED)).count() == 0
    for guard in re.findall(r"\(\?=(\[[^]]*\])\)", text.UNSTABLE + text.MAPPED):
        assert len(re.findall(r"(?<=[^\[^])-", guard)) <= 2
    assert text.UNSTABLE.count("(?=") == 2


def test_composition_is_only_for_other_text(spark):
    assert one(spark, text.nfkc(F.col("t")), t="ﬁ２") == "fi2"
    assert one(spark, text.nfc(F.col("t")), t="e\u0301") == "é"


def test_legacy(spark):
    assert one(spark, text.normalize_legacy(F.col("t")), t=" O'zbek\x07 g`isht  ʼ ") == "O‘zbek g‘isht ‘"
    assert one(spark, text.valid(F.col("t")), t="a") is False


def test_repeats(spark):
    assert one(spark, text.repeated_phrase(F.col("t")), t="x y z " + "Ha ha HA ha ha") is True
    assert one(spark, text.repeated_phrase(F.col("t")), t="ha ha ha ha ha") is False
    assert one(spark, text.repeated_phrase(F.col("t")), t="x y z a ha ha ha ha") is False


def test_confusion_and_signs(spark):
    assert one(spark, text.confusion_labels(F.col("t")), t="The çok және jane") == ["turkish_like", "kazakh_like", "russian_cyrillic", "english_like"]
    signs = text.prediction_signs(F.col("p"), F.col("r"))
    assert one(spark, signs["unexpected_chars"], p="ab©@ñ", r="x") == ["@", "©", "ñ"]
    assert one(spark, signs["hallucination"], p="aaaaaaa", r="aa") is True


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(row[j - 1], old[j])
    return row[-1]


def test_similarities(spark):
    r = random.Random(4)
    rows = [("", ""), ("", "a b"), ("a b", ""), ("tide", "diet"), ("diet", "tide")]
    rows += [(" ".join(r.choice(["an", "bo", "ce", "dу"]) for _ in range(r.randint(0, 12))), " ".join(r.choice(["an", "bo", "ce", "dу"]) for _ in range(r.randint(1, 12)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select("a", "b", similarity.word_edits(a, b).alias("w"), similarity.char_edits(a, b).alias("c"), similarity.ratcliff("a", "b").alias("r"), similarity.indel_ratio("a", "b").alias("i"), similarity.wer(a, b).alias("wer")).collect()
    for x in got:
        u, v = x["a"].split(), x["b"].split()
        assert x["w"] == edits(u, v) and x["c"] == edits(x["a"], x["b"])
        assert 0 <= x["r"] <= 1
        n = len(x["a"]) + len(x["b"])
        assert x["i"] == pytest.approx(200 * lcs(x["a"], x["b"]) / n if n else 100)
        assert x["wer"] is None if not u else x["wer"] == pytest.approx(edits(u, v) / len(u))
    ratio = {(x["a"], x["b"]): x["r"] for x in got}
    assert (ratio["tide", "diet"], ratio["diet", "tide"], ratio["", ""], ratio["", "a b"]) == (0.25, 0.5, 1.0, 0.0)


def test_numbers(spark):
    seconds = (0.0, 0.15, 0.25, 0.35, 0.75, 30.01)
    assert [one(spark, numeric.bucket(F.col("d")), d=d) for d in seconds] == [round(d / 0.1) for d in seconds]
    assert one(spark, numeric.number(F.col("s")), s=" 2.5 ") == 2.5 and one(spark, numeric.number(F.col("s")), s="x") == 0.0
    assert one(spark, numeric.truth(F.col("s")), s=" True ") is True
    assert one(spark, numeric.bin_index(F.array(F.lit(1.0), F.lit(2.0))[0] * F.col("v"), F.array(F.lit(1.0), F.lit(2.0))), v=2.0) == 1


def test_signals(spark):
    wave = F.col("w").cast("array<float>")
    df = spark.createDataFrame([([0.5, -0.5, 0.5, -0.5, 0.0, 0.0, 0.0, 0.0, 1.0],), ([],)], "w array<double>")
    got = df.select(signal.silence_share(wave, 4).alias("s"), F.size(signal.frames(wave, 4)).alias("n"), signal.peak(wave).alias("p"), signal.chunks(wave, 4, 2).alias("c")).collect()
    assert (got[0]["s"], got[0]["n"], got[0]["p"]) == (0.5, 2, 1.0) and [len(c) for c in got[0]["c"]] == [4, 4]
    assert (got[1]["s"], got[1]["n"]) == (1.0, 0)
    joined = df.limit(1).select(signal.joined(F.array(F.slice(wave, 1, 2), F.slice(wave, 3, 1)), 2, 100).alias("j")).first()["j"]
    assert list(joined) == [0.5, -0.5, 0.0, 0.0, 0.5]


def test_recordings(spark):
    df = spark.createDataFrame([(1, i, 400.0) for i in range(11)], "g int, i int, d double")
    got = sorted(tuple(r) for r in telemetry.recordings(df, "g", "i", "d", "i", 1800.0).collect())
    assert got == [(1, 0, 5, 2000.0), (1, 1, 5, 2000.0), (1, 2, 1, 400.0)]
