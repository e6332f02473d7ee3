"""Text functions: normalizers, labels and counts as Column expressions.

Only Unicode composition (NFKC, NFC) needs Python; its Arrow UDF gets no text but those with a character that
composition may change.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabet tables of the Uzbek normalizer.
APOSTROPHES = "‘’‛ʻʼʽʾʿ`´′‚＇ˊ"
PUNCTUATION = {"，": ",", "。": ".", "؛": ";", "؟": "?", "–": "-", "—": "-", "…": "...", "«": '"', "»": '"', "“": '"', "”": '"'}
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "j", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n",
    "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "x", "ц": "s", "ч": "ch", "ш": "sh", "ъ": "'", "ь": "", "э": "e", "ю": "yu",
    "я": "ya", "ў": "o'", "қ": "q", "ғ": "g'", "ҳ": "h",
}
#: White space beyond what Java's plain \\s matches.
SPACES = "\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Fixed value: characters that a transcript may hold, as the inside of a character class.
EXPECTED = r"0-9A-Za-zА-Яа-яЁёЎўҚқҒғҲҳ\s'`ʻʼ’.,!?;:()/\"-"


def _unstable() -> str:
    """What is none of the Latin, Greek and Cyrillic letters and general punctuation that NFKC and NFC never change. Java is
    fast on a class of two ranges and some hundred times slower on one of three, so the long ones are asked first, two at a time."""
    keeps = [c for r in (range(0x80), range(0x80, 0x530), range(0x2010, 0x20D0)) for c in r if unicodedata.normalize("NFKC", chr(c)) == chr(c) and not unicodedata.combining(chr(c))]
    runs = [[keeps[0], keeps[0]]]
    for c in keeps[1:]:
        if c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    inside = lambda runs: "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs)
    long = [x for x in runs if x[1] - x[0] > 100]
    return f"(?=[^{inside(long[:2])}])(?=[^{inside(long[2:4])}])[^{inside(runs)}]"


UNSTABLE = _unstable()
#: All characters of the four tables above are among these; the tables cost more than this guard. Two ranges a class, as before.
MAPPED = r"(?=[^\t-\r -_])[^a-~\xBC-\x{2BA}]"


def _composed(form: str, text: Column) -> Column:
    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return F.coalesce(compose(F.when(text.rlike(UNSTABLE), text)), text)


def nfkc(text: Column) -> Column:
    return _composed("NFKC", text)


def nfc(text: Column) -> Column:
    return _composed("NFC", text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where lambdas inside use it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def translated(text: Column, table: dict[str, str]) -> Column:
    """Replace characters by strings: single ones in one `translate`, the others by `replace`."""
    single = {k: v for k, v in table.items() if len(v) == 1}
    drop = "".join(k for k, v in table.items() if v == "")
    text = F.translate(text, "".join(single) + drop, "".join(single.values()))
    for k, v in table.items():
        if len(v) > 1:
            text = F.replace(text, F.lit(k), F.lit(v))
    return text


def to_latin(text: Column) -> Column:
    """Cyrillic letters to Latin ones; a capital letter gives a capitalized string."""
    return translated(text, CYRILLIC | {k.upper(): v.capitalize() for k, v in CYRILLIC.items()})


def collapsed(text: Column) -> Column:
    """Runs of Unicode white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column, punctuation: bool = True, lower: bool = True, latin: bool = True, apostrophes: bool = True, marks: bool = True) -> Column:
    """The Uzbek normalizer; null gives the empty string. `punctuation` false turns all marks but ' into spaces."""

    def mapped(text: Column) -> Column:
        text = F.translate(text, SPACES, " " * len(SPACES))  # then the plain \\s covers all white space
        if apostrophes:
            text = F.translate(text, APOSTROPHES, "'" * len(APOSTROPHES))
        if marks:
            text = translated(text, PUNCTUATION)
        return to_latin(text) if latin else text

    text = nfkc(F.coalesce(text, F.lit("")))
    text = F.when(text.rlike(MAPPED), mapped(text)).otherwise(text)
    if lower:
        text = F.lower(text)
    else:
        for pair in ("sh", "ch"):
            text = F.regexp_replace(text, rf"(?iU)\b{pair}\b", pair)
    joins = F.regexp_replace(F.regexp_replace(text, r"(?iU)\bo\s*['`ʻʼ’]\s*", "o'"), r"(?iU)\bg\s*['`ʻʼ’]\s*", "g'")
    text = F.when(F.contains(text, F.lit("'")) | (F.lit(False) if apostrophes else text.rlike("[`ʻʼ’]")), joins).otherwise(text)
    if punctuation:
        text = F.regexp_replace(text, r"\s+([,.;:!?])", "$1")
        text = F.regexp_replace(text, r"([,.;:!?])([^\s])", "$1 $2")
    else:
        text = F.regexp_replace(text, r"(?U)[^\w\s']", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "''+", "'"), r" \s+|[\t-\r]\s*", " "))  # a single space stays as it is


def normalize_legacy(text: Column, lower: bool = False) -> Column:
    """The older normalizer: control characters to spaces, every apostrophe to the left single quote."""
    text = nfc(F.coalesce(text, F.lit("")))
    text = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    text = F.translate(text, "ʼ`'", "‘‘‘")
    return collapsed(F.lower(text) if lower else text)


def audit_form(text: Column) -> Column:
    """Lower-cased words joined by one space."""
    return collapsed(F.lower(F.coalesce(text, F.lit(""))))


def text_hash(text: Column) -> Column:
    return F.sha1(normalize(text))


def valid(text: Column, least: int = 2, most: int = 500) -> Column:
    return F.length(normalize_legacy(text)).between(least, most)


def words(text: Column) -> Column:
    """Words between white space; none for a blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def suspicious(text: Column) -> Column:
    return text.rlike(f"(?U)[^{EXPECTED}]")


def distinct_chars(text: Column) -> Column:
    """Different characters other than the space."""
    return F.size(F.array_distinct(F.filter(F.split(text, ""), lambda c: (c != " ") & (c != ""))))


# Signs of four other languages, in the order of the labels.
CONFUSION = {
    "turkish_like": r"(?iU)\b(ve|değil|için|çok|şimdi|olarak|gibi|kadar)\b|(?-i:[ğşİı])",
    "kazakh_like": r"(?iU)(?-i:[әіңүұқөһ])|\b(jane|bolyp|ushin|qazaq)\b",
    "russian_cyrillic": r"[А-Яа-яЁё]",
    "english_like": r"(?iU)\b(the|and|is|are|with|for|this|that|you|not)\b",
}
FOREIGN_LETTERS = "ıİöÖüÜçÇşŞğĞ" + "әіңғүұқөһӘІҢҒҮҰҚӨҺ"
KNOWN_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 '.,?!:-" + "абвгдежзийклмнопрстуфхцчшъьэюяёўқғҳўАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЪЬЭЮЯЁЎҚҒҲ"


def few_distinct(text: Column) -> Column:
    """Whether a text has at most two different characters other than the space."""
    for _ in range(2):
        text = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.left(F.replace(text, F.lit(" "), F.lit("")), F.lit(1)), F.lit(""))
    return text == ""


def confusion_labels(text: Column) -> Column:
    """Signs of other languages in a transcript, as an array."""
    return F.array_compact(F.array(*[F.when(F.coalesce(text, F.lit("")).rlike(p), F.lit(name)) for name, p in CONFUSION.items()]))


def repeated_phrase(text: Column, least: int = 8, times: int = 5) -> Column:
    """Whether some word occurs `times` times in a row, ignoring case, in a text of `least` words or more."""
    w = words(F.lower(text))
    run = F.aggregate(
        w, F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda acc, x: F.struct(x.alias("word"), F.when(x == acc["word"], acc["run"] + 1).otherwise(1).alias("run"), F.greatest(acc["best"], F.when(x == acc["word"], acc["run"] + 1).otherwise(1)).alias("best")),
        lambda acc: acc["best"],
    )
    return (F.size(w) >= least) & (run >= times)


def prediction_signs(prediction: Column, reference: Column) -> dict[str, Column]:
    """Length ratio, letters of other alphabets, unexpected characters (the first 20, sorted) and hallucination."""
    n, m = (F.greatest(F.length(F.trim(x)), F.lit(1)) for x in (prediction, reference))
    chars = F.array_distinct(F.filter(F.split(prediction, ""), lambda c: c != ""))
    letters = lambda s: F.array(*map(F.lit, dict.fromkeys(s)))
    odd = F.filter(F.array_except(chars, letters(KNOWN_LETTERS)), lambda c: ~c.rlike(r"(?U)^\s$"))
    return {
        "prediction_length": n, "reference_length": m, "length_ratio": n / m, "language_confusion": F.arrays_overlap(chars, letters(FOREIGN_LETTERS)),
        "unexpected_chars": F.slice(F.array_sort(odd), 1, 20), "hallucination": (n / m > 3.0) | repeated_phrase(prediction),
    }


def links(text: Column) -> Column:
    """Targets of Markdown links."""
    return F.regexp_extract_all(text, F.lit(r"\[[^\]]+\]\(([^)]+)\)"), F.lit(1))


def money(x: Column, digits: int = 2) -> Column:
    return F.concat(F.lit("$"), F.format_number(x, digits))
