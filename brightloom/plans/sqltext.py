"""The text functions once more, as DuckDB expressions; only the oracles use them."""

from __future__ import annotations

from .base import quoted

# The alphabet of the Uzbek normalizer, written out once more so that the oracles do not read the tables under test.
APOSTROPHES = "\u2018\u2019\u201b\u02bb\u02bc\u02bd\u02be\u02bf\x60\xb4\u2032\u201a\uff07\u02ca"
PUNCTUATION = dict(zip("\uff0c\u3002\u061b\u061f\u2013\u2014\u2026\xab\xbb\u201c\u201d", [",", ".", ";", "?", "-", "-", "...", '"', '"', '"', '"'], strict=True))
CYRILLIC = dict(
    zip(
        "абвгдеёжзийклмнопрстуфхцчшъьэюяўқғҳ",
        "a b v g d e yo j z i y k l m n o p r s t u f x s ch sh '  e yu ya o' q g' h".split(" "),
        strict=True,
    )
)
EXPECTED = r"0-9A-Za-zА-Яа-яЁёЎўҚқҒғҲҳ\s'`ʻʼ’.,!?;:()/\"-"


def replaced(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"


def translated(x: str, table: dict[str, str]) -> str:
    one = {k: v for k, v in table.items() if len(v) == 1}
    x = f"translate({x}, {quoted(''.join(one))}, {quoted(''.join(one.values()))})"
    for k, v in table.items():
        if len(v) != 1:
            x = f"replace({x}, {quoted(k)}, {quoted(v)})"
    return x


def collapsed(x: str) -> str:
    return f"trim({replaced(x, r'\s+', ' ')})"


def normalized(x: str, punctuation: bool = True) -> str:
    x = f"translate(coalesce({x}, ''), {quoted(APOSTROPHES)}, {quoted(chr(39) * len(APOSTROPHES))})"
    x = f"lower({translated(translated(x, PUNCTUATION), CYRILLIC | {k.upper(): v.capitalize() for k, v in CYRILLIC.items()})})"
    for letter in "og":
        x = replaced(x, rf"(?i)\b{letter}\s*['`ʻʼ’]\s*", f"{letter}'")
    if punctuation:
        x = replaced(replaced(x, r"\s+([,.;:!?])", r"\1"), r"([,.;:!?])([^\s])", r"\1 \2")
    else:
        x = replaced(x, r"[^\p{L}\p{M}\p{N}_\s']", " ")
    return collapsed(replaced(x, "'+", "'"))


def legacy(x: str) -> str:
    return collapsed(f"translate({replaced(f'coalesce({x}, {quoted("")})', r'[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ')}, 'ʼ`''', '‘‘‘')")


def stripped(x: str) -> str:
    return replaced(f"coalesce({x}, '')", r"^\s+|\s+$", "")


def suspicious(x: str) -> str:
    return f"regexp_matches({x}, {quoted(f'[^{EXPECTED}]')})"


def distinct_chars(x: str) -> str:
    return f"len(list_distinct(list_filter(string_split({x}, ''), lambda c: c <> ' ' AND c <> '')))"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '\\s+'), lambda x: x <> '')"


def rules(t: str = "text") -> list[tuple[str, str, float]]:
    """The sample rules over columns s (stripped text), n (normalized) and duration."""
    return [
        ("empty_transcript", "s = ''", 80), ("invalid_duration", "NOT isfinite(duration) OR duration <= 0", 80), ("long_utterance", "duration > 30", 10),
        ("low_chars_per_second", "duration > 0 AND length(s) / duration < 2", 30), ("high_chars_per_second", "duration > 0 AND length(s) / duration > 35", 30), ("suspicious_symbols", suspicious("n"), 15),
        ("low_character_diversity", f"{distinct_chars('s')} <= 2 AND length(s) > 10", 25),
    ]


def reasons(rules: list[tuple[str, str, float]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{name}' END" for name, c, _ in rules) + "], lambda r: r IS NOT NULL)"


def score(rules: list[tuple[str, str, float]], start: str = "100.0") -> str:
    return f"greatest(0.0, least(100.0, CAST({start} AS DOUBLE)" + "".join(f" - CASE WHEN {c} THEN {p} ELSE 0 END" for _, c, p in rules) + "))"


#: CTE after `u`: adds s, n, reasons, score and decision.
SCORED = f"""scored AS (SELECT *, CASE WHEN score < 60 THEN 'reject' WHEN score < 80 OR len(reasons) > 0 THEN 'suspicious' ELSE 'keep' END AS decision
  FROM (SELECT *, {reasons(rules())} AS reasons, {score(rules())} AS score FROM (SELECT *, {normalized("s")} AS n FROM (SELECT *, {stripped("text")} AS s FROM u))))"""


def joined(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct({x})), '|')"
