import random

import pytest

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(["ba", "de", "ki", "lo", "mu", "ra", "ti", "so", "ne", "va"]) for _ in range(r.randint(1, 3))) for _ in range(n)]
    out = []
    for i, w in enumerate(words):
        out.append(w + ("." if i % 9 == 8 else ""))
        if i % 40 == 39:
            out[-1] += "\n"
    return " ".join(out)


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in every column, blank and very long texts, ties, copies and wholly repeated rows; extra columns with names that operators use inside."""
    base = prose(1, 120)
    texts = [None, "", "   \n\t ", "one", "two words", "Ünïcödé \x00 tab\tand\x0bmore   spaces", LONG, base, base, base.replace("ba", "bo", 1), prose(2, 300), "same " * 500, "!!! ### $$$ %%%", "|" * 3000]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), 1, "k", 5) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (50, prose(3, 80), "de", None, 3, 1, "z", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, _key string, _row long").repartition(3)


@pytest.fixture(scope="session")
def empty(nasty):
    return nasty.limit(0)
