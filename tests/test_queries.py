"""Every query with an oracle gives DuckDB's rows on the small tables."""

import difflib
import math
import random

import duckdb
import pytest

import __spark_entry__ as entry
from brightloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return float(x) if hasattr(x, "quantize") else x


def in_order(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, con, name):
    got = plans.QUERIES[name](spark, SF)
    want = con.execute(plans.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert in_order(got.columns, got.collect()) == in_order(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_others_run(spark, name):
    assert plans.QUERIES[name](spark, SF).columns


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_pair_measures_against_plain_python(spark):
    tables = plans.base.Tables(spark, SF)
    rows = plans.matching.measured(tables).collect()
    assert len(rows) > 20 and any(not r["ref"].isascii() for r in rows)
    says = {(r["conv_id"], r["turn"]): r for r in plans.QUERIES["teacher_agreement"](spark, SF).collect()}
    for r in rows[:25]:
        a, b = r["ref"].split(), r["hyp"].split()
        wer, cer = edits(a, b) / len(a), edits(r["ref"], r["hyp"]) / len(r["ref"])
        sim = difflib.SequenceMatcher(None, r["ref"], r["hyp"]).ratio()
        assert (r["wer"], r["cer"], r["sim"]) == (pytest.approx(wer), pytest.approx(cer), pytest.approx(sim))
        why = [n for n, bad in (("low_teacher_similarity", sim < 0.85), ("high_teacher_wer", wer > 0.35), ("high_teacher_cer", cer > 0.15)) if bad]
        got = says[r["conv_id"], r["turn"]]
        assert got["teacher_rejection_reasons"] == "|".join(why) and (got["teacher_decision"] == "keep") == (not why)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(plans.ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_same_rows_for_any_partitioning(spark):
    names = ("hours_budget", "stratified_subset", "first_seen_dups", "weighted_sample")
    before = {n: sorted(map(tuple, plans.QUERIES[n](spark, SF).collect())) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        for n in names:
            assert sorted(map(tuple, plans.QUERIES[n](spark, SF).collect())) == before[n]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def dealt(spark, tmp_path_factory):
    """Line items whose runs lie across three files, with values that are null or no number, and the SQL's view of them on one thread."""
    folder = str(tmp_path_factory.mktemp("dealt"))
    odd = [(9_000_000, 1, None, 0.04), (9_000_001, 1, math.nan, 0.01), (9_000_001, 2, 0.01, None), (9_000_002, 1, None, None), (None, 1, 0.09, 0.06)]
    edge = [(0.04, 0.02), (0.06, 0.0), (0.02, 0.07), (0.06, 0.04), (0.05, 0.05), (0.06, 0.05), (0.0, 0.07), (0.04, 0.06), (0.09, 0.0), (0.05, 0.03)]  # means 0.047 and 0.039
    for k in range(300):
        odd += [(8_000_000 + k, i, *x) for i, x in enumerate(random.Random(k).sample(edge, len(edge)))]
    rows = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    more = spark.createDataFrame(odd, "l_orderkey long, l_linenumber int, l_discount double, l_tax double")
    rows.unionByName(more, allowMissingColumns=True).repartition(3).write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"SET threads = 1; CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["run_stability", "materially_better"])
def test_averages_are_summed_in_the_order_of_the_rows(spark, dealt, name):
    """Averages at a threshold fall on either side of it by the order of their sums: the SQL's on one thread is that of files and rows."""
    folder, con = dealt
    got = plans.QUERIES[name](spark, folder)
    want = con.execute(plans.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert in_order(got.columns, got.collect()) == in_order(columns, want.fetchall())
