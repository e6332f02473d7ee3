"""Every operator on nulls, blank and very long texts, repeats, clashing columns and empty tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brightloom.llm import decontaminate, jaccard, mix, paragraphs, quality, shard, store, suffixes, suffixtree, toxicity, urlrank

from .conftest import prose


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(14)] + [(None, 1, 0), (3, None, None), (None, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, prose(2, 300)[:300]), (None, None), (2, ""), (3, "ab"), (3, "ab"), (4, prose(9, 40))], "item_id long, text string")


OPERATORS = {
    "quality": lambda d, labels, b: quality.score(d, quality.train(d, labels)),
    "quality_filter": lambda d, labels, b: quality.filtered(d, labels),
    "toxicity": lambda d, labels, b: toxicity.scored(d, toxicity.train(d, labels)),
    "shards": lambda d, labels, b: shard.sharded(d),
    "mix": lambda d, labels, b: mix.mixed(d),
    "mix_rows": lambda d, labels, b: mix.repeated(d),
    "jaccard": lambda d, labels, b: jaccard.joined(d),
    "jaccard_kept": lambda d, labels, b: jaccard.deduplicated(d),
    "hits": lambda d, labels, b: decontaminate.hits(d, b),
    "clean": lambda d, labels, b: decontaminate.clean(d, b),
    "suffix_tree": lambda d, labels, b: suffixtree.scored(d),
    "paragraphs": lambda d, labels, b: paragraphs.repeated(d),
    "suffixes": lambda d, labels, b: suffixes.repeated(d),
}
ROW_FOR_ROW = ("quality", "toxicity", "shards", "mix", "jaccard", "suffix_tree")


@pytest.mark.parametrize("name", OPERATORS)
def test_nasty(name, nasty, labels, benchmark):
    out = OPERATORS[name](nasty, labels, benchmark)
    rows = out.collect()
    if name in ROW_FOR_ROW:
        assert len(rows) == nasty.count()
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in nasty.select("doc_id").collect())
    if name in ("quality_filter", "mix_rows", "jaccard_kept", "clean"):
        assert out.columns == nasty.columns


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(name, empty, labels, benchmark):
    assert OPERATORS[name](empty, labels, benchmark).count() == 0


@pytest.mark.parametrize("name", ["quality", "toxicity", "hits", "clean"])
def test_empty_second_table(name, nasty, labels, benchmark):
    n = OPERATORS[name](nasty, labels.limit(0), benchmark.limit(0)).count()
    assert n == (0 if name == "hits" else nasty.count())


@pytest.mark.parametrize(("name", "kind"), [("quality", "string"), ("toxicity", "string"), ("hits", "string"), ("hits", "int"), ("hits", "decimal(20,0)"), ("suffixes", "string")])
def test_any_type_of_id(name, kind, nasty, labels, benchmark):
    named = lambda df, c: df.withColumn(c, F.concat(F.lit("d"), F.col(c)) if kind == "string" else F.col(c).cast(kind))
    out = OPERATORS[name](named(nasty, "doc_id"), named(labels, "doc_id"), named(benchmark, "item_id"))
    assert out.schema["doc_id"].dataType.simpleString() == kind
    same = OPERATORS[name](nasty, labels, benchmark)
    ids = lambda df: sorted(str(r[0]).removeprefix("d") for r in df.select("doc_id").collect())
    assert ids(out) == ids(same)


def test_training_rows_are_bounded_where_ids_repeat(spark):
    docs = spark.range(3000).select((F.col("id") % 4).alias("doc_id"), F.concat(F.lit("some words "), F.col("id") % 9).alias("text"))
    few = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, few, max_rows=2) is None or quality.train(docs, few, max_rows=2).depth
    model = toxicity.train(docs, few)
    assert model is not None and len(model.known) == 0
    shares = {round(r["p_toxic"], 2) for r in toxicity.scored(docs, model).select("p_toxic").distinct().collect()}
    assert shares == {0.5}


@pytest.mark.parametrize("rows", ["nasty", "empty"])
def test_the_pipeline_on_nasty_and_empty_tables(rows, request, spark, labels, benchmark, tmp_path):
    docs = request.getfixturevalue(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    store.cleanup(spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    kept = out.collect()
    assert out.columns[:4] == docs.columns[:4] and out.columns[-3:] == ["size", "shard", "slot"]
    assert (len(kept) > 0) == (rows == "nasty") and all(r["text"] and r["text"].strip() for r in kept)
    assert len(store.tables) == 1 and store.tables[0].endswith("/shards")
    store.cleanup(spark)


def test_quality_of_blank_texts(nasty, labels):
    rows = quality.score(nasty, None).where("trim(coalesce(text, '')) = ''").collect()
    assert rows and all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for r in rows)


def test_jaccard_of_blank_and_copied_rows(nasty):
    rows = jaccard.joined(nasty).collect()
    blank = [r for r in rows if r["doc_id"] in (1, 2)]
    assert all(r["n_links"] == 0 and r["group_id"] == r["doc_id"] for r in blank)
    copies = [r for r in rows if r["doc_id"] in (7, 8)]
    assert len(copies) == 4 and all(r["class_id"] == 7 and r["group_id"] == 7 for r in copies)
    # Four rows of the text and one with a null id are linked to each other and to the near copy.
    assert {r["n_links"] for r in copies} == {5}


def test_one_row_of_a_repeated_one_stays(nasty):
    kept = jaccard.deduplicated(nasty)
    assert kept.where("doc_id = 7").count() == 1 and kept.where("doc_id = 8 OR doc_id = 9").count() == 0
    assert kept.where("text IS NULL OR trim(text) = ''").count() == nasty.where("text IS NULL OR trim(text) = ''").count()


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "no scheme", ""), (3, "http://A.Com", None), (4, "http://a.com/x?y", "<p>"), (4, "http://a.com/x?y", "<p>"), (None, "ftp://b.net/es/1#t", "x")], "page_id long, url string, html string")
    got = sorted((str(r[0]), *r[1:]) for r in urlrank.judged(pages).collect())
    assert got == [("1", "", "", None, "allow"), ("2", "", "", None, "allow"), ("3", "a.com", "", None, "allow"), ("4", "a.com", "/x", "com/", "allow"), ("4", "a.com", "/x", "com/", "allow"), ("None", "b.net", "/es/1", "net/es/", "block")]
    assert urlrank.judged(pages.limit(0)).count() == 0


def test_pages_with_clashing_columns_and_long_html(spark):
    names = ["host", "path", "rule", "verdict", "src", "dst", "links", "_host", "score"]
    html = '<a href="https://b.org/x">' * 20_000
    pages = spark.createDataFrame([(1, "http://a.net/es/1", html), (2, "http://b.org/", None), (3, "http://c.org/", '<a href="//a.net">'), (3, "http://c.org/", '<a href="//a.net">')], "page_id long, url string, html string")
    pages = pages.select("*", *[F.lit("x").alias(n) for n in names])
    got = sorted((r["page_id"], r["host"], r["verdict"]) for r in urlrank.judged(pages).collect())
    assert got == [(1, "a.net", "block"), (2, "b.org", "allow"), (3, "c.org", "block"), (3, "c.org", "block")]


def test_tables_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        store.shared_dir(Session())


def test_arrow_settings_are_restored(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    store.cleanup(spark)
    before = spark.conf.get(key)
    store.bounded_batches(spark)
    assert int(spark.conf.get(key)) == store.BATCH_ROWS
    store.cleanup(spark)
    assert spark.conf.get(key) == before


def test_inputs_are_not_changed_by_name_clashes(nasty):
    out = shard.sharded(nasty.withColumn("shard", F.lit("old")))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_row", "size", "shard", "slot"] and out.schema["shard"].dataType.simpleString() == "int"


def test_written_tables_can_be_deleted(spark, nasty):
    path_of = store.written(nasty).inputFiles()[0].removeprefix("file://")
    assert store.tables and Path(path_of).exists()
    store.cleanup(spark)
    assert not store.tables and not Path(path_of).exists()
