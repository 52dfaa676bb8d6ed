"""Which tables the way from raw pages to those that stay writes, and which of them it leaves."""

from pyspark.sql import functions as F

from linkloom import runtime
from linkloom.functions import text as T
from linkloom.plans import catalog, pipeline
from tests.test_pipeline_at_size import words


def written(spark):
    return list(runtime._written.get(spark.sparkContext.applicationId, []))


def test_only_the_pages_that_stay_are_left(spark, sf):
    before = written(spark)
    pages = catalog.QUERIES["near_dup_survivor"](spark, sf)
    left = [p for p in written(spark) if p not in before]
    assert len(left) == 1 and spark.read.parquet(left[0]).columns == ["web_id", "pmid", "url"]
    assert pages.count() > 0


def test_no_text_is_written_twice(spark):
    rows = [(1, words("t1", 8), words("a1")), (2, "n/a", words("a2")), (3, words("t3", 120), "n/a"), (4, words("t4", 130), None)]
    articles = spark.createDataFrame(rows, "pmid long, title string, abstract string")
    pages = spark.createDataFrame([(i, f"TITLE: {words(f't{i}', 8)}\nTEXT: {words(f'p{i}')}", f"u{i}", i) for i in (1, 2)], "web_id long, processed_content string, url string, pmid long")
    before = written(spark)
    final = pipeline.final_corpora(articles, pages)
    tables = [spark.read.parquet(p) for p in written(spark) if p not in before]
    held = [t.where(F.col("corpus_text").isNotNull()).count() for t in tables if "corpus_text" in t.columns]
    assert held == [2]  # of the articles those that lost a marked title or abstract
    want = {i: f"{title}: {text or ''}" for i, title, text in rows}
    assert {r.pmid: r.corpus_text for r in final.articles.collect()} == want
    assert final.articles.where("pmid in (2, 3)").where("title is null or abstract is null").count() == 2
    assert final.pages.where(F.col("corpus_text") == T.compose(F.col("title"), F.col("content"))).count() == 2
