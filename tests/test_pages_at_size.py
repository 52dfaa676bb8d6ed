from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.operators import duplicates
from linkloom.plans import standins


def test_ids_of_pages_need_no_text(spark, tmp_path):
    docs = spark.createDataFrame([(4, "some text", "src1", 9), (5, None, "src2", 0)], "doc_id long, text string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    counted = standins.raw_pages(spark, str(tmp_path)).groupBy("pmid").count()
    assert "text:string" not in counted._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in counted.collect()] == [(2, 10)]


def test_collapsed_blanks(spark):
    odd = ["", " ", "a", " a  b\t", " a  b\x1c c\x85", "a b", "a \n b", None, "\x0b"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    whole = T.collapse_whitespace(F.col("t"))
    got = rows.select(whole, F.array_join(T.words(F.col("t")), " "), T.collapsed_word_count(whole), T.word_count(F.col("t"))).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got)


def test_exact_duplicates_of_repeated_rows(spark):
    rows = [(1, 7, "u", "t", "c"), (1, 7, "u", "t", "c"), (2, 7, "v", "s", "c"), (3, 7, "u", "t", "d"), (4, None, None, "t", "d"), (5, 8, "u", None, "d")]
    pages = spark.createDataFrame(rows, "web_id long, pmid long, url string, title string, content string")
    got = duplicates.drop_exact_duplicates(pages).select("web_id", "pmid_count", "url_count").collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 3), (1, 2, 3), (4, None, None), (5, 1, 3)]
