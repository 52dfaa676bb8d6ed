from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.operators import cleansing


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_word_count_follows_unicode_whitespace(spark):
    assert values(spark, ["", "  a  b ", "a b c", None, "x\x1cy\x85z"], T.word_count) == [0, 2, 3, 0, 3]


def test_collapse_and_first_words(spark):
    assert values(spark, [" a \n b  c"], T.collapse_whitespace) == ["a b c"]
    assert values(spark, ["a b c d"], lambda c: T.first_words(c, 2)) == ["a b"]


def test_tokens_keep_accents_and_drop_single_letters(spark):
    assert values(spark, ["a bb Déjà-vu x_1 12a", ""], T.tokens) == [["bb", "déjà", "vu", "x_1", "12a"], []]


def test_numeric_terms(spark):
    assert values(spark, ["2019", "12a", "٣٤"], T.is_numeric_term) == [True, False, True]


def test_bare_words(spark):
    assert values(spark, ["The cat, sat-on  mats!"], T.bare_words) == [["the", "cat", "saton", "mats"]]


def test_split_marked(spark):
    rows = ["a{-}b{-}c", "TITLE: only", "TITLE: a\nb TEXT: c", "TITLE: t\nTEXT: x TEXT: y"]
    titles = values(spark, rows, lambda c: T.split_marked(c)[0])
    bodies = values(spark, rows, lambda c: T.split_marked(c)[1])
    assert titles == ["a", "only", "ab ", "t"]
    assert bodies == ["b{-}c", None, "c", "x {-}y"]


def test_null_marks_and_missing(spark):
    assert values(spark, ["n/a", "  ", "", "n/a x", None], T.null_if_marked) == [None, None, "", "n/a x", None]
    assert values(spark, ["", "0", " ", "None", None, "x"], T.is_missing) == [True] * 5 + [False]


def test_language_profile(spark):
    rows = ["The cat is on the mat", "le chat est sur une table", "der Hund und die Katze", "el perro y la casa", "zzz"]
    assert values(spark, rows, T.language_by_profile) == ["en", "fr", "de", "es", None]


def test_language_reads_only_opening_words(spark):
    late = "zzz " * 30 + "the and of"
    assert values(spark, [late, "zzz " * 29 + "the"], T.language_by_profile) == [None, "en"]


def test_detector_is_pluggable(spark):
    pages = spark.createDataFrame([("a", "b")], "title string, content string")
    out = cleansing.with_language(pages, lambda c: F.lit("xx")).first()
    assert (out["lang"], out["corpus_text"]) == ("xx", "a: b")


def test_day_stamp(spark):
    assert spark.range(1).select(T.day_stamp().rlike(r"^\d\d-\d\d-\d\d$")).first()[0]


def test_article_text_is_composed_before_nulls(spark):
    body = "w " * 120
    rows = [(1, "t", "n/a"), (2, None, body), (3, " ", "x")]
    out = {r["pmid"]: r for r in cleansing.article_text(spark.createDataFrame(rows, "pmid long, title string, abstract string")).collect()}
    assert out[1]["corpus_text"] == "t: n/a" and out[1]["abstract"] is None
    assert out[2]["corpus_text"] == ": " + body and out[2]["title"] == ""
    assert out[3]["title"] is None
    kept = cleansing.cleanse_articles(spark.createDataFrame(rows, "pmid long, title string, abstract string"))
    assert [r["pmid"] for r in kept.collect()] == [2]
    stages = {r["stage"]: r["n_rows"] for r in cleansing.article_stages(spark.createDataFrame(rows, "pmid long, title string, abstract string")).collect()}
    assert stages == {"articles_read": 3, "articles_without_text": 0, "articles_too_short": 2, "articles_kept": 1}


def test_page_chain_edges(spark):
    pages = spark.createDataFrame(
        [
            (1, "TITLE: a the\nTEXT: " + "the " * 97, "u1", 1),
            (2, "TITLE: a the\nTEXT: " + "the " * 95, "u2", 1),
            (3, "TITLE: \nTEXT: ", "u3", 1),
            (4, "TITLE: " + "the " * 120, "u4", 1),
            (5, "TITLE: a\nTEXT: " + "the " * 120, "u5", 2),
            (6, "TITLE: a\nTEXT: " + "zzz " * 120, "u6", 1),
        ],
        "web_id long, processed_content string, url string, pmid long",
    )
    articles = spark.createDataFrame([(1,)], "pmid long")
    kept = {r["web_id"]: r for r in cleansing.cleanse_pages(pages, articles).collect()}
    assert set(kept) == {1, 4}
    assert kept[1]["text_length"] == 101
    assert kept[4]["content_nan"] and kept[4]["content"] == "None"
    text = cleansing.page_text(pages)
    assert [r["web_id"] for r in text.where(~cleansing.has_text()).collect()] == [3]
    stages = {r["stage"]: r["n_rows"] for r in cleansing.page_stages(pages, articles).collect()}
    assert stages["pages_linked"] == 5 and stages["pages_in_language"] == 2


def test_missing_links_treats_null_as_equal(spark):
    pages = spark.createDataFrame([(1, None), (2, 7), (3, 8)], "web_id long, pmid long")
    articles = spark.createDataFrame([(None,), (7,)], "pmid long")
    assert [r["web_id"] for r in cleansing.missing_links(pages, articles).collect()] == [3]
