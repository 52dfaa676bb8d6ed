"""Text cleansing of both corpora, stage by stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.operators.skew import join_on_hot_key
from linkloom.runtime import pinned

MIN_WORDS = 100


def standardise_nulls(df: DataFrame) -> DataFrame:
    """``n/a`` and blank strings become NULL in every string column."""
    return df.select(
        *[
            T.null_if_marked(F.col(name)).alias(name) if kind == "string" else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def article_text(articles: DataFrame) -> DataFrame:
    """Add ``corpus_text`` and ``text_length``.

    The text is composed before nulls are standardised, so a literal ``n/a`` stays in it.
    """
    filled = articles.na.fill("")
    composed = filled.withColumn("corpus_text", T.compose(F.col("title"), F.col("abstract")))
    return standardise_nulls(composed).withColumn("text_length", T.word_count(F.col("corpus_text")))


def cleanse_articles(articles: DataFrame, min_words: int = MIN_WORDS, audit: Audit | None = None) -> DataFrame:
    whole = pinned(article_text(articles))
    if audit:
        whole = audit.counted(whole, _article_tests(min_words))
    return whole.where(F.col("text_length") >= min_words)


class Audit:
    """Row counts of stages, taken while the rows themselves are written.

    ``counted`` puts an observation on a frame; after a job over the frame has ended ``table`` has its
    counts, without another scan.  The counts are those of one job: write the frame once.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.seen = spark, []

    def counted(self, df: DataFrame, stages: dict[str, Column]) -> DataFrame:
        watch = Observation()
        self.seen.append((watch, list(stages)))
        return df.observe(watch, *[F.count_if(test).alias(name) for name, test in stages.items()])

    def table(self) -> DataFrame:
        """``(stage, n_rows)`` in the order in which the stages were counted."""
        rows = [(name, watch.get[name]) for watch, names in self.seen for name in names]
        return self.spark.createDataFrame(rows, "stage string, n_rows long")


def _article_tests(min_words: int) -> dict[str, Column]:
    length = F.col("text_length")
    return {
        "articles_read": F.lit(True),
        "articles_without_text": length == 0,
        "articles_too_short": length < min_words,
        "articles_kept": length >= min_words,
    }


def article_stages(articles: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Audit counts of the article stages, one row per stage, from one scan."""
    return _audit(article_text(articles), _article_tests(min_words))


def only_linked(pages: DataFrame, articles: DataFrame) -> DataFrame:
    """Pages whose article survived.

    A page without an article id would only match an article without one, and article ids are
    never NULL, so a plain semi-join is the null-safe answer here.
    """
    known = articles.select("pmid").distinct()
    return join_on_hot_key(pages, known, "pmid", F.col("web_id"), "left_semi")


def missing_links(pages: DataFrame, articles: DataFrame) -> DataFrame:
    """Pages whose article is not there; NULL ids count as equal, unlike in SQL ``=``."""
    known = articles.select(F.col("pmid").alias("_pmid")).distinct()
    return pages.join(known, F.col("pmid").eqNullSafe(F.col("_pmid")), "left_anti")


def page_text(pages: DataFrame) -> DataFrame:
    """Split marked page text into title and content and flag missing parts.

    A missing part reads ``None`` in the composed text, as a string.
    """
    title, content = T.split_marked(F.col("processed_content"))
    split = pages.withColumns(
        {
            "processed_content": T.collapse_whitespace(F.col("processed_content")),
            "title": F.coalesce(F.trim(title), F.lit("None")),
            "content": F.coalesce(F.trim(content), F.lit("None")),
        }
    )
    return split.withColumns(
        {
            "title_nan": T.is_missing(F.col("title")),
            "content_nan": T.is_missing(F.col("content")),
            "text_length": T.collapsed_word_count(F.col("processed_content")),
        }
    )


def has_text() -> Column:
    return ~(F.col("title_nan") & F.col("content_nan"))


def composed(pages: DataFrame) -> DataFrame:
    """Add ``corpus_text``, which tables need not hold beside the title and content it consists of."""
    return pages.withColumn("corpus_text", T.compose(F.col("title"), F.col("content")))


def with_language(pages: DataFrame, detector: T.Detector = T.language_by_profile) -> DataFrame:
    """Add ``corpus_text`` and ``lang``.  ``detector`` maps a text column to a language column."""
    return composed(pages).withColumn("lang", detector(F.col("corpus_text")))


def cleanse_pages(
    pages: DataFrame,
    articles: DataFrame,
    min_words: int = MIN_WORDS,
    language: str = "en",
    detector: T.Detector = T.language_by_profile,
    audit: Audit | None = None,
) -> DataFrame:
    """Linked, long enough pages in one language, with title, content and composed text."""
    linked = pinned(page_text(only_linked(pages, articles)))
    if audit:
        linked = audit.counted(linked, _page_tests(min_words))
    kept = linked.where(has_text() & (F.col("text_length") >= min_words))
    spoken = pinned(with_language(kept, detector)).where(F.col("lang") == language)
    if audit:
        spoken = audit.counted(spoken, {"pages_in_language": F.lit(True)})
    return (
        spoken
        .select(
            "web_id",
            "processed_content",
            "url",
            "pmid",
            "title",
            "content",
            "title_nan",
            "content_nan",
            "text_length",
            "corpus_text",
        )
    )


def _page_tests(min_words: int) -> dict[str, Column]:
    return {
        "pages_linked": F.lit(True),
        "pages_without_title": F.col("title_nan"),
        "pages_without_content": F.col("content_nan"),
        "pages_with_text": has_text(),
        "pages_long_enough": has_text() & (F.col("text_length") >= min_words),
    }


def page_stages(
    pages: DataFrame, articles: DataFrame, min_words: int = MIN_WORDS, language: str = "en"
) -> DataFrame:
    """Audit counts after each page stage, from one pass over the linked pages."""
    tagged = with_language(page_text(only_linked(pages, articles)))
    long_enough = has_text() & (F.col("text_length") >= min_words)
    return _audit(tagged, _page_tests(min_words) | {"pages_in_language": long_enough & (F.col("lang") == language)})


def _audit(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    counts = df.agg(*[F.count_if(test).alias(name) for name, test in stages.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("stage"), F.col(n).alias("n_rows")) for n in stages])
    return counts.select(F.inline(pairs))
