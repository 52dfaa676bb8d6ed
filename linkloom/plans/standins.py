"""Pages, articles and links derived from the generic test tables.

Every view reads its tables whole.  The second half of each document plays the web page and the
first half the article it links to; the pages table adds articles without a link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.runtime import pinned

MIN_WORDS = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a text table, spread over the cores when its files give too few splits.

    A table of many files is read as it lies; only a small input is dealt out again, so that the
    word-level work on it does not run on one core.
    """
    df = table(spark, sf_dir, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", T.words(F.col("text")).alias("ws")).withColumn("n", F.size("ws"))


def _long_documents(words: DataFrame) -> DataFrame:
    return pinned(words).where(F.col("n") >= MIN_WORDS)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(side, id, txt): web pages, linked articles and unlinked articles."""
    docs = _long_documents(_document_words(spark, sf_dir))
    half = F.floor(F.col("n") / 2).cast("int")
    sides = F.array(
        F.struct(
            F.lit("web").alias("side"),
            F.array_join(F.slice("ws", half + 1, F.col("n") - half), " ").alias("txt"),
        ),
        F.struct(F.lit("pm").alias("side"), F.array_join(F.slice("ws", F.lit(1), half), " ").alias("txt")),
    )
    linked = docs.select(F.col("doc_id").alias("id"), F.inline(sides)).select("side", "id", "txt")
    return linked.unionByName(_unlinked_articles(spark, sf_dir))


def _unlinked_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace("html", "<[^>]*>", " ")
    pages = texts(spark, sf_dir, "pages", "page_id", "html").select(
        F.lit("pm").alias("side"), (F.lit(-1) - F.col("page_id")).alias("id"), plain.alias("txt")
    )
    counted = pinned(pages.withColumn("n", T.word_count(F.col("txt"))))
    return counted.where(F.col("n") >= MIN_WORDS).drop("n")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _long_documents(_document_words(spark, sf_dir).select("doc_id", "n"))
    return docs.select(F.col("doc_id").alias("web_id"), F.col("doc_id").alias("pmid"))


def requested_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pmid"))


def landed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pmid"))


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, title, abstract): one article per document; one source has unusable abstracts."""
    docs = texts(spark, sf_dir, "documents", "doc_id", "source", "text").select(
        "doc_id", "source", T.words(F.col("text")).alias("ws")
    )
    rest = F.array_join(F.slice("ws", F.lit(9), F.greatest(F.size("ws") - 8, F.lit(0))), " ")
    return docs.select(
        F.col("doc_id").alias("pmid"),
        F.array_join(F.slice("ws", 1, 8), " ").alias("title"),
        F.when(F.col("source") == "src7", F.lit("n/a")).otherwise(rest).alias("abstract"),
    )


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(web_id, processed_content, url, pmid): every document as a page with four kinds of copy.

    Kind 0 is the original; 1 an edited copy (one word inserted after a fifth of the text); 2 has
    its halves swapped; 3 the same content under another title; 4 the same title with a line added.
    """
    docs = texts(spark, sf_dir, "documents", "doc_id", "source", "n_chars", "text").select(
        "doc_id", "source", "n_chars", T.words(F.col("text")).alias("ws")
    )
    n = F.size("ws")
    fifth, half = F.floor(n / 5).cast("int"), F.floor(n / 2).cast("int")

    def part(start, length):
        return F.slice("ws", start, length)

    whole = F.col("ws")
    edited = F.concat(part(F.lit(1), fifth), F.array(F.lit("edited")), part(fifth + 1, n - fifth))
    swapped = F.concat(part(half + 1, n - half), part(F.lit(1), half))
    added = F.concat(whole, F.array(F.lit("added"), F.lit("line")))
    url0 = F.concat_ws("/", "source", F.floor(F.col("n_chars") / 100).cast("string"))

    def copy_url(kind):
        return F.concat_ws("/", "source", F.concat(F.lit("c"), kind.cast("string")), F.col("doc_id").cast("string"))

    # The kinds are numbered first and written out after, so that who asks for ids and urls only splits no text.
    kind = F.col("kind")
    body = F.when(kind == 1, edited).when(kind == 2, swapped).when(kind == 4, added).otherwise(whole)
    title_start = F.when(kind == 4, 1).otherwise(kind + 1).cast("int")
    kinds = docs.select("*", F.explode(F.array(*[F.lit(k).cast("long") for k in range(5)])).alias("kind"))
    return kinds.select(
        (F.col("doc_id") * 5 + kind).alias("web_id"),
        F.concat(
            F.lit("TITLE: "), F.array_join(F.slice("ws", title_start, 8), " "), F.lit("\nTEXT: "), F.array_join(body, " ")
        ).alias("processed_content"),
        F.when(kind == 0, url0).otherwise(copy_url(kind)).alias("url"),
        F.floor(F.col("doc_id") / 2).cast("long").alias("pmid"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, url, len, row_id): order lines as article-page links of known text length."""
    lines = table(spark, sf_dir, "lineitem")
    url = F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    key = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]
    return lines.select(
        F.col("l_orderkey").alias("pmid"),
        url.alias("url"),
        F.col("l_extendedprice").alias("len"),
        F.concat_ws(
            "-",
            F.lpad(key[0], 12, "0"),
            F.lpad(key[1], 4, "0"),
            F.lpad(key[2], 12, "0"),
            F.lpad(F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), 14, "0"),
        ).alias("row_id"),
    )
