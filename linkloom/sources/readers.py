"""Sources: id lists, article and page files, article XML, tables, stored matrices and results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from linkloom.sources import quoted, schemas

# Words that a CSV reader of data frames takes as missing.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """First column of a CSV without header, as sorted ``pmid``.

    Only the first column of the file is parsed, whatever follows it on the line.
    """
    return (
        spark.read.schema("pmid long")
        .option("header", False)
        .option("enforceSchema", True)
        .csv(path)
        .orderBy(F.col("pmid").asc_nulls_last())
    )


def _whole_files(spark: SparkSession, paths: str | Sequence[str], schema: t.StructType, sep: str) -> DataFrame:
    """One task per file; for files with lone carriage returns or comments, which ``quoted`` does not know."""
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep)
    return reader.option("mode", "PERMISSIVE").csv(paths if isinstance(paths, str) else list(paths))


def article_files(spark: SparkSession, paths: str | Sequence[str], split: bool = True) -> DataFrame:
    """All article files as one frame with lower-case names; large files are read by several tasks (``split``).

    Files that were appended to carry their header again in the middle; such rows have no numeric
    id and are dropped.
    """
    raw = (quoted.read if split else _whole_files)(spark, paths, schemas.ARTICLE_FILE, ",")
    kept = raw.where(F.col("PMID").isNotNull())
    clean = [F.when(~F.col(c).isin(*MISSING_WORDS), F.col(c)).alias(c.lower()) for c in schemas.ARTICLE_FIELDS]
    return kept.select(F.col("PMID").alias("pmid"), *clean)


def page_file(spark: SparkSession, path: str, split: bool = True) -> DataFrame:
    """First three columns of a tab-separated file; bytes that are not UTF-8 are left out."""
    raw = (quoted.read if split else _whole_files)(spark, path, schemas.PAGES, "\t")
    return raw.withColumns(
        {c: F.replace(F.col(c), F.lit("�"), F.lit("")) for c in ("processed_content", "final_url")}
    )


# Element paths of a landed article record.
_RECORD_SCHEMA = """MedlineCitation STRUCT<
  PMID: STRING,
  Article: STRUCT<
    Journal: STRUCT<JournalIssue: STRUCT<Volume: STRING, Issue: STRING, PubDate: STRUCT<Year: STRING>>, ISOAbbreviation: STRING>,
    ArticleTitle: STRING,
    Pagination: STRUCT<MedlinePgn: STRING>,
    Abstract: STRUCT<AbstractText: ARRAY<STRING>>,
    AuthorList: STRUCT<Author: ARRAY<STRUCT<LastName: STRING, Initials: STRING>>>>>,
PubmedData STRUCT<ArticleIdList: STRUCT<ArticleId: ARRAY<STRUCT<_VALUE: STRING, _IdType: STRING>>>>"""


def article_records(spark: SparkSession, path: str) -> DataFrame:
    """Landed XML records as eleven string columns; a missing value reads ``None``."""
    raw = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(_RECORD_SCHEMA).load(path)
    article = "MedlineCitation.Article"
    authors = F.transform(
        f"{article}.AuthorList.Author", lambda a: F.concat_ws(" ", a["LastName"], a["Initials"])
    )

    def other_id(kind: str):
        matching = F.filter("PubmedData.ArticleIdList.ArticleId", lambda x: x["_IdType"] == kind)
        return F.get(matching, F.lit(0))["_VALUE"]

    fields = {
        "PMID": F.col("MedlineCitation.PMID"),
        "Year": F.col(f"{article}.Journal.JournalIssue.PubDate.Year"),
        "Title": F.col(f"{article}.ArticleTitle"),
        "Abstract": F.array_join(F.col(f"{article}.Abstract.AbstractText"), " "),
        "Authors": F.array_join(authors, ", "),
        "Journal": F.col(f"{article}.Journal.ISOAbbreviation"),
        "Volume": F.col(f"{article}.Journal.JournalIssue.Volume"),
        "Issue": F.col(f"{article}.Journal.JournalIssue.Issue"),
        "Pages": F.col(f"{article}.Pagination.MedlinePgn"),
        "DOI": other_id("doi"),
        "PMC": other_id("pmc"),
    }
    return raw.select(*[F.coalesce(c.cast("string"), F.lit("None")).alias(n) for n, c in fields.items()])


def table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def jdbc_table(spark: SparkSession, name: str, options: Mapping[str, str]) -> DataFrame:
    """A database table; url, user and password come from ``options``, never from code.

    Give partitionColumn, lowerBound, upperBound and numPartitions for a parallel read.
    """
    return spark.read.format("jdbc").options(**options).option("dbtable", name).load()


def run_scripts(spark: SparkSession, scripts: str | Sequence[str]) -> list[DataFrame]:
    """One frame per statement, always as a list."""
    return [spark.sql(s) for s in ([scripts] if isinstance(scripts, str) else scripts)]


def matrix(spark: SparkSession, path: str, **wanted) -> DataFrame:
    """A stored matrix; ``wanted`` values of partition columns prune the directories that are read."""
    df = spark.read.parquet(path)
    for name, value in wanted.items():
        df = df.where(F.col(name) == value)
    return df


def results(spark: SparkSession, path: str, columns: Sequence[str] = ("tsvd", "cca_k", "median")) -> DataFrame:
    """Result rows from CSV, projected to ``columns`` and ordered by the first two."""
    df = spark.read.schema(schemas.RESULTS).option("header", True).csv(path).select(*columns)
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in columns[:2]])


def conform(df: DataFrame, schema: t.StructType) -> DataFrame:
    """Columns of ``schema`` in its order; values that do not fit a type become NULL."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def rename_all(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """New names by position, or all names in lower case."""
    return df.toDF(*(names if names is not None else [c.lower() for c in df.columns]))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
