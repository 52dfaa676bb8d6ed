"""Fixed schemas of all tables; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as t


def _schema(*fields: tuple[str, t.DataType]) -> t.StructType:
    return t.StructType([t.StructField(name, kind, True) for name, kind in fields])


LONG, TEXT, DOUBLE = t.LongType(), t.StringType(), t.DoubleType()
INT, BOOL = t.IntegerType(), t.BooleanType()

# Column names and order of the tables and files.
ARTICLE_FIELDS = ("Year", "Title", "Abstract", "Authors", "Journal", "Volume", "Issue", "Pages", "DOI", "PMC")

REQUESTED_IDS = _schema(("pmid", LONG))
ARTICLE_FILE = _schema(("PMID", LONG), *[(name, TEXT) for name in ARTICLE_FIELDS])
ARTICLES = _schema(
    ("pmid", LONG), *[(name.lower(), TEXT) for name in ARTICLE_FIELDS if name != "PMC"], ("pmc", DOUBLE)
)
PAGES = _schema(("processed_content", TEXT), ("final_url", TEXT), ("pmid", LONG))
PAGE_LINKS = _schema(("pmid", LONG), ("final_url", TEXT))
FINAL_ARTICLES = _schema(
    ("pmid", LONG),
    ("corpus_text", TEXT),
    ("title", TEXT),
    ("abstract", TEXT),
    ("year", TEXT),
    ("authors", TEXT),
    ("journal", TEXT),
    ("volume", TEXT),
    ("issue", TEXT),
    ("pages", TEXT),
    ("doi", TEXT),
    ("pmc", TEXT),
    ("web_id", LONG),
)
FINAL_PAGES = _schema(
    ("web_id", LONG), ("url", TEXT), ("pmid", LONG), ("title", TEXT), ("content", TEXT), ("corpus_text", TEXT)
)
FINAL_LINKS = _schema(("web_id", LONG), ("pmid", LONG), ("train_test", TEXT))
MATRIX = _schema(("side", TEXT), ("split", TEXT), ("id", LONG), ("term_id", LONG), ("weight", DOUBLE))
RANKS = _schema(("web_id", LONG), ("pmid", LONG), ("rank", LONG))
RESULTS = _schema(
    ("feature", TEXT),
    ("reduction", TEXT),
    ("min_df", INT),
    ("max_df", DOUBLE),
    ("tsvd", INT),
    ("cca", BOOL),
    ("cca_k", INT),
    ("n_links", LONG),
    ("median", DOUBLE),
    ("iqr25", DOUBLE),
    ("iqr75", DOUBLE),
    ("pct1", DOUBLE),
    ("pct50", DOUBLE),
    ("pct250", DOUBLE),
)
