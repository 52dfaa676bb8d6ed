"""Every query of the catalogue: name -> (Spark job, reference SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.operators import (
    cca,
    cleansing,
    duplicates,
    evaluate,
    features,
    language,
    links,
    ordering,
    retrieval,
    scoring,
    splits,
    svd,
)
from linkloom.operators import nearduplicates as near
from linkloom.plans import experiment, grid, oracle, pipeline
from linkloom.plans import standins as S
from linkloom.runtime import materialize, pinned, scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(job: Query) -> Query:
        QUERIES[name] = job
        if sql is not None:
            ORACLES[name] = sql
        return job

    return keep


def _prepared(spark: SparkSession, sf_dir: str) -> experiment.Prepared:
    return experiment.prepare(S.corpus(spark, sf_dir), S.links(spark, sf_dir))


def _link_rank(method: str) -> Query:
    def job(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepared = _prepared(spark, sf_dir)
        return experiment.sparse_ranks(prepared, experiment.known_terms(prepared, split="Test"), method)

    return job


for _method, _suffix in (("Binary", "binary"), ("TF", "tf"), ("TF-IDF", "tfidf")):
    register(f"link_rank_{_suffix}", f"WITH {oracle.ranks(_method)} SELECT * FROM ranks")(_link_rank(_method))


@register("rank_measures", f"WITH {oracle.ranks('TF-IDF')} {oracle.measures('ranks')}")
def rank_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.flagship(S.corpus(spark, sf_dir), S.links(spark, sf_dir))


# Retrieval of articles


@register(
    "request_batches",
    """WITH i AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS batch FROM documents)
SELECT batch, list(doc_id ORDER BY doc_id) AS ids, count(*) AS n_ids FROM i GROUP BY batch""",
)
def request_batches(spark, sf_dir):
    return ordering.request_batches(S.requested_ids(spark, sf_dir), "pmid", 100)


@register(
    "retry_set",
    "SELECT doc_id AS pmid FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
)
def retry_set(spark, sf_dir):
    return retrieval.to_retry(S.requested_ids(spark, sf_dir), S.landed_ids(spark, sf_dir))


@register(
    "download_flags",
    "SELECT doc_id AS pmid, doc_id IN (SELECT doc_id FROM labels) AS downloaded FROM documents",
)
def download_flags(spark, sf_dir):
    return retrieval.flag_downloaded(S.requested_ids(spark, sf_dir), S.landed_ids(spark, sf_dir))


@register(
    "retry_append",
    """WITH missing AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT doc_id AS pmid FROM labels UNION ALL SELECT doc_id FROM missing""",
)
def retry_append(spark, sf_dir):
    landed = S.landed_ids(spark, sf_dir)
    return retrieval.append_retried(landed, retrieval.to_retry(S.requested_ids(spark, sf_dir), landed))


# Cleansing


@register("null_standardise", f"WITH {oracle.ARTICLES} SELECT pmid, title, abstract FROM pm_text")
def null_standardise(spark, sf_dir):
    return cleansing.standardise_nulls(S.raw_articles(spark, sf_dir).na.fill(""))


@register("word_count_filter", f"WITH {oracle.D} SELECT doc_id, n AS n_words FROM d WHERE n >= 100")
def word_count_filter(spark, sf_dir):
    docs = S.texts(spark, sf_dir, "documents", "doc_id", "text")
    counted = pinned(docs.select("doc_id", T.word_count(F.col("text")).alias("n_words")))
    return counted.where(F.col("n_words") >= 100)


@register("article_cleanse", f"WITH {oracle.ARTICLES} SELECT * FROM pm_clean")
def article_cleanse(spark, sf_dir):
    return cleansing.cleanse_articles(S.raw_articles(spark, sf_dir))


@register(
    "missing_text_filter",
    f"""WITH {oracle.PAGES} SELECT web_id, title_nan, content_nan FROM flagged
WHERE NOT (title_nan AND content_nan)""",
)
def missing_text_filter(spark, sf_dir):
    pages = cleansing.only_linked(S.raw_pages(spark, sf_dir), article_cleanse(spark, sf_dir))
    return pinned(cleansing.page_text(pages)).where(cleansing.has_text()).select("web_id", "title_nan", "content_nan")


@register(
    "lang_filter",
    f"""WITH {oracle.language("documents", "text", "found")}
SELECT doc_id, lang_found FROM found WHERE lang_found = 'en'""",
)
def lang_filter(spark, sf_dir):
    docs = S.texts(spark, sf_dir, "documents", "doc_id", "text")
    spoken = pinned(docs.select("doc_id", T.language_by_profile(F.col("text")).alias("lang_found")))
    return spoken.where(F.col("lang_found") == "en")


@register("lang_learned", f"WITH {oracle.learned_language('documents', 'text', 'lang')} SELECT doc_id, lang_found FROM found")
def lang_learned(spark, sf_dir):
    """Language of every document by profiles learned from the declared languages of all of them."""
    docs = S.texts(spark, sf_dir, "documents", "doc_id", "text", "lang")
    detect = language.detector(language.fit(docs))
    return docs.select("doc_id", detect(F.col("text")).alias("lang_found"))


def _clean_pages(spark, sf_dir):
    return cleansing.cleanse_pages(S.raw_pages(spark, sf_dir), article_cleanse(spark, sf_dir))


@register("web_cleanse", f"WITH {oracle.PAGES} SELECT * FROM pages_clean")
def web_cleanse(spark, sf_dir):
    return _clean_pages(spark, sf_dir)


@register(
    "stage_audit",
    f"""WITH {oracle.PAGES}
SELECT 'articles_read' AS stage, count(*) AS n_rows FROM pm_text
UNION ALL SELECT 'articles_without_text', count(*) FROM pm_text WHERE text_length = 0
UNION ALL SELECT 'articles_too_short', count(*) FROM pm_text WHERE text_length < 100
UNION ALL SELECT 'articles_kept', count(*) FROM pm_clean
UNION ALL SELECT 'pages_linked', count(*) FROM linked
UNION ALL SELECT 'pages_without_title', count(*) FROM flagged WHERE title_nan
UNION ALL SELECT 'pages_without_content', count(*) FROM flagged WHERE content_nan
UNION ALL SELECT 'pages_with_text', count(*) FROM flagged WHERE NOT (title_nan AND content_nan)
UNION ALL SELECT 'pages_long_enough', count(*) FROM flagged WHERE NOT (title_nan AND content_nan) AND text_length >= 100
UNION ALL SELECT 'pages_in_language', count(*) FROM pages_clean""",
)
def stage_audit(spark, sf_dir):
    articles, pages = S.raw_articles(spark, sf_dir), S.raw_pages(spark, sf_dir)
    return cleansing.article_stages(articles).unionByName(
        cleansing.page_stages(pages, cleansing.cleanse_articles(articles))
    )


@register(
    "pages_without_article",
    f"""WITH {oracle.PAGES} SELECT web_id, pmid FROM web_raw WHERE pmid NOT IN (SELECT pmid FROM pm_clean)""",
)
def pages_without_article(spark, sf_dir):
    pages = S.raw_pages(spark, sf_dir).select("web_id", "pmid")
    return cleansing.missing_links(pages, article_cleanse(spark, sf_dir))


@register(
    "surrogate_id",
    f"""WITH {oracle.D}, {oracle.RAW_PAGES}
SELECT row_number() OVER (ORDER BY pmid, processed_content, url) - 1 AS web_id, pmid, md5(processed_content) AS content_md5, url
FROM web_raw""",
)
def surrogate_id(spark, sf_dir):
    pages = S.raw_pages(spark, sf_dir).drop("web_id")
    order = [F.col("pmid"), F.col("processed_content"), F.col("url")]
    return ordering.with_global_index(pages, order, "web_id").select(
        "web_id", "pmid", F.md5("processed_content").alias("content_md5"), "url"
    )


# Exact duplicates


@register(
    "dup_census",
    f"""WITH {oracle.PAGES} SELECT web_id, pmid, copies FROM
(SELECT *, count(*) OVER (PARTITION BY content, pmid) AS copies FROM pages_clean) WHERE copies > 1""",
)
def dup_census(spark, sf_dir):
    pages = materialize(_clean_pages(spark, sf_dir).select("web_id", "pmid", "content"))
    return duplicates.duplicate_census(pages, ["content", "pmid"], "web_id").select("web_id", "pmid", "copies")


@register(
    "dedup_keep_first",
    f"WITH {oracle.DEDUPED} SELECT web_id, pmid, url, pmid_count, url_count FROM deduped",
)
def dedup_keep_first(spark, sf_dir):
    return _deduped(spark, sf_dir).select("web_id", "pmid", "url", "pmid_count", "url_count")


def _deduped(spark, sf_dir):
    """Pages without exact copies."""
    clean = materialize(_clean_pages(spark, sf_dir).select("web_id", "pmid", "url", "title", "content"))
    return cleansing.composed(duplicates.drop_exact_duplicates(clean))


@register(
    "dup_flag_not_first",
    """SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_repeat FROM documents""",
)
def dup_flag_not_first(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    return duplicates.flag_not_first(docs, ["text"], "doc_id").select("doc_id", "is_repeat")


@register(
    "text_keep_first",
    "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
)
def text_keep_first(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    return duplicates.keep_first(docs, ["text"], "doc_id").select("doc_id")


@register(
    "factorize_groups",
    """WITH f AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents)
SELECT doc_id, dense_rank() OVER (ORDER BY first_id) - 1 AS group_id FROM f""",
)
def factorize_groups(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return ordering.factorize(docs, "key", "doc_id", "group_id").select("doc_id", "group_id")


# Links and their reduction to one-to-one


@register("group_sizes", f"WITH {oracle.EDGES} SELECT row_id, pmid_count, url_count FROM counted")
def group_sizes(spark, sf_dir):
    return _counted(spark, sf_dir).select("row_id", "pmid_count", "url_count")


def _counted(spark, sf_dir):
    return duplicates.with_link_counts(S.edges(spark, sf_dir), "row_id")


@register(
    "cardinality_buckets",
    f"""WITH {oracle.EDGES}
SELECT CASE WHEN pmid_count = 1 THEN '1' ELSE 'n' END || ':' || CASE WHEN url_count = 1 THEN '1' ELSE 'n' END AS bucket,
  count(*) AS n_links FROM counted GROUP BY 1""",
)
def cardinality_buckets(spark, sf_dir):
    return links.bucket_counts(_counted(spark, sf_dir))


@register(
    "degree_histogram",
    f"""WITH {oracle.EDGES}, u AS (SELECT url, count(*) AS degree FROM edges GROUP BY url),
p AS (SELECT pmid, count(*) AS degree FROM edges GROUP BY pmid)
SELECT 'articles_per_url' AS direction, degree, count(*) AS n FROM u GROUP BY degree
UNION ALL SELECT 'urls_per_article', degree, count(*) FROM p GROUP BY degree""",
)
def degree_histogram(spark, sf_dir):
    return links.degree_histogram(S.edges(spark, sf_dir))


@register(
    "distinct_profile",
    f"""WITH {oracle.DEDUPED} SELECT count(DISTINCT url) AS n_urls, count(DISTINCT (corpus_text, title, content)) AS n_texts,
  count(DISTINCT pmid) AS n_pmids FROM deduped""",
)
def distinct_profile(spark, sf_dir):
    return duplicates.distinct_profile(_deduped(spark, sf_dir))


def _bucket(spark, sf_dir, pmid_many: bool, url_many: bool):
    counted = _counted(spark, sf_dir)
    p = F.col("pmid_count") > 1 if pmid_many else F.col("pmid_count") == 1
    u = F.col("url_count") > 1 if url_many else F.col("url_count") == 1
    return counted.where(p & u).select("pmid", "url", "len", "row_id")


@register("select_one_to_many", f"WITH {oracle.EDGES} {oracle.first_per_url(oracle.ONE_MANY)}")
def select_one_to_many(spark, sf_dir):
    return links.select_per_url(_bucket(spark, sf_dir, False, True))


@register("select_many_to_one", f"WITH {oracle.EDGES} {oracle.longest_per_article(oracle.MANY_ONE)}")
def select_many_to_one(spark, sf_dir):
    return links.select_per_article(_bucket(spark, sf_dir, True, False))


@register(
    "select_many_to_many",
    f"WITH RECURSIVE {oracle.EDGES}, {oracle.greedy(oracle.MANY_MANY)} SELECT * FROM matched",
)
def select_many_to_many(spark, sf_dir):
    return links.select_one_to_one(_bucket(spark, sf_dir, True, True))


@register("one_to_one_cascade", f"WITH {oracle.CASCADE}")
def one_to_one_cascade(spark, sf_dir):
    return links.one_to_one_cascade(_counted(spark, sf_dir))


# Near-duplicates


@register("near_dup_pairs", f"WITH {oracle.near_pairs('min')} SELECT * FROM pairs")
def near_dup_pairs(spark, sf_dir):
    return _rounded(near.near_duplicate_pairs(_texts_to_compare(spark, sf_dir)))


def _texts_to_compare(spark, sf_dir, *columns):
    """Written ``columns`` of the pages without exact copies; what they were made of is deleted."""
    with scratch(spark) as keep:
        return keep(materialize(_deduped(spark, sf_dir).select(*columns or ("web_id", "pmid", "corpus_text"))))


def _rounded(pairs):
    return pairs.withColumn("pct", F.round("pct", 6))


@register("near_dup_pairs_max", f"WITH {oracle.near_pairs('max')} SELECT * FROM pairs")
def near_dup_pairs_max(spark, sf_dir):
    return _rounded(near.near_duplicate_pairs(_texts_to_compare(spark, sf_dir), denominator="max"))


@register("near_dup_all_documents")
def near_dup_all_documents(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("corpus_text"))
    return _rounded(near.near_duplicate_pairs(docs, "doc_id", group=None, denominator="max"))


@register(
    "symmetric_pairs",
    f"""WITH {oracle.near_pairs('min')} SELECT gid, id_1, id_2, pct FROM pairs
UNION SELECT gid, id_2, id_1, pct FROM pairs""",
)
def symmetric_pairs(spark, sf_dir):
    return near.symmetric_pairs(near_dup_pairs(spark, sf_dir))


@register(
    "near_dup_groups",
    f"""WITH {oracle.near_pairs('min')}, f AS (
  SELECT gid, id_1, id_2, min((id_1, id_2)) OVER (PARTITION BY gid) AS first_pair FROM pairs)
SELECT gid, id_1, id_2, dense_rank() OVER (ORDER BY first_pair) - 1 AS group_id FROM f""",
)
def near_dup_groups(spark, sf_dir):
    pairs = materialize(near_dup_pairs(spark, sf_dir).select("gid", "id_1", "id_2"))
    return near.number_groups(pairs).select("gid", "id_1", "id_2", "group_id")


@register("near_dup_survivor", f"WITH {oracle.SURVIVORS} SELECT web_id, pmid, url FROM surviving")
def near_dup_survivor(spark, sf_dir):
    return _surviving(spark, sf_dir, "web_id", "pmid", "url")


def _surviving(spark, sf_dir, *columns):
    """Written ``columns`` of the pages that stay; every table on the way is deleted."""
    with scratch(spark) as keep:
        pages = cleansing.composed(_texts_to_compare(spark, sf_dir, "web_id", "pmid", "url", "title", "content"))
        found = near.near_duplicate_classes(pages)
        pairs = materialize(near.spanning_pairs(found))
        found.discard()
        return keep(materialize(near.survivors(pairs, pages).select(*columns)))


@register(
    "random_member",
    f"""WITH {oracle.near_pairs('min')}, m AS (SELECT gid, id_1 AS web_id FROM pairs UNION SELECT gid, id_2 FROM pairs)
SELECT gid, web_id FROM m QUALIFY row_number() OVER (PARTITION BY gid ORDER BY md5('42:' || web_id), web_id) = 1""",
)
def random_member(spark, sf_dir):
    return near.pick_random_member(near_dup_pairs(spark, sf_dir))


@register(
    "final_web_corpus",
    f"""WITH {oracle.SURVIVORS} SELECT web_id, url, md5(corpus_text) AS text_md5 FROM surviving
QUALIFY row_number() OVER (PARTITION BY corpus_text, title, content ORDER BY web_id) = 1""",
)
def final_web_corpus(spark, sf_dir):
    pages = cleansing.composed(_surviving(spark, sf_dir, "web_id", "url", "title", "content"))
    hashed = pinned(pages.withColumn("text_md5", F.md5("corpus_text")))  # so that no text goes through the last join
    return links.final_web_corpus(hashed).select("web_id", "url", "text_md5")


# Corpora, vocabulary, features


@register(
    "corpora_left_join",
    f"""WITH {oracle.SPLIT} SELECT id AS pmid, web_id FROM (SELECT id FROM corpus WHERE side = 'pm')
LEFT JOIN links ON pmid = id""",
)
def corpora_left_join(spark, sf_dir):
    articles = S.corpus(spark, sf_dir).where(F.col("side") == "pm").select(F.col("id").alias("pmid"))
    return links.attach_links(articles, S.links(spark, sf_dir)).select("pmid", "web_id")


@register("exact_split", f"WITH {oracle.SPLIT} SELECT * FROM tagged")
def exact_split(spark, sf_dir):
    return splits.split_links(S.links(spark, sf_dir))


@register("corpus_split", f"WITH {oracle.SPLIT} SELECT side, split, id, md5(txt) AS txt_md5 FROM split_corpus")
def corpus_split(spark, sf_dir):
    return _split(spark, sf_dir).select("side", "split", "id", F.md5("txt").alias("txt_md5"))


def _split(spark, sf_dir):
    return splits.split_corpus(S.corpus(spark, sf_dir), splits.split_links(materialize(S.links(spark, sf_dir))))


@register("corpus_lengths", f"WITH {oracle.SPLIT} SELECT side, split, count(*) AS n_docs FROM split_corpus GROUP BY ALL")
def corpus_lengths(spark, sf_dir):
    return splits.corpus_lengths(_split(spark, sf_dir))


def _terms(spark, sf_dir):
    """Document terms and corpus size without a split: enough for vocabulary questions."""
    corpus = materialize(S.corpus(spark, sf_dir))
    return features.doc_terms(corpus, keys=("side", "id")), F.lit(corpus.count())


@register("vocab_shared", f"WITH {oracle.TERMS} SELECT term_id, term, df FROM vocab")
def vocab_shared(spark, sf_dir):
    terms, n_docs = _terms(spark, sf_dir)
    return features.number_terms(features.shared_terms(terms, n_docs)).select("term_id", "term", "df")


@register(
    "vocab_thresholds",
    f"WITH {oracle.TERMS} SELECT term, df FROM vocab, nd WHERE df >= 2 AND df <= 0.85::DOUBLE * n_docs",
)
def vocab_thresholds(spark, sf_dir):
    terms, n_docs = _terms(spark, sf_dir)
    return features.shared_terms(terms, n_docs, 2, 0.85).select("term", "df")


@register(
    "vocab_exclusive",
    f"""WITH {oracle.TERMS} SELECT 'web' AS side, term, df FROM dfs WHERE pm_df = 0
UNION ALL SELECT 'pm', term, df FROM dfs WHERE web_df = 0""",
)
def vocab_exclusive(spark, sf_dir):
    terms, _ = _terms(spark, sf_dir)
    sides = [features.exclusive_terms(terms, s).withColumn("side", F.lit(s)) for s in ("web", "pm")]
    return sides[0].unionByName(sides[1]).select("side", "term", "df")


def _features(method: str) -> Query:
    def job(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepared = _prepared(spark, sf_dir)
        matrix = features.features(experiment.known_terms(prepared), method, prepared.n_docs)
        return matrix.withColumn("weight", F.round("weight", 9))

    return job


def _feature_sql(method: str) -> str:
    raw = f"""WITH {oracle.TERMS},
fw AS (SELECT side, split, id, term_id, {oracle.WEIGHTS[method]} AS w FROM tf JOIN vocab USING (term), nd)"""
    if method == "TF-IDF":
        return f"""{raw}, fn AS (SELECT side, id, sqrt(sum(w * w)) AS l FROM fw GROUP BY ALL)
SELECT side, split, id, term_id, round(w / l, 9) AS weight FROM fw JOIN fn USING (side, id)"""
    return f"{raw} SELECT side, split, id, term_id, round(w, 9) AS weight FROM fw"


for _method, _suffix in (("Binary", "binary"), ("TF", "tf"), ("TF-IDF", "tfidf")):
    register(f"features_{_suffix}", _feature_sql(_method))(_features(_method))


@register("link_scores", f"WITH {oracle.ranks('TF-IDF')} SELECT web_id, pmid, cos FROM target")
def link_scores(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    test = experiment.known_terms(prepared, split="Test")
    vectors = features.sparse_vectors(test, "TF-IDF", prepared.n_docs)
    return scoring.score_links(prepared.test_links, materialize(vectors)).select("web_id", "pmid", "cos")


@register(
    "recall_at_n",
    f"""WITH {oracle.ranks('TF-IDF')}, c AS (SELECT rank, count(*) AS n FROM ranks GROUP BY rank)
SELECT rank, n, CAST(sum(n) OVER (ORDER BY rank) AS BIGINT) AS cumulative,
  sum(n) OVER (ORDER BY rank) / (SELECT sum(n) FROM c) AS recall FROM c""",
)
def recall_at_n(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    ranks = materialize(experiment.sparse_ranks(prepared, experiment.known_terms(prepared, split="Test"), "TF-IDF"))
    return evaluate.recall_at_n(ranks)


# The whole way from raw tables


def _final(spark, sf_dir):
    return pipeline.final_corpora(S.raw_articles(spark, sf_dir), S.raw_pages(spark, sf_dir))


@register("pipeline_final_links", f"WITH {oracle.FINAL} SELECT web_id, pmid, train_test FROM tagged")
def pipeline_final_links(spark, sf_dir):
    return pipeline.tagged_links(_final(spark, sf_dir))


@register(
    "pipeline_final_articles",
    f"""WITH {oracle.FINAL} SELECT pmid, web_id, md5(corpus_text) AS text_md5 FROM pm_clean LEFT JOIN links USING (pmid)""",
)
def pipeline_final_articles(spark, sf_dir):
    return _final(spark, sf_dir).articles.select("pmid", "web_id", F.md5("corpus_text").alias("text_md5"))


@register(
    "pipeline_audit",
    f"""WITH {oracle.FINAL}
SELECT 'articles_read' AS stage, count(*) AS n_rows FROM pm_text
UNION ALL SELECT 'articles_without_text', count(*) FROM pm_text WHERE text_length = 0
UNION ALL SELECT 'articles_too_short', count(*) FROM pm_text WHERE text_length < 100
UNION ALL SELECT 'articles_kept', count(*) FROM pm_clean
UNION ALL SELECT 'pages_linked', count(*) FROM linked
UNION ALL SELECT 'pages_without_title', count(*) FROM flagged WHERE title_nan
UNION ALL SELECT 'pages_without_content', count(*) FROM flagged WHERE content_nan
UNION ALL SELECT 'pages_with_text', count(*) FROM flagged WHERE NOT (title_nan AND content_nan)
UNION ALL SELECT 'pages_long_enough', count(*) FROM flagged WHERE NOT (title_nan AND content_nan) AND text_length >= 100
UNION ALL SELECT 'pages_in_language', count(*) FROM pages_clean
UNION ALL SELECT 'pages_without_copies', count(*) FROM deduped
UNION ALL SELECT 'pages_without_near_copies', count(*) FROM surviving
UNION ALL SELECT 'links_chosen', count(*) FROM links""",
)
def pipeline_audit(spark, sf_dir):
    return _final(spark, sf_dir).audit


@register("pipeline_measures", f"WITH {oracle.FINAL_RANKS} {oracle.measures('ranks')}")
def pipeline_measures(spark, sf_dir):
    return pipeline.measures(_final(spark, sf_dir))


# Links that lack an end


def _open_edges(spark, sf_dir):
    """Edges of which every seventh length has no url and every eleventh no article."""
    whole = F.floor("len").cast("long")
    edges = S.edges(spark, sf_dir).select(
        F.when(whole % 11 != 0, F.col("pmid")).alias("pmid"), F.when(whole % 7 != 0, F.col("url")).alias("url"), "len", "row_id"
    )
    return duplicates.with_link_counts(edges, "row_id")


@register(
    "buckets_of_open_links",
    f"""WITH {oracle.OPEN_EDGES}
SELECT CASE WHEN pmid_count = 1 THEN '1' ELSE 'n' END || ':' || CASE WHEN url_count = 1 THEN '1' ELSE 'n' END AS bucket,
  count(*) AS n_links FROM counted WHERE pmid IS NOT NULL AND url IS NOT NULL GROUP BY 1""",
)
def buckets_of_open_links(spark, sf_dir):
    return links.bucket_counts(_open_edges(spark, sf_dir))


@register("cascade_of_open_links", f"WITH {oracle.OPEN_CASCADE}")
def cascade_of_open_links(spark, sf_dir):
    return links.one_to_one_cascade(_open_edges(spark, sf_dir))


# Experiments


def _threshold_results_sql() -> str:
    text = f"""WITH {oracle.TERMS},
limited AS (SELECT term, df, term_id FROM vocab, nd WHERE df >= 2 AND df <= 0.85::DOUBLE * n_docs)"""
    parts = []
    for tag, method in (("_b", "Binary"), ("_t", "TF"), ("_i", "TF-IDF")):
        text += ",\n" + oracle.rank_ctes(method, "limited", tag)
        parts.append(f"SELECT '{method}' AS feature, rank FROM ranks{tag}")
    union = " UNION ALL ".join(parts)
    return f"""{text}
SELECT *, 'Thresholds' AS reduction, 2 AS min_df, 0.85::DOUBLE AS max_df, 0 AS tsvd, FALSE AS cca, 0 AS cca_k,
  feature || '_Thresholds_2_0.85_0_false_0' AS experiment, 100000.0::DOUBLE / median * 3 AS marker_size
FROM ({oracle.measures(f"({union})", "feature")})"""


@register("experiment_results", _threshold_results_sql())
def experiment_results(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    plan = grid.experiment_grid(spark, features.METHODS, [2], [0.85], []).where(
        F.col("reduction") == grid.THRESHOLDS
    )
    return grid.results(grid.run_ranks(prepared, plan))


#: Component counts of the grid in SURVEY section 6; the last two pairs are too dear for it.
SVD_SIZES = [100, 200, 400, 600, 800, 1600]
SVD_SIZES_OF_CCA, CCA_SIZES = [100, 200, 400, 800, 1600], [50, 100, 200, 400, 800, 1600]
CCA_SKIPPED = [(1600, 800), (1600, 1600)]


@register("svd_rank_measures")
def svd_rank_measures(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    plan = grid.experiment_grid(spark, features.METHODS, [2], [0.85], SVD_SIZES).where(F.col("reduction") == grid.TSVD)
    return grid.results(grid.run_ranks(prepared, plan))


@register("cca_rank_measures")
def cca_rank_measures(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    plan = grid.experiment_grid(spark, ["TF-IDF"], [2], [1.0], SVD_SIZES_OF_CCA, CCA_SIZES)
    return grid.results(grid.run_ranks(prepared, plan, CCA_SKIPPED))


def _first_component(spark, sf_dir):
    """(side, split, id, x): TF-IDF documents on the first component, and the links they belong to."""
    prepared = _prepared(spark, sf_dir)
    matrix = features.features(experiment.known_terms(prepared), "TF-IDF", prepared.n_docs)
    model = svd.truncated_svd(matrix, 1)  # writes the matrix itself
    vectors = svd.all_documents(model, prepared.corpus, 1)
    return materialize(vectors.select("side", "split", "id", F.abs(F.col("vec")[0]).alias("x"))), prepared


@register("svd_leading_component", f"""WITH {oracle.LEADING} SELECT side, split, id, round(x, 5) AS x FROM first_axis""")
def svd_leading_component(spark, sf_dir):
    return _first_component(spark, sf_dir)[0].withColumn("x", F.round("x", 5))


@register(
    "cca_first_correlation",
    f"""WITH {oracle.LEADING}
SELECT count(*) AS n_pairs, round(abs(corr(w.x, p.x)), 6) AS correlation
FROM tagged t JOIN first_axis w ON w.side = 'web' AND w.id = t.web_id JOIN first_axis p ON p.side = 'pm' AND p.id = t.pmid
WHERE t.train_test = 'Train'""",
)
def cca_first_correlation(spark, sf_dir):
    rows, prepared = _first_component(spark, sf_dir)
    vectors = rows.select("side", "split", "id", F.array("x").alias("vec"))
    total = cca.moments(cca.training_pairs(vectors, prepared.train_links), 1)
    found = cca.solve(total, 1, 1)
    return spark.createDataFrame([(int(total[-1, -1]), round(float(found.correlations[0]), 6))], "n_pairs long, correlation double")


@register("svd_explained_variance")
def svd_explained_variance(spark, sf_dir):
    """Share of the variance that the first components of each weighting explain, by size."""
    prepared = _prepared(spark, sf_dir)
    known, found = experiment.known_terms(prepared), []
    for method in features.METHODS:
        with scratch(spark) as keep:
            matrix = materialize(features.features(known, method, prepared.n_docs))
            ratios = svd.explained_variance(svd.truncated_svd(matrix, SVD_SIZES[-1]), matrix, prepared.n_docs, SVD_SIZES[-1])
            shares = [F.sum(F.when(F.col("component") < k, F.col("ratio"))).alias(str(k)) for k in SVD_SIZES]
            row = ratios.agg(*shares).unpivot([], [str(k) for k in SVD_SIZES], "tsvd", "explained")
            found.append(keep(materialize(row.select(F.lit(method).alias("feature"), F.col("tsvd").cast("int").alias("tsvd"), "explained"))))
    return reduce(DataFrame.unionByName, found)
