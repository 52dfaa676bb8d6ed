"""Language identification by Bayesian evidence fusion.

A document's languages are weighed by the product of independent pieces of evidence: the likelihood
of its text (byte trigrams, fitted on all documents with a language), the language that its markup
declares, the suffix of its address, and the prior of its host.  How much a declaration tells is
counted over the whole table; host priors are counts shrunk towards the registered domain, that
towards the suffix of the address, that towards the whole table, so a suffix counts once.  A
document's own verdict is left out of all counts it is judged by.  All of these are grouped
aggregations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.url_reputation import domain_of, host_of, suffix_of
from linkloom.runtime import materialize

BUCKETS = 1 << 16
#: Trigrams overlap, so their joint evidence counts for less than the product of them all.
TEMPER = 0.3
#: Weight of the level above, in documents, at each level of the host prior.
PRIOR_WEIGHT = 5.0
SMOOTHING = 1.0
#: A declaration is believed as if so many documents of its language had made it before.
DECLARED_TRUST = 10.0
#: More languages than this in the training column are refused, not dropped.
MAX_LANGUAGES = 256
_CHUNK = 1 << 16
LANG_ATTRIBUTE = r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})"
NOT_TEXT = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"


def trigrams(text: str | None) -> np.ndarray:
    x = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.empty(0, np.int64)
    h = (x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))) * np.uint32(0x9E3779B1)
    return ((h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
            own += np.bincount(trigrams(text), minlength=BUCKETS)
    for lang, own in held.items():
        seen = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(own[seen])], ["lang", "bucket", "n"])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and log likelihoods (bucket by language) of all documents with a language."""
    known = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang IS NOT NULL")
    languages = sorted(r.lang for r in known.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = known.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    counts = np.full((BUCKETS, len(languages)), 0.5)
    place = {name: k for k, name in enumerate(languages)}
    np.add.at(counts, (found["bucket"].to_numpy(np.int64), found["lang"].map(place).to_numpy(np.int64)), found["n"].to_numpy())
    return languages, np.log(counts / counts.sum(0)).astype(np.float32)


def text_evidence(model: np.ndarray, text: str | None) -> np.ndarray:
    """Tempered log likelihood of the whole text under each language, the best at zero."""
    codes, total = trigrams(text), np.zeros(model.shape[1])
    for k in range(0, len(codes), _CHUNK):
        total += model[codes[k : k + _CHUNK]].sum(0, dtype=np.float64)
    total *= TEMPER
    return total - total.max(initial=-np.inf) if len(total) else total


def _scorer(model: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            evidence = [text_evidence(model, t).tolist() for t in batch.column(at).to_pylist()]
            kept = [k for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in kept], pa.array(evidence, pa.list_(pa.float64()))],
                [*[batch.schema.names[k] for k in kept], "evidence"],
            )

    return score


def markup_text(html: Column) -> Column:
    return F.regexp_replace(html, NOT_TEXT, " ")


def from_pages(pages: DataFrame) -> DataFrame:
    """Input rows of ``identify`` for ``pages(page_id, url, html)``."""
    host = host_of(F.col("url"))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), LANG_ATTRIBUTE, 1))
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), markup_text(F.col("html")).alias("text"),
        F.when(declared != "", declared).alias("declared"), host.alias("host"), domain_of(host).alias("domain"), suffix_of(domain_of(host)).alias("suffix"),
    )


def from_documents(docs: DataFrame) -> DataFrame:
    """The same for ``documents``: the source stands for the host; nothing is declared."""
    none = F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("text"), none.alias("declared"),
        F.concat(F.lit("source:"), F.coalesce("source", F.lit(""))).alias("host"), F.lit("source:").alias("domain"), F.lit("source:").alias("suffix"),
    )


def _counts(size: int) -> Column:
    """How many rows have each language by their text; texts that tell nothing are not counted."""
    return F.array(*[F.count(F.when(F.col("at") == k, 1)) for k in range(size)])


def _others(counts: Column) -> Column:
    """Counts that hold the row itself, without it."""
    return F.transform(counts, lambda n, k: n - F.when(k == F.col("at"), 1).otherwise(0))


def _shrunk(counts: Column, prior: Column) -> Column:
    total = F.aggregate(_others(counts), F.lit(0).cast("long"), lambda a, n: a + n)
    return F.zip_with(_others(counts), prior, lambda n, p: (n + PRIOR_WEIGHT * p) / (total + PRIOR_WEIGHT))


def _claim(languages: list[str], declared: list[int]) -> Column:
    """Log likelihood of what the row declares under each language; zero where it declares nothing.

    ``n_said`` counts the rows that declare the same, ``declared`` those that declare anything.
    """
    trust = F.array(*[F.when(F.col("said") == name, DECLARED_TRUST).otherwise(0.0) for name in languages])
    same = F.zip_with(_others(F.col("n_said")), trust, lambda n, t: n + t + SMOOTHING)
    spread = SMOOTHING * (len(languages) + 1) + DECLARED_TRUST
    known = F.zip_with(same, _others(_longs(declared)), lambda n, all_: F.log(n / (all_ + spread)))
    return F.when(F.col("said").isNull(), F.array_repeat(F.lit(0.0), len(languages))).otherwise(known)


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(n).cast("long") for n in values])


def identify(rows: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """One row per input row: ``doc_id, page_id, lang, confidence, text_lang, declared``.

    ``rows`` comes from ``from_pages`` or ``from_documents`` or has their columns; others are left out.
    Null or empty texts give no text evidence, are judged by the rest and not counted; a null
    declaration gives none; null hosts form one host.  Repeated rows are all judged and all counted,
    each for the others.  Ties go to the first language in alphabetical order.  Without any language
    to learn from ``lang`` is null.  An empty table gives an empty result.
    """
    fields = "doc_id long, page_id long, declared string, host string, domain string, suffix string, evidence array<double>"
    scored = rows.select("doc_id", "page_id", "text", "declared", "host", "domain", "suffix").mapInArrow(_scorer(model), fields)
    if not languages:
        none = F.lit(None).cast("string")
        return scored.select("doc_id", "page_id", none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"), "declared")
    size, names = len(languages), F.array(*[F.lit(n) for n in languages])
    place = F.array_position("evidence", F.array_max("evidence")).cast("int")
    tells = F.array_max("evidence") > F.array_min("evidence")
    kind = F.when(F.col("declared").isin(languages), F.col("declared")).otherwise(F.when(F.col("declared").isNotNull(), F.lit("other")))
    items = materialize(
        scored.withColumns(
            {"best": F.element_at(names, place), "at": F.when(tells, place - 1), "said": kind, **{c: F.coalesce(c, F.lit("")) for c in ("host", "domain", "suffix")}}
        )
    )

    def level(*keys: str) -> DataFrame:
        return items.groupBy(*keys).agg(_counts(size).alias(f"n_{keys[0]}"))

    # One row per key, written before it is joined, so that Spark splits a key with many rows.
    by_suffix = materialize(level("suffix"))
    by_domain = materialize(level("domain", "suffix").join(by_suffix, "suffix"))
    by_host = materialize(level("host", "domain", "suffix").join(by_domain, ["domain", "suffix"]))
    said = F.col("said").isNotNull()
    declared = [F.count(F.when(said & (F.col("at") == k), 1)) for k in range(size)]
    sums = items.agg(_counts(size).alias("whole"), F.array(*declared).alias("declared")).first()
    told = items.where(said).groupBy("said").agg(_counts(size).alias("n_said"))  # a row per language at most, and one

    whole = _others(_longs(sums["whole"]))
    total = F.lit(sum(sums["whole"])) - F.col("at").isNotNull().cast("int")
    base = F.transform(whole, lambda n: (n + SMOOTHING) / (total + SMOOTHING * size))
    joined = items.join(by_host, ["host", "domain", "suffix"]).join(F.broadcast(told), "said", "left")
    prior = joined.withColumn("prior", base)
    for counts in ("n_suffix", "n_domain", "n_host"):
        prior = prior.withColumn("prior", _shrunk(F.col(counts), F.col("prior")))
    stated = F.zip_with("evidence", _claim(languages, sums["declared"]), lambda x, y: x + y)
    fused = prior.withColumn("log_post", F.zip_with(stated, F.col("prior"), lambda x, p: x + F.log(p))).withColumn("top", F.array_max("log_post"))
    mass = F.aggregate("log_post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return fused.select(
        "doc_id", "page_id", F.element_at(names, F.array_position("log_post", F.col("top")).cast("int")).alias("lang"),
        F.round(1 / mass, 4).alias("confidence"), F.col("best").alias("text_lang"), "declared",
    )
