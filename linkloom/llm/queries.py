"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import (
    chat,
    decontaminate,
    exact_dedup,
    hard_negatives,
    language,
    mixing,
    packing,
    quality,
    simhash,
    substring_dedup,
    token_alignment,
    token_counts,
    url_reputation,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), model)


#: Conversation -7 of the contract: a text with the control strings of common templates.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op2_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame(
        [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_conversations(turns), in_order=True).drop("expanded_tokens")


def op3_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op5_evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    rows = language.from_pages(_table(spark, sf_dir, "pages")).unionByName(language.from_documents(documents))
    return language.identify(rows, *language.fit(documents))


def op6_blockmax_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = exact_dedup.name_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return named.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = quality.resample(documents, _table(spark, sf_dir, "labels"))
    return kept.select("doc_id", "log_weight")


def op9_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("factors")


def vectors(embeddings: DataFrame) -> DataFrame:
    """Embeddings as ``hard_negatives.mine`` takes them; every seventh row has the next label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.quantized(embeddings, "vec_id", "embedding", moved)


def mine_vectors(embeddings: DataFrame) -> DataFrame:
    return hard_negatives.mine(vectors(embeddings), F.col("id") % 100 == 0)


def op11_slot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_vectors(_table(spark, sf_dir, "embeddings"))


def op12_identity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    models = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return token_alignment.align(_table(spark, sf_dir, "documents"), *models)


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_prefix_counts,
        op2_typed_parts,
        op3_simhash_pivots,
        op4_host_reputation,
        op5_evidence_fusion,
        op6_blockmax_bm25,
        op7_block_naming,
        op8_importance_resampling,
        op9_splitting_tree,
        op10_relative_lz,
        op11_slot_negatives,
        op12_identity_map,
        op13_best_fit,
    )
}

_HOST, _PATH = (
    rf"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', {k}), '')" for k in (1, 2)
)
#: Mean, and prior weight by the method of moments between 1 and 1000, of a level's units.
_LEVEL = """
    SELECT mean, CASE WHEN between_var > 0 THEN greatest(1.0, least(1000.0, mean * (1 - mean) / between_var - 1)) ELSE 1000.0 END AS w
    FROM (SELECT mean, CASE WHEN n - nn / n - (k - 1) > 0
                  THEN (s - n * mean * mean - (k - 1) * (mean * (1 - mean))) / (n - nn / n - (k - 1)) ELSE 0 END AS between_var
          FROM (SELECT count(*) AS k, sum(n) AS n, sum(n * n) AS nn, sum(bad * bad / n::DOUBLE) AS s, sum(bad) / sum(n) AS mean
                FROM {units} WHERE n > 0))
"""

ORACLES: dict[str, str] = {
    "op2_typed_parts": r"""
        WITH own AS (SELECT '\### Assistant: </turn> ok' AS text),
        turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', text FROM own UNION ALL SELECT -7, 1, 'assistant', text FROM own
        ),
        sized AS (
            SELECT *, length(regexp_replace(role, '([\\<>])', '\\\1', 'g')) + length(regexp_replace(text, '([\\<>])', '\\\1', 'g'))
                   + length('<turn >' || chr(10) || chr(10) || '</turn>' || chr(10)) AS width,
                   CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss
            FROM turns
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
               sum(length(loss))::BIGINT AS loss_chars,
               sha256(string_agg(loss, '' ORDER BY turn NULLS LAST, role, text)) AS loss_sha256,
               sum(width)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
    "op4_host_reputation": rf"""
        WITH parsed AS (
            SELECT page_id, translate({_HOST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, {_PATH} AS path FROM pages
        ),
        outcomes AS (
            SELECT doc_id AS page_id, max(CASE WHEN coalesce(toxic, 0) <> 0 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END) AS bad
            FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
        ),
        per_host AS (
            SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad FROM parsed LEFT JOIN outcomes USING (page_id) GROUP BY host
        ),
        bare AS (SELECT *, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', '') AS b FROM per_host),
        named AS (
            SELECT host, n, bad, coalesce(nullif(regexp_extract(b, '([^.]+\.(?:(?:ac|co|com|edu|gov|net|org)\.[a-z][a-z]|[^.]+))$', 1), ''), b) AS domain
            FROM bare
        ),
        hosts AS (SELECT *, regexp_replace(domain, '(?s)^[^.]*\.?', '') AS suffix FROM named),
        domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY domain, suffix),
        suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains GROUP BY suffix),
        ws AS ({_LEVEL.format(units="suffixes")}), wd AS ({_LEVEL.format(units="domains")}), wh AS ({_LEVEL.format(units="hosts")}),
        s AS (SELECT suffix, (bad + ws.w * ws.mean) / (n + ws.w) AS rate FROM suffixes, ws),
        d AS (SELECT domain, (x.bad + wd.w * s.rate) / (x.n + wd.w) AS rate FROM domains x JOIN s USING (suffix), wd),
        h AS (SELECT host, n, wh.w AS w, (x.bad + wh.w * d.rate) / (x.n + wh.w) AS rate FROM hosts x JOIN d USING (domain), wh),
        judged AS (SELECT host, CASE WHEN rate - sqrt(rate * (1 - rate) / (n + w + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS reputation FROM h),
        ruled AS (
            SELECT page_id, host, path, reputation,
                   CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
            FROM parsed JOIN judged USING (host)
        )
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE reputation END AS verdict
        FROM ruled
    """,
    "op10_relative_lz": r"""
        WITH w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
        ),
        starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
        windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM starts),
        firsts AS (SELECT k, min(doc_id) AS d FROM windows GROUP BY k),
        hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (k) WHERE d < doc_id),
        gone AS (SELECT DISTINCT doc_id, i + o AS p FROM hits, range(50) AS t(o)),
        words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op11_slot_negatives": """
        WITH base AS (
            SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ),
        scored AS (
            SELECT a.rid AS arid, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM base a, base b WHERE a.vec_id % 100 = 0
        ),
        positives AS (
            SELECT arid, anchor_id, vec_id AS positive_id, rid AS prid, score AS positive_score FROM scored WHERE same AND rid <> arid
            QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id, rid) <= 5
        ),
        inside AS (
            SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                   row_number() OVER (PARTITION BY p.arid, p.prid ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
            FROM positives p JOIN scored s ON s.arid = p.arid AND NOT s.same
            WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM inside WHERE rank <= 10
    """,
    "op7_block_naming": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept,
               sha256(norm) AS text_sha256
        FROM t WINDOW same AS (PARTITION BY norm)
    """,
}
