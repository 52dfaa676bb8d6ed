"""Reference SQL for the catalogue: plain statements over the same tables, written independently."""

from __future__ import annotations

# Fixed values, written out here so that a mistake in the library's own patterns shows.
_SPACE = r"[\s\p{Z}\x0B\x1C-\x1F\x85]+"
_PUNCTUATION = r"[^\p{L}\p{N}_\s\p{Z}\x0B\x1C-\x1F\x85]"
_TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_]+"
_WORD_RUN = r"[\p{L}\p{N}_]+"
_FREQUENT = {
    "en": "the and of to in is that it for was with as are on be at by this or",
    "fr": "le la les des et un une que qui pour par du est dans en de elle",
    "de": "der die das und ist nicht ein eine mit auf für von den zu es sie auch",
    "es": "el los las y una por con para se del al como lo su que de la en es un",
}


def ws(x: str) -> str:
    """Words of ``x``."""
    return f"list_filter(regexp_split_to_array({x}, '{_SPACE}'), lambda w: w <> '')"


def wc(x: str) -> str:
    return f"coalesce(len({ws(x)}), 0)"


D = f"d AS (SELECT doc_id, source, n_chars, lang, {ws('text')} AS ws, len({ws('text')}) AS n FROM documents)"

CORPUS = f"""{D},
corpus AS (
  SELECT 'web' AS side, doc_id AS id, array_to_string(ws[n // 2 + 1:], ' ') AS txt FROM d WHERE n >= 100
  UNION ALL
  SELECT 'pm', doc_id, array_to_string(ws[1:n // 2], ' ') FROM d WHERE n >= 100
  UNION ALL
  SELECT 'pm', -1 - page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') FROM pages
  WHERE {wc("regexp_replace(html, '<[^>]*>', ' ', 'g')")} >= 100
),
links AS (SELECT doc_id AS web_id, doc_id AS pmid FROM d WHERE n >= 100)"""

_SPLIT = """tagged AS (
  SELECT web_id, pmid,
    CASE WHEN row_number() OVER (ORDER BY md5('42:' || web_id || ':' || pmid), web_id, pmid)
              <= round_even(0.7::DOUBLE * count(*) OVER (), 0) THEN 'Train' ELSE 'Test' END AS train_test
  FROM links
),
split_corpus AS (
  SELECT side, id, txt,
    CASE WHEN (side = 'web' AND id IN (SELECT web_id FROM tagged WHERE train_test = 'Train'))
           OR (side = 'pm' AND id IN (SELECT pmid FROM tagged WHERE train_test = 'Train'))
         THEN 'Train' ELSE 'Test' END AS split
  FROM corpus
)"""

SPLIT = f"{CORPUS},\n{_SPLIT}"

_TERMS = f"""toks AS (SELECT side, split, id, unnest(regexp_extract_all(lower(txt), '{_TOKEN}')) AS term FROM split_corpus),
tf AS (SELECT side, split, id, term, count(*) AS tf FROM toks GROUP BY ALL),
dfs AS (
  SELECT term, count(*) FILTER (side = 'web') AS web_df, count(*) FILTER (side = 'pm') AS pm_df, count(*) AS df
  FROM tf GROUP BY term
),
nd AS (SELECT count(*) AS n_docs FROM corpus),
vocab AS (
  SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS term_id FROM dfs
  WHERE web_df > 0 AND pm_df > 0 AND NOT regexp_full_match(term, '\\p{{Nd}}+')
)"""

TERMS = f"{SPLIT},\n{_TERMS}"

WEIGHTS = {
    "Binary": "1.0::DOUBLE",
    "TF": "tf::DOUBLE",
    "TF-IDF": "tf * (ln((1.0::DOUBLE + n_docs) / (1.0::DOUBLE + df)) + 1.0::DOUBLE)",
}


def ranks(method: str, vocab: str = "vocab") -> str:
    """CTEs up to ``ranks(web_id, pmid, cos, rank)`` for the test links among the test articles."""
    return f"""{TERMS},
{rank_ctes(method, vocab)}"""


def rank_ctes(method: str, vocab: str = "vocab", tag: str = "") -> str:
    return f"""w{tag} AS (
  SELECT side, id, term, {WEIGHTS[method]} AS w FROM tf JOIN {vocab} USING (term), nd WHERE split = 'Test'
),
norm{tag} AS (SELECT side, id, sqrt(sum(w * w)) AS l FROM w{tag} GROUP BY ALL),
unit{tag} AS (SELECT side, id, term, w / l AS w FROM w{tag} JOIN norm{tag} USING (side, id)),
cosines{tag} AS (
  SELECT a.id AS web_id, b.id AS pmid, round(sum(a.w * b.w), 9) AS cos
  FROM unit{tag} a JOIN unit{tag} b USING (term) WHERE a.side = 'web' AND b.side = 'pm' GROUP BY ALL
),
target{tag} AS (
  SELECT t.web_id, t.pmid, coalesce(c.cos, 0) AS cos FROM tagged t LEFT JOIN cosines{tag} c USING (web_id, pmid)
  WHERE train_test = 'Test'
),
ranks{tag} AS (
  SELECT t.web_id, t.pmid, t.cos, 1 + count(c.cos) AS rank
  FROM target{tag} t LEFT JOIN cosines{tag} c ON c.web_id = t.web_id AND c.cos > t.cos GROUP BY ALL
)"""


def measures(source: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT {lead}count(*) AS n_links, quantile_cont(rank, 0.5) AS median,
  quantile_cont(rank, 0.25) AS iqr25, quantile_cont(rank, 0.75) AS iqr75,
  round(100.0::DOUBLE * count(*) FILTER (rank <= 1) / count(*), 6) AS pct1,
  round(100.0::DOUBLE * count(*) FILTER (rank <= 50) / count(*), 6) AS pct50,
  round(100.0::DOUBLE * count(*) FILTER (rank <= 250) / count(*), 6) AS pct250
FROM {source}{group}"""


def _leading(rounds: int) -> str:
    """CTEs up to ``first_axis(side, split, id, x)``: TF-IDF documents on the leading right singular vector.

    Found by power iteration, so without any decomposition; documents without a term get 0.
    """
    steps = [
        "wa AS (SELECT side, id, term, " + WEIGHTS["TF-IDF"] + " AS w FROM tf JOIN vocab USING (term), nd)",
        "wn AS (SELECT side, id, sqrt(sum(w * w)) AS l FROM wa GROUP BY ALL)",
        "a AS MATERIALIZED (SELECT side, id, term, w / l AS w FROM wa JOIN wn USING (side, id))",
        "v0 AS MATERIALIZED (SELECT term, 1.0::DOUBLE / sqrt(count(*) OVER ()) AS x FROM (SELECT DISTINCT term FROM a))",
    ]
    for k in range(rounds):
        steps.append(f"z{k} AS MATERIALIZED (SELECT side, id, sum(w * x) AS x FROM a JOIN v{k} USING (term) GROUP BY ALL)")
        steps.append(f"y{k} AS MATERIALIZED (SELECT term, sum(w * x) AS x FROM a JOIN z{k} USING (side, id) GROUP BY ALL)")
        steps.append(f"v{k + 1} AS MATERIALIZED (SELECT term, x / (SELECT sqrt(sum(x * x)) FROM y{k}) AS x FROM y{k})")
    steps.append(f"on_first AS (SELECT side, id, abs(sum(w * x)) AS x FROM a JOIN v{rounds} USING (term) GROUP BY ALL)")
    steps.append("first_axis AS (SELECT side, split, id, coalesce(x, 0) AS x FROM split_corpus LEFT JOIN on_first USING (side, id))")
    return TERMS + ",\n" + ",\n".join(steps)


LEADING = _leading(150)

def learned_language(table: str, text: str, lang: str) -> str:
    """CTEs up to ``found(doc_id, lang_found)``: likelihood of three-letter runs counted per declared language."""
    return f"""opening AS (
  SELECT doc_id, {lang} AS lang, array_to_string(regexp_extract_all(lower({text}), '\\p{{L}}+')[1:30], ' ') AS o FROM {table}
),
signs AS (SELECT doc_id, lang, string_split(' ' || o || ' ', '') AS s FROM opening WHERE o <> ''),
run AS (
  SELECT doc_id, lang, unnest(list_transform(range(1, len(s) - 1),
    lambda i: (unicode(s[i]) * 961 + unicode(s[i + 1]) * 31 + unicode(s[i + 2])) % 4096)) AS b FROM signs
),
per AS (SELECT lang, b, count(*) AS n FROM run WHERE lang IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS t FROM per GROUP BY lang),
rated AS (
  SELECT doc_id, t.lang, sum(ln((coalesce(p.n, 0) + 1)::DOUBLE / (t.t + 4096))) AS score
  FROM run r CROSS JOIN totals t LEFT JOIN per p ON p.lang = t.lang AND p.b = r.b GROUP BY ALL
),
best AS (SELECT doc_id, lang FROM rated QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1),
found AS (SELECT d.doc_id, best.lang AS lang_found FROM {table} d LEFT JOIN best USING (doc_id))"""


# Stand-ins for the raw tables.

RAW_ARTICLES = f"""{D},
pm_raw AS (
  SELECT doc_id AS pmid, array_to_string(ws[1:8], ' ') AS title,
    CASE WHEN source = 'src7' THEN 'n/a' ELSE coalesce(array_to_string(ws[9:], ' '), '') END AS abstract
  FROM d
)"""


def _copy(kind: int, title_start: int, body: str, url: str) -> str:
    return f"""SELECT doc_id * 5 + {kind} AS web_id,
    'TITLE: ' || array_to_string(ws[{title_start}:{title_start + 7}], ' ') || chr(10)
      || 'TEXT: ' || array_to_string({body}, ' ') AS processed_content,
    {url} AS url, doc_id // 2 AS pmid FROM d"""


RAW_PAGES = f"""web_raw AS (
  {_copy(0, 1, "ws", "source || '/' || (n_chars // 100)")}
  UNION ALL {_copy(1, 2, "ws[1:n // 5] || ['edited'] || ws[n // 5 + 1:]", "source || '/c1/' || doc_id")}
  UNION ALL {_copy(2, 3, "ws[n // 2 + 1:] || ws[1:n // 2]", "source || '/c2/' || doc_id")}
  UNION ALL {_copy(3, 4, "ws", "source || '/c3/' || doc_id")}
  UNION ALL {_copy(4, 1, "ws || ['added', 'line']", "source || '/c4/' || doc_id")}
)"""

_NULLED = "CASE WHEN {0} = 'n/a' OR ({0} <> '' AND regexp_replace({0}, '" + _SPACE.replace("{", "{{").replace("}", "}}") + "', '', 'g') = '') THEN NULL ELSE {0} END"

ARTICLES = f"""{RAW_ARTICLES},
pm_text AS (
  SELECT pmid, {_NULLED.format("title")} AS title, {_NULLED.format("abstract")} AS abstract,
    title || ': ' || abstract AS corpus_text, {wc("title || ': ' || abstract")} AS text_length
  FROM pm_raw
),
pm_clean AS (SELECT * FROM pm_text WHERE text_length >= 100)"""


def _hits(lang: str) -> str:
    listed = ", ".join(f"'{w}'" for w in _FREQUENT[lang].split())
    return f"len(list_filter(opening, lambda w: list_contains([{listed}], w))) AS {lang}"


def language(source: str, text: str, out: str) -> str:
    """CTE ``out``: ``source`` with column ``lang_found``."""
    langs = list(_FREQUENT)
    best = f"greatest({', '.join(langs)})"
    cases = " ".join(f"WHEN {x} = {best} THEN '{x}'" for x in langs)
    return f"""{out}_open AS (SELECT *, regexp_extract_all(lower({text}), '{_WORD_RUN}')[1:30] AS opening FROM {source}),
{out}_hits AS (SELECT *, {", ".join(_hits(x) for x in langs)} FROM {out}_open),
{out} AS (SELECT *, CASE WHEN {best} = 0 THEN NULL {cases} END AS lang_found FROM {out}_hits)"""


_FLAT = "replace(replace(replace(processed_content, 'TITLE: ', ''), chr(10), ''), 'TEXT: ', '{-}')"
_MISSING = "IN ('', '0', ' ', 'None')"

PAGES = f"""{ARTICLES},
{RAW_PAGES},
linked AS (SELECT *, {_FLAT} AS flat FROM web_raw WHERE pmid IN (SELECT pmid FROM pm_clean)),
parts AS (
  SELECT web_id, url, pmid, trim(array_to_string({ws("processed_content")}, ' ')) AS processed_content,
    coalesce(trim(CASE WHEN contains(flat, '{{-}}') THEN left(flat, strpos(flat, '{{-}}') - 1) ELSE flat END), 'None') AS title,
    coalesce(trim(CASE WHEN contains(flat, '{{-}}') THEN substr(flat, strpos(flat, '{{-}}') + 3) END), 'None') AS content
  FROM linked
),
flagged AS (
  SELECT *, title {_MISSING} AS title_nan, content {_MISSING} AS content_nan, {wc("processed_content")} AS text_length,
    title || ': ' || content AS corpus_text
  FROM parts
),
{language("flagged", "corpus_text", "spoken")},
pages_clean AS (
  SELECT web_id, processed_content, url, pmid, title, content, title_nan, content_nan, text_length, corpus_text
  FROM spoken WHERE NOT (title_nan AND content_nan) AND text_length >= 100 AND lang_found = 'en'
)"""

DEDUPED = f"""{PAGES},
once AS (SELECT * FROM pages_clean QUALIFY row_number() OVER (PARTITION BY content, pmid ORDER BY web_id) = 1),
twice AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY title, pmid ORDER BY web_id) = 1),
deduped AS (
  SELECT *, count(*) OVER (PARTITION BY pmid) AS pmid_count, count(*) OVER (PARTITION BY url) AS url_count FROM twice
)"""


def near_pairs(denominator: str) -> str:
    """CTEs up to ``pairs(gid, id_1, id_2, lcs, pct)`` by gaps and islands over equal words."""
    pick = "least" if denominator == "min" else "greatest"
    forward_only = "AND FALSE" if denominator == "max" else ""
    bare = ws(f"lower(regexp_replace(corpus_text, '{_PUNCTUATION}', '', 'g'))")
    texts = f"{DEDUPED}, bare AS (SELECT pmid AS gid, web_id AS id, length(corpus_text) AS l, {bare} AS w FROM deduped)"
    pairs = "pr AS (SELECT a.gid, a.id AS a, b.id AS b FROM bare a JOIN bare b ON a.gid = b.gid AND a.id < b.id)"
    return f"""{texts},
pos AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM bare),
{pairs},
{_runs(pick, forward_only)}"""


def _runs(pick: str, forward_only: str) -> str:
    """CTEs from ``bare``, ``pos`` and ``pr`` to ``pairs``."""
    return f"""same AS (SELECT a, b, x.i AS i, y.i AS j FROM pr JOIN pos x ON x.id = a JOIN pos y ON y.id = b AND y.word = x.word),
isl AS (SELECT a, b, i, j, i - row_number() OVER (PARTITION BY a, b, i - j ORDER BY i) AS g FROM same),
runs AS (SELECT a, b, count(*) AS n, min(i) AS i, min(j) AS j FROM isl GROUP BY a, b, i - j, g),
fwd AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY n DESC, i, j) = 1),
bwd AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY n DESC, j, i) = 1),
both_ways AS (
  SELECT pr.gid, pr.a, pr.b, array_to_string(x.w[f.i:f.i + f.n - 1], ' ') AS run_f,
    array_to_string(y.w[r.j:r.j + r.n - 1], ' ') AS run_b, {pick}(x.l, y.l) AS l
  FROM pr JOIN fwd f USING (a, b) JOIN bwd r USING (a, b) JOIN bare x ON x.id = pr.a JOIN bare y ON y.id = pr.b
),
pairs AS (
  SELECT gid, a AS id_1, b AS id_2, run_f AS lcs, round(length(run_f)::DOUBLE / l * 100, 6) AS pct
  FROM both_ways WHERE length(run_f)::DOUBLE / l * 100 > 50
  UNION ALL
  SELECT gid, b, a, run_b, round(length(run_b)::DOUBLE / l * 100, 6)
  FROM both_ways WHERE length(run_f)::DOUBLE / l * 100 <= 50 AND length(run_b)::DOUBLE / l * 100 > 50 {forward_only}
)"""


def _all_pairs() -> str:
    """``pairs`` over all documents: a run over half of a text lies across the text's middle.

    So it holds three consecutive words near the middle of both texts, or it has at most two words,
    one of which makes up about a quarter of the text.
    """
    bare = ws(f"lower(regexp_replace(text, '{_PUNCTUATION}', '', 'g'))")
    return f"""bare AS (SELECT 0 AS gid, doc_id AS id, length(text) AS l, {bare} AS w FROM documents),
pos AS (SELECT id, l, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM bare),
grown AS (
  SELECT id, i, sum(length(word) + 1) OVER (PARTITION BY id ORDER BY i) AS c, sum(length(word) + 1) OVER (PARTITION BY id) AS t FROM pos
),
middle AS (SELECT id, min(i) AS m FROM grown WHERE c * 2 >= t GROUP BY id),
three AS (SELECT id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS g FROM pos WINDOW o AS (PARTITION BY id ORDER BY i)),
anchor AS (SELECT id, g FROM three JOIN middle USING (id) WHERE g IS NOT NULL AND i BETWEEN m - 3 AND m + 1),
big AS (SELECT DISTINCT id, word FROM pos WHERE length(word) * 4 + 8 >= l),
pr AS (
  SELECT 0 AS gid, a.id AS a, b.id AS b FROM anchor a JOIN three b USING (g) WHERE a.id < b.id
  UNION SELECT 0, b.id, a.id FROM anchor a JOIN three b USING (g) WHERE b.id < a.id
  UNION SELECT 0, a.id, b.id FROM big a JOIN big b USING (word) WHERE a.id < b.id
),
{_runs("greatest", "AND FALSE")}"""


ALL_PAIRS = _all_pairs()


SURVIVORS = f"""{near_pairs("min")},
members AS (SELECT gid, id_1 AS web_id FROM pairs UNION SELECT gid, id_2 FROM pairs),
kept AS (
  SELECT m.gid, m.web_id FROM members m JOIN deduped USING (web_id)
  QUALIFY row_number() OVER (PARTITION BY m.gid ORDER BY length(corpus_text) DESC, m.web_id) = 1
),
surviving AS (
  SELECT * FROM deduped
  WHERE web_id NOT IN (SELECT web_id FROM members) OR web_id IN (SELECT web_id FROM kept)
)"""

EDGE_ROWS = """edges AS (
  SELECT l_orderkey AS pmid, l_partkey || '/' || l_suppkey AS url, l_extendedprice AS len,
    lpad(l_orderkey::VARCHAR, 12, '0') || '-' || lpad(l_linenumber::VARCHAR, 4, '0') || '-'
      || lpad(l_partkey::VARCHAR, 12, '0') || '-'
      || lpad(round(l_extendedprice * 100)::BIGINT::VARCHAR, 14, '0') AS row_id
  FROM lineitem
)"""

EDGES = f"""{EDGE_ROWS},
counted AS (
  SELECT *, count(*) OVER (PARTITION BY pmid) AS pmid_count, count(*) OVER (PARTITION BY url) AS url_count FROM edges
)"""

# Every seventh length without a url, every eleventh without an article.
OPEN_EDGES = f"""{EDGE_ROWS},
holes AS (
  SELECT CASE WHEN floor(len)::BIGINT % 11 <> 0 THEN pmid END AS pmid,
    CASE WHEN floor(len)::BIGINT % 7 <> 0 THEN url END AS url, len, row_id
  FROM edges
),
counted AS (
  SELECT *, CASE WHEN pmid IS NOT NULL THEN count(*) OVER (PARTITION BY pmid) END AS pmid_count,
    CASE WHEN url IS NOT NULL THEN count(*) OVER (PARTITION BY url) END AS url_count
  FROM holes
)"""


def free(where: str, taken: str | None) -> str:
    rest = (
        f" AND pmid NOT IN (SELECT pmid FROM {taken}) AND url NOT IN (SELECT url FROM {taken})" if taken else ""
    )
    return f"SELECT pmid, url, len, row_id FROM counted WHERE {where}{rest}"


ONE_ONE = "pmid_count = 1 AND url_count = 1"
ONE_MANY = "pmid_count = 1 AND url_count > 1"
MANY_ONE = "pmid_count > 1 AND url_count = 1"
MANY_MANY = "pmid_count > 1 AND url_count > 1"


def first_per_url(where: str, taken: str | None = None) -> str:
    return f"""SELECT pmid, url, row_id FROM ({free(where, taken)})
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY row_id) = 1"""


def longest_per_article(where: str, taken: str | None = None) -> str:
    return f"""SELECT pmid, url, row_id FROM ({free(where, taken)})
  QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY len DESC, row_id) = 1"""


def greedy(where: str, taken: str | None = None) -> str:
    """CTEs up to ``matched``: rounds of proposals until no url is contested."""
    return f"""open_edges AS ({free(where, taken)}),
live AS (
  SELECT *, min(row_id) OVER (PARTITION BY pmid) AS prio, 0 AS round FROM open_edges
  UNION ALL
  SELECT pmid, url, len, row_id, prio, round + 1 FROM (
    SELECT *, max(n_prop) OVER () AS busiest FROM (
      SELECT *, min(CASE WHEN prop THEN prio END) OVER (PARTITION BY url) AS holder,
        count(*) FILTER (prop) OVER (PARTITION BY url) AS n_prop
      FROM (SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY len DESC, row_id) = 1 AS prop FROM live)
    )
  ) WHERE busiest > 1 AND (holder IS NULL OR prio <= holder)
),
matched AS (
  SELECT pmid, url, row_id FROM (SELECT * FROM live WHERE round = (SELECT max(round) FROM live))
  QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY len DESC, row_id) = 1
)"""


def cascade(source: str) -> str:
    """CTEs from ``counted`` (in ``source``) up to the chosen links ``t3`` and ``matched``."""
    return f"""{source},
c1 AS ({free(ONE_ONE, None)}),
t1 AS (SELECT pmid, url, row_id FROM c1),
t2 AS (SELECT * FROM t1 UNION ALL {first_per_url(ONE_MANY, "t1")}),
t3 AS (SELECT * FROM t2 UNION ALL {longest_per_article(MANY_ONE, "t2")}),
{greedy(MANY_MANY, "t3")}"""


CASCADE = f"""RECURSIVE {cascade(EDGES)}
SELECT * FROM t3 UNION ALL SELECT * FROM matched"""

OPEN_CASCADE = f"""RECURSIVE {cascade(OPEN_EDGES)}
SELECT * FROM t3 UNION ALL SELECT * FROM matched"""

_COUNTED_PAGES = """counted AS (
  SELECT pmid, url, text_length AS len, web_id AS row_id, pmid_count, url_count FROM surviving
)"""

FINAL = f"""RECURSIVE {cascade(f"{SURVIVORS}, {_COUNTED_PAGES}")},
links AS (SELECT row_id AS web_id, pmid FROM t3 UNION ALL SELECT row_id, pmid FROM matched),
corpus AS (
  SELECT 'web' AS side, web_id AS id, corpus_text AS txt FROM surviving WHERE web_id IN (SELECT web_id FROM links)
  UNION ALL SELECT 'pm', pmid, corpus_text FROM pm_clean
),
{_SPLIT}"""

FINAL_RANKS = f"""{FINAL},
{_TERMS},
{rank_ctes("TF-IDF")}"""
