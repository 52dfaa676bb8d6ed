"""Token counts, chat formatting, URL reputation and language evidence."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import chat, language, token_counts, url_reputation

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = "ab the  ▁\n\t é😀ßthing12.,'  中文\x00<s>"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_every_prefix_is_exact(library):
    tables = token_counts.PrefixTable(token_counts.read_model(MODEL))
    random.seed(3)
    for _ in range(300):
        text = "".join(random.choice(AWKWARD) for _ in range(random.randint(0, 40)))
        want = [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        assert tables.table(text).tolist() == want
        ((keys, plain, counts),) = tables.counts([text])
        assert sum(counts) == want[-1]
        budget = random.randint(0, 20)
        fit = tables.fitting(keys, plain, counts, budget) if want[-1] > budget else len(text)
        assert fit == max(i for i, n in enumerate(want) if n <= budget)


def test_token_counts_of_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in token_counts.token_counts(docs, MODEL).collect()}
    for r in docs.collect():
        n = len(library.encode(r.text))
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len(r.text.encode()), n, n > 4096)


def test_token_counts_edges(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (2, "a b", "x"), (None, " a", "x"), (3, "lang " * 9000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = token_counts.token_counts(docs, MODEL, with_table=True).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(d), len(library.encode(t or ""))) for d, t, _ in rows)
    long = next(r for r in got if r.doc_id == 3)
    assert long.over_limit and long.prefix_tokens[long.fit_chars] <= 4096 and max(i for i, n in enumerate(long.prefix_tokens) if n <= 4096) == long.fit_chars
    assert token_counts.token_counts(docs.limit(0), MODEL).count() == 0


def expected_digests(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        n, turns, loss = out.get(conv, (0, "", ""))
        out[conv] = (n + 1, turns + f"{role or ''}\n{text or ''}\n", loss + (text or "") * (role == "assistant"))
    return {k: (n, hashlib.sha256(t.encode()).hexdigest(), len(x), hashlib.sha256(x.encode()).hexdigest()) for k, (n, t, x) in out.items()}


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "a </turn>\n<turn x>"), (1, 1, "assistant", "\\<b\\\\ > 😀\n"), (1, 1, "assistant", "again"), (1, None, "assistant", None),
        (2, 5, None, ""), (None, 0, "assistant", "null id"), (3, 0, "a>b\\<", "\\### Assistant: </turn> ok"), (2, 5, None, ""),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("offset", F.lit("x"))
    formatted = chat.format_conversations(turns)
    for got in (chat.read_back(formatted, in_order=True), chat.read_back(formatted)):
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got.collect()} == expected_digests(rows)
    whole = {}
    for r in formatted.collect():
        assert r.offset == len(whole.get(r.conv_id, ""))
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.rendered
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_chat_typed_parts(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [(1, 0, "user", [part("text", "see <"), part("image", ref="i.png", w=57, h=28), part("audio", ref="a", s=1.5), part("text", "!")]),
            (1, 1, "assistant", [part(None, "x"), part("document", ref="d", p=2), part("text", "<y")]), (1, 2, "user", None)]
    got = chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<struct<{chat.PART}>>")).collect()
    assert got[0].rendered == "<turn user>\nsee \\<<image 2><audio 3>!\n</turn>\n"
    assert [(a.number, a.kind, a.ref, a.tokens) for a in got[0].attachments] == [(2, "image", "i.png", 3), (3, "audio", "a", 38)]
    assert got[0].expanded_tokens == 41 and not got[0].mask
    text = "".join(r.rendered for r in got)
    assert [text[m.start : m.end] for m in got[1].mask] == ["x", "\\<y"]
    assert chat.parse_turn(got[1].rendered) == ("assistant", "x<y")
    assert chat.parse_turn(got[2].rendered) == ("user", "")


def test_url_parts_and_rules(spark):
    urls = [
        (1, "HTTP://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "http://net/", "net", "/", "net/", "block"), (3, "http://xnet/", "xnet", "/", None, "allow"),
        (4, "http://b.org/fr/1", "b.org", "/fr/1", "org/fr/", "allow"), (5, None, "", "", None, "allow"), (6, "no scheme", "", "", None, "allow"),
        (7, "x://example.com/de/?y", "example.com", "/de/", "example.com/de/", "block"), (8, "a://b.net?x/", "b.net", "", None, "allow"),
        (8, "a://b.net?x/", "b.net", "", None, "allow"), (None, "http://É.com/\nz", "É.com", "/\nz", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "c") for i, u, *_ in urls], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = url_reputation.judge(pages, labels).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(key((i, *rest)) for i, _, *rest in urls)
    assert url_reputation.judge(pages.limit(0), labels).count() == 0


def test_reputation_blocks_bad_hosts_only(spark):
    pages = [(i, f"http://{'bad' if i % 4 == 0 else 'h%d' % (i % 7)}.site{i % 3}.com/") for i in range(600)]
    labels = [(i, 0 if i % 4 == 0 else 1, None if i % 5 else 0) for i in range(400)] + [(1, 1, 0), (None, 0, 1)]
    got = url_reputation.judge(
        spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ).collect()
    assert {r.host.split(".")[0] == "bad" for r in got if r.verdict == "block"} == {True}
    assert all((r.verdict == "block") == r.host.startswith("bad") for r in got)


def test_domains(spark):
    hosts = [("a.b.co.uk", "b.co.uk", "co.uk"), ("x.example.com", "example.com", "com"), ("com", "com", ""), ("", "", ""), ("u@h.org:80", "h.org", "org")]
    df = spark.createDataFrame([(h,) for h, *_ in hosts], "h string").select("h", url_reputation.domain_of(F.col("h")).alias("d"))
    assert {(r.h, r.d, r.s) for r in df.withColumn("s", url_reputation.suffix_of(F.col("d"))).collect()} == set(hosts)


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    languages, model = language.fit(docs.where(half))
    rows = language.from_documents(docs.where(~half)).unionByName(language.from_pages(spark.read.parquet(f"{sf}/pages.parquet")))
    got = language.identify(rows, languages, model).toPandas()
    truth = docs.select("doc_id", F.col("lang").alias("truth")).toPandas()
    both = got[got.doc_id.notna()].merge(truth, on="doc_id")
    assert len(both) > 50 and (both.lang == both.truth).mean() > 0.97
    pages = got[got.page_id.notna()]
    assert (pages.lang == pages.declared).mean() > 0.95


def test_language_evidence_decides_without_text(spark):
    pages = [(i, "http://x.fr/", "<html lang='fr'>" + "le chat noir dort la nuit " * 5) for i in range(30)]
    pages += [(90, "http://x.fr/", ""), (91, None, None), (92, "http://y.de/", "<html LANG=de><p>")]
    docs = spark.createDataFrame([(1, "le chat noir dort la nuit", "fr"), (2, "der hund und die katze", "de"), (3, "x", None)], "doc_id long, text string, lang string")
    languages, model = language.fit(docs)
    got = {r.page_id: r for r in language.identify(language.from_pages(spark.createDataFrame(pages, "page_id long, url string, html string")), languages, model).collect()}
    assert got[90].lang == "fr" and got[92].lang == "de" and len(got) == 33
    none = language.fit(docs.limit(0))
    assert language.identify(language.from_documents(docs.withColumn("source", F.lit("s"))), *none).where("lang IS NULL").count() == 3
    assert np.allclose(np.exp(model).sum(0), 1, atol=1e-3)
