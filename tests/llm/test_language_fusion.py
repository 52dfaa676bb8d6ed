"""Language evidence against brute force: every row is judged by counts over all other rows."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linkloom.llm import language


def buckets(text):
    data = (text or "").encode()
    for a, b, c in zip(data, data[1:], data[2:]):
        h = ((a | b << 8 | c << 16) * 0x9E3779B1) % 2**32
        yield (h ^ h >> 13) % 2**16


def brute_model(training):
    counts = {}
    for text, lang in training:
        if lang is not None:
            own = counts.setdefault(lang, defaultdict(int))
            for b in buckets(text):
                own[b] += 1
    return {lang: (own, math.log(sum(own.values()) + 2**16 / 2)) for lang, own in counts.items()}


def brute_identify(rows, training):
    model = brute_model(training)
    names = sorted(model)
    evidence, best, at, said = [], [], [], []
    for r in rows:
        sums = [0.3 * sum(math.log(model[n][0].get(b, 0) + 0.5) - model[n][1] for b in buckets(r.text)) for n in names]
        evidence.append([x - max(sums) for x in sums])
        best.append(names[sums.index(max(sums))])
        at.append(best[-1] if max(sums) > min(sums) else None)
        said.append(None if r.declared is None else r.declared if r.declared in names else "other")
    out = []
    for i, r in enumerate(rows):
        others = [j for j in range(len(rows)) if j != i and at[j]]

        def count(fits):
            return [sum(at[j] == n for j in others if fits(j)) for n in names]

        whole = count(lambda j: True)
        prior = [(n + 1) / (sum(whole) + len(names)) for n in whole]
        for keys in (("suffix",), ("domain", "suffix"), ("host", "domain", "suffix")):
            own = count(lambda j: all((getattr(rows[j], k) or "") == (getattr(r, k) or "") for k in keys))
            prior = [(n + 5 * p) / (sum(own) + 5) for n, p in zip(own, prior)]
        post = [x + math.log(p) for x, p in zip(evidence[i], prior)]
        if said[i]:
            same, any_ = count(lambda j: said[j] == said[i]), count(lambda j: said[j])
            post = [x + math.log((s + 1 + 10 * (n == said[i])) / (t + len(names) + 1 + 10)) for x, s, t, n in zip(post, same, any_, names)]
        top = max(post)
        out.append((r.doc_id, r.page_id, names[post.index(top)], best[i], r.declared, 1 / sum(math.exp(x - top) for x in post)))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (str(r[0]), str(r[1]), str(r[4]), r[3], r[2], r[5]))


def agree(got, want):
    got, want = in_order([(r.doc_id, r.page_id, r.lang, r.text_lang, r.declared, r.confidence) for r in got]), in_order(want)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], abs=2e-3)


def test_query_equals_brute_force(spark, sf):
    from linkloom.llm import queries

    docs, pages = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/pages.parquet")
    rows = language.from_pages(pages).unionByName(language.from_documents(docs)).collect()
    agree(queries.op5_evidence_fusion(spark, sf).collect(), brute_identify(rows, [(r.text, r.lang) for r in docs.select("text", "lang").collect()]))


FIELDS = "doc_id long, page_id long, text string, declared string, host string, domain string, suffix string"


def test_edges_equal_brute_force(spark):
    training = [("le chat noir dort la nuit", "fr"), ("der hund und die katze", "de"), ("the cat and the dog", "en"), ("x", None), (None, "en")]
    fr, de = "la nuit le chat dort", "die katze und der hund"
    rows = [(k, None, fr, "fr", "a.x.fr", "x.fr", "fr") for k in range(12)]
    rows += [(50, None, de, "de", "b.x.fr", "x.fr", "fr")] * 3  # repeated rows, and a host unlike its domain
    rows += [
        (60, None, None, None, "a.x.fr", "x.fr", "fr"), (61, None, "", "de", "new.de", "new.de", "de"), (62, None, "", None, None, None, None),
        (None, 7, fr, "xx", None, None, None), (None, None, de, "xx", "c.y.de", "y.de", "de"), (63, 8, "zz", "en", "", "", ""), (64, None, de * 3000, None, "c.y.de", "y.de", "de"),
    ]
    table = spark.createDataFrame(rows, FIELDS)
    model = language.fit(spark.createDataFrame(training, "text string, lang string"))
    want = brute_identify(table.collect(), training)
    clashing = table.withColumns({c: F.lit("x") for c in ("evidence", "best", "at", "said", "n_host", "prior", "lang")})
    for form in (table, clashing.repartition(5)):
        got = language.identify(form, *model)
        assert got.columns == ["doc_id", "page_id", "lang", "confidence", "text_lang", "declared"]
        agree(got.collect(), want)
    assert language.identify(table.limit(0), *model).count() == 0


def test_ties_go_to_the_first_language(spark):
    model = language.fit(spark.createDataFrame([("abcabc", "b"), ("abcabc", "a")], "text string, lang string"))
    got = language.identify(spark.createDataFrame([(1, None, "abc", None, "h", "h", "h"), (2, None, None, None, "h", "h", "h")], FIELDS), *model).collect()
    assert [(r.lang, r.confidence) for r in got] == [("a", 0.5)] * 2
