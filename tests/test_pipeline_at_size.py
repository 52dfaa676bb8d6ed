"""What the way from raw tables to the final corpora leaves on disk."""

import random

from linkloom import runtime
from linkloom.plans import pipeline

COMMON = "the of and to in is that for it was on are as with be this by from have or".split()


def words(seed, n=150):
    rng = random.Random(seed)
    return " ".join(rng.choice(COMMON) if rng.random() < 0.6 else f"w{rng.randrange(5000)}" for _ in range(n))


def test_only_the_final_tables_stay(spark):
    articles = spark.createDataFrame([(i, words(f"t{i}", 8), words(f"a{i}")) for i in range(6)], "pmid long, title string, abstract string")
    text = {i: words(f"p{i}") for i in range(6)}
    rows = [(i, f"TITLE: {words(f't{i}', 8)}\nTEXT: {text[i]}", f"u{i}", i) for i in range(6)]
    rows += [(10 + i, f"TITLE: {words(f'o{i}', 8)}\nTEXT: {text[i]} more", f"v{i}", i) for i in range(3)]
    pages = spark.createDataFrame(rows, "web_id long, processed_content string, url string, pmid long")
    before = len(runtime._written.get(spark.sparkContext.applicationId, []))
    final = pipeline.final_corpora(articles, pages)
    assert len(runtime._written[spark.sparkContext.applicationId]) - before == 3  # articles, pages, links
    assert {r.pmid for r in final.links.collect()} == set(range(6))
    assert final.articles.count() == 6 and final.pages.count() == 6
    assert dict(final.audit.collect())["pages_without_near_copies"] == 6
