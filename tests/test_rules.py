"""Missing ends of links, blank values, tag write-back and sample cuts."""

from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.operators import duplicates, evaluate, links, ordering, skew, splits

OPEN = [(1, "a", 5.0, 0), (1, None, 9.0, 1), (None, "a", 7.0, 2), (2, None, 9.0, 3), (3, None, 9.0, 4), (2, "b", 1.0, 5), (None, None, 1.0, 6), (3, "b", 2.0, 7)]


def test_links_without_an_end_are_in_no_bucket(spark):
    edges = duplicates.with_link_counts(spark.createDataFrame(OPEN, "pmid long, url string, len double, row_id long"), "row_id")
    got = {r.bucket: r.n_links for r in links.bucket_counts(edges).collect()}
    assert got == {"n:n": 3}
    chosen = {(r.pmid, r.url) for r in links.one_to_one_cascade(edges).collect()}
    assert chosen == {(1, "a"), (2, "b")}
    assert {(r.pmid, r.url) for r in links.select_one_to_one(edges).collect()} == chosen
    assert {r.url for r in links.select_per_url(edges).collect()} == {"a", "b"}
    assert {r.pmid for r in links.select_per_article(edges).collect()} == {1, 2, 3}


def test_chain_needs_as_many_rounds_as_articles(spark):
    n = 7
    rows = [(p, f"u{u}", float(n - u), p * n + u) for p in range(n) for u in range(n)]
    chosen = links.select_one_to_one(spark.createDataFrame(rows, "pmid long, url string, len double, row_id long"))
    assert {(r.pmid, r.url) for r in chosen.collect()} == {(p, f"u{p}") for p in range(n)}


def test_blank_means_any_space(spark):
    values = ["n/a", " \t", "\xa0", " \xa0\n", "", "x", " x "]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", T.null_if_marked(F.col("v")).alias("w"))
    assert {r.v for r in df.collect() if r.w is None} == {"n/a", " \t", "\xa0", " \xa0\n"}


def test_interleave(spark):
    row = spark.range(1).select(
        T.interleave(F.array(F.lit(1), F.lit(3)), F.array(F.lit(2), F.lit(4), F.lit(5))).alias("x")
    ).first()
    assert row.x == [1, 2, 3, 4, 5]


def test_tags_are_written_back(spark):
    own = spark.createDataFrame([(i, 10 + i, None) for i in range(20)], "web_id long, pmid long, train_test string")
    tagged = splits.split_links(own.where("web_id < 10"))
    got = {r.web_id: r.train_test for r in splits.write_tags(own, tagged).collect()}
    assert sum(v == "Train" for v in got.values()) == 7 and all(got[i] is None for i in range(10, 20))


def test_exact_sample_with_long_prefix(spark, monkeypatch):
    df = spark.range(500).withColumnRenamed("id", "web_id").withColumn("pmid", F.col("web_id") * 3)
    plain = {tuple(r) for r in splits.split_links(df).collect()}
    monkeypatch.setattr(ordering, "_EDGE_ROWS", 0.01)
    assert {tuple(r) for r in splits.split_links(df).collect()} == plain
    assert sum(r[2] == "Train" for r in plain) == 350


def test_salts_follow_the_size_of_the_key(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 700, "hot").when(F.col("id") < 900, F.concat(F.lit("k"), F.col("id"))).alias("k"))
    keys = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for how, n in (("inner", 900), ("left", 1000)):
        assert skew.attach_per_key(rows, keys.where("k IS NOT NULL"), ["k"], "n", F.col("id"), how, hot_rows=50).count() == n
    assert skew.join_on_hot_key(rows, keys.select("k"), "k", F.col("id"), "left_anti", hot_rows=50).count() == 100


def test_quartiles_interpolate(spark):
    ranks = [1, 1, 2, 5, 9, 40, 40, 300]
    df = spark.createDataFrame([("a", r) for r in ranks] + [("b", 7)], "g string, rank long")
    got = {r.g: r for r in evaluate.measures(df, ("g",)).collect()}
    assert (got["a"].median, got["a"].iqr25, got["a"].iqr75, got["a"].pct1, got["a"].pct50) == (7.0, 1.75, 40.0, 25.0, 87.5)
    assert (got["b"].median, got["b"].n_links, got["b"].pct250) == (7.0, 1, 100.0)
    assert evaluate.measures(df.where("g = 'a'").drop("g")).first().median == 7.0
