import hashlib

import pytest
from pyspark.sql import functions as F

from linkloom.operators import duplicates, ordering, retrieval, skew


def test_global_index_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.lit(7919) * F.col("id") % 1000).alias("x")).repartition(7)
    got = sorted((r["n"], r["x"]) for r in ordering.with_global_index(df, [F.col("x")], "n").collect())
    assert got == [(i, i) for i in range(1000)]


@pytest.mark.parametrize("n,inside", [(200, 140), (5, 4), (15, 10), (1, 1), (0, 0)])
def test_exact_fraction(spark, n, inside):
    df = spark.range(n).select(F.col("id").alias("web_id"), F.col("id").alias("pmid"))
    out = ordering.tag_exact_fraction(df, ["web_id", "pmid"]).collect()
    assert len(out) == n
    assert sum(r["train_test"] == "Train" for r in out) == inside == round(0.7 * n)
    order = sorted(range(n), key=lambda i: hashlib.md5(f"42:{i}:{i}".encode()).hexdigest())
    assert {r["web_id"] for r in out if r["train_test"] == "Train"} == set(order[:inside])


def test_exact_fraction_inside_one_bucket(spark):
    df = spark.range(60).select(F.lit(1).alias("a"), F.col("id").alias("b"))
    out = ordering.tag_exact_fraction(df, ["a"], 0.5).collect()
    assert sum(r["train_test"] == "Train" for r in out) == 30


def test_request_batches(spark):
    df = spark.range(250).select((F.col("id") * 3).alias("pmid"))
    out = {r["batch"]: r["ids"] for r in ordering.request_batches(df, "pmid").collect()}
    assert [len(out[i]) for i in range(3)] == [100, 100, 50]
    assert sum((out[i] for i in range(3)), []) == [3 * i for i in range(250)]


def test_factorize_by_first_appearance(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "c"), (5, None)], "id long, k string")
    out = {r["id"]: r["g"] for r in ordering.factorize(df, "k", "id", "g").collect()}
    assert out == {1: 0, 2: 1, 3: 0, 4: 2, 5: None}


def test_running_total_over_strips(spark):
    df = spark.createDataFrame([("a", i, i % 3) for i in range(1, 50)], "m string, rank long, n long")
    out = sorted((r["rank"], r["c"]) for r in ordering.running_total(df, ["m"], "rank", "n", "c", width=7).collect())
    total, expected = 0, []
    for i in range(1, 50):
        total += i % 3
        expected.append((i, total))
    assert out == expected


def test_hot_key_join_equals_plain_join(spark):
    rows = [(i, 1 if i % 3 else i, "x") for i in range(300)] + [(1000, None, "y")]
    df = spark.createDataFrame(rows, "id long, k long, v string")
    plain = {(r["id"], r["n"]) for r in duplicates.group_size(df, "k", "id", "n").collect()}
    hot = {(r["id"], r["n"]) for r in duplicates.group_size(df, "k", "id", "n", hot_rows=10).collect()}
    assert plain == hot and (1000, None) in hot and len(hot) == 301
    keys = spark.createDataFrame([(1,), (3,)], "k long")
    for how in ("left_semi", "left_anti", "inner"):
        a = {r["id"] for r in skew.join_on_hot_key(df, keys, "k", F.col("id"), how, hot_rows=10).collect()}
        b = {r["id"] for r in df.join(keys, "k", how).collect()}
        assert a == b


def test_keep_first_census_and_flag(spark):
    df = spark.createDataFrame(
        [(5, "c", 1), (2, "c", 1), (3, "c", 2), (4, None, 1), (6, None, 1)], "web_id long, content string, pmid long"
    )
    kept = {r["web_id"] for r in duplicates.keep_first(df, ["content", "pmid"], "web_id").collect()}
    assert kept == {2, 3, 4}
    census = {(r["web_id"], r["copies"]) for r in duplicates.duplicate_census(df, ["content", "pmid"], "web_id").collect()}
    assert census == {(5, 2), (2, 2), (4, 2), (6, 2)}
    flags = {r["web_id"]: r["is_repeat"] for r in duplicates.flag_not_first(df, ["content", "pmid"], "web_id", hot_rows=1).collect()}
    assert flags == {5: True, 2: False, 3: False, 4: False, 6: True}


def test_distinct_profile_counts_null_once(spark):
    df = spark.createDataFrame(
        [("u", "t", "a", "b", 1), (None, "t", "a", "b", None), (None, "s", "a", "b", None)],
        "url string, corpus_text string, title string, content string, pmid long",
    )
    assert tuple(duplicates.distinct_profile(df).first()) == (2, 2, 2)


def test_retry(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "pmid long")
    landed = spark.createDataFrame([(2,), (2,)], "pmid long")
    assert {r[0] for r in retrieval.to_retry(asked, landed).collect()} == {1, 3}
    flags = {(r["pmid"], r["downloaded"]) for r in retrieval.flag_downloaded(asked, landed).collect()}
    assert flags == {(1, False), (2, True), (3, False)}
    assert retrieval.append_retried(landed, retrieval.to_retry(asked, landed)).count() == 4
