"""What the cascade moves: keys are compared alone, whole edges only where a key is taken."""

from linkloom.operators import duplicates, links

SCHEMA = "pmid long, url string, len double, row_id string"
ROWS = [(1, "a", 5.0, "r1"), (1, "b", 9.0, "r2"), (2, "b", 7.0, "r3"), (None, "b", 1.0, "r4"), (3, None, 2.0, "r5"), (4, "d", 2.0, "r6")]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_edges_without_a_taken_key_are_not_joined(spark):
    edges = spark.createDataFrame(ROWS, SCHEMA)
    taken = spark.createDataFrame([(7, "x", "r9")], "pmid long, url string, row_id string")
    free = links.not_taken(edges, taken)
    assert "Join" not in plan(free)
    assert sorted(r.row_id for r in free.collect()) == ["r1", "r2", "r3", "r4", "r5", "r6"]


def test_edges_of_taken_keys_leave(spark):
    edges = spark.createDataFrame(ROWS, SCHEMA)
    taken = spark.createDataFrame([(2, "a", "r9")], "pmid long, url string, row_id string")
    assert sorted(r.row_id for r in links.not_taken(edges, taken).collect()) == ["r2", "r4", "r5", "r6"]


def test_counts_are_taken_before_the_first_join(spark):
    counted = duplicates.with_link_counts(spark.createDataFrame(ROWS, SCHEMA), "row_id")
    got = {r.row_id: (r.pmid_count, r.url_count) for r in counted.collect()}
    assert got == {"r1": (2, 1), "r2": (2, 3), "r3": (1, 3), "r4": (None, 3), "r5": (1, None), "r6": (1, 1)}
    # rows, hot keys and sizes of either key: with the second count taken on the joined rows there were more
    assert plan(counted).count("Join") <= 5
