import pyarrow as pa

from linkloom.operators import features, scoring


def test_tasks_grow_with_the_text(spark, monkeypatch):
    monkeypatch.setattr(features, "CHARS_PER_TASK", 10)
    corpus = spark.createDataFrame([("web", i, "some words here") for i in range(100)], "side string, id long, txt string")
    terms = features.doc_terms(corpus, keys=("side", "id"))
    assert terms.rdd.getNumPartitions() == 150 and terms.count() == 300



def test_links_are_scored_a_few_at_a_time(spark, monkeypatch):
    seen, whole = [], scoring._cosines
    monkeypatch.setattr(scoring, "_cosines", lambda batch: seen.append(batch.num_rows) or whole(batch))
    n = 3 * scoring.LINKS_AT_ONCE + 1
    lists = [pa.array([[1, i] for i in range(2, n + 2)], pa.list_(pa.int64())), pa.array([[1.0, 1.0]] * n)] * 2
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), *lists], ["web_id", "pmid", "terms", "weights", "pm_terms", "pm_weights"])
    got = pa.Table.from_batches(list(scoring._score_known(iter([batch]))))
    assert got.num_rows == n and max(seen) <= scoring.LINKS_AT_ONCE and set(got.column("cos").to_pylist()) == {1.0}
