"""Sinks that survive a crash and a rerun."""

import pytest

from linkloom.sources import writers


def ids(spark, path):
    return sorted(r.id for r in spark.read.parquet(path).collect())


def test_replace_swaps_whole_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.replace(spark.range(3), path)
    assert ids(spark, path) == [0, 1, 2]
    writers.replace(spark.read.parquet(path).where("id > 0"), path)  # reads what it replaces
    assert ids(spark, path) == [1, 2]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


@pytest.mark.parametrize("cut", ["write", "first rename", "second rename", "delete"])
def test_a_cut_off_replace_leaves_old_or_new_rows(spark, tmp_path, monkeypatch, cut):
    path = str(tmp_path / "t")
    writers.replace(spark.range(3), path)
    fs, target, staged, previous = writers._paths(spark, path)
    if cut == "write":
        writers.parquet(spark.range(7), str(staged), "errorifexists")
    else:
        writers.parquet(spark.range(7), str(staged), "errorifexists")
        fs.rename(target, previous)
        if cut != "first rename":
            fs.rename(staged, target)
        if cut == "delete":
            fs.delete(previous, True)
    writers.recover(spark, path)
    assert ids(spark, path) == (list(range(7)) if cut in ("second rename", "delete") else [0, 1, 2])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    writers.replace(spark.range(5), path)
    assert ids(spark, path) == list(range(5))


def test_a_batch_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "links")
    for batch, n in (("a", 3), ("b", 2), ("a", 3), ("b", 4)):
        writers.append_once(spark.range(n), path, batch)
    rows = spark.read.parquet(path).groupBy("batch").count().collect()
    assert {(r.batch, r["count"]) for r in rows} == {("a", 3), ("b", 4)}
    with pytest.raises(ValueError):
        writers.append_once(spark.range(1).withColumnRenamed("id", "batch"), path, "a")
