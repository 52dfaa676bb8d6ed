"""Quoted files read in byte ranges give the rows of the whole-file reader."""

import random

import pytest

from linkloom.sources import quoted, readers, schemas

SCHEMA = "id long, a string, b string"


@pytest.fixture
def narrow(spark):
    """Byte ranges of a few hundred bytes, so that records and whole ranges lie inside one field."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def written(rng, rows):
    field = lambda: "".join(rng.choice(['x', ' ', ',', '""', '\n', 'é', 'word ']) for _ in range(rng.choice([0, 5, 30, 400])))
    return "id,a,b\n" + "".join(f'{i},"{field()}","{field()}"\n' for i in range(rows))


@pytest.mark.parametrize("seed", range(2))
def test_same_rows_as_one_task_per_file(spark, tmp_path, narrow, seed):
    rng = random.Random(seed)
    for k in range(2):
        (tmp_path / f"f{k}.csv").write_text(written(rng, 40))
    schema = spark.createDataFrame([], SCHEMA).schema
    got = quoted.read(spark, str(tmp_path), schema)
    whole = spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    key = lambda r: tuple(map(str, r))
    assert sorted(got.collect(), key=key) == sorted(whole.collect(), key=key)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20


def test_article_files_in_ranges(spark, tmp_path, narrow):
    names = schemas.ARTICLE_FILE.fieldNames()
    rows = ["".join([str(i), ",2020", f',"t{i}\nsecond ""line"""', ',"' + "long\n" * 80 + '"', ",x" * (len(names) - 4)]) for i in range(20)]
    (tmp_path / "PubMed_Data1.csv").write_text("\n".join([",".join(names), *rows[:10], ",".join(names), *rows[10:]]) + "\n")
    key = lambda r: tuple(map(str, r))
    got = readers.article_files(spark, str(tmp_path)).collect()
    assert len(got) == 20 and sorted(got, key=key)[0]["title"].startswith("t0\nsecond")
    whole = readers.article_files(spark, str(tmp_path), split=False).collect()
    assert sorted(got, key=key) == sorted(whole, key=key)
