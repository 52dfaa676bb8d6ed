"""What written tables leave in the local folders."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from linkloom import runtime
from linkloom.llm import near_copies


def shuffled(spark):
    """Shuffle files of the session, where Spark's own block manager keeps them."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.length()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = spark.conf.get(runtime._CLEANUP)
    held = shuffled(spark)
    table = runtime.materialize(spark.range(1000).select((F.col("id") % 7).alias("k")).groupBy("k").count())
    for _ in range(50):  # the files go a moment later
        if not shuffled(spark) - held:
            break
        time.sleep(0.1)
    assert not shuffled(spark) - held
    assert table.count() == 7 and spark.conf.get(runtime._CLEANUP) == before


def test_rows_of_mixed_keys_are_all_that_stays(spark):
    rows = runtime.materialize(spark.createDataFrame([(1, 1, 5, 0), (1, 2, 5, 0), (2, 3, 5, 0)], near_copies._KEYS))
    tree = spark.createDataFrame([], "node long, component long")
    folder = Path(runtime.checkpoint_root(spark).removeprefix("file:"))
    before = set(folder.glob("table-*"))
    assert sorted(r.node for r in near_copies._mixed(rows, tree).collect()) == [1, 2]
    assert len(set(folder.glob("table-*")) - before) == 1
