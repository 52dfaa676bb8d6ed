"""Names of blocks and texts depend on the set of texts only."""

from linkloom.llm import exact_dedup


def names(docs, **options):
    return {r.doc_id: (r.n_blocks, r.name, r.keep_id, r.kept) for r in exact_dedup.name_documents(docs, **options).collect()}


def test_names_do_not_depend_on_how_the_rows_are_dealt(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    width = spark.conf.get("spark.sql.shuffle.partitions")
    for options in ({"block_bytes": 256}, {"block_bytes": 256, "hash_bits": 6}):
        want = names(docs, **options)
        try:
            spark.conf.set("spark.sql.shuffle.partitions", "3")
            assert names(docs.repartition(5, "text"), **options) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", width)
        assert len({v[:2] for v in want.values()}) == docs.select("text").distinct().count()


def test_names_are_dense(spark):
    docs = spark.createDataFrame([(i, chr(97 + i % 7) * 10) for i in range(40)], "doc_id long, text string")
    got = names(docs, block_bytes=16)
    assert {v[:2] for v in got.values()} == {(1, k) for k in range(7)} and {v[2] for v in got.values()} == set(range(7))
