import pytest
from pyspark.sql import functions as F

from linkloom.operators import cleansing
from linkloom.sources import readers, schemas, writers


def test_id_list_reads_first_column(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("30,x,y\n10\n20,z\n")
    assert [r["pmid"] for r in readers.id_list(spark, str(tmp_path / "ids.csv")).collect()] == [10, 20, 30]


def test_article_files_drop_repeated_headers(spark, tmp_path):
    head = "PMID,Year,Title,Abstract,Authors,Journal,Volume,Issue,Pages,DOI,PMC\n"
    (tmp_path / "articles_1.csv").write_text(
        head + '1,2001,"T, ""q""","two\nlines",A,J,1,2,3-4,d,None\n' + head + "2,None,nan,n/a,,J,1,2,3,d,77\n"
    )
    (tmp_path / "articles_2.csv").write_text(head + "3,2003,x,y,A,J,1,2,3,d,5\n")
    got = {r["pmid"]: r for r in readers.article_files(spark, f"{tmp_path}/articles_*.csv").collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["title"] == 'T, "q"' and got[1]["abstract"] == "two\nlines" and got[1]["pmc"] is None
    assert got[2]["year"] is None and got[2]["title"] is None and got[2]["abstract"] is None and got[2]["authors"] is None
    assert got[2]["pmc"] == "77"


def test_page_file_ignores_bad_bytes_and_extra_columns(spark, tmp_path):
    (tmp_path / "pages.tsv").write_bytes(b"processed_content\tfinal_url\tpmid\textra\nab\xffc\thttp://u\t7\tz\n")
    row = readers.page_file(spark, str(tmp_path / "pages.tsv")).first()
    assert (row["processed_content"], row["final_url"], row["pmid"]) == ("abc", "http://u", 7)


def test_article_records(spark, tmp_path):
    (tmp_path / "set.xml").write_text(
        """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">12</PMID><Article>
<Journal><JournalIssue><Volume>3</Volume><PubDate><Year>1999</Year></PubDate></JournalIssue>
<ISOAbbreviation>J X</ISOAbbreviation></Journal><ArticleTitle>Title</ArticleTitle>
<Abstract><AbstractText>one</AbstractText><AbstractText>two</AbstractText></Abstract>
<AuthorList><Author><LastName>Roe</LastName><Initials>A</Initials></Author>
<Author><LastName>Doe</LastName><Initials>B</Initials></Author></AuthorList></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>13</PMID></MedlineCitation></PubmedArticle></PubmedArticleSet>"""
    )
    got = {r["PMID"]: r.asDict() for r in readers.article_records(spark, str(tmp_path / "set.xml")).collect()}
    assert got["12"] == {
        "PMID": "12", "Year": "1999", "Title": "Title", "Abstract": "one two", "Authors": "Roe A, Doe B",
        "Journal": "J X", "Volume": "3", "Issue": "None", "Pages": "None", "DOI": "10.1/x", "PMC": "None",
    }
    assert set(got["13"].values()) == {"13", "None"}


def test_tables_replace_append_and_scripts(spark):
    df = spark.createDataFrame([(1, "u")], schemas.PAGE_LINKS)
    writers.replace_table(df, "links_t")
    writers.append_table(df, "links_t")
    assert readers.table(spark, "links_t").count() == 2
    writers.replace_table(df, "links_t")
    one, two = readers.run_scripts(spark, ["select * from links_t", "select count(*) as n from links_t"])
    assert one.count() == 1 and two.first()["n"] == 1
    assert isinstance(readers.run_scripts(spark, "select 1 as x"), list)


def test_matrix_parts_are_pruned(spark, tmp_path):
    path = str(tmp_path / "m")
    for size in (2, 3):
        df = spark.createDataFrame([("web", "Test", 1, [0.5] * size)], "side string, split string, id long, vec array<double>")
        writers.matrix(df.withColumns({"feature": F.lit("TF"), "tsvd": F.lit(size)}), path)
    part = readers.matrix(spark, path, tsvd=3, side="web")
    assert [len(r["vec"]) for r in part.collect()] == [3]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tsvd" in plan or "PartitionFilters: [isnotnull(side" in plan


def test_results_csv_round_trip(spark, tmp_path):
    rows = [("TF", "T-SVD", 2, 1.0, 200, True, 50, 9, 4.0, 1.0, 8.0, 10.0, 60.0, 100.0), ("TF", "T-SVD", 2, 1.0, 100, True, 50, 9, 5.0, 1.0, 8.0, 10.0, 60.0, 100.0)]
    path = str(tmp_path / "results")
    writers.csv(spark.createDataFrame(rows, schemas.RESULTS), path)
    got = [tuple(r) for r in readers.results(spark, path).collect()]
    assert got == [(100, 50, 5.0), (200, 50, 4.0)]
    writers.csv(spark.createDataFrame(rows, schemas.RESULTS), path, mode="append")
    assert readers.results(spark, path).count() == 4


def test_conform_rename_preview(spark, tmp_path):
    raw = spark.createDataFrame([("1", "x"), ("bad", None)], "PMID string, Final_URL string")
    out = readers.conform(readers.rename_all(raw), schemas.PAGE_LINKS)
    assert out.schema == schemas.PAGE_LINKS and [r["pmid"] for r in out.collect()] == [1, None]
    assert readers.rename_all(raw, ["a", "b"]).columns == ["a", "b"]
    assert len(readers.preview(spark.range(20), 5).collect()) == 5
    writers.parquet(out, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert cleansing.standardise_nulls(raw.na.fill("n/a")).where("Final_URL is null").count() == 1


def test_checkpoint_root_is_reused(spark):
    from linkloom.runtime import checkpoint_root, cut, materialize

    assert checkpoint_root(spark) == spark.sparkContext.getCheckpointDir()
    df = spark.range(10).repartition(3)
    assert cut(df).count() == 10 and materialize(df).count() == 10


def test_release_deletes_only_written_tables(spark, monkeypatch):
    from linkloom import runtime

    monkeypatch.setattr(runtime, "_written", {})
    kept = runtime.materialize(spark.range(3))
    runtime._written.clear()
    gone = runtime.materialize(spark.range(4))
    assert gone.count() == 4 and runtime.release(spark) == 1 and kept.count() == 3
    with pytest.raises(Exception):
        gone.count()


def test_pinned_filter_stays_above_the_work(spark):
    from linkloom.runtime import pinned

    df = spark.range(20).withColumn("n", F.length(F.repeat(F.lit("x"), F.col("id").cast("int"))))
    kept = pinned(df).where(F.col("n") >= 15)
    assert {r["id"] for r in kept.collect()} == set(range(15, 20))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("repeat(") == 1
