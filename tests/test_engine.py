"""Changes, streams, plans and the entry module."""

import os
import subprocess
import sys
import zipfile

import pytest
from pyspark import SparkFiles
from pyspark.sql import functions as F

import __spark_entry__
from quarrylane import session
from quarrylane.operators import mutations as M
from quarrylane.plans import quality, retrieval
from quarrylane.session import clear, shared_dir
from quarrylane.session import table as written
from quarrylane.sources import files, schemas
from quarrylane.sources.entities import entity, table
from quarrylane.streaming import ingest


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_and_registration(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_a_session():
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 150"], cwd=".", check=False).returncode == 0


def test_filters_reach_the_scan(spark, sf):
    scan = plan(table(spark, sf, "lineitem").where("l_quantity > 40").select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in scan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in scan
    audits = plan(entity(spark, sf, "audits").where("model = 'R'").groupBy("tier").count())
    assert "EqualTo(l_returnflag,R)" in audits and "l_extendedprice" not in audits


def test_top_k_is_cut_before_the_shuffle(spark, sf):
    text = plan(__spark_entry__.queries()["s01_dense_topk"](spark, sf))
    assert "WindowGroupLimit" in text and "CartesianProduct" not in text


def test_upsert_and_stage(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, stage string")
    got = M.upsert(base, spark.createDataFrame([(2, "x"), (3, "y")], "id long, stage string"), "id")
    assert sorted(got.collect()) == [(1, "a"), (2, "x"), (3, "y")]
    rows = M.update_stage(base.withColumn("status", F.lit("s")), spark.createDataFrame([(1, "n"), (9, "z")], "id long, stage string"))
    assert sorted(map(tuple, rows.select("id", "stage", "status").collect())) == [(1, "n", "n"), (2, "b", "s")]


def test_stream_upserts_by_version_and_is_idempotent(spark):
    folder = shared_dir(spark)
    schema = "id long, stage string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).coalesce(1).write.parquet(f"{folder}/in/1")
    arriving = lambda: spark.readStream.schema(schema).parquet(f"{folder}/in/*")
    batch = ingest.upsert_into(f"{folder}/store", "id", lambda d: d)
    ingest.drain(arriving(), batch, f"{folder}/state")
    spark.createDataFrame([(2, "c"), (3, "d")], schema).coalesce(1).write.parquet(f"{folder}/in/2")
    ingest.drain(arriving(), batch, f"{folder}/state")
    ingest.drain(arriving(), batch, f"{folder}/state")
    assert sorted(map(tuple, ingest.latest_versions(spark, f"{folder}/store").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert ingest.latest_versions(spark, f"{folder}/none") is None


def test_streams_share_a_store_and_it_is_compacted(spark):
    folder, schema = shared_dir(spark), "id long, stage string"
    batch = ingest.upsert_into(f"{folder}/store", "id", lambda d: d)
    for k, rows in enumerate(([(1, "a"), (2, "b")], [(9, "z"), (2, "later")])):  # two streams, whose batches have the same numbers
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in{k}/1")
        ingest.drain(spark.readStream.schema(schema).parquet(f"{folder}/in{k}/*"), batch, f"{folder}/state{k}")
    want = [(1, "a"), (2, "later"), (9, "z")]
    latest = lambda: sorted(map(tuple, ingest.latest_versions(spark, f"{folder}/store").collect()))
    assert latest() == want
    assert ingest.compact(spark, f"{folder}/store") == 2 and latest() == want
    assert ingest.compact(spark, f"{folder}/store") == 1 and latest() == want
    assert ingest.compact(spark, f"{folder}/none") == 0


def test_the_package_ships_from_a_folder_that_cannot_be_written(spark, monkeypatch, tmp_path):
    def refuse(*_, **__):
        raise OSError("Read-only file system")

    monkeypatch.setattr("py_compile.compile", refuse)
    monkeypatch.setattr(session, "_SHIPPED", set())
    sent = []
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, path: sent.append(path))
    session.ship(spark)
    names = zipfile.ZipFile(sent[0]).namelist()
    assert "quarrylane/session.py" in names and "quarrylane/plans/lexical.py" in names and all(n.endswith(".py") for n in names)


def test_tables_are_cleared_after_use(spark):
    with session.cleared(spark):
        path = written(spark.range(3)).inputFiles()[0].removeprefix("file:").replace("///", "/")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_latency_is_nearest_rank(spark):
    df = spark.createDataFrame([("m", x) for x in (5, 1, 3, 2, 4)] + [("one", 9)], "model string, ms long")
    got = {r.model: r for r in quality.latency(df, "ms", ["model"]).collect()}
    assert got["m"].p95 == 5 and got["m"].median == 3.0 and got["one"].p95 == 9


def test_retries(spark):
    rows = spark.createDataFrame([(1, True, 0), (2, False, 1), (3, False, 5)], "id long, ok boolean, attempts int")
    done, again, lost = ingest.with_retries(rows, "ok")
    assert [r.id for r in done.collect()] == [1] and [(r.id, r.delay_s) for r in again.collect()] == [(2, 4.0)] and [r.id for r in lost.collect()] == [3]


def test_files_and_schemas(spark):
    folder = shared_dir(spark)
    files.export_csv(spark.createDataFrame([("Applied", 3)], "stage string, n long"), folder, {"stage": "Stage", "n": "Count"})
    assert spark.read.option("header", True).csv(folder).columns == ["Stage", "Count"]
    assert "timeline" in schemas.profile().names and len(schemas.table_schema("scoring_audits")) == 18
    assert files.as_json(spark.createDataFrame([(1, "a")], "id long, s string")).first().body == '{"id":1,"s":"a"}'


def test_the_package_goes_out_as_an_archive(spark):
    assert [x for x in spark.sparkContext._python_includes if x.endswith("quarrylane.zip")] == ["quarrylane.zip"]
    script = "import sys; sys.path.insert(0, sys.argv[1]); import quarrylane.plans.retrieval as r; assert 'quarrylane.zip' in r.__file__"
    archive = os.path.join(SparkFiles.getRootDirectory(), "quarrylane.zip")
    assert subprocess.run([sys.executable, "-c", script, archive], cwd="/", check=False).returncode == 0


def test_shared_folder_is_asked_for_on_a_cluster_and_cleared():
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Cluster:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "app"
            getConf = staticmethod(dict)

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Cluster)
    Cluster.conf["spark.checkpoint.dir"] = "hdfs:///work/"
    assert shared_dir(Cluster).startswith("hdfs:///work/quarrylane-app/")


def test_clear_removes_written_tables(spark):
    df = written(spark.range(3))
    path = df.inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path.replace("///", "/"))
    clear(spark)
    assert not os.path.exists(path.replace("///", "/"))


def test_texts_are_cut_into_terms_once(spark, sf):
    docs = table(spark, sf, "documents")
    assert retrieval.postings_of(docs)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    index = retrieval.lexical_index(docs)
    queries = docs.limit(3).select(F.col("doc_id").alias("query_id"), "text")
    scores = retrieval.lexical_scores(index, queries)._jdf.queryExecution().optimizedPlan().toString()
    assert scores.count("regexp_extract_all") == 1  # the queries' own


def test_an_index_grows_by_new_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "the of")], "doc_id long, text string"))
    path = shared_dir(spark)
    whole = retrieval.lexical_index(docs)
    retrieval.lexical_index(docs.where("doc_id % 2 = 0"), path=path)
    grown = retrieval.extend_index(docs.where("doc_id % 2 <> 0"), path)
    assert whole.stats.collect() == grown.stats.collect() and whole.stats.first().n == docs.count()
    rounded = lambda index: sorted(map(tuple, index.terms.select("term", "df", F.round("idf", 9)).collect()))
    assert rounded(whole) == rounded(grown)
    assert whole.postings.count() == retrieval.open_index(spark, path).postings.count()
