"""The chunk store, its cache, and embeddings."""

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skein.functions import embedding
from skein.operators import store


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def test_store_of_chunks(spark, tmp_path):
    router = store.Router(spark, str(tmp_path), 4)
    s = router.store("a")
    assert s is router.store("a") and s.count() == 0 and router.store("b").count() == 0
    q = spark.createDataFrame([(1, [0.1] * 4)], "query_id long, embedding array<double>")
    assert s.search(q, 5).count() == 0
    rows = [(1, 10, "one", [0.1] * 4), (2, 10, "two", [1.0, 0.0, 0.0, 0.0]), (3, 11, "three", [0.0, 1.0, 0.0, 0.0])]
    s.upsert(spark.createDataFrame(rows, store.SCHEMA))
    assert s.count() == 3
    best = s.search(q, 1).collect()[0]
    assert best.chunk_id == 1 and best.similarity > 0.99 and best.rank == 1
    with pytest.raises(ValueError):
        s.upsert(spark.createDataFrame([(4, 1, "x", [0.0] * 4), (5, 1, "y", [0.0] * 3)], store.SCHEMA))
    s.upsert(spark.createDataFrame([(1, 10, "one again", [0.5] * 4)], store.SCHEMA))
    assert sorted((r.chunk_id, r.content) for r in s.all().collect()) == [(1, "one again"), (2, "two"), (3, "three")]
    s.delete_document(10)
    assert [r.chunk_id for r in s.all().collect()] == [3] and router.store("b").count() == 0
    s.clear()
    assert s.count() == 0


def test_cache_of_questions(spark):
    c = spark.createDataFrame([(1, 100.0, [1.0, 0.0]), (2, 390.0, [1.0, 0.01]), (3, 395.0, [1.0, 0.0]), (4, 396.0, [0.0, 1.0])], "entry long, ts double, embedding array<double>")
    q = spark.createDataFrame([(7, [2.0, 0.0]), (8, [1.0, 1.0])], "query_id long, embedding array<double>")
    assert [(r.query_id, r.entry) for r in store.cached(q, c, 500.0).collect()] == [(7, 2)]


def test_embeddings(spark):
    d = spark.createDataFrame([(1, "Test text for validation"), (2, ""), (3, "Red fox red unknown")], "doc_id long, text string")
    got = {r.doc_id: r for r in embedding.embed(d, "no such provider").collect()}
    assert len(got[1].embedding) == 512 and abs(sum(x * x for x in got[1].embedding) - 1) < 1e-9
    assert got[2].embedding is None and got[2].error == "empty_input"
    v = spark.createDataFrame([("red", [1.0, 0.0]), ("Red", [4.0, 0.0]), ("fox", [0.0, 2.0])], "word string, embedding array<double>")
    mean = {r.doc_id: r.embedding for r in embedding.word_average(d, v).collect()}
    assert mean == {3: [5 / 3, 2 / 3]}
    bad = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [1.0, float("inf")]), (3, [1.0]), (4, [0.0, 0.0]), (5, [1.0, 0.0]), (6, None)], "i long, e array<double>")
    assert {r.i: r.p for r in bad.select("i", embedding.problem(F.col("e"), 2).alias("p")).collect()} == {1: "nan", 2: "infinite", 3: "dimension", 4: "low_energy", 5: None, 6: "dimension"}
