"""Operators without SQL, and sources and streams, on small inputs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skein.operators import chunking, clustering, ranking, retrieval
from skein.sources import files
from skein.streaming import telemetry


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def test_matches_and_proximity(spark):
    rows = [("red fox", "the red fox", 1.0, 0.5), ("warning light", "Warning: light on", 0.5, 0.5), ("alpha", "alpha", 1.0, 0.0), ("red fox", "red only", 0.5, 0.0), (None, None, 0.0, 0.0), ("red fox", "redfox", 0.0, 1.0)]
    got = spark.createDataFrame([(i, q, c) for i, (q, c, _, _) in enumerate(rows)], "i int, q string, c string")
    got = got.select("i", ranking.keyword_match(F.col("q"), F.col("c")), ranking.term_proximity(F.col("q"), F.col("c"))).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(i, k, p) for i, (_, _, k, p) in enumerate(rows)]


def test_gate_and_context(spark):
    rows = [(1, 1, 0.4, "a b c"), (1, 2, 0.3, "a b c"), (2, 1, 0.6, "a b c"), (3, 1, 0.3, "a b c"), (3, 2, 0.29, "a b c"), (4, 1, 0.36, "hi")]
    c = spark.createDataFrame([(q, i, i, s, t) for q, i, s, t in rows], "query_id long, id long, new_rank int, similarity double, query string")
    assert {r.query_id: r.decision for r in ranking.gate(c).collect()} == {1: "override", 2: "accept", 3: "fallback_ondevice_low_confidence", 4: "accept"}
    assert sorted((r.query_id, r.id) for r in ranking.gated(c, 1).collect()) == [(1, 1), (1, 2), (2, 1), (4, 1)]
    b = spark.createDataFrame([(1, 1, "x" * 90), (1, 2, "y"), (2, 1, "abc"), (2, 2, "de"), (2, 3, "f" * 90), (2, 4, "g"), (3, 1, None)], "query_id long, rank int, content string")
    got = {r.query_id: (r.n_used, r.context) for r in ranking.assemble(b.withColumn("similarity", F.lit(0.5)), 100).collect()}
    head = lambda i: f"[Document Chunk {i}, Similarity: 0.500]\n"
    assert got[1] == (1, head(1) + "x" * 90 + "\n\n---\n\n") and got[3] == (1, head(1))
    assert got[2] == (2, head(1) + "abc\n\n---\n\n" + head(2) + "de\n\n---\n\n")


def test_mmr_prefers_the_different(spark):
    rows = [(1, 1, 0.9, 1, [1.0, 0.0]), (1, 2, 0.89, 2, [1.0, 0.01]), (1, 3, 0.7, 3, [0.0, 1.0]), (2, 9, 0.5, 1, [0.0, 0.0])]
    c = spark.createDataFrame(rows, "query_id long, id long, similarity double, rank int, embedding array<double>")
    assert sorted(tuple(r) for r in ranking.mmr(c, 2).collect()) == [(1, 1, 1), (1, 3, 2), (2, 9, 1)]
    assert ranking.mmr(c.limit(0), 2).count() == 0


def test_knn_of_odd_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [1.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(7, [2.0, 0.0]), (8, None)], "query_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.similarity) for r in retrieval.knn(v, q, 3).orderBy("rank").collect()] == [(7, 1, 1.0), (7, 5, 1.0), (7, 2, 0.0)]
    assert [r.vec_id for r in retrieval.knn(v, q, 3, 0.5).orderBy("rank").collect()] == [1, 5]
    assert retrieval.knn(v, q.limit(0), 3).count() == 0


def test_chunks_of_small_texts(spark):
    small = "one two, • three"
    long = " ".join(f"w{i}{'.' if i % 7 == 6 else ''}" for i in range(900))
    d = spark.createDataFrame([(1, small), (2, ""), (3, None), (4, long)], "doc_id long, text string")
    got = chunking.chunks(d).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.content, r.semantic_density, r.has_list, r.end_position) for r in got if r.doc_id < 4] == [(1, small, 0.5, True, len(small))]
    mine = [r for r in got if r.doc_id == 4]
    assert mine[0].start_position == 0 and all(a.end_position > b.start_position for a, b in zip(mine, mine[1:]))
    assert all(r.content[-1] in ".!?" or r.end_position == len(long) for r in mine) and all(r.word_count <= 420 for r in mine)


def test_kmeans_equals_numpy(spark):
    x = np.random.default_rng(3).normal(size=(60, 4)).round(3)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.cluster for r in clustering.kmeans(v, [(i, x[i].tolist()) for i in range(3)], 5).collect()}
    c = x[:3].copy()
    for _ in range(5):
        near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.array([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(3)])
    assert got == dict(enumerate(((x[:, None] - c) ** 2).sum(2).argmin(1).tolist()))


def test_projections_equal_numpy(spark):
    x = np.random.default_rng(5).normal(size=(80, 6)) * [5, 3, 2, 1, 0.5, 0.1]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(99, [1.0])], "vec_id long, embedding array<double>")
    c = x - x.mean(0)
    want = np.linalg.svd(c, full_matrices=False)[0][:, :3] * np.linalg.svd(c, full_matrices=False)[1][:3]
    got = np.array([[r.x, r.y, r.z] for r in clustering.pca3(v, 6).orderBy("vec_id").collect()])
    assert got.shape == (80, 3) and np.allclose(np.abs(got), np.abs(want))
    r = np.array([[r.x, r.y, r.z] for r in clustering.random_projection3(v, 6).orderBy("vec_id").collect()])
    axes = np.linalg.lstsq(c, r, rcond=None)[0]
    assert np.allclose(axes.T @ axes, np.eye(3)) and np.allclose(c @ axes, r)


def test_files_and_vectors(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_bytes("é text ".encode())
    (tmp_path / "in" / "b.RS").write_bytes("é".encode("latin-1"))
    (tmp_path / "in" / "c.txt").write_bytes(b"  ")
    got = {r.path.rsplit("/", 1)[1]: (r.type, r.text) for r in files.read_texts(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.md": ("markdown", "é text"), "b.RS": ("code", "é")}
    (tmp_path / "in" / "d.png").write_bytes(b"\x89PNG")
    (tmp_path / "in" / "e.rtf").write_bytes(rb"{\rtf1{\fonttbl{\f0 Arial;}}\f0 Some \b bold\b0  text\par}")
    (tmp_path / "in" / "f.bin").write_bytes(b"\xff\xfe\x00")
    every = {r.path.rsplit("/", 1)[1]: (r.error, r.warning) for r in files.dispatch(spark, str(tmp_path / "in")).collect()}
    assert every == {"a.md": (None, "short"), "b.RS": (None, "short"), "c.txt": ("empty_document", None), "d.png": ("ocr_failed", None), "e.rtf": (None, "short"), "f.bin": ("unsupported_format", None)}
    assert [r.text for r in files.read_texts(spark, str(tmp_path / "in")).filter("path LIKE '%rtf'").collect()] == ["Some bold text"]
    v = spark.createDataFrame([(1, [0.5, 1.0], 2), (2, None, None)], "vec_id long, embedding array<float>, label int")
    files.write_vectors(v, str(tmp_path / "v"))
    assert sorted(files.read_vectors(spark, str(tmp_path / "v")).collect()) == sorted(v.collect())
    (tmp_path / "v" / "part-broken.json").write_text('{"vec_id": 3, "embedding": [1.0\n')
    assert files.read_vectors(spark, str(tmp_path / "v")).count() == 2 and files.rejects(spark, str(tmp_path / "v")).count() == 1
    t = spark.createDataFrame([("a,b\n1, 2\n3,4",), ("x\ty\n1,5\t2\n",)], "t string").select(files.table_text(F.col("t"))).collect()
    assert [r[0] for r in t] == ["Table with columns: a, b\n\nRow 1: a: 1 | b: 2\nRow 2: a: 3 | b: 4", "Table with columns: x, y\n\nRow 1: x: 1,5 | y: 2"]


@pytest.mark.parametrize("operator, mode", [(telemetry.windowed, "complete"), (telemetry.debounced, "append"), (telemetry.smoothed, "update")])
def test_streams(spark, tmp_path, operator, mode):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(seconds=s), "view", v) for s, v in ((1, 1.0), (2, 2.0), (12, 4.0), (900, 0.0))]
    schema = "ts timestamp, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    name = operator.__name__ + "_out"
    out = operator(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table(name)
    if operator is telemetry.windowed:
        assert sorted(r.n for r in got.collect()) == [1, 1, 2]
    elif operator is telemetry.debounced:
        assert [r.n for r in got.collect()] == [1, 1, 1]  # the last burst is still open
    else:
        rate = 1.0
        for v in (2.0, 4.0, 0.0):
            rate = 0.6 * v + 0.4 * rate
        assert [(r.n, round(r.rate, 9)) for r in got.collect()] == [(4, round(rate, 9))]
