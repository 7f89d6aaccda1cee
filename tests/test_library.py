"""Commits over several tables, containers with cascade and totals, and files taken in batch by batch."""

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skein.operators.commits import Commits, Conflict
from skein.operators.library import TABLES, Library, scan_json, sink_json
from skein.operators.store import SCHEMA, ChunkStore
from skein.sources import files
from skein.streaming import ingest


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_commits_are_whole_or_nothing(spark, tmp_path):
    c = Commits(spark, str(tmp_path), {"a": ("k string, x int", ("k",)), "b": ("k string, y int", ("k",))})
    frame = lambda table, *r: spark.createDataFrame(list(r), c.tables[table][0])
    assert rows(c.read("a")) == [] and c.versions() == []
    one = c.begin()
    one.replace("a", frame("a", ("p", 1), ("q", 2)), {"k=p", "k=q"})
    one.replace("b", frame("b", ("p", 3)), {"k=p"})
    assert rows(c.read("a")) == []  # nobody sees it yet
    assert one.put() == 1 and rows(c.read("a")) == [("p", 1), ("q", 2)] and rows(c.read("a", k="q")) == [("q", 2)]
    two, three, four = c.begin(), c.begin(), c.begin()
    two.replace("a", frame("a", ("p", 10)), {"k=p"})
    three.replace("a", frame("a", ("q", 20)), {"k=q"})
    four.replace("b", frame("b", ("p", 30)), {"k=p"})
    four.drop("a", {"k=p"})
    assert two.put() == 2 and three.put() == 3  # different units: the later goes on above the earlier
    with pytest.raises(Conflict):
        four.put()
    assert rows(c.read("a")) == [("p", 10), ("q", 20)] and rows(c.read("b")) == [("p", 3)]
    assert rows(c.read("a", 1)) == [("p", 1), ("q", 2)]  # a reader of an older version
    broken = c.begin()
    with pytest.raises(ValueError):
        broken.replace("a", frame("a", ("z", 1)), {"k=p"})
    with pytest.raises(Exception):
        c.begin().replace("a", frame("a", ("p", 1)).select("k", F.raise_error(F.lit("no")).cast("int").alias("x")), {"k=p"})
    assert rows(c.read("a")) == [("p", 10), ("q", 20)] and c.versions() == [1, 2, 3]
    assert not c._put(3, {"meta": {}, "units": {}})  # the number is taken
    assert c.vacuum(keep=1, age=-10) > 0 and rows(c.read("a")) == [("p", 10), ("q", 20)] and c.versions() == [3]


def filled(spark, path):
    lib = Library(spark, path)
    lib.create_container("one", "First", 2)
    lib.create_container("two", "Second", 2, strict=False)
    d = spark.createDataFrame([("d1", "n1", "text", "s1", 3), ("d2", "n2", "text", "s2", 4)], "document_id string, name string, type string, sha256 string, n_chars long")
    ch = [("d1", 0, "aa", [1.0, 0.0]), ("d1", 1, "bbb", [0.0, 1.0]), ("d2", 0, "é", [1.0, 1.0])]
    lib.put("one", d, spark.createDataFrame(ch, "document_id string, chunk_index int, content string, embedding array<double>"))
    return lib, d


def test_documents_go_with_their_chunks_and_totals(spark, tmp_path):
    lib, d = filled(spark, str(tmp_path))
    total = lambda: {r.container_id: (r.total_documents, r.total_chunks, r.size_bytes) for r in lib.containers().collect()}
    assert total() == {"one": (2, 3, 7), "two": (0, 0, 0)}
    assert rows(lib.documents("one").select("document_id", "n_chunks")) == [("d1", 2), ("d2", 1)]
    lib.put("one", d.filter("document_id = 'd1'"), spark.createDataFrame([("d1", 0, "new", [0.5, 0.5]), ("d9", 0, "not of the batch", [0.5, 0.5])], "document_id string, chunk_index int, content string, embedding array<double>"))
    assert rows(lib.chunks("one").select("document_id", "content")) == [("d1", "new"), ("d2", "é")] and total()["one"] == (2, 2, 5)
    q = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, embedding array<double>")
    assert [r.document_id for r in lib.search("one", q, 2).orderBy("rank").collect()] in (["d1", "d2"], ["d2", "d1"])
    assert lib.search("two", q, 2).count() == 0
    for bad in ([1.0], [float("nan"), 0.0], [float("inf"), 0.0]):
        with pytest.raises(ValueError):
            lib.put("one", d, spark.createDataFrame([("d1", 0, "x", bad)], "document_id string, chunk_index int, content string, embedding array<double>"))
    assert total()["one"] == (2, 2, 5)
    lib.remove_documents("one", spark.createDataFrame([("d2",), ("none",)], "document_id string"))
    assert total()["one"] == (1, 1, 3) and rows(lib.chunks().select("document_id")) == [("d1",)]
    lib.update_container("one", name="Renamed", strict=False)
    assert [tuple(r)[1:5] for r in lib.containers().filter("container_id = 'one'").collect()] == [("Renamed", 2, False, 1)]
    with pytest.raises(ValueError):
        lib.update_container("one", total_chunks=7)
    with pytest.raises(ValueError):
        lib.create_container("one", "again")
    with pytest.raises(ValueError):
        lib.create_container("../x", "bad name")
    with pytest.raises(KeyError):
        lib.clear("none")
    lib.clear("one")
    assert total() == {"one": (0, 0, 0), "two": (0, 0, 0)}
    lib.delete_container("one")
    assert total() == {"two": (0, 0, 0)} and lib.delete_container("two") is None and total() == {"two": (0, 0, 0)}


def test_two_writers_of_a_container(spark, tmp_path):
    lib, d = filled(spark, str(tmp_path))
    first = lib.store.begin()
    lib._totals(first, lib._row(first, "one"))
    lib.remove_documents("one", spark.createDataFrame([("d2",)], "document_id string"))
    with pytest.raises(Conflict):
        first.put()
    sink_json(lib.containers(), str(tmp_path / "json"))
    assert rows(scan_json(spark, str(tmp_path / "json"), "containers")) == rows(lib.containers())
    line = spark.read.text(str(tmp_path / "json")).first()[0]
    assert line.index('"container_id"') < line.index('"dimension"') < line.index('"total_chunks"')


def test_a_stores_failed_write_leaves_it_readable(spark, tmp_path):
    s = ChunkStore(spark, str(tmp_path), 2)
    s.upsert(spark.createDataFrame([(i, i % 3, f"c{i}", [float(i), 1.0]) for i in range(40)], SCHEMA))
    with pytest.raises(Exception):
        s.upsert(spark.createDataFrame([(1, 1, "x", [1.0, 1.0])], SCHEMA).withColumn("content", F.raise_error(F.lit("no"))))
    with pytest.raises(ValueError):
        s.upsert(spark.createDataFrame([(1, 1, "x", [float("nan"), 1.0])], SCHEMA))
    assert s.count() == 40
    before = s.store.manifest()[1]["units"]["chunks"]
    s.upsert(spark.createDataFrame([(7, 1, "new", [1.0, 1.0])], SCHEMA))
    after = s.store.manifest()[1]["units"]["chunks"]
    assert sum(before[u] != after[u] for u in before) == 1 and s.count() == 40  # one part was written anew
    s.delete_document(1)
    assert s.count() == 27 and s.all().filter("document_id = 1").count() == 0


def test_files_come_in_once_with_quota_and_quarantine(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    lib.create_container("c", "C")
    box = tmp_path / "in"
    box.mkdir()
    texts = {"a.txt": b"A first text of some words. " * 40, "b.md": b"Short one.", "c.pdf": b"%PDF-1.4", "d.docx": b"PK\x03\x04..", "e.txt": b"  ", "f.rtf": rb"{\rtf1 caf\'e9 na\u239?ve \u-10179?\u-8704? \{x\}\par end}"}
    for name, content in texts.items():
        (box / name).write_bytes(content)

    def run():
        ingest.add_documents(spark, lib, "c", str(box), str(tmp_path / "check"), 4).awaitTermination()

    run()
    docs = {r.name: r for r in lib.documents("c").collect()}
    assert sorted(docs) == ["a.txt", "b.md", "f.rtf"] and docs["b.md"].n_chunks == 1 and docs["a.txt"].type == "text"
    assert {(r.path.rsplit("/", 1)[1], r.error) for r in lib.quarantine().collect()} == {("c.pdf", "image_only_pdf"), ("d.docx", "office_format_needs_conversion"), ("e.txt", "empty_document")}
    assert [r.content for r in lib.chunks("c").filter(F.col("document_id") == docs["f.rtf"].document_id).collect()] == ["café naïve 😀 {x}\nend"]
    version = lib.store.manifest()[0]
    run()  # nothing new
    assert lib.store.manifest()[0] == version
    (box / "g.txt").write_bytes(b"One more text.")
    (box / "h.txt").write_bytes(b"Beyond the limit.")
    run()
    assert sorted(r.name for r in lib.documents("c").collect()) == ["a.txt", "b.md", "f.rtf", "g.txt"]
    assert [r.path.rsplit("/", 1)[1] for r in lib.quarantine().filter("error = 'quota_reached'").collect()] == ["h.txt"]
    last = lib.store.manifest()[0]
    raw = spark.createDataFrame([(str(box / "z.txt"), b"A late repeat of a batch.")], "path string, content binary")
    ingest.add_batch(lib, "c", 100, None, f"files:c:{tmp_path / 'check'}", raw, 1)
    assert lib.store.manifest()[0] == last  # the batch was noted with its commit
    changed = spark.createDataFrame([(lib_path, b"Short one, changed.") for lib_path in [f"file:{box}/b.md"]], "path string, content binary")
    ingest.add_batch(lib, "c", 4, None, "other", changed, 0)
    assert lib.containers().first().total_documents == 4
    assert ingest.document_limit("free", 2) == 60


def test_every_error_of_a_file(spark):
    cases = {
        "a.pdf": (b"no", "pdf_load_failed"), "b.pdf": (b"%PDF-1", "image_only_pdf"), "c.png": (b"no", "image_load_failed"), "d.gif": (b"GIF89a", "ocr_failed"), "e.rtf": (b"no", "rtf_parse_failed"), "f.doc": (b"x", "legacy_office_format"),
        "g.docx": (b"no zip", "corrupted_file"), "h.xlsx": (b"PK\x03\x04", "office_format_needs_conversion"), "i.pages": (b"PK\x03\x04", "iwork_extraction_failed"), "j.zzz": (b"\xff\x00", "unsupported_format"), "k.zzz": (b"\xff\xfe", "unsupported_encoding"), "l.txt": (b" ", "empty_document"), "m.txt": (None, "file_not_found"),
    }
    raw = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "path string, content binary")
    assert {r.path: r.error for r in files.extracted(raw).collect()} == {k: v[1] for k, v in cases.items()} and {v[1] for v in cases.values()} == set(files.ERRORS)
    assert set(TABLES) == {"containers", "documents", "chunks", "quarantine"}
