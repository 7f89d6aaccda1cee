"""Tools as table functions: reports over parts, empty tables, the count of calls."""

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skein.functions.mixing import container_seed, shuffled_key, splitmix64
from skein.operators.tools import Toolbox
from skein.plans.views import decoded, reply_text


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def test_tools_and_their_count(spark):
    box = Toolbox(spark)
    docs = spark.createDataFrame([("a", "B.txt", None, 2, "x", "text", "b."), ("a", "A.txt", 3, 1, "y", "pdf", "b."), ("b", None, None, 0, None, None, "zz")], "container string, name string, pages int, chunks int, added string, type string, asked string")
    lines = {(r.container, r.place): r.line for r in box.call("list_documents", docs).collect()}
    assert lines["a", 0] == "Available documents (2):\n" and lines["a", 1] == "1. A.txt\n   - Pages: 3\n   - Chunks: 1\n   - Added: y\n" and len(lines) == 5
    assert {r.asked: r.document for r in box.call("summarize_document", docs).collect()} == {"b.": "B.txt", "zz": None}
    hits = spark.createDataFrame([(1, 1, "n", 4, 0.9, "t" * 601), (1, 2, None, None, 0.35, None), (1, 3, "n", None, 0.34, "x"), (2, 1, "n", None, None, "x")], "question long, rank int, name string, page int, similarity double, content string")
    assert [r.line for r in box.call("search_results", hits).orderBy("place").collect()] == ["[1] From n, p. 4 (Relevance: 90.0%):\n" + "t" * 600 + " [...]", "[2] From Unknown (Relevance: 35.0%):\n"]
    assert box.call("search_results", hits.limit(0)).count() == 0
    with pytest.raises(KeyError):
        box.call("none", hits)
    assert {r.tool: r.calls for r in box.counts().collect()} == {"list_documents": 1, "search_results": 2, "summarize_document": 1}


def test_splitmix_is_the_known_generator(spark):
    def known(state):
        m = (1 << 64) - 1
        z = (state + 0x9E3779B97F4A7C15) & m
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & m
        z = (z ^ z >> 27) * 0x94D049BB133111EB & m
        return z ^ z >> 31

    values = [0, 1, -1, 1 << 62, -(1 << 63), (1 << 63) - 1, 123456789]
    df = spark.createDataFrame([(v,) for v in values], "s long")
    assert [r[0] & (1 << 64) - 1 for r in df.select(splitmix64(df.s)).collect()] == [known(v & (1 << 64) - 1) for v in values]
    keys = spark.range(5000).select(shuffled_key(F.lit(1).cast("long"), F.col("id")).alias("k"))
    assert keys.distinct().count() == 5000
    ids = spark.createDataFrame([("00000000-0000-0001-0000-000000000002",), ("12345678-1234-1234-1234-567812341234",), ("FFFFFFFF-FFFF-FFFF-0000-000000000000",)], "u string")
    assert [r[0] for r in ids.select(container_seed(ids.u)).collect()] == [3, 0x1234567812341234 ^ 0x1234567812341234 or 0x9E3779B97F4A7C15 - (1 << 64), -1]


def test_broken_values_have_a_problem(spark):
    df = spark.createDataFrame([('{"tag":"view","type":"t"}',), ('{"tag":"view"}',), ('{"tag":"x"}',), ("{",), (None,), ("[]",), ('{"tag":"click","id":7}',)], "t string")
    assert [(r.x.tag, r.x.problem) for r in df.select(decoded(df.t).alias("x")).collect()] == [("view", None), (None, "field missing"), (None, "unknown tag"), (None, "broken"), (None, "broken"), (None, "no tag"), ("click", None)]
    j = spark.createDataFrame([('{"choices":[{"delta":{"content":"a"},"text":"b"}]}',), ('{"content":"c","usage":{"output_tokens":3}}',), ('{"choices":[]}',), ("x",)], "t string")
    assert [(r.x.text, r.x.form, r.x.tokens) for r in j.select(reply_text(j.t).alias("x")).collect()] == [("a", "delta", None), ("c", "content", 3), (None, None, None), (None, None, None)]
