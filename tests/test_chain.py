"""The question chain: each way it can end, on lists made for it."""

import pytest
from pyspark.sql import SparkSession

from skein.operators import chain

SCHEMA = "query_id long, query string, asked string, id long, similarity double, rank int, chunk_index int, source string, content string, embedding array<double>"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def question(n, query, sims, sources, content="red fox text"):
    return [(n, query, query, 10 * n + i, s, i + 1, i, src, content, [1.0, float(i), 0.0]) for i, (s, src) in enumerate(zip(sims, sources))]


def test_each_way_a_question_ends(spark):
    long = "where does the red fox run"
    rows = question(1, long, [0.9, 0.8, 0.7, 0.6, 0.2], "abcab")  # accepted
    rows += question(2, long, [0.3, 0.29, 0.28, 0.27, 0.26], "aaaaa")  # nothing is near
    rows += question(3, long, [0.55, 0.5, 0.45, 0.44, 0.43], "aaabb")  # one at the limit, but the first is strong enough
    rows += question(4, "hello", [0.36, 0.2], ["a", None])  # trivial
    rows += question(5, long, [0.45, 0.37, 0.2, 0.1, 0.1], "aaaba")  # eased by the lead of the first
    rows += [(6, long, long, 60, 0.9, 1, 0, None, None, None)]
    got = {r.query_id: r for r in chain.answers(spark.createDataFrame(rows, SCHEMA), 3, 3).collect()}
    assert {q: r.decision for q, r in got.items()} == {1: "accept", 2: "fallback_ondevice_low_confidence", 3: "accept", 4: "accept", 5: "override", 6: "accept"}
    assert got[1].picks[0] == 10 and len(got[1].picks) == 3 and got[1].n_added == 0 and got[1].warnings == ""
    assert got[1].context.startswith("[Document Chunk 1, Similarity: 0.900]\nred fox text\n\n---\n\n[Document Chunk 2") and not got[1].context.endswith("\n")
    assert got[2].confidence == 0 and len(got[2].picks) == 3 and got[2].n_pass == 0
    assert got[3].n_pass == 1 and got[3].n_added == 1 and len(got[3].picks) == 2
    assert got[4].n_added == 1 and got[4].warnings == "Low relevance; Limited context; Generic query"
    assert got[6].picks == [60] and got[6].context == "[Document Chunk 1, Similarity: 0.900]\n" and got[6].warnings == "Limited context; Single source"
    # one row at the limit whose list leads by little and stays under 0.5 can't be: a limit of 0.52 implies an override
    strict = chain.answer_one([dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r)) for r in question(7, long, [0.53, 0.52, 0.1, 0.1, 0.1], "aabbb")], 3, 2, True, False, 3500)
    assert strict["decision"] == "accept"


def test_contexts_end_at_the_budget_and_sources_are_added(spark):
    rows = [dict(similarity=0.9 - i / 10, content="x" * 100, id=i, source=s) for i, s in enumerate("aaab")]
    text, n = chain.context_of(rows, 300)
    assert n == 2 and len(text) <= 300 and chain.context_of(rows, 1)[1] == 1
    assert [r["id"] for r in chain.covered(rows[:1], rows, 3)[0]] == [0, 3] and chain.covered(rows[:1], rows[:3], 3) == (rows[:1], 0)
    with pytest.raises(Exception, match="top-k"):
        chain.answers(spark.createDataFrame(question(1, "q", [0.1] * 1001, ["a"] * 1001), SCHEMA), 3, 1).collect()
    assert chain.answers(spark.createDataFrame([], SCHEMA), 3, 1).collect() == []
