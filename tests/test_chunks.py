"""Chunks of texts that never end, their coverage, and the paragraph form against a plain version."""

import random

import duckdb
import pytest
from pyspark.sql import SparkSession

from skein.operators import chunking as C
from skein.plans.chunks import QUERIES


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def test_the_cap_says_what_it_cuts_and_can_be_lifted(spark):
    text = "long " * 6000
    plain4 = " ".join(f"Sentence number {i} of many words." for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "short text"), (4, plain4), (5, "   ")], "doc_id long, text string")
    capped = {r.doc_id: r for r in C.chunk_coverage(docs, most=50).collect()}
    assert capped[1].n_chunks == 50 and capped[1].truncated and capped[1].covered < len(text) / 2 and capped[1].n_chars == len(text)
    assert not any(capped[i].truncated for i in (2, 3, 4, 5)) and capped[2].n_chunks == 0 and capped[4].covered == len(plain4)
    whole = {r.doc_id: r for r in C.chunk_coverage(docs, most=None).collect()}
    assert whole[1].covered >= len(text) - C.REST and not whole[1].truncated and whole[1].n_chunks > 50
    marks = C.chunks(docs, most=50).filter("doc_id = 1").select("truncated").distinct().collect()
    assert [r.truncated for r in marks] == [True]
    narrow = C.chunks(docs, features=False)
    assert not set(C.FEATURES) & set(narrow.columns) and narrow.count() == C.chunks(docs).count()


def test_paragraphs_equal_a_plain_version(spark):
    r = random.Random(4)
    texts = ["\n".join(" ".join(f"w{r.randrange(50)}" for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 9))) for _ in range(30)] + ["", "\n\n", "a " * 50]

    def plain(text):
        out, held = [], []
        for p in text.split("\n"):
            words = p.split()
            if held and len(held) + len(words) > 20:
                out.append(held)
                held = held[-4:]
            held = [*held, *words]
        return [" ".join(h) for h in [*out, held] if h]

    got = C.paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 20, 4).orderBy("doc_id", "chunk_index").collect()
    assert [(x.doc_id, x.content) for x in got] == [(i, c) for i, t in enumerate(texts) for c in plain(t)]


def test_keywords_of_documents_and_chunks(spark):
    docs = spark.createDataFrame([(1, "The red fox, the RED dog; fox fox a an 12"), (2, None), (1, "again again")], "doc_id long, text string")
    got = sorted((r.doc_id, r["rank"], r.term, r.n) for r in C.document_keywords(docs, frozenset(["the"])).collect())
    assert got == [(1, 1, "again", 2), (1, 1, "fox", 3), (1, 2, "red", 2), (1, 3, "dog", 1)]
    assert C.chunks(docs, stop=frozenset(["the"])).filter("doc_id = 1").first().keywords == ["fox", "red", "dog"]


def test_section_titles_equal_sql_on_texts_with_headings_of_their_own(spark, tmp_path):
    line = "Some words of a long line that goes on and on, line {}."
    numbered = "\n".join(f"{i}. " + line.format(i) for i in range(1, 300))
    capitals = " ".join(["LOUD WORDS WITHOUT END"] * 300)
    marked = "\n".join(f"## Part {i} of the whole\n" + line.format(i) for i in range(200))
    # "word" with the six words of the headings put around it: 99 and 100
    texts = [numbered, capitals, marked, "few words", "", None, "word " * 93, "word " * 94, "a  b " * 600]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(100, numbered, None), (None, numbered, "en"), (0, numbered, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    query, sql = QUERIES["section_titles"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = query(spark, str(tmp_path)).select("doc_id", "chunk_index", "section_title").collect()
    want = con.execute(f"SELECT doc_id, chunk_index, section_title FROM ({sql})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and [r[0] for r in sorted(want)] == [0, 0, 1, 2, 7, 8]
    # the operator keeps the titles of later chunks
    later = C.chunks(docs.filter("doc_id < 2")).filter("chunk_index > 0 AND section_title IS NOT NULL")
    assert {r.doc_id for r in later.select("doc_id").collect()} == {0, 1}
