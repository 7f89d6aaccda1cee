"""Registered queries of the tools, over the whole tables. A document's name is made of its id, its container is its source."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators.tools import FLOOR, PREVIEW, Toolbox
from skein.plans.catalogue import KNN, hits, table

#: Characters of a page and of a chunk, for the reports' numbers.
PAGE, CHUNK = 2000, 2400


def documents(spark, d):
    n = F.coalesce("n_chars", F.lit(0))
    size = lambda by: F.ceil(n / by)
    docs = table(spark, d, "documents")
    return docs.select(F.coalesce("source", F.lit("none")).alias("container"), F.format_string("doc %06d", "doc_id").alias("name"), size(PAGE).alias("pages"), size(CHUNK).alias("chunks"), F.coalesce("lang", F.lit("-")).alias("added"))


def tool_list(spark, d):
    out = Toolbox(spark).call("list_documents", documents(spark, d))
    return out.select("container", F.col("place").cast("long"), "line")


def tool_search(spark, d):
    h = hits(spark, d, 5)
    page = F.when(F.col("id") % 3 == 0, F.col("id") % 7)
    rows = h.select(F.col("query_id").alias("question"), "rank", F.col("source").alias("name"), page.alias("page"), "similarity", "content")
    out = Toolbox(spark).call("search_results", rows)
    return out.select("question", F.col("place").cast("long"), "name", F.md5(F.col("line").cast("binary")).alias("line_md5"))


def tool_summary(spark, d):
    """One summary for each container: the part is asked for the container's first digits of a name."""
    docs = documents(spark, d).withColumn("asked", F.concat(F.lit("DOC 0"), F.regexp_extract("container", "[0-9]", 0)))
    rows = docs.select("asked", "name", "pages", "chunks", "added", F.lit("text").alias("type"))
    return Toolbox(spark).call("summarize_document", rows)


DOCS = f"docs AS (SELECT coalesce(source, 'none') AS container, printf('doc %06d', doc_id) AS name, ceil(coalesce(n_chars, 0) / {PAGE})::BIGINT AS pages, ceil(coalesce(n_chars, 0) / {CHUNK})::BIGINT AS chunks, coalesce(lang, '-') AS added FROM documents)"

QUERIES = {
    "tool_list_documents": (
        tool_list,
        f"""WITH {DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY container ORDER BY name, added) AS n FROM docs)
SELECT container, n AS place, n || '. ' || name || chr(10) || '   - Pages: ' || pages || chr(10) || '   - Chunks: ' || chunks || chr(10) || '   - Added: ' || added || chr(10) AS line FROM r
UNION ALL SELECT container, 0, 'Available documents (' || count(*) || '):' || chr(10) FROM docs GROUP BY container""",
    ),
    "tool_search_results": (
        tool_search,
        f"""WITH {KNN}, h AS (SELECT query_id AS question, rank, source, CASE WHEN vec_id % 3 = 0 THEN vec_id % 7 END AS page, similarity, trim(coalesce(text, ''), ' ') AS t
  FROM near LEFT JOIN documents ON doc_id = vec_id WHERE rank <= 5 AND similarity >= {FLOOR}), n AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY rank) AS place FROM h)
SELECT question, place, coalesce(source, 'Unknown') AS name, md5('[' || place || '] From ' || coalesce(source, 'Unknown') || CASE WHEN page IS NOT NULL THEN ', p. ' || page ELSE '' END
  || ' (Relevance: ' || printf('%.1f', 100 * similarity) || '%):' || chr(10) || t[:{PREVIEW}] || CASE WHEN length(t) > {PREVIEW} THEN ' [...]' ELSE '' END) AS line_md5 FROM n""",
    ),
    "tool_summarize": (
        tool_summary,
        f"""WITH {DOCS}, a AS (SELECT *, 'DOC 0' || regexp_extract(container, '[0-9]') AS asked FROM docs),
f AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY name) AS r FROM a WHERE contains(lower(name), lower(asked)))
SELECT q.asked, f.name AS document, CASE WHEN f.name IS NULL THEN 'Document not found in selected library: ' || q.asked ELSE 'Document: ' || f.name || chr(10) || '- Pages: ' || f.pages || chr(10)
  || '- Chunks: ' || f.chunks || chr(10) || '- Added: ' || f.added || chr(10) || '- File Type: text' END AS report
FROM (SELECT DISTINCT asked FROM a) q LEFT JOIN f ON f.asked = q.asked AND r = 1""",
    ),
}
