"""Registered queries of the retrieval and analytics engine, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import retrieval as R


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_vectors(spark, d):
    return table(spark, d, "benchmark").join(table(spark, d, "embeddings"), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "embedding")


def knn_batch(spark, d):
    return R.knn(table(spark, d, "embeddings"), query_vectors(spark, d), 10).select("query_id", "vec_id", "similarity", F.col("rank").cast("long"))


def bm25_topk(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.bm25(table(spark, d, "documents"), q, 10).select("query_id", "doc_id", "score", F.col("rank").cast("long"))


#: Ids that are broadcast to a table of texts: 16 MB.
BROADCAST_IDS = 1_000_000


def found_texts(near, docs, most):
    """near (id, ...) with the columns of docs (id, ...), null where docs has no such id; near has `most` rows at most.

    docs is cut to the ids first. While they are few the ids are broadcast, so texts that nothing hit are not moved at all;
    else both sides meet by a shuffle."""
    ids = near.select("id").distinct()
    cut = docs.join(F.broadcast(ids) if most <= BROADCAST_IDS else ids, "id", "left_semi")
    return near.join(cut, "id", "left")


def hits(spark, d, k, content=True):
    """query_id, id, similarity, rank, query, content, source of each query's k nearest vectors; a vector's id names its
    document (a convention of these tables). Without content, texts are not read."""
    near = R.knn(table(spark, d, "embeddings"), query_vectors(spark, d), k).withColumnRenamed("vec_id", "id")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), *[F.col("text").alias("content")] * content, "source")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return found_texts(near.join(q, "query_id"), docs, k * q.count())


def hybrid(spark, d, k=20):
    """The k best of 2k vector hits by weighted reciprocal ranks of vector and keywords."""
    return R.fuse(R.bm25_candidates(hits(spark, d, 2 * k)), k)


def bm25_candidates(spark, d):
    return R.bm25_candidates(hits(spark, d, 40)).select("query_id", "id", "keyword_score")


def rrf_hybrid(spark, d):
    return hybrid(spark, d).select("query_id", "id", "fused", F.col("fused_rank").cast("long").alias("rank"))


def text_features(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.word_count(t).alias("n_words"), F.char_length(F.coalesce(t, F.lit(""))).cast("long").alias("n_code_points"), T.has_number(t).alias("has_number"), T.has_list(t).alias("has_list"), F.size(T.tokens(t)).cast("long").alias("n_tokens"))


def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", F.char_length(T.strip_tags(F.col("html"))).cast("long").alias("n_chars"), F.md5(T.strip_tags(F.col("html")).cast("binary")).alias("text_md5"))


def chunk_windows(spark, d):
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r]+", -1), lambda w: w != "")
    return R.windows(table(spark, d, "documents"), words)


def source_coverage(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n_chars").cast("long").alias("n_chars"), F.max("n_chars").alias("longest"))


def stage_durations(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n_events"), F.round(F.avg("value"), 4).alias("avg_value"), F.countDistinct("user_id").alias("n_users"))


def ring_last_n(spark, d):
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("rn", F.row_number().over(w)).filter("rn <= 20").select("event_type", "event_id", F.col("rn").cast("long"))


def chat_word_stats(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n_turns"), F.sum(T.word_count(F.col("text"))).alias("n_words"))


WORD_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
TOKENS = WORD_TOKENS
WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda t: t <> '')"
KNN = """q AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS q FROM benchmark JOIN embeddings ON item_id = vec_id),
pairs AS (SELECT query_id, vec_id, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 6) AS similarity FROM embeddings, q),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM pairs)"""
BM25 = f"""qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
dt AS (SELECT doc_id, {TOKENS} AS t FROM documents), s AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avg_len FROM dt),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM dt) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT query_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), s GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)"""
HYBRID = f"""{KNN},
hit AS (SELECT near.query_id, near.vec_id AS id, near.similarity, near.rank, b.text AS query, d.text AS content, d.source
  FROM near JOIN benchmark b ON b.item_id = near.query_id LEFT JOIN documents d ON d.doc_id = near.vec_id WHERE near.rank <= 40),
tok AS (SELECT query_id, id, {TOKENS.replace('text', 'content')} AS t FROM hit),
ask AS (SELECT query_id, term, count(*) AS times FROM (SELECT DISTINCT query_id, unnest({TOKENS.replace('text', 'query')}) AS term, generate_subscripts({TOKENS.replace('text', 'query')}, 1) AS place FROM hit) GROUP BY ALL),
siz AS (SELECT query_id, id, len(t) AS size, count(*) OVER (PARTITION BY query_id) AS n, avg(len(t)) OVER (PARTITION BY query_id) AS mean FROM tok),
tfs AS (SELECT query_id, id, term, count(*) AS tf FROM (SELECT query_id, id, unnest(t) AS term FROM tok) JOIN ask USING (query_id, term) GROUP BY ALL),
dfs AS (SELECT query_id, term, count(*) AS df FROM tfs GROUP BY ALL),
kws AS (SELECT query_id, id, round(sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / greatest(mean, 1)))), 6) AS s
  FROM tfs JOIN dfs USING (query_id, term) JOIN ask USING (query_id, term) JOIN siz USING (query_id, id) GROUP BY ALL),
kwd AS (SELECT hit.*, coalesce(s, 0::DOUBLE) AS keyword_score FROM hit LEFT JOIN kws USING (query_id, id)),
kwr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, rank) AS keyword_rank FROM kwd),
fus AS (SELECT *, round(0.7::DOUBLE / (60 + rank) + 0.3::DOUBLE / (60 + keyword_rank), 9) AS fused FROM kwr),
hyb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, rank) AS fused_rank FROM fus) WHERE fused_rank <= 20)"""
BARE = "trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'), ' ')"

CATALOGUE = {
    "knn_batch": (knn_batch, f"WITH {KNN} SELECT query_id, vec_id, similarity, rank FROM near WHERE rank <= 10"),
    "bm25_topk": (bm25_topk, f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM lex WHERE rank <= 10"),
    "bm25_candidates": (bm25_candidates, f"WITH {HYBRID} SELECT query_id, id, keyword_score FROM kwd"),
    "rrf_hybrid": (rrf_hybrid, f"WITH {HYBRID} SELECT query_id, id, fused, fused_rank AS rank FROM hyb"),
    "text_features": (text_features, f"SELECT doc_id, len({WORDS}) AS n_words, length(coalesce(text, '')) AS n_code_points, coalesce(regexp_matches(text, '[0-9]'), false) AS has_number, coalesce(regexp_matches(text, '(^|\\n)[ ]*([-*]|[0-9]+\\.) '), false) AS has_list, len({TOKENS}) AS n_tokens FROM documents"),
    "html_strip": (html_strip, f"SELECT page_id, length({BARE}) AS n_chars, md5({BARE}) AS text_md5 FROM pages"),
    "chunk_windows": (chunk_windows, f"WITH w AS (SELECT doc_id, len({WORDS}) AS n FROM documents), c AS (SELECT doc_id, n, unnest(range(0, greatest(1, ceil((n - 75) / 325.0)::BIGINT))) AS chunk_index FROM w WHERE n > 0) SELECT doc_id, chunk_index, least(400, n - chunk_index * 325)::BIGINT AS n_words FROM c"),
    "source_coverage": (source_coverage, "SELECT source, lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars, max(n_chars) AS longest FROM documents GROUP BY ALL"),
    "stage_durations": (stage_durations, "SELECT event_type, count(*) AS n_events, round(avg(value), 4) AS avg_value, count(DISTINCT user_id) AS n_users FROM events GROUP BY ALL"),
    "ring_last_n": (ring_last_n, "SELECT event_type, event_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 20"),
    "chat_word_stats": (chat_word_stats, f"SELECT conv_id, role, count(*) AS n_turns, sum(len({WORDS}))::BIGINT AS n_words FROM conversations GROUP BY ALL"),
}
