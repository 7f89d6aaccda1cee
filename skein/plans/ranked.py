"""Registered queries over ranked candidates: re-ranking, gate, diversity, context, retrieval logs, clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions.vectors import cosine, norm
from skein.operators import clustering as C
from skein.operators import ranking as K
from skein.operators import retrieval as R
from skein.plans.catalogue import HYBRID, KNN, hits, hybrid, table

#: Picks of the diversity step, and characters of a context.
PICKS, BUDGET = 3, 3500


def candidates(spark, d, k=20, content=False):
    """Each query's k nearest vectors with their documents, with their texts if asked for."""
    return hits(spark, d, k, content)


def reranked(spark, d):
    """The hybrid list in the order of the re-ranking; a vector's id, modulo ten, is its chunk's index (a convention)."""
    return K.rerank(hybrid(spark, d).withColumn("chunk_index", F.col("id") % 10), 20)


def rerank_topk(spark, d):
    return reranked(spark, d).select("query_id", "id", "score", F.col("new_rank").cast("long"))


def keyword_overlap(spark, d):
    return candidates(spark, d, content=True).select("query_id", "id", F.round(K.keyword_match(F.col("query"), F.col("content")), 6).alias("share"))


def gate_decision(spark, d):
    return K.gate(reranked(spark, d))


def gate_lenient(spark, d):
    return K.gate(reranked(spark, d), lenient=True).select("query_id", "limit", "n_pass", "decision")


def gated(spark, d):
    return K.gated(reranked(spark, d), 10).select("query_id", "id", F.col("new_rank").cast("long"))


def filter_similarity(spark, d):
    """The search's own floor and candidate count: min(2k, k + 4) hits for k = 6, those of 0.35 and more, the first six."""
    w = Window.partitionBy("query_id").orderBy("rank")
    near = candidates(spark, d, 10).filter("similarity >= 0.35").withColumn("n", F.row_number().over(w)).filter("n <= 6")
    return near.select("query_id", "id", F.col("n").cast("long").alias("rank"), F.coalesce("source", F.lit("Unknown")).alias("source"))


def mmr_k3(spark, d):
    """The first three by relevance and diversity out of the re-ranked list."""
    rows = reranked(spark, d).select("query_id", "id", "similarity", F.col("new_rank").alias("rank"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return K.mmr(rows.join(vectors, "id"), PICKS)


def doc_coverage(spark, d):
    rows = reranked(spark, d).withColumn("source", F.coalesce("source", F.lit("Unknown")))
    return K.coverage(rows, rows.filter("new_rank <= 1"), 3)


def strict_block(spark, d):
    """Strict queries with fewer than three rows at the strict limit, unless the gate was eased."""
    g = K.gate(reranked(spark, d))
    blocked = (F.col("n_pass") < 3) & ~F.col("override") & ~F.col("trivial")
    return g.select("query_id", "n_pass", F.when(blocked, "strict_blocked").otherwise("ok").alias("decision"))


def context_blocks(spark, d):
    rows = reranked(spark, d).select("query_id", F.col("new_rank").alias("rank"), "similarity", "content")
    c = K.assemble(rows, BUDGET)
    left = K.token_budget(F.col("n_chars"), 512)
    return c.select("query_id", "n_used", "n_chars", left.alias("max_tokens"), F.md5(F.col("context").cast("binary")).alias("context_md5"))


def avg_context_words(spark, d):
    words = F.size(F.filter(F.split(F.coalesce("content", F.lit("")), r"[ \t\n\r]+", -1), lambda w: w != ""))
    rows = reranked(spark, d).filter("new_rank <= 5").select("query_id", words.alias("w")).groupBy("query_id")
    return rows.agg(F.sum("w").alias("total"), F.floor(F.avg("w")).alias("average"), F.max("w").cast("long").alias("most"))


def answer_confidence(spark, d):
    rows = reranked(spark, d).filter("new_rank <= 5").withColumn("rank", F.col("new_rank"))
    return K.confidence(rows, table(spark, d, "documents").select("source").distinct().count())


def chunk_hits(spark, d):
    return candidates(spark, d, 10).groupBy("id").agg(F.count("*").alias("hits"), F.round(F.avg("similarity"), 6).alias("avg_similarity"), F.max("query_id").alias("last_query"))


def doc_hits(spark, d):
    return candidates(spark, d, 10).groupBy(F.coalesce("source", F.lit("Unknown")).alias("source")).agg(F.count("*").alias("hits"), F.countDistinct("id").alias("n_chunks"))


def coverage_pct(spark, d):
    hit = candidates(spark, d, 10).agg(F.countDistinct("id").alias("hit"))
    return table(spark, d, "embeddings").agg(F.count("*").alias("total")).join(F.broadcast(hit), F.lit(True)).select("hit", "total", F.when(F.col("total") > 0, F.round(100.0 * F.col("hit") / F.col("total"), 4)).otherwise(F.lit(0.0)).alias("pct"))


def similarity_matrix(spark, d):
    """All pairs of a twelve-vector sample (the size is the report's own), clamped to 0..1."""
    v = table(spark, d, "embeddings").orderBy("vec_id").limit(12).select("vec_id", "embedding", norm(F.col("embedding")).alias("n"))
    b = v.select(F.col("vec_id").alias("other"), F.col("embedding").alias("e2"), F.col("n").alias("n2"))
    c = F.round(cosine(F.col("embedding"), F.col("n"), F.col("e2"), F.col("n2")), 6)
    return v.join(F.broadcast(b), F.col("vec_id") <= F.col("other")).select("vec_id", "other", F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)).alias("similarity"))


def centroid_mean(spark, d):
    return C.means(table(spark, d, "embeddings"), "label").select("label", F.col("place").cast("long"), F.round("mean", 6).alias("mean"))


def first_three(spark, d):
    return [(r["vec_id"], list(r["embedding"])) for r in table(spark, d, "embeddings").filter("vec_id < 3").collect()]


def assign_nearest(spark, d):
    return C.nearest(table(spark, d, "embeddings"), first_three(spark, d)).select("vec_id", "cluster")


def kmeans_fixed(spark, d):
    return C.kmeans(table(spark, d, "embeddings"), first_three(spark, d)).groupBy("cluster").agg(F.count("*").alias("n"))


def pca3(spark, d):
    return C.pca3(table(spark, d, "embeddings"), 64)


def random_projection3(spark, d):
    return C.random_projection3(table(spark, d, "embeddings"), 64)


def legend_counts(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")).withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


SPLIT = "list_filter(string_split(lower(coalesce({0}, '')), ' '), lambda w: w <> '')"


def cand(k):
    return f"""{KNN}, cand AS (
  SELECT near.query_id, near.vec_id AS id, near.similarity, near.rank, b.text AS query, d.text AS content, d.source
  FROM near JOIN benchmark b ON b.item_id = near.query_id LEFT JOIN documents d ON d.doc_id = near.vec_id WHERE near.rank <= {k})"""


SHARE = "CASE WHEN len(q_set) > 0 THEN len(list_intersect(q_set, words))::DOUBLE / len(q_set) ELSE 0.0::DOUBLE END"
PLACES = "list_filter(range(len(words)), lambda i: contains(words[i + 1], terms[{}]))"
NEAR2 = f"list_min(flatten(list_transform({PLACES.format(1)}, lambda x: list_transform({PLACES.format(2)}, lambda y: abs(x - y)))))"
EVERY = "len(list_filter(terms, lambda t: len(list_filter(words, lambda w: contains(w, t))) > 0)) = len(terms)"
PROX = f"CASE WHEN len(terms) >= 2 AND {EVERY} THEN 1.0::DOUBLE / (1 + {NEAR2}) ELSE 0.0::DOUBLE END"
WORDED = f"""SELECT *, list_distinct(list_filter({SPLIT.format('query')}, lambda w: length(w) > 2)) AS q_set,
  list_filter({SPLIT.format('query')}, lambda w: length(w) > 2) AS terms, {SPLIT.format('content')} AS words"""
RERANKED = f"""{HYBRID}, wrd AS ({WORDED} FROM hyb),
sco AS (SELECT *, round(similarity + 0.2::DOUBLE * ({SHARE}) + 0.15::DOUBLE * ({PROX}) + 0.05::DOUBLE / (id % 10 + 10), 6) AS score FROM wrd),
rer AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS new_rank FROM sco)"""
TRIVIAL = ", ".join(repr(w) for w in K.TRIVIAL)


def gate_sql(lenient="false"):
    return f"""{RERANKED}, lim AS (
  SELECT *, CASE WHEN {lenient} OR trivial THEN 0.35::DOUBLE ELSE 0.52::DOUBLE END AS "limit"
  FROM (SELECT *, len({SPLIT.format('query')}) <= 2 OR lower(trim(coalesce(query, ''), ' ')) IN ({TRIVIAL}) AS trivial FROM rer)),
met AS (
  SELECT query_id, trivial, "limit", max(similarity) FILTER (new_rank = 1) AS top, coalesce(max(similarity) FILTER (new_rank = 2), 0.0::DOUBLE) AS second,
    round(avg(similarity) FILTER (new_rank <= 5), 6) AS avg_top5, count(*) FILTER (similarity >= "limit") AS n_pass
  FROM lim GROUP BY ALL),
ovr AS (
  SELECT *, top >= 0.5::DOUBLE OR (top >= 0.38::DOUBLE AND round(top - avg_top5, 6) >= 0.05::DOUBLE) OR round(top - second, 6) >= 0.07::DOUBLE AS override
  FROM met),
gat AS (
  SELECT *, CASE WHEN n_pass > 0 THEN 'accept' WHEN override OR {lenient} OR trivial THEN 'override' ELSE 'fallback_ondevice_low_confidence' END AS decision
  FROM ovr)"""


def picks_sql(n):
    """Unrolled picks: each step takes the best of what is left against all that was taken."""
    out = f"""{RERANKED}, vec AS (SELECT r.query_id, r.id, r.similarity, r.new_rank, e.embedding::DOUBLE[] AS e FROM rer r JOIN embeddings e ON e.vec_id = r.id),
p1 AS (SELECT query_id, id, e, 1::BIGINT AS pick FROM vec WHERE new_rank = 1)"""
    for i in range(2, n + 1):
        taken = " UNION ALL ".join(f"SELECT query_id, id, e FROM p{j}" for j in range(1, i))
        out += f""",
p{i} AS (SELECT query_id, id, e, {i}::BIGINT AS pick FROM (
  SELECT query_id, id, e, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, new_rank) AS n FROM (
    SELECT c.query_id, c.id, c.new_rank, any_value(c.e) AS e,
      round(0.75::DOUBLE * any_value(c.similarity) - 0.25::DOUBLE * greatest(0, max(list_cosine_similarity(c.e, t.e))), 9) AS v
    FROM vec c JOIN ({taken}) t USING (query_id) GROUP BY c.query_id, c.id, c.new_rank HAVING NOT bool_or(c.id = t.id))) WHERE n = 1)"""
    return out + " " + " UNION ALL ".join(f"SELECT query_id, id, pick FROM p{i}" for i in range(1, n + 1))


BLOCK = "'[Document Chunk ' || new_rank || ', Similarity: ' || printf('%.3f', similarity) || ']' || chr(10) || coalesce(content, '') || CASE WHEN new_rank = count(*) OVER (PARTITION BY query_id) THEN '' ELSE chr(10) || chr(10) || '---' || chr(10) || chr(10) END"
WS = "len(list_filter(string_split_regex(coalesce(content, ''), '[ \\t\\n\\r]+'), lambda w: w <> ''))"

QUERIES = {
    "rerank_topk": (rerank_topk, f"WITH {RERANKED} SELECT query_id, id, score, new_rank FROM rer"),
    "keyword_overlap": (keyword_overlap, f"WITH {cand(20)}, w AS ({WORDED} FROM cand) SELECT query_id, id, round({SHARE}, 6) AS share FROM w"),
    "gate_decision": (gate_decision, f"WITH {gate_sql()} SELECT * FROM gat"),
    "gate_lenient": (gate_lenient, f'WITH {gate_sql("true")} SELECT query_id, "limit", n_pass, decision FROM gat'),
    "gated": (
        gated,
        f'WITH {gate_sql()} SELECT query_id, id, new_rank FROM rer JOIN gat USING (query_id) WHERE (n_pass > 0 AND similarity >= "limit") '
        "OR (decision = 'override' AND new_rank <= 20)",
    ),
    "filter_similarity": (
        filter_similarity,
        f"WITH {cand(10)}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM cand WHERE similarity >= 0.35) "
        "SELECT query_id, id, n AS rank, coalesce(source, 'Unknown') AS source FROM n WHERE n <= 6",
    ),
    "mmr_k3": (mmr_k3, f"WITH {picks_sql(PICKS)}"),
    "doc_coverage": (
        doc_coverage,
        f"""WITH {RERANKED}, rows AS (SELECT query_id, id, new_rank, coalesce(source, 'Unknown') AS source FROM rer),
top AS (SELECT query_id, id, source FROM rows WHERE new_rank = 1),
oth AS (SELECT r.* FROM rows r JOIN top t USING (query_id) WHERE r.source <> t.source),
fst AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY new_rank) AS turn FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY new_rank) AS n FROM oth) WHERE n = 1)
SELECT *, false AS added FROM top UNION ALL SELECT query_id, id, source, true FROM fst WHERE turn <= 2""",
    ),
    "strict_block": (
        strict_block,
        f"WITH {gate_sql()} SELECT query_id, n_pass, CASE WHEN n_pass < 3 AND NOT override AND NOT trivial THEN 'strict_blocked' ELSE 'ok' END AS decision FROM gat",
    ),
    "context_blocks": (
        context_blocks,
        f"""WITH {RERANKED}, blk AS (SELECT query_id, new_rank, {BLOCK} AS b FROM rer),
tot AS (SELECT *, sum(length(b)) OVER (PARTITION BY query_id ORDER BY new_rank ROWS UNBOUNDED PRECEDING) AS total FROM blk)
SELECT query_id, count(*) AS n_used, max(total)::BIGINT AS n_chars, least(512, greatest(128, 3600 - max(total) // 4))::BIGINT AS max_tokens,
  md5(string_agg(b, '' ORDER BY new_rank)) AS context_md5 FROM tot WHERE new_rank = 1 OR total <= {BUDGET} GROUP BY query_id""",
    ),
    "avg_context_words": (
        avg_context_words,
        f"WITH {RERANKED}, w AS (SELECT query_id, {WS} AS w FROM rer WHERE new_rank <= 5) SELECT query_id, sum(w)::BIGINT AS total, "
        "floor(avg(w))::BIGINT AS average, max(w) AS most FROM w GROUP BY query_id",
    ),
    "answer_confidence": (
        answer_confidence,
        f"""WITH {RERANKED}, c AS (SELECT query_id, max(similarity) FILTER (new_rank = 1) AS top, count(*) AS n, count(DISTINCT coalesce(source, 'Unknown')) AS s,
  any_value(len({SPLIT.format('query')})) AS w FROM rer WHERE new_rank <= 5 GROUP BY query_id), t AS (SELECT count(DISTINCT source) AS docs FROM documents)
SELECT query_id, round(0.5::DOUBLE * least(top / 0.8::DOUBLE, 1) + 0.2::DOUBLE * least(n / 5, 1) + 0.2::DOUBLE * least(s / docs, 1) + 0.1::DOUBLE * least(w / 5, 1), 6) AS confidence,
  array_to_string(list_filter([CASE WHEN top < 0.4 THEN 'Low relevance' WHEN top < 0.6 THEN 'Moderate relevance' END, CASE WHEN n < 3 THEN 'Limited context' END,
    CASE WHEN s = 1 AND docs > 1 THEN 'Single source' END, CASE WHEN w <= 2 THEN 'Generic query' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM c, t""",
    ),
    "chunk_hits": (chunk_hits, f"WITH {cand(10)} SELECT id, count(*) AS hits, round(avg(similarity), 6) AS avg_similarity, max(query_id) AS last_query FROM cand GROUP BY id"),
    "doc_hits": (doc_hits, f"WITH {cand(10)} SELECT coalesce(source, 'Unknown') AS source, count(*) AS hits, count(DISTINCT id) AS n_chunks FROM cand GROUP BY ALL"),
    "coverage_pct": (coverage_pct, f"WITH {cand(10)} SELECT (SELECT count(DISTINCT id) FROM cand) AS hit, count(*) AS total, round(100.0::DOUBLE * (SELECT count(DISTINCT id) FROM cand) / count(*), 4) AS pct FROM embeddings"),
    "similarity_matrix": (similarity_matrix, "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 12) SELECT a.vec_id, b.vec_id AS other, greatest(0.0::DOUBLE, least(1.0::DOUBLE, round(list_cosine_similarity(a.e, b.e), 6))) AS similarity FROM v a JOIN v b ON a.vec_id <= b.vec_id"),
    "centroid_mean": (centroid_mean, "SELECT label, place - 1 AS place, round(avg(v), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS place FROM embeddings) GROUP BY ALL"),
    "assign_nearest": (assign_nearest, "WITH p AS (SELECT a.vec_id, c.vec_id AS cluster, round(power(list_distance(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), 2), 9) AS d FROM embeddings a, embeddings c WHERE c.vec_id < 3) SELECT vec_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS n FROM p) WHERE n = 1"),
    "kmeans_fixed": (kmeans_fixed, None),
    "pca3": (pca3, None),
    "random_projection3": (random_projection3, None),
    "legend_counts": (legend_counts, "SELECT label, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS pct FROM embeddings GROUP BY label"),
}
