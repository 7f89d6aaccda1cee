"""Registered queries of the approximate index: the rows whose id is divisible by 100 are asked against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators.index import Index
from skein.plans.catalogue import table

#: Lists, neighbours, and questions that the number of probes is calibrated on.
LISTS, K, CALIBRATION = 16, 10, 200


def made(spark, d):
    vectors = table(spark, d, "embeddings")
    asked = vectors.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return Index.fit(vectors, 64, LISTS), asked


def search(spark, d):
    """With as many probes as a recall of 0.9 needs on CALIBRATION of the questions (rows at random need most lists)."""
    index, asked = made(spark, d)
    probes = index.calibrate(asked.orderBy(F.xxhash64("query_id")).limit(CALIBRATION), K)
    return index.search(asked, K, probes).select("query_id", "vec_id", "similarity", F.col("rank").cast("long"))


def exact(spark, d):
    index, asked = made(spark, d)
    return index.search(asked, K).select("query_id", "vec_id", "similarity", F.col("rank").cast("long"))


def sizes(spark, d):
    """Every row is in one list."""
    rows = made(spark, d)[0].rows
    return rows.agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("n_ids"), (F.countDistinct("list") <= LISTS).alias("few_lists"), F.count_if(F.col("list") < 0).alias("apart"))


NEAREST = f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
p AS (SELECT query_id, vec_id, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 6) AS similarity FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM p) SELECT * FROM r WHERE rank <= {K}"""

QUERIES = {
    "ann_search": (search, None),
    "ann_search_exact": (exact, NEAREST),
    "ann_lists": (sizes, "SELECT count(*) AS n, count(DISTINCT vec_id) AS n_ids, true AS few_lists, 0::BIGINT AS apart FROM embeddings"),
}
