"""Exact nearest neighbours, BM25 over a corpus or over candidates, rank fusion and fixed windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import word_tokens

#: Queries taken at once in a task, and bytes of query vectors broadcast for one scan; more take further scans.
QUERY_BLOCK, BROADCAST_BYTES = 1000, 64 << 20
#: Fixed values of BM25, of the fusion's constant and of its weights.
K1, B, FUSION, VECTOR_WEIGHT, KEYWORD_WEIGHT = 1.5, 0.75, 60, 0.7, 0.3


def knn(vectors: DataFrame, queries: DataFrame, k: int, floor: float | None = None) -> DataFrame:
    """query_id, vec_id, similarity, rank: each query's k most similar vectors, ties by vec_id.

    The queries are a stated set; each batch of vectors meets a block of them in one matrix product and a task keeps k
    for each query, so what is shuffled is k rows a task and query. Cosine is 0 for zero vectors and those of another size."""
    spark = vectors.sparkSession
    asked = queries.filter("embedding IS NOT NULL").select("query_id", "embedding").toPandas()
    dims = sorted({len(e) for e in asked["embedding"]})
    step = max(1, BROADCAST_BYTES // (8 * max([1, *dims])))
    schema, out = "query_id long, vec_id long, similarity double", None
    for dim in dims:
        mine = asked[asked["embedding"].map(len) == dim]
        for at in range(0, len(mine), step):
            some = mine.iloc[at : at + step]
            shared = spark.sparkContext.broadcast((some["query_id"].to_list(), [list(e) for e in some["embedding"]]))
            found = vectors.select("vec_id", "embedding").mapInPandas(nearest(shared, dim, k, floor), schema)
            out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def nearest(shared, dim: int, k: int, floor: float | None):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        ids, q = np.array(shared.value[0], np.int64), np.array(shared.value[1], float).reshape(-1, dim)
        unit = lambda x: x / np.where((n := np.sqrt((x * x).sum(axis=1, keepdims=True))) > 0, n, np.inf)
        q = unit(q)
        # the k best of the task so far: what is shuffled is k rows a task and query
        held = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        for b in batches:
            b = b[b["embedding"].notna()]
            if not len(b):
                continue
            order = np.argsort(b["vec_id"].to_numpy(), kind="stable")
            vec, rows = b["vec_id"].to_numpy()[order], b["embedding"].to_numpy()[order]
            fits = np.array([len(e) == dim for e in rows])
            x = np.zeros((len(rows), dim))
            if fits.any():
                x[fits] = np.stack(rows[fits]).astype(float)
            x = unit(x)
            for at in range(0, len(q), QUERY_BLOCK):
                part = slice(at, at + QUERY_BLOCK)
                sim = np.round(q[part] @ x.T, 6) + 0.0
                top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                both = np.concatenate([held[0][part], np.take_along_axis(sim, top, axis=1)], axis=1), np.concatenate([held[1][part], vec[top]], axis=1)
                best = np.lexsort((both[1], -both[0]), axis=1)[:, :k]
                held[0][part], held[1][part] = (np.take_along_axis(z, best, axis=1) for z in both)
        for at in range(0, len(q), QUERY_BLOCK):
            sim, vec = (z[at : at + QUERY_BLOCK] for z in held)
            real = np.isfinite(sim) if floor is None else sim >= floor
            yield pd.DataFrame({"query_id": np.repeat(ids[at : at + QUERY_BLOCK], real.sum(axis=1)), "vec_id": vec[real], "similarity": sim[real]})

    return run


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score, rank over the whole corpus. Texts are tokenised once: each keeps its length and the counts of
    the queries' terms, from which document frequencies come; then each batch scores its texts and keeps k a query."""
    spark = docs.sparkSession
    terms = queries.select("query_id", F.explode(word_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").count().collect()
    words = sorted({r["term"] for r in terms})
    number = {w: i for i, w in enumerate(words)}
    ids = sorted({r["query_id"] for r in terms})
    place = {q: i for i, q in enumerate(ids)}
    asked = spark.sparkContext.broadcast((number, ids, [(place[r["query_id"]], number[r["term"]], r["count"]) for r in terms]))
    counted = docs.select("doc_id", "text").mapInPandas(term_counts(asked), "doc_id long, size long, term array<int>, tf array<int>")
    # one pass for all statistics: term -1 stands for the texts themselves
    each = counted.select(F.explode(F.concat("term", F.array(F.lit(-1)))).alias("term"), "size").groupBy("term")
    df = {r["term"]: r for r in each.agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}  # the queries' terms
    total, df = df.get(-1), {t: r["n"] for t, r in df.items() if t >= 0}
    n, average = (total["n"], total["size"] / total["n"] or 1.0) if total else (0, 1.0)
    scored = counted.mapInPandas(bm25_scores(asked, n, average, df, k, k1, b), "query_id long, doc_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def term_counts(asked):
    word = re.compile(r"\w+")

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import pandas as pd

        number = asked.value[0]
        for b in batches:
            sizes, terms, tfs = [], [], []
            for text in b["text"]:
                tokens = word.findall((text or "").lower())
                found = Counter(number[t] for t in tokens if t in number)
                sizes.append(len(tokens))
                terms.append(list(found))
                tfs.append(list(found.values()))
            yield pd.DataFrame({"doc_id": b["doc_id"], "size": sizes, "term": terms, "tf": tfs})

    return run


def bm25_scores(asked, n: int, average: float, df: dict, k: int, k1: float, b: float):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        number, ids, terms = asked.value
        idf = np.zeros(len(number))
        for t, d in df.items():
            idf[t] = np.log(1 + (n - d + 0.5) / (d + 0.5))
        at = np.argsort([t for _, t, _ in terms], kind="stable")
        q, t, times = (np.array([r[i] for r in terms])[at] for i in range(3)) if terms else (np.zeros(0, int),) * 3
        first = np.searchsorted(t, np.arange(len(number) + 1))
        # the k best of the task so far, as sorted triples; only pairs that share a term are formed
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            for start in range(0, len(batch), 2000):
                x = batch.iloc[start : start + 2000]
                count = x["term"].map(len).to_numpy()
                if not count.sum():
                    continue
                doc, term, tf = np.repeat(np.arange(len(x)), count), np.concatenate(x["term"].to_list()), np.concatenate(x["tf"].to_list())
                part = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * x["size"].to_numpy()[doc] / average))
                many = first[term + 1] - first[term]
                who = np.repeat(first[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
                pair, place = np.unique(q[who] * len(x) + np.repeat(doc, many), return_inverse=True)
                score = np.round(np.bincount(place, np.repeat(part, many) * times[who], minlength=len(pair)), 6)
                hit = score > 0
                new = pair[hit] // len(x), x["doc_id"].to_numpy()[pair[hit] % len(x)], score[hit]
                held = tuple(np.concatenate([a, c]) for a, c in zip(held, new))
                order = np.lexsort((held[1], -held[2], held[0]))
                held = tuple(a[order] for a in held)
                starts = np.flatnonzero(np.diff(held[0], prepend=-1))
                rank = np.arange(len(held[0])) - np.repeat(starts, np.diff(np.append(starts, len(held[0]))))
                held = tuple(a[rank < k] for a in held)
        yield pd.DataFrame({"query_id": np.array(ids, np.int64)[held[0]], "doc_id": held[1], "score": held[2]})

    return run


def bm25_candidates(candidates: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """candidates (query_id, id, query, content, ...) with keyword_score: BM25 with the statistics of each query's own list.

    Lists are top-k results, so a query's terms and lengths are a few rows."""
    keys = ["query_id", "id"]
    base = candidates.select(*keys, "query", word_tokens(F.col("content")).alias("t"))
    per = Window.partitionBy("query_id")
    sizes = base.select(*keys, F.size("t").alias("size")).withColumn("n", F.count("*").over(per)).withColumn("avg", F.avg("size").over(per))
    asked = base.select("query_id", "query").distinct().select("query_id", F.explode(word_tokens(F.col("query"))).alias("term"))
    asked = asked.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    tf = base.select(*keys, F.explode("t").alias("term")).join(asked, ["query_id", "term"]).groupBy(*keys, "term", "times").agg(F.count("*").alias("tf"))
    tf = tf.withColumn("df", F.count("*").over(Window.partitionBy("query_id", "term"))).join(sizes, keys)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    bound = F.col("tf") + k1 * (1 - b + b * F.col("size") / F.greatest(F.col("avg"), F.lit(1.0)))
    score = tf.groupBy(*keys).agg(F.round(F.sum(F.col("times") * idf * F.col("tf") * (k1 + 1) / bound), 6).alias("keyword_score"))
    return candidates.join(score, keys, "left").withColumn("keyword_score", F.coalesce("keyword_score", F.lit(0.0)))


def fuse(candidates: DataFrame, k: int | None = None, constant: int = FUSION, weights: tuple[float, float] = (VECTOR_WEIGHT, KEYWORD_WEIGHT)) -> DataFrame:
    """candidates (query_id, id, rank, keyword_score, ...) with fused and fused_rank: weighted reciprocal ranks of the vector
    hits; the keyword rank is that of the scores, ties by vector rank. Nothing but vector hits comes out."""
    per = Window.partitionBy("query_id")
    ranked = candidates.withColumn("keyword_rank", F.row_number().over(per.orderBy(F.desc("keyword_score"), "rank")))
    score = weights[0] / (constant + F.col("rank")) + weights[1] / (constant + F.col("keyword_rank"))
    out = ranked.withColumn("fused", F.round(score, 9)).withColumn("fused_rank", F.row_number().over(per.orderBy(F.desc("fused"), "rank")))
    return out if k is None else out.filter(F.col("fused_rank") <= k)


def windows(docs: DataFrame, words: Column, size: int = 400, overlap: int = 75) -> DataFrame:
    """doc_id, chunk_index, n_words of windows of `size` words, each starting size - overlap after the last."""
    step = size - overlap
    n = F.size("_w")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - overlap) / step).cast("int") - 1))
    rows = docs.select("doc_id", words.alias("_w")).filter(n > 0).select("doc_id", F.explode(starts).alias("chunk_index"), n.alias("_n"))
    n_words = F.least(F.lit(size), F.col("_n") - F.col("chunk_index") * step).cast("long")
    return rows.select("doc_id", F.col("chunk_index").cast("long"), n_words.alias("n_words"))
