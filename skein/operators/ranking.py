"""Re-ranking, gating, diversity, coverage and context assembly over candidate lists (query_id, id, similarity, rank, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the gate and of re-ranking.
STRICT, LENIENT = 0.52, 0.35
KEYWORD, PROXIMITY, POSITION = 0.2, 0.15, 0.05


def space_words(text: Column) -> Column:
    """Lower-cased words between single spaces; other white space does not separate."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), " ", -1), lambda w: w != "")


def keyword_match(query: Column, content: Column) -> Column:
    """Share of the query's distinct words of three or more letters found in the content; 0 without such words."""
    q = F.array_distinct(F.filter(space_words(query), lambda w: F.char_length(w) > 2))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, space_words(content))) / F.size(q)).otherwise(F.lit(0.0))


def term_proximity(query: Column, content: Column) -> Column:
    """1 / (1 + least distance) between words containing the query's first two terms; 0 unless every term occurs.

    One fold over the words keeps the last place of each of the two, so long texts cost linear time."""
    terms = F.filter(space_words(query), lambda w: F.char_length(w) > 2)
    words = space_words(content)
    no, far = F.lit(-(1 << 30)), F.lit(1 << 30)
    start = F.struct(F.lit(0).alias("i"), no.alias("a"), no.alias("b"), far.alias("d"))

    def step(s: Column, w: Column) -> Column:
        a = F.when(F.contains(w, F.get(terms, F.lit(0))), s["i"]).otherwise(s["a"])
        b = F.when(F.contains(w, F.get(terms, F.lit(1))), s["i"]).otherwise(s["b"])
        d = F.when((a >= 0) & (b >= 0), F.least(s["d"], F.abs(a - b))).otherwise(s["d"])
        return F.struct((s["i"] + 1).alias("i"), a.alias("a"), b.alias("b"), d.alias("d"))

    least = F.aggregate(words, start, step, lambda s: s["d"])
    every = F.forall(terms, lambda t: F.exists(words, lambda w: F.contains(w, t)))
    return F.when((F.size(terms) >= 2) & every, F.lit(1.0) / (least + 1)).otherwise(F.lit(0.0))


def rerank(candidates: DataFrame, k: int) -> DataFrame:
    """Adds score and new_rank to candidates (query_id, id, query, content, similarity, chunk_index); similarity stays."""
    score = F.col("similarity") + KEYWORD * keyword_match(F.col("query"), F.col("content")) + PROXIMITY * term_proximity(F.col("query"), F.col("content")) + F.lit(POSITION) / (F.col("chunk_index") + 10)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return candidates.withColumn("score", F.round(score, 6)).withColumn("new_rank", F.row_number().over(w)).filter(F.col("new_rank") <= k)


#: Words that make a query trivial.
TRIVIAL = ["test", "help", "hello", "hi", "hey", "ok", "okay"]


def is_trivial(query: Column) -> Column:
    """Two words at most, or one of the trivial ones."""
    return (F.size(space_words(query)) <= 2) | F.lower(F.trim(F.coalesce(query, F.lit("")))).isin(TRIVIAL)


def gate(ranked: DataFrame, strict: bool = True, lenient: bool = False) -> DataFrame:
    """query_id, top, second, avg_top5, limit, n_pass, override, decision from a re-ranked list (query_id, query, similarity,
    new_rank): the raw similarities in the order of the re-ranking."""
    at = lambda r: F.max(F.when(F.col("new_rank") == r, F.col("similarity")))
    easy = F.lit(not strict or lenient) | F.col("trivial")
    rows = ranked.withColumn("trivial", is_trivial(F.col("query"))).withColumn("limit", F.when(easy, LENIENT).otherwise(STRICT))
    m = rows.groupBy("query_id", "trivial", "limit").agg(
        at(1).alias("top"),
        F.coalesce(at(2), F.lit(0.0)).alias("second"),
        F.round(F.avg(F.when(F.col("new_rank") <= 5, F.col("similarity"))), 6).alias("avg_top5"),
        F.sum((F.col("similarity") >= F.col("limit")).cast("long")).alias("n_pass"),
    )
    wide = (F.col("top") >= 0.38) & (F.round(F.col("top") - F.col("avg_top5"), 6) >= 0.05)
    override = (F.col("top") >= 0.5) | wide | (F.round(F.col("top") - F.col("second"), 6) >= 0.07)
    m = m.withColumn("override", override)
    eased = F.col("override") | F.lit(lenient) | F.col("trivial")
    decision = F.when(F.col("n_pass") > 0, "accept").when(eased, "override").otherwise("fallback_ondevice_low_confidence")
    return m.withColumn("decision", decision)


def gated(ranked: DataFrame, k: int, strict: bool = True, lenient: bool = False) -> DataFrame:
    """The rows of a re-ranked list that pass the gate: those at the limit, else under an override the first 2k."""
    g = gate(ranked, strict, lenient).select("query_id", "limit", "n_pass", "override", "decision")
    rows = ranked.join(F.broadcast(g), "query_id")
    over = (F.col("decision") == "override") & (F.col("new_rank") <= 2 * k)
    return rows.filter(((F.col("n_pass") > 0) & (F.col("similarity") >= F.col("limit"))) | over)


def coverage(ranked: DataFrame, kept: DataFrame, k: int) -> DataFrame:
    """query_id, id, source, added: the kept rows (query_id, id, source, new_rank), cut at max(2k, n), and the first row of
    sources not among them from the whole list, until there are max(2, min(k, 3)) sources or the list is full."""
    per = Window.partitionBy("query_id")
    desired = F.lit(max(2, min(k, 3)))
    n = ranked.groupBy("query_id").agg(F.countDistinct("source").alias("sources"))
    mine = kept.select("query_id", "id", "source", "new_rank").withColumn("place", F.row_number().over(per.orderBy("new_rank")))
    mine = mine.filter(F.col("place") <= 2 * k)
    have = mine.groupBy("query_id").agg(F.countDistinct("source").alias("have"), F.count("*").alias("rows"))
    new = ranked.join(mine.select("query_id", "source").distinct(), ["query_id", "source"], "left_anti")
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("new_rank"))).filter("_n = 1")
    first = first.withColumn("turn", F.row_number().over(per.orderBy("new_rank"))).join(n, "query_id").join(have, "query_id", "left")
    need = F.least(desired, F.col("sources")) - F.coalesce("have", F.lit(0))
    room = F.lit(2 * k) - F.coalesce("rows", F.lit(0))
    extra = first.filter((F.col("sources") > 1) & (F.col("turn") <= F.least(need, room)))
    cols = ["query_id", "id", "source"]
    return mine.select(*cols, F.lit(False).alias("added")).union(extra.select(*cols, F.lit(True)))


def mmr(candidates: DataFrame, k: int, weight: float = 0.75) -> DataFrame:
    """query_id, id, pick: maximal marginal relevance over each query's candidates (query_id, id, similarity, rank,
    embedding). The lists are top-k results already, so a group is bounded by their length. Ties go to the better rank."""

    def pick(g):
        import numpy as np
        import pandas as pd

        g = g.sort_values("rank")
        x = np.stack([np.asarray(v, float) for v in g["embedding"]])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        sim, worst, chosen = g["similarity"].to_numpy(float), np.zeros(len(g)), [0]
        while len(chosen) < min(k, len(g)):
            worst = np.maximum(worst, x @ x[chosen[-1]])
            value = np.round(weight * sim - (1 - weight) * worst, 9)
            value[chosen] = -np.inf
            chosen.append(int(np.argmax(value)))
        return pd.DataFrame({"query_id": g["query_id"].to_numpy()[chosen], "id": g["id"].to_numpy()[chosen], "pick": np.arange(1, len(chosen) + 1)})

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id long, id long, pick long")


#: Fixed value: what parts the blocks of a context.
SEPARATOR = "\n\n---\n\n"


def block(place: Column, similarity: Column, content: Column, is_last: Column) -> Column:
    """One block of a context: its header, the text and the separator, which the last of the input has not."""
    head = F.concat(F.lit("[Document Chunk "), place.cast("string"), F.lit(", Similarity: "), F.format_string("%.3f", similarity), F.lit("]\n"))
    return F.concat(head, F.coalesce(content, F.lit("")), F.when(is_last, F.lit("")).otherwise(F.lit(SEPARATOR)))


def assemble(candidates: DataFrame, budget: int) -> DataFrame:
    """query_id, n_used, n_chars, context: blocks of candidates (query_id, rank, similarity, content) in rank order while they
    fit the budget; the first is always kept and the first overflow ends the context. Lists are top-k results."""
    per = Window.partitionBy("query_id")
    last = F.col("place") == F.count("*").over(per)
    rows = candidates.withColumn("place", F.row_number().over(per.orderBy("rank")))
    rows = rows.select("query_id", "place", block(F.col("place"), F.col("similarity"), F.col("content"), last).alias("b"))
    run = rows.withColumn("total", F.sum(F.char_length("b")).over(per.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    kept = run.filter((F.col("place") == 1) | (F.col("total") <= budget)).groupBy("query_id")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "b"))), lambda x: x["b"]), "")
    return kept.agg(F.count("*").alias("n_used"), F.max("total").cast("long").alias("n_chars"), whole.alias("context"))


def token_budget(n_chars: Column, configured: int) -> Column:
    """Tokens left for an answer: a quarter of the characters are tokens of the prompt, 4,000 is the window, 400 its margin."""
    left = F.lit(4000 - 400) - F.floor(n_chars / 4)
    return F.least(F.lit(configured), F.greatest(F.lit(128), left)).cast("long")


def confidence(rows: DataFrame, n_docs: int) -> DataFrame:
    """query_id, confidence, warnings of context rows (query_id, query, similarity, rank, source)."""
    c = rows.groupBy("query_id", "query").agg(
        F.max_by("similarity", -F.col("rank")).alias("top"), F.count("*").alias("n"), F.countDistinct(F.coalesce("source", F.lit("Unknown"))).alias("s")
    )
    words, one = F.size(space_words(F.col("query"))), F.lit(1.0)
    score = 0.5 * F.least(F.col("top") / 0.8, one) + 0.2 * F.least(F.col("n") / 5, one)
    score = score + 0.2 * F.least(F.col("s") / max(n_docs, 1), one) + 0.1 * F.least(words / 5, one)
    said = F.array(
        F.when(F.col("top") < 0.4, "Low relevance").when(F.col("top") < 0.6, "Moderate relevance"),
        F.when(F.col("n") < 3, "Limited context"),
        F.when((F.col("s") == 1) & F.lit(n_docs > 1), "Single source"),
        F.when(words <= 2, "Generic query"),
    )
    return c.select("query_id", F.round(score, 6).alias("confidence"), F.array_join(F.array_compact(said), "; ").alias("warnings"))
