"""From a question's candidates to its context: one grouped step for the whole chain.

Keyword scores, fusion, re-ranking, gate, document coverage, diversity, strict block, context and confidence all look at one
question's list, which is a top-k result (MOST rows at most), so the lists are brought together once and every step is taken
there. The steps equal the Column forms in ranking and retrieval; those serve lists that are used step by step."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from skein.operators import ranking as K
from skein.operators import retrieval as R

#: Rows that a strict answer needs, weight of relevance in strict and other answers, characters of a context.
SUPPORT, STRICT_WEIGHT, WEIGHT, BUDGET, FALLBACK_BUDGET = 3, 0.75, 0.7, 3500, 2500
#: Candidates of a question.
MOST = 1000
SCHEMA = (
    "query_id long, decision string, picks array<long>, n_pass long, n_added long, n_used long, context string, "
    "caution string, confidence double, warnings string"
)
TOKEN = re.compile(r"\w+")


def space_words(text: str | None) -> list[str]:
    return [w for w in (text or "").lower().split(" ") if w]


def keyword_scores(asked: str, contents: list[str | None]) -> list[float]:
    """BM25 of each candidate with the statistics of the list; a term asked twice counts twice."""
    docs = [TOKEN.findall((c or "").lower()) for c in contents]
    times = Counter(TOKEN.findall(asked.lower()))
    counts = [Counter(t for t in d if t in times) for d in docs]
    df = Counter(t for c in counts for t in c)
    n, mean = len(docs), max(sum(map(len, docs)) / max(len(docs), 1), 1.0)
    out = []
    for d, c in zip(docs, counts):
        bound = R.K1 * (1 - R.B + R.B * len(d) / mean)
        out.append(round(math.fsum(times[t] * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (R.K1 + 1) / (f + bound) for t, f in c.items()), 6))
    return out


def keyword_share(query: str | None, words: list[str]) -> float:
    q = {w for w in space_words(query) if len(w) > 2}
    return len(q & set(words)) / len(q) if q else 0.0


def proximity(query: str | None, words: list[str]) -> float:
    terms = [w for w in space_words(query) if len(w) > 2]
    if len(terms) < 2 or not all(any(t in w for w in words) for t in terms):
        return 0.0
    a = b = None
    least = None
    for i, w in enumerate(words):
        a, b = (i if terms[0] in w else a), (i if terms[1] in w else b)
        if a is not None and b is not None:
            least = abs(a - b) if least is None else min(least, abs(a - b))
    return 1 / (1 + least) if least is not None else 0.0


def ordered(rows: list[dict], asked: str, k: int) -> list[dict]:
    """The best 2k by weighted reciprocal ranks, in the order of the re-ranking."""
    rows = sorted(rows, key=lambda r: r["rank"])
    for r, s in zip(rows, keyword_scores(asked, [r["content"] for r in rows])):
        r["keyword"] = s
    for i, r in enumerate(sorted(rows, key=lambda r: (-r["keyword"], r["rank"])), 1):
        r["fused"] = round(R.VECTOR_WEIGHT / (R.FUSION + r["rank"]) + R.KEYWORD_WEIGHT / (R.FUSION + i), 9)
    best = sorted(rows, key=lambda r: (-r["fused"], r["rank"]))[: 2 * k]
    for r in best:
        words = space_words(r["content"])
        r["score"] = round(r["similarity"] + K.KEYWORD * keyword_share(r["query"], words) + K.PROXIMITY * proximity(r["query"], words) + K.POSITION / (r["chunk_index"] + 10), 6)
    return sorted(best, key=lambda r: (-r["score"], r["id"]))


def covered(kept: list[dict], ranked: list[dict], k: int) -> tuple[list[dict], int]:
    """kept with the first row of further sources until max(2, min(k, 3)) are there or the list is full."""
    every = len({r["source"] for r in ranked})
    if every < 2:
        return kept or ranked[: max(k, 3)], 0
    desired, most, out = min(every, max(2, min(k, 3))), max(2 * k, len(kept)), list(kept)
    have = {r["source"] for r in kept}
    for r in ranked:
        if len(have) >= desired or len(out) >= most:
            break
        if r["source"] not in have:
            have.add(r["source"])
            out.append(r)
    return out, len(out) - len(kept)


def diverse(pool: list[dict], k: int, weight: float) -> list[dict]:
    """The first of the pool, then what is relevant and least like the picks so far; without a vector the likeness is 0."""
    import numpy as np

    size = max((len(r["embedding"]) for r in pool if r["embedding"] is not None), default=1)
    x = np.stack([np.asarray(r["embedding"], float) if r["embedding"] is not None and len(r["embedding"]) == size else np.zeros(size) for r in pool])
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    sim, worst, chosen = np.array([r["similarity"] for r in pool]), np.zeros(len(pool)), [0]
    while len(chosen) < min(k, len(pool)):
        worst = np.maximum(worst, x @ x[chosen[-1]])
        value = np.round(weight * sim - (1 - weight) * worst, 9)
        value[chosen] = -np.inf
        chosen.append(int(np.argmax(value)))
    return [pool[i] for i in chosen]


def context_of(rows: list[dict], budget: int) -> tuple[str, int]:
    """Blocks in order while they fit; the first is always kept."""
    out, n = "", 0
    for i, r in enumerate(rows, 1):
        block = f"[Document Chunk {i}, Similarity: {r['similarity']:.3f}]\n{r['content'] or ''}" + (K.SEPARATOR if i < len(rows) else "")
        if n and len(out) + len(block) > budget:
            break
        out, n = out + block, n + 1
    return out, n


def assessed(rows: list[dict], query: str | None, n_docs: int) -> tuple[float, str]:
    top, n, s, words = rows[0]["similarity"], len(rows), len({r["source"] for r in rows}), len(space_words(query))
    score = 0.5 * min(top / 0.8, 1) + 0.2 * min(n / 5, 1) + 0.2 * min(s / max(n_docs, 1), 1) + 0.1 * min(words / 5, 1)
    said = ["Low relevance"] * (top < 0.4) + ["Moderate relevance"] * (0.4 <= top < 0.6) + ["Limited context"] * (n < 3)
    said += ["Single source"] * (s == 1 and n_docs > 1) + ["Generic query"] * (words <= 2)
    return round(score, 6), "; ".join(said)


def answer_one(rows: list[dict], k: int, n_docs: int, strict: bool, lenient: bool, budget: int) -> dict:
    query, asked = rows[0]["query"], rows[0]["asked"]
    for r in rows:
        r["source"] = r["source"] or "Unknown"
    short = space_words(query)
    k = min(k, 3) if len(short) <= 2 else k
    ranked = ordered(rows, asked or "", k)
    sims = [r["similarity"] for r in ranked]
    trivial = len(short) <= 2 or (query or "").strip(" ").lower() in K.TRIVIAL
    limit = K.STRICT if strict and not lenient and not trivial else K.LENIENT
    top, second, mean = sims[0], (sims[1] if len(sims) > 1 else 0.0), round(math.fsum(sims[:5]) / len(sims[:5]), 6)
    override = top >= 0.5 or top >= 0.38 and round(top - mean, 6) >= 0.05 or round(top - second, 6) >= 0.07
    kept = [r for r in ranked if r["similarity"] >= limit]
    out = {"n_pass": len(kept), "n_added": 0, "caution": None, "confidence": 0.0, "warnings": ""}
    if not kept and not (override or lenient or trivial):
        context, n = context_of(ranked[: max(k, 3)], FALLBACK_BUDGET)
        said = "Low-confidence retrieval: answered using extractive on-device analysis"
        return out | {"decision": "fallback_ondevice_low_confidence", "picks": [r["id"] for r in ranked[:n]], "n_used": n, "context": context, "warnings": said}
    decision = "accept" if kept else "override"
    pool, added = covered(kept or ranked[: 2 * k], ranked, k)
    picks = diverse(pool, k, STRICT_WEIGHT if strict else WEIGHT)
    out |= {"picks": [r["id"] for r in picks], "n_added": added}
    if strict and not (lenient or override or trivial) and sum(r["similarity"] >= K.STRICT for r in picks) < SUPPORT:
        lines = [f"- [{i}] {r['source']}: {100 * r['similarity']:.0f}%" for i, r in enumerate(picks[:3], 1)]
        said = "Strict mode: insufficient supporting evidence"
        return out | {"decision": "strict_blocked", "n_used": 0, "context": "", "caution": "Top sources retrieved:\n" + "\n".join(lines), "warnings": said}
    context, n = context_of(picks, budget)
    confidence, warnings = assessed(picks, query, n_docs)
    return out | {"decision": decision, "n_used": n, "context": context, "confidence": confidence, "warnings": warnings}


def answers(candidates: DataFrame, k: int, n_docs: int, strict: bool = True, lenient: bool = False, budget: int = BUDGET) -> DataFrame:
    """A row for each question of candidates (query_id, query, asked, id, similarity, rank, chunk_index, source, content,
    embedding): its 4k nearest chunks. asked is the text whose words count for the keyword score (the question with its
    expansions). decision: accept, override, strict_blocked or fallback_ondevice_low_confidence; picks in their order.

    Defined results: a null content or vector counts as empty; a null source is Unknown; ties go to the better vector rank,
    then to the smaller id; a question without candidates has no row; more than MOST candidates of one are an error."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    columns = ["query_id", "query", "asked", "id", "similarity", "rank", "chunk_index", "source", "content", "embedding"]

    def run(key, g):
        import pandas as pd

        if len(g) > MOST:
            raise ValueError(f"{len(g)} candidates of one question; the lists are top-k results")
        rows = [{c: None if isinstance(v, float) and math.isnan(v) else v for c, v in r.items()} for r in g.to_dict("records")]
        made = answer_one(rows, k, n_docs, strict, lenient, budget) | {"query_id": key[0]}
        return pd.DataFrame([[made[n] for n in names]], columns=names)

    return candidates.select(*columns).groupBy("query_id").applyInPandas(run, SCHEMA)
