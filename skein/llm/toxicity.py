"""Toxicity by a convolutional text classifier trained in numpy.

Words are hashed to BUCKETS embeddings; filters of several widths run over the whole text; each filter's
maximum goes to a logistic layer. One embedding dimension starts from the words' smoothed log odds in one half
of the training rows, the network is trained on the other half. The raw score is calibrated (Platt) on rows kept
out of training, so that THRESHOLD means the same everywhere. The filter, drop_toxic(), has a threshold for each language,
fitted on labelled rows kept out of training.
"""

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_row, table

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 8, 6, (1, 2, 3)
#: The model is fitted on so many labelled rows of each class at most, chosen by a hash, of so many code points at most.
SAMPLE, SAMPLE_CHARS, EPOCHS, THRESHOLD = 2500, 20_000, 6, 0.3
#: Thresholds by language are multiples of 1 / STEPS, and need so many labelled rows of each class.
STEPS, LEAST = 20, 20
WORD = re.compile(r"\w+")


class Buckets:
    def __init__(self, limit: int = 500_000):
        self.limit, self.known = limit, {}

    def __call__(self, text: str | None):
        import numpy as np
        from xxhash import xxh32_intdigest

        words, known = WORD.findall((text or "").lower()), self.known
        if len(known) > self.limit:
            known.clear()
        edge = [0] * (WIDTHS[-1] - 1)  # 0 is padding
        try:
            return np.array([*edge, *[known[w] for w in words], *edge], np.int32)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxh32_intdigest(w.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1
            return np.array([*edge, *[known[w] for w in words], *edge], np.int32)


def activations(model: dict, x):
    """For each width, the filters' activations (filters, places): sums of rows of the tables, contiguous along the text."""
    for w in WIDTHS:
        n, tab = len(x) - w + 1, model["table"][w]
        act = tab[0].take(x[:n], axis=1)
        for j in range(1, w):
            act += tab[j].take(x[j : j + n], axis=1)
        act += model["bias"][w][:, None]
        yield act


def pooled(model: dict, x):
    """Each filter's maximum over the text and the place of it."""
    import numpy as np

    best, at = [], []
    for act in activations(model, x):
        at.append(act.argmax(axis=1))
        best.append(act[np.arange(FILTERS), at[-1]])
    return np.maximum(np.concatenate(best), 0), at


def tables(model: dict) -> None:
    """The filters applied to every embedding once: (filters, buckets) for each width and place in it."""
    import numpy as np

    model["table"] = {w: [np.ascontiguousarray((model["emb"] @ model["conv"][w][j]).T, dtype=np.float32) for j in range(w)] for w in WIDTHS}


def train(rows: list[tuple[str | None, int]], seed: int = 7, odds_ratio: float = 1.0) -> dict:
    """odds_ratio: the odds of label 1 among all labelled rows, over those among rows; it moves the calibration."""
    import numpy as np

    rng, buckets = np.random.default_rng(seed), Buckets()
    data = [(buckets(t), int(y)) for t, y in rows]
    data = [data[i] for i in rng.permutation(len(data))]
    odds_part, fit_part = data[: len(data) * 2 // 5], data[len(data) * 2 // 5 : len(data) * 4 // 5]
    held = data[len(data) * 4 // 5 :]
    counts = np.zeros((2, BUCKETS))
    for x, y in odds_part:
        counts[y, np.unique(x)] += 1
    size = np.maximum(1, [sum(y == k for _, y in odds_part) for k in (0, 1)])
    odds = np.log((counts[1] + 1) / (size[1] + 2)) - np.log((counts[0] + 1) / (size[0] + 2))
    odds *= counts.sum(axis=0) / (counts.sum(axis=0) + 10)
    model = {"emb": rng.normal(0, 0.02, (BUCKETS, DIM)), "conv": {w: rng.normal(0, 0.1, (w, DIM, FILTERS)) for w in WIDTHS}, "bias": {w: np.full(FILTERS, -1.0, np.float32) for w in WIDTHS}, "out": np.full(FILTERS * len(WIDTHS), 0.15), "b": -1.5, "scale": 1.0, "shift": 0.0}
    model["emb"][:, 0] = odds
    model["emb"][0] = 0
    for w in WIDTHS:
        model["conv"][w][:, 0, :] = rng.uniform(0.6, 1.0, (w, FILTERS))
    share = len(fit_part) / np.maximum(1, 2 * np.bincount([y for _, y in fit_part], minlength=2))  # classes weigh alike
    rate = 0.05
    for epoch in range(EPOCHS):
        for start in range(0, len(fit_part), 50):
            tables(model)
            step = rate / (1 + epoch)
            grad_out, grad_b, moves = np.zeros_like(model["out"]), 0.0, []
            batch = fit_part[start : start + 50]
            for x, y in batch:
                f, at = pooled(model, x)
                g = 1 / (1 + np.exp(-np.clip(f @ model["out"] + model["b"], -30, 30))) - y
                g *= share[y]
                grad_out += g * f
                grad_b += g
                back = g * model["out"] * (f > 0)
                for k, w in enumerate(WIDTHS):
                    moves.append((w, x[at[k][:, None] + np.arange(w)], back[k * FILTERS : (k + 1) * FILTERS]))
            n = len(batch)
            for w, words, g in moves:
                e = model["emb"][words]  # filters, width, dim
                np.add.at(model["emb"], (words,), -step * np.einsum("f,wdf->fwd", g, model["conv"][w]))
                model["conv"][w] -= step / n * np.einsum("f,fwd->wdf", g, e)
                model["bias"][w] -= (step / n * g).astype(np.float32)
            model["emb"][0] = 0
            model["out"] -= step * grad_out / n
            model["b"] -= step * grad_b / n
    tables(model)
    if held:
        z = np.array([raw(model, x) for x, _ in held])
        y = np.array([y for _, y in held], float)
        a, c = 1.0, 0.0
        for _ in range(30):  # Newton steps of a logistic fit with a weak prior on the scale
            q = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
            v = q * (1 - q) + 1e-6
            h = np.array([[(v * z * z).sum() + 1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.01]])
            move = np.linalg.solve(h, np.array([((q - y) * z).sum() + (a - 1), (q - y).sum() + 0.01 * c]))
            a, c = a - np.clip(move[0], -1, 1), c - np.clip(move[1], -2, 2)
        a = max(0.1, a)
        model["scale"], model["shift"] = a, c + float(np.log(odds_ratio))
    return {k: v for k, v in model.items() if k not in ("emb", "conv")}


def raw(model: dict, x) -> float:
    import numpy as np

    f = np.maximum(np.concatenate([act.max(axis=1) for act in activations(model, x)]), 0)
    return float(f @ model["out"] + model["b"])


def score_text(model: dict, buckets: Buckets, text: str | None) -> float:
    import math

    return 1 / (1 + math.exp(-max(-30, min(30, model["scale"] * raw(model, buckets(text)) + model["shift"]))))


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> dict:
    """The model from a bounded sample of labelled rows of docs, SAMPLE of each class, for which usable holds."""
    spark = docs.sparkSession
    known = labels.filter(usable & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    chosen = [r for k in (0, 1) for r in known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()]
    if not chosen:
        return train([("", 0), ("", 1)])
    few = spark.createDataFrame([tuple(r) for r in chosen], "doc_id long, toxic int").dropDuplicates(["doc_id"])  # 2 * SAMPLE rows at most
    rows = docs.select("doc_id", "text").filter(F.char_length("text") <= SAMPLE_CHARS).join(F.broadcast(few), "doc_id").limit(4 * SAMPLE).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or "", r.toxic))
    every = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    hits = sum(r.toxic for r in rows)
    ratio = every[1] / every[0] / (hits / (len(rows) - hits)) if len(every) == 2 and 0 < hits < len(rows) else 1.0
    return train([(r.text, r.toxic) for r in rows], odds_ratio=ratio)


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """All rows and columns of docs as struct row, with score (0 to 1).

    Defined results: null and empty texts get the score of a text without words; repeated rows equal scores; the score
    depends on the text alone; an empty table gives no rows; docs' own columns are inside row, so that no name can clash."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 6 * BUCKETS * FILTERS numbers

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets, m = Buckets(), shared.value
        for texts in batches:
            yield pd.Series([score_text(m, buckets, t) for t in texts], dtype="float64")

    return docs.select(as_row(docs).alias("row"), score(docs["text"]).alias("score"))


def thresholds(counts: list[tuple[str, int, int, int]], start: float = THRESHOLD) -> dict[str, float]:
    """The threshold with the best F1 in each language, `start` where a language has under LEAST rows of a class.

    counts: language, the score in whole steps of 1 / STEPS, label, rows."""
    out = {}
    for lang in {r[0] for r in counts}:
        mine = [r[1:] for r in counts if r[0] == lang]
        total, hits = sum(n for *_, n in mine), sum(n for _, y, n in mine if y)
        if min(hits, total - hits) < LEAST:
            out[lang] = start
            continue
        f1 = lambda k, mine=mine, hits=hits: 2 * sum(n for b, y, n in mine if y and b >= k) / max(1, hits + sum(n for b, _, n in mine if b >= k))
        out[lang] = max(range(2, STEPS - 1), key=lambda k: (f1(k), -abs(k / STEPS - start))) / STEPS
    return out


def fold() -> Column:
    """Rows in fold 2 are held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """predicted is by THRESHOLD; lang_threshold and lang_predicted are by the threshold of the row's language, fitted on the
    labelled rows of fold 2, which the score has not seen."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, fold() != 2)
    limits = thresholds(language_counts(docs, labels, model, fold() == 2))
    out = scored(docs.select("doc_id", "text", "lang"), model).select("row.doc_id", "score", limit_of(F.col("row.lang"), limits).alias("lang_threshold"))
    at = lambda limit: (F.col("score") >= limit).cast("int")
    held = F.coalesce(fold() == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", at(THRESHOLD).alias("predicted"), "lang_threshold", at(F.col("lang_threshold")).alias("lang_predicted"))


def language_counts(docs: DataFrame, labels: DataFrame, model: dict, usable: Column) -> list[tuple[str, int, int, int]]:
    """thresholds()' counts of the labelled rows for which usable holds; languages with LEAST rows of both classes only.

    At most 2 * STEPS rows a language are collected. A doc_id labelled both ways counts as toxic."""
    known = labels.filter(usable & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    mine = docs.filter(usable & F.col("lang").isNotNull()).select("doc_id", "lang", "text").join(known, "doc_id")
    step = F.least(F.floor(F.col("score") * STEPS), F.lit(STEPS - 1)).cast("int").alias("step")
    hist = scored(mine, model).groupBy("row.lang", step, "row.toxic").count()
    each = Window.partitionBy("lang")
    of = lambda y: F.sum(F.when(F.col("toxic") == y, F.col("count")).otherwise(0)).over(each)
    rows = hist.withColumn("toxics", of(1)).withColumn("cleans", of(0)).filter(F.least("toxics", "cleans") >= LEAST)
    return [(r["lang"], r["step"], r["toxic"], r["count"]) for r in rows.collect()]


def limit_of(lang: Column, limits: dict[str, float]) -> Column:
    """The threshold of a language; THRESHOLD for a null one and one without its own."""
    if not limits:
        return F.lit(THRESHOLD)
    pairs = F.create_map(*[F.lit(v) for pair in sorted(limits.items()) for v in pair])
    return F.coalesce(F.try_element_at(pairs, lang), F.lit(THRESHOLD))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) below the threshold of their language, which is fitted on fold 2; the model on the others."""
    model = fit(docs, labels, fold() != 2)
    limits = thresholds(language_counts(docs, labels, model, fold() == 2))
    return scored(docs, model).filter(F.col("score") < limit_of(F.col("row.lang"), limits)).select("row.*")
