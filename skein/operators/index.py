"""An approximate index of vectors: coarse centroids, a list of rows for each, and a search of the nearest lists.

Centroids are fitted on a bounded sample; every row is in a list. How many lists a search must look at depends on the vectors
(those without any structure need most of them), so it is measured against the exact search and not assumed."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators.retrieval import BROADCAST_BYTES, QUERY_BLOCK, knn

#: Rows of the sample that centroids are fitted on, rounds of the fit, and the least recall of a calibrated search.
SAMPLE, ROUNDS, RECALL = 20_000, 8, 0.9


def unit(x):
    import numpy as np

    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > 0, n, np.inf)


class Index:
    """rows: vec_id, embedding, list. Vectors that are null, of another dimension or of no length are in list -1, which an
    exact search looks at, too."""

    def __init__(self, rows: DataFrame, centroids):
        self.rows, self.centroids = rows, centroids

    @classmethod
    def fit(cls, vectors: DataFrame, dim: int, lists: int, sample: int = SAMPLE) -> Index:
        """Centroids by rounds of means over the `sample` rows with the smallest hash of their id, then a list for every row."""
        import numpy as np

        rows = vectors.select("vec_id", "embedding")
        some = rows.filter(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()  # a bounded sample
        x = unit(np.array([r["embedding"] for r in some], float).reshape(-1, dim))
        x = x[np.isfinite(x).all(axis=1) & (np.abs(x).sum(axis=1) > 0)]
        c = x[: max(1, lists)].copy()
        for _ in range(ROUNDS if len(x) else 0):
            at = (x @ c.T).argmax(axis=1)
            c = unit(np.stack([x[at == i].sum(axis=0) if (at == i).any() else c[i] for i in range(len(c))]))
        shared = vectors.sparkSession.sparkContext.broadcast(c)  # lists * dim numbers

        def run(batches: Iterator) -> Iterator:
            for b in batches:
                fits = np.array([e is not None and len(e) == dim for e in b["embedding"]], bool)
                where = np.full(len(b), -1)
                if fits.any() and len(shared.value):
                    v = unit(np.stack(b["embedding"][fits].to_numpy()).astype(float))
                    near = (v @ shared.value.T).argmax(axis=1)
                    near[~np.isfinite(v).all(axis=1) | (np.abs(v).sum(axis=1) == 0)] = -1
                    where[np.flatnonzero(fits)] = near
                yield b.assign(list=where.astype("int32"))

        kind = rows.schema["embedding"].dataType.simpleString()
        return cls(rows.mapInPandas(run, f"vec_id long, embedding {kind}, list int"), c)

    def save(self, path: str) -> None:
        """A folder for each list, so that a search reads those that it looks at, and the centroids."""
        self.rows.repartition("list", F.pmod(F.xxhash64("vec_id"), F.lit(8))).write.partitionBy("list").parquet(f"{path}/rows")
        spark = self.rows.sparkSession
        spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(self.centroids)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        import numpy as np

        c = [r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()]  # one row a list
        return cls(spark.read.parquet(f"{path}/rows"), np.array(c, float))

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query_id, vec_id, similarity, rank of queries (query_id, embedding): the k nearest in the `probes` nearest lists, or
        exactly, in all. The queries are a stated set, broadcast by blocks; only the lists that a block asks for are read."""
        import numpy as np

        if probes is None or probes >= len(self.centroids):
            return knn(self.rows, queries, k)
        dim = self.centroids.shape[1]
        asked = queries.filter(F.size("embedding") == dim).select("query_id", "embedding").toPandas()
        step = max(1, BROADCAST_BYTES // (8 * dim))
        schema, out = "query_id long, vec_id long, similarity double", None
        for at in range(0, len(asked), step):
            some = asked.iloc[at : at + step]
            q = unit(np.stack(some["embedding"].to_numpy()).astype(float))
            wanted = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :probes]
            shared = self.rows.sparkSession.sparkContext.broadcast((some["query_id"].to_numpy(), q, wanted))
            rows = self.rows.filter(F.col("list").isin(sorted(set(wanted.ravel().tolist()))))
            found = rows.mapInPandas(probing(shared, k), schema)
            out = found if out is None else out.union(found)
        if out is None:
            return knn(self.rows, queries, k)
        best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
        return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def recall(self, queries: DataFrame, k: int, probes: int) -> float:
        """The share of the exact k nearest that a search with so many probes finds."""
        exact = knn(self.rows, queries, k).select("query_id", "vec_id")
        found = self.search(queries, k, probes).select("query_id", "vec_id", F.lit(1).alias("found"))
        n = exact.join(found, ["query_id", "vec_id"], "left").agg(F.count("*").alias("n"), F.count("found").alias("found")).first()
        return n["found"] / n["n"] if n["n"] else 1.0

    def calibrate(self, queries: DataFrame, k: int, least: float = RECALL) -> int:
        """The smallest number of probes, by halving, whose recall on these queries is `least`."""
        low, high = 1, len(self.centroids)
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.recall(queries, k, middle) >= least else (middle + 1, high)
        return low


def probing(shared, k: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        ids, q, wanted = shared.value
        askers: dict[int, np.ndarray] = {int(i): np.flatnonzero((wanted == i).any(axis=1)) for i in np.unique(wanted)}
        for b in batches:
            for name, g in b.groupby("list"):
                who = askers.get(int(name))
                if who is None or not len(who):
                    continue
                g = g.sort_values("vec_id", kind="stable")
                v, vec = unit(np.stack(g["embedding"].to_numpy()).astype(float)), g["vec_id"].to_numpy()
                for at in range(0, len(who), QUERY_BLOCK):
                    mine = who[at : at + QUERY_BLOCK]
                    sim = np.round(q[mine] @ v.T, 6) + 0.0
                    top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                    yield pd.DataFrame({"query_id": np.repeat(ids[mine], top.shape[1]), "vec_id": vec[top].ravel(), "similarity": np.take_along_axis(sim, top, axis=1).ravel()})

    return run
