"""Clusters and similarities of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest(vectors: DataFrame, centroids: list[tuple[int, list[float]]]) -> DataFrame:
    """vec_id, cluster: the nearest centroid by squared distance, ties to the smaller id. The centroids are K rows."""
    made = vectors.select("vec_id", "embedding")
    far = lambda c: F.aggregate(F.zip_with("embedding", F.array(*[F.lit(float(v)) for v in c]), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)
    best = F.array_min(F.array(*[F.struct(F.round(far(c), 9).alias("d"), F.lit(i).cast("long").alias("c")) for i, c in centroids]))
    return made.select("vec_id", "embedding", best["c"].alias("cluster"))


def means(assigned: DataFrame, key: str = "cluster") -> DataFrame:
    """key, place, mean: element-wise means, pre-aggregated before the shuffle."""
    return assigned.select(key, F.posexplode("embedding").alias("place", "v")).groupBy(key, "place").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def kmeans(vectors: DataFrame, first: list[tuple[int, list[float]]], iterations: int = 12) -> DataFrame:
    """vec_id, cluster after a fixed number of rounds from given centroids; an emptied cluster keeps its centroid."""
    centroids = dict(first)
    for _ in range(iterations):
        new: dict[int, dict[int, float]] = {}
        for r in means(nearest(vectors, sorted(centroids.items()))).collect():  # K x dim numbers
            new.setdefault(r["cluster"], {})[r["place"]] = r["mean"]
        centroids |= {c: [v[i] for i in sorted(v)] for c, v in new.items()}
    return nearest(vectors, sorted(centroids.items())).select("vec_id", "cluster")


def same_size(vectors: DataFrame, dim: int) -> DataFrame:
    """The rows (vec_id, embedding) of that dimension."""
    return vectors.select("vec_id", "embedding").filter(F.size("embedding") == dim)


#: Matrices that come to the driver.
MERGED = 16


def moments(vectors: DataFrame, dim: int):
    """Number, mean and covariance of the vectors: each task sums its rows, the tasks' sums are added in MERGED tasks, and as
    many matrices of dim * (dim + 1) numbers come to the driver, whatever the number of rows."""
    import numpy as np

    schema = "n long, total array<double>, gram array<double>"

    def made(n, total, gram):
        import pandas as pd

        return pd.DataFrame({"n": [n], "total": [total.tolist()], "gram": [gram.ravel().tolist()]})

    def run(batches):
        n, total, gram = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            if len(b):
                x = np.stack(b["embedding"].to_numpy()).astype(float)
                n, total, gram = n + len(x), total + x.sum(axis=0), gram + x.T @ x
        if n:
            yield made(n, total, gram)

    def merge(batches):
        n, total, gram = 0, np.zeros(dim), np.zeros(dim * dim)
        for b in batches:
            for row in b.itertuples():
                n, total, gram = n + row.n, total + row.total, gram + row.gram
        if n:
            yield made(n, total, gram)

    sums = same_size(vectors, dim).select("embedding").mapInPandas(run, schema)
    parts = sums.repartition(MERGED).mapInPandas(merge, schema).toPandas()  # MERGED rows at most
    n = int(parts["n"].sum())
    mean = np.sum([np.array(t) for t in parts["total"]], axis=0) / max(n, 1) if n else np.zeros(dim)
    gram = np.sum([np.array(g) for g in parts["gram"]], axis=0).reshape(dim, dim) if n else np.zeros((dim, dim))
    return n, mean, gram / max(n, 1) - np.outer(mean, mean)


def projected(vectors: DataFrame, mean, axes) -> DataFrame:
    """vec_id, x, y, z of the centred vectors along three axes."""
    import numpy as np

    dim = len(mean)

    def run(batches):
        import pandas as pd

        for b in batches:
            if len(b):
                p = (np.stack(b["embedding"].to_numpy()).astype(float) - mean) @ axes.T
                yield pd.DataFrame({"vec_id": b["vec_id"], "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    return same_size(vectors, dim).mapInPandas(run, "vec_id long, x double, y double, z double")


def pca3(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id, x, y, z along the three axes of largest variance; the first value of an axis that is not zero is positive."""
    import numpy as np

    _, mean, cov = moments(vectors, dim)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :3].T
    axes = axes * np.array([np.sign(a[np.flatnonzero(np.abs(a) > 1e-12)[0]]) for a in axes])[:, None]
    return projected(vectors, mean, axes)


def random_projection3(vectors: DataFrame, dim: int, seed: int = 42) -> DataFrame:
    """vec_id, x, y, z along three orthonormal axes made from seeded normal numbers."""
    import numpy as np

    _, mean, _ = moments(vectors, dim)
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, 3)))
    return projected(vectors, mean, (q * np.sign(np.diag(r))).T)
