"""Centroid clustering of whole-number vectors by sort-means.

In each round the centroids are sorted, for each of them, by their distance from it. A vector starts at the centroid it had
in the round before, at distance d, and scans the others in that centroid's order; it stops at the first one strictly
further than 2 d from it, as none from there on can be nearer, nor as near. All arithmetic is exact.

A vector's earlier assignment is not stored: it follows from the vector and the centroids of the rounds before, which are
k rows each, so a task walks through the rounds. A round reads the table once, writes nothing and shuffles k rows a task; a
lost executor costs its tasks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

#: Whole numbers are held to this size, so that sums of 10**19 vectors fit 38 digits; what does not fit a long is its largest.
LIMIT, LARGEST = 1 << 62, (1 << 63) - 1
#: Centroids of one step of a scan.
STEP = 8


def integers(column, dim: int, scale: int):
    """Places of the rows of an Arrow list column that hold dim finite values, and floor(scale * value) of these rows."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    x = column.take(pa.array(at, pa.int64())).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    whole = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        v = np.clip(np.floor(scale * x[whole]), -LIMIT, LIMIT)
    return at[whole], v.astype(np.int64)


def squared(x, c):
    """Exact squared distances of the rows of x and c: in floats while no sum leaves 53 bits, else in Python's numbers."""
    import numpy as np

    most = max(int(np.abs(a).max()) if a.size else 0 for a in (x, c))
    if 4 * x.shape[1] * most * most < 1 << 53:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    x, c = x.astype(object), c.astype(object)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


class Sorted:
    """The centroids of one round, and for each of them all of them by distance from it."""

    def __init__(self, centroids: list[list[int]]):
        import numpy as np

        self.c = np.array(centroids, np.int64)
        gap = squared(self.c, self.c)
        self.order = np.argsort(gap, axis=1, kind="stable")
        self.gap = np.take_along_axis(gap, self.order, axis=1)

    def nearest(self, v, before):
        """Each vector's nearest centroid, the smaller number of two, and its squared distance."""
        import numpy as np

        best, least = before.copy(), np.zeros(len(v), self.gap.dtype)
        for a in np.unique(before):
            rows = np.flatnonzero(before == a)
            x = v[rows]
            mine = squared(x, self.c[a : a + 1])[:, 0]
            num, dist = np.full(len(rows), a), mine.copy()
            # squared: the first place whose distance from a is over twice mine
            stop = np.searchsorted(self.gap[a], 4 * mine, side="right")
            for at in range(0, len(self.c), STEP):
                going = np.flatnonzero(stop > at)
                if not len(going):
                    break
                some = np.sort(self.order[a, at : at + STEP])
                d = squared(x[going], self.c[some])
                near = d.argmin(axis=1)
                d, near = d[np.arange(len(going)), near], some[near]
                won = (d < dist[going]) | ((d == dist[going]) & (near < num[going]))
                num[going[won]], dist[going[won]] = near[won], d[won]
            best[rows] = num
            least = least.astype(object) if dist.dtype == object else least
            least[rows] = dist
        return best, least


def walk(rounds: list[Sorted], v):
    """The assignment after the last of the rounds, each scanning from the one before."""
    import numpy as np

    best, least = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    for r in rounds:
        best, least = r.nearest(v, best)
    return best, least


def sums(rounds: list[list[list[int]]], dim: int, scale: int):
    """A task's vectors by cluster: cluster, n, sums."""

    def run(batches: Iterator) -> Iterator:
        from decimal import Decimal

        import numpy as np
        import pyarrow as pa

        made = [Sorted(c) for c in rounds]
        total: dict[int, list] = {}
        for b in batches:
            _, v = integers(b.column("embedding"), dim, scale)
            best, _ = walk(made, v)
            wide = v if int(np.abs(v).max(initial=0)) * len(v) < 1 << 62 else v.astype(object)
            for a in np.unique(best).tolist():
                rows = wide[best == a]
                held = total.setdefault(a, [0, [0] * dim])
                held[0] += len(rows)
                held[1] = [x + int(y) for x, y in zip(held[1], rows.sum(axis=0))]
        rows = sorted(total.items())
        if rows:
            number = pa.list_(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in rows], pa.int32()), pa.array([n for _, (n, _) in rows], pa.int64()), pa.array([[Decimal(x) for x in s] for _, (_, s) in rows], number)],
                names=["cluster", "n", "sums"],
            )

    return run


def assigned(rounds: list[list[list[int]]], dim: int, scale: int):
    """vec_id, cluster, distance of a task's vectors."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        made = [Sorted(c) for c in rounds]
        for b in batches:
            at, v = integers(b.column("embedding"), dim, scale)
            best, least = walk(made, v)
            ids = b.column("vec_id").take(pa.array(at, pa.int64()))
            far = pa.array([min(int(x), LARGEST) for x in least], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.int32()), far], names=["vec_id", "cluster", "distance"])

    return run


def is_kept(embedding: Column, dim: int) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return (F.size(embedding) == dim) & finite


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: str = "2") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of vectors (vec_id, embedding).

    The k kept vectors with the smallest sha256 of `seed:vec_id` are the first centroids, in that order; `rounds` times the
    vectors are assigned and every non-empty centroid is replaced by floor(sum / count); then they are assigned once more.

    Defined results: rows whose embedding is null, has another size or holds a null, NaN or infinite value are not returned;
    a null vec_id is clustered but never a first centroid; repeated rows count each; equal vec_ids order by their vectors;
    fewer than k kept rows with an id give fewer centroids and none an empty result; equal distances go to the smaller
    number; values are held to +-2**62, and a distance or inertia beyond a long is the largest long. Other columns of
    vectors are ignored, so that their names can't clash."""
    import hashlib
    from math import floor

    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    firsts = rows.filter(F.col("vec_id").isNotNull() & is_kept(F.col("embedding"), dim)).withColumn("_k", key)
    whole = lambda x: floor(max(-LIMIT, min(LIMIT, scale * x)))
    centroids = [[[whole(x) for x in r["embedding"]] for r in firsts.orderBy("_k", "embedding").limit(k).collect()]]  # k rows
    out = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    if not centroids[0]:
        return spark.createDataFrame([], f"{out}, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        part = rows.select("embedding").mapInArrow(sums(centroids, dim, scale), "cluster int, n long, sums array<decimal(38,0)>")
        by = part.select("cluster", "n", F.posexplode("sums").alias("place", "x")).groupBy("cluster", "place")
        new: dict[int, dict[int, int]] = {}
        for r in by.agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():  # k * dim rows
            new.setdefault(r["cluster"], {})[r["place"]] = int(r["x"]) // r["n"]
        centroids.append([[new[i][p] for p in range(dim)] if i in new else c for i, c in enumerate(centroids[-1])])
    done = materialize(rows.mapInArrow(assigned(centroids, dim, scale), out), "clusters")
    inertia = {r["cluster"]: int(r["d"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    total = sum(inertia.values())
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids[-1]]
    facts = [(i, min(d, LARGEST), min(total, LARGEST), sha[i]) for i, d in sorted(inertia.items())]
    said = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(said), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_sort_means(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def sql(rounds: int = 5, k: int = 40, dim: int = 64) -> str:
    """The rounds as one step after another."""
    far = f"list_sum(list_transform(range(1, {dim + 1}), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT"
    out = f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS m FROM kept WHERE vec_id IS NOT NULL ORDER BY c LIMIT {k}
)"""
    for i in range(rounds + 1):
        out += f""", a{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS b FROM (SELECT r, vec_id, v, c, {far} AS d FROM kept, c{i}) GROUP BY r
)"""
        if i < rounds:
            out += f""", n{i} AS (
  SELECT c, list(x ORDER BY i) AS m FROM (
    SELECT b.c AS c, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS x FROM a{i}, range(1, {dim + 1}) t(i) GROUP BY b.c, i) GROUP BY c
), c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(n{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN n{i} USING (c))"""
    return out + f"""
SELECT vec_id, b.c::INT AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.c))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON b.c = c"""
