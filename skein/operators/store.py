"""A store of chunk vectors: one table for each container, changed by commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.embedding import problem
from skein.functions.vectors import cosine, norm
from skein.operators.commits import Commit, Commits
from skein.operators.retrieval import knn

SCHEMA = "chunk_id long, document_id long, content string, embedding array<double>"
#: Parts of a store by chunk; a change rewrites the parts that it touches.
BUCKETS = 16
#: Fixed values of the result cache: entries, seconds, and the cosine above which a question counts as asked before.
CACHE_ENTRIES, CACHE_SECONDS, CACHE_COSINE = 20, 300, 0.95


class ChunkStore:
    """Chunks (chunk_id, document_id, content, embedding) of one container under `path`, changed by commits: readers see a
    whole version, a failed write changes nothing, and of two writers of the same part one gets Conflict."""

    def __init__(self, spark: SparkSession, path: str, dimension: int):
        self.spark, self.path, self.dimension = spark, path.rstrip("/"), dimension
        self.store = Commits(spark, self.path, {"chunks": (f"bucket int, {SCHEMA}", ("bucket",))})

    def all(self) -> DataFrame:
        return self.store.read("chunks").drop("bucket")

    def _check(self, vectors: DataFrame, what: str) -> None:
        bad = vectors.select(problem(F.col("embedding"), self.dimension).alias("p")).filter("p <> 'low_energy'").first()
        if bad:
            raise ValueError(f"{what} is not usable ({bad['p']}); {self.dimension} finite values are needed")

    def _replace(self, commit: Commit, rows: DataFrame, buckets: set[int]) -> None:
        commit.replace("chunks", rows.select("bucket", "chunk_id", "document_id", "content", F.col("embedding").cast("array<double>")), {commit.unit("chunks", b) for b in buckets})

    def upsert(self, chunks: DataFrame) -> None:
        """Put chunks by id; nothing is written if a vector has another dimension, NaN or an infinite value. Of equal ids in
        one batch the last content by order of embedding and content stays."""
        self._check(chunks, "a vector")
        new = chunks.withColumn("_n", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("content"), F.desc("embedding")))).filter("_n = 1").drop("_n")
        new = new.withColumn("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(BUCKETS)).cast("int"))
        commit = self.store.begin()
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # BUCKETS rows at most
        old = commit.read("chunks").filter(F.col("bucket").isin(sorted(touched))).join(new, "chunk_id", "left_anti")
        self._replace(commit, old.unionByName(new.select(*old.columns)), touched)
        commit.put()

    def delete_document(self, document_id: int) -> None:
        commit = self.store.begin()
        mine = F.col("document_id").eqNullSafe(F.lit(document_id))
        touched = {r["bucket"] for r in commit.read("chunks").filter(mine).select("bucket").distinct().collect()}
        if touched:
            self._replace(commit, commit.read("chunks").filter(F.col("bucket").isin(sorted(touched)) & ~mine), touched)
            commit.put()

    def clear(self) -> None:
        commit = self.store.begin()
        commit.drop("chunks", set(commit.units["chunks"]))
        commit.put()

    def count(self) -> int:
        return self.all().count()

    def search(self, queries: DataFrame, k: int, floor: float | None = None) -> DataFrame:
        """query_id, chunk_id, similarity, rank of queries (query_id, embedding)."""
        self._check(queries, "a question's vector")
        return knn(self.all().withColumnRenamed("chunk_id", "vec_id"), queries, k, floor).withColumnRenamed("vec_id", "chunk_id")


class Router:
    """The stores of containers, each opened once."""

    def __init__(self, spark: SparkSession, root: str, dimension: int):
        self.spark, self.root, self.dimension, self.open = spark, root.rstrip("/"), dimension, {}

    def store(self, container: str) -> ChunkStore:
        if container not in self.open:
            self.open[container] = ChunkStore(self.spark, f"{self.root}/container_id={container}", self.dimension)
        return self.open[container]

    def forget(self, container: str) -> None:
        """A container that was deleted, or whose dimension is another now: its store is opened anew when it is asked for."""
        self.open.pop(container, None)


def cached(queries: DataFrame, cache: DataFrame, now: float) -> DataFrame:
    """query_id, entry: the oldest entry of cache (entry, ts, embedding), among the last CACHE_ENTRIES and not older than
    CACHE_SECONDS, whose question is nearly the same. The cache has CACHE_ENTRIES rows, so it is broadcast."""
    last = cache.orderBy(F.desc("ts"), F.desc("entry")).limit(CACHE_ENTRIES).filter(F.col("ts") >= now - CACHE_SECONDS)
    e = last.select("entry", "ts", F.col("embedding").alias("e"), norm(F.col("embedding")).alias("en"))
    q = queries.select("query_id", "embedding", norm(F.col("embedding")).alias("n"))
    same = cosine(F.col("embedding"), F.col("n"), F.col("e"), F.col("en")) > CACHE_COSINE
    return q.join(F.broadcast(e), same).groupBy("query_id").agg(F.min_by("entry", F.struct("ts", "entry")).alias("entry"))
