"""Containers with documents and chunks, kept together by commits: upkeep, cascade, totals, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.embedding import problem
from skein.operators.commits import Commit, Commits
from skein.operators.retrieval import knn

#: Parts of a container's chunks; a document's chunks lie in one, so a change rewrites the parts of its documents alone.
BUCKETS = 16
TABLES = {
    "containers": ("container_id string, name string, dimension int, strict boolean, total_documents long, total_chunks long, size_bytes long", ("container_id",)),
    "documents": ("container_id string, document_id string, name string, type string, sha256 string, n_chars long, n_chunks long", ("container_id",)),
    "chunks": ("container_id string, bucket int, document_id string, chunk_index int, content string, embedding array<double>", ("container_id", "bucket")),
    "quarantine": ("container_id string, path string, error string, batch long", ("container_id",)),
}


class Library:
    """One library below `path`. Every change is one commit over all tables; a change that another writer's came before in
    the same container raises Conflict and changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Commits(spark, path, TABLES)

    def containers(self) -> DataFrame:
        return self.store.read("containers")

    def documents(self, container: str | None = None) -> DataFrame:
        return self.store.read("documents", **({"container_id": container} if container else {}))

    def chunks(self, container: str | None = None) -> DataFrame:
        """chunk_id (document and place) and the chunk's columns; of one container, only its folders are listed and read."""
        c = self.store.read("chunks", **({"container_id": container} if container else {}))
        return c.withColumn("chunk_id", F.concat_ws("#", "document_id", "chunk_index"))

    def quarantine(self) -> DataFrame:
        return self.store.read("quarantine")

    def _row(self, commit: Commit, container: str) -> dict:
        row = commit.read("containers", container_id=container).first()
        if row is None:
            raise KeyError(container)
        return row.asDict()

    def create_container(self, container: str, name: str, dimension: int = 512, strict: bool = True) -> int:
        c = self.store.begin()
        unit = c.unit("containers", container)
        if unit in c.units["containers"]:
            raise ValueError(f"{container} exists")
        row = (container, name, dimension, strict, 0, 0, 0)
        c.replace("containers", self.spark.createDataFrame([row], TABLES["containers"][0]).coalesce(1), {unit})
        return c.put()

    def update_container(self, container: str, **fields) -> int:
        """Changes name or strict; totals follow from the documents and a vector's size is not changed."""
        if not fields.keys() <= {"name", "strict"}:
            raise ValueError(f"not to be changed: {sorted(fields.keys() - {'name', 'strict'})}")
        c = self.store.begin()
        self._put_row(c, self._row(c, container) | fields)
        return c.put()

    def delete_container(self, container: str) -> int | None:
        """The container with its documents, chunks and quarantine; the last container stays (None)."""
        c = self.store.begin()
        self._row(c, container)
        if len(c.units["containers"]) == 1:
            return None
        for t in TABLES:
            c.drop(t, {u for u in c.units[t] if u.split("/")[0] == f"container_id={container}"})
        return c.put()

    def put(self, container: str, documents: DataFrame, chunks: DataFrame, rejected: DataFrame | None = None, meta: dict | None = None) -> int:
        """documents (document_id, name, type, sha256, n_chars) and chunks (document_id, chunk_index, content, embedding) take
        the place of those with the same document_id. Nothing changes if a vector has another size than the container's or a
        value that is no number. Of repeated document_ids one row stays; their chunks by chunk_index, one each."""
        c = self.store.begin()
        row = self._row(c, container)
        bad = chunks.select(problem(F.col("embedding"), row["dimension"]).alias("p")).filter("p <> 'low_energy'").first()
        if bad:
            raise ValueError(f"a vector is not usable: {bad['p']}")
        ids = documents.select("document_id").distinct()
        count = chunks.groupBy("document_id").agg(F.countDistinct("chunk_index").alias("n_chunks"))
        new = documents.dropDuplicates(["document_id"]).join(count, "document_id", "left").fillna(0, ["n_chunks"])
        self._documents(c, container, ids, new.select("document_id", "name", "type", "sha256", "n_chars", "n_chunks"))
        fresh = chunks.join(ids, "document_id", "left_semi").dropDuplicates(["document_id", "chunk_index"])
        self._chunks(c, container, ids, fresh.select("document_id", "chunk_index", "content", F.col("embedding").cast("array<double>")))
        if rejected is not None:
            old = c.read("quarantine", container_id=container)
            more = rejected.select(F.lit(container).alias("container_id"), "path", "error", F.col("batch").cast("long"))
            c.replace("quarantine", old.unionByName(more), {c.unit("quarantine", container)})
        c.meta = meta or {}
        self._totals(c, row)
        return c.put()

    def remove_documents(self, container: str, ids: DataFrame) -> int:
        """The documents of ids (document_id) and their chunks; unknown ids change nothing."""
        c = self.store.begin()
        row = self._row(c, container)
        ids = ids.select("document_id").distinct()
        self._documents(c, container, ids, None)
        self._chunks(c, container, ids, None)
        self._totals(c, row)
        return c.put()

    def clear(self, container: str) -> int:
        c = self.store.begin()
        row = self._row(c, container)
        for t in ("documents", "chunks", "quarantine"):
            c.drop(t, {u for u in c.units[t] if u.split("/")[0] == f"container_id={container}"})
        self._totals(c, row)
        return c.put()

    def _documents(self, c: Commit, container: str, ids: DataFrame, new: DataFrame | None) -> None:
        left = c.read("documents", container_id=container).join(ids, "document_id", "left_anti")
        if new is not None:
            left = left.unionByName(new.withColumn("container_id", F.lit(container)))
        c.replace("documents", left.select(*[x.split()[0] for x in TABLES["documents"][0].split(", ")]), {c.unit("documents", container)})

    def _chunks(self, c: Commit, container: str, ids: DataFrame, new: DataFrame | None) -> None:
        bucket = F.pmod(F.xxhash64("document_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
        touched = sorted(r["bucket"] for r in ids.select(bucket).distinct().collect())  # BUCKETS rows at most
        old = c.read("chunks", container_id=container).filter(F.col("bucket").isin(touched)).join(ids, "document_id", "left_anti")
        if new is not None:
            old = old.unionByName(new.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(BUCKETS)).cast("int")).withColumn("container_id", F.lit(container)))
        c.replace("chunks", old.select(*[x.split()[0] for x in TABLES["chunks"][0].split(", ")]), {c.unit("chunks", container, b) for b in touched})

    def _totals(self, c: Commit, row: dict) -> None:
        here = {"container_id": row["container_id"]}
        n = c.read("documents", **here).count()
        size = F.coalesce(F.sum(F.octet_length("content").cast("long")), F.lit(0))
        chunks = c.read("chunks", **here).agg(F.count("*").alias("n"), size.alias("size")).first()
        self._put_row(c, row | {"total_documents": n, "total_chunks": chunks["n"], "size_bytes": chunks["size"]})

    def _put_row(self, c: Commit, row: dict) -> None:
        names = [x.split()[0] for x in TABLES["containers"][0].split(", ")]
        one = self.spark.createDataFrame([tuple(row[n] for n in names)], TABLES["containers"][0]).coalesce(1)
        c.replace("containers", one, {c.unit("containers", row["container_id"])})

    def search(self, container: str, queries: DataFrame, k: int, floor: float | None = None) -> DataFrame:
        """query_id, similarity, rank, document_id, chunk_index, content of queries (query_id, embedding)."""
        chunks = self.chunks(container).withColumn("vec_id", F.xxhash64("chunk_id"))
        near = knn(chunks, queries, k, floor)
        return near.join(chunks.drop("embedding", "container_id", "bucket"), "vec_id").drop("vec_id")


def sink_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A table as JSON lines, the keys of each in alphabetical order."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path)


def scan_json(spark: SparkSession, path: str, table: str) -> DataFrame:
    """What sink_json wrote of a table of the library; keys that it does not have are null, others are left out."""
    return spark.read.schema(TABLES[table][0]).json(path)
