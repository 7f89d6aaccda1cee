"""Files into a library: type, text, chunks, vectors, quota, quarantine, each batch in one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.functions import embedding as E
from skein.operators import chunking as C
from skein.operators.library import Library
from skein.sources import files
from skein.streaming.stateful import PACK_DOCUMENTS, TIERS

RAW = "path string, modificationTime timestamp, length long, content binary"


def document_limit(tier: str, packs: int = 0) -> int:
    """Documents that a tier and its packs allow."""
    return TIERS[tier][1] + packs * PACK_DOCUMENTS


def processed(raw: DataFrame, provider: str | None = None, **sizes) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (document_id, name, type, sha256, n_chars, path), chunks (document_id, chunk_index, content, embedding) and
    rejects (path, error) of raw (path, content). A document's id is the hash of its path, so a changed file takes its own
    place; every row of raw is in documents or in rejects."""
    read = files.extracted(raw.select("path", "content", F.sha2("content", 256).alias("sha256")))
    rejects = read.filter("error IS NOT NULL").select("path", "error")
    good = read.filter("error IS NULL")
    name = F.element_at(F.split("path", "/"), -1)
    documents = good.select(F.sha2(F.col("path").cast("binary"), 256).alias("document_id"), name.alias("name"), "type", "sha256", F.char_length("text").cast("long").alias("n_chars"), "path", "text")
    cut = C.chunks(documents.select(F.xxhash64("document_id").alias("doc_id"), "text"), features=False, **sizes)
    named = documents.select(F.xxhash64("document_id").alias("doc_id"), "document_id")
    made = E.embed(cut.select("doc_id", "chunk_index", F.col("content").alias("text")), provider)
    # a chunk of white space alone has no vector and no place in the search
    chunks = made.filter("error IS NULL").join(named, "doc_id").select("document_id", "chunk_index", F.col("text").alias("content"), "embedding")
    return documents.drop("text"), chunks, rejects


def add_batch(library: Library, container: str, limit: int, provider: str | None, stream: str, raw: DataFrame, batch: int) -> None:
    """One batch of files as one commit, which also notes the batch: a batch that comes again changes nothing.

    A file whose document is there with the same content is left out. New documents beyond the limit are quarantined as
    quota_reached, in the order of their paths; changed ones are no new ones. A container that is gone is an error."""
    number, manifest = library.store.manifest()
    if manifest["meta"].get(stream, -1) >= batch:
        return
    raw = raw.select("path", "content").dropDuplicates(["path"]).persist()  # read once; a lost part is read again
    try:
        documents, chunks, rejects = processed(raw, provider)
        old = library.documents(container).select("document_id", F.col("sha256").alias("_old"))
        known = documents.join(old, "document_id", "left")
        changed = known.filter(F.col("_old") != F.col("sha256"))
        new = known.filter("_old IS NULL")
        room = max(0, limit - old.count())
        taken = new.orderBy("path").limit(room)  # as many as the limit allows, which is the feature
        over = new.join(taken.select("document_id"), "document_id", "left_anti")
        add = changed.unionByName(taken).drop("_old", "path").persist()
        refused = rejects.unionByName(over.select("path", F.lit("quota_reached").alias("error"))).withColumn("batch", F.lit(batch))
        library.put(container, add, chunks.join(add.select("document_id"), "document_id", "left_semi"), refused, {stream: batch})
        add.unpersist()
    finally:
        raw.unpersist()


def add_documents(spark: SparkSession, library: Library, container: str, folder: str, checkpoint: str, limit: int, provider: str | None = None, files_a_batch: int = 1000) -> StreamingQuery:
    """Files that come to folder, as long as the query runs or until all there are have been read (it stops then); started
    again with the same checkpoint it goes on behind the last batch committed."""
    stream = spark.readStream.format("binaryFile").schema(RAW).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch).load(folder)
    step = lambda raw, batch: add_batch(library, container, limit, provider, f"files:{container}:{checkpoint}", raw, batch)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
