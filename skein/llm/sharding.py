"""Contiguous balanced shards by global byte-size prefix sums (DataFrame functions only).

Rows are put in one global order by a range exchange; each range partition contributes one total;
the totals' prefix sums (one row per partition) turn local running sums into global byte offsets,
and a row's shard is the equal-sized target interval that its first byte falls in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize


def shard_by_bytes(docs: DataFrame, n_shards: int, order_by: list[str], size: Column, carry: dict[str, Column]) -> DataFrame:
    """Cut the rows of docs, ordered by order_by, into n_shards contiguous runs of near equal total size.

    Returns the order_by columns, `size`, the carried columns, `shard` (0..n_shards-1) and `slot`
    (0-based place in the shard, gapless). Sizes must be positive.

    Defined results: nulls in order_by come first; rows equal in order_by and the carried columns are
    interchangeable and stay together in the order; an empty table gives no rows; a row larger than a
    target leaves the shards it spans beyond its first without rows of their own; further columns of
    docs are ignored, so their names can't clash.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    keys = [f"_k{i}" for i in range(len(order_by))]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(order_by, keys)], size.cast("long").alias("_size"), *[c.alias(f"_c_{n}") for n, c in carry.items()])
    ties = keys + ["_size"] + [f"_c_{n}" for n in carry]
    # the ids of range partitions hold only once they are written: a second evaluation may sample other bounds
    placed = materialize(rows.repartitionByRange(*ties).withColumn("_part", F.spark_partition_id()), "shards")

    totals = placed.groupBy("_part").agg(F.sum("_size").alias("_b"), F.count(F.lit(1)).alias("_n"))
    # one row per range partition, not per document
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.sum("_b").over(Window.partitionBy()).alias("_all"))

    inside = Window.partitionBy("_part").orderBy(*ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumn("_b1", F.sum("_size").over(inside)).withColumn("_n1", F.count(F.lit(1)).over(inside))
    at = local.join(F.broadcast(starts), "_part")
    cut = at.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor((F.col("_b0") + F.col("_b1") - F.col("_size")) * F.lit(n_shards) / F.col("_all"))).cast("int")).withColumn("_row", F.col("_n0") + F.col("_n1") - 1)
    first = cut.groupBy("shard").agg(F.min("_row").alias("_first"))  # n_shards rows
    out = cut.join(F.broadcast(first), "shard")
    return out.select(*[F.col(k).alias(c) for c, k in zip(order_by, keys)], F.col("_size").alias("size"), *[F.col(f"_c_{n}").alias(n) for n in carry], "shard", (F.col("_row") - F.col("_first")).alias("slot"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """A null text counts as an empty one, of size 1; repeated rows each take their place; very long texts are one row."""
    from .common import table, text_of

    docs = table(spark, sf_dir, "documents")
    text = text_of(docs)
    out = shard_by_bytes(docs, 16, ["doc_id"], F.octet_length(text).cast("long") + 1, {"text_crc32": F.crc32(text.cast("binary"))})
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: crc32 isn't built in there: it is folded over the bytes, with the table made from the polynomial.
OP4_SQL = """
WITH RECURSIVE step AS (
  SELECT i AS b, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, k + 1 FROM step WHERE k < 8
), tab AS (SELECT list(v ORDER BY b) AS t FROM step WHERE k = 8),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (
  SELECT doc_id, size, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, length(h), 2), lambda i: (instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1)),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) AS text_crc32
  FROM d, tab
), s AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS b0, sum(size) OVER () AS total,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) AS n FROM c
), p AS (SELECT *, least(15, floor(b0 * 16 / total))::INT AS shard FROM s)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, (n - min(n) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM p
"""
