"""Which document filters remove the same rows: counts for every order of the filters.

Equal texts are found by an RDD routed by xxhash of the text: a partition keeps, for each fingerprint, a chain of the full
texts that have it, each with the least doc_id seen, and gives out the ids that are not the least. A task settles its own
copies before anything is sent, so a text takes one place a task in the shuffle however many copies it has. Rows then are a
mask of the filters they fail; combineByKey merges count vectors by mask, 32 masks a part, from which every order follows."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: The filters in the order of their bits, and the bit of E.
FILTERS, COPY = "ABCDE", 16
MASKS = 1 << len(FILTERS)
CAPITALS, TAIL_BYTES, SIGNS = bytes(range(65, 91)), bytes(range(0x80, 0xC0)), re.compile(rb"[#$%&*|]")
#: Bytes of texts that a task's chains hold before it sends them, and bytes of texts for each shuffle partition.
HELD, PARTITION = 32 << 20, 16 << 20


def failures(text: bytes) -> int:
    """Bits of A to D: under 100 words; 100 * distinct words < 80 * words; 100 * capitals > 10 * code points; a sign."""
    words = text.split()  # cuts at the six ASCII white space characters
    points = len(text.translate(None, TAIL_BYTES))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    few = 100 * len(set(words)) < 80 * len(words)
    return (len(words) < 100) | few << 1 | (100 * capitals > 10 * points) << 2 | (SIGNS.search(text) is not None) << 3


class Chains:
    """Texts by fingerprint. An entry of a chain is [text, mask, least id, rows of that id by part]."""

    def __init__(self):
        self.chains: dict[int, list[list]] = {}
        self.size = 0

    def meet(self, mark: int, text: bytes, mask: int, doc_id, parts: dict) -> Iterator[tuple]:
        """Takes rows of one id; gives (doc_id, part, mask, n) of the rows that are now known to be copies."""
        chain = self.chains.setdefault(mark, [])
        held = next((e for e in chain if e[0] == text), None)
        if held is None:
            chain.append([text, mask, doc_id, Counter(parts)])
            self.size += len(text) + 200
            return
        if doc_id == held[2]:
            held[3].update(parts)
            return
        if doc_id < held[2]:
            doc_id, parts, held[2], held[3] = held[2], held[3], doc_id, Counter(parts)
        for part, n in parts.items():
            yield doc_id, part, mask | COPY, n

    def drain(self) -> Iterator[tuple]:
        for mark, chain in self.chains.items():
            for text, mask, doc_id, parts in chain:
                yield mark, (text, mask, doc_id, dict(parts))
        self.__init__()


def meet(rows: Iterator) -> Iterator[tuple]:
    """(doc_id, text, part) to (mark, (None, settled row)) and (mark, (text, mask, its least id so far, rows by part))."""
    from xxhash import xxh3_64_intdigest

    chains, nameless = Chains(), Counter()
    spread = lambda row: (xxh3_64_intdigest(repr(row).encode()), (None, row))
    for doc_id, text, part in rows:
        text = bytes(text)
        mask = failures(text)
        if doc_id is None:
            nameless[part, mask] += 1
            continue
        yield from map(spread, chains.meet(xxh3_64_intdigest(text), text, mask, doc_id, {part: 1}))
        if chains.size > HELD:
            yield from chains.drain()
    yield from chains.drain()
    yield from (spread((None, part, mask, n)) for (part, mask), n in nameless.items())


def settle(pairs: Iterator) -> Iterator[tuple]:
    """doc_id, part, mask, n of a partition's marks: settled rows pass, the chains find the rest."""
    chains = Chains()
    for mark, (text, *rest) in pairs:
        if text is None:
            yield rest[0]
        else:
            yield from chains.meet(mark, text, *rest)
    for _, (_, mask, doc_id, parts) in chains.drain():
        for part, n in parts.items():
            yield doc_id, part, mask, n


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask, n: the rows of docs (doc_id, text, lang) by the filters they fail."""
    empty = F.lit("")
    rows = docs.select("doc_id", F.coalesce("text", empty).cast("binary").alias("text"), F.coalesce("lang", empty).alias("part")).rdd
    # a partition's chains fit a worker whatever the input's splits are: the texts' bytes say how many there must be
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    met = rows.mapPartitions(meet).partitionBy(max(rows.getNumPartitions(), -(-size // PARTITION), 1), lambda mark: mark)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, mask int, n long"
    return docs.sparkSession.createDataFrame(met.mapPartitions(settle), schema, verifySchema=False)


def vectors(rows: DataFrame) -> RDD:
    """(part, counts): n, good and toxic rows by mask, three vectors one after the other."""
    from xxhash import xxh3_64_intdigest

    def add(v: list, r: tuple) -> list:
        mask, n, good, toxic = r
        v[mask] += n
        v[MASKS + mask] += n * good
        v[2 * MASKS + mask] += n * toxic
        return v

    keyed = rows.select("part", "mask", "n", "good", "toxic").rdd.map(lambda r: (r[0], r[1:]))
    merge = lambda a, b: [x + y for x, y in zip(a, b)]
    return keyed.combineByKey(lambda r: add([0] * (3 * MASKS), r), add, merge, 16, lambda part: xxh3_64_intdigest(part.encode()))


def orders(part: str, v: list) -> Iterator[tuple]:
    """The rows of a part: every order of the filters, step by step."""
    n, good, toxic = (v[i * MASKS : (i + 1) * MASKS] for i in range(3))
    bits = {f: 1 << i for i, f in enumerate(FILTERS)}
    total = lambda counts, ok: sum(c for m, c in enumerate(counts) if ok(m))
    rows, shapley = [], Counter()
    for order in permutations(FILTERS):
        gone = 0
        for step, f in enumerate(order, 1):
            here = lambda m, b=bits[f], g=gone: bool(m & b) and not m & g
            removed, fails = total(n, here), total(n, lambda m: m & bits[f])
            shapley[f] += removed
            kept = total(n, lambda m: not m & (gone | bits[f]))
            rows.append((f, ["".join(order), step, kept, removed, fails - removed, n[bits[f]], total(good, here), total(toxic, here)]))
            gone |= bits[f]
    for f, row in rows:
        yield part, *row, shapley[f]


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for each language of docs
    (doc_id, text, lang) and each of the 120 orders of the five filters; labels (doc_id, quality, toxic).

    Defined results: a null text is empty, a null lang the empty string; a row without doc_id has no label, is never a copy
    and makes none; rows of one doc_id with one text are no copies of each other; of several labels of an id any that says
    1 counts; rows without label count as neither; an empty table gives no rows. Other columns are ignored, so that their
    names can't clash."""
    spark = docs.sparkSession
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias("good" if c == "quality" else c)
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(one("quality"), one("toxic"))
    rows = masked(docs.select("doc_id", "text", "lang"))
    flagged = rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    schema = (
        "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
        "good_lost long, toxic_lost long, shapley long"
    )
    return spark.createDataFrame(vectors(flagged).flatMap(lambda kv: orders(*kv)), schema, verifySchema=False)


def op12_interaction(spark, sf_dir: str) -> DataFrame:
    return interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (
  SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(first < doc_id, false)::INT AS mask
  FROM w
), l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
g AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL
), p AS (
  SELECT '' AS o UNION ALL SELECT o || f FROM p, unnest(['A', 'B', 'C', 'D', 'E']) t(f) WHERE NOT contains(o, f)
), s AS (
  SELECT o, step, o[step] AS f, (1 << (instr('ABCDE', o[step]) - 1)) AS bit,
    list_sum(list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', o[i]) - 1))) AS gone
  FROM p, range(1, 6) t(step) WHERE length(o) = 5
), r AS (
  SELECT part, o AS filter_order, step::INT AS step, f, sum(n * (mask & (bit | coalesce(gone, 0)) = 0)::INT) AS kept,
    sum(n * (mask & bit > 0 AND mask & coalesce(gone, 0) = 0)::INT) AS removed, sum(n * (mask & bit > 0)::INT) AS fails,
    sum(n * (mask = bit)::INT) AS unique_fails, sum(good * (mask & bit > 0 AND mask & coalesce(gone, 0) = 0)::INT) AS good_lost,
    sum(toxic * (mask & bit > 0 AND mask & coalesce(gone, 0) = 0)::INT) AS toxic_lost
  FROM g, s GROUP BY part, o, step, f
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, (fails - removed)::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""
