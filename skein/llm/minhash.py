"""Near-duplicate documents: universal hash minima, banding, signature and set verification, star components.

1. One Arrow pass gives each document its set of word shingles (sorted 64-bit hashes), a signature of
   BANDS * ROWS minima of universal hashes and one key for each band. Documents with equal sets form one class, by a
   pre-aggregated group, so thousands of copies never meet each other. Classes are the nodes of what follows.
2. In each band bucket, every class is compared with one of them, the hub. The links that hold are closed to components.
3. Buckets that still hold several components are finished exactly: classes outside the hub's component (strays) meet the
   bucket's others. Both sides are dealt into chunks of a bounded number of classes and shingles; a task holds two chunks,
   first as signatures, then as full sets of those classes that the signatures left. Pairs live in the task only: what it
   returns is a forest, one row for each class at most. A pair is taken in the first band that both share.
4. Links come from the full sets, after the signature has ruled out the hopeless pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, discard, free_name, materialize, numbered, quoted, table, word_bytes

ROWS, BANDS, WORDS, PERCENT = 5, 40, 5, 75
#: A pair is checked on its sets unless its signatures agree in less than this share of minima, five
#: standard deviations below the limit.
SIGNATURE_FLOOR = 0.60
#: A chunk has so many classes, or shingles, at most (or one class).
CHUNK, CHUNK_SHINGLES = 2000, 2_000_000


def shingle_hashes(words: list[bytes], hashes: WordHashes, k: int = WORDS):
    """The sorted distinct hashes of the k-word shingles; one for the whole of a shorter text."""
    import numpy as np

    if not words:
        return np.zeros(0, np.uint64)
    h = hashes(words)
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(len(h), k), np.uint64)
    for j in range(min(k, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def describe(rows: int = ROWS, bands: int = BANDS, k: int = WORDS):
    import numpy as np

    rng = np.random.default_rng(20240101)
    mult = rng.integers(1, 2**63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, rows * bands, dtype=np.uint64)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        from xxhash import xxh3_64_intdigest

        hashes = WordHashes()
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for b in batches:
            for at in range(0, len(b), 500):
                out = []
                for doc_id, text in zip(b["doc_id"].iloc[at : at + 500], b["text"].iloc[at : at + 500]):
                    s = shingle_hashes(word_bytes(text), hashes, k)
                    if not len(s):
                        out.append((doc_id, 0, 0, None, None))
                        continue
                    sig = np.full(len(mult), 2**64 - 1, np.uint64)
                    for c in range(0, len(s), 2000):
                        sig = np.minimum(sig, (s[None, c : c + 2000] * mult[:, None] + add[:, None]).min(axis=1))
                    sig = (sig >> np.uint64(20)).astype(np.uint16)  # of the highest bits, minima have few that differ
                    keys = [signed(xxh3_64_intdigest(sig[i * rows : (i + 1) * rows].tobytes(), i)) for i in range(bands)]
                    out.append((doc_id, len(s), signed(xxh3_64_intdigest(s.tobytes())), keys, sig.tobytes()))
                yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "set_hash", "bands", "sig"])

    return run, "doc_id long, n_shingles long, set_hash long, bands array<long>, sig binary"


def alike(floor: float = SIGNATURE_FLOOR):
    """The pairs whose signatures agree in enough minima."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for p in batches:
            keep = [np.mean(np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)) >= floor for a, b in zip(p.pop("sig_a"), p.pop("sig_b"))]
            yield p[np.array(keep, bool)]

    return run


def similar(x, y, percent: int = PERCENT) -> bool:
    """Whether two sorted sets are linked."""
    import numpy as np

    if min(len(x), len(y)) * 100 < max(len(x), len(y)) * percent:
        return False
    both = np.sort(np.concatenate([x, y]))
    both = int((both[1:] == both[:-1]).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def verify(batches: Iterator) -> Iterator:
    """The pairs whose full sets are similar enough."""
    import numpy as np

    for p in batches:
        keep = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(p.pop("set_a"), p.pop("set_b"))]
        yield p[np.array(keep, bool)]


def sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, set: the shingle sets of the classes in nodes, made again from the text of one document of each."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        from xxhash import xxh3_64_intdigest

        hashes = WordHashes()
        for b in batches:
            for at in range(0, len(b), 500):
                made = [shingle_hashes(word_bytes(t), hashes) for t in b["text"].iloc[at : at + 500]]
                keys = [xxh3_64_intdigest(s.tobytes()) for s in made]
                yield pd.DataFrame({"node": [k - (1 << 64) if k >> 63 else k for k in keys], "set": [s.tobytes() for s in made]})

    ids = classes.join(nodes, "node", "left_semi").select("doc_id").distinct()
    made = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInPandas(run, "node long, set binary")
    return made.join(nodes, "node", "left_semi").dropDuplicates(["node"])  # a doc_id may come with other texts


def linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough: first by signature, then by the sets of those left."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"))
    close = materialize(pairs.join(side("b"), "b").join(side("a"), "a").mapInPandas(alike(), "a long, b long"), "close")
    nodes = close.select(F.col("a").alias("node")).union(close.select("b")).distinct()
    sets = materialize(sets_of(docs, classes, nodes), "sets")
    of = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"))
    out = materialize(close.join(of("b"), "b").join(of("a"), "a").mapInPandas(verify, "a long, b long"), "links")
    discard(close, sets)
    return out


def hopeful(block, floor: float, rows: int):
    """For each stray of a block (index into its rows), the rows that it may be linked with: of another component, near in
    size, alike by signature, and in no earlier band together."""
    import numpy as np

    sig = np.frombuffer(b"".join(block["sig"]), np.uint16).reshape(len(block), -1)
    node, root, n, stray = (block[c].to_numpy() for c in ("node", "root", "n_shingles", "stray"))
    left, right, band = np.flatnonzero(block["is_left"]), np.flatnonzero(~block["is_left"].to_numpy(bool)), int(block["band"].iloc[0])
    for i in left:
        other = right[(root[right] != root[i]) & (np.minimum(n[right], n[i]) * 100 >= np.maximum(n[right], n[i]) * PERCENT) & (~stray[right] | (node[right] > node[i]))]
        if len(other):
            same = sig[other] == sig[i]
            other, same = other[ok := same.mean(axis=1) >= floor], same[ok]
            first = same.reshape(len(other), -1, rows).all(axis=2).argmax(axis=1) if len(other) else np.zeros(0)
            if len(other := other[first == band]):
                yield i, other


def hopefuls(floor: float = SIGNATURE_FLOOR, rows: int = ROWS):
    """The rows of a block that take part in a pair its signatures leave open."""

    def run(block):
        import numpy as np

        part = np.zeros(len(block), bool)
        for i, other in hopeful(block, floor, rows):
            part[i] = part[other] = True
        return block[part][["bucket", "i", "j", "is_left", "node"]]

    return run


def forest(floor: float = SIGNATURE_FLOOR, rows: int = ROWS):
    """The links of a block that join components which no link before has joined."""

    def run(block):
        import numpy as np
        import pandas as pd

        up, out, node = {}, [], block["node"].tolist()
        sets, root = [np.frombuffer(x, np.uint64) for x in block["set"]], block["root"].tolist()

        def top(x):
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        for i, other in hopeful(block, floor, rows):
            for j in other:
                a, b = top(root[i]), top(root[j])
                if a != b and similar(sets[i], sets[j]):
                    up[a] = b
                    out.append((node[i], node[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def finish(placed: DataFrame, classes: DataFrame, docs: DataFrame, chunk: int = CHUNK, shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """Links (a, b) between the strays of each bucket and its others; placed has bucket, band, node, n_shingles, hub, root,
    hub_root."""
    others = placed.filter(F.col("node") != F.col("hub")).withColumn("stray", F.col("root") != F.col("hub_root"))
    parts = lambda n, size: F.ceil(F.greatest(n / chunk, size / shingles)).cast("int")
    of = lambda c: F.sum(F.when(F.col("stray"), F.lit(c) if isinstance(c, int) else F.col(c)).otherwise(0))
    sizes = others.groupBy("bucket").agg(F.count("*").alias("n"), of(1).alias("s"), F.sum("n_shingles").alias("size"), of("n_shingles").alias("s_size")).filter("s > 0 AND n > 1")
    sizes = sizes.select("bucket", parts(F.col("n"), F.col("size")).alias("n_right"), parts(F.col("s"), F.col("s_size")).alias("n_left"))
    open_ = materialize(others.join(sizes, "bucket").select("bucket", "band", "node", "n_shingles", "root", "stray", "n_left", "n_right"), "open")
    mine = lambda n: F.pmod(F.hash("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = ["bucket", "band", "node", "n_shingles", "root", "stray"]
    left = open_.filter("stray").select(*rest, F.lit(True).alias("is_left"), mine("n_left").alias("i"), every("n_right").alias("j"))
    right = open_.select(*rest, F.lit(False).alias("is_left"), every("n_left").alias("i"), mine("n_right").alias("j"))
    rows = left.unionByName(right).join(classes.select("node", "sig"), "node")
    keys = ["bucket", "i", "j"]
    some = materialize(rows.groupBy(*keys).applyInPandas(hopefuls(), "bucket long, i int, j int, is_left boolean, node long"), "hopeful")
    sets = materialize(sets_of(docs, classes, some.select("node").distinct()), "sets")
    met = some.join(open_.select(*rest), ["bucket", "node"]).join(classes.select("node", "sig"), "node").join(sets, "node")
    out = materialize(met.groupBy(*keys).applyInPandas(forest(), "a long, b long"), "links")
    discard(open_, some, sets)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for the nodes of edges (a, b), by alternating large-star and small-star.

    Minima are pre-aggregated and joined back, so a hub's neighbours are never gathered in one task."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(both.select(F.col("v"), F.col("u")))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        met = both.join(low, "u")
        if large:
            out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        return out.filter("a <> b").distinct()

    e, state = materialize(edges.filter("a <> b").distinct(), "edges"), None
    while True:
        after = materialize(star(star(e, True), False), "edges")
        # two sums over hashes of the edges tell whether anything changed
        now = after.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
        discard(e)
        e = after
        if now == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Defined results: a null text or one without words has no shingles and is its own component; equal sets
    are linked; a null doc_id is a row of its own without component (kept, since nothing can name it); a doc_id with
    several texts belongs to the component of each, row by row; repeated rows are each returned; an empty table gives no
    rows; further columns are ignored."""
    run, schema = describe()
    made = materialize(docs.select("doc_id", "text").mapInPandas(run, schema), "described")
    some = made.filter("n_shingles > 0 AND doc_id IS NOT NULL").withColumnRenamed("set_hash", "node")
    reps = materialize(some.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "reps")
    classes = materialize(some.join(reps, ["doc_id", "node"], "left_semi").dropDuplicates(["node"]).select("doc_id", "node", "n_shingles", "bands", "sig"), "classes")
    banded = classes.select("node", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.min(F.struct("node", "n_shingles")).alias("hub"), F.count("*").alias("n")).filter("n > 1")
    buckets = materialize(banded.join(shared.select("bucket", F.col("hub.node").alias("hub"), F.col("hub.n_shingles").alias("hub_n")), "bucket"), "buckets")
    near = F.least("n_shingles", "hub_n") * 100 >= F.greatest("n_shingles", "hub_n") * PERCENT
    first = buckets.filter((F.col("node") != F.col("hub")) & near).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = linked(first, classes, docs)
    roots = components(links)
    discard(links)

    root = lambda d: d.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    hub_root = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    placed = root(buckets.drop("hub_n")).join(hub_root, "hub", "left").withColumn("hub_root", F.coalesce("hub_root", "hub"))
    more = finish(materialize(placed, "placed"), classes, docs, chunk)
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    discard(buckets, more)

    by_root = root(reps).groupBy("root").agg(F.min("doc_id").alias("least"))
    by_class = root(reps).join(by_root, "root").select(F.col("node").alias("set_hash"), "least")
    joined = made.select("doc_id", "n_shingles", "set_hash").join(by_class, "set_hash", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("least")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with one row of each group of near copies: the one with the smallest doc_id, rows without id
    last. Rows are told apart by a number, so repeated and null doc_ids lose no text that has no copy; rows without words stay."""
    row = free_name(docs, "_row")
    rows = numbered(docs, "numbered", row)
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias(row), "component_id")
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)).alias("least")
    least = found.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(order)
    kept = least.select(F.col("least")[row].alias(row))
    return rows.join(kept, row, "left_semi").select(*[quoted(c) for c in docs.columns])


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
