"""Language-model scoring by context-tree weighting over bytes.

Every byte is coded as eight binary decisions in the context of up to DEPTH bytes before it. Each node (context, bits so
far) holds zeros and ones seen in training; a node's weighted probability is half its Krichevsky-Trofimov estimate,
half the product of its longer contexts'. The posterior weights then mix the estimates of all depths along a context's
path. Where a longer context was never seen, the estimate of the longest one seen stands for it.

Texts are lower-cased (A-Z), preceded by DEPTH bytes 255 and closed by one. What is gathered from the corpus grows with it
and stays distributed:
1. Rows are dealt by a hash into groups of about GROUP_BYTES of text. Each group sends its distinct grams (context and
   byte) and words with their counts, sorted and packed into arrays, to buckets: grams by the last two context bytes, so
   that a bucket's subtrees below depth 1 are whole, words by hash.
2. Buckets merge the arrays and sum up what belongs to depth 1 and 0; those 65,280 nodes at most are collected.
3. Each bucket computes the value of each of its grams once and sends it back to the groups that asked.
4. A group's texts are read behind its replies in one partition, batch by batch.

Rows between groups and buckets number groups times buckets at most; no row stands for a place of a text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RunHashes, SlotTable, discard, materialize, table

DEPTH, END = 6, 255
#: Bytes of text of a group and for a bucket, bytes taken at once, grams held by a group before it sends them.
GROUP_BYTES, BUCKET_BYTES, CHUNK, FLUSH = 32 << 20, 12 << 20, 1 << 20, 4_000_000
#: Key of the word that ends each text.
END_WORD = 2


def raw_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def chunks(raws: list[bytes], most: int = 256) -> Iterator[tuple[int, list[bytes]]]:
    """Index of the first, and `most` texts or about CHUNK bytes in a row."""
    at, size = 0, 0
    for i, raw in enumerate(raws):
        size += len(raw)
        if size >= CHUNK or i + 1 - at == most or i + 1 == len(raws):
            yield at, raws[at : i + 1]
            at, size = i + 1, 0


def grams(raws: list[bytes]):
    """The gram (context, byte) at each coded place of all texts, text after text: as many as bytes and one for each."""
    import numpy as np

    pad = bytes([END]) * DEPTH
    x = np.frombuffer(b"".join(pad + t + pad[:1] for t in raws), np.uint8)
    two = x[:-1].astype(np.uint16) << 8 | x[1:]
    four = two[:-2].astype(np.uint32) << 16 | two[2:]
    key = four[:-3].astype(np.uint64) << np.uint64(24) | (four[3:] & np.uint32(0xFFFFFF))
    n = np.array([len(t) + 1 for t in raws])
    use = np.ones(len(key) + DEPTH, bool)
    starts = np.cumsum(n[:-1] + DEPTH)
    for j in range(DEPTH):  # places whose byte belongs to the padding of the next text
        use[starts - DEPTH + j] = False
    return key[use[: len(key)]], n


class Words:
    """Keys of the words of texts, their ends included."""

    def __init__(self):
        import numpy as np

        self.hashes = RunHashes(256)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True

    def __call__(self, raws: list[bytes]):
        """The keys, and the index of each key's text."""
        import numpy as np

        x = np.frombuffer(b"\n" + b"\n".join(raws) + b"\n", np.uint8)
        space = self.space[x]
        starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
        begin = np.cumsum([1] + [len(r) + 1 for r in raws])
        of = np.searchsorted(begin, starts, "right") - 1
        keys = np.maximum(self.hashes(x, starts, ends), np.uint64(END_WORD + 1))
        return np.concatenate([keys, np.full(len(raws), END_WORD, np.uint64)]), np.concatenate([of, np.arange(len(raws))])


def counted(keys):
    """Sorted distinct keys with their number."""
    import numpy as np

    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def merged(keys, n):
    """Sorted distinct keys, the sums of n and the index of each key among them."""
    import numpy as np

    order = np.argsort(keys)
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return keys[new], np.bincount(back, n, minlength=int(new.sum())) if len(keys) else np.zeros(0), back


def log_gamma(x):
    import numpy as np

    y, low = x + 6.0, np.ones_like(x)
    for j in range(6):
        low = low * (x + j)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


def kt(a, b):
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)


def stacked(keys, n, least: int):
    """(keys, n, up) of the grams of depth DEPTH..least, the deepest first; up: for each key above, its index here."""
    import numpy as np

    out = [(keys, n, None)]
    for depth in range(DEPTH - 1, least - 1, -1):
        out.append(merged(out[-1][0] & np.uint64((1 << 8 * (depth + 1)) - 1), out[-1][1]))
    return out


def chain(stack, level: int):
    """For each layer of a stack its nodes of one bit level: node of each key, first key of each node, zeros, ones, weight of
    the own estimate, and the sum of what is below. Keys are in order, so a node is a run of them."""
    import numpy as np

    out, first_above, total = [], None, None
    for keys, n, up in stack:
        head = keys >> np.uint64(8 - level)
        new = np.concatenate([[True], head[1:] != head[:-1]])
        node, bit, below = np.cumsum(new) - 1, (keys >> np.uint64(7 - level) & np.uint64(1)).astype(bool), None
        a, b = np.bincount(node, np.where(bit, 0, n)), np.bincount(node, np.where(bit, n, 0))
        own = kt(a, b)
        if up is not None:
            below = np.bincount(node[up[first_above]], total, minlength=len(a))
            total = math.log(0.5) + np.logaddexp(own, below)
        else:
            total = own
        weight = np.exp(math.log(0.5) + own - total) if up is not None else np.ones(len(own))
        first_above = np.flatnonzero(new)
        out.append((node, first_above, a, b, weight, below))
    return out


def top_parts(keys, n):
    """Nodes of depth 1 as (b1 << 8 | node), zeros, ones and the sum of what is below, from the grams of one bucket."""
    import numpy as np

    stack, parts = stacked(keys, n, 1), []
    for level in range(8):
        _, first, a, b, _, below = chain(stack, level)[-1]
        k = stack[-1][0][first]
        node = (k >> np.uint64(8)) << np.uint64(8) | np.uint64(1 << level) | (k & np.uint64(255)) >> np.uint64(8 - level)
        parts.append((node, a, b, below))
    return [np.concatenate(c) for c in zip(*parts)]


def top_of(node, a, b, below):
    """Depth 1 and depth 0 as arrays over (b1 << 8 | node) and node: zeros, ones, weight of the own estimate."""
    import numpy as np

    one, root = [np.zeros(1 << 16), np.zeros(1 << 16), np.ones(1 << 16)], [np.zeros(256), np.zeros(256), np.ones(256)]
    if len(node):
        own = kt(a, b)
        total = math.log(0.5) + np.logaddexp(own, below)
        one[0][node], one[1][node], one[2][node] = a, b, np.exp(math.log(0.5) + own - total)
        sums = [np.bincount(node & 255, v, minlength=256) for v in (a, b, total)]
        own = kt(sums[0], sums[1])
        root = [sums[0], sums[1], np.exp(own - np.logaddexp(own, sums[2]))]
    return one, root


def values(keys, n, top):
    """log10 probability of the byte of each gram of one bucket in its context."""
    import numpy as np

    stack, logs = stacked(keys, n, 2), np.zeros(len(keys))

    def see(state, bit, a, b, w):
        """One depth further: where it was seen, its estimate is the one that stands for all deeper ones."""
        acc, rest, last, weight = state
        seen = a + b > 0
        est = (np.where(bit, b, a) + 0.5) / (a + b + 1)
        acc = np.where(seen, acc + rest * weight * last, acc)
        rest = np.where(seen, rest * (1 - weight), rest)
        return acc, rest, np.where(seen, est, last), np.where(seen, w, weight)

    k = stack[-1][0]
    ones = (k >> np.uint64(8) & np.uint64(255)).astype(np.int64) << 8
    for level in range(8):
        node = (np.uint64(1 << level) | (k & np.uint64(255)) >> np.uint64(8 - level)).astype(np.int64)
        bit = (k >> np.uint64(7 - level) & np.uint64(1)).astype(bool)
        state = np.zeros(len(k)), np.ones(len(k)), np.full(len(k), 0.5), np.zeros(len(k))
        for (a, b, w), at in ((top[1], node), (top[0], ones | node)):
            state = see(state, bit, a[at], b[at], w[at])
        links = chain(stack, level)
        for i in range(len(stack) - 1, -1, -1):
            if i < len(stack) - 1:
                state = tuple(s[stack[i + 1][2]] for s in state)
            at, _, a, b, w, _ = links.pop()
            state = see(state, (stack[i][0] >> np.uint64(7 - level) & np.uint64(1)).astype(bool), a[at], b[at], w[at])
        acc, rest, last, _ = state
        logs += np.log10(acc + rest * last)
    return logs


def pack7(keys) -> bytes:
    import numpy as np

    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def unpack7(raw: bytes):
    import numpy as np

    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return out.view(np.uint64).ravel()


class Counts:
    """Sorted keys and their counts, added to in place."""

    def __init__(self):
        import numpy as np

        self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.uint32)

    def add(self, keys, n) -> None:
        """Sorted distinct keys with their counts."""
        import numpy as np

        at = np.searchsorted(self.keys, keys)
        held = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        self.n[at[held]] += n[held].astype(np.uint32)
        self.keys, self.n = np.insert(self.keys, at[~held], keys[~held]), np.insert(self.n, at[~held], n[~held].astype(np.uint32))


def bucket_of(n_buckets: int):
    """The bucket of each pair of last context bytes."""
    import numpy as np

    return ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(RunHashes.BASE) >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.uint16)


def send(n_buckets: int):
    """Rows of a group's distinct grams and words for each bucket, with their times in the rows to learn from."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        words, place = Words(), bucket_of(n_buckets)

        def rows(grp, held):
            parts = []
            for counts, at in ((held[0], place[(held[0].keys >> np.uint64(8)).astype(np.int64) & 65535]), (held[1], (held[1].keys % np.uint64(n_buckets)).astype(np.uint16))):
                order = np.argsort(at, kind="stable")
                parts += [counts.keys[order], counts.n[order], np.searchsorted(at[order], np.arange(n_buckets + 1))]
            g, gn, gc, t, tn, tc = parts
            out = [(b, grp, pack7(g[gc[b] : gc[b + 1]]), gn[gc[b] : gc[b + 1]].tobytes(), t[tc[b] : tc[b + 1]].tobytes(), tn[tc[b] : tc[b + 1]].tobytes()) for b in range(n_buckets) if gc[b] < gc[b + 1] or tc[b] < tc[b + 1]]
            return pd.DataFrame(out, columns=["bucket", "grp", "grams", "gram_n", "words", "word_n"])

        grp, held = None, (Counts(), Counts())
        for b in batches:
            groups, learnt = b["grp"].to_numpy(), b["train"].to_numpy(bool)
            for now in sorted(set(groups.tolist())):
                if now != grp:
                    if grp is not None:
                        yield rows(grp, held)
                    grp, held = now, (Counts(), Counts())
                for learn in (True, False):
                    raws = [raw_bytes(t) for t in b["text"][(groups == now) & (learnt == learn)]]
                    for _, few in chunks(raws, 1 << 20):
                        for counts, keys in zip(held, (grams(few)[0], words(few)[0])):
                            keys, n = counted(keys)
                            counts.add(keys, n if learn else np.zeros_like(n))
                        if len(held[0].keys) >= FLUSH:
                            yield rows(grp, held)
                            held = (Counts(), Counts())
        if grp is not None:
            yield rows(grp, held)

    return run, "bucket int, grp int, grams binary, gram_n binary, words binary, word_n binary"


def together(bucket, what: str, unpack):
    import numpy as np

    parts = [unpack(x) for x in bucket[what]]
    name = "gram_n" if what == "grams" else "word_n"
    n = np.concatenate([np.frombuffer(x, np.uint32) for x in bucket[name]]).astype(float)
    keys, sums, back = merged(np.concatenate(parts), n)
    return keys, sums, np.split(back, np.cumsum([len(p) for p in parts])[:-1]), parts


def as_words(raw: bytes):
    import numpy as np

    return np.frombuffer(raw, np.uint64)


def tops(bucket):
    """One bucket's parts of the nodes of depth 1; in row -1 its numbers of training words and of distinct ones."""
    import numpy as np
    import pandas as pd

    keys, n, _, _ = together(bucket, "grams", unpack7)
    _, c, _, _ = together(bucket, "words", as_words)
    node, a, b, below = top_parts(keys[n > 0], n[n > 0]) if (n > 0).any() else [np.zeros(0)] * 4
    return pd.DataFrame({"node": np.append(node.astype(np.int64), -1), "a": np.append(a, c.sum()), "b": np.append(b, (c > 0).sum()), "below": np.append(below, 0.0)})


def answer(top):
    def run(bucket):
        import numpy as np
        import pandas as pd

        keys, n, at, parts = together(bucket, "grams", unpack7)
        value = values(keys, n, top).astype(np.float32) if len(keys) else np.zeros(0, np.float32)
        _, c, c_at, words = together(bucket, "words", as_words)
        rows = [(grp, pack7(g), value[i].tobytes(), w.tobytes(), c[j].astype(np.int64).tobytes()) for grp, g, i, w, j in zip(bucket["grp"], parts, at, words, c_at)]
        return pd.DataFrame(rows, columns=["grp", "grams", "value", "words", "c"])

    return run


def lookup(batches: Iterator) -> Iterator:
    """Scores of texts; in each partition a group's replies come before its texts."""
    import numpy as np
    import pandas as pd

    words, grp, replies, known = Words(), None, [], None
    for b in batches:
        groups, is_text = b["grp"].to_numpy(), b["is_text"].to_numpy(bool)
        cuts = np.flatnonzero((groups[1:] != groups[:-1]) | (is_text[1:] != is_text[:-1])) + 1
        for part in np.split(np.arange(len(b)), cuts):
            if not len(part):
                continue
            some = b.iloc[part]
            if groups[part[0]] != grp:
                grp, replies, known = groups[part[0]], [], None
            if not is_text[part[0]]:
                replies += list(zip(some["grams"], some["value"], some["words"], some["c"]))
                continue
            if known is None:
                keys, value = (np.concatenate(c) for c in zip(*[(unpack7(r[0]), np.frombuffer(r[1], np.float32)) for r in replies]))
                order = np.argsort(keys)
                keys, value = keys[order], value[order]
                w, c = (np.concatenate(x) for x in zip(*[(as_words(r[2]), np.frombuffer(r[3], np.int64)) for r in replies]))
                w, first = np.unique(w, return_index=True)
                counts = SlotTable(12)
                counts.add(w, c[first])
                known, replies = (keys, value, counts), []
            keys, value, counts = known
            raws = [raw_bytes(t) for t in some["text"]]
            score, base, n, hits = (np.zeros(len(raws)) for _ in range(4))
            for at, few in chunks(raws):
                mine, sizes = grams(few)
                mine = np.sort(mine << np.uint64(8) | np.repeat(np.arange(len(few), dtype=np.uint64), sizes))
                key = mine >> np.uint64(8)
                new = np.concatenate([[True], key[1:] != key[:-1]])
                j = np.searchsorted(keys, key[new])
                if j[-1] == len(keys) or (keys[j] != key[new]).any():
                    raise ValueError("a gram of the documents was not counted")
                score[at : at + len(few)] = np.bincount((mine & np.uint64(255)).astype(np.int64), value[j].astype(float)[np.cumsum(new) - 1], minlength=len(few))
                token, of = words(few)
                c = counts.find(token)
                if (c < 0).any():
                    raise ValueError("a word of the documents was not counted")
                for out, what in ((base, np.log10(c + 0.1)), (n, None), (hits, c > 0)):
                    out[at : at + len(few)] = np.bincount(of, what, minlength=len(few))
            yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64"), "train": some["train"].to_numpy(bool), "n_tokens": n.astype(np.int64), "n_known": hits.astype(np.int64), "base": base, "score": score})


def score_documents(docs: DataFrame, training, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    training: a Column that tells which rows are learnt from (null counts as false). Defined results: null and empty
    texts are the end alone; repeated rows each are scored and each count in training; with nothing to
    train on every bit has one half; a null doc_id is carried; an empty table gives no rows; further columns are ignored.
    Values of grams are kept in single precision."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(spark.sparkContext.defaultParallelism, size // GROUP_BYTES)
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    run, schema = send(min(60_000, 1 + size // bucket_bytes))
    sent = materialize(rows.drop("doc_id").repartitionById(groups, "grp").mapInPandas(run, schema), "sent")
    parts = sent.groupBy("bucket").applyInPandas(tops, "node long, a double, b double, below double")
    sums = materialize(parts.groupBy("node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("below").alias("below")), "tops")
    got = sums.orderBy("node").collect()
    import numpy as np

    n, v = (int(got[0].a), int(got[0].b)) if got else (0, 0)
    node, a, b, below = (np.array(c) for c in zip(*got[1:])) if got[1:] else [np.zeros(0, np.int64)] * 4
    top = spark.sparkContext.broadcast(top_of(node, a, b, below))  # 65,280 nodes at most

    def reply(bucket):
        return answer(top.value)(bucket)

    told = materialize(sent.groupBy("bucket").applyInPandas(reply, "grp int, grams binary, value binary, words binary, c binary"), "told")
    discard(sent, sums)
    no = lambda kind: F.lit(None).cast(kind)
    first = told.select("grp", F.lit(False).alias("is_text"), no("long").alias("doc_id"), no("string").alias("text"), no("boolean").alias("train"), "grams", "value", "words", "c")
    texts = rows.select("grp", F.lit(True).alias("is_text"), "doc_id", "text", "train", *[no("binary").alias(x) for x in ("grams", "value", "words", "c")])
    dealt = first.union(texts).repartitionById(groups, "grp").sortWithinPartitions("grp", "is_text")
    scores = dealt.mapInPandas(lookup, "doc_id long, train boolean, n_tokens long, n_known long, base double, score double")
    base = F.col("base") - F.col("n_tokens") * math.log10(n + 0.1 * (v + 1))
    return scores.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op5_context_tree(spark, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10))
    return score_documents(table(spark, sf_dir, "documents"), fold != 0)
