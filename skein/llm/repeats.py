"""Removal of repeated substrings of LENGTH bytes by sorted ranks.

Doubling from single bytes would sort a row for each byte of the corpus in each of six rounds, so the early rounds are
replaced by ones that lose nothing:
1. Equal texts are one class (rank of the whole text); only its first document takes part.
2. Any two equal LENGTH-byte strings have the same smallest K-byte hash inside. Runs of places that share this minimum
   are ranked by it and by the hash of all bytes they cover. Documents are dealt into groups of GROUP_BYTES; each sends
   its distinct runs, sorted and packed into arrays, to buckets of ranks and gets back the smallest document of each run.
   A run that a smaller document holds as a whole is removed as a whole; one whose minimum lies in one document leaves.
3. For the smallest document of a run whose minimum has other runs too, the last doubling step is taken place by place:
   the rank of LENGTH bytes is the pair of ranks of its first and last HALF bytes (48 and 64 bits of hash are kept).
   Places go to buckets and come back as the runs do.

Groups and buckets grow with the input. A task holds one group's texts or one bucket's runs, in which a run counts once
for each group, however many documents hold it. Rows between the two are at most the distinct runs of the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, table

LENGTH, K, HALF = 50, 24, 32
GROUP_BYTES = 8 << 20
#: Bytes hashed at once inside a group.
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15


def mixed(x, m: int):
    """64-bit hashes of the m-byte strings at each place (m a multiple of 8)."""
    import numpy as np

    n = len(x) - m + 1
    out = np.full(max(0, n), m, np.uint64)
    if n <= 0:
        return out
    y = x.astype(np.uint64)
    word = np.zeros(len(x) - 7, np.uint64)
    for j in range(8):
        word |= y[j : j + len(word)] << np.uint64(8 * j)
    for j in range(0, m, 8):
        out = (out ^ word[j : j + n]) * np.uint64(BASE)
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out


def blocks(texts) -> Iterator[tuple[int, list[bytes]]]:
    """Index of the first text, and UTF-8 texts of about BLOCK bytes together."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t.encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= BLOCK:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def runs_of(raws: list[bytes]):
    """Text index, start, end (exclusive), smallest hash and hash of all covered bytes of the runs of LENGTH-byte places
    that share their smallest K-byte hash. Each text has LENGTH bytes at least."""
    import numpy as np

    x = np.frombuffer(b"".join(raws), np.uint8)
    sizes = np.array([len(r) for r in raws])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(raws), dtype=np.int32), sizes)
    h = mixed(x, K)
    low, span, size = h, LENGTH - K + 1, 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if span > size:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    n = len(low)
    valid = np.arange(LENGTH, n + LENGTH) <= ends[owner[:n]]
    joined = valid[1:] & valid[:-1] & (low[1:] == low[:-1])
    first = np.flatnonzero(valid & ~np.concatenate([[False], joined]))
    last = np.flatnonzero(valid & ~np.concatenate([joined, [False]])) + 1
    # hash of a run: the K-byte hashes inside, weighed by powers of an odd base relative to its start
    power = np.cumprod(np.full(len(h), BASE, np.uint64))
    back = np.cumprod(np.full(len(h), pow(BASE, -1, 1 << 64), np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power)])
    body = (total[last + (LENGTH - K)] - total[first]) * back[first]
    begin = (ends - sizes)[owner[first]]
    return owner[first], first - begin, last - begin, low[first].view(np.int64), body.view(np.int64)


def removed(places) -> list[tuple[int, int]]:
    """Maximal runs covered by the LENGTH-byte strings that begin at the places (lo, hi exclusive)."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(places):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi - 1 + LENGTH))
        else:
            out.append((lo, hi - 1 + LENGTH))
    return out


def packed(value):
    """Six bytes for each value: documents may share them by chance, which costs time only, as bodies tell runs apart."""
    import numpy as np

    return np.ascontiguousarray(value.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpacked(raw: bytes):
    import numpy as np

    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.int64).ravel()


SENT = "bucket long, grp long, value binary, body binary, docs binary, doc binary, several binary"
TOLD = "grp long, value binary, body binary, least binary, more binary"


def distinct(found, grp: int, n_buckets: int):
    """One group's distinct (value, body) as arrays for each bucket: the smallest document (index into docs) and whether
    there are several."""
    import numpy as np
    import pandas as pd

    out = []
    if found:
        value, body, doc = (np.concatenate(c) for c in zip(*found))
        value = value & np.int64(-65536)
        order = np.lexsort((doc, body, value))
        value, body, doc = value[order], body[order], doc[order]
        new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (body[1:] != body[:-1])]))
        several = doc[new] != doc[np.append(new[1:], len(value)) - 1]
        value, body, doc = value[new], body[new], doc[new]
        bucket = (value.view(np.uint64) >> np.uint64(16)) % np.uint64(n_buckets)
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            seen, index = np.unique(doc[part], return_inverse=True)
            kind = np.uint16 if len(seen) <= 1 << 16 else np.uint32
            out.append((int(bucket[part[0]]), grp, packed(value[part]), body[part].tobytes(), seen.tobytes(), index.astype(kind).tobytes(), np.packbits(several[part]).tobytes()))
    return pd.DataFrame(out, columns=["bucket", "grp", "value", "body", "docs", "doc", "several"])


def send_runs(n_buckets: int):
    def run(group):
        import numpy as np

        ids, found = group["doc_id"].to_numpy(np.int64), []
        for at, raws in blocks(group["text"]):
            owner, _, _, value, body = runs_of(raws)
            found.append((value, body, ids[owner + at]))
        return distinct(found, int(group["grp"].iloc[0]), n_buckets)

    return run


def answer(bucket):
    """For each group, its bodies that take part: smallest document, and whether the value has other bodies too."""
    import numpy as np
    import pandas as pd

    parts = []
    for k, r in enumerate(bucket.itertuples(index=False)):
        value, body = unpacked(r.value), np.frombuffer(r.body, np.int64)
        index = np.frombuffer(r.doc, np.uint16 if len(r.doc) == 2 * len(value) else np.uint32)
        parts.append((value, body, np.frombuffer(r.docs, np.int64)[index], np.unpackbits(np.frombuffer(r.several, np.uint8), count=len(value)).astype(bool), np.full(len(value), k, np.int32)))
    value, body, doc, several, row = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((doc, body, value))
    value, body, doc, several, row = value[order], body[order], doc[order], several[order], row[order]
    new_value = np.concatenate([[True], value[1:] != value[:-1]])
    new_body = new_value | np.concatenate([[True], body[1:] != body[:-1]])
    at_value, at_body = np.flatnonzero(new_value), np.flatnonzero(new_body)
    which, which_body = np.cumsum(new_value) - 1, np.cumsum(new_body) - 1
    least = doc[at_body][which_body]
    often = (np.minimum.reduceat(doc, at_value) != np.maximum.reduceat(doc, at_value)) | np.logical_or.reduceat(several, at_value)
    more = (np.add.reduceat(new_body.astype(np.int64), at_value) > 1)[which]
    # a run whose only document here is its smallest, without other runs, has nothing to learn
    keep = np.flatnonzero(often[which] & (more | several | (doc > least)))
    out, groups = [], bucket["grp"].to_numpy()
    keep = keep[np.argsort(row[keep], kind="stable")]
    for part in np.split(keep, np.flatnonzero(np.diff(row[keep])) + 1) if len(keep) else []:
        out.append((int(groups[row[part[0]]]), packed(value[part]), body[part].tobytes(), least[part].tobytes(), np.packbits(more[part]).tobytes()))
    return pd.DataFrame(out, columns=["grp", "value", "body", "least", "more"])


def told(replies):
    """The replies to one group as a frame (value, body, least, more)."""
    import numpy as np
    import pandas as pd

    long = lambda c: np.concatenate([np.frombuffer(b, np.int64) for b in replies[c]])
    more = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(b) // 8).astype(bool) for m, b in zip(replies["more"], replies["body"])]
    return pd.DataFrame({"value": np.concatenate([unpacked(v) for v in replies["value"]]), "body": long("body"), "least": long("least"), "more": np.concatenate(more)})


def matched(texts, ids, told_runs) -> Iterator:
    """For each block of texts: index of the first, texts, the runs that were replied to, and the places (text, place,
    value, body) of the smallest documents of runs whose minimum has other runs too."""
    import numpy as np
    import pandas as pd

    for at, raws in blocks(texts):
        owner, lo, hi, value, body = runs_of(raws)
        r = pd.DataFrame({"owner": owner, "lo": lo, "hi": hi, "value": value & np.int64(-65536), "body": body, "doc_id": ids[owner + at]}).merge(told_runs, on=["value", "body"])
        p = r[r["more"] & (r["doc_id"] == r["least"])]
        begin = np.concatenate([[0], np.cumsum([len(x) for x in raws])])
        n = (p["hi"] - p["lo"]).to_numpy()
        pos = np.repeat(p["lo"].to_numpy() - (np.cumsum(n) - n), n) + np.arange(n.sum())
        own = np.repeat(p["owner"].to_numpy(), n)
        h = mixed(np.frombuffer(b"".join(raws), np.uint8), HALF)
        head, tail = h[begin[own] + pos], h[begin[own] + pos + (LENGTH - HALF)]
        pair = (head ^ np.uint64(BASE)) * np.uint64(0xD6E8FEB86659FD93) + tail
        yield at, raws, r, own, pos, head.view(np.int64), pair.view(np.int64)


def send_places(n_buckets: int):
    def run(group, replies):
        import numpy as np

        found = []
        if len(group) and len(replies):
            ids = group["doc_id"].to_numpy(np.int64)
            for at, _, _, own, _, head, pair in matched(group["text"], ids, told(replies)):
                if len(own):
                    found.append((head, pair, ids[own + at]))
        return distinct(found, int(group["grp"].iloc[0]) if len(group) else 0, n_buckets)

    return run


def cut(group, replies):
    """h, bytes and spans removed and hash of the rest, for the texts of a group that lose something."""
    import numpy as np
    import pandas as pd

    out = []
    if len(group) and len(replies):
        ids, hashes = group["doc_id"].to_numpy(np.int64), group["h"].to_numpy()
        of_places = replies[replies["places"]]
        points = told(of_places) if len(of_places) else pd.DataFrame({"value": np.zeros(0, np.int64), "body": np.zeros(0, np.int64), "least": np.zeros(0, np.int64), "more": np.zeros(0, bool)})
        # a group that has replies to its places has some to its runs
        for at, raws, r, own, pos, head, pair in matched(group["text"], ids, told(replies[~replies["places"]])):
            w = r[r["doc_id"] > r["least"]][["owner", "lo", "hi"]]
            p = pd.DataFrame({"owner": own, "lo": pos, "value": head & np.int64(-65536), "body": pair, "doc_id": ids[own + at]}).merge(points, on=["value", "body"])
            p = p[p["doc_id"] > p["least"]]
            w = pd.concat([w, pd.DataFrame({"owner": p["owner"], "lo": p["lo"], "hi": p["lo"] + 1})]).sort_values(["owner", "lo"])
            for i, g in w.groupby("owner"):
                raw, spans, kept, done = raws[i], removed(zip(g["lo"].tolist(), g["hi"].tolist())), hashlib.sha256(), 0
                for x, y in spans:
                    kept.update(raw[done:x])
                    done = y
                kept.update(raw[done:])
                out.append((hashes[at + i], sum(y - x for x, y in spans), len(spans), kept.hexdigest()))
    return pd.DataFrame(out, columns=["h", "cut_bytes", "cut_spans", "cut_sha256"])


def dedup(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text).

    Defined results: null and empty texts keep nothing and lose nothing; rows that share a doc_id never take from each
    other; a row without doc_id neither gives nor takes; further columns are ignored."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("h"), F.octet_length(text).cast("long").alias("n_bytes"))
    able = rows.filter(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= LENGTH))
    first = materialize(able.groupBy("h").agg(F.min("doc_id").alias("rep"), F.min("n_bytes").alias("size")), "classes")
    n = 1 + (first.agg(F.sum("size")).first()[0] or 0) // group_bytes
    one = able.join(first.select("h", F.col("rep").alias("doc_id")), ["h", "doc_id"], "left_semi").dropDuplicates(["h", "doc_id"])
    one = materialize(one.select("doc_id", "text", "h", F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("grp")), "texts")
    grouped = one.groupBy("grp")
    runs = materialize(one.select("doc_id", "text", "grp").groupBy("grp").applyInPandas(send_runs(n), SENT).groupBy("bucket").applyInPandas(answer, TOLD), "answers")
    asked = one.select("doc_id", "text", "grp").groupBy("grp").cogroup(runs.groupBy("grp")).applyInPandas(send_places(n), SENT)
    points = materialize(asked.groupBy("bucket").applyInPandas(answer, TOLD), "points")
    replies = runs.withColumn("places", F.lit(False)).union(points.withColumn("places", F.lit(True)))
    cuts = materialize(grouped.cogroup(replies.groupBy("grp")).applyInPandas(cut, "h string, cut_bytes long, cut_spans long, cut_sha256 string"), "cuts")
    discard(one, runs, points)
    copy = F.col("doc_id") > F.col("rep")
    joined = rows.select("doc_id", "h", "n_bytes").join(first.select("h", "rep").join(cuts, "h", "left"), "h", "left")
    own = F.col("doc_id") == F.col("rep")
    nothing = hashlib.sha256().hexdigest()
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).when(own, F.coalesce("cut_bytes", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).when(own, F.coalesce("cut_spans", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(copy, F.lit(nothing)).when(own, F.coalesce("cut_sha256", "h")).otherwise(F.col("h")).alias("kept_sha256"),
    )


def op10_suffix(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
