"""Packing of token sequences by best-two-fit.

Documents become pieces of at most `capacity` tokens. Full pieces are sequences of their own. The others are
dealt by a hash into groups of a bounded number of pieces, and each group is packed in one task: fill
greedily by best fit (largest first), then replace a bin's smallest document by two unpacked ones that fit its
larger gap more tightly. Each group may leave one sequence part empty, nothing else is lost by grouping.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RunHashes, SlotTable, materialize, table

CAPACITY, END_ID, GROUP = 4096, 1, 30_000
#: Code points taken at once.
CHUNK = 1 << 20
#: Words are merged in classes of so many bytes at most; longer ones go through the tokenizer.
WORD_SIZES = (6, 11, 24)


def best_two_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices into lengths. One bin at a time is filled from what is unpacked: always the longest that
    fits; then its smallest document is given back if two unpacked ones fill its place and the gap better."""
    by_size: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        by_size.setdefault(n, []).append(i)
    sizes = sorted(by_size)  # distinct lengths still unpacked

    def take(n: int) -> int:
        i = by_size[n].pop()
        if not by_size[n]:
            del by_size[n]
            sizes.pop(bisect_right(sizes, n) - 1)
        return i

    def give(n: int, i: int) -> None:
        if n not in by_size:
            insort(sizes, n)
        by_size.setdefault(n, []).append(i)

    out = []
    while sizes:
        gap, mine = capacity, []
        while sizes and (k := bisect_right(sizes, gap)):
            mine.append((n := sizes[k - 1], take(n)))
            gap -= n
        if gap and len(mine) > 1 and sizes:
            n, i = mine[-1]
            room, best, lo, hi = gap + n, (n, 0, 0), 0, len(sizes) - 1
            while lo <= hi:  # two pointers over the distinct lengths
                both = sizes[lo] + sizes[hi]
                if both > room:
                    hi -= 1
                    continue
                if both > best[0] and (lo < hi or len(by_size[sizes[lo]]) > 1):
                    best = (both, sizes[lo], sizes[hi])
                lo += 1
            if best[0] > n:
                mine.pop()
                mine += [(best[2], take(best[2])), (best[1], take(best[1]))]
                give(n, i)
        out.append([i for _, i in mine])
    return out


class Merges:
    """Byte pair merges of many words at once, each word a row of symbol ids."""

    def __init__(self, vocabulary: str):
        import json
        from pathlib import Path

        import numpy as np

        model = json.loads(Path(vocabulary).read_text(encoding="utf-8"))["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        # bytes as signs: printable ones stand for themselves, the others follow from 256 on
        plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or 174 <= b]
        signs = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.inner = np.array([ids[signs[b]] for b in range(256)], np.int64)
        self.final = np.array([ids[signs[b] + end] for b in range(256)], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        rank_of = {}
        for rank, (a, b) in enumerate(pairs):
            rank_of.setdefault((ids[a] + 1) << 32 | ids[b] + 1, rank)
        self.pairs, self.none = SlotTable(17), len(pairs)
        self.pairs.add(np.array(list(rank_of), np.uint64), np.array(list(rank_of.values())))
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)

    def rank(self, a, b):
        """The rank of each pair; `none` for those that don't merge."""
        import numpy as np

        keys = (a + 1).astype(np.uint64) << np.uint64(32) | (b + 1).astype(np.uint64)
        found = self.pairs.find(keys.ravel()).reshape(keys.shape)
        return np.where(found < 0, self.none, found).astype(np.int32)

    def __call__(self, raw, starts, ends):
        """The ids of the words raw[starts:ends] (UTF-8 bytes), in a row, and how many each word has."""
        import numpy as np

        size, most = ends - starts, int((ends - starts).max())
        at = starts[:, None] + np.arange(most)
        sign = raw[np.minimum(at, len(raw) - 1)]
        rows = np.where(at < ends[:, None] - 1, self.inner[sign], np.where(at == ends[:, None] - 1, self.final[sign], -1)).astype(np.int32)
        ids, live, rank = np.full_like(rows, -1), np.arange(len(size)), self.rank(rows[:, :-1], rows[:, 1:])
        for width in range(most, 0, -1):  # each round merges the first pair of least rank in every row that has one
            n = np.arange(len(live))
            at = rank.argmin(axis=1) if width > 1 else n
            best = rank[n, at] if width > 1 else np.full(len(live), self.none)
            go = best < self.none
            ids[live[~go], :width] = rows[~go]
            live, rows, rank, at, best = live[go], rows[go], rank[go], at[go], best[go]
            if not len(live):
                break
            n, part = np.arange(len(live)), np.ones((len(live), width), bool)
            rows[n, at], part[n, at + 1] = self.made[best], False
            rows = rows[part].reshape(len(live), width - 1)
            size[live] -= 1
            part = part[:, 1:]  # the pair's own place
            rank = rank[part].reshape(len(live), width - 2)
            if width > 2:
                left, right = np.maximum(at - 1, 0), np.minimum(at, width - 3)
                rank[n, left] = self.rank(rows[n, left], rows[n, left + 1])
                rank[n, right] = self.rank(rows[n, right], rows[n, right + 1])
        return ids[np.arange(most) < size[:, None]], size


class WordIds:
    """Token ids of whole texts, put together from the ids of their words.

    The vocabulary's pre-tokenizer keeps the matches of one expression on composed, lower-cased text: a contraction, a run
    of letters, a single digit, or a run of other signs; each match is encoded by itself. So a text's ids are its words' ids
    in a row. Words are found and hashed in numpy, for many texts at once; a table of 64-bit hashes gives the ids of known
    words, and only unknown ones are merged pair by pair, many at once. Texts with the literal form of a special
    token, with signs whose lower case or composition changes their number, or beyond the first plane go through it whole.
    Tables that have grown beyond `limit` words start anew, which costs time only."""

    SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
    #: What may follow a lone apostrophe to form a word with it.
    CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

    def __init__(self, vocabulary: str, limit: int = 1_500_000):
        import os
        import unicodedata

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = self.tok = Tokenizer.from_file(vocabulary)
        tok.no_truncation()
        tok.no_padding()
        self.special = [t.content for t in tok.get_added_tokens_decoder().values()]
        self.merges = Merges(vocabulary)
        self.kind, self.lower = np.full(1 << 16, self.OTHER, np.uint8), np.arange(1 << 16, dtype=np.uint16)
        for c in range(1 << 16):
            ch = chr(c)
            if ch.isspace() and not 0x1C <= c <= 0x1F:
                self.kind[c] = self.SPACE
                continue
            low, group = ch.lower(), unicodedata.category(ch)
            if len(low) != 1 or group in ("Cs", "Cn"):
                self.kind[c] = self.ODD
                continue
            self.lower[c] = ord(low)
            self.kind[c] = self.LETTER if group[0] == "L" else self.DIGIT if group[0] == "N" else self.OTHER
        self.hashes, self.limit = RunHashes(1 << 16), limit
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.known, self.starts, self.sizes, self.flat, self.used, self.words = SlotTable(16), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.uint32), 0, 0

    def plain(self, text: str) -> bool:
        import unicodedata

        return not any(s in text for s in self.special) and unicodedata.is_normalized("NFC", text)

    def cut(self, x, kind):
        """Start and end of each word of the code units x (kind: their kinds)."""
        import numpy as np

        new = np.ones(len(x) + 1, bool)
        new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == self.DIGIT)
        quotes = np.flatnonzero(x == ord("'"))
        quotes = quotes[new[quotes] & new[quotes + 1]]
        follow = lambda at, j: np.where(at + j < len(x), x[np.minimum(at + j, len(x) - 1)], 0)
        for said in self.CONTRACTIONS:
            if len(quotes):
                fits = np.logical_and.reduce([follow(quotes, j) == ord(c) for j, c in enumerate(said, 1)])
                new[quotes[fits] + 1] = False
                new[quotes[fits] + 1 + len(said)] = True
                quotes = quotes[~fits]
        edge = np.flatnonzero(new)
        starts, ends = edge[:-1], edge[1:]
        word = kind[starts] != self.SPACE
        return starts[word], ends[word]

    def learn(self, x, keys, starts, ends) -> None:
        """Words of x at starts and ends, with their distinct keys, go into the tables."""
        import numpy as np

        if not len(keys):
            return
        n = ends - starts
        stop = np.cumsum(n + 1)
        units = np.full(stop[-1], 10, np.uint16)
        units[np.repeat(stop - n - 1 - (np.cumsum(n) - n), n) + np.arange(n.sum())] = x[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        raw = np.frombuffer(units.tobytes().decode("utf-16-le").encode(), np.uint8)
        ends = np.flatnonzero(raw == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        low = 0
        for most in WORD_SIZES:
            which = np.flatnonzero((ends - starts > low) & (ends - starts <= most))
            low = most
            for part in (which[i : i + 20000] for i in range(0, len(which), 20000)):
                self.keep(keys[part], *self.merges(raw, starts[part], ends[part]))
        for i in np.flatnonzero(ends - starts > low):
            ids = np.array(self.tok.encode(raw[starts[i] : ends[i]].tobytes().decode(), add_special_tokens=False).ids)
            self.keep(keys[i : i + 1], ids, np.array([len(ids)]))

    def keep(self, keys, ids, sizes) -> None:
        import numpy as np

        n = len(keys)
        for name, need in (("starts", self.words + n), ("sizes", self.words + n), ("flat", self.used + len(ids))):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(need, len(held)), held.dtype)]))
        self.starts[self.words : self.words + n], self.sizes[self.words : self.words + n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.known.add(keys, np.arange(self.words, self.words + n))
        self.words, self.used = self.words + n, self.used + len(ids)

    def __call__(self, texts: list[str]) -> list:
        """An array of ids for each text."""
        import numpy as np

        plain = [self.plain(t) for t in texts]
        x = np.frombuffer("\n".join(t if p else "" for t, p in zip(texts, plain)).encode("utf-16-le", "surrogatepass"), np.uint16)
        kind = self.kind[x]
        breaks = np.concatenate([[0], np.cumsum([0 if not p else len(t) if t.isascii() else len(t.encode("utf-16-le", "surrogatepass")) // 2 for t, p in zip(texts, plain)]) + np.arange(1, len(texts) + 1)])
        if (kind == self.ODD).any():
            for i in set(np.searchsorted(breaks, np.flatnonzero(kind == self.ODD), "right") - 1):
                plain[i] = False
        x = self.lower[x]
        starts, ends = self.cut(x, kind) if len(x) else (np.zeros(0, np.int64),) * 2
        keys = self.hashes(x, starts, ends)
        found = self.known.find(keys)
        if (found < 0).any():
            if self.words > self.limit:
                self.clear()
                found[:] = -1
            unseen = np.flatnonzero((found < 0) & (kind[starts] != self.ODD))
            new, first = np.unique(np.maximum(keys[unseen], np.uint64(1)), return_index=True)
            self.learn(x, new, starts[unseen[first]], ends[unseen[first]])
            found = self.known.find(keys)
        sizes = np.where(found < 0, 0, self.sizes[found])
        total = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.flat[np.repeat(self.starts[found] - total[:-1], sizes) + np.arange(total[-1])]
        cuts = total[np.searchsorted(starts, breaks)]
        return [flat[a:b] if p else np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32) for t, p, a, b in zip(texts, plain, cuts[:-1].tolist(), cuts[1:].tolist())]


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(vocabulary: str) -> WordIds:
    """The tables of this worker, which later tasks find filled."""
    if vocabulary not in _WORD_IDS:
        _WORD_IDS[vocabulary] = WordIds(vocabulary)
    return _WORD_IDS[vocabulary]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's token ids followed by end_id."""

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pandas as pd

        ids_of, last = word_ids(vocabulary), np.array([end_id], np.uint32)
        for b in batches:
            texts = [t or "" for t in b["text"]]
            out, at = [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
                    size, to = size + len(texts[to]), to + 1
                for doc_id, ids in zip(b["doc_id"].iloc[at:to], ids_of(texts[at:to])):
                    ids = np.concatenate([ids, last]).astype("<u4")
                    for p, start in enumerate(range(0, len(ids), capacity)):
                        x = ids[start : start + capacity]
                        out.append((doc_id, p, start, len(x), zlib.crc32(x.tobytes())))
                at = to
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(made: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The rows of made (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    n = made.filter(F.col("length") < capacity).count()
    groups, columns = max(1, -(-n // group)), list(made.columns)
    salted = made.withColumn("_salt", F.xxhash64("doc_id", "piece", "length", "ids_crc32"))
    full = salted.filter(F.col("length") >= capacity).select(*made.columns, (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # equal rows differ by their place, so that copies of a row without id don't meet in one group
    rest = salted.filter(F.col("length") < capacity).withColumn("_group", F.pmod(F.xxhash64("_salt", F.monotonically_increasing_id()), F.lit(groups)))

    def one(key, pdf):
        import numpy as np

        lengths = pdf["length"].tolist()
        seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for k, inside in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for i in inside:
                seq[i], off[i] = (int(key[0]) << 32) + k, at
                at += lengths[i]
        return pdf[columns].assign(sequence_id=seq, offset=off)

    packed = rest.groupBy("_group").applyInPandas(one, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return full.unionByName(packed)


def pack_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The pieces of every row of docs (doc_id, text) with their place.

    Defined results: a null or empty text is the end id alone; only documents over 4096 ids are cut; repeated rows
    and rows without id each give their pieces; an empty table gives no rows; further columns are ignored."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return pack(materialize(pieces(docs, vocabulary), "pieces"))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
