"""Benchmark decontamination by spaced seeds.

A seed hashes the words under the ones of a fixed mask, so a substituted word under a zero leaves the hash
as it is. Hits of a document's seeds in the benchmark's seed table are verified on the words around them:
the best ungapped segment on the hit's diagonal, where a match counts 1 and a substitution -2.

The benchmark is the stated query set: it is taken in blocks of BLOCK_WORDS words at most (checked), each
block meets all documents in one scan without a shuffle.
"""

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, table

MASKS = ("1111111", "110110111", "1011100111", "11010001111", "1110110011")
BLOCK_WORDS = 1_000_000
#: Words that must match, unless three quarters of the item are fewer.
LEAST_WORDS, SHARE = 12, 0.75
WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def seeds(h, mask: str):
    """The seed hash at each position of the word hashes h."""
    import numpy as np

    n = len(h) - len(mask) + 1
    out = np.full(max(0, n), len(mask), np.uint64)
    for j, c in enumerate(mask):
        if c == "1" and n > 0:
            out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out


def segment(same) -> tuple[int, int, int]:
    """Start, end and matches of the best segment of a diagonal (1 a match, -2 a substitution)."""
    import numpy as np

    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmin(total[: end + 1]))
    return start, end, int(same[start:end].sum())


class Overlaps:
    """The items of one block as an index of seeds; called with a text, it gives the best overlap with each item."""

    def __init__(self, items: list[tuple[int, str]], least: int = LEAST_WORDS, share: float = SHARE):
        import numpy as np

        self.least, self.share, hashes = least, share, WordHashes()
        self.hashes = hashes
        tests = self.tests = [(i, hashes(w)) for i, t in items if len(w := words(t))]
        self.index = []
        for mask in MASKS:
            parts = [(s, k) for k, (_, h) in enumerate(tests) if len(s := seeds(h, mask))]
            if parts:
                s = np.concatenate([p[0] for p in parts])
                at = np.concatenate([np.arange(len(p[0])) for p in parts])
                of = np.concatenate([np.full(len(p[0]), p[1]) for p in parts])
                order = np.argsort(s, kind="stable")
                some = np.zeros(1 << 20, bool)  # the seeds' upper bits: rules most places out before the search
                some[s >> np.uint64(44)] = True
                self.index.append((mask, some, s[order], of[order], at[order]))
        self.small = [(k, h) for k, (_, h) in enumerate(tests) if len(h) < len(MASKS[0])]

    def diagonals(self, h) -> set[tuple[int, int]]:
        """(item, diagonal) of the hits. A seed that an item repeats gives one diagonal for each place in the item and text;
        of places in a row on the same diagonal only the first is looked at, and a diagonal counts once."""
        import numpy as np

        found: set[tuple[int, int]] = set()
        for mask, some, s, of, at in self.index:
            mine = seeds(h, mask)
            places = np.flatnonzero(some[mine >> np.uint64(44)])
            low, high = np.searchsorted(s, mine[places]), np.searchsorted(s, mine[places], "right")
            hit = high > low
            places, low, n = places[hit], low[hit], (high - low)[hit]
            for start in range(0, len(places), 4096):  # pairs of a bounded number of places at a time
                p, many = places[start : start + 4096], n[start : start + 4096]
                j = np.repeat(low[start : start + 4096] - np.cumsum(many) + many, many) + np.arange(many.sum())
                pairs = np.unique(of[j].astype(np.int64) << 32 | (np.repeat(p, many) - at[j] + (1 << 30)))
                found.update(zip((pairs >> 32).tolist(), ((pairs & 0xFFFFFFFF) - (1 << 30)).tolist()))
        for k, t in self.small:  # items too short for a seed are looked for as they are
            found.update((k, int(p)) for p in np.flatnonzero(h == t[0]) if len(h) - p >= len(t) and (h[p : p + len(t)] == t).all())
        return found

    def __call__(self, text: str | None) -> list[tuple]:
        """item_id, its words, words matched, first and last word (exclusive) of the best overlap with each item."""
        h, best = self.hashes(words(text)), {}
        for k, d in sorted(self.diagonals(h)):
            t = self.tests[k][1]
            x, y = max(0, d), min(len(h), d + len(t))
            start, end, n = segment(h[x:y] == t[x - d : y - d])
            if n >= min(self.least, self.share * len(t)):
                best[k] = max(best.get(k, (0,)), (n, x + start, x + end, len(t)))
        return [(self.tests[k][0], v[3], v[0], v[1], v[2]) for k, v in best.items()]


def finder(shared):
    def run(batches: Iterator) -> Iterator:
        overlaps = Overlaps(shared.value)
        for b in batches:
            out = [(doc_id, *hit) for doc_id, text in zip(b["doc_id"], b["text"]) for hit in overlaps(text)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "item_words", "matched", "start_word", "end_word"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, item_words, matched, start_word, end_word: the best overlap of each document and item.

    Words are runs of letters, digits and underscores, in lower case. Defined results: a null or empty text or item
    matches nothing; an empty table gives no rows; repeated rows and rows without id are each looked at; items
    under seven words must occur whole; further columns are ignored."""
    schema = "doc_id long, item_id long, item_words int, matched int, start_word int, end_word int"
    d, out = docs.select("doc_id", "text"), None
    for block in blocks(benchmark, block_words):
        found = d.mapInPandas(finder(block), schema)
        out = found if out is None else out.union(found)
    return out


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> list:
    """The items as broadcasts of block_words words at most (or one item); at least one, maybe empty."""
    context, out, block, n = benchmark.sparkSession.sparkContext, [], [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():  # a partition at a time
        n += (size := len(words(r.text)))
        if block and n > block_words:
            out.append(context.broadcast(block))
            block, n = [], size
        block.append((r.item_id, r.text))
    return [*out, context.broadcast(block)]


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text overlaps an item. Each row is judged by its own text, so null and repeated doc_ids
    are rows like others; null and empty texts stay; columns of any name are kept as they are."""
    out = docs
    for block in blocks(benchmark):
        out = out.filter(~hits(block)(out["text"]))
    return out


def hits(shared):
    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        overlaps = Overlaps(shared.value)
        for texts in batches:
            yield pd.Series([bool(overlaps(t)) for t in texts], dtype=bool)

    return run
