"""Texts into chunks that end at sentences and overlap by words; positions count code points.

The cursor of a text is sequential (each chunk begins where the last one's overlap does), so a text is cut in one Arrow
batch function; texts are independent and nothing is shuffled."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a chunk, words of a text below which it stays whole, words of overlap.
TARGET, LEAST, OVERLAP = 400, 100, 75
#: How far a sentence end may be, the rest that is too short for a chunk, the most chunks of a text. Repetitive
#: texts reach the last one (their overlap is found early, so the cursor creeps); `most=None` has no such end.
SNAP, REST, MOST = 100, 10, 5000
#: Headings, tried on trimmed lines.
HEADINGS = (r"^[A-Z][A-Z\s]+:?\s*$", r"^\d+\.\s+[A-Z].*$", r"^[IVX]+\.\s+[A-Z].*$", r"^#{1,3}\s+.*$")
WORD, TOKEN, DIGIT = re.compile("[^ ]+"), re.compile(r"\w+"), re.compile(r"\d")


def sentence_end(text: str, near: int, within: int = SNAP) -> int | None:
    """The place after the sentence sign nearest to `near`, the earlier of two; None without one."""
    low, high = max(0, near - within), min(len(text), near + within)
    best = min((i for i in range(low, high) if text[i] in ".!?"), key=lambda i: (abs(i - near), i), default=None)
    return None if best is None else best + 1


def range_end(text: str, start: int, target: int = TARGET) -> int:
    """End of the chunk that begins at start: as long as its first words with one space each, moved to a sentence end."""
    spans = [m.end() - m.start() for m in islice(WORD.finditer(text, start), target)]
    if not spans:
        return start + 1
    end = min(start + sum(spans) + len(spans) - 1, len(text))
    return sentence_end(text, end) or end


def next_start(text: str, start: int, end: int, overlap: int = OVERLAP) -> int:
    """Where the next chunk begins: at the first place that holds the chunk's last words with single spaces, else its end."""
    words = [w for w in text[start:end].split(" ") if w]
    if len(words) > overlap:
        at = text.find(" ".join(words[-overlap:]) if overlap else "", start, end)
        if at >= 0 and overlap:
            return at
    return end


def spans(text: str, target: int = TARGET, least: int = LEAST, overlap: int = OVERLAP, most: int | None = MOST) -> list[tuple[int, int]]:
    """Start and end of each chunk of a text; a text of fewer than `least` words is one chunk."""
    if len(TOKEN.findall(text)) < least:
        return [(0, len(text))] if text else []
    out, at = [], 0
    while at < len(text) and (most is None or len(out) < most):
        if len(text) - at < REST:
            if TOKEN.search(text, at):
                out.append((at, len(text)))
            break
        end = range_end(text, at, target)
        if end <= at:
            break
        out.append((at, end))
        at = max(next_start(text, at, end, overlap), at + 1)
    return out


def sections(text: str) -> list[tuple[str, int, int]]:
    """Title, start and end of each heading line."""
    out, at = [], 0
    for line in text.split("\n"):
        title = line.strip(" \t\r")
        if any(re.search(h, title) for h in HEADINGS):
            out.append((title, at, at + len(line)))
        at += len(line) + 1
    return out


SCHEMA = (
    "doc_id long, chunk_index int, start_position int, end_position int, content string, word_count int, "
    "character_count int, truncated boolean, section_title string, distinct_words int, has_numeric boolean, has_list boolean, keywords array<string>"
)
#: Columns that need more than the cut itself.
FEATURES = ("section_title", "distinct_words", "has_numeric", "has_list", "keywords")
#: Keywords of a chunk.
KEYWORDS = 5


def counted(part: str, stop: frozenset, most: int = KEYWORDS) -> list[tuple[str, int]]:
    """The most frequent words of three or more letters that are not in stop, with their counts, ties by the word."""
    n = Counter(w for w in TOKEN.findall(part.lower()) if len(w) > 2 and w not in stop)
    return sorted(n.items(), key=lambda x: (-x[1], x[0]))[:most]


def keywords(part: str, stop: frozenset) -> list[str]:
    return [w for w, _ in counted(part, stop)]


def document_keywords(docs: DataFrame, stop: frozenset, most: int = KEYWORDS) -> DataFrame:
    """doc_id, term, n, rank of each row of docs (doc_id, text): its most frequent words. Words are counted inside the row, so
    nothing is shuffled."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            for at in range(0, len(b), 500):
                part = zip(b["doc_id"].iloc[at : at + 500], b["text"].iloc[at : at + 500])
                rows = [(i, w, n, r) for i, t in part for r, (w, n) in enumerate(counted(t or "", stop, most), 1)]
                yield pd.DataFrame(rows, columns=["doc_id", "term", "n", "rank"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, term string, n long, rank long")


def chunk_rows(doc_id, text: str, target: int, least: int, overlap: int, most: int | None, features: tuple[str, ...], stop: frozenset) -> Iterator[tuple]:
    cut = spans(text, target, least, overlap, most)
    single = len(cut) == 1 and cut[0] == (0, len(text)) and len(TOKEN.findall(text)) < least
    heads = sections(text) if "section_title" in features and cut and not single else []
    # what is left behind the last chunk: more than the rest that is dropped anyhow
    lost = bool(cut) and len(text) - cut[-1][1] >= REST
    for i, (a, b) in enumerate(cut):
        part = text[a:b]
        row = doc_id, i, a, b, part, len(TOKEN.findall(part)), b - a, lost
        made = {
            "section_title": lambda: next((t for t, x, y in heads if x <= a < y), None),
            "distinct_words": lambda: None if single else len({w for w in part.lower().split(" ") if w}),
            "has_numeric": lambda: DIGIT.search(part) is not None,
            "has_list": lambda: "•" in part or re.match(r"\d+\.", part) is not None if single else any(c in part for c in "•-*"),
            "keywords": lambda: keywords(part, stop),
        }
        yield *row, *(made[f]() for f in features)


def chunks(docs: DataFrame, target: int = TARGET, least: int = LEAST, overlap: int = OVERLAP, most: int | None = MOST, features: bool | Collection[str] = True, stop: frozenset = frozenset()) -> DataFrame:
    """The chunks of docs (doc_id, text), with their features, all or those named, if asked for (a batch
    function's columns can't be pruned).

    A null or empty text has none. Of a text with more than `most` chunks the rest is left out and `truncated` says so on each
    of its chunks; most=None covers every text. semantic_density is distinct words by words, 0.5 for a text that stays whole; keywords
    are the chunk's most frequent words but for those of stop."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    wanted = FEATURES if features is True else tuple(f for f in FEATURES if features and f in features)
    made = [n for n in names if n in wanted or n not in FEATURES]
    schema = ", ".join(c for c in SCHEMA.split(", ") if c.split()[0] in made)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            for at in range(0, len(b), 200):
                part = zip(b["doc_id"].iloc[at : at + 200], b["text"].iloc[at : at + 200])
                rows = [r for i, t in part for r in chunk_rows(i, t or "", target, least, overlap, most, wanted, stop)]
                yield pd.DataFrame(rows, columns=made)

    out = docs.select("doc_id", "text").mapInPandas(run, schema)
    if "distinct_words" not in wanted:
        return out
    ratio = F.round(F.col("distinct_words") / F.greatest(F.col("word_count"), F.lit(1)), 6)
    return out.withColumn("semantic_density", F.coalesce(ratio, F.lit(0.5)))


def chunk_coverage(docs: DataFrame, most: int | None = MOST, **sizes) -> DataFrame:
    """doc_id, n_chunks, n_chars, covered, truncated for each row of docs: code points up to the end of the last chunk, and
    whether `most` cut the text short."""
    per = chunks(docs, most=most, features=False, **sizes).groupBy("doc_id")
    per = per.agg(F.count("*").alias("n_chunks"), F.max("end_position").cast("long").alias("covered"), F.bool_or("truncated").alias("truncated"))
    size = docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
    out = size.join(per, "doc_id", "left").fillna({"n_chunks": 0, "covered": 0, "truncated": False})
    return out.select("doc_id", "n_chunks", "n_chars", "covered", "truncated")


def paragraphs(docs: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_index, content: paragraphs packed greedily to `target` words; a chunk begins with the last words of the
    one before."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                held, n = [], 0
                for words in ([w for w in p.split(" ") if w] for p in (text or "").split("\n")):
                    if held and len(held) + len(words) > target:
                        out.append((doc_id, n, " ".join(held)))
                        held, n = held[-overlap:], n + 1
                    held = held + words
                if held:
                    out.append((doc_id, n, " ".join(held)))
            yield pd.DataFrame(out, columns=["doc_id", "chunk_index", "content"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk_index int, content string")


def in_ranges(points: DataFrame, ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """points (key, position, ...) with the title of the first of their key's ranges (key, title, low, high) that holds the
    position (high exclusive). An equi join on the key, so each key's ranges meet only its own points."""
    r = ranges.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("low", "high", "title"))).alias("_r"))
    hit = F.filter("_r", lambda x: (x["low"] <= F.col("position")) & (F.col("position") < x["high"]))
    return points.join(r, key, "left").withColumn("title", F.get(hit, F.lit(0))["title"]).drop("_r")
