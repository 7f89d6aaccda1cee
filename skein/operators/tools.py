"""Tools that a model can call, as table functions of SQL: list_documents, summarize_document and search_results read a table
given with TABLE(...), part by part, and give the lines of their report."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf

#: Characters of a preview in search results, and least similarity of a result.
PREVIEW, FLOOR = 600, 0.35


@udtf(returnType="container string, place int, line string")
class ListDocuments:
    """An entry for each document (container, name, pages, chunks, added) and one with their number, at place 0, for each
    container."""

    def __init__(self):
        self.n, self.container = 0, None

    def eval(self, row: Row) -> Iterator[tuple]:
        self.n, self.container = self.n + 1, row["container"]
        pages = f"   - Pages: {row['pages']}\n" if row["pages"] is not None else ""
        yield row["container"], self.n, f"{self.n}. {row['name']}\n{pages}   - Chunks: {row['chunks']}\n   - Added: {row['added']}\n"

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            yield self.container, 0, f"Available documents ({self.n}):\n"


@udtf(returnType="question long, place int, name string, line string")
class SearchResults:
    """The results of each question (question, rank, name, page, similarity, content) of at least FLOOR, in their order."""

    def __init__(self):
        self.n = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        if row["similarity"] is None or row["similarity"] < FLOOR:
            return
        self.n += 1
        text = (row["content"] or "").strip(" ")
        shown = text[:PREVIEW] + " [...]" * (len(text) > PREVIEW)
        page = f", p. {row['page']}" if row["page"] is not None else ""
        name = row["name"] or "Unknown"
        yield row["question"], self.n, name, f"[{self.n}] From {name}{page} (Relevance: {100 * row['similarity']:.1f}%):\n{shown}"


@udtf(returnType="asked string, document string, report string")
class SummarizeDocument:
    """The first document (asked, name, pages, chunks, added, type) whose name holds what was asked for, whatever the case."""

    def __init__(self):
        self.found, self.asked = None, None

    def eval(self, row: Row) -> None:
        self.asked = row["asked"]
        if self.found is None and (row["asked"] or "").lower() in (row["name"] or "").lower():
            pages = f"- Pages: {row['pages']}\n" if row["pages"] is not None else ""
            self.found = row["name"], f"Document: {row['name']}\n{pages}- Chunks: {row['chunks']}\n- Added: {row['added']}\n- File Type: {row['type']}"

    def terminate(self) -> Iterator[tuple]:
        if self.found:
            yield self.asked, *self.found
        elif self.asked is not None:
            yield self.asked, None, f"Document not found in selected library: {self.asked}"


#: Tool -> table function, the columns that part its rows, and their order.
TOOLS = {
    "list_documents": (ListDocuments, "container", "(name, added)"),
    "search_results": (SearchResults, "question", "(rank)"),
    "summarize_document": (SummarizeDocument, "asked", "(name)"),
}


class Toolbox:
    """The tools of a session, registered for SQL, with a count of the calls of each."""

    def __init__(self, spark: SparkSession):
        self.spark, self.calls = spark, Counter()
        for name, (function, _, _) in TOOLS.items():
            spark.udtf.register(name, function)

    def call(self, tool: str, rows: DataFrame) -> DataFrame:
        """The report over rows; each part is read row by row, so a part's size does not matter."""
        if tool not in TOOLS:
            raise KeyError(tool)
        self.calls[tool] += 1
        _, by, order = TOOLS[tool]
        return self.spark.sql(f"SELECT * FROM {tool}(TABLE({{rows}}) PARTITION BY {by} ORDER BY {order})", rows=rows)

    def counts(self) -> DataFrame:
        """tool, calls of every tool."""
        return self.spark.createDataFrame([(t, self.calls[t]) for t in sorted(TOOLS)], "tool string, calls long")
