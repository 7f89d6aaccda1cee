"""Shared helpers of the training-data operators: shared-folder tables, hashing, row identity."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's own readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Runtime setting that deletes a query's shuffle files once the query has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a session in one process (master local)
    gets a temporary folder; any other uses a folder below the warehouse, and is refused if that is a machine's own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        path = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    if not path:
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        if path.startswith(("file:", "/")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return path.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back.

    This cuts lineage like checkpoint(), survives lost executors, and keeps column pruning for later reads. The shuffle
    files of the writing query are deleted when it has ended: the table stands for them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with clean_up(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    if (mine := _SCRATCH.get()) is not None:
        mine.append(path)
    return out


#: Writes that hold CLEAN_UP on, by session, and what it was before the first of them.
_HOLDING: dict[int, list] = {}
_LOCK = threading.Lock()


@contextmanager
def clean_up(spark: SparkSession) -> Iterator[None]:
    """CLEAN_UP is on inside; it goes back when the last of several threads has left."""
    key = id(spark._jsparkSession)
    with _LOCK:
        held = _HOLDING.setdefault(key, [0, spark.conf.get(CLEAN_UP, "false")])
        held[0] += 1
        spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        with _LOCK:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(CLEAN_UP, _HOLDING.pop(key)[1])


#: Tables written inside the innermost scratch() of this thread.
_SCRATCH: ContextVar[list | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """What this thread materializes inside is deleted at the end, but for the frames put in the list it gives. Other threads'
    tables are not touched."""
    made: list[str] = []
    kept: list = []
    token = _SCRATCH.set(made)
    try:
        yield kept
    finally:
        _SCRATCH.reset(token)
        stay = {getattr(df, "_skein_path", None) for df in kept}
        outer = _SCRATCH.get()
        for path in made:
            if path not in stay:
                delete(spark, path)
            elif outer is not None:
                outer.append(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in (mine := _SCRATCH.get() or []):
        mine.remove(path)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have; Spark takes names of other case for the same."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks, for F.col."""
    return "`" + name.replace("`", "``") + "`"


def as_row(df: DataFrame) -> Column:
    """All columns of df as one struct."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in df.columns])


def numbered(df: DataFrame, label: str, name: str) -> DataFrame:
    """df with a number for each row in the new column name, written: a later scan may split the rows elsewhere, the written
    number stays."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), label)


def discard(*frames: DataFrame) -> None:
    """Delete tables written by materialize() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_skein_path", None)
        if path:
            delete(df.sparkSession, path)


def text_of(docs: DataFrame, text: str = "text") -> Column:
    """The whole text, a null one as empty."""
    return F.coalesce(docs[text], F.lit(""))


def word_bytes(text: str | None) -> list[bytes]:
    """Words between the ASCII white space characters, with A-Z lower-cased; bytes.split() cuts at exactly these."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class WordHashes:
    """64-bit hashes of words, kept in a dictionary of bounded size."""

    def __init__(self, limit: int = 500_000):
        self.limit, self.known = limit, {}

    def __call__(self, words: list):
        import numpy as np
        from xxhash import xxh3_64_intdigest

        known = self.known
        if len(known) > self.limit:
            known.clear()
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxh3_64_intdigest(w)
            return np.array([known[w] for w in words], np.uint64)


class SlotTable:
    """64-bit keys to positions in numpy arrays, open addressing, at most half full. Key 0 stands for an empty slot and is
    taken for 1."""

    def __init__(self, bits: int = 12):
        import numpy as np

        self.bits, self.n = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)

    def _slots(self, keys):
        import numpy as np

        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys):
        """The value of each key, -1 where it is absent."""
        import numpy as np

        keys = np.maximum(keys, np.uint64(1))
        at = self._slots(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        todo = np.flatnonzero((held != keys) & (held != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (held != 0)]
        return out

    def add(self, keys, values):
        """Distinct absent keys with their values."""
        import numpy as np

        if 2 * (self.n + len(keys)) > 1 << self.bits:
            full = self.keys != 0
            old = self.keys[full], self.values[full]
            self.__init__(max(12, int(4 * (self.n + len(keys)) - 1).bit_length()))
            self.add(*old)
        self.n += len(keys)
        keys = np.maximum(keys, np.uint64(1))
        at, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            self.keys[at[free]] = keys[free]  # of several at one slot the last stays
            won = free[self.keys[at[free]] == keys[free]]
            self.values[at[won]] = values[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)


class RunHashes:
    """64-bit hashes of runs of a sequence, from prefix sums: symbols get random numbers, places powers of an odd base."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, symbols: int, seed: int = 11):
        import numpy as np

        self.numbers = np.random.default_rng(seed).integers(1, 2**63, symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = self.back = np.ones(1, np.uint64)

    def __call__(self, x, starts, ends):
        import numpy as np

        if len(self.power) < len(x) + 1:
            n = max(len(x) + 1, 1 << 20)
            step = lambda base: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])
            self.power, self.back = step(self.BASE), step(pow(self.BASE, -1, 1 << 64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.numbers[x] * self.power[: len(x)])])
        out = (total[ends] - total[starts]) * self.back[starts]
        out ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return out ^ out >> np.uint64(29)
