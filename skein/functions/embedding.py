"""Embeddings of texts without a model, means of word vectors, and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import word_count

#: Size of the fallback vector, and the places of length, words and digits in it.
DIMENSION, AT_LENGTH, AT_WORDS, AT_DIGITS = 512, 256, 261, 266
#: Sum of squares below which a vector is nearly zero.
LOW_ENERGY = 1e-4


def raw_fallback(text: Column, dim: int = DIMENSION) -> Column:
    """The first 256 code points of the lower-cased text, its length, its words and whether it has digits, not yet scaled."""
    low = F.lower(F.coalesce(text, F.lit("")))
    known = F.struct(
        F.substring(low, 1, 256).alias("head"),
        F.char_length(low).alias("n"),
        (F.least(word_count(text), F.lit(100)) / 100.0).alias("words"),
        F.when(low.rlike(r"\p{Nd}"), 1.0).otherwise(-1.0).alias("digits"),
    )

    def vector(x: Column) -> Column:
        def place(i: Column) -> Column:
            code = F.when((i < 256) & (i < x["n"]), F.pmod(code_point(F.substring(x["head"], i + 1, F.lit(1))), F.lit(256)) / 128.0 - 1.0)
            length = F.when(i == AT_LENGTH, F.least(x["n"], F.lit(1000)) / 1000.0)
            rest = F.when(i == AT_WORDS, x["words"]).when(i == AT_DIGITS, x["digits"]).otherwise(0.0)
            return F.coalesce(code, length, rest)

        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), place)

    # a transform of one element computes the text's features once, not for each place
    return F.get(F.transform(F.array(known), vector), F.lit(0))


def code_point(ch: Column) -> Column:
    return F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("int")


def scaled(vector: Column) -> Column:
    """The vector at length one; a zero vector stays."""

    def one(v: Column) -> Column:
        size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return F.get(F.transform(F.array(size), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))), F.lit(0))

    return F.get(F.transform(F.array(vector), one), F.lit(0))


def problem(vector: Column, dim: int) -> Column:
    """What is wrong with a vector: dimension, nan, infinite or low_energy (a warning); null if nothing is."""
    value = F.lit(float("inf"))
    energy = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return (
        F.when(vector.isNull() | (F.size(vector) != dim), "dimension")
        .when(F.exists(vector, lambda x: F.isnan(x)), "nan")
        .when(F.exists(vector, lambda x: F.abs(x.cast("double")) == value), "infinite")
        .when(energy < LOW_ENERGY, "low_energy")
    )


def word_average(docs: DataFrame, vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, embedding: the mean of the vectors (word, embedding) of a text's words, as written or else in lower case; texts
    without known words have none. Words are counted before the join, so a common word is one row for each text."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r]+", -1), lambda w: w != "")
    counted = docs.select(key, F.explode(words).alias("word")).groupBy(key, "word").agg(F.count("*").alias("times"))
    low = vectors.select(F.col("word").alias("low"), F.col("embedding").alias("low_embedding"))
    met = counted.join(vectors, "word", "left").join(low, F.lower("word") == F.col("low"), "left")
    met = met.select(key, "times", F.coalesce("embedding", "low_embedding").alias("e")).filter("e IS NOT NULL")
    parts = met.select(key, "times", F.posexplode("e").alias("place", "v")).groupBy(key, "place")
    means = parts.agg((F.sum(F.col("v").cast("double") * F.col("times")) / F.sum("times")).alias("v"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias("embedding"))


class Provider:
    """An embedding of texts: a name, a dimension and a Column. Others are registered beside the fallback."""

    def __init__(self, name: str, dimension: int, embed):
        self.name, self.dimension, self.embed = name, dimension, embed


PROVIDERS = {"fallback": Provider("fallback", DIMENSION, lambda text: scaled(raw_fallback(text)))}


def provider(name: str | None) -> Provider:
    """The provider of that name; the fallback for an unknown one."""
    return PROVIDERS.get(name or "", PROVIDERS["fallback"])


def embed(docs: DataFrame, name: str | None = None) -> DataFrame:
    """docs with embedding; rows whose trimmed text is empty get null and the error empty_input."""
    p, empty = provider(name), F.trim(F.coalesce("text", F.lit(""))) == ""
    return docs.withColumn("embedding", F.when(~empty, p.embed(F.col("text")))).withColumn("error", F.when(empty, "empty_input"))
