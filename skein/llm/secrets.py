"""Secret spans: three fixed patterns, and a battery of randomness tests (DataFrame functions only).

Candidates are runs of 20 and more token characters. From its characters an encoding is inferred (hex, base 32, base 36,
base 64); under it, the battery asks two questions of each candidate.
* Could it be random? Chi-squared uniformity over the alphabet (Wilson-Hilferty normal form), the number of runs about the
  middle of the alphabet and the lag-one serial correlation give a tail probability each, and Fisher's method one for all
  three. Below RANDOM_P the candidate goes.
* Could text explain it? Two tail bounds under a text null for each encoding: the likelihood ratio of uniform letters
  against those of European text (the chance of a ratio of t is 1 / t at most), and the Chernoff bound of the
  runs of one class (lower case, upper case, digit, other) with TEXT_RATE changes. They are combined like Fisher's.
The second's result is the p-value. False discoveries are controlled by Benjamini-Hochberg within length strata, over all
documents, on a histogram of -log10(p), so no ranking of all candidates is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_row, materialize, quoted, table

#: kind, pattern, group whose length counts, least length; the order is that of kinds at one start
PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
TEXT_RATE, FALSE_RATE, RANDOM_P, STEP, MOST_BITS = 0.15, 0.002, 0.001, 0.25, 300
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Percent of each letter in text, about the mean of English, German, French and Spanish.
TEXT_LETTERS = dict(zip(LETTERS, (8.8, 1.4, 3.1, 4.1, 15.0, 1.3, 1.7, 2.9, 7.0, 0.4, 0.6, 4.5, 2.7, 7.8, 6.0, 2.2, 0.7, 6.6, 6.9, 6.7, 3.9, 1.2, 1.0, 0.3, 0.8, 0.6)))


def text_null(alphabet: str) -> list[float]:
    """Logs of uniform over text probability of each sign of the alphabet. Only which letter it is counts: how text mixes
    cases, digits and other signs is no evidence here, since names mix them in any share."""
    letters = {c.lower() for c in alphabet if c.isalpha()}
    every = sum(TEXT_LETTERS[c] for c in letters)
    return [math.log(every / len(letters) / TEXT_LETTERS[c.lower()]) if c.isalpha() else 0.0 for c in alphabet]


#: name, pattern of the whole token, whether it is lower-cased, alphabet
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", True, DIGITS + LETTERS[:6]),
    ("base32", "^[A-Z2-7]+$", False, LETTERS.upper() + "234567"),
    ("base36", "^([a-z0-9]+|[A-Z0-9]+)$", True, LETTERS + DIGITS),
    ("base64", "", False, LETTERS.upper() + LETTERS + DIGITS + "+/"),
)


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, end, token>> of the leftmost non-overlapping matches that are long enough.

    The gaps between matches come from split, the matches from regexp_extract_all; their lengths add up to code points."""
    pat = F.lit(pattern)
    whole = F.regexp_extract_all(text, pat, F.lit(0))
    part = F.regexp_extract_all(text, pat, F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    empty = F.array().cast("array<struct<start:int,end:int,token:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.char_length(x["all"])
        span = F.struct(start.alias("start"), end.alias("end"), x["part"].alias("token"))
        return F.when(x["all"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.when(F.char_length(x["part"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out")))

    rows = F.arrays_zip(gaps, whole, part)
    rows = F.transform(rows, lambda x: F.struct(x["0"].alias("gap"), x["1"].alias("all"), x["2"].alias("part")))
    return F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def of_encoding(bare: Column, value) -> Column:
    """value(encoding) of the first encoding whose pattern the token fits."""
    out = value(ENCODINGS[-1])
    for e in ENCODINGS[-2::-1]:
        out = F.when(bare.rlike(e[1]), value(e)).otherwise(out)
    return out


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def log_tail(z: Column) -> Column:
    """About the log of the two-sided tail of a normal deviate."""
    return -0.717 * F.abs(z) - 0.416 * z * z


def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def judged(token: Column) -> Column:
    """struct<random, bin, stratum>: whether the battery lets the token pass as random, and the evidence against text."""

    def encoded(bare: Column) -> Column:
        t = of_encoding(bare, lambda e: F.lower(bare) if e[2] else F.translate(bare, "-_", "+/"))
        which = of_encoding(bare, lambda e: F.lit(ENCODINGS.index(e)))
        return let(F.struct(bare.alias("bare"), t.alias("t"), which.alias("which"), F.greatest(F.char_length(t), F.lit(2)).alias("n")), spelt)

    def spelt(x: Column) -> Column:
        pick = lambda value: F.coalesce(*[F.when(x["which"] == i, value(e)) for i, e in enumerate(ENCODINGS)])
        chars = F.transform(F.sequence(F.lit(1), x["n"]), lambda i: F.substring(x["t"], i, F.lit(1)))
        kind = lambda c: F.when(c.between("a", "z"), 0).when(c.between("A", "Z"), 1).when(c.between("0", "9"), 2).otherwise(3)
        kinds = F.transform(F.sequence(F.lit(1), x["n"]), lambda i: kind(F.substring(x["bare"], i, F.lit(1))))
        places = F.transform(chars, lambda c: F.greatest(F.position(c, pick(lambda e: F.lit(e[3]))), F.lit(1)))
        ratios = pick(lambda e: F.array(*[F.lit(v) for v in text_null(e[3])]))
        return let(F.struct(x["n"].alias("n"), pick(lambda e: F.lit(float(len(e[3])))).alias("k"), places.alias("places"), kinds.alias("kinds"), ratios.alias("ratios")), counted)

    def counted(x: Column) -> Column:
        n, mean = x["n"], F.aggregate(x["places"], F.lit(0.0), lambda a, p: a + p) / x["n"]
        squares = F.aggregate(F.array_distinct(x["places"]), F.lit(0.0), lambda a, p: a + F.pow(F.size(F.filter(x["places"], lambda q: q == p)).cast("double"), F.lit(2.0)))
        ratio = F.greatest(F.lit(0.0), total(F.transform(x["places"], lambda p: F.element_at(x["ratios"], p))))
        changes = total(F.zip_with(F.slice(x["kinds"], 1, n - 1), F.slice(x["kinds"], 2, n - 1), lambda a, b: F.when(a != b, 1.0).otherwise(0.0)))
        middle = (x["k"] + 1) / 2
        high = total(F.transform(x["places"], lambda p: F.when(p > middle, 1.0).otherwise(0.0)))
        found = {"n": n, "k": x["k"], "places": x["places"], "mean": mean, "squares": squares, "ratio": ratio, "changes": changes, "high": high, "middle": middle}
        return let(F.struct(*[v.alias(name) for name, v in found.items()]), tested)

    def tested(x: Column) -> Column:
        n, df, mean, high = x["n"], x["k"] - 1, x["mean"], x["high"]
        head, tail = F.slice(x["places"], 1, n - 1), F.slice(x["places"], 2, n - 1)
        chi = x["k"] / n * x["squares"] - n
        chi_z = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - F.lit(2.0) / (df * 9))) / F.sqrt(F.lit(2.0) / (df * 9))
        var = total(F.transform(x["places"], lambda p: (p - mean) * (p - mean)))
        serial_z = total(F.zip_with(head, tail, lambda a, b: (a - mean) * (b - mean))) / F.greatest(var, F.lit(1e-9)) * F.sqrt(n.cast("double"))
        runs = 1 + total(F.zip_with(head, tail, lambda a, b: F.when((a > x["middle"]) != (b > x["middle"]), 1.0).otherwise(0.0)))
        expect = 2 * high * (n - high) / n + 1
        runs_z = (runs - expect) / F.sqrt(F.greatest((expect - 1) * (expect - 2) / (n - 1), F.lit(0.25)))
        f = F.least(F.lit(0.999), F.greatest(F.lit(TEXT_RATE), x["changes"] / (n - 1)))
        chernoff = (n - 1) * (f * F.log(f / TEXT_RATE) + (1 - f) * F.log((1 - f) / (1 - TEXT_RATE)))
        z = F.struct(F.greatest(chi_z, F.lit(0.0)).alias("chi"), serial_z.alias("serial"), runs_z.alias("runs"), (x["ratio"] + chernoff).alias("both"))
        return let(z, combined)

    def combined(z: Column) -> Column:
        def verdict(half: Column) -> Column:
            random = F.exp(-half) * (1 + half + half * half / 2) >= RANDOM_P  # Fisher's statistic is twice half, of six degrees
            bits = F.least(F.lit(float(MOST_BITS)), (z["both"] - F.log(1 + z["both"])) / math.log(10))
            m = F.char_length(token)
            stratum = F.when(m < 32, 0).when(m < 64, 1).otherwise(2)
            return F.struct(random.alias("random"), F.floor(bits / STEP).cast("int").alias("bin"), stratum.alias("stratum"))

        return let(-(log_tail(z["chi"]) + log_tail(z["serial"]) + log_tail(z["runs"])), verdict)

    return let(F.regexp_replace(token, "=+$", ""), encoded)


def as_kind(spans: Column, k: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))


def count_of(spans: str, k: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long")


def least_bins(found: DataFrame) -> dict[int, int]:
    """The least bin that is a discovery in each stratum, by Benjamini-Hochberg on the histogram of the candidates that may be random.

    What comes to the driver is bounded: 3 strata of MOST_BITS / STEP bins."""
    hist = found.select(F.explode("more").alias("c")).filter("c.judged.random").groupBy("c.judged.stratum", "c.judged.bin").count().collect()
    out = {}
    for s in {r["stratum"] for r in hist}:
        bins = sorted(((r["bin"], r["count"]) for r in hist if r["stratum"] == s), reverse=True)
        m, above = sum(n for _, n in bins), 0
        for b, n in bins:
            above += n
            if b > 0 and m * 10 ** (-b * STEP) <= FALSE_RATE * above:
                out[s] = b
    return out


def scan(docs: DataFrame) -> DataFrame:
    """row (struct of all columns of docs), base and spans (arrays of start, kind number, end).

    Defined results: a null or empty text has no spans; repeated rows each give theirs; names of columns can't clash,
    since docs' own are inside row; an empty table gives no rows."""
    text = F.coalesce(docs["text"], F.lit(""))
    kinds = [as_kind(matches(text, p, g, n), k) for k, (_, p, g, n) in enumerate(PATTERNS)]
    first = docs.select(as_row(docs).alias("row"), F.array_sort(F.concat(*kinds)).alias("base"), matches(text, CANDIDATE, 0, 20).alias("cand"))
    free = F.filter("cand", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    more = F.transform(free, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), judged(c["token"]).alias("judged")))
    found = materialize(first.select("row", "base", more.alias("more")), "secrets")
    least = least_bins(found)
    if least:
        limit = lambda s: F.coalesce(*[F.when(s == k, v) for k, v in least.items()], F.lit(1 << 30))
        taken = F.filter("more", lambda c: c["judged"]["random"] & (c["judged"]["bin"] >= limit(c["judged"]["stratum"])))
    else:
        taken = F.filter("more", lambda c: F.lit(False))
    extra = as_kind(taken, len(PATTERNS))
    return found.select("row", "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in PATTERNS], F.lit("random"))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = [count_of("base", k).alias(f"n_{name}") for k, (name, *_) in enumerate(PATTERNS)]
    return out.select(F.col("row.doc_id").alias("doc_id"), *n, F.sha2(named(F.col("base")).cast("binary"), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span in text replaced by mark (overlapping spans by one); a null text stays null."""
    out = scan(docs)
    text = F.col("row.text")
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        apart = F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when((x["start"] >= acc["at"]), apart).otherwise(acc["parts"]).alias("parts"))

    clean = F.aggregate("spans", first, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.char_length(text))))
    return out.select(*[F.when(F.size("spans") > 0, clean).otherwise(text).alias(c) if c == "text" else F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])
