"""Registered queries over texts, messages and telemetry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.plans.catalogue import TOKENS, WORDS, table
from skein.sources.files import TYPES, detect_type

#: Phrases that open a new topic, headings, small talk, question forms.
TOPIC_PHRASES = ["However,", "Moreover,", "Furthermore,", "In contrast,", "On the other hand,", "Additionally,", "Nevertheless,", "Consequently,", "In conclusion,", "To summarize,"]
SMALL_TALK = ["hi", "hello", "hey", "yo", "sup", "ok", "thanks", "thank you", "bye", "goodbye", "hola", "hiya"]
QUESTIONS = [
    ("How do I ", "Instructions for "),
    ("How to ", "Procedure for "),
    ("What is ", "Information about "),
    ("What are ", "Details on "),
    ("When should ", "Timing for "),
    ("Why ", "Reason for "),
    ("Can I ", "Possibility of "),
    ("Where ", "Location of "),
]


def topic_boundaries(spark, d):
    t = F.coalesce("text", F.lit(""))
    n = sum(((F.char_length(t) - F.char_length(F.replace(t, F.lit(p), F.lit("")))) / len(p) for p in TOPIC_PHRASES), F.lit(0))
    return table(spark, d, "documents").select("doc_id", n.cast("long").alias("n_boundaries"))


def bm25_df(spark, d):
    return table(spark, d, "documents").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def chunk_density(spark, d):
    w = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\r]+", -1), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", F.round(F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)), 6).alias("density"))


def feature_rates(spark, d):
    t = F.col("text")
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    rates = [rate(T.has_number(t)).alias("numeric"), rate(T.has_list(t)).alias("lists"), rate(T.word_count(t)).alias("avg_words")]
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), *rates)


def audit_sha(spark, d):
    t = F.coalesce("text", F.lit(""))
    preview = F.md5(F.substring(t, 1, 160).cast("binary")).alias("preview_md5")
    sizes = [F.char_length(t).cast("long").alias("n_chars"), F.octet_length(t).cast("long").alias("n_bytes")]
    return table(spark, d, "documents").select("doc_id", preview, *sizes, F.sha2(t.cast("binary"), 256).alias("sha256"))


def filesize_label(spark, d):
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    of = lambda by, unit: F.concat(F.floor(n / by).cast("string"), F.lit(unit))
    size = F.when(n < 1024, of(1, " B")).when(n < 1048576, of(1024, " KB")).otherwise(of(1048576, " MB"))
    return table(spark, d, "documents").select("doc_id", size.alias("size"))


def sanitize(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "").cast("binary")).alias("clean_md5"))


def labelled_docs(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


def unlabelled_docs(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


def quota_check(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).select("source", "n", (F.col("n") < 40).alias("below_limit"))


def sample_stratified(spark, d):
    """Five documents a source in the order of a seeded hash: a sampling operator."""
    w = Window.partitionBy("source").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")).cast("binary")))
    return table(spark, d, "documents").withColumn("n", F.row_number().over(w)).filter("n <= 5").select("source", "doc_id")


def effective_topk(spark, d):
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " ", -1), lambda w: w != ""))
    talk = (words <= 2) & F.lower(F.trim(F.coalesce("text", F.lit("")))).isin(SMALL_TALK)
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(words <= 2, 3).otherwise(10).cast("long").alias("k"), talk.alias("small_talk"))


def file_types(spark, d):
    return table(spark, d, "pages").select("page_id", detect_type(F.col("url")).alias("type"))


def hub_links(spark, d):
    """Links made of each document's container, language, revision (every other one) and id."""
    revision = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(":v"), F.col("doc_id").cast("string"))).otherwise(F.lit(""))
    link = F.concat(F.lit("hf://"), "source", F.lit("/"), "lang", revision, F.lit("/dir/"), F.col("doc_id").cast("string"), F.lit(".bin"))
    part = lambda i: F.regexp_extract(link, r"^hf://([^/]+)/([^/:]+)(?::([^/]+))?/(.+)$", i)
    return table(spark, d, "documents").select("doc_id", part(1).alias("owner"), part(2).alias("repo"), part(3).alias("revision"), part(4).alias("path"))


def average_durations(spark, d):
    """Sums over all events, those without a duration included in the count."""
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum(F.coalesce("value", F.lit(0.0))) / F.count("*"), 4).alias("avg_duration"))


def live_metrics(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("latest"), F.max("event_id").alias("last_id"))


def activity_sessions(spark, d):
    """Bursts of a user's events: a gap of more than six hours starts a new one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    s = table(spark, d, "events").withColumn("new", F.coalesce(gap > 21600 * 10**6, F.lit(True)).cast("long"))
    return s.withColumn("session", F.sum("new").over(w)).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def day_dividers(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    day = F.to_date("ts")
    return table(spark, d, "events").withColumn("new", F.coalesce(day != F.lag(day).over(w), F.lit(True))).filter("new").groupBy("user_id").agg(F.count("*").alias("n_dividers"))


def daily_counts(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


def quoted(xs):
    return ", ".join("('" + x.replace("'", "''") + "')" for x in xs)


LOWER_WORDS = WORDS.replace("coalesce(text, '')", "lower(coalesce(text, ''))")
NAMED = " ".join(f"WHEN e IN ({', '.join(repr(x) for x in names)}) THEN '{kind}'" for kind, names in TYPES.items())
PARTS = ", ".join(f"regexp_extract(link, '^hf://([^/]+)/([^/:]+)(?::([^/]+))?/(.+)$', {i}) AS {n}" for i, n in enumerate(["owner", "repo", "revision", "path"], 1))

TOPICS_SQL = "(" + " + ".join(f"(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{p}', ''))) // {len(p)}" for p in TOPIC_PHRASES) + ")"

QUERIES = {
    "topic_boundaries": (topic_boundaries, "SELECT doc_id, (" + " + ".join(f"(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{p}', ''))) // {len(p)}" for p in TOPIC_PHRASES) + ")::BIGINT AS n_boundaries FROM documents"),
    "bm25_df": (bm25_df, f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS})) AS term FROM documents) GROUP BY term"),
    "chunk_density": (chunk_density, f"SELECT doc_id, round(len(list_distinct({LOWER_WORDS}))::DOUBLE / greatest(len({LOWER_WORDS}), 1), 6) AS density FROM documents"),
    "feature_rates": (feature_rates, f"SELECT source, count(*) AS n, round(avg(coalesce(regexp_matches(text, '[0-9]'), false)::INT), 6) AS numeric, "
        f"round(avg(coalesce(regexp_matches(text, '(^|\\n)[ ]*([-*]|[0-9]+\\.) '), false)::INT), 6) AS lists, round(avg(len({WORDS})), 6) AS avg_words FROM documents GROUP BY source"),
    "audit_sha": (audit_sha, "SELECT doc_id, md5(substring(coalesce(text, ''), 1, 160)) AS preview_md5, length(coalesce(text, '')) AS n_chars, strlen(coalesce(text, '')) AS n_bytes, sha256(coalesce(text, '')) AS sha256 FROM documents"),
    "filesize_label": (filesize_label, "SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN (n // 1024) || ' KB' ELSE (n // 1048576) || ' MB' END AS size FROM (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents)"),
    "sanitize": (sanitize, "SELECT conv_id, turn, md5(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS clean_md5 FROM conversations"),
    "labelled_docs": (labelled_docs, "SELECT source, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY source"),
    "unlabelled_docs": (unlabelled_docs, "SELECT source, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY source"),
    "quota_check": (quota_check, "SELECT source, count(*) AS n, count(*) < 40 AS below_limit FROM documents GROUP BY source"),
    "sample_stratified": (sample_stratified, "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id)) AS n FROM documents) WHERE n <= 5"),
    "effective_topk": (effective_topk, f"SELECT conv_id, turn, CASE WHEN n <= 2 THEN 3::BIGINT ELSE 10::BIGINT END AS k, "
        f"n <= 2 AND t IN ({', '.join(repr(x) for x in SMALL_TALK)}) AS small_talk FROM (SELECT *, lower(trim(coalesce(text, ''), ' ')) AS t, len(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '')) AS n FROM conversations)"),
    "average_durations": (average_durations, "SELECT event_type, round(sum(coalesce(value, 0)) / count(*), 4) AS avg_duration FROM events GROUP BY event_type"),
    "live_metrics": (live_metrics, "SELECT event_type, arg_max(value, (ts, event_id)) AS latest, max(event_id) AS last_id FROM events GROUP BY event_type"),
    "activity_sessions": (activity_sessions, "WITH g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000, true)::BIGINT AS new FROM events "
        "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, (sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM g) SELECT user_id, session, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY ALL"),
    "day_dividers": (day_dividers, "SELECT user_id, count(*) AS n_dividers FROM (SELECT user_id, coalesce(ts::DATE <> lag(ts::DATE) OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AS new FROM events) WHERE new GROUP BY user_id"),
    "daily_counts": (daily_counts, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "file_types": (file_types, f"SELECT page_id, CASE {NAMED} ELSE 'unknown' END AS type FROM (SELECT page_id, lower(regexp_extract(url, '\\.([^./]+)$', 1)) AS e FROM pages)"),
    "hub_links": (
        hub_links,
        f"SELECT doc_id, {PARTS} FROM (SELECT doc_id, 'hf://' || source || '/' || lang || CASE WHEN doc_id % 2 = 0 THEN ':v' || doc_id ELSE '' END || '/dir/' || doc_id || '.bin' AS link FROM documents)",
    ),
}
