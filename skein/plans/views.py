"""Registered queries of seeded samples, tagged values and replies in JSON, live metrics, quotas and message clean-up."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from skein.functions.mixing import GOLDEN, container_seed, shuffled_key
from skein.plans.catalogue import KNN, found_texts, hits, table
from skein.plans.flows import ENTITLEMENT_SQL, entitlement_states
from skein.plans.ledger import EV
from skein.plans.ledger import events as told
from skein.streaming.stateful import PACK_DOCUMENTS

#: Of the sampling queries: rows a container and in all.
SAMPLE, EACH_LEAST, ALL = 200, 1, 60
#: The frame of the live metrics before the last event; the view's own is ten seconds.
FRAME_SECONDS = 86400


def seed_of(source: Column) -> Column:
    """A container's seed out of the UUID that its name's digest spells."""
    return container_seed(F.md5(F.coalesce(source, F.lit("")).cast("binary")))


def container_seeds(spark, d):
    return table(spark, d, "documents").select("source").distinct().select("source", seed_of(F.col("source")).alias("seed"))


def sample_shuffled(spark, d):
    """SAMPLE rows of all documents in the seeded order, shown by id: a sampling operator."""
    key = shuffled_key(F.lit(11).cast("long"), F.col("doc_id"))
    return table(spark, d, "documents").select("doc_id", key.alias("key")).orderBy("key").limit(SAMPLE)


def sample_quota(spark, d):
    """max(1, ALL / containers) rows of each container in its own seeded order, then ALL at most: a sampling operator."""
    docs = table(spark, d, "documents").select("source", "doc_id", shuffled_key(seed_of(F.col("source")), F.col("doc_id")).alias("key"))
    n = table(spark, d, "documents").agg(F.countDistinct("source").alias("n"))
    quota = n.select(F.greatest(F.lit(EACH_LEAST), F.floor(F.lit(ALL) / F.greatest("n", F.lit(1)))).alias("quota"))
    ranked = docs.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("key")))
    kept = ranked.filter(F.col("place") <= ALL).join(F.broadcast(quota), F.lit(True)).filter(F.col("place") <= F.col("quota"))  # one row
    return kept.orderBy("key").limit(ALL).select("source", "doc_id", F.col("place").cast("long"))


def encoded(tag: Column, kind: Column, id_: Column) -> Column:
    """A tagged value as JSON: tag, type where it has one, id where it has one."""
    return F.to_json(F.struct(tag.alias("tag"), kind.alias("type"), id_.alias("id")))


def decoded(text: Column) -> Column:
    """tag, kind, id, problem of a tagged value in JSON, by schema on read: what is broken or of an unknown tag has a problem."""
    v = F.try_parse_json(text)
    tag = F.try_variant_get(v, "$.tag", "string")
    kind, id_ = F.try_variant_get(v, "$.type", "string"), F.try_variant_get(v, "$.id", "string")
    needs = F.when(tag.isin("signup", "view"), kind.isNotNull()).when(tag.isin("click", "purchase", "error"), id_.isNotNull())
    problem = F.when(v.isNull(), "broken").when(tag.isNull(), "no tag").when(needs.isNull(), "unknown tag").when(~needs, "field missing")
    keep = lambda c: F.when(problem.isNull(), c)
    return F.struct(keep(tag).alias("tag"), keep(kind).alias("kind"), keep(id_).alias("id"), problem.alias("problem"))


def tagged_values(spark, d):
    """Events as tagged values; the text is cut short where k is under 5, and a field is missing where it is 5 to 9."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    typed = F.col("event_type").isin("signup", "view")
    whole = F.col("k") >= 10
    text = encoded(F.col("event_type"), F.when(typed & whole, "kind"), F.when(~typed & whole, F.col("user_id").cast("string")))
    text = F.when(F.col("k") < 5, F.substr(text, F.lit(1), F.char_length(text) - 3)).otherwise(text)
    return e.select("event_id", decoded(text).alias("x")).select("event_id", "x.*")


def reply_text(text: Column) -> Column:
    """text, form, tokens of a model's reply in JSON: choices[0].delta.content, .message.content or .text, content, or
    output_text with usage.output_tokens; the first of these that it has. Broken JSON has no form."""
    v = F.try_parse_json(text)
    paths = {"delta": "$.choices[0].delta.content", "message": "$.choices[0].message.content", "text": "$.choices[0].text", "content": "$.content", "output": "$.output_text"}
    found = [F.when(F.try_variant_get(v, p, "string").isNotNull(), F.struct(F.try_variant_get(v, p, "string").alias("text"), F.lit(n).alias("form"))) for n, p in paths.items()]
    said = F.coalesce(*found)
    return F.struct(said["text"].alias("text"), said["form"].alias("form"), F.try_variant_get(v, "$.usage.output_tokens", "bigint").alias("tokens"))


def llm_json(spark, d):
    """Each message wrapped in one of the reply forms by its turn, every seventh without its last sign, and read again."""
    t, turn = F.coalesce("text", F.lit("")), F.col("turn")
    one = lambda c: F.struct(F.array(c).alias("choices"))
    content = F.struct(t.alias("content"))
    forms = [one(F.struct(content.alias("delta"))), one(F.struct(content.alias("message"))), one(F.struct(t.alias("text"))), content, F.struct(t.alias("output_text"), F.struct(F.char_length(t).alias("output_tokens")).alias("usage"))]
    text = F.coalesce(*[F.when(turn % 5 == i, F.to_json(f)) for i, f in enumerate(forms)])
    text = F.when((F.col("conv_id") + turn) % 7 == 0, F.substr(text, F.lit(1), F.char_length(text) - 1)).otherwise(text)
    r = table(spark, d, "conversations").select("conv_id", "turn", reply_text(text).alias("r"))
    return r.select("conv_id", "turn", "r.form", "r.tokens", F.md5(F.col("r.text").cast("binary")).alias("text_md5"))


def live_metrics(spark, d):
    """The frame before the last event, one column a kind: the whole part of its last value, 0 without one."""
    e = told(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    last = e.agg(F.max("us").alias("last"))
    kinds = ["ingestion", "retrieval", "generation", "billing", "error"]
    of = lambda k: F.coalesce(F.max_by(F.when(F.col("category") == k, F.floor("value")), F.when(F.col("category") == k, F.struct("us", "event_id"))), F.lit(0)).alias(k)
    framed = e.join(F.broadcast(last), F.col("us") > F.col("last") - FRAME_SECONDS * 10**6)  # one row
    return framed.agg(F.count("*").alias("n_events"), *[of(k) for k in kinds])


def severity_rows(spark, d):
    """The events of a severity and more, the newest of each category first."""
    w = Window.partitionBy("category").orderBy(F.desc("ts"), F.desc("event_id"))
    e = told(spark, d).filter(F.col("severity") != "info")
    return e.select("event_id", "category", "severity", F.row_number().over(w).cast("long").alias("place"))


def quota_limits(spark, d):
    """Documents a user has (views) against what the last state of the user's tier and packs allows."""
    last = entitlement_states(spark, d).groupBy("user_id").agg(F.max_by("documents", "id").alias("documents"))
    n = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("n"))
    limit = F.coalesce("documents", F.lit(10).cast("long"))
    return n.join(last, "user_id", "left").select("user_id", "n", limit.alias("documents"), (F.col("n") < limit).alias("can_add"), F.greatest(F.lit(0), limit - F.col("n")).alias("room"))


def cleaned(text: Column, first: Column) -> Column:
    """A streamed piece without control characters; a reply's first piece without a leading null and dash."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.when(first, F.regexp_replace(bare, r"(?i)^\s*(null|\(null\))\s*[-–—]\s*", "")).otherwise(bare)


def sanitize_stream(spark, d):
    """Messages as pieces, the first of each conversation behind a null and a dash."""
    first = F.col("turn") == 0
    text = F.when(first, F.concat(F.lit(" (NULL) — "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(cleaned(text, first).cast("binary")).alias("clean_md5"))


def chunk_hit_report(spark, d):
    """Each chunk that questions retrieved: hits, mean similarity, last question, container and the start of its text, in the
    report's order. Hits are counted on rows without texts; then each chunk's text comes once."""
    h = hits(spark, d, 10, content=False).groupBy("id").agg(F.count("*").alias("hits"), F.round(F.avg("similarity"), 6).alias("similarity"), F.max("query_id").alias("last"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("t"), "source")
    place = F.row_number().over(Window.orderBy(F.desc("hits"), F.desc("last"), "id"))  # a report of what was hit
    line = F.trim("t", F.lit(" \n\t\r"))
    snippet = F.when(F.char_length(line) > SNIPPET, F.concat(F.substring(line, 1, SNIPPET), F.lit("…"))).otherwise(line)
    out = found_texts(h.withColumn("place", place), docs, 10 * table(spark, d, "benchmark").count())
    return out.select("place", "id", "hits", "similarity", "last", F.coalesce("source", F.lit("Unknown")).alias("name"), F.coalesce(snippet, F.lit("")).alias("snippet"))


def retrieval_totals(spark, d):
    """Retrieved chunks of the questions by container, each container as the filter, and the one without a filter."""
    h = hits(spark, d, 10, content=False).select("query_id", F.coalesce("source", F.lit("Unknown")).alias("container"))
    each = h.groupBy("container").agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_chunks"))
    every = h.agg(F.lit("all").alias("container"), F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_chunks"))
    return each.unionByName(every)


def download_validate(spark, d):
    """Pages as downloads: under 1024 bytes and a digest that is not the listed one (that of the trimmed page) fail; the file's
    name is the last part of the address, its host, or the id."""
    body = F.coalesce("html", F.lit(""))
    listed = F.sha2(F.trim(body, F.lit(" \n\t\r")).cast("binary"), 256)
    problem = F.when(F.octet_length(body) < LEAST_BYTES, "too small").when(F.sha2(body.cast("binary"), 256) != listed, "checksum mismatch")
    bare = F.regexp_replace(F.coalesce("url", F.lit("")), "[?#].*$", "")
    part = lambda p: F.nullif(F.regexp_extract(bare, p, 1), F.lit(""))
    name = F.coalesce(part("^[a-z]+://[^/]+/(?:.*/)?([^/]+)$"), part("^[a-z]+://([^/]+)"), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", name.alias("name"), F.octet_length(body).cast("long").alias("n_bytes"), problem.alias("problem"))


def legacy_packs(spark, d):
    """Users' old counts of packs (purchases of 50 and less) as rows of the ledger, three at most."""
    n = F.count_if((F.col("event_type") == "purchase") & (F.col("value") <= 50))
    old = table(spark, d, "events").groupBy("user_id").agg(n.alias("n")).filter("n > 0")
    return old.select("user_id", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(3)).cast("long"))).alias("pack"), F.lit(PACK_DOCUMENTS).cast("long").alias("credits"))


#: Characters of a snippet, least bytes of a download.
SNIPPET, LEAST_BYTES = 180, 1024
WRAP = "18446744073709551616::UHUGEINT"


def mixed(state: str) -> str:
    """SplitMix64 of an unsigned state in 128-bit arithmetic."""
    step = lambda z, by, c: f"((xor({z}, {z} >> {by}) * {c}::UHUGEINT) % {WRAP})"
    return f"(SELECT xor(z3, z3 >> 31) FROM (SELECT {step('z2', 27, 0x94D049BB133111EB)} AS z3 FROM (SELECT {step('z1', 30, 0xBF58476D1CE4E5B9)} AS z2 FROM (SELECT ({state} + {GOLDEN}::UHUGEINT) % {WRAP} AS z1))))"


KEY = "upper(lpad(to_hex(({0})::UHUGEINT), 16, '0'))"
SEED = "(xor(('0x' || md5(coalesce(source, ''))[1:16])::UBIGINT, ('0x' || md5(coalesce(source, ''))[17:32])::UBIGINT))::UHUGEINT"
STATE = f"({{0}} + (doc_id::UHUGEINT * {GOLDEN}::UHUGEINT) % {WRAP}) % {WRAP}"

CAND = f"{KNN}, cand AS (SELECT query_id, vec_id AS id, near.similarity, d.text, d.source FROM near LEFT JOIN documents d ON d.doc_id = near.vec_id WHERE rank <= 10)"
BODY = "coalesce(html, '')"
BARE_URL = "regexp_replace(coalesce(url, ''), '[?#].*$', '')"

QUERIES = {
    "chunk_hit_report": (
        chunk_hit_report,
        f"""WITH {CAND}, h AS (SELECT id, count(*) AS hits, round(avg(similarity), 6) AS similarity, max(query_id) AS last, any_value(source) AS source, any_value(trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13))) AS t FROM cand GROUP BY id)
SELECT row_number() OVER (ORDER BY hits DESC, last DESC, id)::INT AS place, id, hits, similarity, last, coalesce(source, 'Unknown') AS name,
  CASE WHEN length(t) > {SNIPPET} THEN t[:{SNIPPET}] || '…' ELSE coalesce(t, '') END AS snippet FROM h""",
    ),
    "retrieval_totals": (
        retrieval_totals,
        f"""WITH {CAND}, h AS (SELECT query_id, coalesce(source, 'Unknown') AS container FROM cand)
SELECT container, count(DISTINCT query_id) AS n_queries, count(*) AS n_chunks FROM h GROUP BY container UNION ALL SELECT 'all', count(DISTINCT query_id), count(*) FROM h""",
    ),
    "download_validate": (
        download_validate,
        f"""SELECT page_id, coalesce(nullif(regexp_extract({BARE_URL}, '^[a-z]+://[^/]+/(?:.*/)?([^/]+)$', 1), ''), nullif(regexp_extract({BARE_URL}, '^[a-z]+://([^/]+)', 1), ''), page_id::VARCHAR) AS name,
  octet_length(encode({BODY}))::BIGINT AS n_bytes, CASE WHEN octet_length(encode({BODY})) < {LEAST_BYTES} THEN 'too small'
  WHEN sha256({BODY}) <> sha256(trim({BODY}, ' ' || chr(10) || chr(9) || chr(13))) THEN 'checksum mismatch' END AS problem FROM pages""",
    ),
    "legacy_migration": (
        legacy_packs,
        """WITH n AS (SELECT user_id, count(*) FILTER (event_type = 'purchase' AND value <= 50) AS n FROM events GROUP BY user_id)
SELECT user_id, unnest(range(1, least(n, 3) + 1)) AS pack, 25::BIGINT AS credits FROM n WHERE n > 0""",
    ),
    "container_seed": (
        container_seeds,
        f"SELECT source, CASE WHEN s > 9223372036854775807::UHUGEINT THEN (s::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE s::BIGINT END AS seed FROM (SELECT source, {SEED} AS s FROM documents GROUP BY source)",
    ),
    "sample_shuffled": (
        sample_shuffled,
        f"WITH s AS MATERIALIZED (SELECT doc_id, {STATE.format('11::UHUGEINT')} AS state FROM documents) SELECT doc_id, {KEY.format(mixed('state'))} AS key FROM s ORDER BY key LIMIT {SAMPLE}",
    ),
    "sample_quota": (
        sample_quota,
        f"""WITH s AS MATERIALIZED (SELECT source, doc_id, {STATE.format(SEED)} AS state FROM documents), k AS (SELECT source, doc_id, {KEY.format(mixed('state'))} AS key FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key) AS place FROM k), q AS (SELECT greatest({EACH_LEAST}, {ALL} // greatest(count(DISTINCT source), 1)) AS quota FROM documents)
SELECT source, doc_id, place FROM r, q WHERE place <= quota ORDER BY key LIMIT {ALL}""",
    ),
    "tagged_union_codec": (
        tagged_values,
        """WITH e AS (SELECT event_id, user_id, event_type AS t, json_extract_string(props, '$.k')::INT AS k, event_type IN ('signup', 'view') AS typed FROM events)
SELECT event_id, CASE WHEN k >= 10 THEN t END AS tag, CASE WHEN k >= 10 AND typed THEN 'kind' END AS kind, CASE WHEN k >= 10 AND NOT typed THEN user_id::VARCHAR END AS id,
  CASE WHEN k < 5 THEN 'broken' WHEN k < 10 THEN 'field missing' END AS problem FROM e""",
    ),
    "parse_llm_json": (
        llm_json,
        """WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t, (conv_id + turn) % 7 = 0 AS bad FROM conversations)
SELECT conv_id, turn, CASE WHEN NOT bad THEN ['delta', 'message', 'text', 'content', 'output'][turn % 5 + 1] END AS form, CASE WHEN NOT bad AND turn % 5 = 4 THEN length(t) END AS tokens,
  CASE WHEN NOT bad THEN md5(t) END AS text_md5 FROM c""",
    ),
    "live_metrics_frame": (
        live_metrics,
        f"WITH {EV}, f AS (SELECT *, epoch_us(ts) AS us FROM ev), g AS (SELECT * FROM f WHERE us > (SELECT max(us) FROM f) - {FRAME_SECONDS} * 1000000::BIGINT) SELECT count(*) AS n_events, "
        + ", ".join(f"coalesce(floor(max_by(value, (us, event_id)) FILTER (category = '{k}'))::BIGINT, 0) AS {k}" for k in ("ingestion", "retrieval", "generation", "billing", "error"))
        + " FROM g",
    ),
    "severity_rows": (
        severity_rows,
        f"WITH {EV} SELECT event_id, category, severity, row_number() OVER (PARTITION BY category ORDER BY ts DESC, event_id DESC) AS place FROM ev WHERE severity <> 'info'",
    ),
    "quota_limits": (
        quota_limits,
        f"""WITH s AS ({ENTITLEMENT_SQL}), l AS (SELECT user_id, max_by(documents, id) AS documents FROM s GROUP BY user_id),
n AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS n FROM events GROUP BY user_id)
SELECT user_id, n, coalesce(documents, 10) AS documents, n < coalesce(documents, 10) AS can_add, greatest(0, coalesce(documents, 10) - n) AS room FROM n LEFT JOIN l USING (user_id)""",
    ),
    "sanitize_stream": (
        sanitize_stream,
        r"SELECT conv_id, turn, md5(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS clean_md5 FROM conversations",
    ),
}
