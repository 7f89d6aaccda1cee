"""Registered queries of telemetry views, samples and clusters, embeddings, ledgers and limits.

Events stand for telemetry: signup is ingestion, view retrieval, click generation, purchase billing, error an error."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import embedding as E
from skein.functions.vectors import cosine, norm
from skein.plans.catalogue import KNN, WORDS, hits, table

#: Ranks, document and library limits of tiers, documents of a pack and packs that count.
TIERS = {"free": (0, 10, 1), "starter": (1, 40, 3), "pro": (2, 1000, 10), "lifetime": (3, 1000, 10)}
PACK_DOCUMENTS, MOST_PACKS, PREVIEWS = 25, 3, 3
CATEGORIES = {"signup": "ingestion", "view": "retrieval", "click": "generation", "purchase": "billing", "error": "error"}


def events(spark, d):
    kind = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("value") > 90, "warning").otherwise("info")
    return table(spark, d, "events").withColumn("category", F.element_at(kind, F.col("event_type"))).withColumn("severity", severity)


def severity_filter(spark, d):
    return events(spark, d).groupBy("category", "severity").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


def telemetry_mirror(spark, d):
    """What goes to the log: some categories or more than information, with its details as sorted key=value pairs."""
    e = events(spark, d).filter(F.col("category").isin("retrieval", "billing", "error") | (F.col("severity") != "info"))
    pairs = F.from_json("props", "map<string,string>")
    said = F.array_join(F.array_sort(F.transform(F.map_entries(pairs), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), " ")
    return e.select("event_id", "category", said.alias("details"))


def log_filter(spark, d):
    level = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    kept = events(spark, d).filter((level <= 1) & ~F.col("category").isin("billing"))
    return kept.groupBy("user_id").agg(F.count("*").alias("n"))


def stage_active(spark, d):
    """Categories seen in each user's last 12 events within six hours of the last one."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = F.max("ts").over(Window.partitionBy("user_id"))
    e = events(spark, d).withColumn("n", F.row_number().over(w)).withColumn("last", last)
    near = F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) < 6 * 3600 * 10**6
    return e.filter((F.col("n") <= 12) & near).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("active"))


def last_k_events(spark, d):
    """The last three events of each user, the oldest of them first."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = events(spark, d).select("user_id", "event_id", F.row_number().over(w).alias("n")).filter("n <= 3")
    return e.select("user_id", "event_id", (4 - F.col("n")).cast("long").alias("place"))


def recent_queries(spark, d):
    """The first five generation events of each user, the last of them first."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(spark, d).filter("category = 'generation'").select("user_id", "event_id", F.row_number().over(w).alias("n")).filter("n <= 5")
    return e.select("user_id", "event_id", (6 - F.col("n")).cast("long").alias("place"))


def query_stats(spark, d):
    e = events(spark, d).groupBy(F.to_date("ts").cast("string").alias("day"))
    return e.agg(F.count_if(F.col("category") == "generation").alias("n_queries"), F.round(F.sum("value") / F.count("*"), 4).alias("mean"))


def latest_added(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.unix_micros(F.max("ts").cast("timestamp")).alias("latest"))


def top_charts(spark, d):
    """The eight most retrieved chunks, ties by the smaller id: a report of eight rows."""
    h = hits(spark, d, 10).groupBy("id").agg(F.count("*").alias("hits"), F.round(F.avg("similarity"), 6).alias("similarity"))
    return h.orderBy(F.desc("hits"), "id").limit(8)


def validation_summary(spark, d):
    ok = F.count_if(F.col("event_type") != "error")
    e = events(spark, d).groupBy("user_id").agg(ok.alias("passed"), (F.count("*") - ok).alias("failed"))
    return e.withColumn("status", F.when(F.col("failed") == 0, "passed").when(F.col("passed") == 0, "failed").otherwise("warning"))


def tokens_per_sec(spark, d):
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r]+", -1), lambda w: w != ""))
    seconds = (F.col("turn") % 4).cast("double")
    speed = F.when(seconds > 0, F.round(words / seconds, 6))
    return table(spark, d, "conversations").select("conv_id", "turn", speed.alias("speed"), F.when(seconds < 1, "device").otherwise("cloud").alias("location"))


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding", "label", norm(F.col("embedding")).alias("n"))


def cluster_stats(spark, d):
    """Size and mean similarity of all pairs of each label. The sum over pairs of unit vectors follows from their sum, so no
    pair is formed."""
    v = vectors(spark, d).filter("n > 0").select("label", "vec_id", "n", F.posexplode("embedding").alias("place", "x"))
    sums = v.groupBy("label", "place").agg(F.sum(F.col("x").cast("double") / F.col("n")).alias("s"))
    total = sums.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    size = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("lead"))
    mean = F.when(F.col("n") > 1, F.round((F.col("square") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6)).otherwise(F.lit(0.0))
    return size.join(total, "label").select("label", "n", "lead", mean.alias("similarity"))


def cluster_order(spark, d):
    """Labels by size, the larger first, then by their first vector."""
    size = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("lead"))
    return size.select("label", F.row_number().over(Window.orderBy(F.desc("n"), "lead")).cast("long").alias("place"))  # one row a label


def pair_sim_stats(spark, d):
    """Mean and maximum of the pairs of the report's sample of twelve vectors."""
    v = vectors(spark, d).orderBy("vec_id").limit(12)
    b = v.select(F.col("vec_id").alias("other"), F.col("embedding").alias("e2"), F.col("n").alias("n2"))
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("embedding"), F.col("n"), F.col("e2"), F.col("n2"))))
    return v.join(F.broadcast(b), F.col("vec_id") < F.col("other")).agg(F.round(F.avg(c), 6).alias("mean"), F.round(F.max(c), 6).alias("most"))


def sample_seeded(spark, d):
    """A hundred documents in the order of a seeded hash, shown by id: a sampling operator."""
    key = F.md5(F.concat(F.lit("11:"), F.col("doc_id").cast("string")).cast("binary"))
    return table(spark, d, "documents").select("doc_id", key.alias("k")).orderBy("k").limit(100).select("doc_id")


def embed_fallback(spark, d):
    e = E.embed(table(spark, d, "documents").select("doc_id", "text"))
    at = lambda i: F.round(F.get("embedding", F.lit(i)), 6).alias(f"v{i}")
    return e.select("doc_id", "error", at(0), at(5), at(256), at(261), at(266))


def validate_embedding(spark, d):
    v = table(spark, d, "embeddings")
    odd = F.when(F.col("vec_id") % 50 == 1, F.slice("embedding", 1, 3)).when(F.col("vec_id") % 50 == 2, F.transform("embedding", lambda x: x * 0))
    return v.select("vec_id", E.problem(F.coalesce(odd, F.col("embedding")), 64).alias("problem"))


def entitlements(spark, d):
    """Each user's tier is the best that any purchase gave; documents allowed are the tier's and those of three packs."""
    bought = F.col("event_type") == "purchase"
    rank = F.when(F.col("value") > 95, 3).when(F.col("value") > 80, 2).when(F.col("value") > 50, 1).otherwise(0)
    u = table(spark, d, "events").groupBy("user_id").agg(F.coalesce(F.max(F.when(bought, rank)), F.lit(0)).alias("rank"), F.count_if(bought & (F.col("value") <= 50)).alias("packs"))
    of = lambda i: F.coalesce(*[F.when(F.col("rank") == r[0], F.lit(r[i])) for r in TIERS.values()])
    name = F.coalesce(*[F.when(F.col("rank") == r[0], F.lit(n)) for n, r in TIERS.items()])
    limit = (of(1) + F.least("packs", F.lit(MOST_PACKS)) * PACK_DOCUMENTS).cast("long")
    return u.select("user_id", name.alias("tier"), "packs", limit.alias("documents"), of(2).cast("long").alias("libraries"), (F.col("rank") >= 2).alias("is_at_least_pro"))


def preview_ledger(spark, d):
    """Runs of a free user's allowance before and after each click, and the access they give."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    used = table(spark, d, "events").filter("event_type = 'click'").withColumn("n", F.count("*").over(w))
    left = F.greatest(F.lit(0), F.lit(PREVIEWS) - F.col("n")).cast("long")
    access = F.when(F.col("n") <= PREVIEWS, F.concat(F.lit("preview("), left.cast("string"), F.lit(")"))).otherwise("blocked")
    return used.select("user_id", "event_id", left.alias("left"), access.alias("access"))


def pack_ledger(spark, d):
    """Credits of the purchases that are not expired ten days before the last event, each transaction once."""
    e = table(spark, d, "events").filter("event_type = 'purchase'").dropDuplicates(["event_id"])
    last = table(spark, d, "events").agg(F.max("ts").alias("last"))
    live = F.unix_micros(F.col("ts").cast("timestamp")) > F.unix_micros(F.col("last").cast("timestamp")) - 10 * 86400 * 10**6
    return e.join(F.broadcast(last), F.lit(True)).groupBy("user_id").agg(F.count("*").alias("packs"), F.count_if(live).alias("active"), F.sum(F.when(live, PACK_DOCUMENTS).otherwise(0)).alias("credits"))


def fallback_order(spark, d):
    """Backends in order, each once, without those excluded and the primary one."""
    order = F.array(*[F.lit(x) for x in ("device", "extract", "local", "device", "remote")])
    out = F.array_except(F.array_distinct(order), F.array(F.element_at(order, (F.col("conv_id") % 5 + 1).cast("int"))))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(out, ",").alias("order"))


def snapshot_diff(spark, d):
    """What each snapshot of a growing answer adds: the rest behind what it shares with the one before."""
    w = Window.partitionBy("doc_id").orderBy("size")
    t = F.coalesce("text", F.lit(""))
    s = table(spark, d, "documents").select("doc_id", t.alias("t"), F.explode(F.array(*[F.lit(x) for x in (40, 90, 200)])).alias("size"))
    s = s.withColumn("shown", F.substring("t", F.lit(1), F.col("size"))).withColumn("before", F.coalesce(F.lag("shown").over(w), F.lit("")))
    new = F.when(F.col("shown").startswith(F.col("before")), F.substr("shown", F.char_length("before") + 1)).otherwise(F.col("shown"))
    return s.select("doc_id", F.col("size").cast("long"), F.md5(new.cast("binary")).alias("delta_md5"))


def disk_check(spark, d):
    """Whether what is free holds the expected bytes and 50 MiB; an unknown size passes."""
    need = F.when(F.col("event_type") != "view", (F.col("value") * 1000000).cast("long"))
    free = F.lit(100 * 1000000 + 10000000)
    return table(spark, d, "events").select("event_id", (need.isNull() | (free >= need + 50 * 1048576)).alias("fits"), F.coalesce(F.round(F.try_divide(F.col("value"), F.lit(100)), 6), F.lit(0.0)).alias("progress"))


def dedup_registry(spark, d):
    """Models by path and backend, the last entry of each, and the first of each backend as the one selected."""
    w = Window.partitionBy("path", "backend").orderBy(F.desc("event_id"))
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 40).alias("path"), F.col("event_type").alias("backend"))
    kept = e.withColumn("n", F.row_number().over(w)).filter("n = 1")
    first = F.row_number().over(Window.partitionBy("backend").orderBy("path", "event_id")) == 1
    return kept.select("path", "backend", "event_id", first.alias("selected"))


def verify_sha256(spark, d):
    """Texts whose digest is that of their neighbour's id are copies of it."""
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    first = table(spark, d, "documents").groupBy(digest.alias("digest")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    return first.filter("n > 1")


CAT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORIES.items()) + " END"
EV = f"ev AS (SELECT *, {CAT} AS category, CASE WHEN event_type = 'error' THEN 'error' WHEN value > 90 THEN 'warning' ELSE 'info' END AS severity FROM events)"
RANK = "CASE WHEN value > 95 THEN 3 WHEN value > 80 THEN 2 WHEN value > 50 THEN 1 ELSE 0 END"
LOW = "lower(coalesce(text, ''))"
RAW = f"list_transform(range(512), lambda i: CASE WHEN i < 256 AND i < length({LOW}) THEN (unicode(substring({LOW}, i + 1, 1)) % 256) / 128.0::DOUBLE - 1 WHEN i = 256 THEN least(length({LOW}), 1000) / 1000.0::DOUBLE WHEN i = 261 THEN least(len({WORDS}), 100) / 100.0::DOUBLE WHEN i = 266 THEN CASE WHEN regexp_matches({LOW}, '\\p{{Nd}}') THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ELSE 0.0::DOUBLE END)"

QUERIES = {
    "severity_filter": (severity_filter, f"WITH {EV} SELECT category, severity, count(*) AS n, max(event_id) AS last_id FROM ev GROUP BY ALL"),
    "telemetry_mirror": (
        telemetry_mirror,
        f"""WITH {EV} SELECT event_id, category, array_to_string(list_sort(list_transform(json_keys(props), lambda k: k || '=' || json_extract_string(props, k))), ' ') AS details
FROM ev WHERE category IN ('retrieval', 'billing', 'error') OR severity <> 'info'""",
    ),
    "log_filter": (log_filter, f"WITH {EV} SELECT user_id, count(*) AS n FROM ev WHERE severity <> 'info' AND category <> 'billing' GROUP BY user_id"),
    "stage_active": (
        stage_active,
        f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, max(ts) OVER (PARTITION BY user_id) AS last FROM ev)
SELECT user_id, array_to_string(list_sort(list(DISTINCT category)), ',') AS active FROM r WHERE n <= 12 AND epoch_us(last) - epoch_us(ts) < 21600000000 GROUP BY user_id""",
    ),
    "last_k_events": (
        last_k_events,
        "SELECT user_id, event_id, 4 - n AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3",
    ),
    "recent_queries": (
        recent_queries,
        "SELECT user_id, event_id, 6 - n AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click') WHERE n <= 5",
    ),
    "query_stats": (query_stats, "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'click') AS n_queries, round(sum(value) / count(*), 4) AS mean FROM events GROUP BY 1"),
    "latest_added": (latest_added, "SELECT event_type, epoch_us(max(ts)) AS latest FROM events GROUP BY event_type"),
    "top_n_charts": (top_charts, f"WITH {KNN} SELECT vec_id AS id, count(*) AS hits, round(avg(similarity), 6) AS similarity FROM near WHERE rank <= 10 GROUP BY 1 ORDER BY hits DESC, id LIMIT 8"),
    "validation_summary": (
        validation_summary,
        """WITH s AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS passed, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id)
SELECT *, CASE WHEN failed = 0 THEN 'passed' WHEN passed = 0 THEN 'failed' ELSE 'warning' END AS status FROM s""",
    ),
    "tokens_per_sec": (
        tokens_per_sec,
        f"SELECT conv_id, turn, CASE WHEN turn % 4 > 0 THEN round(len({WORDS})::DOUBLE / (turn % 4), 6) END AS speed, CASE WHEN turn % 4 < 1 THEN 'device' ELSE 'cloud' END AS location FROM conversations",
    ),
    "cluster_stats": (
        cluster_stats,
        """WITH p AS (SELECT a.label, avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label)
SELECT label, n, lead, round(coalesce(s, 0), 6) AS similarity FROM (SELECT label, count(*) AS n, min(vec_id) AS lead FROM embeddings GROUP BY label) LEFT JOIN p USING (label)""",
    ),
    "cluster_order": (cluster_order, "SELECT label, row_number() OVER (ORDER BY count(*) DESC, min(vec_id)) AS place FROM embeddings GROUP BY label"),
    "pair_sim_stats": (
        pair_sim_stats,
        """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 12),
p AS (SELECT greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_cosine_similarity(a.e, b.e))) AS c FROM v a JOIN v b ON a.vec_id < b.vec_id) SELECT round(avg(c), 6) AS mean, round(max(c), 6) AS most FROM p""",
    ),
    "sample_seeded": (sample_seeded, "SELECT doc_id FROM documents ORDER BY md5('11:' || doc_id) LIMIT 100"),
    "embed_fallback": (
        embed_fallback,
        f"""WITH r AS (SELECT doc_id, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'empty_input' END AS error, {RAW} AS v FROM documents),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM r)
SELECT doc_id, error, """ + ", ".join(f"CASE WHEN error IS NULL THEN round(v[{i + 1}] / size, 6) END AS v{i}" for i in (0, 5, 256, 261, 266)) + " FROM n",
    ),
    "validate_embedding": (validate_embedding, "SELECT vec_id, CASE WHEN vec_id % 50 = 1 THEN 'dimension' WHEN vec_id % 50 = 2 THEN 'low_energy' END AS problem FROM embeddings"),
    "entitlement_fold": (
        entitlements,
        f"""WITH u AS (SELECT user_id, coalesce(max({RANK}) FILTER (event_type = 'purchase'), 0) AS rank, count(*) FILTER (event_type = 'purchase' AND value <= 50) AS packs FROM events GROUP BY user_id)
SELECT user_id, ['free', 'starter', 'pro', 'lifetime'][rank + 1] AS tier, packs, ([10, 40, 1000, 1000][rank + 1] + least(packs, 3) * 25)::BIGINT AS documents,
  [1, 3, 10, 10][rank + 1]::BIGINT AS libraries, rank >= 2 AS is_at_least_pro FROM u""",
    ),
    "preview_ledger": (
        preview_ledger,
        """WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click')
SELECT user_id, event_id, greatest(0, 3 - n) AS left, CASE WHEN n <= 3 THEN 'preview(' || (3 - n) || ')' ELSE 'blocked' END AS access FROM c""",
    ),
    "pack_ledger": (
        pack_ledger,
        """WITH m AS (SELECT max(ts) AS last FROM events), p AS (SELECT DISTINCT user_id, event_id, epoch_us(ts) > epoch_us(last) - 864000000000 AS live FROM events, m WHERE event_type = 'purchase')
SELECT user_id, count(*) AS packs, count(*) FILTER (live) AS active, (25 * count(*) FILTER (live))::BIGINT AS credits FROM p GROUP BY user_id""",
    ),
    "fallback_order": (
        fallback_order,
        """SELECT conv_id, turn, array_to_string(list_filter(['device', 'extract', 'local', 'remote'], lambda x: x <> ['device', 'extract', 'local', 'device', 'remote'][conv_id % 5 + 1]), ',') AS "order"
FROM conversations""",
    ),
    "snapshot_diff": (
        snapshot_diff,
        """WITH s AS (SELECT doc_id, coalesce(text, '') AS t, unnest([40, 90, 200]) AS size, unnest([0, 40, 90]) AS prev FROM documents)
SELECT doc_id, size::BIGINT AS size, md5(substring(substring(t, 1, size), length(substring(t, 1, prev)) + 1)) AS delta_md5 FROM s""",
    ),
    "disk_check": (
        disk_check,
        """SELECT event_id, event_type = 'view' OR value IS NULL OR 110000000 >= trunc(value * 1000000)::BIGINT + 52428800 AS fits, coalesce(round(value / 100, 6), 0) AS progress FROM events""",
    ),
    "dedup_upsert_registry": (
        dedup_registry,
        """WITH k AS (SELECT user_id % 40 AS path, event_type AS backend, max(event_id) AS event_id FROM events GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY backend ORDER BY path, event_id) = 1 AS selected FROM k""",
    ),
    "verify_sha256": (verify_sha256, "SELECT sha256(coalesce(text, '')) AS digest, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1"),
}
