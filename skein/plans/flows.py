"""Registered queries of order-dependent operators: result cache, reply streams, throttle, entitlements, consent.

Conventions of these tables: an event's `k` names the vector that its user asks for; purchases are writes to the user's
container. A purchase is a billing transaction, an error its revocation, a click one that failed; the value names the product
and (user, k) the transaction, so that deliveries repeat. For consent a click sends, a view decides, a signup opens a session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.operators import retrieval as R
from skein.plans.catalogue import table
from skein.streaming import stateful as S

DAY = 86400.0
#: Of the queries: the cache's time to live, the throttle's step, a pack's life, characters of a piece of a reply.
CACHE_SECONDS, EVERY, PACK_SECONDS, PIECE = 3 * DAY, DAY / 4, 7 * DAY, 37


def events(spark, d):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), seconds.alias("ts"), "event_type", "value", k.alias("n"))


def cache_rows(spark, d):
    """What each user's container is asked and when it is written to; the answers are the ten nearest vectors."""
    e = events(spark, d).filter("event_type <> 'signup'")
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = vectors.join(e.select(F.col("n").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    near = R.knn(vectors, asked, 10).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("near"))
    found = asked.join(near, "query_id").select(F.col("query_id").alias("n"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("near.vec_id").alias("results"))
    kind = F.when(F.col("event_type") == "purchase", "clear").otherwise("ask")
    k = F.when(F.col("event_type") == "click", 5).otherwise(10)
    return e.join(found, "n", "left").select("user_id", "ts", "id", kind.alias("kind"), "embedding", "results", k.alias("k"))


def result_cache(spark, d):
    out = S.as_table(cache_rows(spark, d), "user_id", S.QueryCache(seconds=CACHE_SECONDS))
    return out.select("user_id", "id", "hit", "entry", F.array_join("results", ",").alias("results"), F.col("entries").cast("long"))


def pieces(spark, d):
    """Each turn's text as a stream of events in one of three forms, cut into pieces of PIECE characters."""
    t, turn = F.coalesce("text", F.lit("")), F.col("turn") % 3
    frame = lambda c: F.concat(F.lit("data: "), c, F.lit("\n\n"))
    words = F.split(t, " ", -1)
    content = lambda c: F.struct(c.alias("content"))
    delta = F.transform(words, lambda w, i: frame(F.to_json(F.struct(F.array(F.struct(content(F.when(i > 0, F.concat(F.lit(" "), w)).otherwise(w)).alias("delta"))).alias("choices")))))
    upto = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / 20).cast("int"))
    whole = F.transform(upto, lambda i: frame(F.to_json(F.struct(F.array(F.struct(content(F.array_join(F.slice(words, F.lit(1), 20 * i + 20), " ")).alias("message"))).alias("choices")))))
    bare = F.transform(F.filter(F.split(t, r"[ \t\n\r\x0B\f]+", -1), lambda w: w != ""), frame)
    frames = F.when(turn == 0, delta).when(turn == 1, whole).otherwise(bare)
    stream = F.concat(F.lit(": open\r\n\r\n"), F.array_join(frames, ""), F.lit("data: [DONE]\n\n"))
    rows = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("reply"), stream.alias("s"))
    places = F.sequence(F.lit(0), F.floor((F.char_length("s") - 1) / PIECE).cast("int"))
    cut = rows.select("reply", "s", F.explode(places).alias("seq"))
    return cut.select("reply", F.col("seq").cast("long"), (F.col("seq") / 4.0).alias("ts"), F.substr("s", F.col("seq") * PIECE + 1, F.lit(PIECE)).alias("data"))


def reply_streams(spark, d):
    """What the parser puts together out of the pieces: one row a reply, its additions joined."""
    out = S.as_table(pieces(spark, d), "reply", S.ReplyStream())
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    last = out.groupBy("reply").agg(said.alias("text"), F.max("n_chars").alias("n_chars"), F.max("n_tokens").alias("n_tokens"), F.count_if("is_final").alias("n_final"))
    return last.select("reply", F.md5(F.col("text").cast("binary")).alias("text_md5"), "n_chars", "n_tokens", "n_final")


def throttle(spark, d):
    return S.as_table(events(spark, d).select("user_id", "ts", "id", "value"), "user_id", S.Throttle(EVERY))


def product(value: Column) -> Column:
    return F.when(value > 95, "lifetime").when(value > 80, "pro").when(value > 50, "starter").otherwise(S.PACK)


def billing(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "purchase").when(F.col("event_type") == "error", "revoke").otherwise("failed")
    e = events(spark, d).filter(F.col("event_type").isin("purchase", "error", "click"))
    expires = F.col("ts") + PACK_SECONDS
    return e.select("user_id", "ts", "id", kind.alias("kind"), product(F.col("value")).alias("product"), F.col("n").alias("transaction"), expires.alias("expires"))


def entitlement_states(spark, d):
    out = S.as_table(billing(spark, d), "user_id", S.Entitlements())
    return out.withColumn("packs", F.col("packs").cast("long"))


def consent_log(spark, d):
    kind = F.when(F.col("event_type") == "click", "send").when(F.col("event_type") == "view", "decide").otherwise("new_session")
    e = events(spark, d).filter(F.col("event_type").isin("click", "view", "signup"))
    said = F.element_at(F.array(*[F.lit(x) for x in ("once", "allow", "deny", "reset")]), (F.floor("value") % 4 + 1).cast("int"))
    return S.as_table(e.select("user_id", "ts", "id", kind.alias("kind"), said.alias("value")), "user_id", S.Consent())


def numbered(kinds: str) -> str:
    return f"""ev AS (SELECT user_id, event_id AS id, epoch_us(ts) / 1e6::DOUBLE AS ts, event_type AS e, value, json_extract_string(props, '$.k')::BIGINT AS k,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ({kinds}))"""


CACHE_SQL = f"""WITH RECURSIVE {numbered("'view', 'click', 'error', 'purchase'")},
v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS MATERIALIZED (SELECT q.vec_id AS k, v.vec_id AS o, list_cosine_similarity(v.e, q.e) AS c FROM v, v q WHERE q.vec_id IN (SELECT k FROM ev)),
near AS (SELECT k, list(o ORDER BY c6 DESC, o)[:10] AS res FROM (SELECT k, o, round(c, 6) AS c6 FROM pairs) GROUP BY k),
alike AS (SELECT k, list(o) FILTER (c > 0.95) AS same FROM pairs WHERE o IN (SELECT k FROM ev) GROUP BY k),
q AS MATERIALIZED (SELECT ev.*, res, same FROM ev LEFT JOIN near USING (k) LEFT JOIN alike USING (k)),
st AS (
  SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS id, 'x' AS e, []::STRUCT(id BIGINT, ts DOUBLE, k BIGINT, res BIGINT[])[] AS held, NULL::STRUCT(id BIGINT, ts DOUBLE, k BIGINT, res BIGINT[]) AS found, NULL::BIGINT[] AS res
  FROM (SELECT DISTINCT user_id FROM ev)
  UNION ALL
  SELECT user_id, n, id, e, CASE WHEN e = 'purchase' THEN [] WHEN found IS NULL AND res IS NOT NULL
      THEN list_append(list_filter(held, lambda h: ts - h.ts <= {CACHE_SECONDS}), {{'id': id, 'ts': ts, 'k': k, 'res': res}})[-20:] ELSE held END, found, res
  FROM (
    SELECT q.user_id, q.n, q.id, q.e, q.ts, q.k, q.res, st.held, CASE WHEN q.e <> 'purchase'
      THEN list_filter(st.held, lambda h: q.ts - h.ts <= {CACHE_SECONDS} AND list_contains(coalesce(q.same, []), h.k))[1] END AS found
    FROM st JOIN q ON q.user_id = st.user_id AND q.n = st.n + 1)
)
SELECT user_id, id, found IS NOT NULL AS hit, found.id AS entry, coalesce(array_to_string(coalesce(found.res, res)[:CASE WHEN e = 'click' THEN 5 ELSE 10 END], ','), '') AS results, len(held) AS entries
FROM st WHERE n > 0 AND e <> 'purchase'"""

REPLY_SQL = r"""WITH t AS (SELECT conv_id || ':' || turn AS reply, turn % 3 AS form, coalesce(text, '') AS t FROM conversations),
w AS (SELECT *, CASE WHEN form = 2 THEN list_filter(string_split_regex(t, '[ \t\n\r\x0B\f]+'), lambda w: w <> '') ELSE list_filter(string_split(t, ' '), lambda w: w <> '') END AS words FROM t),
s AS (SELECT reply, words, CASE WHEN form = 2 THEN array_to_string(words, '') ELSE t END AS said FROM w)
SELECT reply, md5(said) AS text_md5, length(said) AS n_chars, len(words) AS n_tokens, 1::BIGINT AS n_final FROM s"""

THROTTLE_SQL = f"""WITH RECURSIVE {numbered("'view', 'click', 'error', 'purchase', 'signup'")},
st AS (
  SELECT user_id, 0::BIGINT AS n, NULL::DOUBLE AS last, NULL::STRUCT(id BIGINT, v DOUBLE) AS wait, []::STRUCT(tm DOUBLE, id BIGINT, v DOUBLE, w BOOLEAN)[] AS gone FROM (SELECT DISTINCT user_id FROM ev)
  UNION ALL
  SELECT user_id, n, CASE WHEN ok THEN ts ELSE last1 END, CASE WHEN ok THEN wait1 ELSE {{'id': id, 'v': value}} END,
    list_concat(fired, CASE WHEN ok THEN [{{'tm': ts, 'id': id, 'v': value, 'w': false}}] ELSE [] END)
  FROM (
    SELECT *, last1 IS NULL OR ts >= last1 + {EVERY}::DOUBLE AS ok
    FROM (
      SELECT ev.user_id, ev.n, ev.ts, ev.id, ev.value, CASE WHEN fire THEN last + {EVERY}::DOUBLE ELSE last END AS last1, CASE WHEN NOT fire THEN wait END AS wait1,
        CASE WHEN fire THEN [{{'tm': last + {EVERY}::DOUBLE, 'id': wait.id, 'v': wait.v, 'w': true}}] ELSE [] END AS fired
      FROM (SELECT st.*, e2.ts >= last + {EVERY}::DOUBLE AND wait IS NOT NULL AS fire FROM st JOIN ev e2 ON e2.user_id = st.user_id AND e2.n = st.n + 1) s
      JOIN ev ON ev.user_id = s.user_id AND ev.n = s.n + 1))
), every AS (
  SELECT user_id, unnest(gone) AS g FROM st
  UNION ALL
  SELECT user_id, {{'tm': last + {EVERY}::DOUBLE, 'id': wait.id, 'v': wait.v, 'w': true}} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS r FROM st) WHERE r = 1 AND wait IS NOT NULL
)
SELECT user_id, g.tm AS "at", g.id AS id, g.v AS value, g.w AS waited FROM every"""

ENTITLEMENT_SQL = f"""WITH RECURSIVE {numbered("'purchase', 'error', 'click'")},
tx AS MATERIALIZED (SELECT *, CASE WHEN value > 95 THEN 3 WHEN value > 80 THEN 2 WHEN value > 50 THEN 1 END AS rank FROM ev),
st AS (
  SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS id, 0::BIGINT AS tier, []::STRUCT(t BIGINT, x DOUBLE)[] AS packs, []::BIGINT[] AS seen, []::BIGINT[] AS gone, '' AS status
  FROM (SELECT DISTINCT user_id FROM tx)
  UNION ALL
  SELECT user_id, n, id, CASE WHEN buy AND rank > tier THEN rank WHEN undo AND rank = tier THEN 0 ELSE tier END,
    CASE WHEN buy AND rank IS NULL AND len(packs) < 3 THEN list_append(packs, {{'t': k, 'x': ts + {PACK_SECONDS}::DOUBLE}})
      WHEN undo AND rank IS NULL THEN list_concat(packs[:spot - 1], packs[spot + 1:]) ELSE packs END,
    CASE WHEN buy THEN list_append(seen, k) ELSE seen END, CASE WHEN undo THEN list_append(gone, k) ELSE gone END,
    CASE WHEN buy AND rank > tier THEN 'upgraded' WHEN buy AND rank IS NULL THEN CASE WHEN len(packs) < 3 THEN 'pack' ELSE 'cap reached' END
      WHEN undo AND rank = tier THEN 'revoked' WHEN undo AND rank IS NULL AND len(packs) > 0 THEN 'pack removed' ELSE 'ignored' END
  FROM (
    SELECT *, e = 'purchase' AND NOT list_contains(seen, k) AND NOT list_contains(gone, k) AS buy, e = 'error' AND NOT list_contains(gone, k) AS undo,
      coalesce(nullif(list_position(list_transform(packs, lambda p: p.t), k), 0), 1) AS spot
    FROM (
      SELECT tx.user_id, tx.n, tx.id, tx.e, tx.k, tx.ts, tx.rank, st.tier, st.seen, st.gone, list_filter(st.packs, lambda p: p.x > tx.ts) AS packs
      FROM st JOIN tx ON tx.user_id = st.user_id AND tx.n = st.n + 1))
)
SELECT user_id, id, ['free', 'starter', 'pro', 'lifetime'][tier + 1] AS tier, len(packs) AS packs, ([10, 40, 1000, 1000][tier + 1] + 25 * len(packs))::BIGINT AS documents,
  [1, 3, 10, 10][tier + 1]::BIGINT AS libraries, status FROM st WHERE n > 0"""

CONSENT_SQL = f"""WITH RECURSIVE {numbered("'click', 'view', 'signup'")},
cv AS MATERIALIZED (SELECT *, ['once', 'allow', 'deny', 'reset'][floor(value)::BIGINT % 4 + 1] AS said FROM ev),
st AS (
  SELECT user_id, 0::BIGINT AS n, 'ask' AS s, false AS ses, NULL::BIGINT AS pend, []::STRUCT(id BIGINT, o VARCHAR, a BIGINT)[] AS gone FROM (SELECT DISTINCT user_id FROM cv)
  UNION ALL
  SELECT cv.user_id, cv.n, CASE WHEN e = 'view' THEN CASE said WHEN 'once' THEN s WHEN 'reset' THEN 'ask' ELSE said END ELSE s END,
    CASE WHEN e = 'signup' THEN false WHEN e = 'view' AND said IN ('once', 'reset') THEN said = 'once' ELSE ses END,
    CASE WHEN e = 'signup' THEN NULL WHEN e = 'click' AND NOT ses AND s = 'ask' THEN id WHEN e = 'view' AND said <> 'reset' THEN NULL ELSE pend END,
    CASE WHEN e = 'click' AND ses THEN [{{'id': id, 'o': 'session', 'a': NULL}}] WHEN e = 'click' AND s = 'allow' THEN [{{'id': id, 'o': 'remembered', 'a': NULL}}]
      WHEN e = 'click' AND s = 'deny' THEN [{{'id': id, 'o': 'denied', 'a': NULL}}]
      WHEN e = 'click' AND pend IS NOT NULL THEN [{{'id': id, 'o': 'denied', 'a': pend}}, {{'id': id, 'o': 'asked', 'a': NULL}}] WHEN e = 'click' THEN [{{'id': id, 'o': 'asked', 'a': NULL}}]
      WHEN e = 'view' AND said <> 'reset' AND pend IS NOT NULL THEN [{{'id': id, 'o': CASE said WHEN 'allow' THEN 'remembered' WHEN 'once' THEN 'session' ELSE 'denied' END, 'a': pend}}] ELSE [] END
  FROM st JOIN cv ON cv.user_id = st.user_id AND cv.n = st.n + 1
)
SELECT user_id, g.id AS id, g.o AS outcome, g.a AS answers FROM (SELECT user_id, unnest(gone) AS g FROM st)"""

QUERIES = {
    "query_cache": (result_cache, CACHE_SQL),
    "sse_parse": (reply_streams, REPLY_SQL),
    "throttle": (throttle, THROTTLE_SQL),
    "entitlement_states": (entitlement_states, ENTITLEMENT_SQL),
    "consent_state": (consent_log, CONSENT_SQL),
}
