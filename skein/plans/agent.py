"""Registered queries of question understanding, extractive answers, tool reports and the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from skein.operators.chain import answers
from skein.plans.catalogue import KNN, found_texts, hits, table
from skein.plans.chunks import STOP_WORDS
from skein.plans.corpus import QUESTIONS

#: Synonyms, trivial questions, cue words, and the phrases of answers.
SYNONYMS = {
    "clean": ["sanitize", "disinfect", "sterilize", "wash"],
    "use": ["operate", "utilize", "employ", "apply"],
    "device": ["instrument", "equipment", "apparatus", "tool"],
    "procedure": ["process", "method", "protocol", "technique"],
    "patient": ["individual", "subject", "person"],
    "doctor": ["physician", "surgeon", "clinician", "practitioner"],
    "remove": ["detach", "disconnect", "separate", "extract"],
    "install": ["attach", "connect", "mount", "affix"],
    "check": ["verify", "inspect", "examine", "test"],
    "warning": ["caution", "alert", "notice", "advisory"],
}
TRIVIAL = ["test", "help", "hello", "hi", "hey", "ok", "okay", "thanks", "thank you"]
CUES = ["important", "must", "should", "warning", "note", "key", "essential", "critical"]
TYPES = [
    ("definition", ["what"], ["what is", "what are"]),
    ("instruction", ["how"], ["how to", "how do"]),
    ("explanation", ["why"], ["why is", "why do"]),
    ("temporal", ["when"], ["when to", "when should"]),
    ("location", ["where"], []),
    ("description", [], ["list", "tell me about", "describe"]),
]
BONUS = {"instruction": ["step", "first"], "definition": ["is", "are", "means"], "explanation": ["because", "due to", "reason"]}
INTROS = {
    "definition": "Based on your documents, here's what I found:",
    "instruction": "According to your documents:",
    "explanation": "Your documents explain:",
    "temporal": "Regarding timing, your documents state:",
    "location": "Regarding location, here's what your documents say:",
    "description": "From your documents:",
    "general": "Here's what I found in your documents:",
}
NOT_FOUND = "I found your documents but couldn't identify specific information matching your query."
STOPS = sorted({w for words in STOP_WORDS.values() for w in words})
PREFIXES = [a for a, _ in QUESTIONS] + ["Tell me about ", "x "]


def asked(spark, d):
    """query_id, question: the tables' items as questions, each with one of the question forms in front."""
    pick = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), (F.col("item_id") % len(PREFIXES) + 1).cast("int"))
    text = F.concat(pick, F.lit("clean the device procedure "), F.coalesce(F.substring("text", 1, 60), F.lit("")), F.lit("?"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("question"))


def key_terms(text: Column) -> Column:
    """Words of three or more letters that no list of frequent words has, as they are written."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda w: (F.char_length(w) > 2) & ~F.lower(w).isin(STOPS))


def synonyms(term: Column) -> Column:
    known = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return F.coalesce(F.try_element_at(known, F.lower(term)), F.array().cast("array<string>"))


def reformulations(question: Column) -> Column:
    def one(a, b):
        said = F.replace(F.concat(F.lit(b), F.substr(question, F.lit(len(a) + 1))), F.lit("?"), F.lit(""))
        return F.when(question.startswith(a), said)

    return F.array_compact(F.array(*[one(a, b) for a, b in QUESTIONS]))


def expansions(question: Column) -> Column:
    """The question, versions with synonyms in place of terms or behind it, and its statement forms; sorted, each once."""
    terms = key_terms(question)
    tokens = F.size(F.filter(F.split(question, " ", -1), lambda w: w != ""))
    trivial = (tokens <= 1) | (F.size(terms) == 0) | F.lower(F.trim(question)).isin(TRIVIAL)
    more = [F.concat(question, F.lit(f" {w}")) for w in ("overview", "summary", "introduction")]
    generic = F.array(question, *more, F.lit("overview"), F.lit("summary"))
    swap = lambda t: F.transform(F.slice(synonyms(t), 1, 2), lambda s: F.regexp_replace(question, F.concat(F.lit("(?i)"), t), s))
    behind = F.slice(F.flatten(F.transform(F.array_distinct(terms), synonyms)), 1, 3)
    tail = F.when(F.size(behind) > 0, F.array(F.concat(question, F.lit(" "), F.array_join(behind, " ")))).otherwise(F.array().cast("array<string>"))
    forms = F.when(F.contains(question, F.lit("?")), reformulations(question)).otherwise(F.array().cast("array<string>"))
    full = F.concat(F.array(question), F.flatten(F.transform(terms, swap)), tail, forms)
    return F.array_sort(F.array_distinct(F.when(trivial, generic).otherwise(full)))


def query_type(question: Column) -> Column:
    low, out = F.lower(F.coalesce(question, F.lit(""))), F.lit("general")
    for name, starts, parts in reversed(TYPES):
        is_it = F.lit(False)
        for s in starts:
            is_it = is_it | low.startswith(s)
        for p in parts:
            is_it = is_it | F.contains(low, F.lit(p))
        out = F.when(is_it, name).otherwise(out)
    return out


def sentences(text: Column) -> Column:
    """Trimmed runs up to a sentence sign, of more than 20 characters."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(parts, lambda s: F.trim(s, F.lit(" \n\t\r"))), lambda s: F.char_length(s) > 20)


def thousandths(sentence: Column) -> Column:
    """The importance of a sentence in whole thousandths: two for each character, 300 for a digit, 200 for a cue; 1000 at most."""
    cue = F.lit(False)
    for w in CUES:
        cue = cue | F.contains(F.lower(sentence), F.lit(w))
    score = 2 * F.char_length(sentence) + F.when(sentence.rlike("[0-9]"), 300).otherwise(0) + F.when(cue, 200).otherwise(0)
    return F.least(score, F.lit(1000)).cast("long")


def importance(sentence: Column) -> Column:
    return thousandths(sentence) / 1000.0


def relevant_sentences(rows):
    """query_id, type, sentence, score, rank: the five best sentences for each row (query_id, question, content)."""
    long = lambda c, n: F.array_distinct(F.filter(F.transform(key_terms(c), F.lower), lambda w: F.char_length(w) > n))
    r = rows.select("query_id", "question", query_type(F.col("question")).alias("type"), F.posexplode(sentences(F.col("content"))).alias("place", "sentence"))
    match = F.size(F.array_intersect(long(F.col("sentence"), 3), long(F.col("question"), 2)))
    bonus = F.lit(False)
    for name, cues in BONUS.items():
        found = F.contains(F.lower("sentence"), F.lit("to ")) if name == "instruction" else F.lit(False)
        for c in cues:
            found = found | F.contains("sentence", F.lit(c))
        bonus = bonus | ((F.col("type") == name) & found)
    score = F.round(importance(F.col("sentence")) + match * 0.5 + F.when(bonus, 0.3).otherwise(0.0), 6)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "place")
    return r.withColumn("score", score).withColumn("rank", F.row_number().over(w)).filter("rank <= 5")


def contexts(spark, d):
    """Each question with the document that has its id (a convention of these tables)."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    q = asked(spark, d)
    return found_texts(q.withColumn("id", F.col("query_id")), docs, q.count()).drop("id")


def extractive_answer(spark, d):
    rows = relevant_sentences(contexts(spark, d))
    said = F.transform(F.array_sort(F.collect_list(F.struct("rank", "sentence"))), lambda x: x["sentence"])
    made = rows.groupBy("query_id").agg(said.alias("said"))
    intro = F.create_map(*[F.lit(x) for kv in INTROS.items() for x in kv])
    foot = F.concat(F.lit("\n\n[On-Device Analysis: Extracted "), F.size("said").cast("string"), F.lit(" relevant passages from your documents]"))
    answer = F.concat(F.element_at(intro, query_type(F.col("question"))), F.lit("\n\n"), F.array_join("said", "\n\n"), foot)
    out = asked(spark, d).join(made, "query_id", "left")
    return out.select("query_id", F.md5(F.when(F.col("said").isNull(), F.lit(NOT_FOUND)).otherwise(answer).cast("binary")).alias("answer_md5"))


def sentence_rank(spark, d):
    return relevant_sentences(contexts(spark, d)).select("query_id", "type", F.col("rank").cast("long"), "score", F.md5(F.col("sentence").cast("binary")).alias("md5"))


def sentence_importance(spark, d):
    """The mean over each document's sentences, in whole hundred thousandths, halves up."""
    s = table(spark, d, "documents").select("doc_id", F.explode(sentences(F.col("text"))).alias("s"))
    sums = s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(thousandths(F.col("s"))).alias("total"))
    return sums.select("doc_id", "n", (F.expr("(200 * total + n) div (2 * n)") / 100000.0).alias("importance"))


def expand_query(spark, d):
    e = expansions(F.col("question"))
    return asked(spark, d).select("query_id", F.size(e).cast("long").alias("n"), F.array_join(e, "\n").alias("versions"))


def key_term_counts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(key_terms(F.col("text"))).cast("long").alias("n_terms"))


def query_types(spark, d):
    q = asked(spark, d).select("query_id", "question")
    return q.select("query_id", query_type(F.col("question")).alias("type"), F.size(reformulations(F.col("question"))).cast("long").alias("n_forms"))


def reformulated(spark, d):
    return asked(spark, d).select("query_id", F.array_join(reformulations(F.col("question")), "\n").alias("statements"))


def entity_extract(spark, d):
    """Names: runs of capitalised words behind another word (the first word of a sentence is no name)."""
    found = F.regexp_extract_all("text", F.lit(r"[a-z,] ([A-Z][a-z]+(?: [A-Z][a-z]+)*)"), F.lit(1))
    names = table(spark, d, "documents").select(F.explode(found).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")


def prompt_build(spark, d):
    c = contexts(spark, d)
    text = F.concat(F.lit("Context:\n"), F.coalesce("content", F.lit("")), F.lit("\n\nQuestion: "), "question", F.lit("\n\nAnswer:"))
    return c.select("query_id", F.char_length(text).cast("long").alias("n_chars"), F.floor(F.char_length(text) / 4).alias("tokens"), F.md5(text.cast("binary")).alias("md5"))


def tool_search(spark, d):
    """The report of three hits for each question: name, relevance in percent and a preview of 600 characters."""
    h = hits(spark, d, 3).withColumn("t", F.trim(F.coalesce("content", F.lit(""))))
    preview = F.when(F.char_length("t") > 600, F.concat(F.substring("t", 1, 600), F.lit(" [...]"))).otherwise(F.col("t"))
    name = F.coalesce("source", F.lit("Unknown"))
    line = F.format_string("[%d] From %s (Relevance: %.1f%%):\n%s", F.col("rank"), name, F.col("similarity") * 100, preview)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"])
    out = h.groupBy("query_id").agg(lines.alias("l"))
    report = F.concat(F.lit("Found "), F.size("l").cast("string"), F.lit(" relevant chunks\n\n"), F.array_join("l", "\n\n"))
    return out.select("query_id", F.md5(report.cast("binary")).alias("report_md5"), tool_names(report).alias("names"))


def tool_names(report: Column) -> Column:
    """The names in a report's lines, joined by commas."""
    return F.array_join(F.regexp_extract_all(report, F.lit(r"(?m)^\[\d+\] From (.+) \(Relevance"), F.lit(1)), ",")


def list_docs_intent(spark, d):
    """Ten names of each container and how many more there are."""
    name = F.format_string("doc %06d", F.col("doc_id"))
    all_ = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min_by(name, "doc_id").alias("first"))
    w = Window.partitionBy("source").orderBy("doc_id")
    ten = table(spark, d, "documents").select("source", "doc_id", name.alias("name")).withColumn("k", F.row_number().over(w)).filter("k <= 10")
    said = ten.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    more = F.when(F.col("n") > 10, F.concat(F.lit(" and "), (F.col("n") - 10).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return all_.join(said, "source").select("source", F.concat("names", more).alias("names"))


def tool_summary(spark, d):
    """For each container name in lower case, the first document of the container whose name contains it."""
    docs = table(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_docs"))
    asked_ = docs.select(F.lower("source").alias("name")).distinct()
    hit = asked_.join(F.broadcast(docs), F.contains(F.lower("source"), F.col("name")))
    return hit.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.min_by("n_docs", "doc_id").alias("n_docs"))


def container_scope(spark, d):
    """Documents of the active container; those without one belong to the first container."""
    first = "src0"
    mine = F.coalesce(F.when(F.col("doc_id") % 7 != 0, F.col("source")), F.lit(first))
    return table(spark, d, "documents").select(mine.alias("container"), "n_chars").groupBy("container").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


def speech_format(spark, d):
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"\*\*|\*|#", "")
    cut = F.when(F.char_length(t) > 500, F.concat(F.substring(t, 1, 497), F.lit("..."))).otherwise(t)
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(cut.cast("binary")).alias("spoken_md5"))


def similarity_bands(spark, d):
    band = F.when(F.col("similarity") >= 0.8, "high").when(F.col("similarity") >= 0.6, "medium").otherwise("low")
    shown = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("similarity")))
    h = hits(spark, d, 5)
    return h.select("query_id", "id", band.alias("band"), shown.alias("shown"), F.md5(F.substring(F.coalesce("content", F.lit("")), 1, 150).cast("binary")).alias("preview_md5"))


TERMS = r"list_filter(regexp_extract_all(coalesce({0}, ''), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 2 AND lower(w) NOT IN (" + ", ".join(map(repr, STOPS)) + "))"
PREFIX_SQL = "[" + ", ".join(repr(p) for p in PREFIXES) + "]"
ASKED = f"asked AS (SELECT item_id AS query_id, {PREFIX_SQL}[item_id % {len(PREFIXES)} + 1] || 'clean the device procedure ' || coalesce(substring(text, 1, 60), '') || '?' AS question FROM benchmark)"
SYN = "MAP {" + ", ".join(f"'{k}': {v!r}" for k, v in SYNONYMS.items()) + "}"
FORMS = "list_filter([" + ", ".join(f"CASE WHEN starts_with(question, '{a}') THEN replace('{b}' || substring(question, {len(a) + 1}), '?', '') END" for a, b in QUESTIONS) + "], lambda x: x IS NOT NULL)"


def type_sql(q="question"):
    out = "CASE"
    for name, starts, parts in TYPES:
        tests = [f"starts_with(lower(coalesce({q}, '')), '{s}')" for s in starts] + [f"contains(lower(coalesce({q}, '')), '{p}')" for p in parts]
        out += f" WHEN {' OR '.join(tests)} THEN '{name}'"
    return out + " ELSE 'general' END"


SENTENCES = r"list_filter(list_transform(regexp_extract_all(coalesce({0}, ''), '[^.!?]+[.!?]*'), lambda s: trim(s, ' ' || chr(10) || chr(9) || chr(13))), lambda s: length(s) > 20)"
CUED = " OR ".join(f"contains(lower({{0}}), '{c}')" for c in CUES)
THOUSANDTHS = f"least(1000, 2 * length({{0}}) + CASE WHEN regexp_matches({{0}}, '[0-9]') THEN 300 ELSE 0 END + CASE WHEN {CUED} THEN 200 ELSE 0 END)"
IMPORTANCE = f"({THOUSANDTHS} / 1000.0::DOUBLE)"
BONUS_SQL = " OR ".join(
    f"(type = '{name}' AND (" + " OR ".join([f"contains(sentence, '{c}')" for c in cues] + (["contains(lower(sentence), 'to ')"] if name == "instruction" else [])) + "))" for name, cues in BONUS.items()
)
LONG = "list_distinct(list_filter(list_transform({0}, lambda w: lower(w)), lambda w: length(w) > {1}))"
RELEVANT = f"""{ASKED}, ctx AS (SELECT query_id, question, text AS content FROM asked LEFT JOIN documents ON doc_id = query_id),
sen AS (SELECT query_id, question, {type_sql()} AS type, unnest({SENTENCES.format('content')}) AS sentence, unnest(range(len({SENTENCES.format('content')}))) AS place FROM ctx),
sco AS (SELECT *, round({IMPORTANCE.format('sentence')} + 0.5::DOUBLE * len(list_intersect({LONG.format(TERMS.format('sentence'), 3)}, {LONG.format(TERMS.format('question'), 2)}))
  + CASE WHEN {BONUS_SQL} THEN 0.3::DOUBLE ELSE 0 END, 6) AS score FROM sen),
rel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS rank FROM sco) WHERE rank <= 5)"""
INTRO_SQL = "CASE " + type_sql("question") + " " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in INTROS.items()) + " END"
EMPTY = "[]::VARCHAR[]"
SWAPS = f"flatten(list_transform({TERMS.format('question')}, lambda t: list_transform(coalesce(syn[lower(t)], {EMPTY})[:2], lambda s: regexp_replace(question, t, s, 'gi'))))"
BEHIND = f"flatten(list_transform(list_filter({TERMS.format('question')}, lambda t, i: list_position({TERMS.format('question')}, t) = i), lambda t: coalesce(syn[lower(t)], {EMPTY})))[:3]"
TRIVIAL_SQL = f"len(list_filter(string_split(question, ' '), lambda w: w <> '')) <= 1 OR len({TERMS.format('question')}) = 0 OR lower(trim(question, ' ')) IN ({', '.join(map(repr, TRIVIAL))})"
HIT = "SELECT near.query_id, near.vec_id AS id, near.similarity, near.rank, d.text AS content, d.source FROM near JOIN benchmark b ON b.item_id = near.query_id LEFT JOIN documents d ON d.doc_id = near.vec_id"

QUERIES = {
    "expand_query": (
        expand_query,
        f"""WITH {ASKED}, s AS (SELECT query_id, question, {SYN} AS syn FROM asked),
v AS (SELECT query_id, list_sort(list_distinct(CASE WHEN {TRIVIAL_SQL} THEN [question, question || ' overview', question || ' summary', question || ' introduction', 'overview', 'summary']
  ELSE list_concat(list_concat([question], {SWAPS}), list_concat(CASE WHEN len({BEHIND}) > 0 THEN [question || ' ' || array_to_string({BEHIND}, ' ')] ELSE {EMPTY} END,
  CASE WHEN contains(question, '?') THEN {FORMS} ELSE {EMPTY} END)) END)) AS e FROM s) SELECT query_id, len(e) AS n, array_to_string(e, chr(10)) AS versions FROM v""",
    ),
    "key_terms": (key_term_counts, f"SELECT conv_id, turn, len({TERMS.format('text')}) AS n_terms FROM conversations"),
    "query_type": (query_types, f"WITH {ASKED} SELECT query_id, {type_sql()} AS type, len({FORMS}) AS n_forms FROM asked"),
    "reformulated": (reformulated, f"WITH {ASKED} SELECT query_id, array_to_string({FORMS}, chr(10)) AS statements FROM asked"),
    "sentence_importance": (
        sentence_importance,
        f"WITH s AS (SELECT doc_id, unnest({SENTENCES.format('text')}) AS s FROM documents) SELECT doc_id, count(*) AS n, "
        f"((200 * sum({THOUSANDTHS.format('s')}) + count(*)) // (2 * count(*)))::BIGINT / 100000.0::DOUBLE AS importance FROM s GROUP BY doc_id",
    ),
    "sentence_rank": (sentence_rank, f"WITH {RELEVANT} SELECT query_id, type, rank, score, md5(sentence) AS md5 FROM rel"),
    "extractive_answer": (
        extractive_answer,
        f"""WITH {RELEVANT}, g AS (SELECT query_id, string_agg(sentence, chr(10) || chr(10) ORDER BY rank) AS said, count(*) AS n FROM rel GROUP BY query_id)
SELECT query_id, md5(CASE WHEN said IS NULL THEN '{NOT_FOUND.replace(chr(39), chr(39) * 2)}' ELSE {INTRO_SQL} || chr(10) || chr(10) || said || chr(10) || chr(10) ||
  '[On-Device Analysis: Extracted ' || n || ' relevant passages from your documents]' END) AS answer_md5 FROM asked LEFT JOIN g USING (query_id)""",
    ),
    "entity_extract": (
        entity_extract,
        "SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z,] ([A-Z][a-z]+(?: [A-Z][a-z]+)*)', 1)) AS name FROM documents) GROUP BY name HAVING count(*) > 1",
    ),
    "prompt_build": (
        prompt_build,
        f"""WITH {ASKED}, p AS (SELECT query_id, 'Context:' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Answer:' AS t
FROM asked LEFT JOIN documents ON doc_id = query_id) SELECT query_id, length(t) AS n_chars, length(t) // 4 AS tokens, md5(t) AS md5 FROM p""",
    ),
    "tool_search": (
        tool_search,
        f"""WITH {KNN}, h AS (SELECT *, trim(coalesce(content, ''), ' ') AS t FROM ({HIT} WHERE near.rank <= 3)),
l AS (SELECT query_id, rank, coalesce(source, 'Unknown') AS name, '[' || rank || '] From ' || coalesce(source, 'Unknown') || ' (Relevance: ' || printf('%.1f', similarity * 100) || '%):' || chr(10) ||
  CASE WHEN length(t) > 600 THEN substring(t, 1, 600) || ' [...]' ELSE t END AS l FROM h)
SELECT query_id, md5('Found ' || count(*) || ' relevant chunks' || chr(10) || chr(10) || string_agg(l, chr(10) || chr(10) ORDER BY rank)) AS report_md5, string_agg(name, ',' ORDER BY rank) AS names FROM l GROUP BY query_id""",
    ),
    "list_docs_intent": (
        list_docs_intent,
        """WITH r AS (SELECT source, printf('doc %06d', doc_id) AS name, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, string_agg(name, ', ' ORDER BY name) || CASE WHEN any_value(n) > 10 THEN ' and ' || (any_value(n) - 10) || ' more' ELSE '' END AS names FROM r WHERE k <= 10 GROUP BY source""",
    ),
    "tool_summary": (
        tool_summary,
        """WITH s AS (SELECT source, min(doc_id) AS doc_id, count(*) AS n_docs FROM documents GROUP BY source)
SELECT a.name, min(s.doc_id) AS doc_id, arg_min(s.n_docs, s.doc_id) AS n_docs FROM (SELECT DISTINCT lower(source) AS name FROM s) a JOIN s ON contains(lower(s.source), a.name) GROUP BY a.name""",
    ),
    "container_scope": (
        container_scope,
        "SELECT CASE WHEN doc_id % 7 <> 0 THEN source ELSE 'src0' END AS container, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1",
    ),
    "speech_format": (
        speech_format,
        """WITH s AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '\\*\\*|\\*|#', '', 'g') AS t FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN length(t) > 500 THEN substring(t, 1, 497) || '...' ELSE t END) AS spoken_md5 FROM s""",
    ),
    "similarity_band": (
        similarity_bands,
        f"""WITH {KNN} SELECT query_id, id, CASE WHEN similarity >= 0.8 THEN 'high' WHEN similarity >= 0.6 THEN 'medium' ELSE 'low' END AS band,
least(1.0::DOUBLE, greatest(0.0::DOUBLE, similarity)) AS shown, md5(substring(coalesce(content, ''), 1, 150)) AS preview_md5 FROM ({HIT} WHERE near.rank <= 5)""",
    ),
}


def chain_candidates(spark, d, k):
    """The 4k nearest of each question with texts and vectors, and the question's words with those of its expansions."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("question"))
    asked_text = q.select("query_id", F.array_join(expansions(F.col("question")), " ").alias("asked"))
    rows = hits(spark, d, 4 * k).join(asked_text, "query_id").withColumn("chunk_index", F.col("id") % 10)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return found_texts(rows, vectors, 4 * k * q.count())


def answer_chain(spark, d, strict=True):
    n_docs = table(spark, d, "documents").select("source").distinct().count()
    out = answers(chain_candidates(spark, d, CHAIN_K), CHAIN_K, n_docs, strict)
    picks = F.array_join(F.transform("picks", lambda x: x.cast("string")), ",")
    said = F.md5(F.col("context").cast("binary"))
    return out.select("query_id", "decision", picks.alias("picks"), "n_pass", "n_added", "n_used", said.alias("context_md5"), "confidence", "warnings")


def answer_chain_open(spark, d):
    return answer_chain(spark, d, False)


def chain_sql(strict: bool) -> str:
    """The chain step by step over the same lists."""
    from skein.plans import ranked
    from skein.plans.catalogue import HYBRID, TOKENS

    k, weight = CHAIN_K, "0.75" if strict else "0.7"
    old = HYBRID[HYBRID.index("ask AS (") : HYBRID.index("siz AS (")]
    expanded = f"""asked AS (SELECT item_id AS query_id, coalesce(text, '') AS question FROM benchmark), syn AS (SELECT query_id, question, {SYN} AS syn FROM asked),
ver AS (SELECT query_id, array_to_string(list_sort(list_distinct(CASE WHEN {TRIVIAL_SQL} THEN [question, question || ' overview', question || ' summary', question || ' introduction', 'overview', 'summary']
  ELSE list_concat(list_concat([question], {SWAPS}), list_concat(CASE WHEN len({BEHIND}) > 0 THEN [question || ' ' || array_to_string({BEHIND}, ' ')] ELSE {EMPTY} END,
  CASE WHEN contains(question, '?') THEN {FORMS} ELSE {EMPTY} END)) END)), ' ') AS asktext FROM syn),
ask AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOKENS.replace('text', 'asktext')}) AS term FROM ver) GROUP BY ALL),
"""
    base = ranked.gate_sql().replace(old, expanded).replace("near.rank <= 40", f"near.rank <= {4 * k}").replace("fused_rank <= 20", f"fused_rank <= {2 * k}")
    if not strict:
        base = base.replace("WHEN false OR trivial THEN 0.35::DOUBLE", "WHEN true THEN 0.35::DOUBLE")
    base += f""",
src AS MATERIALIZED (SELECT rer.query_id, rer.id, similarity, new_rank, coalesce(source, 'Unknown') AS src, content, rer.query FROM rer),
kep AS MATERIALIZED (SELECT s.* FROM src s JOIN gat USING (query_id) WHERE (n_pass > 0 AND similarity >= "limit") OR (n_pass = 0 AND decision = 'override')),
kct AS (SELECT query_id, count(*) AS n, count(DISTINCT src) AS have FROM kep GROUP BY query_id),
dsr AS (SELECT query_id, count(DISTINCT src) AS every FROM src GROUP BY query_id),
fst AS (SELECT s.*, row_number() OVER (PARTITION BY query_id, src ORDER BY new_rank) AS f FROM src s WHERE (query_id, src) NOT IN (SELECT query_id, src FROM kep)),
ext AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY new_rank) AS turn FROM fst WHERE f = 1),
pol AS MATERIALIZED (
  SELECT query_id, id, similarity, src, content, new_rank AS pos FROM kep
  UNION ALL SELECT e.query_id, e.id, e.similarity, e.src, e.content, 1000 + turn FROM ext e JOIN kct USING (query_id) JOIN dsr USING (query_id)
    WHERE every > 1 AND turn <= least(least(every, 3) - have, greatest({2 * k}, n) - n)),
vec AS MATERIALIZED (SELECT p.*, e.embedding::DOUBLE[] AS e FROM pol p LEFT JOIN embeddings e ON e.vec_id = p.id),
p1 AS MATERIALIZED (SELECT *, 1::BIGINT AS pick FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS r FROM vec) WHERE r = 1)"""
    for i in range(2, k + 1):
        taken = " UNION ALL ".join(f"SELECT query_id, id, e FROM p{j}" for j in range(1, i))
        base += f""",
p{i} AS MATERIALIZED (SELECT * EXCLUDE (v, r), 0 AS r, {i}::BIGINT AS pick FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, pos) AS r FROM (
  SELECT c.query_id, c.id, c.similarity, c.src, any_value(c.content) AS content, c.pos, any_value(c.e) AS e,
    round({weight}::DOUBLE * c.similarity - (1 - {weight}::DOUBLE) * greatest(0, max(list_cosine_similarity(c.e, t.e))), 9) AS v
  FROM vec c JOIN ({taken}) t USING (query_id) GROUP BY c.query_id, c.id, c.similarity, c.src, c.pos HAVING NOT bool_or(c.id = t.id))) WHERE r = 1)"""
    picked = " UNION ALL ".join(f"SELECT query_id, id, similarity, src, content, pick FROM p{i}" for i in range(1, k + 1))
    blocked = "n_pass_top < 3 AND NOT override AND NOT trivial" if strict else "false"
    block = "'[Document Chunk ' || pick || ', Similarity: ' || printf('%.3f', similarity) || ']' || chr(10) || coalesce(content, '') || CASE WHEN pick = count(*) OVER (PARTITION BY query_id) THEN '' ELSE chr(10) || chr(10) || '---' || chr(10) || chr(10) END"
    return f"""WITH {base},
fal AS (SELECT query_id, id, similarity, src, content, new_rank AS pick FROM src JOIN gat USING (query_id) WHERE n_pass = 0 AND decision <> 'override' AND new_rank <= {max(k, 3)}),
sel AS MATERIALIZED (SELECT *, true AS main FROM ({picked}) UNION ALL SELECT *, false FROM fal),
blk AS (SELECT query_id, pick, id, {block} AS b, main FROM sel),
tot AS (SELECT *, sum(length(b)) OVER (PARTITION BY query_id ORDER BY pick ROWS UNBOUNDED PRECEDING) AS total FROM blk),
ctx AS (SELECT query_id, count(*) AS n_used, string_agg(b, '' ORDER BY pick) AS context FROM tot WHERE pick = 1 OR total <= CASE WHEN main THEN 3500 ELSE 2500 END GROUP BY query_id),
agg AS (SELECT query_id, any_value(main) AS main, count(*) AS n, count(DISTINCT src) AS s, max(similarity) FILTER (pick = 1) AS top1, string_agg(id::VARCHAR, ',' ORDER BY pick) AS picks,
  string_agg(id::VARCHAR, ',' ORDER BY pick) FILTER (main OR pick <= 99) AS every, count(*) FILTER (similarity >= 0.52) AS n_pass_top FROM sel GROUP BY query_id),
add AS (SELECT query_id, count(*) AS n_added FROM pol WHERE pos > 1000 GROUP BY query_id),
nwd AS (SELECT query_id, any_value(len({ranked.SPLIT.format('query')})) AS words FROM src GROUP BY query_id), dcs AS (SELECT count(DISTINCT source) AS docs FROM documents),
jnd AS (SELECT *, main AND {blocked} AS stop FROM agg JOIN gat USING (query_id) JOIN ctx USING (query_id) LEFT JOIN add USING (query_id) JOIN nwd USING (query_id), dcs)
SELECT query_id, CASE WHEN stop THEN 'strict_blocked' ELSE decision END AS decision,
  CASE WHEN main THEN picks ELSE (SELECT string_agg(x, ',') FROM (SELECT unnest(string_split(picks, ',')[:n_used]) AS x)) END AS picks, n_pass, coalesce(n_added, 0) AS n_added,
  CASE WHEN stop THEN 0 ELSE n_used END AS n_used, md5(CASE WHEN stop THEN '' ELSE context END) AS context_md5,
  CASE WHEN stop OR NOT main THEN 0.0::DOUBLE ELSE round(0.5::DOUBLE * least(top1 / 0.8::DOUBLE, 1) + 0.2::DOUBLE * least(n / 5, 1) + 0.2::DOUBLE * least(s / docs, 1) + 0.1::DOUBLE * least(words / 5, 1), 6) END AS confidence,
  CASE WHEN stop THEN 'Strict mode: insufficient supporting evidence' WHEN NOT main THEN 'Low-confidence retrieval: answered using extractive on-device analysis' ELSE
    array_to_string(list_filter([CASE WHEN top1 < 0.4 THEN 'Low relevance' WHEN top1 < 0.6 THEN 'Moderate relevance' END, CASE WHEN n < 3 THEN 'Limited context' END,
    CASE WHEN s = 1 AND docs > 1 THEN 'Single source' END, CASE WHEN words <= 2 THEN 'Generic query' END], lambda x: x IS NOT NULL), '; ') END AS warnings
FROM jnd"""


#: Rows of an answer in the registered chain; its lists are 4k nearest and 2k fused.
CHAIN_K = 5
QUERIES |= {"answer_chain": (answer_chain, chain_sql(True)), "answer_chain_open": (answer_chain_open, chain_sql(False))}
