"""Queries over documents and conversations, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import prism, running
from tessera.runtime import materialize, table

LEG = 10  # short documents have short legs


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _clean(column: str) -> str:
    sql = f"coalesce({column}, '')"
    for pattern, replacement in T.CLEANING:
        sql = f"regexp_replace({sql}, '{pattern.replace(chr(39), chr(39) * 2)}', '{replacement.format(whole=chr(92) + '0')}', 'g')"
    return sql


def _words(column: str) -> str:
    return f"list_filter(string_split_regex(lower(regexp_replace({column}, '[/()]', '', 'g')), '[,.;:!? ]+'), lambda x: x <> '')"


def _bound(first: str, last: str) -> str:
    return f"(strlen({first}) = 1 OR strlen({last}) = 1 OR {last} IN ({_quoted(T.ENDINGS)}) OR {first} IN ({_quoted(T.STARTERS)}))"


SENTS = f"""
raw AS (SELECT doc_id, list_filter(list_transform(string_split_regex({_clean('text')}, '[^\n]#'), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents),
sents AS (SELECT doc_id, len(l) + 1 AS n_sentences, unnest(l) AS sentence, generate_subscripts(l, 1) AS s_idx FROM raw)"""
_LEADS = ", ".join(f"lag(word, {k}) OVER o AS w{k}" for k in range(1, 6))


def _occ(keys: str, source: str) -> str:
    """Occurrences of every length from a table of words in order (keys, i, word)."""
    parts = [f"SELECT {keys}, 1 AS n, word AS ngram, i AS pos FROM lags"]
    for n in range(2, 7):
        gram = " || ' ' || ".join([*(f"w{k}" for k in range(n - 1, 0, -1)), "word"])
        parts.append(f"SELECT {keys}, {n} AS n, {gram} AS ngram, i AS pos FROM lags WHERE w{n - 1} IS NOT NULL AND NOT {_bound(f'w{n - 1}', 'word')}")
    return f"lags AS (SELECT {keys}, i, word, {_LEADS} FROM {source} WINDOW o AS (PARTITION BY {keys} ORDER BY i)), occ AS ({' UNION ALL '.join(parts)})"


OCC = f"""{SENTS},
lists AS (SELECT doc_id, s_idx, n_sentences, {_words('sentence')} AS w FROM sents),
spots AS (SELECT doc_id, s_idx, n_sentences, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM lists),
{_occ('doc_id, s_idx, n_sentences', 'spots')}"""


def _intent(count: str) -> str:
    return f"CASE WHEN {count} < 3 OR strlen(ngram) < 5 THEN 0 ELSE {count} / {LEG}.0::DOUBLE * strlen(ngram) / (1 + exp({count} / {LEG}.0::DOUBLE - n_sentences / {LEG}.0::DOUBLE)) END"


TOPICS = f"""{OCC},
per AS (SELECT doc_id, n, ngram, any_value(n_sentences) AS n_sentences, count(*) AS own, min(s_idx) AS first, max(s_idx) AS last, count(DISTINCT s_idx) AS spread FROM occ GROUP BY doc_id, n, ngram),
cum AS (SELECT *, CAST(sum(own) OVER (PARTITION BY n, ngram ORDER BY doc_id) AS DOUBLE) AS c FROM per),
sc AS (SELECT *, {_intent('c')} AS intent FROM cum),
topics AS (SELECT doc_id, n, ngram, round(intent, 6) AS intent FROM sc WHERE intent >= 0.3 AND own = spread AND first > 0 AND last / own::DOUBLE > 3 AND last / own::DOUBLE < 4 * {LEG})"""
RANKS = f"""{OCC},
run AS (SELECT *, CAST(count(*) OVER (PARTITION BY n, ngram ORDER BY doc_id, s_idx, pos) AS DOUBLE) AS c FROM occ),
sums AS (SELECT doc_id, s_idx, sum({_intent('c')}) AS score FROM run GROUP BY doc_id, s_idx),
every AS (SELECT doc_id, len(l) + 1 AS n_sentences, unnest(range(0, len(l) + 1)) AS s_idx FROM raw WHERE len(l) > 0),
ranks AS (SELECT doc_id, n_sentences, s_idx, round(coalesce(score, 0) * CASE WHEN n_sentences // 2 = 0 THEN 1.0
  ELSE 1 + (n_sentences // 2 - s_idx) * (n_sentences // 2 - s_idx) / ((n_sentences // 2) * (n_sentences // 2))::DOUBLE END, 6) AS rank FROM every LEFT JOIN sums USING (doc_id, s_idx))"""
LEGS = f"""{RANKS},
numbered AS (SELECT *, greatest(s_idx - 1, 0) // {LEG + 1} AS leg FROM ranks),
la AS (SELECT doc_id, leg, count(*) AS sentences, sum(rank) AS total, any_value(n_sentences) AS n FROM numbered GROUP BY doc_id, leg),
lb AS (SELECT doc_id, leg, sentences, total / CASE WHEN leg < greatest(n - 2, 0) // {LEG + 1} OR sentences = CASE WHEN leg = 0 THEN {LEG + 2} ELSE {LEG + 1} END THEN {LEG}
  WHEN leg = 0 THEN sentences ELSE sentences + 1 END AS average FROM la),
legs AS (SELECT *, CASE WHEN max(average) OVER (PARTITION BY doc_id) > 0 THEN average / max(average) OVER (PARTITION BY doc_id) ELSE 0 END AS interest FROM lb)"""


def text_prism_topics(spark, sf_dir):
    return prism.topics(_docs(spark, sf_dir), LEG)


def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.clean(F.col("text")).alias("cleaned"))


def sentence_split(spark, sf_dir):
    return prism.sentences(_docs(spark, sf_dir)).select("doc_id", F.col("n_sentences").cast("long").alias("n_sentences"), F.col("s_idx").cast("long").alias("s_idx"), "sentence")


def ngram_count(spark, sf_dir):
    return prism.ngram_counts(_docs(spark, sf_dir), 3)


def binding_filter(spark, sf_dir):
    sents = prism.sentences(_docs(spark, sf_dir))
    pairs = T.let(T.words(F.col("sentence")), lambda w: T.ngrams(w, 2, keep_bound=True))
    each = sents.select("doc_id", F.explode_outer(pairs).alias("g")).filter("g is not null").select("doc_id", F.split("g.ngram", " ").alias("w"))
    out = T.bound(F.col("w")[0], F.col("w")[1])
    return each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum(out.cast("long")).alias("bound"))


def intentionality(spark, sf_dir):
    found = prism.own_intents(_docs(spark, sf_dir), LEG)
    return found.withColumn("intent", F.round("intent", 6)).filter("intent > 0").select("doc_id", "n", "ngram", "own", "intent")


def sentence_rank(spark, sf_dir):
    return prism.sentence_ranks(_docs(spark, sf_dir), LEG).select("doc_id", F.col("n_sentences").cast("long").alias("n_sentences"), F.col("s_idx").cast("long").alias("s_idx"), F.round(F.col("rank") + 1e-9, 4).alias("rank"))


def leg_average(spark, sf_dir):
    found = prism.legs(prism.sentence_ranks(_docs(spark, sf_dir), LEG), LEG)
    return found.select("doc_id", F.col("leg").cast("long").alias("leg"), "sentences", F.round(F.col("average") + 1e-9, 4).alias("average"), F.round(F.col("interest") + 1e-9, 4).alias("interest"))


def leg_selection(spark, sf_dir):
    ranks = materialize(prism.sentence_ranks(_docs(spark, sf_dir), LEG), "ranks")
    return prism.selections(ranks, LEG).select("doc_id", F.col("leg").cast("long").alias("leg"), F.col("s_idx").cast("long").alias("s_idx"), F.round(F.col("rank") + 1e-9, 4).alias("rank"))


def leg_selection_threshold(spark, sf_dir):
    ranks = materialize(prism.sentence_ranks(_docs(spark, sf_dir), LEG), "ranks")
    return prism.selections(ranks, LEG, threshold=0.5, most=3).select("doc_id", F.col("leg").cast("long").alias("leg"), F.col("s_idx").cast("long").alias("s_idx"), F.round(F.col("rank") + 1e-9, 4).alias("rank"))


def concept_buckets(spark, sf_dir):
    return prism.concept_buckets(prism.topics(_docs(spark, sf_dir), LEG)).withColumn("n", F.col("n").cast("long"))


def static_intent(spark, sf_dir):
    return prism.static_intent(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


def ngram_overlap(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return running.shared(_docs(spark, sf_dir), items, (3, 4, 5))


def total_text(spark, sf_dir):
    found = prism.total_text(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return found.select("conv_id", F.md5("total").alias("digest"), F.octet_length("total").cast("long").alias("bytes"))


def predicates(spark, sf_dir):
    s = F.col("part")
    parts = _docs(spark, sf_dir).select(F.explode_outer(F.split("text", r"[ \n]")).alias("part")).filter("part is not null")
    tests = {"bracketed": T.bracketed(s), "code": T.is_code(s), "code_loose": T.is_code(s, strict=False), "legal": T.is_legal(s), "bot": T.is_bot(s), "anonymous": T.is_anonymous(s)}
    return parts.agg(F.count(F.lit(1)).alias("parts"), *[F.sum(t.cast("long")).alias(name) for name, t in tests.items()])


def key_name(spark, sf_dir):
    head = F.regexp_replace(F.substring("url", 9, 60), r"[^\x00-\x7F]", "")
    return table(spark, sf_dir, "pages").select("page_id", T.key_name(head, F.col("page_id") % 7).alias("key"), T.invariant_description(F.concat(F.lit("\n  "), head, F.lit("  "))).alias("description"))


def assess_result(spark, sf_dir):
    names = list(T.ASSESSMENTS)
    reply = F.concat(F.lit("reply: "), F.element_at(F.array(*map(F.lit, [*names, "none"])), (F.col("event_id") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", T.assess_result(reply).alias("outcome"))


QUERIES = {
    f.__name__: f
    for f in (
        text_prism_topics, clean_text, sentence_split, ngram_count, binding_filter, intentionality, sentence_rank, leg_average, leg_selection, leg_selection_threshold,
        concept_buckets, static_intent, ngram_overlap, total_text, predicates, key_name, assess_result,
    )
}

_PLACE = "row_number() OVER (PARTITION BY doc_id, leg ORDER BY rank DESC)"
_DISTINCT = "dist AS (SELECT doc_id, leg, rank, max(s_idx) AS s_idx FROM numbered GROUP BY doc_id, leg, rank)"
ORACLES = {
    "text_prism_topics": f"WITH {TOPICS} SELECT * FROM topics",
    "clean_text": f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents",
    "sentence_split": f"WITH {SENTS} SELECT doc_id, n_sentences, s_idx, sentence FROM sents",
    "ngram_count": f"WITH {OCC} SELECT n, ngram, count(*) AS count FROM occ GROUP BY n, ngram HAVING count(*) >= 3",
    "binding_filter": f"WITH {OCC} SELECT doc_id, count(*) AS pairs, CAST(sum({_bound('w1', 'word')}::BIGINT) AS BIGINT) AS bound FROM lags WHERE w1 IS NOT NULL GROUP BY doc_id",
    "intentionality": f"WITH {OCC}, per AS (SELECT doc_id, n, ngram, any_value(n_sentences) AS n_sentences, count(*) AS own FROM occ GROUP BY doc_id, n, ngram) SELECT * FROM (SELECT doc_id, n, ngram, own, round({_intent('own')}, 6) AS intent FROM per) WHERE intent > 0",
    "sentence_rank": f"WITH {RANKS} SELECT doc_id, n_sentences, s_idx, round(rank + 1e-9, 4) AS rank FROM ranks",
    "leg_average": f"WITH {LEGS} SELECT doc_id, leg, sentences, round(average + 1e-9, 4) AS average, round(interest + 1e-9, 4) AS interest FROM legs",
    "leg_selection": f"WITH {LEGS}, {_DISTINCT} SELECT doc_id, leg, s_idx, round(rank + 1e-9, 4) AS rank FROM (SELECT d.*, l.interest, {_PLACE} AS p FROM dist d JOIN legs l USING (doc_id, leg) WHERE interest > 0) WHERE p <= floor(0.5 + sqrt({LEG} * interest))",
    "leg_selection_threshold": f"WITH {LEGS}, {_DISTINCT} SELECT doc_id, leg, s_idx, round(rank + 1e-9, 4) AS rank FROM (SELECT d.*, {_PLACE} AS p FROM dist d JOIN legs l USING (doc_id, leg) WHERE interest > 0.5) WHERE p <= 3",
    "concept_buckets": f"WITH {TOPICS} SELECT doc_id, len(string_split(ngram, ' ')) AS n, count(*) AS concepts, round(sum(intent) + 1e-9, 4) AS total, max(intent) AS best FROM topics GROUP BY ALL",
    "static_intent": f"""WITH lists AS (SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes, {_words("regexp_replace(coalesce(text, ''), '[' || chr(10) || '\\[\\]]', '', 'g')")} AS w FROM conversations),
spots AS (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM lists), {_occ('conv_id, turn', 'spots')},
stm AS (SELECT n, ngram, count(*) AS c FROM occ GROUP BY n, ngram), each AS (SELECT DISTINCT conv_id, turn, n, ngram FROM occ),
means AS (SELECT conv_id, turn, n, avg(c) AS mean FROM each JOIN stm USING (n, ngram) GROUP BY conv_id, turn, n), totals AS (SELECT conv_id, turn, sum(mean) AS total FROM means GROUP BY conv_id, turn)
SELECT conv_id, turn, round(CASE WHEN bytes < 10 THEN 0 ELSE coalesce(total, 0) * bytes / 7 END, 4) AS intent FROM lists LEFT JOIN totals USING (conv_id, turn)""",
    "ngram_overlap": f"WITH {OCC}, bd AS (SELECT n, ngram FROM occ WHERE n IN (3, 4, 5)), it AS (SELECT n, ngram FROM ({'WITH ' + OCC.replace('FROM documents', 'FROM (SELECT item_id AS doc_id, text FROM benchmark)')} SELECT n, ngram FROM occ WHERE n IN (3, 4, 5))) SELECT n, count(*) AS shared FROM (SELECT DISTINCT n, ngram FROM bd INTERSECT SELECT DISTINCT n, ngram FROM it) GROUP BY n",
    "total_text": "SELECT conv_id, md5(total) AS digest, strlen(total) AS bytes FROM (SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn, coalesce(text, '')) AS total FROM conversations GROUP BY conv_id)",
    "predicates": """WITH p AS (SELECT unnest(string_split_regex(text, '[ \n]')) AS s FROM documents)
SELECT count(*) AS parts, CAST(sum((starts_with(s, '[') OR ends_with(s, ']'))::BIGINT) AS BIGINT) AS bracketed,
CAST(sum((contains(s, '{') OR ends_with(s, '}') OR ends_with(s, '^') OR contains(s, 'Categories :') OR contains(s, 'Hidden categories :') OR contains(s, '=') OR contains(s, 'http') OR contains(s, '/') OR ends_with(s, ':'))::BIGINT) AS BIGINT) AS code,
CAST(sum((contains(s, '{') OR ends_with(s, '}') OR ends_with(s, '^') OR contains(s, 'Categories :') OR contains(s, 'Hidden categories :'))::BIGINT) AS BIGINT) AS code_loose,
CAST(sum((contains(s, 'terms may appl') OR contains(s, 'Creative Commons') OR contains(s, 'last edited') OR contains(s, 'Terms of Use') OR contains(s, 'Privacy Policy'))::BIGINT) AS BIGINT) AS legal,
CAST(sum((contains(s, 'Bot') OR ends_with(s, 'bot'))::BIGINT) AS BIGINT) AS bot,
CAST(sum((len(regexp_extract_all(s, '\\.')) = 3 OR len(regexp_extract_all(s, ':')) > 2)::BIGINT) AS BIGINT) AS anonymous FROM p""",
    "key_name": r"""WITH h AS (SELECT page_id, regexp_replace(substr(url, 9, 60), '[^\x00-\x7F]', '', 'g') AS head FROM pages)
SELECT page_id, lower(regexp_replace(substr(head, 1, 40), '[^a-zA-Z0-9]', '-', 'g')) || '_' || CAST(page_id % 7 AS VARCHAR) AS key, trim(trim(replace(chr(10) || '  ' || head || '  ', '  ', ' '), chr(10) || ' '), ' ') AS description FROM h""",
    "assess_result": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0.0 END AS outcome FROM events",
}
