"""Queries over whole topics: all documents of a subject as its article, all its events as its history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import prism
from tessera.operators import promises as P
from tessera.operators import topics as O
from tessera.plans import history_queries as HQ
from tessera.plans import promise_queries as PQ
from tessera.plans import text_queries as TQ
from tessera.runtime import table

SEPARATOR = ". "


def _articles(spark, sf_dir):
    """In parts, joined by line ends."""
    return table(spark, sf_dir, "documents").select((F.col("doc_id") % HQ.SUBJECTS).alias("subject"), F.col("doc_id").alias("part"), "text")


def _rounded(names):
    return [F.round(c, 8).alias(f"v_{c}") for c in names]


SUMMARY = ("L", "LL", "N", "NL", "I", "W", "U", "M", "TG", "TU", "BF", "burst")


def analyze_topics(spark, sf_dir):
    found = O.analyze(_articles(spark, sf_dir), HQ._log(spark, sf_dir), separator=SEPARATOR, **HQ._options("db"))
    return found.select("subject", "users", "episodes", "edits", *_rounded(SUMMARY))


def trust_rows(spark, sf_dir):
    options = {k: v for k, v in HQ._options("base").items() if k != "kind"}
    return O.trust_rows(_articles(spark, sf_dir), HQ._log(spark, sf_dir), SEPARATOR, **options).select("subject", *_rounded(O.ROW))


def story_links(spark, sf_dir):
    ranks = prism.sentence_ranks(table(spark, sf_dir, "documents").select("doc_id", "text"), TQ.LEG)
    return O.story_links(prism.selections(ranks, TQ.LEG)).select("from_id", "semantics", "to_id")


def difference_links(spark, sf_dir):
    concepts = TQ.text_prism_topics(spark, sf_dir).select((F.col("doc_id") % HQ.SUBJECTS).alias("episode"), "ngram")
    return O.difference_links(concepts).select("link_type", "from_id", "to_id")


def lock_expiry(spark, sf_dir):
    """Requests that take their value in minutes; each third never ends."""
    s = P.samples(table(spark, sf_dir, "events"))
    end = F.when(F.col("seq") % 3 != 0, F.col("t") + F.floor("q").cast("long") * 60 * 10**9)
    return P.rate_limited(s.select(F.col("promise").alias("name"), "seq", F.col("t").alias("begin_ns"), end.alias("end_ns")), 3600.0, 7200.0).select("name", "seq", "ready", "expired")


QUERIES = {f.__name__: f for f in (analyze_topics, trust_rows, story_links, difference_links, lock_expiry)}


def _sizes(name: str, source: str) -> str:
    sents = TQ.SENTS.replace("raw AS", f"raw_{name} AS").split("sents AS")[0].rstrip().rstrip(",").replace("FROM documents", f"FROM {source}").replace("doc_id", "subject")
    return f"""{sents}, {name}_n AS (SELECT subject, strlen(text) AS bytes, len(l) + 1 AS sentences FROM {source} JOIN raw_{name} USING (subject))"""


_TEXTS = f"""article AS (SELECT doc_id % {HQ.SUBJECTS} AS subject, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id, coalesce(text, '')) AS text FROM documents GROUP BY 1),
talk AS (SELECT subject, string_agg(message, '{SEPARATOR}' ORDER BY date, seq) AS text FROM log GROUP BY subject),
{_sizes("article", "article")}, {_sizes("talk", "talk")},
iss AS (SELECT subject, sum((revert > 0 AND i > 1 AND "user" IS DISTINCT FROM last_user)::INT + (abs(edit_delta + last_delta) < last_delta / 10.0::DOUBLE)::INT)::DOUBLE AS issues
  FROM (SELECT *, row_number() OVER o - 1 AS i, lag("user") OVER o AS last_user, lag(edit_delta, 1, 0) OVER o AS last_delta FROM log WINDOW o AS (PARTITION BY subject ORDER BY date, seq)) GROUP BY subject),
pe AS (SELECT subject, count(DISTINCT "user") AS users, count(DISTINCT CASE WHEN contains("user", 'Bot') OR ends_with("user", 'bot') THEN "user" END) AS bots FROM log GROUP BY subject),
be AS (SELECT subject, count(*) AS episodes, count(*)::DOUBLE + 1 AS opened, sum(users)::DOUBLE AS ie, sum((end_ns - begin_ns)::DOUBLE / 86400000000000.0::DOUBLE) AS days, CAST(sum(edits) AS BIGINT) AS edits,
  sum((end_ns - begin_ns)::DOUBLE / 86400000000000.0::DOUBLE / users) AS per_user, sum((end_ns - begin_ns)::DOUBLE / 86400000000000.0::DOUBLE / (1 + users * (users - 1))) AS per_pair FROM et GROUP BY subject),
x AS (SELECT subject, users, episodes, edits, a.bytes::DOUBLE AS l, ie / opened AS n, issues AS i, t.bytes::DOUBLE / a.bytes AS w, t.sentences::DOUBLE / a.sentences AS u, t.sentences::DOUBLE / t.bytes AS m, days / opened AS tg, per_user AS tu, per_pair AS tu2, opened,
  coalesce(bots / nullif(users - bots, 0)::DOUBLE, 0) AS bf FROM be JOIN pe USING (subject) JOIN iss USING (subject) JOIN article_n a USING (subject) JOIN talk_n t USING (subject))"""
_LOG = "CASE WHEN {0} > 0 THEN ln(CASE WHEN {0} > 0 THEN {0} ELSE 1 END) END"
_VALUES = {"L": "l", "N": "n", "N2": "(n * n - n)", "I": "i", "W": "w", "U": "u", "M": "m", "TG": "tg", "TU": "tu", "TU2": "tu2", "BF": "bf"}
_VALUES |= {f"{k}L": _LOG.format(_VALUES[k]) for k in ("L", "N", "N2", "I", "W", "U", "M")} | {f"{k}L": f"ln(1 + {_VALUES[k]})" for k in ("TG", "TU", "TU2")}


def _select(names, values) -> str:
    return ", ".join(f'round({values[c]}, 8) AS "v_{c}"' for c in names)


ORACLES = {
    "analyze_topics": f"WITH RECURSIVE {HQ._episodes('db')}, {_TEXTS} SELECT subject, users, episodes, edits, {_select(SUMMARY, _VALUES | {'I': 'i / l', 'TU': 'tu / opened', 'burst': 'edits / opened'})} FROM x",
    "trust_rows": f"WITH RECURSIVE {HQ._episodes('base')}, {_TEXTS} SELECT subject, {_select(O.ROW, _VALUES)} FROM x",
    "story_links": f"""WITH sel AS ({TQ.ORACLES['leg_selection']}), p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s_idx) AS k FROM (SELECT DISTINCT doc_id, s_idx FROM sel))
SELECT CASE WHEN k = 1 THEN 'topic/' || doc_id ELSE 'event/' || doc_id || '-story_' || (k - 1) END AS from_id, 'LEADS_TO' AS semantics, 'event/' || doc_id || '-story_' || k AS to_id FROM p""",
    "difference_links": f"""WITH {TQ.TOPICS}, c AS (SELECT DISTINCT doc_id % {HQ.SUBJECTS} AS episode, ngram, string_split(ngram, ' ') AS w FROM topics WHERE len(string_split(ngram, ' ')) >= 3),
pt AS (SELECT DISTINCT ngram, w, unnest(range(1, len(w) + 1)) AS n FROM c), sp AS (SELECT ngram, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM pt), sub AS (SELECT DISTINCT ngram, len(w) AS k, n, array_to_string(w[i : i + n - 1], ' ') AS part FROM sp)
SELECT 'Contains' AS link_type, 'episode/' || episode AS from_id, replace('ngram' || len(w) || '/' || ngram, ' ', '_') AS to_id FROM c
UNION ALL SELECT 'Contains', replace('ngram' || k || '/' || ngram, ' ', '_'), replace('ngram' || n || '/' || part, ' ', '_') FROM sub WHERE part <> ngram AND strlen(part) >= 3""",
    "lock_expiry": f"{PQ.limits('CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) * 1000 + CAST(floor(value) AS BIGINT) * 60000000000 END', 7200)} SELECT name, seq, ready, expired FROM r",
}
