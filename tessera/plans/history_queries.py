"""Queries over edit histories. Events span a month, so episodes are cut at shorter times than a day."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import history as H
from tessera.runtime import table

DAYS = {"base": 0.02, "db": 0.02, "ml": 0.004}
SCALE = 2.0
SUBJECTS = 8


def _log(spark, sf_dir):
    return H.changelog(table(spark, sf_dir, "events"), F.get_json_object("props", "$.k").cast("long") % SUBJECTS)


def _options(kind):
    return {"kind": kind, "scale": SCALE, "days": DAYS[kind]}


LOG = f"""log AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % {SUBJECTS} AS subject, event_id AS seq, ts AS date, CASE WHEN user_id % 10 = 0 THEN 'Bot' ELSE 'user' END || user_id AS "user",
  CAST(floor(value) AS BIGINT) * CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS edit_delta, event_type AS message, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS revert, epoch_us(ts) * 1000 AS t FROM events)"""
UNDOS = f"""{LOG}, un AS (SELECT *, row_number() OVER o - 1 AS i, lag("user") OVER o AS last_user, lag(edit_delta, 1, 0) OVER o AS last_delta FROM log WINDOW o AS (PARTITION BY subject ORDER BY date, seq)),
undos AS (SELECT *, revert > 0 AND i > 1 AS explicit, revert > 0 AND i > 1 AND "user" IS DISTINCT FROM last_user AS issue, abs(edit_delta + last_delta) < last_delta / 10.0::DOUBLE AS effective FROM un)"""


def _episodes(kind: str) -> str:
    day = int(DAYS[kind] * H.DAY_NS)
    start = 0.0 if kind == "ml" else float(H.MINUTE_NS)
    gap = "t - lag(t, 1, 0) OVER o" if kind == "ml" else "greatest(t - lag(t, 1, 0) OVER o, 0)"
    after = "0.4::DOUBLE * {e} + 0.6::DOUBLE * g.gap::DOUBLE"
    test = {
        "base": f"g.gap > {SCALE}::DOUBLE * {{e}} AND g.t - coalesce({{b}}, g.t) > {day}",
        "db": f"g.gap > {day} AND g.t - coalesce({{b}}, g.t) > {day} AND g.gap > {SCALE}::DOUBLE * {{e}}",
        "ml": f"g.t - coalesce({{b}}, g.t) > {2 * day} AND g.gap > {after} AND g.gap > {10 * day}",
    }[kind]
    opened = "g.t" if kind == "base" else "NULL::BIGINT"

    def state(e, b):
        c = test.format(e=e, b=b)
        return f"{after.format(e=e)} AS ema, CASE WHEN {c} THEN {opened} ELSE coalesce({b}, g.t) END AS burst, {c} AS cut"

    return f"""{LOG}, g AS (SELECT *, row_number() OVER o - 1 AS i, {gap} AS gap FROM log WINDOW o AS (PARTITION BY subject ORDER BY date, seq)),
r AS (SELECT g.subject, g.i, {state(f'{start}::DOUBLE', 'NULL::BIGINT')} FROM g WHERE g.i = 0 UNION ALL SELECT g.subject, g.i, {state('r.ema', 'r.burst')} FROM r JOIN g ON g.subject = r.subject AND g.i = r.i + 1),
ep AS (SELECT g.*, cut OR lead(g.i) OVER o IS NULL AS closes, CAST(coalesce(sum(cut::INT) OVER (PARTITION BY g.subject ORDER BY g.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS INT) AS episode
  FROM g JOIN r USING (subject, i) WINDOW o AS (PARTITION BY g.subject ORDER BY g.i)),
et0 AS (SELECT subject, episode, count(*) AS edits, count(DISTINCT "user") AS users, CAST(sum(abs(edit_delta)) AS BIGINT) AS work, min(t) AS first, max(t) AS end_ns, max(CASE WHEN closes THEN gap END) AS gap_ns FROM ep GROUP BY subject, episode),
et AS (SELECT subject, episode, edits, users, work, {'coalesce(lag(end_ns) OVER (PARTITION BY subject ORDER BY episode), first)' if kind == 'base' else 'first'} AS begin_ns, end_ns, gap_ns FROM et0)"""


def _table(kind):
    def query(spark, sf_dir):
        return H.episode_table(_log(spark, sf_dir), **_options(kind)).select("subject", "episode", "edits", "users", "work", "begin_ns", "end_ns", "duration_ns", "gap_ns")

    return query


def gap_ema(spark, sf_dir):
    return H.gap_average(_log(spark, sf_dir)).select("subject", "events", F.round(F.col("average") / 1e9, 3).alias("average_s"))


def user_gap_ema(spark, sf_dir):
    return H.user_gap_average(_log(spark, sf_dir)).select("subject", "user", "edits", F.round(F.col("average") / 1e9, 3).alias("average_s"))


def undo_explicit(spark, sf_dir):
    return H.undos(_log(spark, sf_dir)).filter("explicit").select("subject", "seq", "user", "last_user", "issue")


def undo_effective(spark, sf_dir):
    return H.undos(_log(spark, sf_dir)).filter("effective").select("subject", "seq", "user", "edit_delta", "last_delta")


def user_roles(spark, sf_dir):
    return H.user_roles(_log(spark, sf_dir))


def user_lifetimes(spark, sf_dir):
    return H.user_lifetimes(_log(spark, sf_dir)).select("subject", "user", F.round("days", 6).alias("days"))


def user_changes(spark, sf_dir):
    return _log(spark, sf_dir).groupBy("subject", "user").agg(F.count(F.lit(1)).alias("changes"), F.sum("revert").alias("reverts"))


def cluster_hist(spark, sf_dir):
    found = H.cluster_histogram(H.episode_table(_log(spark, sf_dir), **_options("db")))
    return found.select("n", *[F.round(c, 8).alias(c) for c in ("p", "ln_n", "ln_p")])


def work_hist(spark, sf_dir):
    found = H.cluster_histogram(H.episode_table(_log(spark, sf_dir), **_options("ml")).filter("work > 0"), "work")
    return found.select("n", *[F.round(c, 8).alias(c) for c in ("p", "ln_n", "ln_p")])


def alignment_spectrum(spark, sf_dir):
    return H.alignment_spectrum(_log(spark, sf_dir), **_options("ml"))


def value_frequency(spark, sf_dir):
    return H.frequency(H.user_roles(_log(spark, sf_dir)).select("reverts"), "reverts")


def interval_overlaps(spark, sf_dir):
    return H.interval_overlaps(_log(spark, sf_dir), **_options("db"))


def topic_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    articles = docs.groupBy((F.col("doc_id") % SUBJECTS).alias("subject")).agg(
        F.sum(F.octet_length("text")).alias("bytes"), F.sum("n_chars").alias("history_bytes"), F.count(F.lit(1)).alias("sentences"), F.sum((F.col("n_chars") > 1000).cast("int")).alias("history_sentences")
    )
    found = H.topic_summary(_log(spark, sf_dir), articles, **_options("db"))
    return found.select("subject", "users", "episodes", "edits", *[F.round(c, 8).alias(c if len(c) > 1 else f"v_{c}") for c in ("L", "LL", "N", "NL", "I", "W", "U", "M", "TG", "TU", "BF", "burst")])


def episode_flags(spark, sf_dir):
    return H.episode_flags(_log(spark, sf_dir), **_options("ml")).select("subject", "episode", F.array_join("flags", ",").alias("flags"))


def no_bots(spark, sf_dir):
    log = H.changelog(table(spark, sf_dir, "events"), F.get_json_object("props", "$.k").cast("long") % SUBJECTS, no_bots=True)
    return log.groupBy("subject").agg(F.count(F.lit(1)).alias("edits"), F.count_distinct("user").alias("users"))


def assess_changes(spark, sf_dir):
    """Each document in place of its subject's document before it; the message is its first line."""
    text = F.coalesce("text", F.lit(""))
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("subject"), F.col("doc_id").alias("ord"), text.alias("added"), F.get(F.split(text, "\n", 2), F.lit(0)).alias("message"), (F.length(text) % 97).cast("double").alias("intent"))
    measured = H.measure_changes(d).drop("added", "message")
    before = F.lag("added_bytes", 1, 0).over(Window.partitionBy("subject").orderBy("ord"))
    changes = measured.withColumn("removed_bytes", before)
    return H.assess_changes(changes).select("subject", "ord", "assessment", F.array_join("flags", ",").alias("flags"), F.round("sigma", 6).alias("sigma"))


def next_event_links(spark, sf_dir):
    w = H.ordered()
    log = _log(spark, sf_dir).withColumn("previous", F.lag("seq").over(w))
    return log.filter("previous is not null").select("subject", F.col("previous").alias("from_seq"), F.col("seq").alias("to_seq"))


QUERIES = {f"episodes_{k}": _table(k) for k in ("base", "db", "ml")} | {
    f.__name__: f
    for f in (
        gap_ema, user_gap_ema, undo_explicit, undo_effective, user_roles, user_lifetimes, user_changes, cluster_hist, work_hist, alignment_spectrum, value_frequency, interval_overlaps, topic_summary,
        episode_flags, no_bots, assess_changes, next_event_links,
    )
}

_ROLES = """, ro AS (SELECT subject, "user", count(*) AS changes, CAST(sum(CASE WHEN explicit THEN revert ELSE 0 END + effective::INT) AS BIGINT) AS reverts FROM undos GROUP BY subject, "user"),
roles AS (SELECT *, CASE WHEN reverts = changes THEN 'correctional' WHEN reverts > 1 AND reverts / changes::DOUBLE > 0.3 THEN 'contentious' END AS role FROM ro WHERE reverts > 0)"""


def _fold(keys: str) -> str:
    return f"""{LOG}, x AS (SELECT {keys}, t, seq, date, row_number() OVER o AS i, greatest(t - lag(t{', 1, 0' if keys == 'subject' else ''}) OVER o, 0)::DOUBLE AS gap FROM log WINDOW o AS (PARTITION BY {keys} ORDER BY date, seq)),
l AS (SELECT {keys}, count(*) AS n, list_prepend({float(H.MINUTE_NS)}::DOUBLE, coalesce(list(gap ORDER BY i) FILTER ({"true" if keys == "subject" else "i > 1"}), [])) AS gs FROM x GROUP BY {keys})
SELECT {keys}, n AS {"events" if keys == "subject" else "edits"}, round(list_reduce(gs, lambda a, b: 0.4::DOUBLE * a + 0.6::DOUBLE * b) / 1e9, 3) AS average_s FROM l"""


def _hist(kind: str, size: str, where: str = "true") -> str:
    return f"WITH RECURSIVE {_episodes(kind)}, h AS (SELECT {size}::DOUBLE AS n, count(*)::DOUBLE AS h FROM et WHERE {where} GROUP BY 1), q AS (SELECT n, h / sum(h) OVER () AS p FROM h) SELECT n, round(p, 8) AS p, round(ln(n), 8) AS ln_n, round(ln(p), 8) AS ln_p FROM q"


ORACLES = {f"episodes_{k}": f"WITH RECURSIVE {_episodes(k)} SELECT subject, episode, edits, users, work, begin_ns, end_ns, end_ns - begin_ns AS duration_ns, gap_ns FROM et" for k in ("base", "db", "ml")} | {
    "gap_ema": f"WITH {_fold('subject')}",
    "user_gap_ema": f"WITH {_fold('subject, \"user\"')}",
    "undo_explicit": f'WITH {UNDOS} SELECT subject, seq, "user", last_user, issue FROM undos WHERE explicit',
    "undo_effective": f'WITH {UNDOS} SELECT subject, seq, "user", edit_delta, last_delta FROM undos WHERE effective',
    "user_roles": f"WITH {UNDOS}{_ROLES} SELECT * FROM roles",
    "user_lifetimes": f'WITH {LOG} SELECT * FROM (SELECT subject, "user", round((max(t) - min(t)) / 86400000000000.0::DOUBLE, 6) AS days FROM log GROUP BY subject, "user" HAVING (max(t) - min(t)) / 86400000000000.0::DOUBLE > 1)',
    "user_changes": f'WITH {LOG} SELECT subject, "user", count(*) AS changes, CAST(sum(revert) AS BIGINT) AS reverts FROM log GROUP BY subject, "user"',
    "cluster_hist": _hist("db", "users"),
    "work_hist": _hist("ml", "work", "work > 0"),
    "alignment_spectrum": f"""WITH RECURSIVE {_episodes('ml')}, al AS (SELECT sum(edit_delta)::DOUBLE AS d, sum(abs(edit_delta))::DOUBLE AS a FROM ep GROUP BY subject, episode),
cl AS (SELECT CAST(trunc(d / a / 0.05::DOUBLE) AS INT) AS class, count(*) AS count FROM al WHERE a <> 0 GROUP BY 1) SELECT class, count, CAST(row_number() OVER (ORDER BY class) - 1 AS INT) AS idx FROM cl""",
    "value_frequency": f"WITH {UNDOS}{_ROLES} SELECT reverts, count(*) AS count, CAST(row_number() OVER (ORDER BY reverts) - 1 AS INT) AS idx FROM roles GROUP BY reverts",
    "interval_overlaps": f"""WITH RECURSIVE {_episodes('db')}, nu AS (SELECT subject, episode, "user", row_number() OVER (PARTITION BY subject, episode ORDER BY date, seq) AS k FROM ep),
sp AS (SELECT subject, episode, "user", min(k) AS s, max(k) AS e FROM nu GROUP BY subject, episode, "user")
SELECT a.subject, a.episode, a."user", count(*) AS partners FROM sp a JOIN sp b ON a.subject = b.subject AND a.episode = b.episode AND a."user" <> b."user" AND a.s <= b.e + 5 AND b.s <= a.e + 5 GROUP BY 1, 2, 3""",
    "topic_summary": f"""WITH RECURSIVE {_episodes('db')}, be AS (SELECT subject, count(*) AS episodes, sum(users) AS ie, sum(end_ns - begin_ns)::DOUBLE AS time, CAST(sum(edits) AS BIGINT) AS edits, sum((end_ns - begin_ns)::DOUBLE / users) AS pu FROM et GROUP BY subject),
pe AS (SELECT subject, count(DISTINCT "user") AS users, count(DISTINCT CASE WHEN contains("user", 'Bot') OR ends_with("user", 'bot') THEN "user" END) AS bots FROM log GROUP BY subject),
un AS (SELECT *, row_number() OVER o - 1 AS i, lag("user") OVER o AS last_user, lag(edit_delta, 1, 0) OVER o AS last_delta FROM log WINDOW o AS (PARTITION BY subject ORDER BY date, seq)),
iss AS (SELECT subject, sum((revert > 0 AND i > 1 AND "user" IS DISTINCT FROM last_user)::INT + (abs(edit_delta + last_delta) < last_delta / 10.0::DOUBLE)::INT) AS issues FROM un GROUP BY subject),
ar AS (SELECT doc_id % {SUBJECTS} AS subject, sum(strlen(text))::DOUBLE AS l, sum(n_chars)::DOUBLE AS h, count(*)::DOUBLE AS big, sum((n_chars > 1000)::INT)::DOUBLE AS small FROM documents GROUP BY 1)
SELECT subject, users, episodes, edits, round(l, 8) AS "v_L", round(ln(l), 8) AS "LL", round(ie / (episodes + 1)::DOUBLE, 8) AS "v_N", round(ln(ie / (episodes + 1)::DOUBLE), 8) AS "NL", round(issues / l, 8) AS "v_I", round(h / l, 8) AS "v_W", round(small / big, 8) AS "v_U",
round(small / h, 8) AS "v_M", round(time / (episodes + 1) / 86400000000000.0::DOUBLE, 8) AS "TG", round(pu / (episodes + 1) / 86400000000000.0::DOUBLE, 8) AS "TU", round(coalesce(bots / nullif(users - bots, 0)::DOUBLE, 0), 8) AS "BF", round(edits / (episodes + 1)::DOUBLE, 8) AS burst
FROM be JOIN pe USING (subject) JOIN iss USING (subject) JOIN ar USING (subject)""",
    "episode_flags": f"""WITH RECURSIVE {_episodes('ml')}, un AS (SELECT subject, seq, "user", edit_delta, revert, row_number() OVER o - 1 AS i, lag("user") OVER o AS last_user, lag(edit_delta, 1, 0) OVER o AS last_delta FROM log WINDOW o AS (PARTITION BY subject ORDER BY date, seq)),
fl AS (SELECT subject, seq, revert > 0 AND i > 1 AS explicit, revert > 0 AND i > 1 AND "user" IS DISTINCT FROM last_user AS issue, abs(edit_delta + last_delta) < last_delta / 10.0::DOUBLE AS effective FROM un)
SELECT ep.subject, ep.episode, concat_ws(',', CASE WHEN bool_or(effective) THEN 'effective_undo' END, CASE WHEN bool_or(explicit) THEN 'explicit_undo' END, CASE WHEN bool_or(issue) THEN 'state_of_contention' END, CASE WHEN bool_or(explicit OR effective) THEN 'state_of_uncertainty_about_article' END) AS flags
FROM ep JOIN fl ON ep.subject = fl.subject AND ep.seq = fl.seq GROUP BY ep.subject, ep.episode""",
    "no_bots": f"""WITH {LOG} SELECT subject, count(*) AS edits, count(DISTINCT "user") AS users FROM log WHERE NOT (contains("user", 'Bot') OR ends_with("user", 'bot')) GROUP BY subject""",
    "assess_changes": f"""WITH c AS (SELECT doc_id % 5 AS subject, doc_id AS ord, coalesce(text, '') AS added, coalesce(lag(coalesce(text, '')) OVER (PARTITION BY doc_id % 5 ORDER BY doc_id), '') AS removed, lower(string_split(coalesce(text, ''), chr(10))[1]) AS message, (length(coalesce(text, '')) % 97)::DOUBLE AS intent FROM documents),
m AS (SELECT *, list(intent) OVER (ORDER BY ord ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS xs FROM c),
a AS (SELECT *, list_reduce(list_prepend(0.0::DOUBLE, xs), lambda p, q: 0.5::DOUBLE * p + 0.5::DOUBLE * q) AS mean, abs(strlen(added) - strlen(removed)) > 1000 AS lg, strlen(removed) > strlen(added) * 10 AS dl FROM m),
s AS (SELECT *, CASE WHEN mean = 0 THEN 0 ELSE abs(intent - mean) / abs(mean) END AS sigma FROM a)
SELECT subject, ord, CASE WHEN lg OR dl THEN 'potential_trustworthinss_low' ELSE 'potential_trustworthiness_ok' END AS assessment, concat_ws(',', CASE WHEN lg THEN 'large_edit' END, CASE WHEN dl THEN 'large_deletion' END,
CASE WHEN len(list_filter([{', '.join(repr(x) for x in H.BAD_SIGNALS)}], lambda x: contains(message, x))) > 0 THEN 'counter_policy_message' END, CASE WHEN sigma > 1.5 THEN 'anomalous_message' END, CASE WHEN (lg OR dl) AND contains(added, 'http') THEN 'url_warning' END) AS flags, round(sigma, 6) AS sigma FROM s""",
    "next_event_links": f"WITH {LOG} SELECT * FROM (SELECT subject, lag(seq) OVER (PARTITION BY subject ORDER BY date, seq) AS from_seq, seq AS to_seq FROM log) WHERE from_seq IS NOT NULL",
}
