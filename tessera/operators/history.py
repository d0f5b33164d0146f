"""Event histories: gaps, episodes, contention, roles, topic summaries.

A changelog has subject, seq (its order: by date, ties by id), date, user, edit_delta, message, revert. All but the
episode boundary are window functions and aggregates by subject. The boundary feeds back (where an episode starts
depends on where the last one ended), so it is a fold over a subject's sorted events that holds three numbers.

Defined results: a null subject or user is one of its own; the columns t, gap, i, episode and closes are the operators',
and replace any of those names; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import is_bot
from tessera.operators.prism import running_before
from tessera.runtime import fold_rows

MINUTE_NS, DAY_NS = 60 * 10**9, 86400 * 10**9
SCALE = 10.0
#: Rows of a block in which a running mean is formed.
AVERAGED = 1 << 14


def changelog(events: DataFrame, subject: Column, no_bots: bool = False) -> DataFrame:
    """events(event_id, ts, user_id, event_type, value) as edits: errors are reversions."""
    frame = events.select(
        subject.alias("subject"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("date"),
        F.concat(F.when(F.col("user_id") % 10 == 0, F.lit("Bot")).otherwise(F.lit("user")), F.col("user_id").cast("string")).alias("user"),
        (F.floor("value") * F.when(F.col("event_type") == "error", -1).otherwise(1)).cast("long").alias("edit_delta"),
        F.col("event_type").alias("message"),
        (F.col("event_type") == "error").cast("int").alias("revert"),
    )
    return frame.filter(~is_bot(F.col("user"))) if no_bots else frame


def ordered(by: str = "subject", *more: str) -> Window:
    return Window.partitionBy(by, *more).orderBy("date", "seq")


def ns(ts: Column) -> Column:
    """Nanoseconds since 1970, whatever the session's time zone: times without a zone count as UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) * 1000


def gaps(log: DataFrame, keep_negative: bool = False) -> DataFrame:
    """`log` with t (ns), gap (ns; the first counts from 0) and i (from 0)."""
    w = ordered()
    frame = log.withColumn("t", ns(F.col("date"))).withColumn("i", F.row_number().over(w) - 1)
    gap = F.col("t") - F.lag("t", 1, 0).over(w)
    return frame.withColumn("gap", gap if keep_negative else F.greatest(gap, F.lit(0)))


def running_average(frame: DataFrame, keys: list[str], order: list[str], block: Column, value: str, start: float, keep: float = 0.4, take: float = 0.6) -> DataFrame:
    """keys, rows, average: `keep` of what was and `take` of each value, in order, from `start`; null values are passed over.

    It is a weighted sum, so blocks of each key (which rise with the order) are summed apart and joined by the number of
    values after them: no row and no state holds a key's values.
    """
    blocked = frame.withColumn("block", block)
    latest = Window.partitionBy(*keys, "block").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    after = F.coalesce(F.count(value).over(latest), F.lit(0))
    parts = blocked.withColumn("after", after).groupBy(*keys, "block").agg(
        F.count(F.lit(1)).alias("rows"), F.count(value).alias("n"), F.sum(take * F.pow(F.lit(keep), F.col("after")) * F.col(value)).alias("part")
    )
    later = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = start * F.pow(F.lit(keep), F.sum("n")) + F.coalesce(F.sum(F.pow(F.lit(keep), F.col("later")) * F.col("part")), F.lit(0.0))
    return parts.withColumn("later", later).groupBy(*keys).agg(F.sum("rows").alias("rows"), total.alias("average"))


def gap_average(log: DataFrame, start: float = float(MINUTE_NS)) -> DataFrame:
    """subject, events, average: the running average gap after the last event."""
    found = running_average(gaps(log), ["subject"], ["i"], F.floor(F.col("i") / AVERAGED), "gap", start)
    return found.withColumnRenamed("rows", "events")


def user_gap_average(log: DataFrame) -> DataFrame:
    """subject, user, edits, average: gaps of each user's own edits, from a minute on."""
    w = ordered("subject", "user")
    own = log.withColumn("t", ns(F.col("date"))).withColumn("i", F.row_number().over(w)).withColumn("gap", F.when(F.col("i") > 1, F.greatest(F.col("t") - F.lag("t").over(w), F.lit(0))))
    found = running_average(own, ["subject", "user"], ["i"], F.floor(F.col("i") / AVERAGED), "gap", float(MINUTE_NS))
    return found.withColumnRenamed("rows", "edits")


def _closes(kind: str, scale: float, days: float):
    """Whether an episode ends, by gap, length so far and the average gap before and after this one."""
    day = int(days * DAY_NS)
    return {
        "base": lambda gap, length, before, after: gap > scale * before and length > day,
        "db": lambda gap, length, before, after: gap > day and length > day and gap > scale * before,
        "ml": lambda gap, length, before, after: length > 2 * day and gap > after and gap > 10 * day,
    }[kind]


def episodes(log: DataFrame, kind: str = "db", scale: float = SCALE, days: float = 1.0) -> DataFrame:
    """`log` with t, gap, i, episode (from 1) and closes: whether the event is the last of its episode.

    kind: "base" (a burst starts at the event that closed the last one), "db" or "ml" (at the next event).
    days: the shortest episode and, for db, the shortest gap; ml asks for twice and ten times as much.
    A null subject is a subject; events without a date come first and close nothing.
    """
    ends = _closes(kind, scale, days)

    def step(state, t, gap, last):
        average, burst, episode = state
        if t is None or gap is None:
            return state, (episode, last)
        burst = t if burst is None else burst
        after = 0.4 * average + 0.6 * gap
        cut = ends(gap, t - burst, average, after)
        opened = (t if kind == "base" else None) if cut else burst
        return (after, opened, episode + cut), (episode, cut or last)

    frame = gaps(log, keep_negative=kind == "ml").withColumn("last", F.lead("i").over(ordered()).isNull())
    start = (0.0 if kind == "ml" else float(MINUTE_NS), None, 1)
    return fold_rows(frame, ["subject"], ["i"], ["t", "gap", "last"], start, step, "episode int, closes boolean").drop("last")


def episode_table(log: DataFrame, kind: str = "db", **options) -> DataFrame:
    """subject, episode, edits, users, work (sum of absolute deltas), begin_ns, end_ns, duration_ns, gap_ns (before the closing event)."""
    found = episodes(log, kind, **options)
    made = found.groupBy("subject", "episode").agg(
        F.count(F.lit(1)).alias("edits"), F.count_distinct("user").alias("users"), F.sum(F.abs("edit_delta")).alias("work"),
        F.min("t").alias("first"), F.max("t").alias("end_ns"), F.max(F.when(F.col("closes"), F.col("gap"))).alias("gap_ns"),
    )
    begin = F.coalesce(F.lag("end_ns").over(Window.partitionBy("subject").orderBy("episode")), F.col("first")) if kind == "base" else F.col("first")
    return made.withColumn("begin_ns", begin).withColumn("duration_ns", F.col("end_ns") - F.col("begin_ns")).drop("first")


def undos(log: DataFrame) -> DataFrame:
    """`log` with i, explicit (a reversion, not in the first two rows), issue (of another user's edit) and effective
    (the edit cancels nine tenths of the one before)."""
    w = ordered()
    frame = log.withColumn("i", F.row_number().over(w) - 1).withColumn("last_user", F.lag("user").over(w)).withColumn("last_delta", F.lag("edit_delta", 1, 0).over(w))
    explicit = (F.col("revert") > 0) & (F.col("i") > 1)
    effective = F.abs(F.col("edit_delta") + F.col("last_delta")) < F.col("last_delta") / 10.0
    return frame.withColumn("explicit", explicit).withColumn("issue", explicit & ~F.col("user").eqNullSafe(F.col("last_user"))).withColumn("effective", effective)


def user_roles(log: DataFrame) -> DataFrame:
    """subject, user, changes, reverts, role: of users who undid anything."""
    made = undos(log).groupBy("subject", "user").agg(
        F.count(F.lit(1)).alias("changes"), F.sum(F.when(F.col("explicit"), F.col("revert")).otherwise(0) + F.col("effective").cast("int")).alias("reverts")
    )
    share = F.col("reverts") / F.col("changes")
    role = F.when(F.col("reverts") == F.col("changes"), "correctional").when((F.col("reverts") > 1) & (share > 0.3), "contentious")
    return made.filter("reverts > 0").withColumn("role", role)


def user_lifetimes(log: DataFrame) -> DataFrame:
    """subject, user, days: between first and last edit, where more than one."""
    days = (F.max(ns(F.col("date"))) - F.min(ns(F.col("date")))) / F.lit(float(DAY_NS))
    return log.groupBy("subject", "user").agg(days.alias("days")).filter("days > 1")


def cluster_histogram(table: DataFrame, size: str = "users") -> DataFrame:
    """n, p, ln_n, ln_p: how often groups of n meet."""
    counts = table.groupBy(F.col(size).cast("double").alias("n")).agg(F.count(F.lit(1)).alias("h"))
    p = F.col("h") / F.sum("h").over(Window.partitionBy())
    return counts.select("n", p.alias("p"), F.ln("n").alias("ln_n"), F.ln(p).alias("ln_p"))


def alignment_spectrum(log: DataFrame, kind: str = "ml", **options) -> DataFrame:
    """class, count, idx (place in order of class): episodes by the sum of their deltas over the absolute sum."""
    each = episodes(log, kind, **options).groupBy("subject", "episode").agg(F.sum("edit_delta").alias("d"), F.sum(F.abs("edit_delta")).alias("a")).filter("a <> 0")
    made = each.select((F.col("d") / F.col("a") / 0.05).cast("int").alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("count"))
    return made.withColumn("idx", F.row_number().over(Window.orderBy("class")) - 1)


def frequency(values: DataFrame, value: str) -> DataFrame:
    """value, count, idx: how often each value occurs, and its place in order."""
    return values.groupBy(value).agg(F.count(F.lit(1)).alias("count")).withColumn("idx", F.row_number().over(Window.orderBy(value)) - 1)


def interval_overlaps(log: DataFrame, horizon: int = 5, **options) -> DataFrame:
    """subject, episode, user, partners: users of an episode whose spans of event numbers, widened by the horizon, meet.

    All users of an episode are partners but those who end before a span or start after it: two counts in order, no pairs.
    """
    found = episodes(log, **options)
    numbered = found.withColumn("k", F.row_number().over(Window.partitionBy("subject", "episode").orderBy("date", "seq")))
    spans = numbered.groupBy("subject", "episode", "user").agg(F.min("k").alias("s"), F.max("k").alias("e"))
    s, e = F.col("s"), F.col("e")

    def point(axis: int, x: Column, counts: int) -> Column:
        return F.struct(F.lit(axis).alias("axis"), x.alias("x"), F.lit(counts).alias("counts"))

    points = spans.select("subject", "episode", "user", F.inline(F.array(point(0, e, 1), point(0, s - horizon, 0), point(1, -s, 1), point(1, -e - horizon, 0))))
    axis = Window.partitionBy("subject", "episode", "axis")
    below = F.sum("counts").over(axis.orderBy("x", "counts").rowsBetween(Window.unboundedPreceding, 0))
    asked = points.withColumn("below", below).withColumn("all", F.sum("counts").over(axis)).filter("counts = 0")
    partners = F.max("all") - 1 - F.sum("below")
    return asked.groupBy("subject", "episode", "user").agg(partners.alias("partners")).filter("partners > 0")


def topic_summary(log: DataFrame, articles: DataFrame, kind: str = "db", **options) -> DataFrame:
    """One row for each subject: L, LL, N, NL, I, W, U, M, TG, TU, BF and the users, episodes and edits behind them.

    articles: subject, bytes, history_bytes, sentences, history_sentences. Undefined ratios are 0; a trailing empty episode counts, as an episode is opened after each close.
    """
    marked = episode_table(log, kind, **options)
    by_episode = marked.groupBy("subject").agg(F.count(F.lit(1)).alias("episodes"), F.sum("users").alias("in_episodes"), F.sum("duration_ns").alias("time"), F.sum("edits").alias("edits"), F.sum(F.try_divide(F.col("duration_ns").cast("double"), F.col("users").cast("double"))).alias("per_user"))
    people = log.select("subject", "user").distinct().groupBy("subject").agg(F.count(F.lit(1)).alias("users"), F.sum(is_bot(F.col("user")).cast("int")).alias("bots"))
    issues = undos(log).groupBy("subject").agg(F.sum(F.col("issue").cast("int") + F.col("effective").cast("int")).alias("issues"))
    all_ = by_episode.join(people, "subject").join(issues, "subject").join(articles, "subject")

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    c = F.col
    opened = c("episodes") + 1
    n = c("in_episodes") / opened
    return all_.select(
        "subject", c("bytes").cast("double").alias("L"), F.ln(c("bytes").cast("double")).alias("LL"), n.alias("N"), F.ln(n).alias("NL"), ratio(c("issues"), c("bytes")).alias("I"), ratio(c("history_bytes"), c("bytes")).alias("W"),
        ratio(c("history_sentences"), c("sentences")).alias("U"), ratio(c("history_sentences"), c("history_bytes")).alias("M"), (c("time") / opened / DAY_NS).alias("TG"), (c("per_user") / opened / DAY_NS).alias("TU"), ratio(c("bots"), c("users") - c("bots")).alias("BF"),
        "users", "episodes", "edits", (c("edits") / opened).alias("burst"),
    )


# Words in messages that count as signals.
BAD_SIGNALS = ("fuck", "cunt", "bastard", "unhelpful", "unfair", "too", "deceiv", "deceptive", "terrorism", "justice", "unsourced")


def bad_signal(message: Column) -> Column:
    return F.exists(F.array(*map(F.lit, BAD_SIGNALS)), lambda x: F.contains(F.lower(message), x))


def measure_changes(changes: DataFrame) -> DataFrame:
    """`changes` with added_bytes, url, bad: what assess_changes asks of texts, so that they need not be dealt."""
    added = F.coalesce("added", F.lit(""))
    return changes.withColumns({"added_bytes": F.octet_length(added), "url": F.contains("added", F.lit("http")), "bad": bad_signal(F.col("message"))})


def assess_changes(changes: DataFrame, limit: int = 1000) -> DataFrame:
    """`changes` (added, removed, message, intent, ord) with assessment, flags (names) and sigma: how far the intent is from the running mean.

    The mean runs over all subjects together, in order of `ord`, which no two rows share. Instead of the three texts, changes
    may have removed_bytes and what measure_changes gives.
    """
    if "removed_bytes" in changes.columns:
        add, rm, url, bad = (F.col(c) for c in ("added_bytes", "removed_bytes", "url", "bad"))
    else:
        add, rm = F.octet_length(F.coalesce("added", F.lit(""))), F.octet_length(F.coalesce("removed", F.lit("")))
        url, bad = F.contains("added", F.lit("http")), bad_signal(F.col("message"))
    large, deletion = F.abs(add - rm) > limit, rm > add * 10
    # Rows go to blocks by their place in the whole order, each with the 63 before it: older terms weigh less than 2^-63.
    places = running_before(changes.select("ord", "intent", F.lit(1).alias("one")), [], "ord", "one", "place").select("ord", "intent", "place")
    own = F.floor(F.col("place") / AVERAGED)
    late = F.pmod("place", F.lit(AVERAGED)) >= AVERAGED - 63
    dealt = places.select("*", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))).alias("block"))
    recent = Window.partitionBy("block").orderBy("place").rowsBetween(-63, 0)
    mean = F.aggregate(F.collect_list("intent").over(recent), F.lit(0.0), lambda a, x: 0.5 * a + 0.5 * x)
    means = dealt.withColumn("mean", mean).filter(F.col("block") == own).select("ord", "mean")
    scored = changes.join(means, "ord").withColumn("sigma", F.coalesce(F.try_divide(F.abs(F.col("intent") - F.col("mean")), F.abs("mean")), F.lit(0.0)))
    flags = F.array_compact(
        F.array(
            F.when(large, F.lit("large_edit")), F.when(deletion, F.lit("large_deletion")), F.when(bad, F.lit("counter_policy_message")), F.when(F.col("sigma") > 1.5, F.lit("anomalous_message")),
            F.when((large | deletion) & url, F.lit("url_warning")),
        )
    )
    level = F.when(large | deletion, F.lit("potential_trustworthinss_low")).otherwise(F.lit("potential_trustworthiness_ok"))
    return scored.withColumn("assessment", level).withColumn("flags", flags)


def episode_flags(log: DataFrame, kind: str = "ml", **options) -> DataFrame:
    """subject, episode, flags: the context that each episode shows, in order of name."""
    marked = undos(log).select("subject", "seq", "explicit", "issue", "effective")
    joined = episodes(log, kind, **options).join(marked, ["subject", "seq"])
    has = {name: F.max(F.col(c).cast("int")) == 1 for name, c in (("explicit_undo", "explicit"), ("effective_undo", "effective"), ("state_of_contention", "issue"))}
    doubt = F.max((F.col("explicit") | F.col("effective")).cast("int")) == 1
    made = joined.groupBy("subject", "episode").agg(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in has.items()], F.when(doubt, F.lit("state_of_uncertainty_about_article")))).alias("flags"))
    return made.withColumn("flags", F.array_sort("flags"))
