"""Column functions over strings: predicates, names, word runs and intentionality."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that no phrase ends or starts with, and phrases of legal notices.
ENDINGS = (
    "but", "and", "the", "or", "a", "an", "its", "it's", "their", "your", "my", "of", "as", "are", "is", "be", "with", "using", "that", "who", "to", "no",
    "because", "at", "yes", "yeah", "yay", "in",
)
STARTERS = ("and", "or", "of", "the", "it", "because", "in", "that", "these", "those", "is", "are", "was", "were", "but", "yes", "no", "yeah", "yay")
LEGAL = ("terms may appl", "Creative Commons", "last edited", "Terms of Use", "Privacy Policy")
#: (pattern, replacement), in this order. A full stop is marked by #.
CLEANING = (
    (r"<[^>]*>", ""),
    (r"\\[^ –\n]+", " "),
    (r"[–{&}“”#%^+_=$’~‘/<>\"]+", ""),
    (r"[:;]+", "."),
    (r"([^.,: ][\n])+", "{whole}:"),
    (r"[^- a-zA-ZåøæÅØÆ.:,()!?\n]+", ""),
    (r"[?!.]+", "{whole}#"),
    (r"[ \n]+", " "),
)
LEVELS = (1, 2, 3, 4, 5, 6)
MIN_COUNT, MIN_BYTES, CUTOFF, LEG = 3, 5, 0.3, 100


def let(value: Column, then) -> Column:
    """then(value), with the value computed once a row, wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def clean(text: Column) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1].format(whole="$0")), CLEANING, F.coalesce(text, F.lit("")))


def question_marks(text: Column) -> Column:
    """A # after each question mark before a space, and a space at the end."""
    return F.concat(F.regexp_replace(text, r"\?(?= )", "?#"), F.lit(" "))


def split_sentences(cleaned: Column, pattern: str = r"[^\n]#") -> Column:
    return F.filter(F.transform(F.split(cleaned, pattern), lambda x: F.btrim(x, F.lit(" "))), lambda x: x != "")


def words(sentence: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(sentence, r"[/()]", "")), r"[,.;:!? ]+"), lambda x: x != "")


def bound(first: Column, last: Column) -> Column:
    """A phrase that starts or ends with a word that binds to its neighbours, or with a single byte."""
    return (F.octet_length(first) == 1) | (F.octet_length(last) == 1) | last.isin(*ENDINGS) | first.isin(*STARTERS)


def ngrams(w: Column, n: int, keep_bound: bool = False) -> Column:
    """n, ngram, pos (place of the last word, from 1) of each run of n words."""
    spots = F.sequence(F.lit(n), F.size(w))
    if n > 1 and not keep_bound:
        spots = F.filter(spots, lambda i: ~bound(F.get(w, i - n), F.get(w, i - 1)))
    made = F.transform(spots, lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(w, i - n + 1, n), " ").alias("ngram"), i.alias("pos")))
    return F.when(F.size(w) >= n, made).otherwise(F.array().cast("array<struct<n:int,ngram:string,pos:int>>"))


def intentionality(count: Column, ngram: Column, sentences: Column, leg: int = LEG) -> Column:
    """Frequency times length, damped where repetition outgrows the text."""
    rate = count / F.lit(float(leg))
    value = rate * F.octet_length(ngram) / (1 + F.exp(rate - sentences / F.lit(float(leg))))
    return F.when((count < MIN_COUNT) | (F.octet_length(ngram) < MIN_BYTES), F.lit(0.0)).otherwise(value)


def bracketed(s: Column) -> Column:
    return s.startswith("[") | s.endswith("]")


def is_code(s: Column, strict: bool = True) -> Column:
    tests = [s.contains("{"), s.endswith("}"), s.endswith("^"), s.contains("Categories :"), s.contains("Hidden categories :")]
    if strict:
        tests += [s.contains("="), s.contains("http"), s.contains("/"), s.endswith(":")]
    return reduce(or_, tests)


def is_legal(s: Column) -> Column:
    return reduce(or_, [s.contains(x) for x in LEGAL])


def is_bot(user: Column) -> Column:
    return user.contains("Bot") | user.endswith("bot")


def is_anonymous(user: Column) -> Column:
    """Named by an address: three dots, or more than two colons."""
    return (F.regexp_count(user, F.lit(r"\.")) == 3) | (F.regexp_count(user, F.lit(":")) > 2)


def key_name(s: Column, number: Column | None = None) -> Column:
    """A key: the first 40 bytes; what cannot be printed becomes x, other than letters and digits -, in lower case.

    Bytes beyond ASCII are read as they come, so a character cut in two counts as one.
    """
    head = F.decode(F.substring(F.encode(s, "UTF-8"), 1, 40), "UTF-8") if s is not None else s
    made = F.lower(F.regexp_replace(F.regexp_replace(head, r"[\x00-\x1F\x7F]", "x"), r"[^a-zA-Z0-9]", "-"))
    return made if number is None else F.concat(made, F.lit("_"), number.cast("string"))


def invariant_description(s: Column) -> Column:
    return F.btrim(F.btrim(F.replace(s, F.lit("  "), F.lit(" ")), F.lit("\n ")), F.lit(" "))


# Fixed values of an assessment.
ASSESSMENTS = {"potential_trustworthiness_high": 1.0, "potential_trustworthiness_ok": 0.5, "potential_trustworthinss_low": 0.25, "potential_untrusted": 0.0}


def assess_result(s: Column, levels: dict[str, float] = ASSESSMENTS) -> Column:
    """The level whose name the reply holds; none counts as 0."""
    found = F.lit(0.0)
    for name, value in reversed(levels.items()):
        found = F.when(s.contains(name), F.lit(value)).otherwise(found)
    return found
