"""Words of a text as Spark columns. White space is ASCII: space and \\x09-\\x0D."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
#: Everything in ASCII that is neither a letter nor a digit, capitals included: texts are lower-cased first.
MARKS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
MARK_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _parts(trimmed: Column, pattern: str) -> Column:
    return F.when(F.coalesce(F.octet_length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, pattern))


def count_words(text: Column) -> Column:
    """Number of runs of other characters than white space (long); 0 for null."""
    return F.size(_parts(F.btrim(text, F.lit(SPACE)), SPACES)).cast("long")


def space_words(text: Column) -> Column:
    """The runs of other characters than white space; an empty array for null."""
    return _parts(F.btrim(text, F.lit(SPACE)), SPACES)


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, all else as it is. Texts of ASCII alone take the faster lower()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and characters beyond ASCII; an empty array for null."""
    return _parts(F.btrim(lower_ascii(text), F.lit(MARKS)), MARK_RUN)


def let(value: Column, then) -> Column:
    """then(value), with the value computed once a row.

    A column that is only named can be put in the place of its name by the optimizer, also within a lambda
    function, where it would be computed anew for each element. A lambda's own variable cannot.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def unpacked(name: str, columns: list[str], *but: str) -> list[Column]:
    """The columns of a struct made by packed, without those named in `but`, which give way to others."""
    return [F.col(f"{name}.`{c}`").alias(c) for c in columns if c not in but]


def packed(docs: DataFrame, name: str, *columns: str) -> DataFrame:
    """All columns of `docs` as one struct, beside the columns named: whatever names they have, none clashes."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name), *[F.col(c) for c in dict.fromkeys(columns)])
