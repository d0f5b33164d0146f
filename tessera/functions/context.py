"""Fuzzy Boolean context expressions, compiled to columns.

`a | b` is the sum, `a & b` and `a . b` the product, `!a` 1 where a is not above 0, else 0; an unknown symbol is 0.
Symbols are letters, digits and underscores. Parsing is done once on the driver; nothing is interpreted for a row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(text: str):
    """A tree of ("or", parts), ("and", parts), ("not", part), ("symbol", name); ValueError if it is none."""
    tokens = re.findall(r"\w+|[()!]|[|]+|[&.]+|\S", text)
    place = 0

    def peek() -> str:
        return tokens[place] if place < len(tokens) else ""

    def take() -> str:
        nonlocal place
        place += 1
        return tokens[place - 1]

    def several(name, part, mark):
        found = [part()]
        while peek() and peek()[0] in mark:
            take()
            found.append(part())
        return found[0] if len(found) == 1 else (name, found)

    def either():
        return several("or", both, "|")

    def both():
        return several("and", single, "&.")

    def single():
        token = peek()
        if token == "!":
            take()
            return ("not", single())
        if token == "(":
            take()
            inner = either()
            if peek() != ")":
                raise ValueError(f"bad expression: {text!r}")
            take()
            return inner
        if re.fullmatch(r"\w+", token):
            return ("symbol", take())
        raise ValueError(f"bad expression: {text!r}")

    tree = either()
    if place < len(tokens):
        raise ValueError(f"bad expression: {text!r}")
    return tree


def compile_expression(text: str, symbol, compat: bool = False) -> Column:
    """The value of an expression; symbol: name -> Column. compat: a bad expression is -1 instead of an error."""
    try:
        tree = parse(text)
    except ValueError:
        if compat:
            return F.lit(-1.0)
        raise

    def column(node) -> Column:
        kind, inner = node
        if kind == "symbol":
            return F.coalesce(symbol(inner), F.lit(0.0))
        if kind == "not":
            return F.when(column(inner) > 0, F.lit(0.0)).otherwise(F.lit(1.0))
        out = column(inner[0])
        for part in inner[1:]:
            out = out + column(part) if kind == "or" else out * column(part)
        return out

    return column(tree)


def in_map(context: Column):
    """Symbols from a map column."""
    return lambda name: F.try_element_at(context, F.lit(name))


def context_map(facts: DataFrame, scope: str, symbol: str, value: str | None = None) -> DataFrame:
    """scope, context: a map of symbols; each counts its rows, or has the sum of a value."""
    weight = F.count(F.lit(1)).cast("double") if value is None else F.sum(value).cast("double")
    each = facts.groupBy(scope, symbol).agg(weight.alias("w"))
    return each.groupBy(scope).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(symbol, "w")))).alias("context"))


def active_symbols(context: Column) -> Column:
    """Symbols above 0, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(context, lambda k, v: v > 0)))
