"""Semantic versions, routes and names as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_VERSION = r"^\s*(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?\s*$"


def version(text: Column) -> Column:
    """A struct that orders as the versions do: numbers, releases after their pre-releases, pre-releases by code points; null if it is none."""
    parts = [F.regexp_extract(text, _VERSION, k) for k in range(1, 5)]
    return F.when(text.rlike(_VERSION), F.struct(*(parts[k].cast("bigint").alias(n) for k, n in enumerate(("major", "minor", "patch"))), (parts[3] == "").alias("release"), parts[3].alias("pre")))


def satisfies(text: Column, constraint: str) -> Column:
    """Whether a version meets all of a constraint's comma-separated parts: ``*``, ``^``, ``~``, comparisons, or the version itself."""
    own = version(text)
    held = F.lit(True)
    for part in filter(None, (p.strip() for p in (constraint or "*").split(","))):
        if part == "*":
            continue
        sign, bare = re.match(r"(\^|~|>=|<=|==|>|<)?\s*(.*)$", part).groups()
        numbers = re.match(_VERSION, bare)
        if not numbers:
            raise ValueError(f"not a version: {bare!r}")
        edge = version(F.lit(bare))
        if sign in ("^", "~"):
            major, minor, patch = (int(x) for x in numbers.groups()[:3])
            if sign == "~":
                above = (major, minor + 1, 0)
            else:
                above = (major + 1, 0, 0) if major else (0, minor + 1, 0) if minor else (0, 0, patch + 1)
            held = held & (own >= edge) & (own < version(F.lit(".".join(map(str, above)))))
        else:
            held = held & {None: own == edge, "==": own == edge, ">=": own >= edge, "<=": own <= edge, ">": own > edge, "<": own < edge}[sign]
    return F.coalesce(held, F.lit(False))


def route(path: Column) -> Column:
    """A route with one leading slash, single slashes within, none at its end, and ``{}`` for each variable."""
    single = F.regexp_replace(F.concat(F.lit("/"), F.coalesce(path, F.lit(""))), "/+", "/")
    bare = F.when(single == "/", single).otherwise(F.regexp_replace(single, "/$", ""))
    return F.regexp_replace(bare, r"\{[^}]*\}", "{}")


def bean_name(simple: Column) -> Column:
    """The default bean name: the first letter in lower case, unless the first two are upper case."""
    return F.when(simple.rlike("^[A-Z]{2}"), simple).otherwise(F.concat(F.lower(F.substring(simple, 1, 1)), F.substring(simple, 2, 10_000)))


def literal_kind(text: Column) -> Column:
    """The kind of a source literal: text_block, string, char, boolean, null, long, float, double, int or invalid."""
    digits = r"(?:0[xX][0-9a-fA-F](?:_*[0-9a-fA-F])*|0[bB][01](?:_*[01])*|0(?:_*[0-7])*|[1-9](?:_*\d)*)"
    real = r"(?:\d(?:_*\d)*\.(?:\d(?:_*\d)*)?|\.\d(?:_*\d)*|\d(?:_*\d)*(?=[eEfFdD]))(?:[eE][+-]?\d+)?"
    return (
        F.when(text.rlike(r'(?s)^"""[ \t\f]*\n.*"""$'), "text_block").when(text.rlike(r'^"(?:[^"\\\n]|\\.)*"$'), "string").when(text.rlike(r"^'(?:[^'\\\n]|\\.|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3})'$"), "char")
        .when(text.isin("true", "false"), "boolean").when(text == "null", "null").when(text.rlike(f"^{digits}[lL]$"), "long").when(text.rlike(f"^(?:{real}|{digits})[fF]$") & ~text.rlike("^0[xX]"), "float")
        .when(text.rlike(f"^(?:{real}[dD]?|{digits}[dD])$") & ~text.rlike("^0[xX]"), "double").when(text.rlike(f"^{digits}$"), "int").otherwise("invalid")
    )
