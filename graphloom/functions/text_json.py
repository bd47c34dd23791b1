"""JSON texts as the stores keep them: perhaps unreadable, perhaps wrapped once more in a JSON string."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_BLANKS = " \t\r\n"


def _closed(text: Column) -> Column:
    """The text if nothing follows its closing bracket; the JVM's reader would pass over what follows."""
    bare = F.trim(text, F.lit(_BLANKS))
    ends = F.concat(F.substring(bare, 1, 1), F.substring(bare, -1, 1))
    return F.when(~ends.rlike(r'^[\[{"]') | ends.isin("{}", "[]", '""'), text)


def variant(text: Column) -> Column:
    """VARIANT of a JSON text. Null for null and unreadable texts; one wrapping JSON string is taken off."""
    outer = F.try_parse_json(_closed(text))
    inner = F.try_variant_get(outer, "$", "string")
    return F.when(F.ltrim(text, F.lit(_BLANKS)).startswith('"'), F.try_parse_json(_closed(inner))).otherwise(outer)


def instant(text: Column) -> Column:
    """The instant of an ISO 8601 text as microseconds since 1970; without an offset it is UTC; null if unreadable."""
    bare = F.trim(text)
    zoned = F.when(bare.rlike(r"([zZ]|[+-]\d{2}:?\d{2}|[+-]\d{2})$") & bare.rlike(r"\d{1,2}:\d{2}"), bare).otherwise(F.concat(bare, F.lit("Z")))
    spaced = F.regexp_replace(F.upper(zoned), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.unix_micros(spaced.try_cast("timestamp"))


#: Tokens of JSON: a string, a number, a word, or a mark.
_TOKEN = re.compile(r"""[ \t\r\n]*(?:("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null)|([\[\]{},:]))""", re.S)
_ODD = re.compile(r"""("(?:[^"\\]|\\.)*")(:null(?=[,}]),?)?|-?\d+(?:\.\d+)?(?:E-?\d+)?""", re.S)
_LOOSE = re.compile(r"""("(?:[^"\\]|\\.)*")|,(?=})""", re.S)
#: A reader of the JVM stops at this depth and at numbers of this length, so shorter texts never reach a limit.
_LIMIT = 1000


def _number(token: str) -> str:
    """One spelling for equal numbers: without exponent, needless zeros and the sign of zero."""
    value = Decimal(token)
    if abs(value.adjusted()) > 400:
        sign, places, exponent = value.as_tuple()
        bare = "".join(map(str, places)).rstrip("0")
        return f"{'-' * sign}{bare}E{exponent + len(places) - len(bare)}" if bare else "0"
    digits = format(value, "f")
    digits = digits.rstrip("0").rstrip(".") if "." in digits else digits
    return "0" if digits == "-0" else digits


def _regular(text: str) -> str:
    """Compact JSON without null members and with one spelling for equal numbers."""

    def token(match: re.Match) -> str:
        if match[1] is None:
            return _number(match[0])
        return "" if match[2] else match[1]

    return _LOOSE.sub(lambda m: m[1] or "", _ODD.sub(token, text))


def read_beyond(text: str, without: frozenset[str] = frozenset(), wrapped: bool = True) -> str | None:
    """Canonical text of JSON of any depth and with numbers of any length, by a stack of open containers; None if unreadable.

    One wrapping string is taken off; members named in ``without`` are left out at the top. Members of one name twice
    make a text unreadable, as in the JVM.
    """
    stack: list[tuple[str, list, str | None]] = []
    at, value, key, ready = 0, None, None, True  # ready: a value may come
    text = text.strip(_BLANKS)
    while at < len(text):
        match = _TOKEN.match(text, at)
        if not match:
            return None
        at, (string, number, word, mark) = match.end(), match.groups()
        if mark in ("[", "{"):
            if not ready or stack and stack[-1][0] == "{" and key is None:
                return None
            stack.append((mark, [], key))
            key, ready = None, True
            continue
        if mark in ("]", "}"):
            if not stack or "[{".index(stack[-1][0]) != "]}".index(mark) or key is not None or ready and stack[-1][1]:
                return None
            _, held, key = stack.pop()
            if mark == "}" and len({k for k, _ in held}) < len(held):
                return None
            kept = sorted(f"{k}:{v}" for k, v in held if v != "null" and (stack or json.loads(k) not in without)) if mark == "}" else held
            value = f"{'[{'[']}'.index(mark)]}{','.join(kept)}{mark}"
        elif mark == ",":
            if ready or not stack or key is not None:
                return None
            ready = True
            continue
        elif mark == ":":
            return None  # the only colons follow a name, see below
        else:
            try:
                value = json.dumps(json.loads(string), ensure_ascii=False) if string else _number(number) if number else word
            except ValueError:
                return None
            if not ready:
                return None
            if string and stack and stack[-1][0] == "{" and key is None:
                colon = _TOKEN.match(text, at)
                if not colon or colon[4] != ":":
                    return None
                key, at = value, colon.end()
                continue
        if stack:
            if stack[-1][0] == "{" and key is None:
                return None
            stack[-1][1].append((key, value) if stack[-1][0] == "{" else value)
            key, ready = None, False
        elif at < len(text):
            return None
        elif wrapped and string:
            return read_beyond(json.loads(string), without, False)
        else:
            return None if value == "null" else value
    return None


def with_canonical(df: DataFrame, column: str, name: str, without: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``name``: one text for all spellings of the JSON value in ``column``: members by name, null members and those
    in ``without`` (at the top) left out, no spacing, one spelling for equal numbers; null for null and unreadable values.

    The JVM reads and writes each text once. Only texts with null members or numbers with an exponent are gone over again
    in Python, and only long texts that the JVM could not read, perhaps for their depth or a number's length, are read there.
    """
    dropped = frozenset(without)

    @F.pandas_udf("string")
    def regular(texts: pd.Series) -> pd.Series:
        return texts.map(_regular, na_action="ignore")

    @F.pandas_udf("string")
    def beyond(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: read_beyond(t, dropped), na_action="ignore")

    value, text, read = F.col("_value"), F.col(column), F.col("_read")
    members = F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, v: ~k.isin(*dropped) & ~F.is_variant_null(v))
    compact = F.when(~F.is_variant_null(value), F.coalesce(F.to_json(members), F.to_json(value)))
    odd = F.when(read.rlike(r":null[,}]|\.0([,}\]]|$)|[0-9]E-?[0-9]"), read)
    held = df.withColumn("_value", variant(text)).withColumns({"_read": compact, "_lost": F.when(value.isNull() & (F.length(text) > _LIMIT), text)}).drop("_value")
    gone_over = held.withColumns({"_odd": odd}).withColumns({"_odd": regular("_odd"), "_lost": beyond("_lost")})
    return gone_over.withColumn(name, F.coalesce("_odd", "_read", "_lost")).drop("_odd", "_read", "_lost")
