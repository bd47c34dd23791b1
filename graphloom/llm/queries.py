"""The queries p4, p5, p7, p8 and p9 over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.conversations import rebuilt, sender_clocks, turns
from graphloom.llm.encode import token_ids
from graphloom.llm.leakage import leaks
from graphloom.llm.pairs import defective_pairs
from graphloom.llm.segments import fit_profiles, language_segments, mislabelled
from graphloom.sources.tables import table


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", ["doc_id", "text", "lang"], spread=True)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    asks = table(spark, folder, "ask_log", ["ask_id", "turn_id", "question", "answer"], spread=True)
    return defective_pairs(asks, table(spark, folder, "conversation_turns"), _labelled(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return rebuilt(table(spark, folder, "conversation_messages"))


def p5_clocks(spark: SparkSession, folder: str) -> DataFrame:
    clocks = sender_clocks(turns(table(spark, folder, "conversation_messages")))
    return clocks.select("conversation_id", F.round("assistant_s", 2).alias("assistant_s"), F.round("system_s", 2).alias("system_s"), "feasible")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_ids(table(spark, folder, "documents", ["doc_id", "text"], spread=True))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents", ["doc_id", "text"], spread=True), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return mislabelled(_labelled(spark, folder))


def p9_languages(spark: SparkSession, folder: str) -> DataFrame:
    documents = _labelled(spark, folder)
    return language_segments(documents, fit_profiles(documents)).select("doc_id", "segment", "lang", "confidence")


QUERIES = {"p4_found": p4_found, "p5_found": p5_found, "p5_clocks": p5_clocks, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found, "p9_languages": p9_languages}
_TURNS = (
    r"m AS (SELECT conversation_id AS c, position AS p, id, CASE WHEN r IN ('user', 'human') THEN 'user' WHEN r IN ('assistant', 'model', 'bot', 'ai') THEN 'assistant' WHEN r IN ('system', 'sys') THEN 'system' END AS s, regexp_replace(content, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t, coalesce(regexp_replace(content, '[\s\p{Z}\p{C}]+', '', 'g'), '') = '' AS blank, epoch_us(created_at::TIMESTAMPTZ) AS tm FROM (SELECT *, lower(regexp_replace(role, '[\s\p{Z}\p{C}]+', '', 'g')) AS r FROM conversation_messages) WHERE conversation_id IS NOT NULL), "
    r"g AS (SELECT c, p, min(id) AS id, min(s) AS s, min(tm) AS tm, bool_or(blank OR p IS NULL OR s IS NULL) OR count(DISTINCT (s, t)) > 1 AS broken FROM m GROUP BY c, p)"
)
_GAPS = "b.c, (b.tm - a.tm) / 1e6 AS g, left(a.s, 1) || left(b.s, 1) AS way, (b.s = 'assistant')::INT - (a.s = 'assistant')::INT AS p, (b.s = 'system')::INT - (a.s = 'system')::INT AS q FROM g a JOIN g b ON a.c = b.c AND b.p = a.p + 1 WHERE NOT a.broken AND NOT b.broken AND a.tm IS NOT NULL AND b.tm IS NOT NULL"
_SOLVED = "SELECT c, pp + 1e-6 - p * p / n AS a, pq - p * q / n AS b, qq + 1e-6 - q * q / n AS d, pg - p * g / n AS e, qg - q * g / n AS f, w FROM (SELECT c, count(*) AS n, sum(p) AS p, sum(q) AS q, sum(p * p) AS pp, sum(q * q) AS qq, sum(p * q) AS pq, sum(g) AS g, sum(p * g) AS pg, sum(q * g) AS qg, {ways} AS w FROM gaps GROUP BY c)"
_WAYS = "{" + ", ".join(f"'{w}_': min(g) FILTER (way = '{w}')" for w in ("ua", "au", "us", "su", "as", "sa")) + "}"
_RINGS = " AND ".join(f"coalesce({' + '.join(f'w.{x}_' for x in ring)} > 0, true)" for ring in (("ua", "au"), ("us", "su"), ("as", "sa"), ("ua", "as", "su"), ("us", "sa", "au")))
SQL = {
    "p5_found": f"WITH {_TURNS}, "
    "f AS (SELECT c, string_agg(left(s, 1), '' ORDER BY p) FILTER (s <> 'system') AS line, count(*) AS n, min(p) AS a, max(p) AS b, bool_or(broken) AS broken FROM g GROUP BY c) SELECT c AS conversation_id, p AS position, id AS message_id, s AS speaker FROM g JOIN f USING (c) WHERE NOT f.broken AND a = 0 AND b = n - 1 AND regexp_full_match(line, '(ua)+')",
    "p5_clocks": f"WITH {_TURNS}, gaps AS (SELECT {_GAPS}), solved AS ({_SOLVED.format(ways=_WAYS)}) "
    f"SELECT c AS conversation_id, round(coalesce((e * d - b * f) / (a * d - b * b), 0), 2) AS assistant_s, round(coalesce((a * f - b * e) / (a * d - b * b), 0), 2) AS system_s, {_RINGS} AS feasible FROM (SELECT DISTINCT c FROM g) LEFT JOIN solved USING (c)",
}
