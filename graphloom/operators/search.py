"""Search over symbols, nodes and documents, and bounded contexts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the document score.
DOCUMENT_WEIGHTS = {"filename": 5, "title": 4, "heading": 3, "body": 1, "phrase": 6}
#: Weights of a hit's parts.
HIT_WEIGHTS = {"identity": 0.35, "lexical": 0.25, "intent": 0.15, "graph": 0.15, "evidence": 0.10}
MAX_TERMS = 64
_WORD = "[A-Za-z0-9_+]+"


def query_terms(text: str, limit: int = MAX_TERMS) -> list[str]:
    """The distinct terms of a query, lower case, in order, ``limit`` at most."""
    return list(dict.fromkeys(t.lower() for t in re.findall(_WORD, text)))[:limit]


def terms(text: Column) -> Column:
    """The distinct terms of a text, lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_+]+"), 0))


def ordered_terms(text: Column) -> Column:
    """The terms of a text in order, one blank apart."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_+]+"), 0), " ")


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    name = F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def document_scores(documents: DataFrame, query: str) -> DataFrame:
    """``(id, score)`` of documents ``(id, path, content)`` that score: 5 a query term in the file name, 4 in the first
    level-one heading, 3 in any heading, 1 in the text, and 6 for each quoted phrase in name or text (as a substring)."""
    wanted = F.array(*(F.lit(t) for t in query_terms(re.sub(r'"', " ", query)))) if query_terms(query) else F.array().cast("array<string>")
    lines = F.transform(F.split(F.coalesce("content", F.lit("")), r"\r\n|\n|\r"), lambda x: F.trim(x))
    title = F.try_element_at(F.filter(lines, lambda x: x.startswith("# ")), F.lit(1))
    headings = F.array_join(F.filter(lines, lambda x: x.startswith("#")), " ")
    hits = {
        "filename": F.size(F.array_intersect(wanted, terms(stem(F.col("path"))))),
        "title": F.size(F.array_intersect(wanted, terms(title))),
        "heading": F.size(F.array_intersect(wanted, terms(headings))),
        "body": F.size(F.array_intersect(wanted, terms(F.col("content")))),
    }
    score = F.lit(0)
    for name, count in hits.items():
        score = score + count * DOCUMENT_WEIGHTS[name]
    name, body = ordered_terms(stem(F.col("path"))), ordered_terms(F.col("content"))
    for phrase in {" ".join(t.lower() for t in re.findall(_WORD, p)) for p in re.findall(r'"([^"]+)"', query)} - {""}:
        score = score + F.when(name.contains(phrase) | body.contains(phrase), DOCUMENT_WEIGHTS["phrase"]).otherwise(0)
    return documents.select("id", score.alias("score")).where("score > 0")


def symbol_search(symbols: DataFrame, text: str, kinds: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """``(id, score, reason)`` of symbols ``(id, kind, name, qualified_name)``: 100 equal name, 95 equal qualified name,
    70 prefix, 50 within the name, 30 within the qualified name; without text all that pass the filters score 0."""
    needle = text.strip().lower()
    rows = symbols.where(F.col("kind").isin(*kinds)) if kinds else symbols
    name, full = F.lower("name"), F.lower("qualified_name")
    score, reason = F.lit(0), F.lit("filters")
    if needle:
        cases = ((name == needle, 100, "exact-name"), (full == needle, 95, "exact-qualified-name"), (name.startswith(needle), 70, "name-prefix"), (name.contains(needle), 50, "name-contains"), (full.contains(needle), 30, "qualified-name-contains"))
        score, reason = F.lit(None).cast("int"), F.lit(None).cast("string")
        for condition, points, why in reversed(cases):
            score, reason = F.when(condition, points).otherwise(score), F.when(condition, why).otherwise(reason)
    hits = rows.select("id", score.alias("score"), reason.alias("reason"), "qualified_name", "kind").where(F.col("score").isNotNull())
    if limit is not None:
        hits = hits.orderBy(F.col("score").desc(), "qualified_name", "kind", "id").limit(limit)
    return hits.select("id", "score", "reason")


def _containing(token: str):
    return lambda x: F.lower(x).contains(token)


def node_search(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """The ``limit`` best of nodes ``(id, kind, name, facets)``: 100 for an equal name, 45 for the query within it, 35 or 12
    for each token, 8 for a facet with it, and 0.1 for every type node."""
    whole = query.lower()
    key, name = F.lower("id"), F.lower("name")
    score = F.when((key == whole) | (name == whole), 100.0).when(key.contains(whole) | name.contains(whole), 45.0).otherwise(0.0)
    for token in query_terms(query):
        score = score + F.when((key == token) | (name == token), 35.0).when(key.contains(token) | name.contains(token), 12.0).otherwise(0.0)
        score = score + F.when(F.exists("facets", _containing(token)), 8.0).otherwise(0.0)
    score = F.round(score + F.when(F.col("kind") == "type", 0.1).otherwise(0.0), 1)
    return nodes.select("id", score.alias("score")).where("score > 0").orderBy(F.col("score").desc(), F.lower("id"), "id").limit(limit)


def postings(entries: DataFrame) -> DataFrame:
    """``(term, id)`` of ``entries(id, text)``, each once."""
    return entries.select("id", F.explode(terms(F.col("text"))).alias("term")).distinct()


def bounded(found: DataFrame, order: Sequence[Column], limit: int | None) -> DataFrame:
    """The first ``limit`` rows with ``omitted``, the number of those left out; all rows, with 0, without a limit."""
    if limit is None:
        return found.withColumn("omitted", F.lit(0).cast("bigint"))
    total = found.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("omitted"))
    return found.orderBy(*order).limit(limit).join(F.broadcast(total))  # one row


def any_term(index: DataFrame, wanted: Sequence[str], limit: int | None = None) -> DataFrame:
    """``(id, matched, omitted)`` of entries with some of the terms; with a ``limit`` the best, then by id."""
    found = index.where(F.col("term").isin(*wanted)).groupBy("id").agg(F.count_distinct("term").alias("matched"))
    return bounded(found, [F.col("matched").desc(), F.col("id")], limit)


def all_terms(index: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """``(id)`` of entries with all of the terms."""
    return index.where(F.col("term").isin(*wanted)).groupBy("id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(set(wanted))).select("id")


def search_by_plan(plan, nodes: DataFrame, edges: DataFrame, concepts: DataFrame, limit: int | None = None) -> DataFrame:
    """``(id, why, omitted)`` of the subjects that a search plan asks for; with a ``limit`` the first by id, and how many are left out.

    ``nodes(id, kind, name)``, ``edges(source, target, relation)``, ``concepts(id, concept)``. A relation is walked from all
    subjects of the plan's name; concepts must all hold; kinds, ``using`` and a scope filter what is found. All filters come
    before the limit.
    """
    wanted = (plan.subject or plan.text).lower()
    named = nodes.where((F.lower("name") == wanted) | (F.lower("id") == wanted)).select(F.col("id").alias("subject"))
    if "relational" in plan.intents and plan.relation:
        near, far = ("target", "source") if plan.direction != "outgoing" else ("source", "target")
        links = edges.where(F.col("relation") == plan.relation).select(F.col(near).alias("subject"), F.col(far).alias("id"))
        found, why = links.join(named, "subject", "left_semi").select("id").distinct(), plan.relation
    elif plan.concepts:
        held = concepts.where(F.col("concept").isin(*plan.concepts)).groupBy("id").agg(F.count_distinct("concept").alias("n"))
        found, why = held.where(F.col("n") == len(plan.concepts)).select("id"), "concept"
    elif "subject_kind" in plan.intents and plan.subject is None:
        found, why = nodes.where(F.col("kind").isin(*plan.kinds)).select("id").distinct(), "kind"
    else:
        found, why = named.select(F.col("subject").alias("id")).distinct(), "identity"
    if plan.kinds:
        found = found.join(nodes.where(F.col("kind").isin(*plan.kinds)).select("id").distinct(), "id", "left_semi")
    if "using" in plan.filters:
        used = nodes.where(F.lower("name") == plan.filters["using"]).select(F.col("id").alias("target"))
        found = found.join(edges.where("relation = 'depends_on'").join(used, "target", "left_semi").select(F.col("source").alias("id")).distinct(), "id", "left_semi")
    for scope in ("project", "module", "package"):
        if scope in plan.filters:
            inside = nodes.where((F.col("kind") == scope) & (F.lower("name") == plan.filters[scope])).select(F.col("id").alias("target"))
            found = found.join(edges.where("relation = 'member_of'").join(inside, "target", "left_semi").select(F.col("source").alias("id")).distinct(), "id", "left_semi")
    return bounded(found.select("id", F.lit(why).alias("why")), [F.col("id")], limit)


def hit_score(parts: dict[str, Column], exact: Column, evidenced: Column) -> Column:
    """The weighted mean over the parts that are active (not null); hits without evidence that are not exact count 0.39 of it."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, value in parts.items():
        total = total + F.coalesce(value * HIT_WEIGHTS[name], F.lit(0.0))
        weight = weight + F.when(value.isNotNull(), HIT_WEIGHTS[name]).otherwise(0.0)
    score = F.when(weight > 0, total / weight).otherwise(0.0)
    return F.round(F.when(evidenced | exact, score).otherwise(score * 0.39), 6)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("bigint")


def within_budget(ranked: DataFrame, group: str, order: Sequence[Column], cost: str, budget: int) -> DataFrame:
    """Of each group the longest prefix whose costs fit the budget: it stops at the first row that does not fit."""
    window = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(cost).over(window)).where(F.col("used") <= budget)
