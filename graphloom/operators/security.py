"""Secrets in texts, consolidation of findings, taint along paths, debt and change review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.evidence import security_priority, severity_rank
from graphloom.operators.ordering import globally_ranked

#: What secrets look like.
SECRETS = {
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "generic_secret": r"(?i)(?:password|passwd|secret|api[_-]?key|token)\s*[:=]\s*[\"']([^\"']{8,})[\"']",
}
#: Weak algorithms.
WEAK_CRYPTO = ("MD5", "SHA-1", "SHA1", "DES", "DESEDE", "RC4", "AES/ECB")


def secrets(texts: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """``(id, rule, hits)`` of ``texts(id, text)`` that match a pattern; null texts match nothing."""
    patterns = patterns or SECRETS
    counts = F.array(*(F.struct(F.lit(name).alias("rule"), F.regexp_count("text", F.lit(pattern)).alias("hits")) for name, pattern in patterns.items()))
    return texts.select("id", F.explode(counts).alias("x")).select("id", "x.rule", "x.hits").where("hits > 0")


def is_weak(algorithm: Column) -> Column:
    """Whether an algorithm's name holds a weak one, in any case."""
    upper = F.upper(algorithm)
    found = F.lit(False)
    for name in WEAK_CRYPTO:
        found = found | upper.contains(name)
    return found


def consolidated(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per finding that several producers report: highest severity, share of the commonest one, producers, priority.

    ``findings(*keys, severity, producer, traces, resolved)``; equal keys are one finding.
    """
    by = findings.groupBy(*keys, "severity").agg(F.count("*").alias("n"), F.collect_set("producer").alias("producers"), F.max("traces").alias("traces"), F.max("resolved").alias("resolved"))
    merged = by.groupBy(*keys).agg(
        F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"),
        F.round(F.max("n") / F.sum("n"), 4).alias("agreement"),
        F.size(F.array_distinct(F.flatten(F.collect_list("producers")))).alias("producers"),
        F.max("traces").alias("traces"),
        F.max("resolved").alias("resolved"),
    )
    priority = security_priority(F.col("severity"), F.col("traces"), F.col("resolved"))
    return merged.select(*keys, "severity", "agreement", "producers", priority["score"].alias("priority"), priority["tier"].alias("tier"))


def taint_findings(paths: DataFrame, sources: Sequence, sinks: Sequence, sanitizers: Sequence) -> DataFrame:
    """``(path, verdict)`` of ``paths(path)`` that begin at a source and end at a sink: sanitized if a sanitiser lies between."""
    first, last = F.element_at("path", 1), F.element_at("path", -1)
    between = F.slice("path", F.lit(2), F.greatest(F.size("path") - 2, F.lit(0)))
    clean = F.arrays_overlap(between, F.array(*(F.lit(s) for s in sanitizers))) if sanitizers else F.lit(False)
    return paths.where(first.isin(*sources) & last.isin(*sinks)).select("path", F.when(clean, "sanitized").otherwise("tainted").alias("verdict"))


def taint_between(paths: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame) -> DataFrame:
    """``taint_findings`` where the sources, sinks and sanitizers are tables of ``id``, of any size."""
    first, last = F.element_at("path", 1), F.element_at("path", -1)
    ends = paths.join(sources.select(F.col("id").alias("first")).distinct(), first == F.col("first"), "left_semi").join(sinks.select(F.col("id").alias("last")).distinct(), last == F.col("last"), "left_semi")
    between = ends.select("path", F.explode(F.slice("path", F.lit(2), F.greatest(F.size("path") - 2, F.lit(0)))).alias("id"))
    clean = between.join(sanitizers.select("id").distinct(), "id", "left_semi").select("path").distinct().withColumn("clean", F.lit(True))
    return ends.join(clean, "path", "left").select("path", F.when(F.col("clean"), "sanitized").otherwise("tainted").alias("verdict"))


def debt_ranking(seams: DataFrame) -> DataFrame:
    """``(seam, impact, direct, risk, rank)``: only seams with a known impact are ranked, by impact, direct, risk, name;
    unknown values come last. The ranks come from one range-partitioned sort."""
    known = F.col("impact").isNotNull()
    keys = {"_1": -F.col("impact"), "_2": F.col("direct").isNull(), "_3": -F.col("direct"), "_4": F.col("risk").isNull(), "_5": -F.col("risk")}
    ranked = globally_ranked(seams.where(known).withColumns(keys), [*keys, "seam"], "rank").drop(*keys)
    return ranked.withColumn("rank", (F.col("rank") + 1).cast("int")).unionByName(seams.where(~known).withColumn("rank", F.lit(None).cast("int")))


def change_review(changes: DataFrame, subjects: DataFrame, impact: DataFrame, risk: DataFrame, cyclic: DataFrame) -> DataFrame:
    """``(path, id, exact, dependents, risk, in_cycle)``: the subjects of each changed path, or those of its project where the
    path has none, with what they affect."""
    exact = changes.select("path", "project").distinct().join(subjects.select("path", "id").distinct(), "path")
    rest = changes.select("path", "project").distinct().join(exact.select("path").distinct(), "path", "left_anti")
    fallback = rest.join(subjects.select("project", "id").distinct(), "project")
    found = exact.select("path", "id", F.lit(True).alias("exact")).unionByName(fallback.select("path", "id", F.lit(False).alias("exact")))
    joined = found.join(impact, "id", "left").join(risk, "id", "left").join(cyclic.select("id").distinct().withColumn("c", F.lit(True)), "id", "left")
    return joined.select("path", "id", "exact", F.coalesce("dependents", F.lit(0)).alias("dependents"), "risk", F.coalesce("c", F.lit(False)).alias("in_cycle"))


def citations(answers: DataFrame, cited: DataFrame, known: DataFrame, required: DataFrame) -> DataFrame:
    """``(answer, accepted, unknown, missing)``: counts of cited ids that are known, of those that are not, and of required ones not cited."""
    marked = cited.distinct().join(known.select("evidence").distinct().withColumn("k", F.lit(True)), "evidence", "left")
    counted = marked.groupBy("answer").agg(F.count_if(F.col("k").isNotNull()).alias("accepted"), F.count_if(F.col("k").isNull()).alias("unknown"))
    lacking = required.distinct().join(cited.distinct(), ["answer", "evidence"], "left_anti").groupBy("answer").agg(F.count("*").alias("missing"))
    zero = F.lit(0).cast("bigint")
    return answers.select("answer").distinct().join(counted, "answer", "left").join(lacking, "answer", "left").select("answer", *(F.coalesce(c, zero).alias(c) for c in ("accepted", "unknown", "missing")))


def in_scope(findings: DataFrame, projects: Sequence[str] = (), symbols: Sequence[str] = (), categories: Sequence[str] = (), severities: Sequence[str] = (), languages: Sequence[str] = ()) -> DataFrame:
    """The findings of the given projects, symbols, categories, severities and languages; an empty list asks for nothing. Null values are in no list."""
    for column, wanted in (("project", projects), ("symbol", symbols), ("category", categories), ("severity", severities), ("language", languages)):
        if wanted:
            findings = findings.where(F.col(column).isin(*wanted))
    return findings


def retained(findings: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` findings with ``total``, the exact number of all, and ``omitted``."""
    total = findings.agg(F.count("*").alias("total"), F.greatest(F.count("*") - limit, F.lit(0)).alias("omitted"))
    return findings.orderBy(*order).limit(limit).join(F.broadcast(total))  # one row


def has_absolute_path(text: Column) -> Column:
    """Whether a text names a path from the root, a drive or a home folder."""
    return F.coalesce(text.rlike(r"(^|[\s\"'(=])(/[A-Za-z0-9._-]+){2,}|\b[A-Za-z]:[\\/]|(^|\s)~/"), F.lit(False))


def is_source_shaped(text: Column) -> Column:
    """Whether a text looks like program source: a fence, a declaration with its body, or a line that ends a statement."""
    return F.coalesce(text.rlike(r"(?m)```|^\s*(public|private|protected|class|def|function|import|package)\s+\S+.*[{:;]\s*$|^\s*\S+.*;\s*$"), F.lit(False))
