"""Rules as columns: registered predicates over a table, run together, and policy packs that need each other."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.evidence import SEVERITIES
from graphloom.operators.lookups import glob_pattern


@dataclass(frozen=True)
class Rule:
    """A rule: where ``predicate`` holds, a row is a finding."""

    rule_id: str
    severity: str
    predicate: Callable[[], Column]
    message: str = ""


@dataclass
class RuleRegistry:
    """Rules by id. Ids are unique, severities known."""

    rules: dict[str, Rule] = field(default_factory=dict)

    def add(self, rule: Rule) -> None:
        if rule.rule_id in self.rules:
            raise ValueError(f"rule {rule.rule_id} is registered already")
        if rule.severity not in SEVERITIES:
            raise ValueError(f"unknown severity {rule.severity}")
        self.rules[rule.rule_id] = rule

    def run(self, rows: DataFrame, key: str, enabled: set[str] | None = None) -> DataFrame:
        """``(key, rule_id, severity, message)``: each finding once, all rules in one pass over ``rows``; null predicates find nothing."""
        chosen = [self.rules[r] for r in sorted(self.rules) if enabled is None or r in enabled]
        if not chosen:
            return rows.select(key, *(F.lit("").alias(c) for c in ("rule_id", "severity", "message"))).limit(0)
        found = F.array_compact(F.array(*(F.when(r.predicate(), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"))) for r in chosen)))
        return rows.select(key, F.explode(found).alias("f")).select(key, "f.*").distinct()


@dataclass(frozen=True)
class Pack:
    """A policy pack: its version and the packs it needs, with constraints; optional ones may be absent."""

    name: str
    version: str
    needs: tuple[tuple[str, str, bool], ...] = ()


def resolve_packs(packs: list[Pack], satisfies: Callable[[str, str], bool]) -> list[str]:
    """The packs' names, each after those it needs. Missing or unfit ones and circles are errors."""
    known = {p.name: p for p in packs}
    if len(known) < len(packs):
        raise ValueError("a pack is given twice")
    done: dict[str, bool] = {}
    order: list[str] = []

    def place(name: str) -> None:
        if done.get(name):
            return
        if name in done:
            raise ValueError(f"packs need each other in a circle at {name}")
        done[name] = False
        for other, constraint, optional in sorted(known[name].needs):
            if other in known:
                if not satisfies(known[other].version, constraint):
                    raise ValueError(f"{name} needs {other} {constraint}")
                place(other)
            elif not optional:
                raise ValueError(f"{name} needs {other}, which is missing")
        done[name] = True
        order.append(name)

    for name in sorted(known):
        place(name)
    return order


def catalog(registry: RuleRegistry) -> list[tuple[str, str, str]]:
    """(rule_id, severity, message) of all rules by id."""
    return [(r.rule_id, r.severity, r.message) for _, r in sorted(registry.rules.items())]


def rule_test(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """``(rule_id, found, missing, unexpected, passed)`` of findings ``(key, rule_id)`` against those that a rule's cases expect."""
    one = actual.select(key, "rule_id").distinct().withColumn("a", F.lit(1))
    two = expected.select(key, "rule_id").distinct().withColumn("e", F.lit(1))
    joined = one.join(two, [key, "rule_id"], "full_outer")
    counted = joined.groupBy("rule_id").agg(F.count_if(F.col("a").isNotNull() & F.col("e").isNotNull()).alias("found"), F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"))
    return counted.withColumn("passed", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def gated(findings: DataFrame, suppressions: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), disabled: Sequence[str] = ()) -> DataFrame:
    """``(finding_id, rule_id, path, state, suppression)``: ``kept``, ``disabled`` by rule, ``outside`` the paths, or ``suppressed`` by the first that fits.

    ``suppressions(place, rule_id, path)``: a null rule or path fits any; ``place`` is their order. Paths are globs. A finding
    meets only the suppressions of its own rule and path, or of any.
    """
    path = F.col("path")
    inside = reduce(lambda a, b: a | b, (path.rlike(glob_pattern(g)) for g in include), F.lit(not include)) & ~reduce(lambda a, b: a | b, (path.rlike(glob_pattern(g)) for g in exclude), F.lit(False))
    own = suppressions.select("place", F.coalesce("rule_id", F.lit("*")).alias("r"), F.coalesce("path", F.lit("*")).alias("p"))
    keys = findings.select("finding_id", F.explode(F.array(*(F.struct(r.alias("r"), p.alias("p")) for r in (F.col("rule_id"), F.lit("*")) for p in (path, F.lit("*"))))).alias("k")).select("finding_id", "k.*")
    first = keys.join(own, ["r", "p"]).groupBy("finding_id").agg(F.min("place").alias("suppression"))
    state = F.when(F.col("rule_id").isin(*disabled), "disabled").when(~F.coalesce(inside, F.lit(False)), "outside").when(F.col("suppression").isNotNull(), "suppressed").otherwise("kept")
    joined = findings.select("finding_id", "rule_id", "path").join(first, "finding_id", "left")
    return joined.select("finding_id", "rule_id", "path", state.alias("state"), F.when(state == "suppressed", F.col("suppression")).alias("suppression"))
