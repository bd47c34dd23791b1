"""Design patterns and architecture as joins of a relation table with itself.

``facts(source, target, relation)`` holds inherits, composes, calls, uses, returns, constructs and overrides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _of(facts: DataFrame, relation: str, source: str, target: str) -> DataFrame:
    return facts.where(F.col("relation") == relation).select(F.col("source").alias(source), F.col("target").alias(target)).distinct()


def _abstractions(facts: DataFrame, least: int = 2) -> DataFrame:
    return _of(facts, "inherits", "child", "base").groupBy("base").agg(F.count("*").alias("implementations")).where(F.col("implementations") >= least)


def strategies(facts: DataFrame) -> DataFrame:
    """``(abstraction, client, implementations)``: two implementors or more, and a use by another."""
    uses = _of(facts, "uses", "client", "base")
    own = _of(facts, "inherits", "client", "base")
    return uses.join(_abstractions(facts), "base").join(own, ["client", "base"], "left_anti").select(F.col("base").alias("abstraction"), "client", "implementations")


def factories(facts: DataFrame) -> DataFrame:
    """``(factory, abstraction, products)``: returns an abstraction and constructs two of its subtypes or more."""
    made = _of(facts, "returns", "factory", "base").join(_of(facts, "inherits", "child", "base"), "base").join(_of(facts, "constructs", "factory", "child"), ["factory", "child"])
    return made.groupBy("factory", F.col("base").alias("abstraction")).agg(F.count("*").alias("products")).where("products >= 2")


def builders(methods: DataFrame) -> DataFrame:
    """``(owner)`` of ``methods(owner, name, returns)``: two methods that return the owner, and one that returns another type."""
    return methods.distinct().groupBy("owner").agg(F.count_if(F.col("returns") == F.col("owner")).alias("own"), F.count_if(F.col("returns") != F.col("owner")).alias("other")).where("own >= 2 and other >= 1").select("owner")


def adapters(facts: DataFrame) -> DataFrame:
    """``(adapter, role, adaptee)``: inherits the role, composes and calls another."""
    held = _of(facts, "composes", "adapter", "adaptee").join(_of(facts, "calls", "adapter", "adaptee"), ["adapter", "adaptee"])
    return held.join(_of(facts, "inherits", "adapter", "role"), "adapter").where("role <> adaptee").select("adapter", "role", "adaptee")


def decorators(facts: DataFrame) -> DataFrame:
    """``(decorator, role)``: inherits, composes and calls the same."""
    keys = ["decorator", "role"]
    return _of(facts, "inherits", *keys).join(_of(facts, "composes", *keys), keys).join(_of(facts, "calls", *keys), keys)


def commands(facts: DataFrame) -> DataFrame:
    """``(abstraction, invoker, command, receiver)``: an invoker composes and calls an abstraction of two implementors or more,
    of which one composes and calls a receiver."""
    held = _of(facts, "composes", "a", "b").join(_of(facts, "calls", "a", "b"), ["a", "b"])
    invokers = held.select(F.col("a").alias("invoker"), F.col("b").alias("base")).join(_abstractions(facts), "base")
    concrete = _of(facts, "inherits", "command", "base").join(held.select(F.col("a").alias("command"), F.col("b").alias("receiver")), "command")
    return invokers.join(concrete, "base").where("invoker <> command and receiver <> base").select(F.col("base").alias("abstraction"), "invoker", "command", "receiver")


def template_methods(facts: DataFrame, members: DataFrame) -> DataFrame:
    """``(template, hook, override)``: an override in a direct subtype of a method that another method of the base calls.

    ``members(method, owner)``.
    """
    owner = members.select("method", "owner").distinct()
    over = _of(facts, "overrides", "override", "hook").join(owner.select(F.col("method").alias("override"), F.col("owner").alias("child")), "override").join(owner.select(F.col("method").alias("hook"), F.col("owner").alias("base")), "hook")
    direct = over.join(_of(facts, "inherits", "child", "base"), ["child", "base"])
    calls = _of(facts, "calls", "template", "hook").join(owner.select(F.col("method").alias("template"), F.col("owner").alias("base")), "template")
    return direct.join(calls, ["hook", "base"]).where("template <> hook").select("template", "hook", "override")


def architecture_tokens(terms: DataFrame, groups: Sequence[Sequence[str]], least: int, base: float) -> DataFrame:
    """``(scope, groups, confidence)`` of ``terms(scope, term)``: how many groups have a token in the scope.

    Scopes with ``least`` groups or more; the confidence is ``base`` and .06 for each group beyond, .98 at most.
    """
    number = F.lit(None).cast("int")
    for k, tokens in enumerate(groups):
        number = F.when(F.col("term").isin(*tokens), k).otherwise(number)
    counted = terms.withColumn("group", number).where(F.col("group").isNotNull()).groupBy("scope").agg(F.count_distinct("group").alias("groups")).where(F.col("groups") >= least)
    return counted.select("scope", "groups", F.round(F.least(F.lit(0.98), F.lit(base) + 0.06 * (F.col("groups") - least)), 4).alias("confidence"))
