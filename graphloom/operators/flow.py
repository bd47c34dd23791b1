"""Data-flow analyses of control-flow graphs, one method at a time.

``blocks(method, block, position, defines, uses)`` has one row per block with the variables it defines and those it uses
before defining them; ``edges(method, source, target)`` link blocks. A method's graph is small by nature, methods are many,
so each method is one group and all groups run in parallel.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.java_numbers import binary
from graphloom.operators.grouped import fold_groups


class Method:
    """A method's blocks in order, with their links."""

    def __init__(self, rows: Iterable[tuple]) -> None:
        """``rows`` of (block, defines, uses, targets) in order; null lists are empty."""
        self.order: list = []
        self.defines: dict = {}
        self.uses: dict = {}
        targets: dict = {}
        for block, defines, uses, after in rows:
            self.order.append(block)
            self.defines[block], self.uses[block] = set(() if defines is None else defines), set(() if uses is None else uses)
            targets[block] = () if after is None else after
        self.after: dict = {a: sorted({b for b in targets[a] if b in targets}) for a in self.order}
        self.before: dict = defaultdict(list)
        for a in self.order:
            for b in self.after[a]:
                self.before[b].append(a)

    def solve(self, start: Iterable, near: dict, far: dict, transfer: Callable) -> tuple[dict, dict]:
        """Least fixpoint of set unions: what enters and what leaves each block."""
        into, out = {b: frozenset() for b in self.order}, {b: frozenset() for b in self.order}
        work = list(start)
        while work:
            block = work.pop(0)
            into[block] = frozenset().union(*(out[b] for b in near[block]))
            new = transfer(block, into[block])
            if new != out[block]:
                out[block] = new
                work += [b for b in far[block] if b not in work]
        return into, out

    def reaching(self) -> dict:
        """Definitions (variable, block) that reach the entry of each block."""
        own = {b: frozenset((v, b) for v in self.defines[b]) for b in self.order}
        return self.solve(self.order, self.before, self.after, lambda b, x: own[b] | {d for d in x if d[0] not in self.defines[b]})[0]

    def live(self) -> dict:
        """Variables live at the entry of each block."""
        return self.solve(self.order[::-1], self.after, self.before, lambda b, x: frozenset(self.uses[b]) | (x - self.defines[b]))[1]

    def postorder(self) -> list:
        """Reachable blocks in reverse postorder from the first block."""
        seen, result = set(), []
        stack = [(self.order[0], iter(self.after[self.order[0]]))] if self.order else []
        seen.update(b for b, _ in stack)
        while stack:
            block, rest = stack[-1]
            following = next((b for b in rest if b not in seen), None)
            if following is None:
                result.append(block)
                stack.pop()
            else:
                seen.add(following)
                stack.append((following, iter(self.after[following])))
        return result[::-1]

    def dominators(self) -> dict:
        """Blocks that lie on every way from the first block; unreachable blocks have none."""
        order = self.postorder()
        every = set(order)
        found = {b: every for b in order}
        if order:
            found[order[0]] = {order[0]}
        changed = True
        while changed:
            changed = False
            for block in order[1:]:
                new = set.intersection(*(found[b] for b in self.before[block] if b in found)) | {block}
                if new != found[block]:
                    found[block], changed = new, True
        return found


def _reaching_rows(m: Method) -> list[tuple]:
    return [(b, v, d) for b, held in m.reaching().items() for v, d in held]


def _live_rows(m: Method) -> list[tuple]:
    return [(b, v, None) for b, held in m.live().items() for v in held]


def _use_rows(m: Method) -> list[tuple]:
    return [(b, v, d) for b, held in m.reaching().items() for v, d in held if v in m.uses[b]]


def _dead_rows(m: Method) -> list[tuple]:
    live = m.live()
    return [(b, v, None) for b in m.order for v in m.defines[b] if not any(v in live[a] for a in m.after[b])]


def _dominator_rows(m: Method) -> list[tuple]:
    return [(b, None, d) for b, held in m.dominators().items() for d in held]


def _order_rows(m: Method) -> list[tuple]:
    return [(b, None, k) for k, b in enumerate(m.postorder())]


#: What each analysis gives per (block, variable, other): other is the defining block, the dominator, or the place in order.
ANALYSES: dict[str, Callable[[Method], list[tuple]]] = {
    "reaching_definitions": _reaching_rows, "liveness": _live_rows, "def_use": _use_rows, "dead_assignments": _dead_rows, "dominators": _dominator_rows, "reverse_postorder": _order_rows,
}


def analyse(blocks: DataFrame, edges: DataFrame, analysis: str) -> DataFrame:
    """``(method, block, variable, other)`` of one of ``ANALYSES``. Edges to unknown blocks are left out."""
    rows_of = ANALYSES[analysis]
    links = edges.groupBy(F.col("method").alias("m"), F.col("source").alias("s")).agg(F.collect_set("target").alias("targets"))
    own = blocks.select("method", "block", "position", "defines", "uses")
    linked = own.join(links, (own["method"] == links["m"]) & (own["block"] == links["s"]), "left").drop("m", "s")

    def fold(method: object, rows: list[tuple]) -> list[tuple]:
        return [(method, *r) for r in rows_of(Method((block, defines, uses, targets) for _, block, _, defines, uses, targets in rows))]

    return fold_groups(linked, "method", ["position", "block"], fold, "method bigint, block bigint, variable string, other bigint")


def sequential_taint(steps: DataFrame, sources: tuple[str, ...], sanitizers: tuple[str, ...]) -> DataFrame:
    """``(program, position, target)``: assignments whose value is tainted, folded in order through each program.

    ``steps(program, position, target, call, arguments)``: a call of a source taints, one of a sanitiser cleans, and any
    other value is tainted if an argument is.
    """

    def fold(program: object, rows: list[tuple]) -> list[tuple]:
        tainted: set[str] = set()
        found = []
        for _, position, target, call, arguments in rows:
            call = call or ""
            dirty = not call.endswith(sanitizers) and (call.endswith(sources) or any(a in tainted for a in (() if arguments is None else arguments)))
            (tainted.add if dirty else tainted.discard)(target)
            if dirty:
                found.append((program, position, target))
        return found

    return fold_groups(steps.select("program", "position", "target", "call", "arguments"), "program", ["position"], fold, "program bigint, position bigint, target string")


def constant_values(steps: DataFrame) -> DataFrame:
    """``(program, target, value)``: the constant that each variable holds at the end, null where it has none.

    ``steps(program, position, target, op, left, right)``: operands are integers or variable names; int arithmetic wraps.
    """

    def fold(program: object, rows: list[tuple]) -> list[tuple]:
        held: dict[str, int | None] = {}

        def value(text: str | None) -> int | None:
            if text is None:
                return None
            return int(text) if text.lstrip("-").isdigit() else held.get(text)

        for _, _, target, op, left, right in rows:
            a, b = value(left), value(right)
            held[target] = a if op == "=" else None if a is None or b is None else binary(op, a, b, 32)
        return [(program, t, v) for t, v in sorted(held.items())]

    return fold_groups(steps.select("program", "position", "target", "op", "left", "right"), "program", ["position"], fold, "program bigint, target string, value bigint")


def nullability(steps: DataFrame) -> DataFrame:
    """``(method, variable, state)`` after all steps of ``steps(method, position, variable, source)``.

    A source is null, nonnull, unknown, or the name of a variable; where branches join (several rows of one position)
    different states become maybe_null, or unknown if none of them may be null.
    """

    def fold(method: object, rows: list[tuple]) -> list[tuple]:
        held: dict[str, str] = {}
        for _, group in groupby(rows, key=lambda r: r[1]):
            new: dict[str, set[str]] = defaultdict(set)
            for _, _, variable, source in group:
                new[variable].add(source if source in ("null", "nonnull", "unknown") else held.get(source, "unknown"))
            held |= {v: next(iter(s)) if len(s) == 1 else "maybe_null" if s & {"null", "maybe_null"} else "unknown" for v, s in new.items()}
        return [(method, v, s) for v, s in sorted(held.items())]

    return fold_groups(steps.select("method", "position", "variable", "source"), "method", ["position", "variable", "source"], fold, "method bigint, variable string, state string")


def linear_edges(blocks: DataFrame) -> DataFrame:
    """Edges from each block to the next by position: a method without branches."""
    following = blocks.select("method", (F.col("position") - 1).alias("position"), F.col("block").alias("target"))
    return blocks.select("method", "position", F.col("block").alias("source")).join(following, ["method", "position"]).select("method", "source", "target")
