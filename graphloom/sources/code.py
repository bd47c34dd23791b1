"""Code in texts: blocks, declarations in several languages, and settings files."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.grouped import fold_groups
from graphloom.session import ship


def code_blocks(documents: DataFrame) -> DataFrame:
    """``(id, block, language, code)`` of the fenced blocks of ``documents(id, text)``; the language is guessed from the code.

    A text without fences that begins as code of a known language does is code alone, and so one block.
    """
    bare = F.regexp_replace("text", r"\r\n?", "\n")
    fenced = F.regexp_extract_all(bare, F.lit(r"(?s)```[A-Za-z0-9]*\n(.*?)\n```"), 1)
    found = F.when(~bare.contains("```") & (code_language(bare) != "unknown"), F.array(bare)).otherwise(fenced)
    rows = documents.select("id", F.posexplode(found).alias("block", "code"))
    return rows.select("id", "block", code_language(F.col("code")).alias("language"), "code")


def code_language(code: Column) -> Column:
    """java, python, sql, shell, json, typescript or unknown, by the first line."""
    head = F.ltrim(code)
    return (
        F.when(head.rlike(r"^(?:public|private|protected|final|abstract|package|import java|class \w+ (?:\{|extends|implements))"), "java").when(head.rlike(r"^(?:def |class \w+[:(]|from \w|import \w)"), "python")
        .when(head.rlike(r"^(?i:select|insert|update|delete|create|with)\s"), "sql").when(head.startswith("$ "), "shell").when(head.rlike(r"^[\[{]"), "json")
        .when(head.rlike(r"^(?:export |interface \w+|const \w+|function \w+)"), "typescript").otherwise("unknown")
    )


class Declaration(NamedTuple):
    kind: str
    name: str
    owner: str
    line: int


_JAVA_MASK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_JAVA_TYPE = re.compile(r"\b(class|interface|enum|record|@interface)\s+([A-Za-z_$][\w$]*)")
_JAVA_MEMBER = re.compile(r"\b(?:(?:public|private|protected|static|final|abstract|synchronized|default|volatile|transient)\s+)+(?:[\w$<>\[\],.?]+\s+)?([A-Za-z_$][\w$]*)\s*(\(|=|;)")
_TS_DECLARATION = re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(class|interface|enum|function|type|const)\s+([A-Za-z_$][\w$]*)", re.M)
_SQL_TABLE = re.compile(r"\b(?:from|join|into|update)\s+([A-Za-z_][\w.]*)", re.I)


def _blank(match: re.Match) -> str:
    return re.sub(r"[^\n]", " ", match[0])


def java(code: str) -> Iterator[Declaration]:
    """Types with the types around them, and members, from braces and keywords outside comments and literals."""
    plain = _JAVA_MASK.sub(_blank, code)
    events = sorted(
        [(m.start(), "type", m) for m in _JAVA_TYPE.finditer(plain)] + [(m.start(), "member", m) for m in _JAVA_MEMBER.finditer(plain)] + [(m.start(), m[0], m) for m in re.finditer(r"[{}]", plain)],
        key=lambda e: e[0],
    )
    owners: list[str | None] = []
    waiting: str | None = None
    for at, what, match in events:
        around = ".".join(o for o in owners if o)
        line = plain.count("\n", 0, at) + 1
        if what == "type":
            yield Declaration(match[1].lstrip("@") if match[1] != "@interface" else "annotation", match[2], around, line)
            waiting = match[2]
        elif what == "{":
            owners.append(waiting)
            waiting = None
        elif what == "}":
            if owners:
                owners.pop()
        elif owners and owners[-1] and match[1] not in ("class", "interface", "enum", "record"):
            yield Declaration("method" if match[2] == "(" else "field", match[1], around, line)


def python(code: str) -> Iterator[Declaration]:
    """Classes, functions and methods by the language's own parser."""

    def walk(body: list[ast.stmt], owner: str) -> Iterator[Declaration]:
        for node in body:
            if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "class" if isinstance(node, ast.ClassDef) else "method" if owner else "function"
                yield Declaration(kind, node.name, owner, node.lineno)
                yield from walk(node.body, f"{owner}.{node.name}".lstrip("."))

    yield from walk(ast.parse(code).body, "")


def typescript(code: str) -> Iterator[Declaration]:
    for match in _TS_DECLARATION.finditer(_JAVA_MASK.sub(_blank, code)):
        yield Declaration(match[1], match[2], "", code.count("\n", 0, match.start(2)) + 1)


def sql(code: str) -> Iterator[Declaration]:
    for match in _SQL_TABLE.finditer(code):
        yield Declaration("table", match[1], "", code.count("\n", 0, match.start()) + 1)


#: The frontends by language; a caller may add its own.
FRONTENDS: dict[str, Callable[[str], Iterator[Declaration]]] = {"java": java, "python": python, "typescript": typescript, "sql": sql}


def declarations(blocks: DataFrame, frontends: dict[str, Callable[[str], Iterator[Declaration]]] | None = None) -> DataFrame:
    """``(id, block, language, kind, name, owner, line)`` of ``blocks(id, block, language, code)``; code that cannot be parsed declares nothing."""
    ship(blocks.sparkSession)
    known = frontends or FRONTENDS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for own, block, language, code in batch.itertuples(index=False):
                try:
                    rows += [(own, block, language, *d) for d in known[language](code)]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=["id", "block", "language", *Declaration._fields])

    return blocks.where(F.col("language").isin(*known)).select("id", "block", "language", "code").mapInPandas(run, "id bigint, block int, language string, kind string, name string, owner string, line int")


def properties(text: str) -> dict[str, str]:
    """Keys and values of a properties file: ``=`` or ``:`` separates, ``#`` and ``!`` begin comments, a backslash goes on."""
    found: dict[str, str] = {}
    joined = re.sub(r"\\\r?\n[ \t]*", "", text)
    for line in joined.splitlines():
        bare = line.strip()
        if bare and bare[0] not in "#!":
            key, value = re.match(r"((?:\\.|[^=:\s\\])*)[ \t]*[=:]?[ \t]*(.*)", bare).groups()
            found[re.sub(r"\\(.)", r"\1", key)] = value
    return found


def flattened_yaml(text: str) -> dict[str, str]:
    """Dotted keys and scalar values of a YAML mapping by indentation; list items get their number. Anchors and flow style are left as text."""
    found: dict[str, str] = {}
    stack: list[tuple[int, str]] = []
    counts: dict[str, int] = {}
    for line in text.splitlines():
        bare = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not bare.strip() or bare.strip() in ("---", "..."):
            continue
        indent = len(bare) - len(bare.lstrip())
        body = bare.strip()
        while stack and stack[-1][0] >= indent and not (body.startswith("- ") and stack[-1][0] == indent and not stack[-1][1].endswith("]")):
            stack.pop()
        prefix = ".".join(k for _, k in stack).replace(".[", "[")
        if body.startswith("- ") or body == "-":
            n = counts[prefix] = counts.get(prefix, -1) + 1
            stack.append((indent, f"[{n}]"))
            prefix, body, indent = f"{prefix}[{n}]", body[2:].strip(), indent + 2
        match = re.match(r"""("[^"]*"|'[^']*'|[^:\s][^:]*):(?:\s+(.*))?$""", body)
        if match:
            key = match[1].strip().strip("\"'")
            full = f"{prefix}.{key}".lstrip(".")
            if match[2]:
                found[full] = match[2].strip().strip("\"'")
            else:
                stack.append((indent, key))
        elif body:
            found[prefix] = body.strip("\"'")
    return found


def config_values(files: DataFrame) -> DataFrame:
    """``(path, key, value)`` of the properties and YAML files among ``files(path, content)``, by suffix; null contents have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, k, v) for path, text in zip(batch["path"], batch["content"]) for k, v in (properties if path.endswith(".properties") else flattened_yaml)(text).items()]
            yield pd.DataFrame(rows, columns=["path", "key", "value"])

    ship(files.sparkSession)
    return files.where(F.col("path").rlike(r"\.(properties|ya?ml)$") & F.col("content").isNotNull()).select("path", "content").mapInPandas(run, "path string, key string, value string")


def unflattened(values: DataFrame) -> DataFrame:
    """``(path, json)``: the dotted keys of ``config_values`` put together again as nested objects; a key that is also a prefix of others keeps its value under ``""``."""

    def fold(path: object, rows: list[tuple]) -> list[tuple]:
        root: dict = {}
        for _, key, value in rows:
            node = root
            *above, last = key.split(".")
            for part in above:
                if not isinstance(node.get(part), dict):
                    node[part] = {"": node[part]} if part in node else {}
                node = node[part]
            if isinstance(node.get(last), dict):
                node[last][""] = value
            else:
                node[last] = value
        return [(path, json.dumps(root, sort_keys=True, separators=(",", ":"), ensure_ascii=False))]

    return fold_groups(values.select("path", "key", "value"), "path", ["key"], fold, "path string, json string")


def without_comments(code: Column) -> Column:
    """Code of the C family without line and block comments; texts in quotes stay as they are."""
    return F.regexp_replace(code, r"""(?s)("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|//[^\n]*|/\*.*?(?:\*/|$)""", "$1")


def literal_arguments(code: Column, call: str) -> Column:
    """The texts in quotes that ``call`` is given, in order; arguments that are no plain texts are left out. Comments do not count."""
    one = r"(?:\"[^\"\n]*\"|'[^'\n]*'|[\w.]+)"
    lists = F.regexp_extract_all(without_comments(code), F.lit(rf"(?m)^[ \t]*{call}\b(?:[ \t]+|[ \t]*\(\s*)({one}(?:\s*,\s*{one})*)"), 1)
    texts = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(r"\"([^\"\n]*)\"|'([^'\n]*)'"), 0)))
    return F.transform(texts, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


#: Folders of compiled sources below a module, most specific first, and folders below them that are none.
SOURCE_FOLDERS = ("src/main/java", "src/main/kotlin", "src/main/groovy", "src/main/scala", "src")
NO_SOURCES = ("test", "tests", "resources", "fixture", "fixtures", "generated")


def source_roots(files: DataFrame) -> DataFrame:
    """``(root, files)``: the compiled source root of each source file ``(path)`` and how many it has; files below tests, resources,
    fixtures and generated folders have none."""
    slashed = F.concat(F.lit("/"), "path")
    root = F.lit(None).cast("string")
    for folder in reversed(SOURCE_FOLDERS):
        at = F.instr(slashed, f"/{folder}/")
        root = F.when(at > 0, F.substring(slashed, F.lit(2), at + len(folder) - 1)).otherwise(root)
    code = F.col("path").rlike(r"\.(java|kt|kts|groovy|scala)$") & ~F.lower(slashed).rlike(r"/(" + "|".join(NO_SOURCES) + r")(/|-)")
    return files.where(code).withColumn("root", root).where("root is not null").groupBy("root").agg(F.count("*").alias("files"))
