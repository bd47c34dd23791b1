"""Problem 6: fields that come, go, change their name or their type from file to file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text_json import variant
from graphloom.operators.graph import components
from graphloom.operators.ordering import with_neighbours
from graphloom.session import shared_table

#: Share of the projects in both files whose values must agree for a field to count as renamed.
SAME_CONTENT = 0.5


def json_type(kind: Column) -> Column:
    """object, array, string, boolean, integer or number by a VARIANT's schema; null for JSON null. A fraction or exponent makes a number."""
    whole = kind.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT)") | kind.rlike(r"^DECIMAL\((19|[23]\d),0\)")
    return (
        F.when(kind == "VOID", None).when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(whole, "integer").otherwise("number")
    )


def snapshot_type(text: Column) -> Column:
    """integer (digits only, at most 18), object, or text."""
    return F.when(text.rlike(r"^[0-9]{1,18}$"), "integer").when(F.json_object_keys(text).isNotNull(), "object").otherwise("text")


def path_values(project_runs: DataFrame) -> DataFrame:
    """One row per non-null member of ``stats``: file_name, project, field, kind, value_hash.

    All rows count, also superseded ones; unreadable values and other shapes of ``stats`` have no members.
    """
    members = F.try_variant_get(variant(F.col("value_json")), "$.stats", "map<string,variant>")
    rows = project_runs.select(F.col("export_file").alias("file_name"), "project", F.explode(members).alias("field", "value"))
    shaped = rows.where(F.col("file_name").isNotNull()).withColumn("shape", F.schema_of_variant("value")).where("shape <> 'VOID'")
    typed = shaped.withColumn("kind", json_type(F.col("shape")))
    return typed.select("file_name", "project", "field", "kind", F.xxhash64(F.to_json("value")).alias("value_hash"))


def _fields(values: DataFrame) -> DataFrame:
    """(file_name, field, kind): the type that most rows of a file have; at a tie the first by name."""
    counts = values.groupBy("file_name", "field", "kind").agg(F.count("*").alias("n"))
    return counts.groupBy("file_name", "field").agg(F.min(F.struct(-F.col("n"), "kind")).alias("best")).select("file_name", "field", "best.kind")


def _turn_values(turns: DataFrame) -> DataFrame:
    """(file_name, field, kind, form) of every snapshot reference; the form is the value without a scheme before
    it (such as ``sha256:``) and with a mark for its digits and hex runs."""
    columns = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in ("snapshot_id", "snapshot"))))
    rows = turns.select(F.col("export_file").alias("file_name"), columns.alias("x")).select("file_name", "x.field", "x.value").where(F.col("value").isNotNull() & F.col("file_name").isNotNull())
    bare = F.regexp_replace(F.lower("value"), "^[a-z][a-z0-9]*:", "")
    form = F.regexp_replace(F.regexp_replace(bare, "[0-9a-f-]{6,}", "#"), "[0-9]+", "#")
    return rows.select("file_name", "field", snapshot_type(F.col("value")).alias("kind"), form.alias("form"))


def _compared(files: DataFrame, fields: DataFrame) -> DataFrame:
    """file_name, previous, field, old_kind, new_kind: each file's fields beside those of the file before."""
    pairs = files.where(F.col("previous").isNotNull()).select("file_name", "previous")
    new = pairs.join(fields, "file_name").select("file_name", "previous", "field", F.col("kind").alias("new_kind"))
    old = pairs.join(fields.select(F.col("file_name").alias("previous"), "field", "kind"), "previous").select("file_name", "previous", "field", F.col("kind").alias("old_kind"))
    return new.join(old, ["file_name", "previous", "field"], "full_outer")


def _ends(compared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fields that go (file_name, previous, old, kind) and those that come (file_name, new, kind)."""
    gone = compared.where(F.col("new_kind").isNull()).select("file_name", "previous", F.col("field").alias("old"), F.col("old_kind").alias("kind"))
    return gone, compared.where(F.col("old_kind").isNull()).select("file_name", F.col("field").alias("new"), F.col("new_kind").alias("kind"))


def _agreeing(compared: DataFrame, values: DataFrame) -> DataFrame:
    """Fields of one type that go and come with values that agree project by project, one new name for an old one: file_name, old, new.

    Only values of fields that go where one of their type comes, and the reverse, are compared. Fields meet only where a
    project has one value under both, by its hash; fields that share nothing never do.
    """
    gone, come = _ends(compared)
    meets = ["file_name", "kind"]
    gone, come = shared_table(gone.join(come.select(*meets).distinct(), meets, "left_semi")), shared_table(come.join(gone.select(*meets).distinct(), meets, "left_semi"))
    keys = ["file_name", "old", "new"]
    before = values.select(F.col("file_name").alias("previous"), F.col("field").alias("old"), "project", "value_hash").join(gone, ["previous", "old"]).select("file_name", "old", "kind", "project", "value_hash").distinct()
    after = values.select("file_name", F.col("field").alias("new"), "project", "value_hash").join(come, ["file_name", "new"]).select("file_name", "new", "kind", "project", "value_hash").distinct()
    same = before.join(after, ["file_name", "kind", "project", "value_hash"]).select(*keys, "project").distinct().groupBy(*keys).agg(F.count("*").alias("equal"))
    same = shared_table(same)
    olds, news = before.select("file_name", "old", "project").distinct(), after.select("file_name", "new", "project").distinct()
    both = same.join(olds, ["file_name", "old"]).join(news, ["file_name", "new", "project"]).groupBy(*keys).agg(F.count("*").alias("both"))
    scores = same.join(both, keys).where(F.col("equal") >= SAME_CONTENT * F.col("both"))
    return _one_to_one(scores, F.col("equal"))


def _alike(compared: DataFrame, values: DataFrame) -> DataFrame:
    """Fields of one type that go and come with values of one form, which is the commonest of each: file_name, old, new."""
    gone, come = _ends(compared)
    counts = values.groupBy("file_name", "field", "form").agg(F.count("*").alias("n"))
    forms = counts.groupBy("file_name", "field").agg(F.max(F.struct("n", "form")).alias("best")).select("file_name", "field", "best.form", "best.n")
    before = gone.join(forms.select(F.col("file_name").alias("previous"), F.col("field").alias("old"), "form", "n"), ["previous", "old"])
    after = come.join(forms.select("file_name", F.col("field").alias("new"), "form"), ["file_name", "new"])
    return _one_to_one(before.join(after, ["file_name", "kind", "form"]), F.col("n"))


def _one_to_one(pairs: DataFrame, weight: Column) -> DataFrame:
    by_old = Window.partitionBy("file_name", "old").orderBy(weight.desc(), "new")
    by_new = Window.partitionBy("file_name", "new").orderBy(weight.desc(), "old")
    return pairs.withColumn("i", F.row_number().over(by_old)).withColumn("j", F.row_number().over(by_new)).where("i = 1 and j = 1").select("file_name", "old", "new")


def _report(compared: DataFrame, renamed: DataFrame) -> DataFrame:
    ends = renamed.select("file_name", F.col("old").alias("field")).unionByName(renamed.select("file_name", F.col("new").alias("field")))
    kind = F.when(F.col("old_kind").isNull(), "added").when(F.col("new_kind").isNull(), "removed").when(F.col("old_kind") != F.col("new_kind"), "retyped")
    single = compared.withColumn("change_kind", kind).where(F.col("change_kind").isNotNull()).join(ends, ["file_name", "field"], "left_anti")
    rows = single.select("file_name", "change_kind", F.col("field").alias("field_name"), F.lit("").alias("new_name"))
    return rows.unionByName(renamed.select("file_name", F.lit("renamed").alias("change_kind"), F.col("old").alias("field_name"), F.col("new").alias("new_name")))


def schema_changes(export_files: DataFrame, project_runs: DataFrame, conversation_turns: DataFrame) -> DataFrame:
    """``(file_name, change_kind, field_name, new_name)``: each file's fields against the file before of its feed and workspace.

    Files follow each other by ``exported_at``, then name; a file without rows has no fields. A member of ``stats``
    is renamed to another when, of the projects in both files, at least half have an equal value under both names.
    ``snapshot_id`` and ``snapshot`` are two places of one reference whose values are new in each file, so a change of
    place with one type and one form of the values (such as hex digits) is a renaming.
    """
    files = export_files.where(F.col("file_name").isNotNull()).dropDuplicates(["file_name"]).withColumn("chain", F.concat_ws("|", "feed", "workspace_fingerprint"))
    chained = shared_table(with_neighbours(files.select("file_name", "feed", "chain", "exported_at"), "chain", ["exported_at", "file_name"], "file_name").select("file_name", "feed", "previous"))
    values = shared_table(path_values(project_runs))
    runs = shared_table(_compared(chained.where("feed = 'runs'"), _fields(values)))
    references = _turn_values(conversation_turns)
    turns = _compared(chained.where("feed = 'turns'"), _fields(references))
    renamed = shared_table(_agreeing(runs, values))
    moved = _alike(turns, references)
    return _report(runs, renamed).unionByName(_report(turns, moved))


def canonical_names(renamed: DataFrame) -> DataFrame:
    """``(raw_name, field)``: one name for all names of a field, the least of those linked by renamings, of any file."""
    links = renamed.select(F.col("field_name").alias("source"), F.col("new_name").alias("target")).distinct()
    return components(links).select(F.col("node").alias("raw_name"), F.col("component").alias("field"))


def _typed(kind: Column, raw_type: Column, value: Column) -> dict[str, Column]:
    """One column for each type, null unless the field is of that type and the value can be cast to it.

    Group separators are read; an integer has no fraction; ``true`` and ``false`` are read from texts, and so are objects and
    arrays; other values than objects and arrays are texts. ``number`` also holds what an integer field has with a fraction.
    """
    digits = F.when(~raw_type.isin("object", "array", "boolean"), F.regexp_replace(value, r"(?<=\d),(?=\d{3}(\D|$))", ""))
    exact = digits.try_cast("decimal(38,10)")
    whole = F.when(F.trim(digits).rlike(r"^[+-]?[0-9]+$"), digits.try_cast("decimal(38,0)")).when(exact == F.floor(exact), exact.try_cast("decimal(38,0)"))
    shape = F.schema_of_variant(F.try_parse_json(value))
    return {
        "integer": F.when(kind == "integer", whole),
        "number": F.when(kind.isin("integer", "number"), digits.try_cast("double")),
        "flag": F.when((kind == "boolean") & raw_type.isin("boolean", "string") & F.lower(F.trim(value)).isin("true", "false"), F.lower(F.trim(value)) == "true"),
        "text": F.when(kind.isin("string", "text") & ~raw_type.isin("object", "array"), value),
        "json": F.when((kind == "object") & shape.startswith("OBJECT") | (kind == "array") & shape.startswith("ARRAY"), value),
    }


def _members(project_runs: DataFrame) -> DataFrame:
    """Every non-null member of ``stats`` under its own name."""
    members = F.try_variant_get(variant(F.col("value_json")), "$.stats", "map<string,variant>")
    rows = project_runs.select("analysis_run_id", F.lit(None).cast("bigint").alias("turn_id"), "position", "export_file", F.explode(members).alias("raw_name", "v"))
    value = F.coalesce(F.try_variant_get("v", "$", "string"), F.to_json("v"))
    return rows.select(F.lit("runs").alias("feed"), "analysis_run_id", "turn_id", "position", "export_file", "raw_name", json_type(F.schema_of_variant("v")).alias("raw_type"), value.alias("value")).where(F.col("raw_type").isNotNull())


def _references(turns: DataFrame) -> DataFrame:
    """Every non-null snapshot reference with the column that it stands in."""
    places = F.explode(F.array(*(F.struct(F.lit(n).alias("raw_name"), F.col(n).alias("value")) for n in ("snapshot_id", "snapshot"))))
    rows = turns.select(F.col("id").alias("turn_id"), "position", "export_file", places.alias("x")).where(F.col("x.value").isNotNull())
    return rows.select(F.lit("turns").alias("feed"), F.lit(None).cast("bigint").alias("analysis_run_id"), "turn_id", "position", "export_file", "x.raw_name", snapshot_type(F.col("x.value")).alias("raw_type"), "x.value")


def consistent_table(export_files: DataFrame, project_runs: DataFrame, conversation_turns: DataFrame) -> DataFrame:
    """``(feed, analysis_run_id, turn_id, position, export_file, field, field_type, raw_name, raw_type, value, integer, number,
    flag, text, json, cast_failed)``: every member of ``stats`` and every snapshot reference under one name, its text, and
    its value in the column of the field's type, which is its commonest one (at a tie the first by name).

    Snapshot references are the field ``snapshot_id`` of the feed ``turns``, whichever column they stand in. Values that
    cannot be cast to the field's type are reported, not dropped.
    """
    changes = schema_changes(export_files, project_runs, conversation_turns)
    names = canonical_names(changes.where("change_kind = 'renamed' and new_name not in ('snapshot', 'snapshot_id')"))
    members = _members(project_runs).join(names, "raw_name", "left").withColumn("field", F.coalesce("field", "raw_name"))
    named = members.unionByName(_references(conversation_turns).withColumn("field", F.lit("snapshot_id")))
    kinds = named.groupBy("feed", "field", "raw_type").agg(F.count("*").alias("n")).groupBy("feed", "field").agg(F.min(F.struct(-F.col("n"), "raw_type")).alias("k")).select("feed", "field", F.col("k.raw_type").alias("field_type"))
    typed = named.join(kinds, ["feed", "field"]).withColumns(_typed(F.col("field_type"), F.col("raw_type"), F.col("value")))
    cast = F.when(F.col("field_type") == "integer", F.col("integer").isNull()).otherwise(F.coalesce(F.col("number").cast("string"), F.col("flag").cast("string"), "text", "json").isNull())
    return typed.select("feed", "analysis_run_id", "turn_id", "position", "export_file", "field", "field_type", "raw_name", "raw_type", "value", "integer", "number", "flag", "text", "json", cast.alias("cast_failed"))


def failed_casts(consistent: DataFrame) -> DataFrame:
    """``(feed, export_file, field, raw_name, field_type, rows, other_type, failed)``: per file and name, how many values have
    another type than the field, and how many could not be cast to it."""
    counts = (F.count("*").alias("rows"), F.count_if(F.col("raw_type") != F.col("field_type")).alias("other_type"), F.count_if("cast_failed").alias("failed"))
    return consistent.groupBy("feed", "export_file", "field", "raw_name", "field_type").agg(*counts)
