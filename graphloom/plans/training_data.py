"""The queries p1, p2, p3 and p6 over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators.nested_flatten import nested_items
from graphloom.operators.schema_drift import consistent_table, failed_casts, schema_changes
from graphloom.operators.snapshot_changes import snapshot_changes
from graphloom.operators.top_per_group import top_per_group
from graphloom.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "project_runs", ["analysis_run_id", "position", "project", "value_json", "received_at"], spread=True)
    return snapshot_changes(table(spark, folder, "analysis_runs"), runs)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return top_per_group(table(spark, folder, "risk_hotspots"), "project", "subject_id", "score", "scored_at")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested_items(table(spark, folder, "project_runs"), table(spark, folder, "analysis_runs"), table(spark, folder, "conversation_turns"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return schema_changes(table(spark, folder, "export_files"), table(spark, folder, "project_runs"), table(spark, folder, "conversation_turns"))


def p6_table(spark: SparkSession, folder: str) -> DataFrame:
    return consistent_table(table(spark, folder, "export_files"), table(spark, folder, "project_runs"), table(spark, folder, "conversation_turns"))


def p6_casts(spark: SparkSession, folder: str) -> DataFrame:
    return failed_casts(p6_table(spark, folder))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p6_found": p6_found, "p6_table": p6_table, "p6_casts": p6_casts}


def _array(value: str) -> str:
    """SQL for the elements of a JSON value: of an array, or of a lone object."""
    return f"CASE json_type({value}) WHEN 'ARRAY' THEN json_transform({value}, '[\"JSON\"]') WHEN 'OBJECT' THEN [{value}] ELSE [] END"


def _level(name: str, above: str, member: str) -> str:
    """SQL for the object elements of a member of the rows above."""
    held = _array(f"json_extract(v, '$.{member}')")
    step = f"SELECT t, id, pos, p AS parent, p || CASE p WHEN '' THEN '' ELSE '.' END || '{member}[' || (generate_subscripts(a, 1) - 1) || ']' AS p, unnest(a) AS v FROM (SELECT *, {held} AS a FROM {above})"
    return f"{name} AS (SELECT * FROM ({step}) WHERE json_type(v) = 'OBJECT')"


def _readable(text: str) -> str:
    """SQL for a JSON text that may be unreadable or wrapped once more in a string."""
    outer = f"CASE WHEN json_valid({text}) THEN {text}::JSON END"
    return f"CASE json_type({outer}) WHEN 'VARCHAR' THEN CASE WHEN json_valid({outer} ->> '$') THEN ({outer} ->> '$')::JSON END ELSE {outer} END"


def _root(name: str, above: str) -> str:
    step = f"SELECT t, id, pos, '' AS parent, '[' || (generate_subscripts(a, 1) - 1) || ']' AS p, unnest(a) AS v FROM (SELECT *, {_array('v')} AS a FROM {above})"
    return f"{name} AS (SELECT * FROM ({step}) WHERE json_type(v) IN ('OBJECT', 'VARCHAR'))"


_P3 = ", ".join(
    (
        f"pr AS (SELECT 'project_runs' AS t, id, pos, '' AS p, {_readable('x')} AS v FROM (SELECT analysis_run_id AS id, position AS pos, arg_max({{'x': value_json}}, received_at).x AS x FROM project_runs GROUP BY 1, 2))",
        f"ar AS (SELECT 'analysis_runs' AS t, id, -1 AS pos, {_readable('requested_json')} AS v FROM (SELECT DISTINCT id, requested_json FROM analysis_runs))",
        f"ct AS (SELECT 'conversation_turns' AS t, id, -1 AS pos, {_readable('x')} AS v FROM (SELECT id, arg_max({{'x': limitations_json}}, updated_at::TIMESTAMPTZ).x AS x FROM conversation_turns GROUP BY id))",
        "po AS (SELECT * FROM pr WHERE json_type(v) = 'OBJECT')",
        *(_level(*x) for x in (("m", "po", "modules"), ("ty", "m", "types"), ("me", "ty", "methods"), ("f", "po", "findings"), ("tr", "f", "trace"), ("ev", "tr", "evidence"))),
        _root("rq", "ar"), _level("sc", "rq", "scopes"), _root("li", "ct"), _level("su", "li", "subjects"),
    )
)

_P6 = ", ".join(
    (
        "fs AS (SELECT file_name AS f, feed, lag(file_name) OVER (PARTITION BY feed, workspace_fingerprint ORDER BY exported_at, file_name) AS b FROM (SELECT DISTINCT * FROM export_files))",
        f"st AS (SELECT f, project, json_extract(v, '$.stats') AS s FROM (SELECT export_file AS f, project, {_readable('value_json')} AS v FROM project_runs))",
        "ks AS (SELECT f, project, s, unnest(json_keys(s)) AS field FROM st WHERE json_type(s) = 'OBJECT')",
        "vs AS (SELECT f, project, field, x::VARCHAR AS x, CASE json_type(x) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'number' ELSE 'integer' END AS kind FROM (SELECT *, json_extract(s, '$.\"' || field || '\"') AS x FROM ks) WHERE json_type(x) <> 'NULL')",
        "ts AS (SELECT export_file AS f, unnest([{'field': 'snapshot_id', 'x': snapshot_id}, {'field': 'snapshot', 'x': snapshot}], recursive := true) FROM conversation_turns)",
        "every AS (SELECT f, field, kind FROM vs UNION ALL SELECT f, field, CASE WHEN regexp_full_match(x, '[0-9]{1,18}') THEN 'integer' WHEN json_valid(x) AND json_type(CASE WHEN json_valid(x) THEN x::JSON END) = 'OBJECT' THEN 'object' ELSE 'text' END FROM ts WHERE x IS NOT NULL)",
        "fd AS (SELECT f, field, kind FROM every GROUP BY f, field, kind QUALIFY row_number() OVER (PARTITION BY f, field ORDER BY count(*) DESC, kind) = 1)",
        "nw AS (SELECT fs.f, b, feed, field, kind FROM fs JOIN fd USING (f) WHERE b IS NOT NULL), od AS (SELECT fs.f, b, feed, field, kind FROM fs JOIN fd ON fd.f = b)",
        "cp AS (SELECT coalesce(nw.f, od.f) AS f, coalesce(nw.b, od.b) AS b, coalesce(nw.feed, od.feed) AS feed, coalesce(nw.field, od.field) AS field, od.kind AS k0, nw.kind AS k1 FROM nw FULL JOIN od ON nw.f = od.f AND nw.field = od.field)",
        "mv AS (SELECT g.f, g.b, g.feed, g.field AS o, c.field AS n FROM cp g JOIN cp c ON g.f = c.f AND g.k0 = c.k1 WHERE g.k1 IS NULL AND c.k0 IS NULL)",
        "pa AS (SELECT mv.f, o, n, x.project, bool_or(x.x = y.x) AS same FROM mv JOIN vs x ON x.f = mv.b AND x.field = o JOIN vs y ON y.f = mv.f AND y.field = n AND y.project = x.project WHERE feed = 'runs' GROUP BY ALL)",
        "fo AS (SELECT f, field, regexp_replace(regexp_replace(regexp_replace(lower(x), '^[a-z][a-z0-9]*:', ''), '[0-9a-f-]{6,}', '#', 'g'), '[0-9]+', '#', 'g') AS form FROM ts WHERE x IS NOT NULL GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY f, field ORDER BY count(*) DESC, form DESC) = 1)",
        "sc AS (SELECT f, o, n, count(*) FILTER (same) AS e FROM pa GROUP BY ALL HAVING count(*) FILTER (same) >= 0.5 * count(*) UNION ALL SELECT mv.f, o, n, 1 FROM mv JOIN fo a ON a.f = mv.b AND a.field = o JOIN fo z ON z.f = mv.f AND z.field = n AND z.form = a.form WHERE feed = 'turns')",
        "rn AS (SELECT f, o, n FROM sc QUALIFY row_number() OVER (PARTITION BY f, o ORDER BY e DESC, n) = 1 AND row_number() OVER (PARTITION BY f, n ORDER BY e DESC, o) = 1)",
    )
)

#: Every value under its field's one name, with the field's commonest type and whether the value can be cast to it.
_CASTS = ", ".join(
    (
        "li AS (SELECT DISTINCT o AS a, n AS b FROM rn JOIN fs USING (f) WHERE feed = 'runs'), tw AS (SELECT a, b FROM li UNION SELECT b, a FROM li), rc AS (SELECT a, b FROM tw UNION SELECT rc.a, tw.b FROM rc JOIN tw ON tw.a = rc.b), nm AS (SELECT a AS raw_name, least(a, min(b)) AS field FROM rc GROUP BY a)",
        "na AS (SELECT 'runs' AS feed, vs.f AS export_file, coalesce(nm.field, vs.field) AS field, vs.field AS raw_name, kind AS raw_type, vs.x::JSON ->> '$' AS v FROM vs LEFT JOIN nm ON nm.raw_name = vs.field UNION ALL SELECT 'turns', f, 'snapshot_id', field, CASE WHEN regexp_full_match(x, '[0-9]{1,18}') THEN 'integer' WHEN json_valid(x) AND json_type(CASE WHEN json_valid(x) THEN x::JSON END) = 'OBJECT' THEN 'object' ELSE 'text' END, x FROM ts WHERE x IS NOT NULL)",
        "ft AS (SELECT feed, field, raw_type AS field_type FROM na GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY feed, field ORDER BY count(*) DESC, raw_type) = 1)",
        "dg AS (SELECT *, CASE WHEN raw_type NOT IN ('object', 'array', 'boolean') THEN regexp_replace(regexp_replace(v, '([0-9]),([0-9]{3})', '\\1\\2', 'g'), '([0-9]),([0-9]{3})', '\\1\\2', 'g') END AS d, CASE WHEN json_valid(v) THEN json_type(v::JSON) END AS shape FROM na JOIN ft USING (feed, field))",
        "ca AS (SELECT *, CASE field_type WHEN 'integer' THEN coalesce(regexp_full_match(trim(d), '[+-]?[0-9]{1,38}') OR try_cast(d AS DECIMAL(38, 10)) = floor(try_cast(d AS DECIMAL(38, 10))), false) WHEN 'number' THEN try_cast(d AS DOUBLE) IS NOT NULL WHEN 'boolean' THEN raw_type IN ('boolean', 'string') AND lower(trim(v)) IN ('true', 'false') WHEN 'object' THEN coalesce(shape = 'OBJECT', false) WHEN 'array' THEN coalesce(shape = 'ARRAY', false) ELSE raw_type NOT IN ('object', 'array') END AS fits FROM dg)",
    )
)

_P1 = ", ".join(
    (
        f"held AS (SELECT analysis_run_id AS run, r.project AS project, {_readable('r.x')} AS v FROM (SELECT analysis_run_id, arg_max({{'project': project, 'x': value_json}}, received_at) AS r FROM project_runs GROUP BY analysis_run_id, position))",
        # a value is the set of its paths with kinds and atoms; null members are no paths, null elements are
        "nodes AS (SELECT run, project, j.fullkey AS k, CASE WHEN j.type IN ('OBJECT', 'ARRAY', 'NULL') THEN j.type WHEN j.type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN 'n' || j.atom::DOUBLE ELSE j.type || j.atom END AS what FROM held, json_tree(held.v) j WHERE v IS NOT NULL)",
        "flat AS (SELECT run, project, list_sort(list(k || '=' || what)) AS c FROM nodes WHERE NOT regexp_matches(k, '^\\$\\.stats($|[.\\[])') AND (what <> 'NULL' OR k LIKE '%]') GROUP BY run, project)",
        "rows_ AS (SELECT held.run, held.project, c FROM held LEFT JOIN flat USING (run, project))",
        "snap AS (SELECT id, lag(id) OVER (PARTITION BY workspace_fingerprint ORDER BY created_at::TIMESTAMPTZ, id) AS before FROM (SELECT DISTINCT id, workspace_fingerprint, created_at FROM analysis_runs WHERE regexp_full_match(requested_json, '\\s*\\[\\s*\\]\\s*')) WHERE id IN (SELECT analysis_run_id FROM project_runs))",
        "new_ AS (SELECT id AS run, project, c FROM snap JOIN rows_ ON run = id WHERE before IS NOT NULL), old_ AS (SELECT id AS run, project, c FROM snap JOIN rows_ ON run = before)",
    )
)

SQL = {
    "p6_casts": f"WITH RECURSIVE {_P6}, {_CASTS} SELECT feed, export_file, field, raw_name, field_type, count(*) AS rows, count(*) FILTER (raw_type <> field_type) AS other_type, count(*) FILTER (NOT fits) AS failed FROM ca GROUP BY ALL",
    "p1_found": f"WITH {_P1} SELECT coalesce(n.run, o.run) AS run_id, coalesce(n.project, o.project) AS project, CASE WHEN o.run IS NULL THEN 'added' WHEN n.run IS NULL THEN 'removed' ELSE 'changed' END AS change_kind FROM new_ n FULL JOIN old_ o ON n.run = o.run AND n.project = o.project WHERE o.run IS NULL OR n.run IS NULL OR n.c IS DISTINCT FROM o.c",
    "p6_found": f"WITH {_P6} SELECT f AS file_name, 'renamed' AS change_kind, o AS field_name, n AS new_name FROM rn UNION ALL SELECT f, CASE WHEN k0 IS NULL THEN 'added' WHEN k1 IS NULL THEN 'removed' ELSE 'retyped' END, field, '' FROM cp WHERE (k0 IS NULL OR k1 IS NULL OR k0 <> k1) AND (f, field) NOT IN (SELECT (f, o) FROM rn UNION ALL SELECT (f, n) FROM rn)",
    "p3_found": f"WITH {_P3} " + " UNION ALL ".join(f"SELECT t AS record_table, id AS record_id, pos AS record_position, p AS item_path, parent AS parent_path FROM {x}" for x in ("m", "ty", "me", "f", "tr", "ev", "rq", "sc", "li", "su")),
    "p2_found": "WITH l AS (SELECT project, subject_id, arg_max({'s': score}, scored_at).s AS score FROM risk_hotspots WHERE project IS NOT NULL GROUP BY 1, 2) SELECT project, subject_id, row_number() OVER (PARTITION BY project ORDER BY score DESC, subject_id)::INT AS place FROM l WHERE score IS NOT NULL AND NOT isnan(score) QUALIFY place <= 5",
}
