import pytest
from pyspark.sql import functions as F

from graphloom.functions import versions as V
from graphloom.operators import semantics as P
from graphloom.operators.interpreter import interpret
from graphloom.operators.rules import Pack, Rule, RuleRegistry, resolve_packs


@pytest.mark.parametrize(
    ("text", "intents", "concepts", "kinds", "subject", "relation", "filters"),
    [
        ("REST endpoint", ["concept"], ["rest_endpoint"], [], None, None, {}),
        ("OwnerMap", ["exact_identity"], [], [], None, None, {}),
        ("type:a.b#c", ["exact_identity"], [], [], None, None, {}),
        ("classes OwnerMap", ["subject_kind"], [], ["type"], "ownermap", None, {}),
        ("depends on core-lib in project  shop?", ["relational", "compound"], [], [], "core-lib", "depends_on", {"project": "shop"}),
        ("services using hibernate", ["concept", "compound"], ["service"], [], None, None, {"using": "hibernate"}),
        ("something quite else", ["unknown"], [], [], None, None, {}),
        ("used by OwnerMap", ["relational", "ambiguous"], [], [], "ownermap", None, {}),
        ("cache or kafka", ["concept", "ambiguous"], ["caching", "kafka"], [], None, None, {}),
        ("ｃａｃｈｅ", ["concept"], ["caching"], [], None, None, {}),
    ],
)
def test_interpreter(text, intents, concepts, kinds, subject, relation, filters):
    plan = interpret(text)
    assert (plan.intents, plan.concepts, plan.kinds, plan.subject, plan.relation, plan.filters) == (intents, concepts, kinds, subject, relation, filters)


@pytest.mark.parametrize(("text", "relation"), [("?!", None), ("using x", None), ("calls foo", "imports")])
def test_interpreter_errors(text, relation):
    with pytest.raises(ValueError):
        interpret(text, relation)


@pytest.mark.parametrize(
    ("version", "constraint", "want"),
    [("1.2.3", "^1.0.0", True), ("2.0.0", "^1.0.0", False), ("0.3.0", "^0.2.5", False), ("0.0.3", "^0.0.3", True), ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False), ("1.0.0-rc", ">=1.0.0", False), ("1.0.0-a", "<1.0.0", True), ("1.0.0-b", ">1.0.0-a", True), ("1.10.0", ">1.9.0", True), ("x", ">=0.0.0", False), ("1.0.0", "1.0.0", True), (None, "1.0.0", False)],
)
def test_versions(spark, version, constraint, want):
    assert spark.createDataFrame([(version,)], "v string").select(V.satisfies(F.col("v"), constraint)).first()[0] is want


def test_packs():
    fits = lambda v, c: v == c or c == "*"
    a, b, c = Pack("a", "1", (("b", "2", False), ("gone", "*", True))), Pack("b", "2", (("c", "*", False),)), Pack("c", "3")
    assert resolve_packs([a, b, c], fits) == ["c", "b", "a"]
    for packs in ([a, Pack("b", "9"), c], [a], [Pack("x", "1", (("y", "*", False),)), Pack("y", "1", (("x", "*", False),))], [c, c]):
        with pytest.raises(ValueError):
            resolve_packs(packs, fits)


def test_rules(spark, rows):
    registry = RuleRegistry()
    registry.add(Rule("B", "high", lambda: F.col("n") > 1))
    registry.add(Rule("A", "low", lambda: F.col("n").isNotNull(), "has n"))
    df = spark.createDataFrame([("x", 2), ("y", None), ("x", 2)], "k string, n int")
    assert rows(registry.run(df, "k")) == [("x", "A", "low", "has n"), ("x", "B", "high", "")]
    assert rows(registry.run(df, "k", {"B"})) == [("x", "B", "high", "")] and rows(registry.run(df, "k", set())) == []
    with pytest.raises(ValueError):
        registry.add(Rule("A", "low", lambda: F.lit(True)))
    with pytest.raises(ValueError):
        registry.add(Rule("C", "bad", lambda: F.lit(True)))


def test_feasible(spark):
    data = [("a", "x", ">", 1.0), ("a", "x", "<", 2.0), ("b", "x", ">", 2.0), ("b", "x", "<=", 2.0), ("c", "x", "==", 1.0), ("c", "x", "!=", 1.0), ("d", "x", "==", 1.0), ("d", "x", "==", 2.0), ("e", "x", ">=", 2.0), ("e", "x", "<=", 2.0), ("e", "y", "!=", 2.0), ("f", "x", "==", 3.0), ("f", "x", "<", 3.0), ("g", "x", ">=", 2.0), ("g", "x", "<=", 2.0), ("g", "x", "!=", 2.0)]
    got = {r["state"]: r["feasible"] for r in P.feasible_states(spark.createDataFrame(data, "state string, variable string, op string, value double")).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False, "e": True, "f": False, "g": False}


def test_symbols_calls_switches(spark, rows):
    symbols = spark.createDataFrame([("a", None, "f"), ("b", "a", None), ("b", "zz", "g")], "id string, owner_id string, source string")
    assert rows(P.symbol_problems(symbols)) == [("b", "duplicate"), ("b", "orphan")]
    assert P.without_source(symbols, spark.createDataFrame([("f",)], "source string")).count() == 2
    methods = spark.createDataFrame([("m1", "T", "f", 1), ("m2", "U", "f", 1), ("m3", "U", "g", 0)], "method_id string, owner string, name string, arity int")
    calls = spark.createDataFrame([(1, "T", "f", 1), (2, "X", "f", 1), (3, "X", "h", 0), (4, "X", "print", 0)], "call_id int, receiver string, name string, arity int")
    assert rows(P.link_calls(calls, methods, spark.createDataFrame([("print",)], "name string"))) == [(1, "m1", "exact"), (2, "m1", "by_name"), (2, "m2", "by_name"), (3, None, "unresolved")]
    over = spark.createDataFrame([("m1", "f", ["long"]), ("m2", "f", ["int"]), ("m3", "f", []), ("m4", "f", ["text"])], "method_id string, name string, parameters array<string>")
    asked = spark.createDataFrame([(1, "f", ["int"]), (2, "f", []), (3, "f", ["text", "int"])], "call_id int, name string, arguments array<string>")
    assert [(r[0], r[1], r[3]) for r in rows(P.overloads(asked, over, spark.createDataFrame([("int", "long")], "narrow string, wide string")))] == [(1, "resolved", "m2"), (2, "resolved", "m3"), (3, "unresolved", None)]
    switches = spark.createDataFrame([(1, "S", None), (2, "S", True)], "switch_id int, type string, has_default boolean")
    assert rows(P.missing_cases(switches, spark.createDataFrame([(1, "A")], "switch_id int, leaf string"), spark.createDataFrame([("S", "A"), ("S", "B")], "type string, leaf string"))) == [(1, "B")]
    assert rows(spark.createDataFrame([(["x:Service", "x:controller"],), ([],)], "f array<string>").select(P.layer(F.col("f")))) == [("controller",), ("other",)]


def test_annotations(spark, rows):
    code = '/* @Entity */ @Entity class A { @OneToMany(mappedBy = "b") List<B> bs; @org.x.Autowired C c; // @Service\n @PostMapping(path = "/p") void f() {} @Override int g() {} }'
    got = P.annotation_facts(spark.createDataFrame([(1, code), (2, None)], "id int, code string"))
    assert rows(got) == [(1, "Autowired", None, "injection"), (1, "Entity", None, "entity"), (1, "OneToMany", "b", "relation"), (1, "PostMapping", "/p", "POST")]
