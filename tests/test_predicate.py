import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marlstone.predicate import EmptyInList, InactiveField, SyntaxProblem, TypeMismatch, UnknownField, UnsupportedOperator, compile_predicate, match, parse
from marlstone.predicate.syntax import Between, Both, Compare, Either, OneOf, Without

FIELDS = {"a": "int", "b": "int", "s": "str", "t": "bool"}
SCHEMA = "id int, a bigint, b bigint, s string, t boolean"
DATA = [(1, 1, 2, "x", True), (2, None, 2, "y", False), (3, None, 3, None, None), (4, 1, None, "x", None), (5, None, None, None, None), (6, -3, 7, "é'", True)]


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(DATA, SCHEMA).cache()


def test_precedence_and_literals():
    assert parse("a = 1 or b=2 AND t = TRUE") == Either(Compare("a", "=", 1), Both(Compare("b", "=", 2), Compare("t", "=", True)))
    assert parse(r"s = 'it\'s \q \\'") == Compare("s", "=", r"it's \q " + "\\")
    assert parse("NOT NOT a IN (1, -2)") == Without(Without(OneOf("a", (1, -2))))
    assert parse("a = -9223372036854775808").value == -(2**63)


@pytest.mark.parametrize("text", ["", "a", "a =", "a = 3.14", "a IN ()", "a IN (1,)", "a IN 1", "(a = 1", "a = 1 b = 2", "é = 1", "a = 9223372036854775808", "a ! 1", "a = 'x", "a = b", "a == 1", "not", "a = -", "a <> 1", "s = 'x\\"])
def test_syntax_errors(text):
    with pytest.raises(SyntaxProblem):
        parse(text)


def test_error_position_counts_bytes():
    with pytest.raises(SyntaxProblem) as e:
        parse("s = 'é' ;")
    assert e.value.position == 9


def test_validation_comes_first():
    for text, error in [
        ("nope = 1", UnknownField), ("a = 'x'", TypeMismatch), ("s = 1", TypeMismatch), ("a = true", TypeMismatch), ("t < true", UnsupportedOperator),
        ("a = 1 AND zzz = 2", UnknownField), ("a IN (1, 'x')", TypeMismatch), ("NOT (t = 1)", TypeMismatch),
    ]:
        with pytest.raises(error):
            compile_predicate(text, FIELDS)
    with pytest.raises(InactiveField):
        compile_predicate("a = 1", FIELDS, frozenset({"a"}))
    with pytest.raises(EmptyInList):
        compile_predicate(OneOf("a", ()), FIELDS)
    with pytest.raises(UnsupportedOperator):
        compile_predicate(Between("t", True, False), FIELDS)


def test_presence_universe(table):
    assert ids(match(table, "NOT (a = 1 AND b = 2)", FIELDS)) == [2, 3, 4, 6]
    assert ids(match(table, "NOT s = 'x'", FIELDS)) == [2, 6]
    assert ids(match(table, "a != 1", FIELDS)) == [6]
    assert ids(match(table, "NOT NOT a = 1", FIELDS)) == [1, 4]
    assert ids(match(table, Between("b", 2, 3), FIELDS)) == [1, 2, 3]
    assert ids(match(table, "t IN (true, true)", FIELDS)) == [1, 6]


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame(DATA, SCHEMA).write.parquet(str(tmp_path / "t"))
    df = match(spark.read.parquet(str(tmp_path / "t")), "a = 1 AND b > 0", FIELDS).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(a,1)" in plan and "GreaterThan(b,0)" in plan


leaf = st.one_of(
    st.builds(Compare, st.sampled_from("ab"), st.sampled_from(["=", "!=", "<", "<=", ">", ">="]), st.integers(-3, 7)),
    st.builds(Compare, st.just("s"), st.sampled_from(["=", "!=", "<", ">="]), st.sampled_from(["x", "y", "é'"])),
    st.builds(Compare, st.just("t"), st.sampled_from(["=", "!="]), st.booleans()),
    st.builds(OneOf, st.just("a"), st.lists(st.integers(-3, 2), min_size=1, max_size=3).map(tuple)),
)
tree = st.recursive(leaf, lambda t: st.one_of(st.builds(Both, t, t), st.builds(Either, t, t), st.builds(Without, t)), max_leaves=6)


def brute(node, table):
    """Rows as sets, without SQL's three values."""
    at = {"a": 1, "b": 2, "s": 3, "t": 4}
    if isinstance(node, Both):
        return brute(node.left, table) & brute(node.right, table)
    if isinstance(node, Either):
        return brute(node.left, table) | brute(node.right, table)
    if isinstance(node, Without):
        from marlstone.predicate.compile import named

        return {r[0] for r in table if any(r[at[f]] is not None for f in named(node.inner))} - brute(node.inner, table)
    have = [(r[0], r[at[node.field]]) for r in table if r[at[node.field]] is not None]
    if isinstance(node, OneOf):
        return {i for i, v in have if v in node.values}
    k = (lambda v: v.encode()) if node.field == "s" else (lambda v: v)
    test = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[node.op]
    return {i for i, v in have if test(k(v), k(node.value))}


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(tree)
def test_random_predicates(table, node):
    assert ids(match(table, node, FIELDS)) == sorted(brute(node, DATA))
