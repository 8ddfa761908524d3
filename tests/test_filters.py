import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trawl.operators import filters
from trawl.operators.filters import FilterError, Node, Comparison

TYPES = {"a": "integer", "s": "string", "f": "float", "b": "boolean", "d": "datetime", "notes": "integer"}


def test_precedence_and_keywords():
    assert filters.parse("a = 1 or NOT b = true and s != \"x\"") == Node(any=(Comparison("a", "eq", 1), Node(all=(Node(no=Comparison("b", "eq", True)), Comparison("s", "neq", "x")))))
    assert filters.parse("notes = 1") == Comparison("notes", "eq", 1)  # a key that begins like a keyword
    assert filters.parse(r's = "a \"q\""') == Comparison("s", "eq", 'a "q"')
    assert filters.parse("a IS NOT NULL") == Node(no=Comparison("a", "is_null"))


def test_keys():
    assert filters.parse("2fa = 1") == Comparison("2fa", "eq", 1) and filters.parse("007 IS NULL") == Comparison("007", "is_null")
    assert filters.parse("a-b_c >= -2.5") == Comparison("a-b_c", "gte", -2.5)
    for text in ("a.b = 1", "_a = 1", "-a = 1"):
        with pytest.raises(FilterError):
            filters.parse(text)


@pytest.mark.parametrize("text", ["a =", "a = 1 garbage", "(a = 1", "= 1", "a ~ 1", "a = 1 AND", "a IS 3"])
def test_errors(text):
    with pytest.raises(FilterError):
        filters.parse(text)


@pytest.mark.parametrize("text", ["x = 1", "s < \"a\"", "b > true", "a = \"1\"", "a = 1.5", "d = \"soon\"", "a = null"])
def test_static_types(text):
    with pytest.raises(FilterError):
        filters.validate(filters.parse(text), TYPES)


def test_tree_is_a_conjunction():
    tree = {"key": "a", "op": "eq", "value": 1, "or": [{"key": "s", "op": "eq", "value": "x"}], "not": {"key": "b", "op": "eq", "value": True}}
    assert filters.from_tree(tree) == Node(all=(Comparison("a", "eq", 1),), any=(Comparison("s", "eq", "x"),), no=Comparison("b", "eq", True))


tests_of = st.sampled_from(["a = 1", "a != 1", "a >= 2", "a IS NULL", 's = "x"', 's != "x"', "f < 0.5", "b = true"])
trees = st.recursive(tests_of, lambda x: st.one_of(st.tuples(x, st.sampled_from(["AND", "OR"]), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), x.map(lambda t: f"NOT ({t})")), max_leaves=5)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=trees)
def test_negation_is_two_valued(spark, text):
    rows = spark.createDataFrame([(1, "x", 0.1, True), (2, "y", 0.9, False), (None, None, None, None)], "meta_a long, meta_s string, meta_f double, meta_b boolean")
    yes, no = filters.metadata_filter(text, TYPES), filters.metadata_filter(f"NOT ({text})", TYPES)
    assert rows.select(F.count_if(yes).alias("y"), F.count_if(no).alias("n"), F.count_if(yes.isNull() | no.isNull()).alias("u")).first()[:] in [(y, 3 - y, 0) for y in range(4)]


def test_datetime_zone(spark):
    rows = spark.sql("SELECT timestamp_ntz'2024-01-01 12:00:00' AS meta_d")
    assert rows.where(filters.metadata_filter('d = "2024-01-01T13:00:00+01:00"', TYPES)).count() == 1
    assert rows.where(filters.metadata_filter('d >= "2024-01-02"', TYPES)).count() == 0


def test_tags(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, None)], "id int, tags array<string>")
    ids = lambda c: sorted(r.id for r in rows.where(c).collect())
    assert ids(filters.tags_filter(("a", "b"))) == [1, 2]
    assert ids(filters.tags_filter(("a", "b"), True)) == [1]
    assert ids(filters.tags_filter(())) == [1, 2, 3]
