from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators import relalg


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_union_is_a_set(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert rows(relalg.distinct_union(a, a)) == [(1,), (2,)]


def test_count_with_zero_and_empty_relation(spark):
    sites = spark.createDataFrame([("a",), ("b",)], "site string")
    none = spark.createDataFrame([], "site string")
    assert rows(relalg.count_with_zero(sites, none, ["site"])) == [("a", 0), ("b", 0)]


def test_division(spark):
    pairs = spark.createDataFrame([("x", 1), ("x", 2), ("x", 2), ("y", 1)], "item string, v int")
    assert rows(relalg.division(pairs, "item", "v", spark.createDataFrame([(1,), (2,)], "v int"))) == [("x",)]


def test_nearest_breaks_ties(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "z"), ("k", 1, "a")], "k string, d int, n string")
    assert rows(relalg.nearest(df, ["k"], F.col("d"), F.col("n"))) == [("k", 1, "a")]


def test_range_join_equals_brute_force(spark):
    points = [(1, x) for x in range(0, 40, 3)]
    spans = [(1, 5, 5), (1, 0, 39), (1, 11, 23), (2, 0, 39)]
    got = rows(relalg.range_join(spark.createDataFrame(points, "k int, at int"), spark.createDataFrame(spans, "k int, low int, high int"), ["k"], "at", "low", "high", 7).select("at", "low", "high"))
    assert got == sorted((x, lo, hi) for _, x in points for k, lo, hi in spans if k == 1 and lo <= x <= hi)


def test_as_of_is_strictly_before(spark):
    left = spark.createDataFrame([("u", 5), ("u", 3), ("w", 1)], "k string, t int")
    right = spark.createDataFrame([("u", 3, "a"), ("u", 4, "b"), ("w", 1, "c")], "k string, t int, v string")
    assert rows(relalg.as_of(left, right, ["k"], "t", ["v"]).select("k", "t", F.coalesce("prior_v", F.lit("-")))) == [("u", 3, "-"), ("u", 5, "b"), ("w", 1, "-")]


def test_generate_excludes_the_end(spark):
    df = spark.createDataFrame([(0,), (2,)], "n int")
    assert rows(relalg.generate(df, F.lit(0), F.col("n"), "g")) == [(2, 0), (2, 1)]


def test_string_functions(spark):
    r = spark.range(1).select(
        fn.substr(F.lit("abcdef"), 0, 2), fn.substr(F.lit("abcdef"), 2, 2), fn.contains("cd", F.lit("abcdef")), fn.match("a.c", F.lit("abcd")), fn.to_number(F.lit("x1")), fn.kebab(F.lit("myTagName")), fn.strip_quotes(F.lit("'q'")), fn.prefixes(F.lit("a.b.c")), fn.visibility(F.lit(" public_access ")), fn.upper_first(F.lit("get"))
    ).first()
    assert tuple(r) == ("ab", "cd", True, False, None, "my-tag-name", "q", ["a", "a.b", "a.b.c"], "PUBLIC", "Get")
