import random

import pytest

from graphloom.operators import config, fixpoint, graph, hierarchy, tiers

EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("c", "d"), ("x", "d"), ("a", "b")]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def edges(spark):
    return spark.createDataFrame(EDGES, "a string, b string")


def test_closure_with_cycle_and_loop(spark, edges):
    pairs = set(EDGES)
    while True:
        more = pairs | {(a, d) for a, b in pairs for c, d in pairs if b == c}
        if more == pairs:
            break
        pairs = more
    assert rows(fixpoint.closure(edges)) == sorted(pairs)


def test_closure_of_nothing(spark):
    assert fixpoint.closure(spark.createDataFrame([], "a string, b string")).isEmpty()


def test_a_bound_that_is_too_small_raises(spark, edges):
    with pytest.raises(fixpoint.NotConverged):
        fixpoint.closure(edges, 1)


def test_distances_and_parents(spark, edges):
    found = graph.distances(edges, spark.createDataFrame([("a",)], "node string"))
    assert rows(found) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(graph.parents(edges, found)) == [("b", 1, "a"), ("c", 2, "b"), ("d", 3, "c")]


def test_depth_bound(spark, edges):
    assert rows(graph.distances(edges, spark.createDataFrame([("a",)], "node string"), 1)) == [("a", 0), ("b", 1)]


def test_shortest_paths_and_between(spark, edges):
    a, d = (spark.createDataFrame([(n,)], "node string") for n in "ad")
    assert rows(graph.shortest_path_edges(edges, a, d)) == [("a", "b", 1), ("b", "c", 2), ("c", "d", 3)]
    assert rows(graph.between(edges, a, d)) == [("a",), ("b",), ("c",), ("d",)]


def test_impact_only_through_and_overlay(spark, edges):
    d = spark.createDataFrame([("d",)], "node string")
    assert rows(graph.impact(edges, d)) == [("a", 3), ("b", 2), ("c", 1), ("x", 1)]
    a = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.only_through(edges, a, ("b", "c"))) == [("c",), ("d",)]
    from pyspark.sql import functions as F

    tiered = edges.withColumn("tier", F.lit("known_edge"))
    got = rows(graph.with_overlay(tiered, spark.createDataFrame([("d", "e")], "a string, b string"), spark.createDataFrame([("x", "d")], "a string, b string")))
    assert ("d", "e", "asserted") in got and ("x", "d", "known_edge") not in got


def test_optimistic_edges(spark, edges):
    made = graph.optimistic(edges, spark.createDataFrame([("d", "run"), ("x", "run")], "a string, name string"), spark.createDataFrame([("run", "z")], "name string, b string"), spark.createDataFrame([("x", "z")], "a string, b string"))
    assert ("d", "z") in rows(made) and ("x", "z") not in rows(made)


def test_every_site_keeps_an_edge(spark):
    sites = spark.createDataFrame([("s0",), ("s1",), ("s2",), ("s3",), ("s4",), ("s1",)], "site string")
    targets = spark.createDataFrame([("s1", "m", "client"), ("s1", "m", "client"), ("s2", "m", "client"), ("s2", "n", "client"), ("s3", "l", "lib"), *[("s4", f"m{k}", "client") for k in range(5)]], "site string, target string, provenance string")
    made = tiers.tiered_edges(sites, targets, cap=4)
    assert rows(made.na.fill("-")) == [("s0", "-", "ambiguous_unknown"), ("s1", "m", "known_edge"), ("s2", "m", "multi_inferred"), ("s2", "n", "multi_inferred"), ("s3", "l", "boundary_lib"), ("s4", "-", "fan_capped")]
    assert tiers.refused_or_lost(sites, made).isEmpty()


def test_hierarchy_with_diamond_and_cycle(spark):
    parents = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("p", "q"), ("q", "p")], "type string, parent string")
    up = rows(hierarchy.ancestors(parents))
    assert ("d", "a", 2) in up and ("p", "p", 2) in up
    members = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "f"), ("a", "g")], "owner string, name string")
    found = {(t, n): (o, tied) for t, n, o, _, tied in rows(hierarchy.lookup(members, parents))}
    assert found["b", "f"] == ("b", False) and found["d", "g"] == ("a", False) and found["d", "f"][1]
    methods = spark.createDataFrame([("a", "f", 1), ("d", "f", 1), ("d", "f", 2)], "owner string, name string, arity int")
    assert rows(hierarchy.overrides(methods, parents)) == [("a", "d", "f", 1)]


def test_precedence_and_satisfaction(spark):
    slots = spark.createDataFrame([("d", 0, "b"), ("d", 1, "c"), ("b", 0, "a"), ("e", 0, "c"), ("e", 1, "b"), ("c", 0, "a"), ("x", 0, "y"), ("y", 0, "x")], "type string, position int, base string")
    place, pairs = hierarchy.precedence(slots)
    found = rows(place)
    assert [r for r in found if r[0] == "d"] == [("d", "a", 3), ("d", "b", 1), ("d", "c", 2), ("d", "d", 0)]
    assert [r[1] for r in sorted(found, key=lambda r: r[2]) if r[0] == "e"] == ["e", "c", "b", "a"]
    lone = spark.createDataFrame([("d", 0, "b"), ("d", 1, "c"), ("b", 0, "a")], "type string, position int, base string")
    place, pairs = hierarchy.precedence(lone)  # nothing orders what b inherits and what is written after b
    assert rows(pairs) == [("d", "a", "c")] and not [r for r in rows(place) if r[0] == "d"]
    need = spark.createDataFrame([("i", "f", 0), ("i", "g", 1)], "contract string, name string, arity int")
    has = spark.createDataFrame([("x", "f", 0), ("x", "g", 1), ("y", "f", 0), ("y", "g", 2)], "type string, name string, arity int")
    assert rows(hierarchy.satisfies(need, has)) == [("i", "x")]


def test_direct_parents(spark):
    spans = spark.createDataFrame([("f", "A", 0, 100), ("f", "B", 10, 50), ("f", "C", 20, 30), ("g", "D", 20, 30)], "file string, id string, low int, high int")
    assert rows(hierarchy.direct_parents(spans)) == [("B", "A"), ("C", "B")]
    rnd = random.Random(2)
    many = [(f"f{rnd.randrange(3)}", k, a := rnd.randrange(60), a + rnd.randrange(1, 30)) for k in range(150)]
    want = []
    for f, i, low, high in many:
        over = [(h - x, -x, j) for g, j, x, h in many if g == f and x <= low and h >= high and (x, h) != (low, high)]
        if over:
            size = min(over)[:2]
            want.append((i, {j for *own, j in over if tuple(own) == size}))
    got = dict(rows(hierarchy.direct_parents(spark.createDataFrame(many, "file string, id int, low int, high int"))))
    assert got.keys() == {i for i, _ in want} and all(got[i] in near for i, near in want)


def test_mutual_recursion(spark, edges):
    step = lambda side: lambda total, fresh: fresh[side].join(edges, fresh[side]["node"] == edges["a"]).selectExpr("b AS node")
    seed = spark.createDataFrame([("x",)], "node string")
    found = fixpoint.mutual_fixpoint({"even": seed, "odd": seed.limit(0)}, {"even": step("odd"), "odd": step("even")})
    assert rows(found["even"]) == [("x",)] and rows(found["odd"]) == [("d",)]


def test_placeholders_and_states(spark):
    v = spark.createDataFrame([("s", "a", "${b}-${c:x}"), ("s", "b", "${d}"), ("s", "d", "1"), ("s", "loop", "${loop}"), ("s", "open", "${none}")], "source string, key string, value string")
    assert rows(config.resolved(v).select("key", "value", "open")) == [("a", "1-x", False), ("b", "1", False), ("d", "1", False), ("loop", "${loop}", True), ("open", "${none}", True)]
    assert ("a", "d", 2) in rows(config.depends(v))
    c = spark.createDataFrame([("n1", "d", "1"), ("n2", "d", "2"), ("n3", "zz", "1")], "name string, key string, wanted string")
    assert rows(config.three_states(c, v)) == [("n1", "selected"), ("n2", "excluded"), ("n3", "undecided")]
    deep = [("s", f"k{i}", f"${{k{i + 1}}}.{i}") for i in range(25)] + [("s", "k25", "end"), ("s", "p", "${q}"), ("s", "q", "a${p}b${k25}"), ("s", "z", "${k24}${q:d}${k24}${no:e}")]
    got = {r.key: (r.value, r.open) for r in config.resolved(spark.createDataFrame(deep, "source string, key string, value string")).collect()}
    assert got["k0"] == ("end" + "".join(f".{i}" for i in range(24, -1, -1)), False)  # however many keys are on the way
    assert got["p"] == ("${q}", True) and got["q"] == ("a${p}bend", True) and got["z"] == ("end.24${q:d}end.24e", True)


def plans_of(monkeypatch, module, name):
    """What a module writes by one of staging's functions: (plan, name)."""
    found, own = [], getattr(module, name)

    def watched(df, *more):
        found.append((df._jdf.queryExecution().executedPlan().toString(), more[-1]))
        return own(df, *more)

    monkeypatch.setattr(module, name, watched)
    return found


def test_a_walk_writes_the_edges_as_they_are_and_once(spark, edges, monkeypatch):
    plans = plans_of(monkeypatch, graph, "cut")
    node = lambda n: spark.createDataFrame([(n,)], "node string")
    graph.impact(edges, node("d"))
    assert [("Exchange" in plan, name) for plan, name in plans if name == "edges"] == [(False, "edges")]
    # an edge that the table repeats comes once
    assert rows(graph.parents(edges, graph.distances(edges, node("a")))) == [("b", 1, "a"), ("c", 2, "b"), ("d", 3, "c")]


def test_a_wide_walk_deals_edges_once(spark, edges):
    sources = spark.createDataFrame([("a",), ("x",)], "node string")
    assert rows(graph.distances(edges, sources, wide=True)) == [("a", 0), ("b", 1), ("c", 2), ("d", 1), ("x", 0)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        known = graph.steps(edges, wide=True)
        plan = sources.join(known, sources["node"] == known["a"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
