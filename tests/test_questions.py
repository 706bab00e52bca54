from graphloom.operators import questions
from graphloom.sources import bundle, configs


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_changed(spark):
    schema = "qualified_name string, kind string, signature string, body string"
    old = spark.createDataFrame([("a", "method", "()", "1"), ("b", "method", "()", "1"), ("c", "method", "()", "1"), ("f", "field", "int", None), ("t", "type", "x", None), ("s", "method", "()", "1")], schema)
    new = spark.createDataFrame([("b", "method", "(x)", "1"), ("c", "method", "()", "2"), ("d", "method", "()", "1"), ("f", "field", "long", None), ("t", "type", "y", None), ("s", "method", "()", "1")], schema)
    assert rows(questions.changed(old, new)) == [("a", "removed"), ("b", "signature"), ("c", "body only"), ("d", "added"), ("f", "field"), ("t", "type header")]


def test_impact_and_tests(spark):
    edges = spark.createDataFrame([("x", "m", "multi_inferred"), ("x", "m", "known_edge"), ("y", "x", "known_edge"), ("t", "y", "known_edge")], "a string, b string, tier string")
    pairs = spark.createDataFrame([("m", "m2")], "base string, node string")
    target = spark.createDataFrame([("m",)], "node string")
    got = rows(questions.impact(edges, pairs, pairs.limit(0), spark.createDataFrame([("t",)], "node string"), target))
    assert got == sorted([("m2", "override", 0, None), ("t", "entry point", 3, None), ("t", "transitive", 3, None), ("x", "direct", 1, "known_edge"), ("y", "transitive", 2, None)], key=str)
    where = spark.createDataFrame([("t", "test_a.py"), ("y", "lib.py")], "node string, file string")
    assert rows(questions.affected_tests(edges, where, spark.createDataFrame([("test_a.py",)], "file string"), target)) == [("test_a.py", 3)]


def test_context_pages_and_spawned(spark):
    tokens = spark.createDataFrame([("n1", "cache"), ("n1", "get"), ("n2", "get"), ("n3", "get"), ("t1", "cache")], "node string, token string")
    edges = spark.createDataFrame([("n1", "n9")], "a string, b string")
    got = {r.node: r.hop for r in questions.context(tokens, edges, ["cache", "get"], spark.createDataFrame([("t1",)], "node string")).collect()}
    assert got == {"n1": 0, "n9": 1}
    df = spark.createDataFrame([("s", 1, 4), ("s", 2, 4), ("s", 3, 4), ("u", 1, 9)], "s string, k int, c int")
    assert [r.page for r in questions.pages(df, "s", ["k"], "c", 8).orderBy("s", "k").collect()] == [0, 0, 1, 0]
    tests = spark.createDataFrame([("t", "run('tools/a.py'); sh('python', '-m', 'pkg.b')")], "test string, text string")
    scripts = spark.createDataFrame([("/r/tools/a.py",), ("/r/pkg/b.py",), ("/r/c.py",)], "script string")
    assert rows(questions.spawned(tests, scripts)) == [("t", "/r/pkg/b.py"), ("t", "/r/tools/a.py")]


def test_traces_only_add(spark):
    edges = spark.createDataFrame([("a", "b", "multi_inferred"), ("a", "c", "multi_inferred")], "a string, b string, tier string")
    seen = spark.createDataFrame([("a", "b"), ("a", "z"), ("a", "z")], "a string, b string")
    assert rows(questions.merged_traces(edges, seen)) == [("a", "b", "multi_inferred", True), ("a", "c", "multi_inferred", False), ("a", "z", "known_edge", True)]


def test_unresolved_order(spark):
    edges = spark.createDataFrame([("s1", None, "ambiguous_unknown"), ("s2", None, "ambiguous_anon"), ("s3", "f", "known_edge"), ("s4", None, "ambiguous_unknown")], "site string, target string, tier string")
    sites = spark.createDataFrame([("s1", "e"), ("s2", "f"), ("s3", "g"), ("s4", "h")], "site string, caller string")
    got = questions.unresolved(edges, sites, spark.createDataFrame([("s4",)], "site string")).collect()
    assert [tuple(r) for r in got] == [("s2", "f", 1), ("s1", "e", 0)]


def test_graph_is_written_by_schema(spark, tmp_path):
    run = spark.createDataFrame([("k", "b"), ("k", "a"), ("x", "-")], "key string, value string")
    bundle.write_graph({"run": run}, str(tmp_path), {"rel": spark.createDataFrame([(1, "z"), (1, "z")], "p int, q string")})
    assert rows(bundle.read_graph(spark, str(tmp_path), "run")) == [("k", "a"), ("x", None)]
    assert rows(spark.read.parquet(str(tmp_path / "ext_rel"))) == [("1", "z")]
    made = bundle.external_entities(spark.createDataFrame([("a.b.C",), ("known",), (None,)], "target string"), spark.createDataFrame([("known",)], "id string"))
    assert rows(made) == [("external:a.b.C", "C", "a.b")]
    v = bundle.vocabulary(spark.createDataFrame([("x",), ("y",), ("x",)], "kind string"), ["kind"], {"kind": ["x"]})
    assert rows(v) == [("kind", "x", 2, True), ("kind", "y", 1, False)]
    labels = bundle.distinct_labels(spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], "label string, k int"), "label", "k")
    assert {r.label for r in labels.collect()} == {"p", "p#2", "q"}


YAML = """# note
server:
  port: 8080   # inline
  ssl:
    enabled: true
names:
  - a
  - "b c"
routes:
  - id: one
    path: /x
  - id: two
---
server:
  port: 1
"""


def test_yaml(spark, tmp_path):
    (tmp_path / "a.yml").write_text(YAML)
    got = [(r.document, r.key, r.value) for r in configs.read_yaml(spark, str(tmp_path / "a.yml")).collect()]
    assert got == [(0, "server.port", "8080"), (0, "server.ssl.enabled", "true"), (0, "names[0]", "a"), (0, "names[1]", "b c"), (0, "routes[0].id", "one"), (0, "routes[0].path", "/x"), (0, "routes[1].id", "two"), (1, "server.port", "1")]


def test_gradle(spark):
    text = "dependencies {\n  implementation 'g:a:1'\n  testImplementation(\"g:b\")\n  api project(':core')\n  // nothing\n  implementation(libs.x.y)\n}"
    got = configs.gradle_dependencies(spark.createDataFrame([("b", text)], "source string, value string"))
    assert rows(got.select("configuration", "coordinate")) == [("api", ":core"), ("implementation", "g:a:1"), ("implementation", "libs.x.y"), ("testImplementation", "g:b")]
