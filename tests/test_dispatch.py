import random

from graphloom.operators import dispatch, flow, questions, routes


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_overrides_and_dispatch(spark):
    parents = spark.createDataFrame([("B", "A"), ("C", "B"), ("D", "B")], "type string, parent string")
    members = spark.createDataFrame([("A", "f", 0), ("B", "f", 0), ("C", "f", 0), ("A", "g", 1)], "owner string, name string, arity int")
    assert rows(dispatch.nearest_overrides(members, parents)) == [("B", "f", 0, "A"), ("C", "f", 0, "B")]
    calls = spark.createDataFrame([("s", "B", "f"), ("t", "D", "g")], "site string, receiver string, name string")
    built = spark.createDataFrame([("D",)], "type string")
    assert rows(dispatch.self_dispatch(calls, members, parents, built)) == [("s", "B", True), ("s", "C", False), ("t", "A", True)]
    targets = spark.createDataFrame([("s", "A", "f()"), ("s", "C", "f()"), ("s", "A", "g()"), ("u", "A", "f()")], "site string, owner string, signature string")
    assert rows(dispatch.without_shadowed(targets, parents)) == [("s", "A", "g()"), ("s", "C", "f()"), ("u", "A", "f()")]
    said = spark.createDataFrame([("p", "C")], "site string, type string")
    heard = spark.createDataFrame([("h1", "A"), ("h2", "C"), ("h3", "D")], "handler string, type string")
    assert rows(dispatch.listeners(said, heard, parents)) == [("p", "h1", False), ("p", "h2", True)]


def test_stored_and_exact(spark):
    stores = spark.createDataFrame([("x", "f1"), ("y", "f2")], "holder string, callable string")
    links = spark.createDataFrame([("z", "x"), ("z", "y"), ("x", "z")], "holder string, source string")
    invokes = spark.createDataFrame([("s1", "y"), ("s2", "z"), ("s3", "nobody")], "site string, holder string")
    assert rows(dispatch.stored_callables(stores, links, invokes)) == [("s1", "f2", "known_edge"), ("s2", "f1", "multi_inferred"), ("s2", "f2", "multi_inferred"), ("s3", None, "ambiguous_anon")]
    fan = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "site string, target string")
    assert rows(dispatch.exact_first(fan, spark.createDataFrame([("a", "2")], "site string, target string"))) == [("a", "2"), ("b", "3")]
    uses = spark.createDataFrame([("u1", "A", "x", "target"), ("u2", "A", "x", "value"), ("u3", "A", "q", "both")], "site string, owner string, name string, role string")
    declared = spark.createDataFrame([("A", "x", "A.x", "client")], "owner string, name string, field string, provenance string")
    assert rows(dispatch.field_access(uses, declared)) == [("u1", "A.x", "write", "known_edge"), ("u2", "A.x", "read", "known_edge"), ("u3", None, "read_write", "ambiguous_unknown")]
    put = spark.createDataFrame([("r", "K", "v1"), ("r", "lit", "v2")], "registry string, key string, value string")
    get = spark.createDataFrame([("s", "r", "text"), ("t", "q", "text")], "site string, registry string, key string")
    assert rows(dispatch.keyed(put, get, spark.createDataFrame([("K", "text")], "name string, text string"))) == [("s", "v1")]


def test_states_and_reasons(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "e")], "a string, b string")
    seen, ran = spark.createDataFrame([("a", "b")], "a string, b string"), spark.createDataFrame([("a",)], "node string")
    assert rows(dispatch.confirmed(edges, seen, ran)) == [("a", "b", "confirmed"), ("a", "c", "contradicted"), ("d", "e", "not executed")]
    from pyspark.sql import functions as F

    sites = spark.createDataFrame([("s", "eval", None), ("t", None, "f"), ("u", None, None)], "site string, kind string, name string")
    assert [r.reason for r in dispatch.reasons(sites, [("dynamic", F.col("kind") == "eval"), ("no declaration", F.col("name").isNotNull())]).orderBy("site").collect()] == ["dynamic", "no declaration", "unknown"]


def closed(created, assigned, stored, loaded):
    holds, inside = set(created), set()
    while True:
        more = {(t, v) for t, s in assigned for n, v in holds if n == s} | {(t, v) for t, b, p in loaded for n, o in holds if n == b for q, f, v in inside if (q, f) == (o, p)}
        deeper = {(o, p, v) for b, p, s in stored for n, o in holds if n == b for m, v in holds if m == s}
        if more <= holds and deeper <= inside:
            return holds, inside
        holds, inside = holds | more, inside | deeper


def test_value_flow_equals_brute_force(spark):
    rng = random.Random(4)
    names = [f"v{k}" for k in range(7)]
    for _ in range(2):
        pick = lambda: rng.choice(names)
        created = [(pick(), f"o{k}") for k in range(4)]
        assigned = [(pick(), pick()) for _ in range(4)]
        stored = [(pick(), rng.choice("pq"), pick()) for _ in range(3)]
        loaded = [(pick(), pick(), rng.choice("pq")) for _ in range(3)]
        got = flow.values(spark.createDataFrame(created, "name string, value string"), spark.createDataFrame(assigned, "target string, source string"), spark.createDataFrame(stored, "base string, property string, source string"), spark.createDataFrame(loaded, "target string, base string, property string"))
        holds, inside = closed(created, assigned, stored, loaded)
        assert set(rows(got["holds"])) == holds and set(rows(got["inside"])) == inside


def test_calls_hand_over(spark):
    calls = spark.createDataFrame([("s", "f"), ("t", "f"), ("u", "g")], "site string, callee string")
    args = spark.createDataFrame([("s", 0, "a"), ("t", 0, "b"), ("u", 0, "c")], "site string, place int, name string")
    params = spark.createDataFrame([("f", 0, "f.x"), ("g", 0, "g.x")], "callee string, place int, name string")
    returns = spark.createDataFrame([("f", "f.r")], "callee string, name string")
    results = spark.createDataFrame([("s", "s.out")], "site string, name string")
    assert rows(flow.assignments(calls, args, params, returns, results)) == [("f.x", "a"), ("f.x", "b"), ("g.x", "c"), ("s.out", "f.r")]
    assert rows(flow.assignments(calls, args, params, returns, results, cap=1)) == [("g.x", "c"), ("s.out", "f.r")]


def test_routes(spark):
    mounts = spark.createDataFrame([("app", "api", "/api/"), ("api", "users", "users"), ("api", "api", "again")], "parent string, child string, prefix string")
    own = spark.createDataFrame([("users", "get", "/:id", "show"), ("users", "get", "/me", "me"), ("app", "post", "/", "root")], "router string, verb string, path string, handler string")
    made = routes.composed(mounts, own, spark.createDataFrame([("app",)], "router string"))
    assert rows(made) == [("get", "/api/users/:id", "show"), ("get", "/api/users/me", "me"), ("post", "/", "root")]
    asked = spark.createDataFrame([("c1", "GET", "/api/users/me?x=1"), ("c2", "get", "/api/users/${id}"), ("c3", "get", "/nowhere")], "site string, verb string, path string")
    met = routes.matched(asked, made)
    assert rows(met) == [("c1", "me", "/api/users/me"), ("c2", "me", "/api/users/me")]
    chain = spark.createDataFrame([(f"r{k}", f"r{k + 1}", f"p{k}") for k in range(14)], "parent string, child string, prefix string")
    far = spark.createDataFrame([("r14", "get", "end", "h")], "router string, verb string, path string, handler string")
    assert rows(routes.composed(chain, far, spark.createDataFrame([("r0",)], "router string"))) == [("get", "/" + "/".join(f"p{k}" for k in range(14)) + "/end", "h")]
    order = routes.middleware(spark.createDataFrame([("a", "log", 3, 1), ("a", "auth", 2, 5), ("b", "x", 1, 1), ("a", "cors", 2, 1)], "router string, handler string, line int, column int"))
    assert sorted((r.router, r.place, r.handler) for r in order.collect()) == [("a", 0, "cors"), ("a", 1, "auth"), ("a", 2, "log"), ("b", 0, "x")]
    lonely, unasked = routes.alone(asked, made, met)
    assert [r.site for r in lonely.collect()] == ["c3"] and {r.handler for r in unasked.collect()} == {"show", "root"}


def test_more_questions(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "x"), ("c", "d")], "a string, b string")
    node = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    assert rows(questions.edges_between(edges, node("a"), node("c"))) == [("a", "b"), ("b", "c")]
    assert rows(questions.what_if(edges, spark.createDataFrame([("d", "z")], "a string, b string"), node("b"))) == [("z", 3)]
    tiers = spark.createDataFrame([("s", "f", "known_edge"), ("t", "l", "boundary_lib"), ("u", None, "ambiguous_unknown"), ("v", "f", "asserted")], "site string, target string, tier string")
    assert rows(questions.counts(tiers)) == [(4, 2, 1, 1, 1)]
    assert rows(questions.verified(spark.createDataFrame([("a", "b"), ("a", "d")], "a string, b string"), edges)) == [("a", "b", True), ("a", "d", False)]
    links = spark.createDataFrame([("a", "b", "f", 1, "x()"), ("a", "c", "f", 2, "y()")], "a string, b string, file string, line int, text string")
    kept, stale = questions.current_links(links, spark.createDataFrame([("f", 1, "  x()"), ("f", 2, "z()")], "file string, line int, text string"))
    assert [r.b for r in kept.collect()] == ["b"] and [r.b for r in stale.collect()] == ["c"]
    tests = spark.createDataFrame([("t/a/x.py",), ("u.py",)], "test string")
    assert rows(questions.beneath(tests, spark.createDataFrame([("t/conf.py",), ("root.py",), ("t/b/conf.py",)], "setup string"))) == [("t/a/x.py", "root.py"), ("t/a/x.py", "t/conf.py"), ("u.py", "root.py")]
    run = spark.createDataFrame([("t", "all {}"), ("t/a", "one {}")], "folder string, command string")
    assert rows(questions.commands(spark.createDataFrame([("t/a/case",), ("t/z",)], "path string"), run)) == [("t/a/case", "one t/a/case"), ("t/z", "all t/z")]
    assert rows(questions.used_packages(spark.createDataFrame([("yaml.loader",)], "name string"), spark.createDataFrame([("PyYAML", "yaml"), ("other", "o")], "package string, module string"))) == [("PyYAML",)]
    assert [(r.lang, r.main) for r in questions.over_languages({"java": node("a"), "py": node("b")}, "py").collect()] == [("py", True), ("java", False)]


def test_edges_between_are_read_once_and_not_dealt(spark, monkeypatch):
    from test_graph import plans_of

    from graphloom.operators import graph

    plans = plans_of(monkeypatch, graph, "cut")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "b"), ("b", "x"), ("c", "d")], "a string, b string")
    node = lambda n: spark.createDataFrame([(n,)], "node string")
    assert rows(questions.edges_between(edges, node("a"), node("c"))) == [("a", "b"), ("b", "c")]
    assert [("Exchange" in plan, name) for plan, name in plans if name == "edges"] == [(False, "edges")]


def test_what_if_walks_on_from_what_is_reached(spark, monkeypatch):
    import random

    from graphloom.operators import graph

    walks, own = [], graph.walk
    monkeypatch.setattr(graph, "walk", lambda *a: walks.append(a) or own(*a))
    chance = random.Random(5)

    def reached(pairs):
        depth, todo = {"0": 0}, ["0"]
        for n in todo:
            for b in sorted(b for a, b in pairs if a == n and b not in depth):
                depth[b] = depth[n] + 1
                todo.append(b)
        return depth

    # a chain, so that added edges bring nodes nearer from which other added edges lead on
    chain = [(str(k), str(k + 1)) for k in range(12)] + [("n1", "n2"), ("n2", "n3"), ("n3", "4")]
    for _ in range(1):
        added = [(str(chance.randrange(13)), str(chance.randrange(13))) for _ in range(3)] + [(str(chance.randrange(6, 13)), "n1"), (str(chance.randrange(6, 13)), "n3"), ("n2", "9")]
        before, after = reached(chain), reached(chain + added)
        walks.clear()
        found = questions.what_if(spark.createDataFrame(chain, "a string, b string"), spark.createDataFrame(added, "a string, b string"), spark.createDataFrame([("0",)], "node string"))
        assert rows(found) == sorted((n, d) for n, d in after.items() if n not in before) and len(walks) == 1
