"""Further registered queries: dispatch, value flow, routes, styles and the query layer's smaller questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import config, dispatch, flow, graph, hierarchy, questions, relalg, routes, styles, web
from graphloom.plans.catalogue import HIER_SQL, SITE_SQL, _hierarchy, _order_edges, query
from graphloom.plans.orders import EDGES_SQL, edges, node, reach_sql, start
from graphloom.sources.tables import table

# the query layer


@query(f"WITH RECURSIVE {EDGES_SQL}, {reach_sql('S:1', name='f')}, {reach_sql('C:1', True, 'g')}, i AS (SELECT node FROM f INTERSECT SELECT node FROM g) SELECT a, b FROM edges WHERE a IN (SELECT node FROM i) AND b IN (SELECT node FROM i)")
def edges_between_supplier_customer(spark, d):
    return questions.edges_between(edges(spark, d), start(spark, "S:1"), start(spark, "C:1"))


@query(SITE_SQL + """, e AS (SELECT p.site, p.target, CASE WHEN provenance = 'lib' THEN 'boundary_lib' WHEN n = 1 THEN 'known_edge' ELSE 'multi_inferred' END AS tier FROM p JOIN f USING (site)
UNION ALL SELECT o_orderkey, NULL, 'ambiguous_unknown' FROM orders WHERE o_orderkey NOT IN (SELECT site FROM p))
SELECT count(DISTINCT site) AS sites, count(DISTINCT CASE WHEN target IS NOT NULL AND tier <> 'boundary_lib' THEN site END) AS resolved, count(DISTINCT CASE WHEN tier = 'boundary_lib' THEN site END) AS boundary,
count(DISTINCT CASE WHEN tier = 'asserted' THEN site END) AS asserted, count(DISTINCT CASE WHEN tier = 'ambiguous_unknown' THEN site END) AS open FROM e""")
def graph_counts(spark, d):
    return questions.counts(_order_edges(spark, d))


@query("""SELECT 'C:' || c_custkey AS a, 'N:' || (c_nationkey % 5) AS b, c_nationkey < 5 AS held FROM customer""")
def verified_answer(spark, d):
    """An answer's edges looked up again in the graph; some of them aren't there."""
    answer = table(spark, d, "customer").select(node("C", "c_custkey").alias("a"), F.concat(F.lit("N:"), (F.col("c_nationkey") % 5).cast("string")).alias("b"))
    known = table(spark, d, "customer").select(node("C", "c_custkey").alias("a"), node("N", "c_nationkey").alias("b"))
    return questions.verified(answer, known)


@query("""SELECT o_orderkey, 'confirmed' AS state FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'contradicted' ELSE 'not executed' END FROM orders WHERE o_orderstatus <> 'F'""")
def confirmed_by_run(spark, d):
    """Edges after a run: taken, not taken although the caller ran, or not executed."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"), "o_orderstatus")
    ran = orders.filter("o_orderstatus IN ('F', 'O')").select(F.col("a").alias("node"))
    return dispatch.confirmed(orders, orders.filter("o_orderstatus = 'F'"), ran).select(F.col("a").alias("o_orderkey"), "state")


@query("""WITH t AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-zA-Z]+://', ''), '[?#].*$', '') AS test FROM pages), s AS (SELECT regexp_replace(test, '/[^/]*$', '') AS folder, min(test) AS setup FROM t WHERE test LIKE '%/%' GROUP BY 1)
SELECT test, setup FROM t JOIN s ON starts_with(test, s.folder || '/')""")
def setups_above(spark, d):
    """Set-up files and the files in their folder or below it; here, the first page of each folder."""
    paths = table(spark, d, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-zA-Z]+://", ""), "[?#].*$", "").alias("test")).distinct()
    setups = paths.filter(F.col("test").contains("/")).groupBy(F.regexp_replace("test", "/[^/]*$", "").alias("f")).agg(F.min("test").alias("setup"))
    return questions.beneath(paths, setups)


@query(f"WITH RECURSIVE {EDGES_SQL}, {reach_sql('S:1')} SELECT 'X:' || r_regionkey AS node, CAST(depth + 1 AS INTEGER) AS depth FROM region JOIN reach ON node = 'R:' || r_regionkey")
def what_if_regions_lead_on(spark, d):
    regions = table(spark, d, "region").select(node("R", "r_regionkey").alias("a"), node("X", "r_regionkey").alias("b"))
    return questions.what_if(edges(spark, d), regions, start(spark, "S:1"))


@query(f"WITH RECURSIVE {EDGES_SQL}, r AS (SELECT 'S:' || s_suppkey AS node FROM supplier WHERE s_acctbal < 0 UNION SELECT e.b FROM r JOIN edges e ON e.a = r.node) SELECT node FROM r")
def entry_reachable(spark, d):
    """What the entry points (suppliers in debt) lead to."""
    roots = table(spark, d, "supplier").filter("s_acctbal < 0").select(node("S", "s_suppkey").alias("node"))
    return dispatch.entry_reachable(edges(spark, d), roots)


@query("SELECT c_custkey AS id, 'customer' AS lang, true AS main FROM customer UNION ALL SELECT s_suppkey, 'supplier', false FROM supplier")
def over_languages(spark, d):
    return questions.over_languages({"supplier": table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), "customer": table(spark, d, "customer").select(F.col("c_custkey").alias("id"))}, "customer")


# dispatch


MEMBERS_SQL = "m AS (SELECT type AS owner, 'size' AS name, 0 AS arity FROM p WHERE type LIKE 'N:1%' UNION ALL SELECT 'R:' || r_regionkey, 'size', 0 FROM region UNION ALL SELECT type, 'size', 0 FROM p WHERE type LIKE 'C:1%'), a AS (SELECT type, parent AS ancestor, 1 AS depth FROM p UNION SELECT a.type, p.parent, a.depth + 1 FROM a JOIN p ON p.type = a.ancestor)"


def _members(spark, d):
    up = _hierarchy(spark, d)
    own = up.filter(F.col("type").startswith("N:1") | F.col("type").startswith("C:1")).select(F.col("type").alias("owner"))
    return own.union(table(spark, d, "region").select(node("R", "r_regionkey"))).select("owner", F.lit("size").alias("name"), F.lit(0).alias("arity"))


@query(f"WITH RECURSIVE {HIER_SQL}, {MEMBERS_SQL} SELECT owner, name, arity, base_owner FROM (SELECT x.owner, x.name, x.arity, y.owner AS base_owner, rank() OVER (PARTITION BY x.owner, x.name ORDER BY a.depth) AS r FROM m x JOIN a ON a.type = x.owner JOIN m y ON y.owner = a.ancestor) WHERE r = 1")
def nearest_override(spark, d):
    return dispatch.nearest_overrides(_members(spark, d), _hierarchy(spark, d))


@query("SELECT c_custkey AS site, handler, CAST(max(e) AS BOOLEAN) AS exact FROM (SELECT c_custkey, 'nation' AS handler, 0 AS e FROM customer WHERE c_nationkey < 3 UNION ALL SELECT c_custkey, 'region', 0 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 UNION ALL SELECT c_custkey, 'first', 1 FROM customer WHERE c_custkey = 1) GROUP BY ALL")
def event_listeners(spark, d):
    """Handlers of a published type and of its ancestors."""
    published = table(spark, d, "customer").select(F.col("c_custkey").alias("site"), node("C", "c_custkey").alias("type"))
    handlers = relalg.facts(spark, [("nation", "N:0"), ("nation", "N:1"), ("nation", "N:2"), ("region", "R:1"), ("first", "C:1")], "handler string, type string")
    return dispatch.listeners(published, handlers, _hierarchy(spark, d))


@query("""WITH t AS (SELECT DISTINCT l_orderkey AS site, p_brand AS target FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT o_orderkey AS site, t.target, CASE count(t.target) OVER (PARTITION BY o_orderkey) WHEN 0 THEN 'ambiguous_anon' WHEN 1 THEN 'known_edge' ELSE 'multi_inferred' END AS tier FROM orders LEFT JOIN t ON t.site = o_orderkey""")
def callables_through_holders(spark, d):
    """Calls through a holder to what other holders gave it; without any, the site stays as a row."""
    stores = table(spark, d, "part").select(node("P", "p_partkey").alias("holder"), F.col("p_brand").alias("callable"))
    links = table(spark, d, "lineitem").select(node("O", "l_orderkey").alias("holder"), node("P", "l_partkey").alias("source"))
    invokes = table(spark, d, "orders").select(F.col("o_orderkey").alias("site"), node("O", "o_orderkey").alias("holder"))
    return dispatch.stored_callables(stores, links, invokes)


@query("SELECT DISTINCT n_nationkey AS site, o_custkey % 10 AS value FROM nation, orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def keyed_registry(spark, d):
    stores = table(spark, d, "orders").select(F.col("o_orderpriority").alias("registry"), F.col("o_orderstatus").alias("key"), (F.col("o_custkey") % 10).alias("value")).distinct()
    reads = table(spark, d, "nation").select(F.col("n_nationkey").alias("site"), F.lit("1-URGENT").alias("registry"), F.lit("FINISHED").alias("key"))
    return dispatch.keyed(stores, reads, relalg.facts(spark, [("FINISHED", "F")], "name string, text string"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_totalprice < 50000 THEN 'small' ELSE 'unknown' END AS reason FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unresolved_reasons(spark, d):
    open_ = relalg.anti(table(spark, d, "orders"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])
    return dispatch.reasons(open_, [("finished", F.col("o_orderstatus") == "F"), ("small", F.col("o_totalprice") < 50000)]).select("o_orderkey", "reason")


@query("""SELECT o_orderkey AS site, CASE WHEN c_acctbal > 0 THEN c_custkey END AS field, CASE o_orderstatus WHEN 'F' THEN 'write' WHEN 'O' THEN 'read' ELSE 'read_write' END AS access,
CASE WHEN c_acctbal > 0 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'boundary_lib' ELSE 'known_edge' END ELSE 'ambiguous_unknown' END AS tier FROM orders JOIN customer ON c_custkey = o_custkey""")
def field_access(spark, d):
    role = F.when(F.col("o_orderstatus") == "F", "target").when(F.col("o_orderstatus") == "O", "value").otherwise("both")
    uses = table(spark, d, "orders").select(F.col("o_orderkey").alias("site"), F.col("o_custkey").alias("owner"), F.lit("x").alias("name"), role.alias("role"))
    declared = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("owner"), F.lit("x").alias("name"), F.col("c_custkey").alias("field"), F.when(F.col("c_mktsegment") == "BUILDING", "lib").otherwise("client").alias("provenance"))
    return dispatch.field_access(uses, declared)


# value flow


@query("""SELECT 'P:' || p_partkey AS name, p_brand AS value FROM part UNION SELECT 'S:' || l_suppkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey
UNION SELECT 'N:' || s_nationkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey""")
def value_flow(spark, d):
    """Brands that parts, their suppliers and these suppliers' nations may hold."""
    created = table(spark, d, "part").select(node("P", "p_partkey").alias("name"), F.col("p_brand").alias("value"))
    assigned = table(spark, d, "lineitem").select(node("S", "l_suppkey").alias("target"), node("P", "l_partkey").alias("source")).union(table(spark, d, "supplier").select(node("N", "s_nationkey"), node("S", "s_suppkey")))
    none = created.limit(0)
    stored = none.select(F.col("name").alias("base"), F.lit("p").alias("property"), F.col("name").alias("source"))
    return flow.values(created, assigned, stored, stored.select(F.col("source").alias("target"), "base", "property"))["holds"]


@query("""WITH c AS (SELECT l_partkey AS callee FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT (l_orderkey, l_linenumber, l_suppkey)) <= 25)
SELECT DISTINCT 'P:' || l_partkey AS target, 'S:' || l_suppkey AS source FROM lineitem WHERE l_partkey IN (SELECT callee FROM c)""")
def parameter_flow_with_cap(spark, d):
    """Arguments to parameters, but for callables with very many call sites."""
    lines = table(spark, d, "lineitem").withColumn("site", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    calls = lines.select("site", F.col("l_partkey").alias("callee"))
    arguments = lines.select("site", F.lit(0).alias("place"), node("S", "l_suppkey").alias("name"))
    parameters = table(spark, d, "part").select(F.col("p_partkey").alias("callee"), F.lit(0).alias("place"), node("P", "p_partkey").alias("name"))
    return flow.assignments(calls, arguments, parameters, parameters.limit(0).select("callee", "name"), arguments.limit(0).select("site", "name"), cap=25)


# routes, styles, pages


ROUTE_PARTS = "list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '')"


@query(f"""WITH c AS (SELECT page_id AS site, {ROUTE_PARTS} AS p FROM pages) SELECT site, CASE WHEN len(p) = 2 AND p[1] = 'en' THEN 'english' WHEN len(p) = 2 THEN 'any' ELSE 'deep' END AS handler,
CASE WHEN len(p) = 2 AND p[1] = 'en' THEN '/v/en/:id' WHEN len(p) = 2 THEN '/v/:lang/:id' ELSE '/v/:lang/:part/:id' END AS path FROM c WHERE len(p) IN (2, 3)""")
def client_to_route(spark, d):
    """Requests to the mounted route that fits with the fewest stand-ins."""
    mounts = spark.createDataFrame([("app", "pages", "v")], "parent string, child string, prefix string")
    own = spark.createDataFrame([("pages", "get", "/en/:id", "english"), ("pages", "get", ":lang/:id", "any"), ("pages", "get", "/:lang/:part/:id/", "deep")], "router string, verb string, path string, handler string")
    made = routes.composed(mounts, own, spark.createDataFrame([("app",)], "router string"))
    clients = table(spark, d, "pages").select(F.col("page_id").alias("site"), F.lit("GET").alias("verb"), F.concat(F.lit("/v"), web.url_path(F.col("url"))).alias("path"))
    return routes.matched(clients, F.broadcast(made))


@query("SELECT p_brand AS element, p_type AS property, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size > 45 DESC, p_size DESC, p_partkey DESC) AS INTEGER) AS place FROM part")
def cascade_order(spark, d):
    """Declarations of one element and property in the order in which they win."""
    part = table(spark, d, "part")
    wanted = part.select(F.lit(1).alias("page_id"), F.col("p_brand").alias("element"), F.col("p_type").alias("property"), (F.col("p_size") > 45).alias("important"), F.lit(False).alias("inline"), F.col("p_size").alias("specificity"), F.col("p_partkey").alias("position"), F.lit(web.EXACT).alias("status"), "p_partkey")
    return styles.cascade(wanted).select("element", "property", "p_partkey", "place")


@query("""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '<style>p\\{(margin|padding):[^<;]*\\}</style>', 1)) AS via FROM pages)
SELECT page_id, via, via || x AS property FROM s, (VALUES (''), ('-top'), ('-right'), ('-bottom'), ('-left')) v(x)""")
def longhand_declarations(spark, d):
    declared = web.style_rules(table(spark, d, "pages")).filter("property IN ('margin', 'padding')")
    return styles.expanded(declared).select("page_id", "via", "property")


@query("""WITH r AS (SELECT n_regionkey AS page_id, n_nationkey, NULL AS c_custkey, n_name AS title FROM nation UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey),
e AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n_nationkey, c_custkey NULLS FIRST) AS element FROM r), h AS (SELECT page_id, n_nationkey, element FROM e WHERE c_custkey IS NULL)
SELECT e.page_id, CAST(e.element AS INTEGER) AS element, CASE WHEN c_custkey IS NULL THEN 2 ELSE 3 END AS level, title, CAST(CASE WHEN c_custkey IS NOT NULL THEN h.element END AS INTEGER) AS parent FROM e JOIN h ON h.page_id = e.page_id AND h.n_nationkey = e.n_nationkey""")
def page_outline_parents(spark, d):
    """Headings under the heading they belong to: a page for each region, its nations and, below each, the customers."""
    from pyspark.sql import Window

    nation = table(spark, d, "nation")
    people = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("page_id"), "n_nationkey", "c_custkey", F.lit("h3").alias("tag"), F.col("c_name").alias("text"))
    heads = nation.select(F.col("n_regionkey").alias("page_id"), "n_nationkey", F.lit(None).cast("long").alias("c_custkey"), F.lit("h2").alias("tag"), F.col("n_name").alias("text")).union(people)
    order = Window.partitionBy("page_id").orderBy("n_nationkey", F.col("c_custkey").asc_nulls_first())
    return styles.outline(heads.withColumn("element", F.row_number().over(order)))


@query("""SELECT n_regionkey AS page_id, CAST(c_custkey + 100 AS INTEGER) AS control, CAST(n_nationkey + 1 AS INTEGER) AS form, CASE WHEN c_custkey % 2 = 0 THEN CAST(n_nationkey + 1000000000 AS INTEGER) END AS label FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def page_inventory(spark, d):
    """Controls with their form and label: a form for each nation, a control for each customer, every other one named by a label."""
    nation = table(spark, d, "nation")
    row = lambda page, element, parent, tag, own, form, target: [page.cast("long").alias("page_id"), element.cast("int").alias("element"), parent.cast("int").alias("parent"), F.lit(tag).alias("tag"), own.alias("id"), F.create_map(F.lit("form"), form, F.lit("for"), target).alias("attributes")]
    none = F.lit(None).cast("string")
    roots = table(spark, d, "region").select(*row(F.col("r_regionkey"), F.lit(0), F.lit(-1), "html", none, none, none))
    forms = nation.select(*row(F.col("n_regionkey"), F.col("n_nationkey") + 1, F.lit(0), "form", none, none, none))
    labels = nation.select(*row(F.col("n_regionkey"), F.col("n_nationkey") + 1_000_000_000, F.lit(0), "label", none, none, F.concat(F.lit("i"), F.col("n_nationkey").cast("string"))))
    people = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    inputs = people.select(*row(F.col("n_regionkey"), F.col("c_custkey") + 100, F.col("n_nationkey") + 1, "input", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("i"), F.col("n_nationkey").cast("string"))), none, none))
    return styles.controls(roots.union(forms).union(labels).union(inputs))


@query("""SELECT c_custkey AS page_id, '/n' || c_nationkey AS sheet, 1 AS place FROM customer UNION ALL SELECT c_custkey, '/' || c_mktsegment, 0 FROM customer
UNION ALL SELECT c_custkey, '/r' || n_regionkey, 1 FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def sheets_of_pages(spark, d):
    """What pages load, by links and by imports of what they link."""
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    links = customer.select(F.col("c_custkey").alias("page_id"), name("/n", "c_nationkey").alias("href"), F.lit(1).alias("place")).union(customer.select("c_custkey", name("/", "c_mktsegment"), F.lit(0)))
    sheets = nation.select(name("/n", "n_nationkey").alias("sheet")).union(nation.select(name("/r", "n_regionkey"))).union(customer.select(name("/", "c_mktsegment"))).distinct()
    return styles.loads(links, sheets, nation.select(name("/n", "n_nationkey").alias("sheet"), name("/r", "n_regionkey").alias("imported")))[0]


SLOTS_SQL = "s AS (SELECT 'C:' || c_custkey AS type, 0 AS position, 'N:' || c_nationkey AS base FROM customer UNION ALL SELECT 'C:' || c_custkey, 1, 'S:' || c_mktsegment FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'N:' || n_nationkey, 0, 'R:' || n_regionkey FROM nation)"


def _slots(spark, d):
    customer = table(spark, d, "customer")
    row = lambda t, p, b: [t.alias("type"), F.lit(p).alias("position"), b.alias("base")]
    more = customer.filter("c_custkey % 3 = 0").select(*row(node("C", "c_custkey"), 1, node("S", "c_mktsegment")))
    return customer.select(*row(node("C", "c_custkey"), 0, node("N", "c_nationkey"))).union(more).union(table(spark, d, "nation").select(*row(node("N", "n_nationkey"), 0, node("R", "n_regionkey"))))


@query(f"""WITH {SLOTS_SQL}, t AS (SELECT type FROM s GROUP BY type HAVING count(*) = 1) SELECT type, type AS base, 0 AS rank FROM t UNION ALL SELECT s.type, base, 1 FROM s JOIN t USING (type)
UNION ALL SELECT s.type, u.base, 2 FROM s JOIN t USING (type) JOIN s u ON u.type = s.base""")
def bases_in_order(spark, d):
    """Types with their bases in the order in which they are asked, where that is total."""
    return hierarchy.precedence(_slots(spark, d))[0]


@query(f"""WITH {SLOTS_SQL} SELECT a.type, least(r.base, b.base) AS a, greatest(r.base, b.base) AS b FROM s a JOIN s b ON b.type = a.type AND b.position = 1 JOIN s r ON r.type = a.base WHERE a.position = 0""")
def bases_in_doubt(spark, d):
    """Pairs of bases that neither inheritance nor the written order puts before the other."""
    return hierarchy.precedence(_slots(spark, d))[1]


# rule programs


@query("""WITH own AS (SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey % 2 = 0), d AS (SELECT c_custkey, n_nationkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
wide AS (SELECT c_custkey, 'N:' || o.n_nationkey || '.ship' AS target FROM d JOIN own o ON o.n_regionkey = d.n_regionkey), w AS (SELECT c_custkey, count(*) AS n FROM wide GROUP BY c_custkey)
SELECT 'new ' || c_custkey AS site, 'M:' || n_regionkey AS "from", '' AS "to", 'client' AS provenance, 'ambiguous_unknown' AS tier FROM d
UNION ALL SELECT 'exact ' || c_custkey, 'M:' || n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN 'N:' || n_nationkey || '.ship' ELSE 'R:' || n_regionkey || '.ship' END, 'client', 'known_edge' FROM d
UNION ALL SELECT 'any ' || d.c_custkey, 'M:' || d.n_regionkey, wide.target, 'client', CASE WHEN w.n = 1 THEN 'known_edge' ELSE 'multi_inferred' END FROM d JOIN wide USING (c_custkey) JOIN w USING (c_custkey)""")
def rule_call_edges(spark, d):
    """The call program: regions declare a method that every other nation overrides; customers call it on a constructed
    nation and on a variable of their region's type."""
    from graphloom.rules.programs import program
    from graphloom.rules.solve import solve

    nation = table(spark, d, "nation").withColumns({"n": node("N", "n_nationkey"), "r": node("R", "n_regionkey"), "m": node("M", "n_regionkey")})
    regions = nation.select("r", "m").distinct()
    lit = F.lit
    types = nation.select("n", "n", lit("p"), lit("f"), lit("class"), lit("")).union(regions.select("r", "r", lit("p"), lit("f"), lit("class"), lit("")))
    ship = lambda owner, kind: [F.concat(owner, lit(".ship")), F.col(owner), lit("ship"), lit(0), lit(kind), lit("")]
    methods = nation.filter("n_nationkey % 2 = 0").select(*ship("n", "instance")).union(regions.select(*ship("r", "abstract"))).union(regions.select("m", "r", lit("run"), lit(0), lit("static"), lit("")))
    sites = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    name = lambda k: F.concat(lit(k + " "), F.col("c_custkey").cast("string"))
    expr = lambda k, kind, text: sites.select(name(k), "m", "r", lit(kind), text, lit(1))
    exprs = expr("new", "new", F.col("n")).union(expr("exact", "call", lit("ship"))).union(expr("name", "name", lit("v"))).union(expr("any", "call", lit("ship")))
    inputs = {
        "type": types, "method": methods, "expr": exprs, "heritage": nation.select("n", lit(0), "r", lit("extends")), "variable": regions.select("m", lit("v"), "r", lit("local")),
        "receiver": sites.select(name("exact"), name("new")).union(sites.select(name("any"), name("name"))), "arity": sites.select(name("new"), lit(0)).union(sites.select(name("exact"), lit(0))).union(sites.select(name("any"), lit(0))),
        "cap": relalg.facts(spark, [(50,)], "n long"),
    }
    return solve(spark, program("calls"), inputs, ["call_edge"])["call_edge"]


CALL_SQL = """t AS (SELECT 'C:' || c_custkey AS type, 'N:' || c_nationkey AS base FROM customer UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation)"""


def _call_facts(spark, d):
    """Customers extend nations, which implement regions; regions and every other nation declare size, orders are fields."""
    customer, nation, lit = table(spark, d, "customer"), table(spark, d, "nation"), F.lit
    c, n, r = node("C", "c_custkey"), node("N", "n_nationkey"), node("R", "n_regionkey")
    kind = lambda x, k: [x, x, lit("p"), lit("f"), lit(k), lit("")]
    types = customer.select(*kind(c, "class")).union(nation.select(*kind(n, "class"))).union(nation.select(*kind(r, "interface")).distinct())
    heritage = customer.select(c, lit(0), node("N", "c_nationkey"), lit("extends")).union(nation.select(n, lit(0), r, lit("implements")))
    size = lambda x, k: [F.concat(x, lit(".size")), x, lit("size"), lit(0), lit(k), lit("")]
    methods = nation.filter("n_nationkey % 2 = 0").select(*size(n, "instance")).union(nation.select(*size(r, "abstract")).distinct())
    fields = table(spark, d, "orders").select(node("O", "o_orderkey"), node("C", "o_custkey"), node("O", "o_orderkey"), F.when(F.col("o_orderkey") % 3 == 0, "int").otherwise(node("C", "o_custkey")), lit("instance"))
    return {"type": types, "heritage": heritage, "method": methods, "field": fields}


def _calls(spark, d, wanted):
    from graphloom.rules.programs import program
    from graphloom.rules.solve import solve

    return solve(spark, program("calls"), _call_facts(spark, d), [wanted])[wanted]


@query(f"""WITH {CALL_SQL} SELECT type, base FROM t UNION ALL SELECT a.type, b.base FROM t a JOIN t b ON b.type = a.base""")
def rule_conforms(spark, d):
    """The call program's wider closure: everything that a type conforms to."""
    return _calls(spark, d, "conforms")


@query("SELECT 'C:' || c_custkey AS type, 'N:' || c_nationkey AS base FROM customer")
def rule_inherits(spark, d):
    """The narrower one: only what is extended, which ends at a nation, as that implements its region."""
    return _calls(spark, d, "inherits")


@query("""WITH m AS (SELECT 'N:' || n_nationkey AS type, CASE WHEN n_nationkey % 2 = 0 THEN 'N:' || n_nationkey ELSE 'R:' || n_regionkey END || '.size' AS method FROM nation)
SELECT type, 'size' AS name, 0 AS arity, method FROM m UNION ALL SELECT 'C:' || c_custkey, 'size', 0, method FROM customer JOIN m ON type = 'N:' || c_nationkey UNION ALL SELECT DISTINCT 'R:' || n_regionkey, 'size', 0, 'R:' || n_regionkey || '.size' FROM nation""")
def rule_members(spark, d):
    """Members that types see: a declaration hides those farther up."""
    return _calls(spark, d, "member")


@query(f"""WITH {CALL_SQL} SELECT type AS owner, base AS used, CASE WHEN base LIKE 'R:%' THEN 'implements' ELSE 'extends' END AS context FROM t
UNION ALL SELECT 'O:' || o_orderkey, 'C:' || o_custkey, 'field' FROM orders WHERE o_orderkey % 3 <> 0""")
def rule_type_uses(spark, d):
    """Types that types, fields and methods use, with the context."""
    return _calls(spark, d, "type_use")


@query("""SELECT 'N:' || n_nationkey || '.size' AS method, 'R:' || n_regionkey || '.size' AS base FROM nation WHERE n_nationkey % 2 = 0""")
def rule_overrides(spark, d):
    return _calls(spark, d, "overrides")


@query(r"""SELECT p_partkey AS k, CAST(length(p_name) AS BIGINT) AS n, substr(p_name, 3, 4) AS part, p_brand || '/' || p_size AS label, greatest(p_size, 10) AS big, least(p_size, 10) AS small, CASE WHEN contains(p_type, 'AN') THEN 1 ELSE 0 END AS an,
CAST(p_size // 7 AS BIGINT) AS sevenths, CAST(p_size % 7 AS BIGINT) AS rest, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS brand FROM part WHERE regexp_full_match(p_brand, 'Brand#[0-9]+')""")
def rule_functors(spark, d):
    """The rule language's functors over all parts."""
    from graphloom.rules.solve import solve

    text = r"""
    .decl part(k: number, name: symbol, brand: symbol, type: symbol, size: number) .input part
    .decl an(k: number) an(k) :- part(k, _, _, t, _), contains("AN", t).
    .decl flag(k: number, x: number)
    flag(k, 1) :- an(k).
    flag(k, 0) :- part(k, _, _, _, _), !an(k).
    .decl out(k: number, n: number, part: symbol, label: symbol, big: number, small: number, an: number, sevenths: number, rest: number, brand: number)
    out(k, strlen(name), substr(name, 2, 4), cat(b, "/", to_string(s)), max(s, 10), min(s, 10), x, s / 7, s % 7, to_number(substr(b, 6, strlen(b) - 6))) :-
        part(k, name, b, _, s), match("Brand#[0-9]+", b), flag(k, x).
    """
    return solve(spark, text, {"part": table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")}, ["out"])["out"]


@query(f"""WITH RECURSIVE {EDGES_SQL}, {reach_sql('C:1', True, 'g')} SELECT 'C:2' AS node, 'override' AS section, 0 AS hop, NULL AS tier UNION ALL SELECT a, 'direct', 1, 'known_edge' FROM edges WHERE b = 'C:1'
UNION ALL SELECT node, 'transitive', depth, NULL FROM g WHERE depth > 1 UNION ALL SELECT node, 'entry point', depth, NULL FROM g WHERE node LIKE 'S:%'""")
def impact_answer(spark, d):
    """What a change to a customer touches: what must change with it, direct dependents with their tier, the rest by hop, entry points."""
    known = edges(spark, d).withColumn("tier", F.when(F.col("a").startswith("O:"), "known_edge").otherwise("multi_inferred"))
    entries = table(spark, d, "supplier").select(node("S", "s_suppkey").alias("node"))
    pair = relalg.facts(spark, [("C:1", "C:2")], "base string, node string")
    return questions.impact(known, pair, pair.limit(0), entries, start(spark, "C:1"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, {reach_sql('C:1', True, 'g')} SELECT p_brand AS file, CAST(min(depth) AS INTEGER) AS hop FROM part JOIN g ON node = 'P:' || p_partkey WHERE p_size > 25 GROUP BY p_brand""")
def affected_tests(spark, d):
    """Test files (brands) of which a declaration (a large part) reaches a changed customer."""
    part = table(spark, d, "part").filter("p_size > 25").select(node("P", "p_partkey").alias("node"), F.col("p_brand").alias("file"))
    return questions.affected_tests(edges(spark, d), part, part.select("file").distinct(), start(spark, "C:1"))


@query("""SELECT 'c' || c_custkey AS key, 'n' || c_nationkey AS "on", 1 AS depth FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1 FROM nation
UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def keys_that_depend(spark, d):
    """Keys whose value needs another key's, directly or through others."""
    value = lambda k, c: F.concat(F.lit("${" + k), F.col(c).cast("string"), F.lit("}"))
    key = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string")).alias("key")
    values = table(spark, d, "customer").select(key("c", "c_custkey"), value("n", "c_nationkey").alias("value")).union(table(spark, d, "nation").select(key("n", "n_nationkey"), value("r", "n_regionkey")))
    return config.depends(values)


@query("""WITH RECURSIVE f AS (SELECT event_type AS a, n AS b FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IS NOT NULL GROUP BY ALL),
w AS (SELECT (SELECT min(a) FROM f) AS node, 0 AS rest UNION SELECT f.b, (w.rest + 1) % 3 FROM w JOIN f ON f.a = w.node) SELECT node, rest FROM w""")
def rule_three_relations(spark, d):
    """Three relations that recur through each other: what is 0, 1 and 2 hops away, counted by three."""
    from graphloom.plans.catalogue import _event_edges
    from graphloom.rules.solve import solve

    text = """
    .decl edge(a: symbol, b: symbol) .input edge
    .decl first(a: symbol) first(x) :- edge(x, _), x = min y : { edge(y, _) }.
    .decl zero(a: symbol) .decl one(a: symbol) .decl two(a: symbol)
    zero(x) :- first(x).
    one(y) :- zero(x), edge(x, y).
    two(y) :- one(x), edge(x, y).
    zero(y) :- two(x), edge(x, y).
    .decl hops(node: symbol, rest: number)
    hops(x, 0) :- zero(x).  hops(x, 1) :- one(x).  hops(x, 2) :- two(x).
    """
    return solve(spark, text, {"edge": _event_edges(spark, d)}, ["hops"])["hops"]


@query(f"WITH RECURSIVE {EDGES_SQL}, {reach_sql('C:1', True, 'g')} SELECT node, depth FROM g")
def distances_to_customer(spark, d):
    """One-sided: how far everything is from a customer, backwards."""
    return graph.distances(graph.reversed_edges(edges(spark, d)), start(spark, "C:1"))
