"""The registered queries, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators import config, fixpoint, graph, hierarchy, questions, relalg, tiers, web
from graphloom.plans.orders import EDGES_SQL, edges, reach_sql, start
from graphloom.sources import bundle
from graphloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# pages


@query("SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag")
def html_elements_by_tag(spark, d):
    return web.tags(table(spark, d, "pages")).groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


LINKS_SQL = """l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)"""


@query(f"WITH {LINKS_SQL} SELECT CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN 'external' WHEN href LIKE '#%' THEN 'fragment' WHEN href LIKE '/%' THEN 'root_relative' WHEN href = '' THEN 'empty' ELSE 'relative' END AS reason, count(*) AS n, count(DISTINCT href) AS targets FROM l GROUP BY 1")
def link_unresolved_by_reason(spark, d):
    return web.links(table(spark, d, "pages")).groupBy(web.link_reason(F.col("href")).alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("href").alias("targets"))


@query(f"WITH {LINKS_SQL} SELECT page_id, href FROM l WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE regexp_replace(p.url, '^[a-zA-Z]+://[^/]*', '') = l.href)")
def links_not_indexed(spark, d):
    pages = table(spark, d, "pages")
    known = pages.select(web.url_path(F.col("url")).alias("href"))
    return relalg.anti(web.links(pages).select("page_id", "href"), known, ["href"]).select("page_id", "href")


@query("""SELECT token, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(string_split(v, ' ')) AS token FROM (SELECT page_id, unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS v FROM pages)) WHERE token <> '' GROUP BY token""")
def class_token_usage(spark, d):
    return web.classes(table(spark, d, "pages")).groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query("SELECT page_id, md5(array_to_string(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1), ',')) AS signature FROM pages")
def page_shape_signature(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(F.array_join(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), 1), ",")).alias("signature"))


@query("""WITH s AS (SELECT page_id, md5(array_to_string(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1), ',')) AS signature FROM pages)
SELECT signature, count(*) AS pages, min(page_id) AS first_page FROM s GROUP BY signature HAVING count(*) > 1""")
def repeated_page_shapes(spark, d):
    return page_shape_signature(spark, d).groupBy("signature").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).filter("pages > 1")


@query("""SELECT page_id, CAST(i AS INTEGER) AS position, regexp_extract(h[i], '^<h([1-6])', 1) AS level, regexp_replace(h[i], '<[^>]*>', '', 'g') AS heading
FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<h[1-6][^>]*>[^<]*</h[1-6]>') AS h FROM pages))""")
def page_heading_outline(spark, d):
    found = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<h[1-6][^>]*>[^<]*</h[1-6]>"), 0)).alias("p", "h"))
    return found.select("page_id", (F.col("p") + 1).alias("position"), F.regexp_extract("h", "^<h([1-6])", 1).alias("level"), F.regexp_replace("h", "<[^>]*>", "").alias("heading"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9]* class="ad"')) AS BIGINT) AS matches FROM pages WHERE regexp_matches(html, '<[a-zA-Z][a-zA-Z0-9]* class="ad"')""")
def selector_match_class_ad(spark, d):
    pattern = F.lit('<[a-zA-Z][a-zA-Z0-9]* class="ad"')
    return table(spark, d, "pages").select("page_id", F.regexp_count("html", pattern).cast("long").alias("matches")).filter("matches > 0")


STYLE_SQL = """sheet AS (SELECT page_id, unnest(regexp_extract_all(html, '<style>([^<]*)</style>', 1)) AS css FROM pages),
rule AS (SELECT page_id, unnest(regexp_extract_all(css, '([^{}]+\\{[^{}]*\\})', 1)) AS r FROM sheet),
decl AS (SELECT page_id, trim(split_part(r, '{', 1)) AS selector, unnest(string_split(regexp_extract(r, '\\{([^{}]*)\\}', 1), ';')) AS d FROM rule),
style AS (SELECT page_id, selector, trim(split_part(d, ':', 1)) AS property, trim(regexp_replace(d, '^[^:]*:', '')) AS value FROM decl WHERE contains(d, ':'))"""


@query(f"WITH {STYLE_SQL} SELECT selector, property, value, count(*) AS n FROM style GROUP BY ALL")
def style_declarations(spark, d):
    return web.style_rules(table(spark, d, "pages")).groupBy("selector", "property", "value").agg(F.count("*").alias("n"))


@query(f"""WITH {STYLE_SQL}, used AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages)
SELECT s.page_id, s.selector FROM (SELECT DISTINCT page_id, selector FROM style) s ANTI JOIN used u ON u.page_id = s.page_id AND u.tag = s.selector""")
def unused_tag_selectors(spark, d):
    """Selectors by tag without an element on their page."""
    pages = table(spark, d, "pages")
    rules = web.style_rules(pages).select("page_id", "selector").distinct()
    return relalg.anti(rules, web.tags(pages).withColumnRenamed("tag", "selector").distinct(), ["page_id", "selector"]).select("page_id", "selector")


@query("""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-zA-Z]+://', ''), '[?#].*$', '') AS u FROM pages), p AS (SELECT page_id, string_split(u, '/') AS parts FROM h)
SELECT ancestor, count(DISTINCT page_id) AS pages FROM (SELECT page_id, array_to_string(parts[1:k], '/') AS ancestor FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM p)) GROUP BY ancestor""")
def url_path_ancestors(spark, d):
    plain = F.regexp_replace(F.regexp_replace("url", "^[a-zA-Z]+://", ""), "[?#].*$", "")
    return table(spark, d, "pages").select("page_id", F.explode(fn.prefixes(plain, "/")).alias("ancestor")).groupBy("ancestor").agg(F.countDistinct("page_id").alias("pages"))


# trees given as tables: a region's page has a part for each nation and, in it, a paragraph for each customer


TREE_SQL = """n AS (SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nth, count(*) OVER (PARTITION BY n_regionkey) AS family FROM nation),
c AS (SELECT c_custkey, c_mktsegment, c_nationkey, n_regionkey, row_number() OVER w AS nth, count(*) OVER (PARTITION BY c_nationkey) AS family, lag(c_mktsegment) OVER w AS before FROM customer JOIN nation ON n_nationkey = c_nationkey WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey))"""


def _tree(spark, d):
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    none = lambda t: F.lit(None).cast(t)
    attributes, classes = F.create_map().cast("map<string,string>"), lambda *c: F.array(*c).cast("array<string>")
    row = lambda page, element, parent, depth, position, tag, own, cls, text: [page.cast("long").alias("page_id"), element.cast("int").alias("element"), parent.cast("int").alias("parent"), F.lit(depth).alias("depth"), position.cast("int").alias("position"), F.lit(tag).alias("tag"), own.alias("id"), cls.alias("classes"), attributes.alias("attributes"), text.alias("text")]
    roots = table(spark, d, "region").select(*row(F.col("r_regionkey"), F.lit(0), F.lit(-1), 0, F.lit(0), "html", none("string"), classes(), F.lit("")))
    at = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    parts = nation.select(*row(F.col("n_regionkey"), F.col("n_nationkey") + 1, F.lit(0), 1, at - 1, "div", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), classes(F.lit("nation")), F.lit("")))
    placed = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    nth = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    paragraphs = placed.select(*row(F.col("n_regionkey"), F.col("c_custkey") + 100, F.col("c_nationkey") + 1, 2, nth - 1, "p", F.concat(F.lit("c"), F.col("c_custkey").cast("string")), classes(F.col("c_mktsegment"), F.lit("customer")), F.col("c_name")))
    return roots.union(parts).union(paragraphs)


@query(f"""WITH {TREE_SQL} SELECT 'div > p.BUILDING' AS selector, 3 AS status, count(*) AS n FROM c WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'p.BUILDING + p', 3, count(*) FROM c WHERE before = 'BUILDING' UNION ALL SELECT 'div:has(> p.BUILDING)', 3, count(DISTINCT c_nationkey) FROM c WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'html p:nth-child(3n+1)', 3, count(*) FROM c WHERE (nth - 1) % 3 = 0 UNION ALL SELECT 'p:not(.BUILDING):last-child', 3, count(*) FROM c WHERE nth = family AND c_mktsegment <> 'BUILDING'
UNION ALL SELECT 'div:first-child p:hover, div:nth-last-child(1)', 2, count(*) FROM c WHERE c_nationkey IN (SELECT n_nationkey FROM n WHERE nth = 1) UNION ALL SELECT 'div:first-child p:hover, div:nth-last-child(1)', 3, count(*) FROM n WHERE nth = family""")
def web_selector_status(spark, d):
    """Elements that selectors match for sure, or under a condition."""
    wanted = ["div > p.BUILDING", "p.BUILDING + p", "div:has(> p.BUILDING)", "html p:nth-child(3n+1)", "p:not(.BUILDING):last-child", "div:first-child p:hover, div:nth-last-child(1)"]
    return web.selected(_tree(spark, d), wanted).groupBy("selector", "status").agg(F.count("*").alias("n"))


@query(f"""WITH {TREE_SQL}, s AS (SELECT md5('p(') AS leaf), d AS (SELECT c_nationkey, md5('div(' || array_to_string(list_transform(range(0, count(*)), lambda x: leaf), ',')) AS signature FROM c, s GROUP BY c_nationkey, leaf)
SELECT signature, count(*) AS n, count(DISTINCT page) AS pages FROM (SELECT leaf AS signature, n_regionkey AS page FROM c, s UNION ALL SELECT coalesce(signature, md5('div(')), n_regionkey FROM n LEFT JOIN d ON c_nationkey = n_nationkey) GROUP BY signature HAVING count(*) > 1""")
def web_component_signatures(spark, d):
    """Repeated subtrees, by structural signature."""
    repeated = web.signatures(_tree(spark, d)).groupBy("signature").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))
    return repeated.filter("n > 1")


# relational algebra


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def documents_without_label(spark, d):
    return relalg.anti(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey = 1)")
def parts_not_from_supplier_1(spark, d):
    served = table(spark, d, "lineitem").filter("l_suppkey = 1").select(F.col("l_partkey").alias("p_partkey"))
    return relalg.anti(table(spark, d, "part").select("p_partkey"), served, ["p_partkey"])


@query("SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50)")
def suppliers_with_line(spark, d):
    lines = table(spark, d, "lineitem").filter("l_quantity >= 50").select(F.col("l_suppkey").alias("s_suppkey"))
    return relalg.semi(table(spark, d, "supplier").select("s_suppkey", "s_name"), lines, ["s_suppkey"])


@query("SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def order_line_count_with_zero(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return relalg.count_with_zero(table(spark, d, "orders").select("o_orderkey"), lines, ["o_orderkey"], "lines")


@query("SELECT n_name FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name HAVING count(DISTINCT CASE WHEN o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders) THEN o_orderpriority END) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def nations_covering_all_priorities(spark, d):
    orders = table(spark, d, "orders")
    named = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    pairs = orders.join(named, F.col("o_custkey") == F.col("c_custkey")).select("n_name", "o_orderpriority")
    return relalg.division(pairs, "n_name", "o_orderpriority", orders)


@query("SELECT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority IS NOT NULL GROUP BY c_custkey HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def customers_with_every_priority(spark, d):
    orders = table(spark, d, "orders")
    return relalg.division(orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority"), "c_custkey", "o_orderpriority", orders)


EVENT_US = "epoch_us(ts)"


@query("""SELECT s.user_id, s.event_id AS start_event, e.event_id FROM (SELECT user_id, event_id, ts FROM events WHERE event_type = (SELECT min(event_type) FROM events)) s
JOIN events e ON e.user_id = s.user_id AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 6 HOUR AND e.event_id <> s.event_id""")
def event_in_window_of_signup(spark, d):
    """Range join: a user's events within six hours of an event of the first type."""
    events = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    first = events.agg(F.min("event_type").alias("event_type"))
    hours = 6 * 3600 * 1000000
    spans = events.join(F.broadcast(first), "event_type").select("user_id", F.col("event_id").alias("start_event"), F.col("at").alias("low"), (F.col("at") + hours).alias("high"))
    return relalg.range_join(events.select("user_id", "event_id", "at"), spans, ["user_id"], "at", "low", "high", hours).filter("event_id <> start_event").select("user_id", "start_event", "event_id")


@query("""WITH k AS (SELECT max(event_type) AS t FROM events)
SELECT e.event_id, e.user_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.ts = (SELECT max(q.ts) FROM events q WHERE q.user_id = e.user_id AND q.ts < e.ts)) AS prior_event
FROM events e, k WHERE e.event_type = k.t""")
def last_event_before_error(spark, d):
    """As-of: the last event of the user before each event of the last type."""
    events = table(spark, d, "events")
    last = events.agg(F.max("event_type").alias("event_type"))
    left = events.join(F.broadcast(last), "event_type").select("event_id", "user_id", "ts")
    return relalg.as_of(left, events.select("user_id", "ts", F.col("event_id").alias("event")), ["user_id"], "ts", ["event"]).select("event_id", "user_id", F.col("prior_event").alias("prior_event"))


@query("""SELECT a.p_partkey, min(b.p_size) AS nearest_size FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND b.p_size < a.p_size GROUP BY a.p_partkey""")
def shadowed_parts(spark, d):
    """Parts that a smaller one of the same brand and type hides. A minimum per group decides it; no self-join is needed."""
    part = table(spark, d, "part")
    least = Window.partitionBy("p_brand", "p_type")
    return part.withColumn("nearest_size", F.min("p_size").over(least)).filter("nearest_size < p_size").select("p_partkey", "nearest_size")


@query("SELECT p_brand, p_partkey, p_retailprice, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def top_parts_per_brand(spark, d):
    order = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").withColumn("place", F.row_number().over(order)).filter("place <= 3").select("p_brand", "p_partkey", "p_retailprice", "place")


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS precedence, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after_role FROM conversations")
def turn_precedence_rank(spark, d):
    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", (F.row_number().over(order) - 1).alias("precedence"), F.lag("role").over(order).alias("after_role"))


@query("SELECT l_orderkey, l_linenumber, CAST(g AS INTEGER) AS step FROM (SELECT l_orderkey, l_linenumber, unnest(range(0, l_linenumber)) AS g FROM lineitem)")
def generated_ranges(spark, d):
    return relalg.generate(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), F.lit(0), F.col("l_linenumber"), "step")


@query("SELECT p_partkey, p_name || '#' || p_brand AS label, CAST(length(p_name) AS INTEGER) AS n, substr(p_name, 1, 4) AS head, contains(p_type, 'A') AS has_a, regexp_full_match(p_brand, 'Brand#[0-9]+') AS is_brand, TRY_CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS number FROM part")
def rule_string_functions(spark, d):
    c = F.col
    return table(spark, d, "part").select("p_partkey", fn.cat(c("p_name"), F.lit("#"), c("p_brand")).alias("label"), fn.strlen(c("p_name")).alias("n"), fn.substr(c("p_name"), 0, 4).alias("head"), fn.contains("A", c("p_type")).alias("has_a"), fn.match("Brand#[0-9]+", c("p_brand")).alias("is_brand"), fn.to_number(F.regexp_extract("p_brand", "([0-9]+)", 1)).alias("number"))


@query("SELECT DISTINCT name, kind FROM (SELECT s_name AS name, 'supplier' AS kind FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT c_name, 'customer' FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0)")
def accounts_of_interest(spark, d):
    """Several clauses with one head, and a disjunction in a body."""
    return relalg.distinct_union(table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind")), table(spark, d, "customer").filter((F.col("c_mktsegment") == "BUILDING") | (F.col("c_acctbal") < 0)).select(F.col("c_name").alias("name"), F.lit("customer").alias("kind")))


@query("SELECT o_orderkey, urgency FROM orders JOIN (VALUES ('1-URGENT', 3), ('2-HIGH', 2), ('3-MEDIUM', 1)) v(p, urgency) ON p = o_orderpriority")
def literal_fact_join(spark, d):
    levels = relalg.facts(spark, [("1-URGENT", 3), ("2-HIGH", 2), ("3-MEDIUM", 1)], "o_orderpriority string, urgency int")
    return table(spark, d, "orders").join(levels, "o_orderpriority").select("o_orderkey", "urgency")


@query("SELECT o_custkey, min(o_totalprice) AS least, max(o_totalprice) AS most, count(*) AS n, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_custkey")
def aggregates_by_customer(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"), F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("priorities"))


@query("SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def parts_returned_and_open(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("key")).distinct().join(lines.filter("l_returnflag = 'N'").select(F.col("l_partkey").alias("key")), "key", "left_semi")


# tiers and conservation


@query("""WITH p AS (SELECT DISTINCT l_orderkey || '-' || l_partkey AS site, l_suppkey AS target FROM lineitem), f AS (SELECT site, count(*) AS n FROM p GROUP BY site)
SELECT site, target, CASE WHEN n = 1 THEN 'known_edge' ELSE 'multi_inferred' END AS tier FROM p JOIN f USING (site)""")
def order_part_supplier_tiers(spark, d):
    sites = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_partkey").alias("site"), F.col("l_suppkey").alias("target"), F.lit("client").alias("provenance"))
    return tiers.tiered_edges(sites, sites)


def _order_edges(spark, d, cap=None):
    sites = table(spark, d, "orders").select(F.col("o_orderkey").alias("site"))
    targets = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("site"), F.col("l_suppkey").alias("target"), F.when(F.col("l_returnflag") == "R", "lib").otherwise("client").alias("provenance"))
    return tiers.tiered_edges(sites, targets, cap)


SITE_SQL = """WITH p AS (SELECT DISTINCT l_orderkey AS site, l_suppkey AS target, CASE WHEN l_returnflag = 'R' THEN 'lib' ELSE 'client' END AS provenance FROM lineitem),
f AS (SELECT site, count(*) AS n FROM p GROUP BY site)"""


@query(SITE_SQL + """ SELECT p.site, p.target, CASE WHEN provenance = 'lib' THEN 'boundary_lib' WHEN n = 1 THEN 'known_edge' ELSE 'multi_inferred' END AS tier FROM p JOIN f USING (site)
UNION ALL SELECT o_orderkey, NULL, 'ambiguous_unknown' FROM orders WHERE o_orderkey NOT IN (SELECT site FROM p)""")
def site_edges_by_tier(spark, d):
    return _order_edges(spark, d)


@query(SITE_SQL + """ SELECT p.site, p.target, CASE WHEN provenance = 'lib' THEN 'boundary_lib' WHEN n = 1 THEN 'known_edge' ELSE 'multi_inferred' END AS tier FROM p JOIN f USING (site) WHERE n <= 4
UNION ALL SELECT site, NULL, 'fan_capped' FROM f WHERE n > 4
UNION ALL SELECT o_orderkey, NULL, 'ambiguous_unknown' FROM orders WHERE o_orderkey NOT IN (SELECT site FROM p)""")
def site_edges_with_fan_cap(spark, d):
    return _order_edges(spark, d, 4)


@query("SELECT CASE WHEN l.k IS NULL THEN 'open' ELSE 'closed' END AS state, count(*) AS sites FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON l.k = o_orderkey GROUP BY 1")
def site_conservation(spark, d):
    made = _order_edges(spark, d).groupBy("site").agg(F.max("target").alias("t"))
    return made.groupBy(F.when(F.col("t").isNull(), "open").otherwise("closed").alias("state")).agg(F.count("*").alias("sites"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS fan, CASE WHEN count(DISTINCT l_partkey) > 500 THEN 'fan_capped' ELSE 'multi_inferred' END AS tier FROM lineitem GROUP BY l_suppkey")
def supplier_fan_capped(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("fan")).withColumn("tier", F.when(F.col("fan") > 500, "fan_capped").otherwise("multi_inferred"))


@query("SELECT o_custkey, count(*) AS open_orders FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY o_custkey")
def unresolved_most_called(spark, d):
    open_ = tiers.unresolved(_order_edges(spark, d)).select(F.col("site").alias("o_orderkey"))
    return table(spark, d, "orders").join(open_, "o_orderkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("open_orders"))


# recursion and graph questions


@query(f"WITH RECURSIVE {EDGES_SQL}, {reach_sql('S:1')} SELECT node, depth FROM reach")
def supplier_reach(spark, d):
    """Hops from one supplier over the whole typed graph."""
    return graph.distances(edges(spark, d), start(spark, "S:1"))


@query("WITH RECURSIVE e AS (SELECT 'N:' || n_nationkey AS a, 'R:' || n_regionkey AS b FROM nation UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey FROM customer), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM c")
def nation_region_reach(spark, d):
    pairs = table(spark, d, "nation").select(F.concat(F.lit("N:"), "n_nationkey").alias("a"), F.concat(F.lit("R:"), "n_regionkey").alias("b")).union(table(spark, d, "customer").select(F.concat(F.lit("C:"), "c_custkey"), F.concat(F.lit("N:"), "c_nationkey")))
    return fixpoint.closure(pairs)


USER_EDGES_SQL = "e AS (SELECT DISTINCT event_type AS a, n AS b FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IS NOT NULL)"


def _event_edges(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("event_type").alias("a"), F.lead("event_type").over(order).alias("b")).filter("b IS NOT NULL").distinct()


@query(f"WITH RECURSIVE {USER_EDGES_SQL}, c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM c")
def user_event_reach(spark, d):
    return fixpoint.closure(_event_edges(spark, d))


@query(f"WITH RECURSIVE {USER_EDGES_SQL}, p AS (SELECT (SELECT min(a) FROM e) AS node, 0 AS parity UNION SELECT e.b, 1 - p.parity FROM p JOIN e ON p.node = e.a) SELECT node, CASE parity WHEN 0 THEN 'even' ELSE 'odd' END AS hops FROM p")
def even_odd_hops(spark, d):
    """Two relations that recur through each other: what is an even, and an odd, number of hops away."""
    from graphloom.operators.staging import cut

    hops = cut(_event_edges(spark, d))
    seed = hops.agg(F.min("a").alias("node"))
    step = lambda side: lambda total, fresh: fresh[side].join(hops, F.col("node") == F.col("a")).select(F.col("b").alias("node"))
    found = fixpoint.mutual_fixpoint({"even": seed, "odd": seed.limit(0)}, {"even": step("odd"), "odd": step("even")})
    return found["even"].withColumn("hops", F.lit("even")).union(found["odd"].withColumn("hops", F.lit("odd")))


@query(f"""WITH RECURSIVE {EDGES_SQL}, {reach_sql('C:1')} SELECT r.node, r.depth, e.a AS parent FROM reach r JOIN edges e ON e.b = r.node JOIN reach p ON p.node = e.a AND p.depth = r.depth - 1""")
def path_customer_to_region(spark, d):
    known = graph.steps(edges(spark, d))
    return graph.parents(known, graph.walk(known, start(spark, "C:1")))


@query(f"WITH RECURSIVE {EDGES_SQL}, {reach_sql('S:1', name='f')}, {reach_sql('C:1', True, 'g')} SELECT node FROM f INTERSECT SELECT node FROM g")
def between_supplier_customer(spark, d):
    return graph.between(edges(spark, d), start(spark, "S:1"), start(spark, "C:1"))


@query(f"WITH RECURSIVE {EDGES_SQL}, {reach_sql('O:1', True)} SELECT node, depth FROM reach WHERE depth > 0")
def impact_of_order(spark, d):
    """What leads to an order: parts and suppliers, by hop."""
    return graph.impact(edges(spark, d), start(spark, "O:1"))


@query("SELECT DISTINCT l_partkey AS part, o_custkey AS customer FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey = 1")
def impact_of_supplier(spark, d):
    served = table(spark, d, "lineitem").filter("l_suppkey = 1").select("l_orderkey", F.col("l_partkey").alias("part"))
    return table(spark, d, "orders").join(served, F.col("o_orderkey") == F.col("l_orderkey")).select("part", F.col("o_custkey").alias("customer")).distinct()


@query("SELECT d.source, l.quality, count(*) AS documents, count_if(l.toxic = 1) AS toxic FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL")
def impact_documents_labelled(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return joined.groupBy("source", "quality").agg(F.count("*").alias("documents"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query(f"""WITH RECURSIVE {EDGES_SQL}
SELECT * FROM (SELECT a, b, 'known_edge' AS tier FROM edges UNION SELECT 'C:1', 'R:0', 'asserted' UNION SELECT 'N:1', 'R:0', 'asserted') WHERE NOT (a = 'N:0' AND b = 'R:0')""")
def edges_with_overlay(spark, d):
    known = edges(spark, d).withColumn("tier", F.lit("known_edge"))
    asserted = relalg.facts(spark, [("C:1", "R:0"), ("N:1", "R:0")], "a string, b string")
    rejected = relalg.facts(spark, [("N:0", "R:0")], "a string, b string")
    return graph.with_overlay(known, asserted, rejected)


@query(f"""WITH RECURSIVE {EDGES_SQL}, f AS (SELECT 'O:1' AS node UNION SELECT b FROM f JOIN edges ON a = node),
g AS (SELECT 'O:1' AS node UNION SELECT b FROM g JOIN edges ON a = node WHERE NOT (a = 'O:1')) SELECT node FROM f EXCEPT SELECT node FROM g""")
def reached_only_through(spark, d):
    """Evidence: nodes that an order reaches over its customer's edge alone."""
    own = table(spark, d, "orders").filter("o_orderkey = 1").agg(F.max("o_custkey")).first()[0]  # the edge that the question is about
    return graph.only_through(edges(spark, d), start(spark, "O:1"), ("O:1", f"C:{own}"))


@query("""WITH a AS (SELECT o_custkey AS k, max(o_orderstatus) AS s, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderstatus) AS s, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1)
SELECT qualified_name, change FROM (SELECT 'C:' || coalesce(a.k, b.k) AS qualified_name, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.s <> b.s THEN 'signature' WHEN a.n <> b.n THEN 'body only' END AS change FROM a FULL JOIN b ON a.k = b.k) WHERE change IS NOT NULL""")
def order_status_diff(spark, d):
    """What changed between two snapshots of customers, by name."""
    half = lambda c: table(spark, d, "orders").filter(c).groupBy(F.concat(F.lit("C:"), F.col("o_custkey").cast("string")).alias("qualified_name")).agg(F.lit("method").alias("kind"), F.max("o_orderstatus").alias("signature"), F.count("*").alias("body"))
    return questions.changed(half("o_orderdate < timestamp'1995-01-01'"), half("o_orderdate >= timestamp'1995-01-01'"))


@query("SELECT *, 'removed' AS change FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <= 2 EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1) UNION ALL SELECT *, 'added' FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1 EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <= 2)")
def graph_difference(spark, d):
    lines = table(spark, d, "lineitem")
    return graph.graph_diff(lines.filter("l_linenumber <= 2"), lines.filter("l_linenumber = 1"), ["l_partkey", "l_suppkey"])


# hierarchy on the order graph: regions as supertypes of nations, nations of customers


@query("SELECT 'N:' || n_nationkey AS id, 'R:' || n_regionkey AS parent FROM nation UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey FROM customer")
def containment_roll_up(spark, d):
    """The direct parent of each span: a region is a file, its nations stretches of it, their customers lines in these."""
    wide = 10**9
    nation, c = table(spark, d, "nation"), lambda k, x: F.concat(F.lit(k), F.col(x).cast("string")).alias("id")
    low = F.col("n_nationkey").cast("long") * wide
    file = F.col("n_regionkey").alias("file")
    spans = table(spark, d, "region").select(F.col("r_regionkey").alias("file"), c("R:", "r_regionkey"), F.lit(0).cast("long").alias("low"), F.lit(wide * 10**6).alias("high"))
    spans = spans.union(nation.select(file, c("N:", "n_nationkey"), low, low + wide - 1))
    inside = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return hierarchy.direct_parents(spans.union(inside.select(file, c("C:", "c_custkey"), low + F.col("c_custkey") % wide, low + F.col("c_custkey") % wide)))


HIER_SQL = "p AS (SELECT 'C:' || c_custkey AS type, 'N:' || c_nationkey AS parent FROM customer UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation)"


def _hierarchy(spark, d):
    c = lambda k, x: F.concat(F.lit(k), F.col(x).cast("string"))
    return table(spark, d, "customer").select(c("C:", "c_custkey").alias("type"), c("N:", "c_nationkey").alias("parent")).union(table(spark, d, "nation").select(c("N:", "n_nationkey"), c("R:", "n_regionkey")))


@query(f"WITH RECURSIVE {HIER_SQL}, a AS (SELECT type, parent AS ancestor, 1 AS depth FROM p UNION SELECT a.type, p.parent, a.depth + 1 FROM a JOIN p ON p.type = a.ancestor) SELECT type, ancestor, CAST(min(depth) AS INTEGER) AS depth FROM a GROUP BY ALL")
def hierarchy_closure(spark, d):
    return hierarchy.ancestors(_hierarchy(spark, d))


@query(f"""WITH RECURSIVE {HIER_SQL}, m AS (SELECT type AS owner, 'size' AS name FROM p WHERE type LIKE 'N:1%' UNION ALL SELECT 'R:' || r_regionkey, 'size' FROM region UNION ALL SELECT 'C:1', 'size'),
a AS (SELECT type, parent AS ancestor, 1 AS depth FROM p UNION SELECT a.type, p.parent, a.depth + 1 FROM a JOIN p ON p.type = a.ancestor),
c AS (SELECT owner AS type, name, owner, 0 AS depth FROM m UNION SELECT a.type, m.name, m.owner, a.depth FROM a JOIN m ON m.owner = a.ancestor)
SELECT type, name, owner, CAST(depth AS INTEGER) AS depth, count(*) OVER (PARTITION BY type, name) > 1 AS tied FROM (SELECT *, rank() OVER (PARTITION BY type, name ORDER BY depth) AS r FROM c) WHERE r = 1""")
def member_lookup_with_hiding(spark, d):
    """The nearest declaration that a customer, nation or region sees hides those farther up."""
    up = _hierarchy(spark, d)
    members = up.filter(F.col("type").startswith("N:1")).select(F.col("type").alias("owner")).union(table(spark, d, "region").select(F.concat(F.lit("R:"), F.col("r_regionkey").cast("string")))).union(spark.createDataFrame([("C:1",)], "owner string")).withColumn("name", F.lit("size"))
    return hierarchy.lookup(members, up)


@query("SELECT r.user_id, r.contract FROM (SELECT e.user_id, c.contract, count(DISTINCT e.event_type) AS n FROM events e JOIN (SELECT DISTINCT event_type, CASE WHEN event_type < 'm' THEN 'low' ELSE 'high' END AS contract FROM events) c USING (event_type) GROUP BY ALL) r JOIN (SELECT CASE WHEN event_type < 'm' THEN 'low' ELSE 'high' END AS contract, count(DISTINCT event_type) AS n FROM events GROUP BY 1) w ON w.contract = r.contract AND w.n = r.n")
def structural_satisfaction(spark, d):
    """Users whose events cover every event type that a contract asks for."""
    events = table(spark, d, "events")
    required = events.select(F.when(F.col("event_type") < "m", "low").otherwise("high").alias("contract"), F.col("event_type").alias("name"), F.lit(0).alias("arity")).distinct()
    declared = events.select(F.col("user_id").alias("type"), F.col("event_type").alias("name"), F.lit(0).alias("arity"))
    return hierarchy.satisfies(required, declared).select(F.col("type").alias("user_id"), "contract")


@query("SELECT a.o_orderkey AS id, arg_min(b.o_orderkey, struct_pack(d := b.o_orderdate, k := b.o_orderkey)) AS next_order FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate > a.o_orderdate GROUP BY a.o_orderkey")
def nearest_following_order(spark, d):
    """As-of with time running backwards: the last order strictly before is the next one."""
    orders = table(spark, d, "orders").withColumns({"back": -F.unix_micros(F.col("o_orderdate").cast("timestamp")), "order": -F.col("o_orderkey")})
    found = relalg.as_of(orders.select("o_orderkey", "o_custkey", "back"), orders.select("o_custkey", "back", "order"), ["o_custkey"], "back", ["order"])
    return found.filter("prior_order IS NOT NULL").select(F.col("o_orderkey").alias("id"), (-F.col("prior_order")).alias("next_order"))


# configuration, text, vocabulary


@query("SELECT json_extract_string(props, '$.k') AS value, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1")
def event_props_key_values(spark, d):
    return table(spark, d, "events").select(F.get_json_object("props", "$.k").alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT json_extract_string(props, '$.k') AS value, count(DISTINCT user_id) AS users, min(user_id) AS first_user FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1")
def props_key_to_users(spark, d):
    return table(spark, d, "events").select(F.get_json_object("props", "$.k").alias("value"), "user_id").filter("value IS NOT NULL").groupBy("value").agg(F.countDistinct("user_id").alias("users"), F.min("user_id").alias("first_user"))


@query("""WITH v(source, key, value) AS (VALUES ('a', 'host', 'h'), ('a', 'url', 'http://h/x'), ('a', 'deep', 'http://h/x/y'), ('a', 'alt', 'none'), ('a', 'loop', '${loop}'))
SELECT n_nationkey AS nation, key, value, value = '${loop}' AS open FROM nation, v""")
def placeholder_chains(spark, d):
    """Values whose placeholders go over other keys, a default, and a key that needs itself."""
    raw = relalg.facts(spark, [("host", "h"), ("url", "http://${host}/x"), ("deep", "${url}/y"), ("alt", "${missing:none}"), ("loop", "${loop}")], "key string, value string")
    values = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("source")).join(raw)
    return config.resolved(values).select(F.col("source").cast("int").alias("nation"), "key", "value", "open")


TOKEN_SQL = "t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents)"


@query(f"WITH {TOKEN_SQL} SELECT token, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_document FROM t GROUP BY token")
def doc_token_index(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("token")).groupBy("token").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_document"))


@query(f"WITH {TOKEN_SQL}, n AS (SELECT count(*) AS n FROM documents) SELECT token, round(ln(max(n.n)::DOUBLE / count(DISTINCT doc_id)), 6) AS idf FROM t, n GROUP BY token HAVING count(DISTINCT doc_id) >= 5")
def context_terms_idf(spark, d):
    total = table(spark, d, "documents").agg(F.count("*").alias("n"))
    return doc_token_index(spark, d).filter("documents >= 5").join(F.broadcast(total)).select("token", F.round(F.log(F.col("n") / F.col("documents")), 6).alias("idf"))


@query("SELECT 'event_type' AS field, event_type AS value, count(*) AS n, event_type IN ('click', 'view', 'purchase') AS documented FROM events GROUP BY event_type")
def vocab_event_type(spark, d):
    return bundle.vocabulary(table(spark, d, "events"), ["event_type"], {"event_type": ["click", "view", "purchase"]})


@query("SELECT doc_id, CAST(floor((s - n_chars) / 20000) AS BIGINT) AS page FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM documents)")
def pages_of_a_budget(spark, d):
    """Pagination: documents of a source on pages of a fixed budget of characters."""
    return questions.pages(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", ["doc_id"], "n_chars", 20000).select("doc_id", "page")


@query("SELECT name, state, count(*) AS n FROM (SELECT p_brand AS name, CASE WHEN l_flag IS NULL THEN 'undecided' WHEN l_flag = 'R' THEN 'selected' ELSE 'excluded' END AS state FROM part LEFT JOIN (SELECT l_partkey, min(l_returnflag) AS l_flag FROM lineitem GROUP BY 1) ON l_partkey = p_partkey) GROUP BY ALL")
def three_state_conditions(spark, d):
    values = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("value"))
    conditions = table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("key"), F.lit("R").alias("wanted"))
    return config.three_states(conditions, values).groupBy("name", "state").agg(F.count("*").alias("n"))


@query("""SELECT s.side, count(*) AS n FROM (SELECT 'served' AS side FROM (SELECT DISTINCT o_custkey FROM orders) JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'unserved' FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') UNION ALL SELECT 'unsent' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')) s GROUP BY s.side""")
def cross_process_sides(spark, d):
    """Senders joined with servers on a key, and both sides that stay alone."""
    sent = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    served = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    keys = sent.select("c_custkey").distinct()
    parts = [keys.join(served, "c_custkey").select(F.lit("served").alias("side")), relalg.anti(keys, served.filter("c_mktsegment <> 'BUILDING'"), ["c_custkey"]).select(F.lit("unserved").alias("side")), relalg.anti(served, sent.filter("o_orderstatus = 'F'"), ["c_custkey"]).select(F.lit("unsent").alias("side"))]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("side").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, min(o_orderkey) AS first_order, arg_min(o_orderpriority, o_orderkey) AS kind FROM orders GROUP BY o_custkey")
def first_seen_kind(spark, d):
    return relalg.first_seen(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("first_order"), F.col("o_orderpriority").alias("kind"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, n_name) AS label FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3")
def filled_by_fallback(spark, d):
    near = F.broadcast(table(spark, d, "nation").filter("n_regionkey < 3"))
    joined = table(spark, d, "customer").join(near, F.col("c_nationkey") == F.col("n_nationkey"), "left").withColumn("label", F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")))
    return relalg.fill(joined, "label", F.col("n_name")).select("c_custkey", "label")


from graphloom.plans import extended as _extended  # noqa: E402, F401  (registers further queries)
