"""Questions of the query layer: what changed, what a change touches and how sure that is, tests, task context, pages of an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.operators.staging import cut
from graphloom.schemas import tier_rank


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """qualified_name, change: declarations (qualified_name, kind, signature, body) of two snapshots, by name and never by id."""
    a = old.select("qualified_name", *[F.col(c).alias(f"old_{c}") for c in ("kind", "signature", "body")])
    b = new.select("qualified_name", *[F.col(c).alias(f"new_{c}") for c in ("kind", "signature", "body")])
    differs = lambda c: ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    change = F.when(F.col("old_kind").isNull(), "added").when(F.col("new_kind").isNull(), "removed").when(differs("signature"), F.when(F.col("new_kind") == "field", "field").when(F.col("new_kind") == "type", "type header").otherwise("signature")).when(differs("body"), "body only")
    return a.join(b, "qualified_name", "full").select("qualified_name", change.alias("change")).filter("change IS NOT NULL")


def impact(edges: DataFrame, overrides: DataFrame, subtypes: DataFrame, entry_points: DataFrame, target: DataFrame, max_depth: int = 40) -> DataFrame:
    """node, section, hop, tier of what a change to target (node) touches.

    Sections: must change with it (overrides base, node; subtypes base, node), direct dependents with the best tier of
    their edges (a, b, tier), transitive callers by hop, and the entry points among them."""
    with_it = overrides.join(target.select(F.col("node").alias("base")), "base").select("node", F.lit("override").alias("section")).union(subtypes.join(target.select(F.col("node").alias("base")), "base").select("node", F.lit("subtype")))
    tied = with_it.distinct().select("node", "section", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("tier"))
    best = edges.join(target.select(F.col("node").alias("b")), "b").groupBy(F.col("a").alias("node")).agg(F.min_by("tier", tier_rank(F.col("tier"))).alias("tier"))
    direct = best.select("node", F.lit("direct").alias("section"), F.lit(1).alias("hop"), "tier")
    callers = graph.impact(edges, target, max_depth)
    far = callers.filter("depth > 1").select("node", F.lit("transitive"), F.col("depth"), F.lit(None).cast("string"))
    entries = callers.join(entry_points.select("node"), "node", "left_semi").select("node", F.lit("entry point"), F.col("depth"), F.lit(None).cast("string"))
    return tied.union(direct).union(far).union(entries)


def affected_tests(edges: DataFrame, declared_in: DataFrame, tests: DataFrame, changes: DataFrame, max_depth: int = 40) -> DataFrame:
    """file, hop: test files (tests: file) one of whose declarations (node, file) reaches a change (node)."""
    reached = graph.distances(graph.reversed_edges(edges), changes, max_depth)
    return reached.join(declared_in, "node").join(tests.select("file"), "file", "left_semi").groupBy("file").agg(F.min("depth").alias("hop"))


def context(tokens: DataFrame, edges: DataFrame, task: list[str], is_test: DataFrame, seeds_a_term: int = 1, max_depth: int = 3) -> DataFrame:
    """node, hop, score: what a task's words are about. tokens: node, token. Terms weigh by inverse document frequency, tests
    count half; from the best seed of each term the neighbourhood is walked in both directions."""
    total = tokens.select("node").distinct().agg(F.count("*").alias("total"))
    wanted = tokens.filter(F.col("token").isin(task)).distinct()
    weight = wanted.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(total)).select("token", F.log(1 + F.col("total") / F.col("df")).alias("idf"))
    scored = wanted.join(weight, "token").join(is_test.select("node", F.lit(True).alias("test")).distinct(), "node", "left")
    value = F.col("idf") * F.when(F.col("test"), 0.5).otherwise(1.0)
    sums = scored.withColumn("value", value).withColumn("score", F.sum("value").over(Window.partitionBy("node")))
    order = Window.partitionBy("token").orderBy(F.desc("score"), "node")
    seeds = sums.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= seeds_a_term).select("node").distinct()
    around = graph.distances(edges.select("a", "b").union(edges.select("b", "a")), seeds, max_depth)
    own = sums.select("node", "score").distinct()
    return around.join(own, "node", "left").select("node", F.col("depth").alias("hop"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


def unresolved(edges: DataFrame, sites: DataFrame, decided: DataFrame) -> DataFrame:
    """site, caller, calls: open sites of the most-called callers first. sites: site, caller."""
    open_ = edges.filter(F.col("tier").startswith("ambiguous_")).select("site").distinct().join(decided.select("site"), "site", "left_anti")
    calls = sites.join(edges.filter("target IS NOT NULL"), "site").groupBy(F.col("target").alias("caller")).agg(F.count("*").alias("calls"))
    return open_.join(sites, "site").join(calls, "caller", "left").select("site", "caller", F.coalesce("calls", F.lit(0)).alias("calls")).orderBy(F.desc("calls"), "caller", "site")


def pages(rows: DataFrame, section: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """rows with page: a section's rows in order on pages of a fixed budget."""
    upto = Window.partitionBy(section).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("page", F.floor((F.sum(cost).over(upto) - F.col(cost)) / budget))


def spawned(tests: DataFrame, scripts: DataFrame) -> DataFrame:
    """test, script: a script that a test's text names by path or as a module after -m. tests: test, text; scripts: script."""
    named = tests.select("test", F.explode(F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(r"([\w./-]+\.(?:py|sh|js|ts))"), 1), F.transform(F.regexp_extract_all("text", F.lit(r"-m['\", ]+([\w.]+)"), 1), lambda m: F.concat(F.replace(m, F.lit("."), F.lit("/")), F.lit(".py")))))).alias("name"))
    tail = lambda c: F.substring_index(c, "/", -1)
    return named.withColumn("t", tail(F.col("name"))).join(scripts.withColumn("t", tail(F.col("script"))), "t").filter(F.col("script").endswith(F.col("name"))).select("test", "script").distinct()


def merged_traces(edges: DataFrame, observed: DataFrame) -> DataFrame:
    """a, b, tier, seen of edges and a runtime trace (a, b): a trace adds edges and confirms them, it never removes one."""
    flagged = edges.join(observed.select("a", "b").distinct().withColumn("seen", F.lit(True)), ["a", "b"], "left").select("a", "b", "tier", F.coalesce("seen", F.lit(False)).alias("seen"))
    new = observed.select("a", "b").distinct().join(edges.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", F.lit("known_edge").alias("tier"), F.lit(True).alias("seen"))
    return flagged.union(new)


def edges_between(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int = 40) -> DataFrame:
    """a, b: edges of all routes from a source to a target."""
    known = graph.steps(edges)
    inside = graph.inside(known, sources, targets, max_depth).select("node")
    return known.join(inside.select(F.col("node").alias("a")), "a", "left_semi").join(inside.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b").distinct()


def counts(edges: DataFrame) -> DataFrame:
    """One row about edges (site, target, tier): sites, those with a target in the project, at its boundary, asserted, and open ones."""
    sites = lambda c: F.countDistinct(F.when(c, F.col("site")))
    boundary = F.col("tier").startswith("boundary")
    return edges.agg(F.countDistinct("site").alias("sites"), sites(F.col("target").isNotNull() & ~boundary).alias("resolved"), sites(boundary).alias("boundary"), sites(F.col("tier") == "asserted").alias("asserted"), sites(F.col("tier").startswith("ambiguous_")).alias("open"))


def verified(answer: DataFrame, edges: DataFrame) -> DataFrame:
    """The answer's rows (a, b, …) with held: whether the graph has the edge."""
    return answer.join(edges.select("a", "b").distinct().withColumn("held", F.lit(True)), ["a", "b"], "left").withColumn("held", F.coalesce("held", F.lit(False)))


def current_links(asserted: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Asserted edges (a, b, file, line, text) whose line still reads as it did, and those that have to be looked at again. lines: file, line, text."""
    now = lines.select("file", "line", F.trim("text").alias("now"))
    met = asserted.join(now, ["file", "line"], "left").withColumn("same", F.coalesce(F.col("now") == F.trim("text"), F.lit(False)))
    return met.filter("same").select(*asserted.columns), met.filter(~F.col("same")).select(*asserted.columns)


def beneath(tests: DataFrame, setups: DataFrame) -> DataFrame:
    """test, setup: tests (test) in the folder, or below it, of a set-up file (setup). Joined on the folder, of which a path has a few."""
    from graphloom.functions.text import prefixes

    folder = lambda c: F.when(F.col(c).contains("/"), F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.lit(""))
    above = tests.select("test", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), prefixes(folder("test"), "/")))).alias("folder"))
    return above.join(setups.select("setup", folder("setup").alias("folder")), "folder").select("test", "setup")


def commands(changed: DataFrame, runners: DataFrame) -> DataFrame:
    """path, command of changed files (path) by the longest folder that a runner has (folder, command, with {} for the path)."""
    from graphloom.functions.text import prefixes

    each = changed.select("path", F.explode(prefixes(F.col("path"), "/")).alias("folder"))
    best = each.join(runners, "folder").groupBy("path").agg(F.max_by("command", F.length("folder")).alias("command"))
    return best.select("path", F.replace("command", F.lit("{}"), F.col("path")).alias("command"))


def over_languages(graphs: dict[str, DataFrame], main: str) -> DataFrame:
    """One answer a language as one table with lang and main (whether it is the project's first language)."""
    out = None
    for lang in sorted(graphs, key=lambda k: (k != main, k)):
        part = graphs[lang].withColumn("lang", F.lit(lang)).withColumn("main", F.lit(lang == main))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def used_packages(imports: DataFrame, installed: DataFrame) -> DataFrame:
    """package: installed packages (package, module) of which something is imported (name, dotted)."""
    return installed.join(imports.select(F.substring_index("name", ".", 1).alias("module")).distinct(), "module", "left_semi").select("package").distinct()


def what_if(edges: DataFrame, added: DataFrame, sources: DataFrame, max_depth: int = 40) -> DataFrame:
    """node, depth: what the sources reach with further edges and not without them."""
    known, more = graph.steps(edges), graph.steps(added)
    before = graph.walk(known, sources, max_depth)
    both, seen, found = known.union(more), before.select("node", "depth"), None
    fresh, over = before, more  # at first, only the further edges lead on from what is reached
    while True:
        made = fresh.join(over, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg((F.min("depth") + 1).alias("depth")).filter(F.col("depth") <= max_depth)
        old = seen.select(F.col("node").alias("n"), F.col("depth").alias("d"))
        # what is new, and what the further edges bring nearer: a new node may be reached through it
        fresh, over = cut(made.join(old, (F.col("node") == F.col("n")) & (F.col("d") <= F.col("depth")), "left_anti"), "what-if"), both
        found = fresh if found is None else found.union(fresh)
        if fresh.isEmpty():
            break
        seen = seen.union(fresh)
    return found.groupBy("node").agg(F.min("depth").alias("depth")).join(before.select("node"), "node", "left_anti")
