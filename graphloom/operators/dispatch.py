"""Which targets a call may have: overrides, constructed subtypes, exact receivers, stored callables, listeners, registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import graph, hierarchy
from graphloom.operators.fixpoint import fixpoint


def nearest_overrides(members: DataFrame, parents: DataFrame) -> DataFrame:
    """owner, name, arity, base_owner: the nearest declaration that each method overrides; farther ones follow through it."""
    base = members.select(F.col("owner").alias("ancestor"), "name", "arity")
    found = hierarchy.ancestors(parents).join(members.select(F.col("owner").alias("type"), "name", "arity"), "type").join(base, ["ancestor", "name", "arity"])
    near = Window.partitionBy("type", "name", "arity").orderBy("depth")
    return found.withColumn("r", F.rank().over(near)).filter("r = 1").select(F.col("type").alias("owner"), "name", "arity", F.col("ancestor").alias("base_owner"))


def without_shadowed(targets: DataFrame, parents: DataFrame) -> DataFrame:
    """Targets (site, owner, signature) but those that a target of one site with the same signature, in a subtype of the owner, hides."""
    below = hierarchy.ancestors(parents).select(F.col("type").alias("lower"), F.col("ancestor").alias("owner"))
    nearer = targets.select("site", "signature", F.col("owner").alias("lower")).join(below, "lower").select("site", "owner", "signature").distinct()
    return targets.join(nearer, ["site", "owner", "signature"], "left_anti")


def self_dispatch(calls: DataFrame, members: DataFrame, parents: DataFrame, constructed: DataFrame) -> DataFrame:
    """site, target (owner of the method), constructed: what a call (site, receiver, name) may run, in the receiver's type and its subtypes.

    A subtype that nothing constructs stays, with constructed false."""
    below = hierarchy.ancestors(parents).select(F.col("ancestor").alias("receiver"), F.col("type").alias("dynamic"))
    own = calls.select("site", F.col("receiver").alias("dynamic"), "name")
    wide = own.union(calls.join(below, "receiver").select("site", "dynamic", "name")).distinct()
    seen = hierarchy.lookup(members, parents).select(F.col("type").alias("dynamic"), "name", F.col("owner").alias("target"))
    made = constructed.select(F.col("type").alias("dynamic"), F.lit(True).alias("made")).distinct()
    found = wide.join(seen, ["dynamic", "name"]).join(made, "dynamic", "left")
    return found.groupBy("site", "target").agg(F.max(F.coalesce("made", F.lit(False))).alias("constructed"))


def exact_first(fan: DataFrame, exact: DataFrame) -> DataFrame:
    """site, target: where the concrete type of a receiver is known, its targets stand for the whole fan."""
    return exact.select("site", "target").union(fan.join(exact, "site", "left_anti").select("site", "target")).distinct()


def stored_callables(stores: DataFrame, links: DataFrame, invokes: DataFrame) -> DataFrame:
    """site, target, tier of calls through a variable or field. stores: holder, callable; links: holder, source (holder gets
    what source holds); invokes: site, holder. A site without a value keeps a row."""
    moves = links.select(F.col("source").alias("holder"), F.col("holder").alias("into"))
    held = fixpoint(stores.select("holder", "callable"), lambda fresh: fresh.join(moves, "holder").select(F.col("into").alias("holder"), "callable"))
    found = invokes.join(held, "holder", "left").select("site", F.col("callable").alias("target")).distinct()
    n = F.count("target").over(Window.partitionBy("site"))
    return found.select("site", "target", F.when(n == 0, "ambiguous_anon").when(n == 1, "known_edge").otherwise("multi_inferred").alias("tier"))


def listeners(published: DataFrame, handlers: DataFrame, parents: DataFrame) -> DataFrame:
    """site, handler, exact: handlers (handler, type) of a published value's type (site, type), or of one of its ancestors."""
    up = hierarchy.ancestors(parents).select("type", "ancestor")
    wide = published.select("site", "type", F.lit(True).alias("exact")).union(published.join(up, "type").select("site", "ancestor", F.lit(False)))
    return wide.join(handlers, "type").groupBy("site", "handler").agg(F.max("exact").alias("exact"))


def keyed(stores: DataFrame, reads: DataFrame, literals: DataFrame, on: Sequence[str] = ("registry",)) -> DataFrame:
    """site, value: values stored under a key that a site reads from the same registry. A key that is a variable is looked up in
    literals (name, text); what isn't there stands for itself."""
    named = literals.select(F.col("name").alias("key"), "text").distinct()
    plain = lambda df, *names: df.join(named, "key", "left").select(*names, *on, F.coalesce("text", "key").alias("key"))
    return plain(stores, "value").join(plain(reads, "site"), [*on, "key"]).select("site", "value").distinct()


def reasons(sites: DataFrame, rules: Sequence[tuple[str, Column]], otherwise: str = "unknown") -> DataFrame:
    """sites with reason: the first rule that holds says why a site stays open."""
    value = F.lit(otherwise)
    for name, condition in reversed(rules):
        value = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(value)
    return sites.withColumn("reason", value)


def field_access(uses: DataFrame, declared: DataFrame) -> DataFrame:
    """site, field, access, tier. uses: site, owner, name, role (value, target, both); declared: owner, name, field, provenance.

    A use without a declaration keeps a row."""
    access = F.when(F.col("role") == "target", "write").when(F.col("role") == "both", "read_write").otherwise("read")
    found = uses.join(declared, ["owner", "name"], "left")
    n = F.count("field").over(Window.partitionBy("site"))
    tier = F.when(n == 0, "ambiguous_unknown").when(F.col("provenance") == "lib", "boundary_lib").when(n == 1, "known_edge").otherwise("multi_inferred")
    return found.select("site", "field", access.alias("access"), tier.alias("tier"))


def entry_reachable(edges: DataFrame, roots: DataFrame, max_depth: int = 1000) -> DataFrame:
    """node: what the entry points (node) lead to, themselves included."""
    return graph.distances(edges, roots, max_depth, wide=True).select("node")


def affected_by_gaps(sites: DataFrame, gaps: DataFrame) -> DataFrame:
    """site, construct: sites (site, module) in modules of which a part could not be parsed (module, construct)."""
    return sites.join(gaps.select("module", "construct").distinct(), "module").select("site", "construct")


def confirmed(edges: DataFrame, observed: DataFrame, executed: DataFrame) -> DataFrame:
    """a, b, state of edges after a run: confirmed, contradicted (the caller ran and never took it), or not executed."""
    seen = observed.select("a", "b").distinct().withColumn("seen", F.lit(True))
    ran = executed.select(F.col("node").alias("a")).distinct().withColumn("ran", F.lit(True))
    state = F.when(F.col("seen"), "confirmed").when(F.col("ran"), "contradicted").otherwise("not executed")
    return edges.select("a", "b").distinct().join(seen, ["a", "b"], "left").join(ran, "a", "left").select("a", "b", state.alias("state"))
