"""HTTP routes: mount prefixes composed, middleware in order, clients matched with templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.fixpoint import fixpoint


def plain_path(path: Column) -> Column:
    """One slash between segments, one in front, none at the end."""
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/|/$", ""))


def segments(path: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(path, r"[?#].*$", ""), "/"), lambda s: s != "")


def stands_in(segment: Column) -> Column:
    """:id, {id}, <id>, ${…} and * take any text."""
    return segment.rlike(r"^(:.*|\{.*\}|<.*>|\$\{.*\}|\*)$")


def composed(mounts: DataFrame, routes: DataFrame, roots: DataFrame) -> DataFrame:
    """verb, path, handler of routes (router, verb, path, handler) under every chain of mounts (parent, child, prefix) from a root (router).

    A chain doesn't mount a router inside itself, so chains end, however deep they are."""
    hops = mounts.select(F.col("parent").alias("router"), "child", "prefix").distinct()
    seed = roots.select("router", F.lit("").alias("at"), F.array("router").alias("chain"))
    found = fixpoint(seed, lambda fresh: fresh.join(hops, "router").filter(~F.array_contains("chain", F.col("child"))).select(F.col("child").alias("router"), F.concat("at", F.lit("/"), "prefix").alias("at"), F.array_append("chain", F.col("child")).alias("chain")), ["router", "at", "chain"])
    return found.join(routes, "router").select("verb", plain_path(F.concat("at", F.lit("/"), "path")).alias("path"), "handler").distinct()


def middleware(registered: DataFrame) -> DataFrame:
    """registered (router, handler, line, column, …) with place: the order in which a router's handlers run."""
    return registered.withColumn("place", F.row_number().over(Window.partitionBy("router").orderBy("line", "column", "handler")) - 1)


def matched(clients: DataFrame, routes: DataFrame) -> DataFrame:
    """site, handler, path: routes (verb, path, handler) that a client's request (site, verb, path) fits, those with fewest stand-ins.

    Joined on verb, number of segments and the place and text of one that is no stand-in on either side, of which a fitting
    pair without stand-ins of the client has one for each of the route's; routes of stand-ins only, and clients with one, are
    met by the shape alone."""
    left = clients.select("site", F.upper("verb").alias("verb"), segments(F.col("path")).alias("asked")).withColumn("n", F.size("asked"))
    right = routes.select(F.upper("verb").alias("verb"), "path", "handler", segments(F.col("path")).alias("served")).withColumn("n", F.size("served"))
    fits = F.forall(F.zip_with("asked", "served", lambda a, s: (a == s) | stands_in(a) | stands_in(s)), lambda x: x)
    vague = F.size(F.filter("served", stands_in))
    # a route is found by its first plain segment; a client without stand-ins asks with each of its own
    first = F.array_position(F.transform("served", lambda s: ~stands_in(s)), True)
    right = right.withColumn("at", first.cast("int")).withColumn("word", F.when(F.col("at") > 0, F.element_at("served", F.greatest("at", F.lit(1)))).otherwise(F.lit("")))
    open_ = F.exists("asked", stands_in)
    asks = F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("word"))), F.transform("asked", lambda s, i: F.struct((i + 1).cast("int").alias("at"), s.alias("word"))))
    plain = left.filter(~open_).select("*", F.explode(asks).alias("by")).select("site", "verb", "asked", "n", "by.at", "by.word")
    met = plain.join(right, ["verb", "n", "at", "word"]).select("site", "asked", "served", "path", "handler")
    met = met.union(left.filter(open_).join(right, ["verb", "n"]).select("site", "asked", "served", "path", "handler")).filter(fits).withColumn("vague", vague)
    best = met.withColumn("r", F.rank().over(Window.partitionBy("site").orderBy("vague")))
    return best.filter("r = 1").select("site", "handler", "path").distinct()


def alone(clients: DataFrame, routes: DataFrame, met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clients that no route serves, and routes that no client asks for."""
    return clients.join(met, "site", "left_anti"), routes.join(met, ["handler", "path"], "left_anti")
