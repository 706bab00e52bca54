"""Value flow: which values a variable, parameter, result or property may hold, as a joint fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.fixpoint import mutual_fixpoint
from graphloom.operators.staging import cut


def assignments(calls: DataFrame, arguments: DataFrame, parameters: DataFrame, returns: DataFrame, results: DataFrame, cap: int | None = None) -> DataFrame:
    """target, source: what calls (site, callee) hand over. arguments: site, place, name; parameters: callee, place, name;
    returns: callee, name; results: site, name. With cap, a callable with more call sites hands nothing to its parameters."""
    pairs = calls.select("site", "callee").distinct()
    narrow = pairs
    if cap is not None:
        wide = pairs.groupBy("callee").count().filter(F.col("count") > cap).select("callee")
        narrow = pairs.join(wide, "callee", "left_anti")
    into = narrow.join(arguments.withColumnRenamed("name", "source"), "site").join(parameters.withColumnRenamed("name", "target"), ["callee", "place"]).select("target", "source")
    out = pairs.join(returns.withColumnRenamed("name", "source"), "callee").join(results.withColumnRenamed("name", "target"), "site").select("target", "source")
    return into.union(out).distinct()


def values(created: DataFrame, assigned: DataFrame, stored: DataFrame, loaded: DataFrame) -> dict[str, DataFrame]:
    """holds (name, value) and inside (owner, property, value), the least that hold together.

    created: name, value. assigned: target, source. stored: base, property, source (base.property = source).
    loaded: target, base, property (target = base.property). Literal dictionary keys are properties."""
    assigned, stored, loaded = (cut(x.distinct(), "flow") for x in (assigned, stored, loaded))
    owner = lambda df: df.select(F.col("name").alias("base"), F.col("value").alias("owner"))
    source = lambda df: df.select(F.col("name").alias("source"), "value")

    def holds(total, fresh):
        moved = fresh["holds"].join(assigned, F.col("name") == F.col("source")).select(F.col("target").alias("name"), "value")
        reads = lambda held, inside: owner(held).join(loaded, "base").join(inside, ["owner", "property"]).select(F.col("target").alias("name"), "value")
        return moved.union(reads(fresh["holds"], total["inside"])).union(reads(total["holds"], fresh["inside"]))

    def inside(total, fresh):
        writes = lambda bases, sources: owner(bases).join(stored, "base").join(source(sources), "source").select("owner", "property", "value")
        return writes(fresh["holds"], total["holds"]).union(writes(total["holds"], fresh["holds"]))

    seed = created.select("name", "value")
    kind = seed.schema["value"].dataType
    nothing = seed.limit(0).select(F.col("value").alias("owner"), F.lit("").alias("property"), F.col("value").cast(kind).alias("value"))
    return mutual_fixpoint({"holds": seed, "inside": nothing}, {"holds": holds, "inside": inside})
