"""From sites and targets to edges with a confidence tier; every site keeps at least one edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiered_edges(sites: DataFrame, targets: DataFrame, cap: int | None = None) -> DataFrame:
    """site, target, tier. sites: site; targets: site, target, provenance (client, lib). A capped fan gives one row without target."""
    pairs = targets.select("site", "target", "provenance").distinct()
    fans = pairs.groupBy("site").agg(F.count("*").alias("n"))
    tier = F.when(F.col("provenance") == "lib", "boundary_lib").when(F.col("n") == 1, "known_edge").otherwise("multi_inferred")
    wide = F.col("n") > cap if cap else F.lit(False)
    known = sites.select("site").distinct().join(fans, "site")
    narrow = known.filter(~wide).join(pairs, "site").select("site", "target", tier.alias("tier"))
    capped = known.filter(wide).select("site", F.lit(None).cast(pairs.schema["target"].dataType).alias("target"), F.lit("fan_capped").alias("tier"))
    made = narrow.union(capped)
    return conserved(sites, made)


def conserved(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """edges and a row for each site that has none: keyed on the absence of an edge, not on a reason for it."""
    open_ = sites.select("site").distinct().join(edges, "site", "left_anti")
    return edges.unionByName(open_.select("site", F.lit(None).cast(edges.schema["target"].dataType).alias("target"), F.lit("ambiguous_unknown").alias("tier")))


def unresolved(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("tier").startswith("ambiguous_")).select("site").distinct()


def refused_or_lost(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """Sites without an edge: must be empty."""
    return sites.select("site").distinct().join(edges, "site", "left_anti")
