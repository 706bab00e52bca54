"""Writers of a graph: core tables by schema, extension tables, a catalogue of what was seen, exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.schemas import CORE, absent_to_null, require

#: Key columns of the core tables: of rows that agree on them the first in the order of all columns stays.
KEYS = {"methods": ["id"], "types": ["id"], "fields": ["id"], "call_sites": ["id"], "run": ["key"]}


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of a core table, by name and cast; absent values are null; rows are distinct and unique by key."""
    fields = [f.strip().split(" ") for f in CORE[name].split(",")]
    require(df, *[n for n, _ in fields])
    shaped = df.select(*[absent_to_null(F.col(n).cast("string")).try_cast(t).alias(n) for n, t in fields]).distinct()
    keys = KEYS.get(name)
    if not keys:
        return shaped
    order = Window.partitionBy(*keys).orderBy(*[F.col(n).asc_nulls_last() for n, _ in fields])
    return shaped.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def write_graph(tables: Mapping[str, DataFrame], root: str, extra: Mapping[str, DataFrame] | None = None) -> None:
    """Core tables under root/<name>, sorted inside files by their first column so that scans can skip; others under root/ext_<name>."""
    for name, df in tables.items():
        shaped = conform(df, name)
        shaped.sortWithinPartitions(shaped.columns[0]).write.mode("overwrite").parquet(f"{root}/{name}")
    for name, df in (extra or {}).items():
        df.select(*[F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate(df.columns)]).distinct().write.mode("overwrite").parquet(f"{root}/ext_{name}")


def write_tsv(tables: Mapping[str, DataFrame], root: str) -> None:
    """Core tables as headered, tab-separated text under root/<name>, rows in order inside files; absent values are empty."""
    for name, df in tables.items():
        shaped = conform(df, name)
        shaped.sortWithinPartitions(*shaped.columns).write.mode("overwrite").option("emptyValue", "").option("nullValue", "").csv(f"{root}/{name}", sep="\t", header=True)


def short_uids(df: DataFrame, column: str, prefix: int = 0, digits: int = 16) -> DataFrame:
    """df with ids cut to their prefix and so many hexadecimal digits (64 bits); ids that would be one are kept whole."""
    cut = F.substring(column, 1, prefix + digits)
    clash = df.groupBy(cut.alias("short")).agg(F.min(column).alias("low"), F.max(column).alias("high")).filter("low <> high").select("short")
    return df.join(clash, cut == F.col("short"), "left").withColumn(column, F.when(F.col("short").isNull(), cut).otherwise(F.col(column))).drop("short")


def read_graph(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(CORE[name]).parquet(f"{root}/{name}")


def vocabulary(df: DataFrame, columns: Sequence[str], documented: Mapping[str, Sequence[str]]) -> DataFrame:
    """field, value, n, documented: the values of enumerated columns, and whether anyone has described them."""
    stack = ", ".join(f"'{c}', cast(`{c}` AS string)" for c in columns)
    seen = df.selectExpr(f"stack({len(columns)}, {stack}) AS (field, value)").filter("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n"))
    known = [(c, v) for c, values in documented.items() for v in values]
    listed = df.sparkSession.createDataFrame(known, "field string, value string").withColumn("documented", F.lit(True))
    return seen.join(F.broadcast(listed), ["field", "value"], "left").withColumn("documented", F.coalesce("documented", F.lit(False)))


def wanted_library_rows(library: DataFrame, *references: DataFrame) -> DataFrame:
    """Rows of library entities (id) that something refers to (one column each)."""
    every = references[0].toDF("id")
    for r in references[1:]:
        every = every.union(r.toDF("id"))
    return library.join(every.distinct(), "id", "left_semi")


def external_entities(targets: DataFrame, known: DataFrame) -> DataFrame:
    """id, name, owner of targets (target) that no known entity (id) is: made up from their dotted name."""
    alone = targets.filter("target IS NOT NULL").select("target").distinct().join(known.select(F.col("id").alias("target")), "target", "left_anti")
    return alone.select(F.concat(F.lit("external:"), "target").alias("id"), F.substring_index("target", ".", -1).alias("name"), F.when(F.col("target").contains("."), F.regexp_replace("target", r"\.[^.]*$", "")).alias("owner"))


def distinct_labels(df: DataFrame, label: str, key: str) -> DataFrame:
    """label with #2, #3 … where several keys have one."""
    order = Window.partitionBy(label).orderBy(key)
    return df.withColumn("__n", F.row_number().over(order)).withColumn(label, F.when(F.col("__n") > 1, F.concat(label, F.lit("#"), F.col("__n").cast("string"))).otherwise(F.col(label))).drop("__n")


def adjacency_json(edges: DataFrame) -> DataFrame:
    """node, edges: one JSON document a node, for graph pages. Grouped by source node."""
    return edges.groupBy(F.col("a").alias("node")).agg(F.to_json(F.array_sort(F.collect_set(F.struct("b", "tier")))).alias("edges"))
