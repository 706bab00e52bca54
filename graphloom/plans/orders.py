"""The tables of orders as a typed graph: supplier -> part -> order -> customer -> nation -> region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.tables import table


def node(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """a, b: edges as the tables have them. Lines repeat pairs; who asks for edges takes each once, walks don't need to."""
    line, orders, customer, nation = (table(spark, folder, t) for t in ("lineitem", "orders", "customer", "nation"))
    return (
        line.select(node("S", "l_suppkey").alias("a"), node("P", "l_partkey").alias("b"))
        .union(line.select(node("P", "l_partkey"), node("O", "l_orderkey")))
        .union(orders.select(node("O", "o_orderkey"), node("C", "o_custkey")))
        .union(customer.select(node("C", "c_custkey"), node("N", "c_nationkey")))
        .union(nation.select(node("N", "n_nationkey"), node("R", "n_regionkey")))
    )


def start(spark: SparkSession, *names: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(n,) for n in names], "node string"))


EDGES_SQL = """edges AS (SELECT DISTINCT 'S:' || l_suppkey AS a, 'P:' || l_partkey AS b FROM lineitem
    UNION ALL SELECT DISTINCT 'P:' || l_partkey, 'O:' || l_orderkey FROM lineitem
    UNION ALL SELECT 'O:' || o_orderkey, 'C:' || o_custkey FROM orders
    UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey FROM customer
    UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation)"""


def reach_sql(source: str, backwards: bool = False, name: str = "reach") -> str:
    a, b = ("b", "a") if backwards else ("a", "b")
    return f"{name}_all AS (SELECT '{source}' AS node, 0 AS depth UNION SELECT e.{b}, r.depth + 1 FROM {name}_all r JOIN edges e ON e.{a} = r.node WHERE r.depth < 40), {name} AS (SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM {name}_all GROUP BY node)"
