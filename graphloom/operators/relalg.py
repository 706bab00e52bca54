"""The relational algebra of the rules: set semantics, negation, counting with zero, division, nearest, ranges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def distinct_union(*parts: DataFrame) -> DataFrame:
    """Several clauses with one head."""
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def semi(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other, list(on), "left_semi")


def anti(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Stratified negation."""
    return df.join(other, list(on), "left_anti")


def facts(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A literal fact table, of the size of a program text: broadcast."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def count_with_zero(outer: DataFrame, inner: DataFrame, on: Sequence[str], name: str = "n", of: Column | None = None) -> DataFrame:
    """Rows of outer with the number of matches in inner, 0 included. Counts before it joins."""
    counted = inner.groupBy(*on).agg((F.countDistinct(of) if of is not None else F.count("*")).alias(name))
    return outer.join(counted, list(on), "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("long"))


def division(pairs: DataFrame, item: str, value: str, required: DataFrame) -> DataFrame:
    """Items whose values cover all required ones (a column of the same name)."""
    needed = required.select(value).distinct()
    covered = pairs.select(item, value).distinct().join(needed, value, "left_semi").groupBy(item).agg(F.count("*").alias("covered"))
    total = needed.agg(F.count("*").alias("needed"))  # one row
    return covered.join(F.broadcast(total), F.col("covered") == F.col("needed")).select(item)


def nearest(df: DataFrame, keys: Sequence[str], distance: Column, *ties: Column) -> DataFrame:
    """The row of least distance for each key; ties are broken by the given columns, which make the pick unique."""
    order = Window.partitionBy(*keys).orderBy(distance.asc(), *ties)
    return df.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def range_join(points: DataFrame, spans: DataFrame, key: Sequence[str], at: str, low: str, high: str, width: int) -> DataFrame:
    """Points inside spans (ends included) of one key. Both sides are cut into bins of width, so the join has an equality on
    (key, bin) even where a key is weak; a span goes to every bin it touches."""
    binned = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("__bin", F.floor(F.col(at) / width)).join(binned, [*key, "__bin"]).filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("__bin")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, carried: Sequence[str]) -> DataFrame:
    """left rows with the carried columns of the last right row strictly before them: one sort by key and time, no join.

    right must have the keys, time and carried columns; of right rows at one time the greatest carried values win."""
    last = F.max(F.when(F.col("__right"), F.struct(F.col(time), *carried)))
    both = left.withColumn("__right", F.lit(False)).unionByName(right.select(*keys, time, *carried).withColumn("__right", F.lit(True)), allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    if dict(left.dtypes)[time].startswith("timestamp"):
        both = both.withColumn("__at", F.unix_micros(F.col(time).cast("timestamp")))
        before = Window.partitionBy(*keys).orderBy("__at").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("__last", last.over(before)).filter(~F.col("__right"))
    return found.select(*left.columns, *[F.col(f"__last.{c}").alias(f"prior_{c}") for c in (time, *carried)])


def generate(df: DataFrame, low: Column, high: Column, name: str) -> DataFrame:
    """range(low, high): a row for each integer, high excluded."""
    return df.filter(low < high).withColumn(name, F.explode(F.sequence(low, high - 1)))


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of duplicates by key the first in a total order stays."""
    return nearest(df, keys, order[0], *order[1:])


def fill(df: DataFrame, column: str, *fallbacks: Column) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), *fallbacks))
