"""Mixing sources to target weights by hash-threshold histograms.

Each document has a 60-bit hash of its id. Word counts are summed by source and hash bucket; a cumulative sum over the
buckets of one level finds the bucket in which a source's budget ends, and only that bucket is split again on the next
level. After the last level a bucket is one hash value, so the mix is a filter ``hash < threshold``: nothing is sorted by
document, a larger budget contains a smaller one, and reruns agree.

Nulls: a null text has size 0; null sources form one source, ordered last; null ids hash alike and share a tie evenly.
Ties and repeated rows at the boundary hash share what is left in proportion to their size. Empty tables give no rows.
Texts of any length are counted whole. mix reads doc_id, source and text alone; mixed_documents passes columns of any name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import staged, unused

WEIGHTS = (5, 2, 1)
LEVELS, BITS = 6, 10
#: Up to so many sources their table (some 100 bytes each) is sent to every task; beyond, it is joined by shuffle.
MANY_SOURCES = 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash60(doc_id: Column) -> Column:
    """15 hexadecimal digits of md5, which other SQL engines have as well."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target of a table (source, size).

    Targets are proportional to the weights up to a water level: sources in order of cap/weight fill up one after the
    other, and the first level that stays below its source's cap/weight holds for all later ones."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row for each source, not for each document
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by = by.withColumn("ratio", F.lit(float(most)) * F.col("source_size") / F.col("w"))
    by = by.withColumn("place", F.row_number().over(fill)).withColumns({"capped": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "weight_left": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)), "total": F.sum("source_size").over(every)})
    by = by.withColumn("level", (F.lit(float(share)) * F.col("total") - F.lit(float(most)) * F.col("capped")) / F.col("weight_left"))
    by = by.withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(every)["level"])
    cap = F.lit(float(most)) * F.col("source_size")
    return by.select("source", "source_size", F.when(F.col("water").isNull(), cap).otherwise(F.least(cap, F.col("w") * F.col("water"))).alias("target"))


def _budgets(targets: DataFrame) -> DataFrame:
    """copies: whole copies of all documents; want: words of the further copy."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return targets.withColumn("copies", copies).withColumn("want", F.col("target") - F.col("copies") * F.col("source_size"))


def thresholds(rows: DataFrame, targets: DataFrame, name: str = "mix") -> DataFrame:
    """For each source: the hash value at which the budget ends, the words wanted from it and the words that have it.

    rows: source, size, h. Each level reads only rows of the boundary bucket of the level before."""
    budgets = _budgets(targets)
    small = targets.count() <= MANY_SOURCES
    spread = F.broadcast if small else (lambda x: x)
    state = budgets.select("source", "source_size", "target", "copies", "want", F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        bucket = F.shiftright("h", shift)
        edge = spread(state.select(F.col("source").alias("s"), "prefix"))
        inside = rows.join(edge, rows["source"].eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BITS) == F.col("prefix")), "left_semi") if level else rows
        histogram = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        summed = histogram.withColumn("cum", F.sum("words").over(up_to))
        old = spread(state.withColumnRenamed("source", "s"))
        joined = summed.join(old, summed["source"].eqNullSafe(F.col("s")))
        # the first bucket that reaches the budget
        reached = joined.filter((F.col("cum") >= F.col("want")) & (F.col("words") > 0)).groupBy("source").agg(F.min_by(F.struct("bucket", "cum", "words", "source_size", "target", "copies", "want"), "bucket").alias("b"))
        state = reached.select("source", "b.source_size", "b.target", "b.copies", (F.col("b.want") - (F.col("b.cum") - F.col("b.words"))).alias("want"), F.col("b.bucket").alias("prefix"), F.col("b.words").alias("tied"))
        state = staged(state, f"{name}-level{level}")
    return state


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0, cut: bool = True) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each document.

    taken counts words: whole copies, and at the boundary hash the words that are left of the budget. With cut=False the
    documents at the boundary are taken whole or not at all, whichever is nearer."""
    rows = staged(docs.select("doc_id", "source", words(F.col("text")).alias("size"), hash60(F.col("doc_id")).alias("h")), "mix-sizes")
    targets = staged(source_targets(rows.select("source", "size"), weights, share, most), "mix-targets")
    edges = thresholds(rows, targets)
    known = _budgets(targets).select(F.col("source").alias("s"), "source_size", "target", "copies")
    edges = edges.select(F.col("source").alias("e"), F.col("prefix").alias("edge"), "want", "tied")
    small = targets.count() <= MANY_SOURCES
    spread = F.broadcast if small else (lambda x: x)
    bounds = spread(known.join(edges, F.col("s").eqNullSafe(F.col("e")), "left").drop("e"))
    part = F.floor(F.col("size") * F.col("want") / F.col("tied")).cast("long") if cut else F.when(F.col("want") * 2 >= F.col("tied"), F.col("size")).otherwise(F.lit(0).cast("long"))
    more = F.when(F.col("edge").isNull() | (F.col("h") > F.col("edge")), F.lit(0).cast("long")).when(F.col("h") < F.col("edge"), F.col("size")).otherwise(part)
    return rows.join(bounds, rows["source"].eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size") + more).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The documents of the mix, whole, each as often as it is taken; the columns of docs."""
    kept = docs.columns
    size, h = words(F.col("text")), hash60(F.col("doc_id"))
    rows = staged(docs.select("source", size.alias("size"), h.alias("h")), "mix-sizes")
    targets = staged(source_targets(rows.select("source", "size"), weights, share, most), "mix-targets")
    edges = thresholds(rows, targets)
    edges = edges.select(F.col("source").alias("e"), F.col("prefix").alias("edge"), "want", "tied")
    s, copies, edge, near, n = (unused(x, kept) for x in ("of_source", "copies", "edge", "near", "copy"))
    known = _budgets(targets).select(F.col("source").alias(s), F.col("copies").alias(copies))
    small = targets.count() <= MANY_SOURCES
    spread = F.broadcast if small else (lambda x: x)
    bounds = spread(known.join(edges, F.col(s).eqNullSafe(F.col("e")), "left").select(s, copies, F.col("edge").alias(edge), (F.col("want") * 2 >= F.col("tied")).alias(near)))
    more = F.when(F.col(edge).isNull() | (h > F.col(edge)), 0).when((h < F.col(edge)) | F.col(near), 1).otherwise(0)
    times = docs.join(bounds, docs["source"].eqNullSafe(F.col(s)))
    return times.withColumn(n, F.explode(F.array_repeat(F.lit(1), (F.col(copies) + more).cast("int")))).select(*[F.col(f"`{c}`") for c in kept])


def oracle(table: str = "documents") -> str:
    """DuckDB: the same mix by sorting each source by hash."""
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM {table}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size / w AS ratio FROM w),
c AS (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS place, coalesce(sum(source_size) OVER f, 0)::DOUBLE AS capped, (sum(w) OVER () - coalesce(sum(w) OVER f, 0))::DOUBLE AS weight_left, (sum(source_size) OVER ())::DOUBLE AS total
    FROM r WINDOW f AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (1.5::DOUBLE * total - 2.0::DOUBLE * capped) / weight_left AS level FROM c),
m AS (SELECT *, (SELECT arg_min(level, place) FROM l WHERE level <= ratio) AS water FROM l),
t AS (SELECT source, source_size, CASE WHEN water IS NULL THEN 2.0::DOUBLE * source_size ELSE least(2.0::DOUBLE * source_size, w * water) END AS target FROM m),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
j AS (SELECT d.doc_id, d.size, d.h, b.source_size, b.target, b.copies, b.target - b.copies * b.source_size AS want,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
    sum(d.size) OVER (PARTITION BY d.source, d.h) AS tied FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(copies * size + CASE WHEN tied = 0 OR cum - tied >= want THEN 0 WHEN cum < want THEN size
    ELSE floor(size * (want - (cum - tied)) / tied) END AS BIGINT) AS taken FROM j"""
