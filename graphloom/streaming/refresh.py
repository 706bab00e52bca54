"""Incremental refresh: each micro-batch of facts is merged into a table and its derived graph solved anew, then swapped in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions, in order: a version counts once its marker file is there."""
    fs, at, _ = _files(spark, root)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[4:]) for n in names if n.startswith("done") and n[4:].isdigit())


def publish(df: DataFrame, root: str, version: int) -> None:
    """Write a version, then its marker; nothing is deleted or renamed, so there is no moment without a complete one.

    Readers keep the version that they opened. A version that is complete is never written again."""
    if version in versions(df.sparkSession, root):
        return
    df.write.mode("overwrite").parquet(f"{root}/v{version}")
    fs, _, jvm = _files(df.sparkSession, root)
    fs.create(jvm.org.apache.hadoop.fs.Path(f"{root}/done{version}"), True).close()


def current(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The latest complete version; with before, the latest below that number."""
    found = [v for v in versions(spark, root) if before is None or v < before]
    return spark.read.parquet(f"{root}/v{found[-1]}") if found else None


def drop_old(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete all but the latest versions, markers first."""
    fs, _, jvm = _files(spark, root)
    for v in versions(spark, root)[:-keep]:
        for name in (f"done{v}", f"v{v}"):
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/{name}"), True)


def refresh(stream: DataFrame, facts_root: str, graph_root: str, solve: Callable[[DataFrame], DataFrame], keys: list[str], checkpoint: str) -> StreamingQuery:
    """Start a query that keeps a graph in step with a stream of facts. One batch is solved at a time."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        old = current(spark, facts_root, number)  # a batch that comes again starts from where it did
        merged = rows.dropDuplicates(keys) if old is None else old.join(rows, keys, "left_anti").unionByName(rows.dropDuplicates(keys))
        publish(merged, facts_root, number)
        publish(solve(current(spark, facts_root, number + 1)), graph_root, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
