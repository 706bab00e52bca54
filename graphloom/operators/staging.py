"""Tables that cut the lineage of loops, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; an own folder only where that is unset and all runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (spark.conf.get("spark.master", "local") + "[").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return _own[app]


def dealt(df: DataFrame, key: str, name: str) -> DataFrame:
    """As cut(), in buckets by a column: a join on it takes them as they are, and only the other side is dealt to them."""
    spark, own = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/loops/{own}").saveAsTable(own)
    return spark.table(own)


def cut(df: DataFrame, name: str = "round") -> DataFrame:
    """Write df and read it again: a later round, or a retry after a lost executor, starts from the files."""
    path = f"{shared_dir(df.sparkSession)}/loops/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
