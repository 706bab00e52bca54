"""What the operators of this subpackage share: staged tables in the cluster's shared folder, and small Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only on one machine (tests), where it may be unset, an own one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (spark.conf.get("spark.master", "local") + "[").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return _own[app]


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and return the table read again.

    Cuts lineage so that a lost executor costs a re-read and not a re-computation, and fixes what is not
    deterministic (partition numbers) once for all later readers."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def give_back(spark: SparkSession) -> None:
    """Have the executors collect their garbage, so that their heaps shrink to what lives and the machine has the rest again.

    G1 lets a heap grow to its bound with garbage that steps leave behind and keeps it; Python workers need the room. As
    many small tasks as there are cores go out, and the scheduler deals them over all executors."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def forget_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of queries that are over: it does so when the driver collects its garbage, which else
    may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of an Arrow batch between Spark and Python, where the session has Spark's default (64 MB): bounds what both sides hold of long texts.
BATCH_BYTES = 8 << 20
BATCH_SETTING, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


_kept: list = []


def between_tasks(forget) -> None:
    """Have a worker call forget before each task that isn't run with keeps=True: frees what other tasks keep between them."""
    _kept.append(forget)


def _trimmed(run, keeps, batches):
    """run(batches); at the end a worker, which Spark keeps for other tasks, gives its free memory back."""
    if not keeps:
        for forget in _kept:
            forget()
    yield from run(batches)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not a C library with this call
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run, schema, keeps: bool = False) -> DataFrame:
    """df.mapInArrow in batches of bounded size, by workers that don't keep the memory of their largest task.

    keeps: what tasks of this kind keep between them (a table of token ids) stays in the worker."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(functools.partial(_trimmed, run, keeps), schema)


def slices(batches, rows: int = 1000):
    """Arrow batches cut to at most so many rows each: bounds the memory of vectorised work on texts."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            part = batch.slice(at, rows)
            if part.num_rows:
                yield part


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    found = batch.column(batch.schema.get_field_index(name))
    return found.cast(pa.string()) if pa.types.is_large_string(found.type) or pa.types.is_string_view(found.type) else found


def slices_by_bytes(batches, name: str, most: int = 8 << 20):
    """Arrow batches cut so that the texts of a part hold about so many bytes (one longer text is a part of its own)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(column(batch, name)), 0)).astype(np.int64)
        ends, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


#: Slots of the filter below; the table that goes to all tasks has at most SLOTS / 64 rows of 16 bytes.
SLOTS = 1 << 23


def unused(name: str, names: list[str]) -> str:
    """A column name that none of names is, upper and lower case alike."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def parted(rows: DataFrame, key: Column, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows in two: those whose key the one column of named may hold, and those whose key it surely doesn't.

    Only the first need a join, and so a shuffle, of wide rows. Keys are hashed to SLOTS bits; the table of the bits is
    bounded by that, whatever the input. More keys only mean more rows that may be named; a join must follow."""
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(SLOTS))
    bit = lambda s: F.expr(f"shiftleft(1L, cast({s} % 64 AS int))")
    own = named.select(slot(F.col(named.columns[0])).alias("slot")).select(F.floor(F.col("slot") / 64).alias("word"), bit("slot").alias("bit"))
    at, word, bits = (unused(n, rows.columns) for n in ("slot_of", "slot_word", "slot_bits"))
    table = staged(own.groupBy(F.col("word").alias(word)).agg(F.bit_or("bit").alias(bits)), "filter")
    marked = rows.withColumn(at, slot(key)).join(F.broadcast(table), F.floor(F.col(at) / 64) == F.col(word), "left")
    hit = F.coalesce(F.col(bits).bitwiseAND(bit(f"`{at}`")), F.lit(0)) != 0
    return marked.filter(hit).select(*rows.columns), marked.filter(~hit).select(*rows.columns)
