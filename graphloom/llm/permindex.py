"""Approximate nearest neighbours by a permutation index.

Pivots are vectors of the table. A vector is represented by the order in which it sees its nearest pivots (``seen`` of them)
and posted in the inverted files of the ``posted`` nearest. The files are a stored table: one row for each file and block of it,
with ids, vectors and orders. A query asks the files of its nearest pivots, the ``ask`` share of all; in each, rows are ranked
by the footrule distance of their order from the query's, a pivot that the query doesn't ask counting as seen at the place
after the last, and the nearest half is compared exactly, by cosine. Only the best few of a block go on, so no pairs are
written out. A file that very many rows or queries stand in is dealt as blocks of bounded size of either.

Pivots lie far apart, out of a bounded sample (the rows of least hash); everything else covers all rows. Blocks are by hash of
the id, so the result doesn't depend on how rows are dealt. Equal vectors are one entry with the smallest ids that a query can
need. Vectors are compared with those of their own length; a length is an index of its own.

Nulls: null or zero vectors and vectors with null or non-finite parts are neither queries nor candidates, nor are rows
without an id. Very large and very small components are scaled by a power of two first. Ties go to the smaller id; repeated
rows count as often as they are there. An empty table gives no rows. Further columns are not read, whatever their names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import mapped, staged

#: A pivot for so many distinct vectors, and at most so many pivots; rows of the sample that they are chosen from.
ROWS_A_PIVOT, PIVOTS, SAMPLE = 16, 512, 2048
SEEN, POSTED = 12, 3
#: Share of the pivots that a query asks, and the pivots that it asks in any case.
ASK, ASK_LEAST = 0.25, 64
#: Share of a block's rows, by footrule, that are compared exactly, and rows that are compared in any case.
SHARE, AT_LEAST = 0.5, 32
#: Rows and queries of a block.
BLOCK, QUERY_BLOCK = 4096, 4096


def usable(vectors: DataFrame, key: str, value: str) -> DataFrame:
    v = F.col(value)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(key).isNotNull() & v.isNotNull() & fine).select(F.col(key).cast("long").alias("id"), F.transform(v.cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that the largest component is between a half and one: exact, and no square overflows."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=-1, keepdims=True))[1])


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def orders(vectors: np.ndarray, pivots: np.ndarray, seen: int) -> np.ndarray:
    """The nearest pivots of each (unit) vector, nearest first, equal ones in their own order."""
    near = np.round(vectors @ pivots.T, 12)  # the same for a row in any batch
    return np.argsort(-near, axis=1, kind="stable")[:, :seen]


def spread_out(sample: np.ndarray, few: int) -> np.ndarray:
    """So many of the (unit) vectors, each next one the farthest from those before: a dense region takes few of them."""
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(few, len(sample)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


def footrule(wanted: np.ndarray, order: np.ndarray, n_pivots: int) -> np.ndarray:
    """Distance of each row's order from each query's: over the pivots that the row sees, the sum of the differences of places."""
    place = np.full((len(wanted), n_pivots), wanted.shape[1], np.int16)
    np.put_along_axis(place, wanted, np.arange(wanted.shape[1], dtype=np.int16)[None, :], 1)
    out = np.zeros((len(wanted), len(order)), np.int32)
    for j in range(order.shape[1]):
        out += np.abs(place[:, order[:, j]] - np.int16(j))
    return out


def best(queries: np.ndarray, query_ids: np.ndarray, wanted: np.ndarray, raw: np.ndarray, ids: list[list[int]], order: np.ndarray, n_pivots: int, k: int, share: float) -> tuple[list[int], list[int], list[float]]:
    """Query, row id, cosine: the best of one block for each query."""
    few = min(len(raw), max(AT_LEAST, int(np.ceil(share * len(raw)))))
    far = footrule(wanted, order, n_pivots).astype(np.int64) * len(raw) + np.arange(len(raw))  # ties: the smaller id first
    norms = np.sqrt((raw * raw).sum(axis=1))
    out: tuple[list[int], list[int], list[float]] = ([], [], [])
    for q, query_id, f in zip(queries, query_ids.tolist(), far, strict=True):
        found = np.argpartition(f, few - 1)[:few] if few < len(f) else np.arange(len(f))
        # summed row by row: equal vectors get equal scores wherever they stand
        cos = (raw[found] * q).sum(axis=1) / (norms[found] * np.sqrt((q * q).sum()))
        if len(cos) > k + 1:
            edge = np.partition(cos, len(cos) - k - 1)[len(cos) - k - 1]
            found, cos = found[cos >= edge], cos[cos >= edge]
        pairs = sorted((-c, i) for c, r in zip(cos.tolist(), found.tolist(), strict=True) for i in ids[r] if i != query_id)[:k]
        out[0].extend([query_id] * len(pairs))
        out[1].extend(i for _, i in pairs)
        out[2].extend(-c for c, _ in pairs)
    return out


def _ordered(pivots: np.ndarray, seen: int, name: str):
    """Batches of rows with a vector v: with its order as a further column."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = np.asarray(batch.column(batch.schema.get_field_index("v")).flatten()).reshape(batch.num_rows, -1)
                order = orders(unit(v), pivots, seen).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, order.shape[1], dtype=np.int32)), pa.array(order.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return run


def _search(rows: DataFrame, asked: DataFrame, k: int, n_pivots: int, seen: int, posted: int, ask: float, share: float, sample: int) -> DataFrame:
    """rows: ids (the smallest of equal vectors), v; asked: id, v; all of one length. query_id, vec_id, score, with repeats."""
    spark = rows.sparkSession
    n = rows.count()
    chosen = rows.orderBy(F.xxhash64(F.col("ids")[0], F.lit("pivot")), F.col("ids")[0]).limit(sample).collect()  # bounded by the parameter
    pivots = spread_out(unit(np.array([r.v for r in chosen])), min(n_pivots, max(1, -(-n // ROWS_A_PIVOT), ASK_LEAST)))
    see, post = min(seen, len(pivots)), min(posted, len(pivots))
    asks = min(len(pivots), max(ASK_LEAST, int(np.ceil(ask * len(pivots)))))

    # the stored inverted files
    shown = staged(rows.transform(mapped, _ordered(pivots, see, "near"), "ids array<long>, v array<double>, near array<int>"), "vector-orders")
    posts = shown.select(F.explode(F.slice("near", 1, post)).alias("pivot"), "ids", "v", "near")
    sizes = staged(posts.groupBy("pivot").count(), "file-sizes")  # a row for each pivot
    wishes = staged(asked.transform(mapped, _ordered(pivots, asks, "near"), "id long, v array<double>, near array<int>"), "query-orders")
    want = wishes.select(F.explode("near").alias("pivot"), "id", "v", "near")
    loads = want.groupBy("pivot").count()
    dealt = sizes.select(F.col("pivot").alias("p"), F.ceil(F.col("count") / BLOCK).alias("blocks")).join(loads.select(F.col("pivot").alias("l"), F.ceil(F.col("count") / QUERY_BLOCK).alias("parts")), F.col("p") == F.col("l"))
    dealt = F.broadcast(staged(dealt.select("p", "blocks", "parts"), "file-blocks"))  # at most n_pivots rows
    here = F.col("pivot") == F.col("p")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    files = posts.join(dealt, here).withColumn("block", F.pmod(F.xxhash64(F.col("ids")[0], F.lit("block")), F.col("blocks")))
    files = staged(files.groupBy("pivot", "block", "parts").agg(F.sort_array(F.collect_list(F.struct("ids", "v", "near"))).alias("rows")), "inverted-files")  # BLOCK rows or so each
    left = files.select("pivot", "block", every("parts").alias("part"), F.lit(None).cast("long").alias("id"), "rows", F.lit(None).cast("array<double>").alias("v"), F.lit(None).cast("array<int>").alias("near"))
    right = want.join(dealt, here).select("pivot", every("blocks").alias("block"), F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).alias("part"), "id", F.lit(None).cast(files.schema["rows"].dataType).alias("rows"), "v", "near")
    met = left.union(right).repartition("pivot", "block", "part").sortWithinPartitions("pivot", "block", "part", F.col("id").asc_nulls_first())

    def run(batches):
        key, raw, ids, order = None, None, [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)])
            heads = np.asarray(batch.column(3).is_null())
            cuts = sorted({0, *np.flatnonzero(heads).tolist(), *(np.flatnonzero(heads) + 1).tolist(), batch.num_rows})
            for a, b in zip(cuts, cuts[1:], strict=False):
                if heads[a]:
                    own = batch.column(4)[a].values
                    lists = [own.field(x) for x in ("ids", "v", "near")]
                    key, ids = keys[:, a], lists[0].to_pylist()
                    raw = scaled(np.array(lists[1].to_pylist()))
                    order = np.array(lists[2].to_pylist())
                elif key is not None and (keys[:, a] == key).all():  # sorted: all queries of the file follow it
                    n = b - a
                    part = batch.slice(a, n)
                    q = scaled(np.asarray(part.column(5).flatten()).reshape(n, -1))
                    wanted = np.asarray(part.column(6).flatten()).reshape(n, -1)
                    found = best(q, np.asarray(part.column(3)), wanted, raw, ids, order, len(pivots), k, share)
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return met.transform(mapped, run, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", value: str = "embedding", n_pivots: int = PIVOTS, seen: int = SEEN, posted: int = POSTED, ask: float = ASK, share: float = SHARE, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, its own id left out."""
    if k >= ASK_LEAST:
        raise ValueError(f"k must be below {ASK_LEAST}")
    rows, asked = usable(vectors, key, value), staged(usable(queries, key, value), "queries")
    # equal vectors are one entry with the k + 1 smallest of its ids
    nth = Window.partitionBy("v").orderBy("id")
    rows = rows.withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= k + 1)
    rows = staged(rows.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids", "v"), "vectors")
    lengths = sorted(r.n for r in rows.select(F.size("v").alias("n")).distinct().collect())  # a row for each length of vectors
    found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for n in lengths:
        found = found.union(_search(rows.filter(F.size("v") == n), asked.filter(F.size("v") == n), k, n_pivots, seen, posted, ask, share, sample))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(nearest))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
