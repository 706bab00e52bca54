"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprint: 64 bits, each set if more than half of the hashes of a document's 3-word shingles (repeats count) have it.

Links: fingerprints that differ in at most three bits agree on one of four 16-bit blocks. For each block all distinct
fingerprints are turned so that the block comes first and sorted by Gray rank over range partitions; a block value is never
cut. In that order neighbours share long masked bit patterns. A partition is cut, at block values, into stretches of bounded
size; runs of fingerprints form leaves, runs of leaves upper nodes, each with the bits that all of its members share. A
search compares node with node from the top: bits in which two patterns differ are differences of every pair below, they only
add up on the way down, and a pair of nodes with more than three, or with one in the block itself (such pairs are found under
another block), is pruned with all that stands under it. A block value that very many fingerprints share is split by further
bits, a quarter of those left at a time, of which again one agrees, until groups are small; as a group has no more
fingerprints than its free bits can tell apart, that ends. From each stretch only a spanning forest of its links goes on.

Nulls and texts without words have fingerprint zero and link to each other. Null ids are kept as rows; a component whose
ids are all null has a null component_id. Repeated rows give repeated rows; equal texts tie and have one fingerprint. Texts
of any length are read whole, their shingles in bounded stretches. An empty table gives no rows. Further columns are not read,
whatever their names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import nearcopies
from graphloom.llm.components import connected_components
from graphloom.llm.shared import column, mapped, slices_by_bytes, staged

SEED, NEAR, SHINGLE = 42, 3, 3
LEAF, FAN = 16, 16
#: Fingerprints of a stretch; a group of more with one block value is split by its other bits (exact, see above).
LARGE = 1 << 14
ALL = (1 << 64) - 1


def text_fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = len(words) - SHINGLE + 1
    hashed = xxhash.xxh64_intdigest
    if n < 1:
        return hashed(b" ".join(words), SEED)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = words[at : min(at + 65536, n) + SHINGLE - 1]
        counts += nearcopies.set_bits(np.array([hashed(b" ".join(s), SEED) for s in zip(part, part[1:], part[2:], strict=False)], np.uint64))
    return nearcopies.majority(counts, n)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: 64 bits as a signed long."""

    def run(batches):
        for batch in slices_by_bytes(batches, "text", 2 << 20):
            found = np.array([text_fingerprint(t) for t in column(batch, "text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").transform(mapped, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the reflected Gray sequence."""
    rank = fp.copy()
    for by in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(by)
    return rank


def index_levels(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pattern and mask of shared bits of each node, leaves first, over fingerprints in Gray order."""
    levels, pattern, mask, size = [], fps, np.full(len(fps), ~np.uint64(0)), LEAF
    while len(pattern) > 1:
        starts = np.arange(0, len(pattern), size)
        every = np.bitwise_and.reduceat(pattern & mask, starts)
        some = np.bitwise_or.reduceat(pattern | ~mask, starts)
        pattern, mask, size = every, every | ~some, FAN
        levels.append((pattern, mask))
    return levels or [(fps, np.full(len(fps), ~np.uint64(0)))]


def near_pairs(fps: np.ndarray, agree: int = 0, block: int = 1 << 16, seen: dict | None = None):
    """Index pairs (i < j) of fingerprints in Gray order that differ in at most NEAR bits and in none of agree, in bounded blocks.

    seen: counts the pairs of nodes that were compared, and those that were pruned."""
    n = len(fps)
    if n < 2:
        return
    must = np.uint64(agree)
    levels = index_levels(fps)
    todo = [(len(levels) - 1, np.array([0]), np.array([0]))]
    while todo:
        level, a, b = todo.pop()
        pattern, mask = levels[level]
        apart = (pattern[a] ^ pattern[b]) & mask[a] & mask[b]
        keep = (np.bitwise_count(apart) <= NEAR) & (apart & must == 0)
        if seen is not None:
            seen["compared"] = seen.get("compared", 0) + len(a)
            seen["pruned"] = seen.get("pruned", 0) + len(a) - int(keep.sum())
        a, b = a[keep], b[keep]
        below, fan = (len(levels[level - 1][0]), FAN) if level else (n, LEAF)
        step = max(1, block // (fan * fan))
        grid = np.arange(fan)
        for at in range(0, len(a), step):
            left = (a[at : at + step, None, None] * fan + grid[None, :, None]).repeat(fan, 2).ravel()
            right = (b[at : at + step, None, None] * fan + grid[None, None, :]).repeat(fan, 1).ravel()
            real = (left < below) & (right < below) & ((left < right) | ((left == right) & (level > 0)))
            left, right = left[real], right[real]
            if level:
                todo.append((level - 1, left, right))
            else:
                apart = fps[left] ^ fps[right]
                hit = (np.bitwise_count(apart) <= NEAR) & (apart & must == 0)
                if hit.any():
                    yield left[hit], right[hit]


def forest(fps: np.ndarray, agree: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A star round the first member of each linked set: (member, first), from all links of fps in Gray order."""
    label = np.arange(len(fps))
    for i, j in near_pairs(fps, agree):
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(label, high, low)
            while True:
                jumped = label[label]
                if np.array_equal(jumped, label):
                    break
                label = jumped
    own = np.arange(len(fps))
    far = np.flatnonzero(label != own)
    return far, label[far]


def bit_ranges(mask: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each run of set bits of a 64-bit mask, from the highest."""
    out, at = [], 0
    while at < 64:
        n = 0
        while at + n < 64 and mask >> (63 - at - n) & 1:
            n += 1
        if n:
            out.append((at, n))
        at += n + 1
    return out


def turned(fps: np.ndarray, mask: int) -> np.ndarray:
    """Fingerprints with the bits of the mask before all others."""
    out = np.zeros(len(fps), np.uint64)
    for first, n in [*bit_ranges(mask), *bit_ranges(mask ^ ALL)]:
        part = (fps >> np.uint64(64 - first - n)) & np.uint64((1 << n) - 1)
        out = part if n == 64 else (out << np.uint64(n)) | part
    return out


def quarters(mask: int) -> list[int]:
    """The mask with each quarter of the bits that it leaves free: two patterns within NEAR bits agree on one of them."""
    free = [i for i in range(64) if not mask >> i & 1][::-1]
    size = -(-len(free) // (NEAR + 1))
    return [mask | sum(1 << i for i in free[at : at + size]) for at in range(0, len(free), size)] if free else []


def _stretches(rows: np.ndarray, over: bool):
    """Rows (mask, value, fp) sorted by mask and value, cut into stretches of one mask between values; last: what the next batch goes on with."""
    while rows.shape[1]:
        n = int(np.searchsorted(rows[0], rows[0, 0], side="right"))
        if n > LARGE:
            begins = np.flatnonzero(rows[1, 1:n] != rows[1, : n - 1]) + 1
            fit = int(np.searchsorted(begins, LARGE, side="right"))
            if len(begins):
                n = int(begins[max(fit - 1, 0)])
            elif n == rows.shape[1] and not over:
                break
        elif n == rows.shape[1] and not over:
            break
        yield rows[:, :n]
        rows = rows[:, n:]
    yield rows


def _stretch_links(batches):
    """Rows (mask, value, fp) of a partition sorted by mask and value: links found by the index of each stretch."""
    held = np.zeros((3, 0), np.int64)

    def of(rows: np.ndarray):
        mask, fps = int(rows[0, 0]) & ALL, np.ascontiguousarray(rows[2]).view(np.uint64)
        fps = fps[np.argsort(gray_rank(turned(fps, mask)), kind="stable")]
        far, near = forest(fps, mask)
        if len(far):
            yield pa.RecordBatch.from_arrays([pa.array(fps[x].view(np.int64)) for x in (far, near)], names=["a", "b"])

    for batch in batches:
        rows = np.concatenate([held, np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)])], axis=1)
        *whole, held = _stretches(rows, False)
        for own in whole:
            yield from of(own)
    for own in [*_stretches(held, True)][:-1]:
        yield from of(own)


def _as_long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _block_rank(fp, first: int, count: int):
    """Gray rank of count bits of fp from bit first, counted from the highest."""
    rank = F.shiftrightunsigned(fp, 64 - first - count).bitwiseAND(F.lit((1 << count) - 1))
    for by in (1, 2, 4, 8):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, by))
    return rank


def links(distinct: DataFrame) -> DataFrame:
    """a, b: links that hold together all distinct fingerprints (fp) within NEAR bits of each other."""
    spark = distinct.sparkSession
    masks = quarters(0)
    blocks = F.array(*[F.struct(F.lit(_as_long(m)).alias("mask"), _block_rank(F.col("fp"), 16 * k, 16).alias("value")) for k, m in enumerate(masks)])
    rows = distinct.select("fp", F.explode(blocks).alias("k")).select("k.mask", "k.value", "fp")
    done = None
    while True:
        sizes = rows.groupBy("mask", "value").count().filter(F.col("count") > LARGE)
        heavy = staged(sizes.select(F.col("mask").alias("m"), F.col("value").alias("v")), "large-blocks")
        if heavy.isEmpty():
            done = rows if done is None else done.union(rows)
            break
        same = (F.col("mask") == F.col("m")) & (F.col("value") == F.col("v"))
        light = rows.join(heavy, same, "left_anti")
        done = light if done is None else done.union(light)
        # four rows for each mask of this round; the bits bound the rounds
        finer = [(m, q) for m in masks for q in quarters(m)]
        table = F.broadcast(spark.createDataFrame([(_as_long(m), _as_long(q)) for m, q in finer], "p long, q long"))
        heavy_rows = rows.join(heavy, same, "left_semi").join(table, F.col("mask") == F.col("p"))
        rows = staged(heavy_rows.select(F.col("q").alias("mask"), F.col("fp").bitwiseAND(F.col("q")).alias("value"), "fp").distinct(), "large-parts")
        masks = sorted({q for _, q in finer})
    return done.repartitionByRange("mask", "value").sortWithinPartitions("mask", "value").transform(mapped, _stretch_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id that links reach)."""
    prints = staged(fingerprints(docs), "fingerprints")
    first = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    groups = connected_components(links(first.select("fp")))
    classes = first.join(groups, first["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    heads = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = staged(classes.join(heads, "component").select(F.col("fp").alias("f"), "component_id"), "fingerprint-components")
    return prints.join(classes, F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those of which a near copy (five-word shingles, Jaccard 0.8 or more) with a smaller id stays.

    Candidates are linked fingerprints of five-word shingles and, since near copies of this similarity differ in some ten of
    64 bits, equal min-hash keys, too; all are compared exactly (``nearcopies``)."""
    return nearcopies.one_of_each(docs, links)
