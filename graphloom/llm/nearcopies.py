"""Near copies of whole documents: Jaccard similarity of their 5-word shingles of at least 0.8, compared exactly.

Texts with the same words (ASCII lower case, white space aside) are one class. Whom to compare is found by the SimHash of
the shingles (64 bits, linked within three by the index of ``simhash``), which finds the closest copies, and by BANDS keys of
ROWS min-hashes each: at similarity 0.8 two classes have one of them in common but for one case in 100,000. Both only say what
may be alike. Components of these links are dealt to tasks, where texts come by their smallest doc_id and each is compared on
its shingles with those that stay; a prefix of the shingles (ordered by hash) that two texts of this similarity must share
finds whom to compare with, exactly. A component of more than PART texts is cut into parts of that size by hash; what stays of
them is dealt anew, until it fits one part or parts no longer shrink, so that the copies of one text never meet in one task.
Every text that goes has a near copy with a smaller id that stayed in its part, and of those that stay at the end no two of a
component are near copies.

Texts of fewer than five words are one shingle; null texts and texts without words are alike. Null ids come after all others,
rows of one id are told apart by their text, and of equal rows one stays. Ties go by the hash of id and text. Texts of any
length are compared whole. An empty table gives no rows. Columns of any name pass unchanged."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.components import connected_components
from graphloom.llm.passages import shingle_hashes, words_of
from graphloom.llm.shared import column, mapped, parted, slices_by_bytes, staged, unused

SIMILARITY, BANDS, ROWS = 0.8, 16, 3
#: Texts of a component that one task compares in a round.
PART = 2_000
ODD = np.random.default_rng(11).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FLIP = np.random.default_rng(12).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(words: list[bytes]) -> np.ndarray:
    found = shingle_hashes(words)
    return found if len(found) else np.array([xxhash.xxh64_intdigest(b" ".join(words), 8)], np.uint64)


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from the highest."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The 64 bits that over half of n hashes have."""
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def keys(found: list[np.ndarray]) -> np.ndarray:
    """One row for each text: its band keys."""
    base, starts = np.concatenate(found), np.cumsum([0, *map(len, found[:-1])])
    out = np.zeros((len(found), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        least = np.minimum.reduceat((base ^ FLIP[k]) * ODD[k], starts)
        out[:, k // ROWS] = (out[:, k // ROWS] * np.uint64(0x9E3779B97F4A7C15)) ^ least
    return (out * np.uint64(0xBF58476D1CE4E5B9) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _signed(batches):
    for batch in slices_by_bytes(batches, "text", 1 << 20):
        words = [words_of(t) for t in column(batch, "text").to_pylist()]
        own = np.array([xxhash.xxh64_intdigest(b" ".join(w), 9) for w in words], np.uint64).view(np.int64)
        found = [shingles(w) for w in words]
        bands = keys(found)
        prints = np.array([majority(sum(set_bits(f[at : at + 65536]) for at in range(0, len(f), 65536)), len(f)) for f in found], np.uint64).view(np.int64)
        arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own), arrays, pa.array(prints)], names=["row", "doc_id", "class", "bands", "fp"])


class Staying:
    """Texts of one component that stay, found by the shingles that a near copy must share."""

    def __init__(self):
        self.sets, self.index = [], {}

    def has_near(self, text: str | None) -> bool:
        """Whether one that stays is a near copy; otherwise this one stays."""
        own = np.unique(shingles(words_of(text)))
        prefix = own[: len(own) - math.ceil(SIMILARITY * len(own)) + 1].tolist()
        for i in {i for v in prefix for i in self.index.get(v, ())}:
            other = self.sets[i]
            if min(len(own), len(other)) >= SIMILARITY * max(len(own), len(other)):
                both = len(np.intersect1d(own, other, assume_unique=True))
                if both >= SIMILARITY * (len(own) + len(other) - both):
                    return True
        for v in prefix:
            self.index.setdefault(v, []).append(len(self.sets))
        self.sets.append(own)
        return False


def _staying(batches):
    """Rows of component, part, class, text, sorted by component, part and id: the classes that go."""
    at, last, staying = None, None, Staying()
    for batch in slices_by_bytes(batches, "text", 4 << 20):
        out = []
        for component, part, own, text in zip(*(batch.column(i).to_pylist() for i in range(3)), column(batch, "text").to_pylist(), strict=True):
            if (component, part) != at:
                at, last, staying = (component, part), None, Staying()
            if own != last:  # not a repeated row
                last = own
                if staying.has_near(text):
                    out.append(own)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["gone"])


def _gone(texts: DataFrame) -> DataFrame:
    """texts: component, class, head, text. The classes that go."""
    found, left, before, size = None, texts.select("component", "class", "head"), None, PART
    texts = texts.select(F.col("class").alias("c"), "text")
    while True:
        sizes = left.groupBy("component").count().select(F.col("component").alias("whole"), F.ceil(F.col("count") / size).alias("parts"))
        dealt = left.join(sizes, F.col("component") == F.col("whole"))
        dealt = dealt.select("component", F.pmod(F.xxhash64("class", F.lit(size)), F.col("parts")).cast("long").alias("part"), "class", "head")
        met = dealt.join(texts, F.col("class") == F.col("c")).repartition("component", "part").sortWithinPartitions("component", "part", "head")
        gone = staged(met.select("component", "part", "class", "text").transform(mapped, _staying, "gone long").distinct(), "near-gone")
        found = gone if found is None else found.union(gone)
        # only components of several parts go on
        left = staged(dealt.join(sizes.filter("parts > 1").select("whole"), F.col("component") == F.col("whole"), "left_semi").join(gone, F.col("class") == F.col("gone"), "left_anti").select("component", "class", "head"), "near-left")
        now = left.count()
        if not now:
            return found
        if before is not None and now > 0.9 * before:  # what is left is hardly alike: larger parts
            size *= 4
        before = now


def one_of_each(docs: DataFrame, links) -> DataFrame:
    """The documents without those of which a near copy with a smaller id stays. links: of distinct fingerprints (``simhash.links``)."""
    names = docs.columns
    at = unused("row_at", names)
    rowed = docs.withColumn(at, F.xxhash64("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = rowed.select(F.col(at).alias("row"), "doc_id", "text").transform(mapped, _signed, f"row long, doc_id {kind}, class long, bands array<long>, fp long")
    signed = staged(signed, "near-keys")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    classes = staged(signed.groupBy("class").agg(F.min(place).alias("head"), F.min("bands").alias("bands"), F.min("fp").alias("fp")), "near-classes")
    spread = classes.select(F.col("class"), F.explode("bands").alias("key"))
    first = spread.groupBy("key").agg(F.min("class").alias("least"), F.count("*").alias("n")).filter("n > 1").select("key", "least")
    edges = spread.join(first, "key").filter("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b"))
    prints = staged(classes.groupBy("fp").agg(F.min("class").alias("least")), "near-prints")
    linked = links(prints.select("fp"))
    ends = [prints.select(F.col("fp").alias(f"f{x}"), F.col("least").alias(f"c{x}")) for x in "ab"]
    linked = linked.join(ends[0], F.col("a") == F.col("fa")).join(ends[1], F.col("b") == F.col("fb")).select("ca", "cb")
    alike = classes.join(prints.select(F.col("fp").alias("f"), "least"), F.col("fp") == F.col("f")).filter("class <> least").select("class", "least")
    groups = connected_components(edges.union(linked).union(alike))
    wanted = staged(classes.join(groups, F.col("class") == F.col("node")).select("component", "class", "head"), "near-wanted")
    named, _ = parted(rowed.select(at, "text"), F.col(at), wanted.select("head.row"))
    texts = staged(named.join(wanted, F.col(at) == F.col("head.row")).select("component", "class", "head", "text"), "near-texts")
    gone = _gone(texts)
    later = signed.join(classes.select(F.col("class").alias("own"), F.col("head.row").alias("first")), F.col("class") == F.col("own"))
    later = later.join(gone.distinct(), F.col("class") == F.col("gone"), "left").filter("gone IS NOT NULL OR row <> first").select(F.col("row").alias("later"))
    later = staged(later.distinct(), "near-later")
    repeated = signed.groupBy("row").count().filter("count > 1").select(F.col("row").alias("later"))
    doubtful, others = parted(rowed, F.col(at), later.union(repeated))
    kept = doubtful.join(later.select(F.col("later").alias(gone_at := unused("gone_at", [*names, at]))).hint("merge"), F.col(at) == F.col(gone_at), "left_anti")
    nth = unused("nth", [*names, at])
    kept = kept.withColumn(nth, F.row_number().over(Window.partitionBy(at).orderBy(F.lit(0)))).filter(F.col(nth) == 1)
    return kept.select(*names).union(others.select(*names))
