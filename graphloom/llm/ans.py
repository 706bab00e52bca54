"""Token ids as binary output: static range asymmetric numeral system (rANS) with one shared frequency table.

A stored set is two tables: ``table`` (id, freq; the frequencies sum to 2**18) and ``blocks``. A block holds whole
documents, some 65536 ids or one longer document, and can be read without any other. Its payload:

    "RANS" | version u16 | reserved u16 | ids u64 | lanes u32 | steps u32 | checkpoints u32 | crc32 of the ids (u32 each) u32
    | for each checkpoint and lane: state u64 | for each checkpoint and lane: words read so far u32
    | for each lane: words u32 | the words of each lane, u32 each

Id i of a block belongs to lane i % lanes, step i // lanes; lanes are coded side by side. Every 512 steps there is a
checkpoint, from which decoding can begin; a reader decodes all stretches of many blocks at once. The crc32 is checked.

Nulls: a null text is empty and has only the end id; null ids come first. Rows with one doc_id are ordered by their ids'
hash. An empty table gives no blocks and no rows."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.packing import tokenised, vocabulary
from graphloom.llm.shared import mapped, shared_dir, staged
from graphloom.llm.tokens import default_path

SCALE = 18
TOTAL = 1 << SCALE
LOW = np.uint64(1 << 31)
LANES, BLOCK, CHECK_STEPS = 64, 65536, 512
HEAD = struct.Struct("<4sHHQIIII")
#: Up to so many rows (one for each partition of the written set) are sent to every task.
SMALL_TABLE = 500_000


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to TOTAL, at least 1 for each id that occurs."""
    seen = np.flatnonzero(counts)
    freq = np.zeros(len(counts), np.int64)
    if not len(seen):
        return freq
    share = counts[seen].astype(np.float64) / counts.sum()
    freq[seen] = np.maximum(1, np.floor(share * TOTAL)).astype(np.int64)
    over = int(freq.sum()) - TOTAL
    order = seen[np.argsort(-freq[seen], kind="stable")]
    if over < 0:
        freq[order[0]] -= over
    while over > 0:  # taken from the most frequent ones, in proportion
        room = freq[order] - 1
        cut = np.minimum(room, -(-room * over // max(int(room.sum()), 1)))
        cut = np.where(np.cumsum(cut) <= over, cut, np.maximum(0, over - (np.cumsum(cut) - cut)))
        freq[order] -= cut
        over -= int(cut.sum())
    return freq


def encode_blocks(blocks: list[np.ndarray], freq: np.ndarray) -> list[bytes]:
    """Payload of each block of ids (u32)."""
    f, start = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    filler = int(np.argmax(freq))
    lanes = np.array([LANES * max(1, round(len(b) / BLOCK)) for b in blocks])
    steps = np.array([-(-len(b) // k) for b, k in zip(blocks, lanes, strict=True)])
    order = np.argsort(-steps, kind="stable")
    first = np.concatenate([[0], np.cumsum(lanes[order])])
    width, longest = int(first[-1]), int(steps.max())
    symbols = np.full((longest, width), filler, np.uint32)
    for k, b in enumerate(order):
        own = np.full(steps[b] * lanes[b], filler, np.uint32)
        own[: len(blocks[b])] = blocks[b]
        symbols[: steps[b], first[k] : first[k + 1]] = own.reshape(steps[b], lanes[b])
    # at step t the lanes of blocks with more than t steps are at work; these come first
    at_work = first[np.searchsorted(-steps[order], -np.arange(longest), side="left")]
    state, put = np.full(width, LOW), np.zeros(width, np.int64)
    words = np.zeros((longest + 2, width), np.uint32)
    checks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for t in range(longest - 1, -1, -1):
        n = int(at_work[t])
        s = symbols[t, :n]
        fs, x = f[s], state[:n]
        out = np.flatnonzero(x >= fs << np.uint64(63 - SCALE))
        if len(out):
            words[put[out], out] = (x[out] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            x[out] >>= np.uint64(32)
            put[out] += 1
        q = x // fs
        state[:n] = (q << np.uint64(SCALE)) + (x - q * fs) + start[s]
        if t % CHECK_STEPS == 0:
            checks[t] = state[:n].copy(), put[:n].copy()
    made: list[bytes] = [b""] * len(blocks)
    for k, b in enumerate(order):
        lo, hi = first[k], first[k + 1]
        own = [checks[t] for t in range(0, int(steps[b]), CHECK_STEPS)]
        total = put[lo:hi]
        read = [(total - p[lo:hi]).astype("<u4") for _, p in own]
        streams = [words[: total[j], lo + j][::-1].astype("<u4").tobytes() for j in range(hi - lo)]
        crc = zlib.crc32(blocks[b].astype("<u4").tobytes())
        made[b] = b"".join([HEAD.pack(b"RANS", 1, 0, len(blocks[b]), lanes[b], steps[b], len(own), crc), *(s[lo:hi].astype("<u8").tobytes() for s, _ in own), *(r.tobytes() for r in read), total.astype("<u4").tobytes(), *streams])
    return made


def decode_blocks(payloads: list[bytes], freq: np.ndarray) -> list[np.ndarray]:
    """Ids of each block; all stretches between checkpoints of all blocks side by side."""
    f, start = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    symbol_of = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
    heads, states, places, lengths, pool, base = [], [], [], [], [], 0
    for data in payloads:
        mark, version, _, n, lanes, steps, checks, crc = HEAD.unpack_from(data)
        if mark != b"RANS" or version != 1:
            raise ValueError("not a block of this format")
        at = HEAD.size
        state = np.frombuffer(data, "<u8", checks * lanes, at)
        at += 8 * checks * lanes
        read = np.frombuffer(data, "<u4", checks * lanes, at).reshape(checks, lanes).astype(np.int64)
        at += 4 * checks * lanes
        total = np.frombuffer(data, "<u4", lanes, at).astype(np.int64)
        at += 4 * lanes
        words = np.frombuffer(data, "<u4", int(total.sum()), at)
        heads.append((n, lanes, steps, checks, crc))
        states.append(state)
        places.append((base + read + (np.cumsum(total) - total)).ravel())
        lengths.append(np.repeat(np.minimum(CHECK_STEPS, steps - CHECK_STEPS * np.arange(checks)), lanes))
        pool.append(words)
        base += len(words)
    state, place, length = (np.concatenate(x) for x in (states, places, lengths))
    words = np.concatenate([*pool, np.zeros(1, np.uint32)]).astype(np.uint64)
    order = np.argsort(-length, kind="stable")
    x, place, sorted_length = state[order].astype(np.uint64), place[order], length[order]
    out = np.zeros((CHECK_STEPS, len(x)), np.uint32)
    below = np.uint64(TOTAL - 1)
    for t in range(int(sorted_length[0]) if len(sorted_length) else 0):
        n = int(np.searchsorted(-sorted_length, -t, side="left"))
        own = x[:n]
        slot = own & below
        s = symbol_of[slot]
        out[t, :n] = s
        own = f[s] * (own >> np.uint64(SCALE)) + slot - start[s]
        few = np.flatnonzero(own < LOW)
        if len(few):
            own[few] = (own[few] << np.uint64(32)) | words[place[few]]
            place[few] += 1
        x[:n] = own
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    found, at = [], 0
    for n, lanes, _, checks, crc in heads:
        columns = back[at : at + checks * lanes].reshape(checks, lanes)
        ids = np.concatenate([out[:, c] for c in columns]).ravel()[:n] if checks else np.zeros(0, np.uint32)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum doesn't hold")
        found.append(ids)
        at += checks * lanes
    return found


BLOCK_FIELDS = "part int, block int, first_id long, n_ids long, doc_ids array<long>, doc_lengths array<long>, payload binary"


def _write_rows(freq: np.ndarray, form: np.dtype, together: int = 48):
    """Rows (doc_id, ids) of a partition in order to rows of blocks, some blocks at a time."""

    def run(batches):
        from pyspark import TaskContext

        part, number, done = TaskContext.get().partitionId(), 0, 0
        docs: list[tuple] = []
        held, waiting, waiting_ids = 0, [], 0

        def flush():
            nonlocal number, done, waiting, waiting_ids
            ids = [np.concatenate([a for _, a in w]) for w in waiting]
            for w, own, payload in zip(waiting, ids, encode_blocks(ids, freq), strict=True):
                yield part, number, done, len(own), [k for k, _ in w], [len(a) for _, a in w], payload
                number, done = number + 1, done + len(own)
            waiting, waiting_ids = [], 0

        def rows():
            nonlocal docs, held, waiting_ids
            for batch in batches:
                for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    own = np.frombuffer(data.as_buffer(), form).astype(np.uint32)
                    docs.append((key, own))
                    held += len(own)
                    if held >= BLOCK:
                        waiting.append(docs)
                        waiting_ids += held
                        docs, held = [], 0
                        if len(waiting) >= together or waiting_ids >= together * BLOCK * 2:
                            yield from flush()
            if docs:
                waiting.append(docs)
            if waiting:
                yield from flush()

        yield from rows()

    def arrow(batches):
        for row in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["part", "block", "first_id", "n_ids", "doc_ids", "doc_lengths", "payload"])

    return arrow


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = 1) -> None:
    """Encode documents (doc_id, text) in ascending doc_id order and write the set to a folder that Spark can write."""
    tokenizer = tokenizer or default_path("word_bpe_49k.json")
    size = max(vocabulary(tokenizer), end + 1)
    form = np.dtype("<u4" if vocabulary(tokenizer) > 65536 else "<u2")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = staged(tokenised(docs, "word", tokenizer, end).select("doc_id", "ids"), "ans-ids")

    def count(batches):
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for data in batch.column(0):
                sums += np.bincount(np.frombuffer(data.as_buffer(), form), minlength=size)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[seen])], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in rows.select("ids").transform(mapped, count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        counts[r.id] = r.n
    freq = quantised(counts)
    spark = docs.sparkSession
    seen = np.flatnonzero(freq)
    spark.createDataFrame([(int(i), int(freq[i])) for i in seen], "id long, freq long").coalesce(1).write.parquet(f"{folder}/table")
    order = (F.col("doc_id"), F.xxhash64("ids"))  # rows of one id, or of none, may go to several tasks
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.transform(mapped, _write_rows(freq, form), BLOCK_FIELDS).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (32 bits each) of every document of a written set."""
    table = spark.read.parquet(f"{folder}/table").collect()  # at most the vocabulary
    freq = np.zeros(max((r.id for r in table), default=0) + 1, np.int64)
    for r in table:
        freq[r.id] = r.freq
    blocks = spark.read.schema(BLOCK_FIELDS).parquet(f"{folder}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that was written
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if parts.count() <= SMALL_TABLE:
        parts = F.broadcast(parts)
    placed = blocks.join(parts, F.col("part") == F.col("p")).select((F.col("base") + F.col("first_id")).alias("at"), "doc_ids", "doc_lengths", "payload")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 16):
                some = batch.slice(lo, 16)
                found = decode_blocks([p.as_buffer().to_pybytes() for p in some.column(3)], freq)
                for at, keys, lengths, ids in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2).to_pylist(), found, strict=True):
                    ends = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))])
                    data = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(at + ends[:-1]), pa.array(np.diff(ends)), data], names=["doc_id", "start", "n_tokens", "ids"])

    return placed.transform(mapped, run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """Write the documents as a set in the shared folder and read it back."""
    folder = f"{shared_dir(docs.sparkSession)}/ans-{uuid.uuid4().hex}"
    write(docs, folder)
    return read(docs.sparkSession, folder)
