"""Mixture-controlled packing: deficit round-robin over source queues into windows of fixed length.

Every source is a queue of its documents' tokens. A round of the robin fills one window: each queue is owed its target
share of the window and what it was owed before, is served the whole tokens of that, its document cut there, and carries
the rest, less than a token for each level of a tree over the queues, to the next window. What a queue has been served
after W tokens is a closed form of W (``Shares``), so the output is cut into groups of windows: each group knows which
stretch of each queue it serves and the deficits that it starts with, without looking at any other group or partition.
Every window but the last so holds its sources in the target proportions to within those few tokens.
By default the targets are the sources' own shares of all tokens, which hold from the first window to the last. Given
weights hold until a source is empty; the others then go on in proportion to theirs.

Nulls: a null text is empty and has only the end id; null sources form one source, null ids are kept. Empty tables give no
rows. Repeated rows and ids are packed as often as they are there. Texts of any length are cut at windows; no text is
needed whole after it is tokenised. Further columns are not read, whatever their names. No skew: queues are cut by token
position, not by source."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import column, mapped, slices_by_bytes, staged
from graphloom.llm.tokens import default_path, encoder, gather

WINDOW, GROUP_WINDOWS = 1024, 128
#: Up to so many rows (40 bytes each), one for each input partition and source, are sent to every task.
SMALL_TABLE = 500_000
#: Bytes of texts that are tokenised together, and where the table of pieces is bounded by the caller.
PART_BYTES, SMALL_PART_BYTES = 8 << 20, 2 << 20


def tokenised(docs: DataFrame, kind: str, path: str, end: int, queue: str | None = None, table_bytes: int | None = None) -> DataFrame:
    """doc_id, the queue's column, part (number of the input partition), own (ids of the queue before it in its part), n_tokens, ids (little-endian, 16 bits where the vocabulary allows) with the end id."""
    wide = vocabulary(path) > 65536
    names = ["doc_id", *([queue] if queue else [])]

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder, sums = encoder(kind, path, table_bytes), {}
        for batch in slices_by_bytes(batches, "text", PART_BYTES if table_bytes is None else SMALL_PART_BYTES):
            flat, starts = coder.ids(column(batch, "text"))
            before = []
            for key, n in zip(column(batch, queue).to_pylist() if queue else [None] * batch.num_rows, (np.diff(starts) + 1).tolist(), strict=True):
                before.append(sums.get(key, 0))
                sums[key] = before[-1] + n
            yield with_end(batch, names, part, before, flat, starts, end, np.dtype("<u4" if wide else "<u2"))

    fields = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in names)
    return docs.select(*names, "text").transform(mapped, run, f"{fields}part int, own long, n_tokens long, ids binary", keeps=True)


def with_end(batch, names, part, before, flat, starts, end, form) -> pa.RecordBatch:
    n = len(starts) - 1
    lengths = np.diff(starts)
    out = np.full(len(flat) + n, end, form)
    keep = np.ones(len(out), bool)
    keep[starts[1:] + np.arange(n)] = False
    out[keep] = flat
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    width = form.itemsize
    if offsets[-1] * width < 2**31:
        ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((offsets * width).astype(np.int32)), pa.py_buffer(out)])
    else:
        ids = pa.array([out[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary())
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(np.full(n, part, np.int32)), pa.array(before, pa.int64()), pa.array(lengths + 1, pa.int64()), ids], names=[*names, "part", "own", "n_tokens", "ids"])


def vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


class Shares:
    """taken(source, W): tokens of the source's queue among the first W of the output, for any W, in whole numbers.

    A phase lasts until a source is empty. In it, a node of a tree over the sources hands y tokens down: floor(y * left /
    all) to its left side, the rest to its right. Both grow with y, so no queue ever goes back, and the sum is exact."""

    def __init__(self, totals: list[int], weights: list[float] | None = None):
        self.n, self.total = len(totals), sum(totals)
        self.phases: list[tuple[int, int, list[int], list[int]]] = []
        left, done, at = list(totals), [0] * len(totals), 0
        from fractions import Fraction

        want = [Fraction(t) for t in totals] if weights is None else [Fraction(w).limit_denominator(10**6) for w in weights]
        while any(left):
            live = [j for j in range(self.n) if left[j]]
            if not any(want[j] > 0 for j in live):
                want = [Fraction(t) for t in left]
            unit = min(left[j] / want[j] for j in live if want[j] > 0)
            amounts = [int(unit * want[j]) if left[j] else 0 for j in range(self.n)]
            self.phases.append((at, sum(amounts), done[:], self.tree(amounts)))
            at += sum(amounts)
            done = [d + a for d, a in zip(done, amounts, strict=True)]
            left = [x - a for x, a in zip(left, amounts, strict=True)]
        self.starts = [p[0] for p in self.phases]

    def tree(self, amounts: list[int]) -> list[int]:
        size = 1
        while size < self.n:
            size *= 2
        sums = [0] * size + amounts + [0] * (size - self.n)
        for k in range(size - 1, 0, -1):
            sums[k] = sums[2 * k] + sums[2 * k + 1]
        return sums

    def taken(self, source: int, upto: int) -> int:
        if upto >= self.total:
            upto = self.total
        k = max(bisect_right(self.starts, upto) - 1, 0)
        at, length, done, sums = self.phases[k]
        y, size = min(upto - at, length), len(sums) // 2
        node, step = 1, size // 2
        while node < size:
            first = y * sums[2 * node] // sums[node] if sums[node] else 0
            right = source & step
            node, y = (2 * node + 1, y - first) if right else (2 * node, first)
            step //= 2
        return done[source] + y

    def served(self, sources: list[int], start: int, end: int, window: int) -> np.ndarray | None:
        """As served, for the output's tokens from start to end, if a source runs empty in between."""
        if bisect_right(self.starts, start) == bisect_right(self.starts, end - 1):
            return None
        upto = [*range(start, end, window), end]
        return np.array([[self.taken(j, x) - self.taken(j, start) for j in sources] for x in upto], np.int64)

    def group(self, source: int, position: int, width: int) -> int:
        """The group of width tokens that serves this position of the queue."""
        low, high = 0, -(-self.total // width) - 1
        while low < high:
            mid = (low + high) // 2
            if self.taken(source, (mid + 1) * width) > position:
                high = mid
            else:
                low = mid + 1
        return low


def served(amounts: np.ndarray, window: int) -> np.ndarray:
    """Row k: tokens of each queue that the first k windows of a group hold; the last row: amounts.

    The first k windows have k * window tokens; a node of a tree over the queues hands floor(tokens * left / all) of its own
    to its left side, the rest to its right. So no queue goes back, rows sum up exactly, and each queue stays within a token a
    level of its share."""
    total = int(amounts.sum())
    size = 1
    while size < len(amounts):
        size *= 2
    sums = [np.concatenate([amounts, np.zeros(size - len(amounts), np.int64)])]
    while len(sums[-1]) > 1:
        sums.append(sums[-1].reshape(-1, 2).sum(axis=1))
    has = np.minimum(np.arange(-(-total // window) + 1) * window, total)[:, None]
    for below, here in zip(sums[-2::-1], sums[:0:-1], strict=True):
        left = has * below[::2] // np.maximum(here, 1)
        has = np.stack([left, has - left], axis=2).reshape(len(has), -1)
    return has[:, : len(amounts)]


def fill(lengths: list[np.ndarray], window: int = WINDOW, ends: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Rounds over queues of piece lengths: columns piece (counted over all queues), start in it, length, window, offset, in order.

    ends: as of served, where the targets change inside the group."""
    amounts = np.array([q.sum() for q in lengths], np.int64)
    ends = served(amounts, window) if ends is None else ends
    rounds = len(ends) - 1
    # all queues behind each other on one axis, cut where a piece ends and where a window has had its share
    every = np.concatenate(lengths)
    begins = np.cumsum(every) - every
    base = np.cumsum(amounts) - amounts
    shares = (ends[:-1] + base).T.ravel()  # by queue, then window
    cuts = np.unique(np.concatenate([begins, shares, [amounts.sum()]]))
    start, length = cuts[:-1], np.diff(cuts)
    piece = np.searchsorted(begins, start, side="right") - 1
    queue, at = np.divmod(np.searchsorted(shares, start, side="right") - 1, rounds)
    order = np.lexsort((start, queue, at))
    piece, start, length, at = piece[order], start[order] - begins[piece[order]], length[order], at[order]
    return piece, start, length, at, np.cumsum(length) - length - at * window


def _queue_slices(shares: Shares, width: int, form: np.dtype):
    """Rows (queue, position, doc_id, n_tokens, ids) to rows (group, queue, position, doc_id, doc_tokens, start, ids), cut at ends of groups."""
    size = form.itemsize

    def run(batches):
        ends: dict[int, tuple[int, int, int]] = {}
        for batch in batches:
            queues, positions, counts = (batch.column(i).to_pylist() for i in (0, 1, 3))
            ids = batch.column(4)
            at, group, start, pieces = [], [], [], []
            for i, (j, p, n) in enumerate(zip(queues, positions, counts, strict=True)):
                data, done = ids[i].as_buffer(), 0
                g, low, high = ends.get(j, (0, 0, 0))
                while done < n:
                    if not low <= p + done < high:
                        g = g + 1 if p + done == high and high else shares.group(j, p + done, width)
                        low, high = shares.taken(j, g * width), shares.taken(j, (g + 1) * width)
                        if not low <= p + done < high:
                            g = shares.group(j, p + done, width)
                            low, high = shares.taken(j, g * width), shares.taken(j, (g + 1) * width)
                        ends[j] = (g, low, high)
                    take = min(n - done, high - p - done)
                    at.append(i)
                    group.append(g)
                    start.append(done)
                    pieces.append(data.slice(done * size, take * size).to_pybytes())
                    done += take
            take = pa.array(at, pa.int64())
            starts = pa.array(start, pa.int64())
            import pyarrow.compute as pc

            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), batch.column(0).take(take), pc.add(batch.column(1).take(take), starts), batch.column(2).take(take), batch.column(3).take(take), starts, pa.array(pieces, pa.binary())], names=["group", "queue", "position", "doc_id", "doc_tokens", "start", "ids"])

    return run


def _fill_groups(shares: Shares, form: np.dtype, window: int, group_windows: int):
    """Partitions sorted by group, queue, position: the pieces of each group's windows; groups may go over batches."""

    def of(rows: pa.Table):
        queues = np.asarray(rows.column("queue"))
        cuts = np.flatnonzero(np.diff(queues)) + 1
        bounds = [0, *cuts.tolist(), len(queues)]
        ids = rows.column("ids").combine_chunks()
        data = np.frombuffer(ids.buffers()[2], np.uint8) if ids.buffers()[2] is not None else np.zeros(0, np.uint8)
        offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
        tokens = data[offsets[0] : offsets[-1]].view(form).astype("<u4")
        row_at = (offsets[:-1] - offsets[0]) // form.itemsize
        lengths = np.diff(offsets) // form.itemsize
        group = int(rows.column("group")[0].as_py())
        begin = group * group_windows * window
        ends = shares.served([int(queues[a]) for a in bounds[:-1]], begin, begin + int(lengths.sum()), window)
        row, start, length, win, offset = fill([lengths[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], window, ends)
        flat, at = gather(tokens, row_at[row] + start, length)
        packed = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((np.concatenate([at, [len(flat)]]) * 4).astype(np.int32)), pa.py_buffer(flat)])
        take = pa.array(row)
        pick = lambda name: rows.column(name).combine_chunks().take(take)
        return pa.RecordBatch.from_arrays([pick("doc_id"), pa.array(np.asarray(pick("start")) + start), pa.array(length), packed, pick("doc_tokens"), pa.array(group * group_windows + win), pa.array(offset)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            groups = np.asarray(table.column("group"))
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[0].column("group")[0].as_py() != groups[a]:
                    yield of(pa.concat_tables(held))
                    held = []
                held.append(table.slice(a, b - a))
        if held:
            yield of(pa.concat_tables(held))

    return run


def pack(docs: DataFrame, path: str | None = None, end: int = 0, weights: dict[str | None, float] | None = None, window: int = WINDOW, group_windows: int = GROUP_WINDOWS, table_bytes: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (32 bits each), doc_tokens, sequence_id, offset.

    A sequence is its pieces by offset; all are window tokens long but the last. weights: target proportion of each
    source (sources without one come last, in proportion to their size); None: as the sources are. table_bytes: bound of the
    table of encoded pieces that a worker keeps; less costs time, not memory."""
    path = path or default_path("byte_bpe_50k.json")
    form = np.dtype("<u4" if vocabulary(path) > 65536 else "<u2")
    rows = staged(tokenised(docs, "byte", path, end, "source", table_bytes), "pack-tokens")
    order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("source", "part").agg(F.sum("n_tokens").alias("tokens"))
    parts = staged(parts.withColumn("base", F.coalesce(F.sum("tokens").over(order), F.lit(0).cast("long"))), "pack-parts")
    sources = parts.groupBy("source").agg(F.sum("tokens").alias("tokens")).orderBy(F.col("source").asc_nulls_last()).collect()  # a row for each source
    shares = Shares([r.tokens for r in sources], None if weights is None else [weights.get(r.source, 0) for r in sources])
    spark = docs.sparkSession
    numbers = F.broadcast(spark.createDataFrame([(r.source, j) for j, r in enumerate(sources)], f"n {docs.schema['source'].dataType.simpleString()}, queue int"))
    width = window * group_windows
    kind = docs.schema["doc_id"].dataType.simpleString()

    bases = parts.join(numbers, F.col("source").eqNullSafe(F.col("n"))).select(F.col("source").alias("s"), F.col("part").alias("p"), "base", "queue")
    if parts.count() <= SMALL_TABLE:
        bases = F.broadcast(bases)
    placed = rows.join(bases, F.col("part").eqNullSafe(F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    known = placed.select("queue", (F.col("base") + F.col("own")).alias("position"), "doc_id", "n_tokens", "ids")
    cut = known.transform(mapped, _queue_slices(shares, width, form), f"group long, queue int, position long, doc_id {kind}, doc_tokens long, start long, ids binary")
    dealt = cut.repartition("group").sortWithinPartitions("group", "queue", "position")
    return dealt.transform(mapped, _fill_groups(shares, form, window, group_windows), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
