"""Line dedup with a suffix array over line ids, built by distributed prefix doubling.

Every line that has words gets the 128-bit hash of its white-space-normalised text; lines that occur once cut the texts
into runs of repeated lines. Suffixes of these runs are ranked by their first line, then by the first 2, 4, 8 … lines:
rows sorted over all partitions by (rank, rank of the suffix that many lines on) get their place in the order as the new
rank, from counts of partitions; one sort a round and no group in one task. It ends when all suffixes are told apart or
equal to their ends.

Common prefixes of neighbours in the order come from the ranks of the rounds, longest first. An interval of the order
with a common prefix of n lines is a repeated run; a suffix has an earlier copy of n lines if the least position of the
interval isn't its own. For each suffix the longest such n is found by one pass from either side over each partition, with
the frontier (common prefix, least position) of the partitions before it: as many numbers as it has different common
prefixes, which go to the partition's task alone.

A maximal repeated run of at least ``min_words`` words is deleted wherever it isn't the first copy, in order of doc_id;
white-space lines inside and right before it go with it. Shorter runs stay: with a least length of one word every later
occurrence of any line would go, whatever stands around it, and runs would mean nothing. A stretch without blanks counts
as a word for each 36 bytes (12 characters of three bytes), so that scripts without blanks have runs, too.

Nulls: a null text stays null. Rows of one doc_id and text are one document, known by a 64-bit hash of both, and are
treated alike. Null ids come first. Ties (equal runs in one document) go to the earlier line. Empty texts stay; texts of any
length are cut whole. An empty table gives no rows. Further columns, whatever their names, pass unchanged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import column, mapped, parted, slices_by_bytes, staged, unused

MIN_WORDS = 8


def line_id(line: bytes) -> tuple[int, int, int] | None:
    """128-bit hash, in two halves, and number of words (at least one for each 36 bytes); None without words."""
    words = line.split()
    if not words:
        return None
    h = xxhash.xxh3_128_intdigest(b" ".join(words))
    return h >> 64, h & 0xFFFFFFFFFFFFFFFF, max(len(words), len(line) // 36)


def document_key():
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))


def lines(docs: DataFrame) -> DataFrame:
    """doc (key), doc_id, place (among lines that have words), line (number), words, h1, h2."""

    def run(batches):
        for batch in slices_by_bytes(batches, "text", 4 << 20):
            at, place, number, words, h1, h2 = [], [], [], [], [], []
            for i, text in enumerate(column(batch, "text").to_pylist()):
                k = 0
                for n, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    found = line_id(line)
                    if found:
                        at.append(i)
                        place.append(k)
                        number.append(n)
                        h1.append(found[0])
                        h2.append(found[1])
                        words.append(found[2])
                        k += 1
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(place, pa.int32()), pa.array(number, pa.int32()), pa.array(words, pa.int32()), *(pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2))], names=["doc", "doc_id", "place", "line", "words", "h1", "h2"])

    return docs.select(document_key().alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), "text").transform(mapped, run, "doc long, doc_id long, place int, line int, words int, h1 long, h2 long")


def _numbered(rows: DataFrame, keys: list[str], tie: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Rows in global order of keys, as a staged table with part and idx (their place in it), and a row for each part."""
    ordered = rows.repartitionByRange(*keys, *tie).sortWithinPartitions(*keys, *tie)

    def number(batches):
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(done, done + n))], names=[*batch.schema.names, "part", "idx"])
            done += n

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    table = staged(ordered.transform(mapped, number, f"{fields}, part int, idx long"), name)
    parts = table.groupBy("part").agg(F.count("*").alias("n"), F.min_by(F.struct(*keys), "idx").alias("first"), F.max_by(F.struct(*keys), "idx").alias("last"))
    return table, parts


def _ranked(rows: DataFrame, major: list[str], minor: list[str], name: str) -> DataFrame:
    """rows with start_major and start: places in the global order at which the rows of equal major keys, and of equal keys, begin;
    and alone: surely no other row has these keys (a partition's first and last rows aren't sure).

    Each partition finds the beginnings inside it; a run that comes from an earlier partition begins where that one says."""
    keys, tie = [*major, *minor], ["doc", "place"]
    table, parts = _numbered(rows, keys, tie, name)
    spark = rows.sparkSession

    def begins(batches):
        held = None  # keys of the last row, and where its runs begin
        for batch in batches:
            k = np.stack([np.asarray(batch.column(batch.schema.get_field_index(c))).astype(np.int64) for c in keys])
            part, idx = (np.asarray(batch.column(batch.schema.get_field_index(c))).astype(np.int64) for c in ("part", "idx"))
            outs = []
            for depth, j in ((len(major), 0), (len(keys), 1)):
                same = np.zeros(len(idx), bool)
                same[1:] = (k[:depth, 1:] == k[:depth, :-1]).all(axis=0) & (part[1:] == part[:-1])
                carried = held is not None and idx[0] > 0 and held[0] == part[0] and (k[:depth, 0] == held[1][:depth]).all()
                at = np.where(same, -1, idx)
                if carried:
                    at[0] = held[2][j]
                place = np.maximum.accumulate(np.where(at >= 0, np.arange(len(at)), 0))
                outs.append(at[place])
            alone = np.zeros(len(idx), bool)
            alone[1:-1] = ~same[1:-1] & ~same[2:] & (part[1:-1] == part[2:]) & (part[1:-1] == part[:-2])
            held = (part[-1], k[:, -1], [o[-1] for o in outs])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(o) for o in outs), pa.array(alone)], names=[*batch.schema.names, "in_major", "in_keys", "alone"])

    # rows of a part are read in order by one task
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    local = staged(table.repartition("part").sortWithinPartitions("part", "idx").transform(mapped, begins, f"{fields}, in_major long, in_keys long, alone boolean"), name)
    ends = local.groupBy("part").agg(F.max_by(F.struct("in_major", "in_keys"), "idx").alias("e")).select(F.col("part").alias("p"), "e.*")
    stats = parts.join(ends, F.col("part") == F.col("p")).orderBy("part").collect()  # a row for each partition
    base, before, info = 0, None, []
    for s in stats:
        carry_major = before[1] if before and before[0][: len(major)] == tuple(s.first[: len(major)]) else base
        carry_keys = before[2] if before and before[0] == tuple(s.first) else base
        info.append((s.part, base, carry_major, carry_keys))
        begin_major = carry_major if s.in_major == 0 else base + s.in_major
        begin_keys = carry_keys if s.in_keys == 0 else base + s.in_keys
        before = (tuple(s.last), begin_major, begin_keys)
        base += s.n
    known = F.broadcast(spark.createDataFrame(info, "p int, base long, carry_major long, carry_keys long"))
    joined = local.join(known, F.col("part") == F.col("p"))
    begin = lambda inside, carry: F.when(F.col(inside) == 0, F.col(carry)).otherwise(F.col("base") + F.col(inside))
    return joined.select(*rows.columns, begin("in_major", "carry_major").alias("start_major"), begin("in_keys", "carry_keys").alias("start"), "alone")


def _by_document(run, rows: DataFrame, schema: str) -> DataFrame:
    """run(numpy columns of one or more whole documents in order) for the rows dealt by document."""
    names = rows.columns

    def whole(batches):
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            doc = np.asarray(batch.column(0)).astype(np.int64)
            if not len(doc):
                continue
            last = int(np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))[-1])
            held = batch.slice(last)
            if last:
                yield from run({n: np.asarray(batch.column(i).slice(0, last)) for i, n in enumerate(names)})
        if held is not None:
            yield from run({n: np.asarray(held.column(i)) for i, n in enumerate(names)})

    return rows.repartition("doc").sortWithinPartitions("doc", "place").transform(mapped, whole, schema)


def _runs(c: dict) -> np.ndarray:
    """Lines from each row to the end of its run of consecutive repeated lines."""
    n = len(c["doc"])
    ends = np.concatenate([(c["doc"][1:] != c["doc"][:-1]) | (c["place"][1:] != c["place"][:-1] + 1), [True]])
    last = np.flatnonzero(ends)
    return last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1


SUFFIX = "doc long, doc_id long, place int, words int, left int, first long, prior long, rank long"


def _columns(c: dict, names: list[str], **more: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(more.get(n, c.get(n))) for n in names], names=names)


def runs_of(repeated: DataFrame, min_words: int) -> DataFrame:
    """Repeated lines with left (lines to the end of their run), without repeated rows and without the runs that have too few words for any deletion."""
    names = ["doc", "doc_id", "place", "words", "h1", "h2", "left"]

    def run(c):
        once = np.concatenate([[True], (c["doc"][1:] != c["doc"][:-1]) | (c["place"][1:] != c["place"][:-1])])
        c = {n: x[once] for n, x in c.items()}
        left = _runs(c)
        begins = np.concatenate([[True], left[:-1] == 1])
        size = np.add.reduceat(c["words"].astype(np.int64), np.flatnonzero(begins))[np.cumsum(begins) - 1]
        keep = size >= min_words
        if keep.any():
            yield _columns({n: x[keep] for n, x in c.items()}, names, left=left[keep].astype(np.int32))

    return _by_document(run, repeated, "doc long, doc_id long, place int, words int, h1 long, h2 long, left int")


def suffix_ranks(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """rows: of runs_of. All suffixes with their final rank, and (doc, place, rank) after each round, of the documents that it still had.

    A suffix is settled if no other has its rank or if it ends within the lines compared; a document of which all are
    settled takes no part in later rounds."""
    ranked = _ranked(rows, ["h1"], ["h2"], "lines-rank0")
    names = ["doc", "doc_id", "place", "words", "left", "first", "prior", "rank"]

    def begin(c):
        prior = np.full(len(c["doc"]), -1, np.int64)
        inner = np.flatnonzero((c["doc"][1:] == c["doc"][:-1]) & (c["place"][1:] == c["place"][:-1] + 1)) + 1
        prior[inner] = c["start"][inner - 1]
        yield _columns(c, [*names, "open"], first=c["start"], prior=prior, rank=c["start"], open=~c["alone"])

    table = staged(_by_document(begin, ranked.select("doc", "doc_id", "place", "words", "left", "start", "alone"), f"{SUFFIX}, open boolean"), "lines-round0")
    rounds, done, length = [table.select("doc", "place", "rank")], [], 1
    while True:

        def look(c, length=length):
            n = len(c["rank"])
            on = np.full(n, -1, np.int64)  # a suffix that ends comes first
            far = np.flatnonzero(c["left"] > length)
            on[far] = c["rank"][far + length]
            active = c["open"] & (c["left"] >= length)
            begins = np.concatenate([[True], c["doc"][1:] != c["doc"][:-1]])
            live = np.logical_or.reduceat(active, np.flatnonzero(begins))[np.cumsum(begins) - 1]
            yield _columns(c, [*names, "on", "state"], on=on, state=(live.astype(np.int32) + active.astype(np.int32)))

        ahead = staged(_by_document(look, table, f"{SUFFIX}, on long, state int"), "lines-ahead")
        done.append(ahead.filter("state = 0").select(*names))
        active = ahead.filter("state = 2").select(*names, "on")
        if active.isEmpty():
            every = done[0]
            for d in done[1:]:
                every = every.union(d)
            return every, rounds
        fresh = _ranked(active, ["rank"], ["on"], f"lines-rank{len(rounds)}")
        fresh = fresh.select(*names[:-1], (F.col("rank") + F.col("start") - F.col("start_major")).alias("rank"), (~F.col("alone")).alias("open"))
        table = staged(fresh.union(ahead.filter("state = 1").select(*names, F.lit(False))), "lines-round")
        rounds.append(table.select("doc", "place", "rank"))
        length *= 2


def common_prefixes(suffixes: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """The suffixes in order (part, idx), with lcp: lines in common with the one before.

    Where a suffix and the one before it in the order follow equal lines, the suffixes one line earlier are neighbours,
    too, with one line more in common; only the others are compared, by the ranks of the rounds from the last to the first."""
    names = ["doc", "doc_id", "place", "words", "left", "first", "prior", "rank"]
    order, parts = _numbered(suffixes, ["rank"], ["doc_id", "doc", "place"], "lines-order")
    last = {r.part: r.last for r in order.groupBy("part").agg(F.max_by(F.struct("doc", "place", "left", "first", "prior", "rank"), "idx").alias("last")).collect()}  # a row for each partition
    before, prior = {}, None
    for part in sorted(last):
        before[part], prior = prior, tuple(last[part])

    def neighbours(batches):
        held = None
        for batch in batches:
            get = lambda n: np.asarray(batch.column(batch.schema.get_field_index(n))).astype(np.int64)
            own = np.stack([get(n) for n in ("doc", "place", "left", "first", "prior", "rank")])
            part = get("part")
            other = np.empty_like(own)
            other[:, 1:] = own[:, :-1]
            for i in [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist()]:
                q = held[1] if i == 0 and held is not None and held[0] == part[0] else before[int(part[i])]
                other[:, i] = q if q is not None else (0, -9, 0, -9, -1, -9)
            held = (part[-1], own[:, -1])
            same_rank, follows = own[5] == other[5], (own[4] == other[4]) & (own[4] >= 0)
            lcp = np.where(same_rank, own[2], 0)
            # 0: known, 1: from the suffix a line earlier, 2: to compare
            how = np.where(same_rank | (own[3] != other[3]), 0, np.where(follows, 1, 2))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in ("doc", "doc_id", "place", "words", "left", "part", "idx")), pa.array(other[0]), *(pa.array(x.astype(np.int32)) for x in (other[1], other[2], lcp, how))], names=["doc", "doc_id", "place", "words", "left", "part", "idx", "q_doc", "q_place", "q_left", "lcp", "how"])

    rows = staged(order.select(*names, "part", "idx").repartition("part").sortWithinPartitions("part", "idx").transform(mapped, neighbours, "doc long, doc_id long, place int, words int, left int, part int, idx long, q_doc long, q_place int, q_left int, lcp int, how int"), "lines-neighbours")
    pairs = rows.filter("how = 2").select("doc", "place", "left", "q_doc", "q_place", "q_left", "lcp")
    finished = None
    for k in range(len(rounds) - 1, -1, -1):
        size = 1 << k
        room = F.least("left", "q_left") - F.col("lcp") >= size
        mine = rounds[k].select(F.col("doc").alias("m_doc"), F.col("place").alias("m_place"), F.col("rank").alias("m_rank"))
        other = rounds[k].select(F.col("doc").alias("o_doc"), F.col("place").alias("o_place"), F.col("rank").alias("o_rank"))
        # a document that a round no longer had has nothing in common over so many lines
        met = pairs.filter(room).join(mine, (F.col("doc") == F.col("m_doc")) & (F.col("place") + F.col("lcp") == F.col("m_place")), "left").join(other, (F.col("q_doc") == F.col("o_doc")) & (F.col("q_place") + F.col("lcp") == F.col("o_place")), "left")
        met = met.withColumn("lcp", (F.col("lcp") + F.when(F.col("m_rank") == F.col("o_rank"), F.lit(size)).otherwise(0)).cast("int")).select(*pairs.columns)
        pairs = staged(met.union(pairs.filter(~room)), "lines-pairs")
        finished = pairs
    columns = ["doc", "doc_id", "place", "words", "left", "part", "idx", "lcp", "how"]
    # a compared value is a row of its own next to the suffix's
    found = {"doc": "doc", "doc_id": "0L", "place": "place", "words": "0", "left": "0", "part": "0", "idx": "0L", "lcp": "lcp", "how": "3"}
    both = rows.select(*columns).union(finished.selectExpr(*[f"{v} AS {k}" for k, v in found.items()]))

    def fill(c):
        extra = c["how"] == 3
        found = dict(zip(zip(c["doc"][extra].tolist(), c["place"][extra].tolist(), strict=True), c["lcp"][extra].tolist(), strict=True))
        own = {n: x[~extra] for n, x in c.items()}
        doc, place, lcp = own["doc"].tolist(), own["place"].tolist(), own["lcp"].tolist()
        for i, kind in enumerate(own["how"].tolist()):
            if kind == 2:
                lcp[i] = found[doc[i], place[i]]
            elif kind == 1:
                lcp[i] = lcp[i - 1] - 1
        yield _columns(own, columns[:-1], lcp=np.array(lcp, np.int32))

    return _by_document(fill, both, "doc long, doc_id long, place int, words int, left int, part int, idx long, lcp int")


def sweep(frontier: list, lcps: list[int], positions: list) -> tuple[list[int], list]:
    """One pass in one direction. frontier: (common prefix with what comes next, least position), prefixes and positions rising.

    lcps[i]: common prefix with the one before. For each: the longest prefix with an earlier position before it; then the frontier at the end."""
    out = []
    for shared, position in zip(lcps, positions, strict=True):
        least = None
        while frontier and frontier[-1][0] > shared:
            least = frontier.pop()[1]
        if least is not None and shared and not (frontier and frontier[-1][0] == shared):
            frontier.append((shared, least))
        if not shared:
            frontier.clear()
        while frontier and frontier[-1][1] > position:
            frontier.pop()
        out.append(frontier[-1][0] if frontier else 0)
        frontier.append((1 << 31, position))
    return out, frontier


def merged(frontier: list, shared: int, later: list) -> list:
    """The frontier before a partition, cut to the least prefix in it, with the partition's own on top."""
    out = []
    for prefix, position in frontier:
        prefix = min(prefix, shared)
        if prefix and not (out and out[-1][0] == prefix):
            out.append((prefix, position))
    for prefix, position in later:
        while out and (out[-1][1] > position):
            out.pop()
        if not (out and out[-1][0] >= prefix):
            out.append((prefix, position))
    return out


def earlier_copies(suffixes: DataFrame) -> DataFrame:
    """doc, place, words, copy: length of the longest run from here on that has a copy at an earlier position."""
    spark = suffixes.sparkSession
    rows = staged(suffixes, "lines-suffixes")

    def parts_of(batches):
        """The rows of each part, put together once."""
        held, number = [], None
        for batch in batches:
            part = np.asarray(batch.column(batch.schema.get_field_index("part")))
            if not len(part):
                continue
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and part[a] != number:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                held.append(batch.slice(a, b - a))
                number = part[a]
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def of(batch):
        get = lambda n: batch.column(batch.schema.get_field_index(n)).to_pylist()
        return get("lcp"), list(zip(get("doc_id"), get("doc"), get("place"), strict=True))

    def summary(batches):
        for batch in parts_of(batches):
            lcps, positions = of(batch)
            _, forth = sweep([], lcps, positions)
            _, back = sweep([], [0, *lcps[:0:-1]], positions[::-1])
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(batch.schema.get_field_index("part"))[0].as_py()], pa.int32()), pa.array([lcps[0]], pa.int32()), pa.array([min(lcps[1:], default=1 << 30)], pa.int32()), *(pa.array([[x for p, pos in f for x in (p, *pos)]], pa.list_(pa.int64())) for f in (forth, back))], names=["part", "first", "least", "forth", "back"])

    dealt = rows.repartition("part").sortWithinPartitions("part", "idx")
    stats = dealt.transform(mapped, summary, "part int, first int, least int, forth array<long>, back array<long>").orderBy("part").collect()  # a row for each partition, with at most as many numbers as lines in a run
    unflat = lambda x: [(x[i], tuple(x[i + 1 : i + 4])) for i in range(0, len(x), 4)]
    left, right, now = {}, {}, []
    for s in stats:
        left[s.part] = now
        now = merged(now, min(s.first, s.least), unflat(s.forth))
    now, link = [], 0
    for s in reversed(stats):
        right[s.part] = (now, link)
        now, link = merged([(min(p, link), x) for p, x in now], s.least, unflat(s.back)), s.first
    # each part's frontiers go with its rows, in front of them
    flat = lambda f: [x for p, pos in f for x in (p, *pos)]
    table = [(int(s.part), -1, flat(left[s.part]), flat(right[s.part][0]), right[s.part][1]) for s in stats]
    fronts = staged(spark.createDataFrame(table, "part int, idx long, before array<long>, after array<long>, link int"), "lines-fronts")
    dealt = rows.unionByName(fronts, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", "idx")

    def find(batches):
        for batch in parts_of(batches):
            before, after, link = (batch.column(batch.schema.get_field_index(n))[0].as_py() for n in ("before", "after", "link"))
            before, after = unflat(before), unflat(after)
            batch = batch.slice(1)
            lcps, positions = of(batch)
            forth, _ = sweep(list(before), lcps, positions)
            back, _ = sweep(list(after), [link, *lcps[:0:-1]], positions[::-1])
            copy = [max(a, b) for a, b in zip(forth, reversed(back), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in ("doc", "place", "words")), pa.array(copy, pa.int32())], names=["doc", "place", "words", "copy"])

    return dealt.transform(mapped, find, "doc long, place int, words int, copy int")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, places (of lines that have words) that are in a later copy of a repeated run of at least min_words words."""
    known = staged(lines(docs).drop("line"), "lines")
    # a line occurs more than once if its first place isn't its last
    here = F.struct("doc", "place")
    often = known.groupBy("h1", "h2").agg(F.min(here).alias("low"), F.max(here).alias("high")).filter("low <> high").select(F.col("h1").alias("a"), F.col("h2").alias("b"))
    often = staged(often, "lines-often")
    repeated = known.join(often, (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b")), "left_semi")
    rows = staged(runs_of(repeated, min_words), "lines-repeated")
    if rows.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc long, places array<int>")
    suffixes, rounds = suffix_ranks(rows)
    copies = earlier_copies(common_prefixes(suffixes, rounds))

    def cover(c):
        total = np.concatenate([[0], np.cumsum(c["words"].astype(np.int64))])
        n = len(c["doc"])
        ends = np.arange(n) + c["copy"]
        long_enough = (c["copy"] > 0) & (total[ends] - total[:n] >= min_words)
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, np.flatnonzero(long_enough), 1)
        np.add.at(change, ends[long_enough], -1)
        gone = np.cumsum(change[:n]) > 0
        if gone.any():
            doc, place = c["doc"][gone], c["place"][gone]
            starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(doc[starts]), pa.ListArray.from_arrays(pa.array(np.concatenate([starts, [len(doc)]]), pa.int32()), pa.array(place, pa.int32()))], names=["doc", "places"])

    return _by_document(cover, copies, "doc long, places array<int>")


def without(text: str | None, places: list[int] | None) -> str | None:
    """A text without the lines at these places and the white-space lines right before each of them."""
    if not text or not places:
        return text
    gone, out, blank, k, after = set(places), [], [], 0, False
    for line in text.split("\n"):
        if not line.encode("utf-8", "surrogatepass").split():
            blank.append(line)
            continue
        if k in gone:
            blank, after = [], True
        else:
            out += [*blank, line]
            blank, after = [], False
        k += 1
    return "\n".join(out + ([] if after else blank))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows and columns of docs with later copies deleted from text, n_chars (if there) to match, and removed_lines."""
    gone = staged(later_copies(docs.select("doc_id", "text"), min_words), "lines-gone")
    names = docs.columns
    key, same, places = (unused(x, names) for x in ("key_of", "key_gone", "places_gone"))
    gone = gone.select(F.col("doc").alias(same), F.col("places").alias(places))
    named, others = parted(docs, document_key(), gone.select(same))
    # by merge at every size: the texts of documents that change are dealt once
    joined = named.withColumn(key, document_key()).join(gone.hint("merge"), F.col(key) == F.col(same), "left").select(*names, places)
    text_at = names.index("text")
    chars_at = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in slices_by_bytes(batches, "text", 4 << 20):
            places = batch.column(len(names)).to_pylist()
            texts = [without(t, p) for t, p in zip(column(batch, "text").to_pylist(), places, strict=True)]
            columns = list(batch.columns[: len(names)])
            if chars_at is not None:
                old = columns[chars_at]
                columns[chars_at] = pa.array([len(t) if p and t is not None else o for t, p, o in zip(texts, places, old.to_pylist(), strict=True)], old.type)
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(p or ()) for p in places], pa.int32())], names=[*names, "removed_lines"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return joined.transform(mapped, run, f"{fields}removed_lines int").union(others.withColumn("removed_lines", F.lit(0)))


def deduplicated_rows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """As deduplicated, without the documents of which nothing is left."""
    found = deduplicated(docs, min_words)
    return found.filter((F.col("removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop("removed_lines")
