"""Type hierarchies: precedence order, member lookup with hiding, overrides, structural satisfaction, containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.fixpoint import fixpoint


def ancestors(parents: DataFrame, max_depth: int = 1000) -> DataFrame:
    """type, ancestor, depth (least) over (type, parent); cycles end."""
    steps = parents.select(F.col("type").alias("s"), "parent").distinct()
    seed = parents.select("type", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    return fixpoint(seed, lambda x: x.join(steps, F.col("ancestor") == F.col("s")).select("type", F.col("parent").alias("ancestor"), (F.col("depth") + 1).alias("depth")), ["type", "ancestor"], max_depth)


def lookup(members: DataFrame, parents: DataFrame) -> DataFrame:
    """type, name, owner, depth, tied: the nearest declaration that a type sees; tied if two owners are as near."""
    own = members.select(F.col("owner").alias("type"), "name", "owner", F.lit(0).alias("depth"))
    inherited = ancestors(parents).join(members, F.col("ancestor") == F.col("owner")).select("type", "name", "owner", "depth")
    near = Window.partitionBy("type", "name").orderBy("depth")
    found = own.union(inherited).distinct().withColumn("r", F.rank().over(near)).filter("r = 1").drop("r")
    return found.withColumn("tied", F.count("*").over(Window.partitionBy("type", "name")) > 1)


def overrides(members: DataFrame, parents: DataFrame) -> DataFrame:
    """base_owner, owner, name, arity: a method that an ancestor declares with the same name and arity."""
    base = members.select(F.col("owner").alias("base_owner"), "name", "arity")
    return ancestors(parents).join(members, F.col("type") == F.col("owner")).join(base, ["name", "arity"]).filter(F.col("ancestor") == F.col("base_owner")).select("base_owner", "owner", "name", "arity").distinct()


ORDER = """
.decl slot(type: symbol, position: number, base: symbol) .input slot
.decl above(type: symbol, base: symbol)
above(t, b) :- slot(t, _, b), t != b.
above(t, b) :- above(t, m), slot(m, _, b), t != b.
// a type comes before its bases, a base before those that it has itself and, of one type, those written after it
.decl before(type: symbol, a: symbol, b: symbol)
before(t, t, b) :- above(t, b).
before(t, a, b) :- above(t, a), above(a, b).
before(t, a, b) :- slot(t, p, a), slot(t, q, b), p < q.
before(t, a, b) :- above(t, m), before(m, a, b).
before(t, a, c) :- before(t, a, b), before(t, b, c).
.decl incomparable(type: symbol, a: symbol, b: symbol)
incomparable(t, a, b) :- above(t, a), above(t, b), a < b, !before(t, a, b), !before(t, b, a).
incomparable(t, a, b) :- before(t, a, b), before(t, b, a), a < b.
.decl open(type: symbol) open(t) :- incomparable(t, _, _).
.decl place(type: symbol, base: symbol, rank: number)
place(t, b, n) :- before(t, t, b), !open(t), n = count : { before(t, _, b) }.
place(t, t, 0) :- slot(t, _, _), !open(t).
"""


def precedence(slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(type, base, rank) where the order of a type's bases is total, itself first; (type, a, b) of pairs that nothing orders.

    slots: type, position, base. The order is what inheritance and the written order of bases imply, closed transitively;
    a type with a pair that stays open, or that is ordered both ways, has no ranks."""
    from graphloom.rules.solve import solve

    found = solve(slots.sparkSession, ORDER, {"slot": slots.select("type", "position", "base")}, ["place", "incomparable"])
    return found["place"], found["incomparable"]


def satisfies(required: DataFrame, declared: DataFrame) -> DataFrame:
    """contract, type: types that declare every (name, arity) a contract asks for."""
    need = required.select("contract", "name", "arity").distinct()
    wanted = need.groupBy("contract").agg(F.count("*").alias("wanted"))
    held = need.join(declared.select("type", "name", "arity").distinct(), ["name", "arity"]).groupBy("contract", "type").agg(F.count("*").alias("held"))
    return held.join(wanted, "contract").filter("held = wanted").select("contract", "type")


def direct_parents(spans: DataFrame) -> DataFrame:
    """id, parent: the smallest span of one file that strictly holds another (file, id, low, high).

    A file's spans in order of their beginning, longer ones first: a stack of the spans that are still open holds the parent.
    No span meets all others; spans that cross are no parents of each other."""
    import pyarrow as pa

    kind = spans.schema["id"].dataType.simpleString()

    def run(batches):
        file, open_ = None, []
        for batch in batches:
            ids, parents = [], []
            for f, i, low, high in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if f != file:
                    file, open_ = f, []
                while open_ and open_[-1][2] < low:
                    open_.pop()
                # the smallest open span that ends no earlier and isn't the same one
                parent = min((o for o in open_ if o[2] >= high and (o[1], o[2]) != (low, high)), key=lambda o: (o[2] - o[1], -o[1]), default=None)
                if parent:
                    ids.append(i)
                    parents.append(parent[0])
                open_.append((i, low, high))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(1).type), pa.array(parents, batch.schema.field(1).type)], names=["id", "parent"])

    dealt = spans.select("file", "id", "low", "high").distinct().repartition("file").sortWithinPartitions("file", "low", F.desc("high"), F.desc("id"))
    return dealt.mapInArrow(run, f"id {kind}, parent {kind}")


def virtual_targets(calls: DataFrame, overriding: DataFrame, instantiated: DataFrame | None = None) -> DataFrame:
    """site, target owner: the receiver's own method and what overrides it; with instantiated only in constructed types."""
    below = overriding.select(F.col("base_owner").alias("receiver"), F.col("owner").alias("target"), "name", "arity")
    if instantiated is not None:
        below = below.join(instantiated.select(F.col("type").alias("target")), "target", "left_semi").select("receiver", "target", "name", "arity")
    return calls.select("site", F.col("receiver").alias("target")).union(calls.join(below, ["receiver", "name", "arity"]).select("site", "target")).distinct()
