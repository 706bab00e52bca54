"""Recursion on DataFrames: semi-naive rounds, each cut to files so that plans and retries stay short."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from graphloom.operators.staging import cut


class NotConverged(RuntimeError):
    pass


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: Sequence[str] | None = None, max_rounds: int = 1000, bounded: bool = False) -> DataFrame:
    """The least set that holds seed and is closed under step (linear recursion: step sees the new rows of the last round).

    keys: rows that agree on them are one, and the first found stays (least number of rounds). bounded: stop after
    max_rounds instead of raising."""
    keys = list(keys or seed.columns)
    total = fresh = cut(seed.dropDuplicates(keys))
    for _ in range(max_rounds):
        fresh = cut(step(fresh).select(*seed.columns).dropDuplicates(keys).join(total.select(*keys), keys, "left_anti"))
        if fresh.isEmpty():
            return total
        total = total.union(fresh)
    if bounded:
        return total
    raise NotConverged(f"not settled in {max_rounds} rounds")


def mutual_fixpoint(seeds: Mapping[str, DataFrame], steps: Mapping[str, Callable[[Mapping[str, DataFrame], Mapping[str, DataFrame]], DataFrame]], max_rounds: int = 1000) -> dict[str, DataFrame]:
    """Several relations that recur through each other. Each step gets (all so far, new in the last round).

    For nonlinear rules a step joins the new rows of either side with all of the other. Negation inside the cycle isn't
    allowed: steps may only anti-join relations from outside of it."""
    total = {k: cut(v.distinct(), k) for k, v in seeds.items()}
    fresh = dict(total)
    for _ in range(max_rounds):
        made = {k: cut(step(total, fresh).distinct().join(total[k], total[k].columns, "left_anti"), k) for k, step in steps.items()}
        if all(x.isEmpty() for x in made.values()):
            return total
        fresh = {k: made.get(k, v.limit(0)) for k, v in total.items()}
        total = {k: v.union(made[k]) if k in made else v for k, v in total.items()}
    raise NotConverged(f"not settled in {max_rounds} rounds")


def closure(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Transitive closure of edges (a, b), by doubling: paths join paths, so the rounds are the logarithm of the longest."""
    from pyspark.sql import functions as F

    total = cut(edges.select("a", "b").distinct(), "closure")
    fresh = total
    for _ in range(max_rounds):
        ahead = fresh.alias("x").join(total.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")
        behind = total.alias("x").join(fresh.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")
        fresh = cut(ahead.union(behind).distinct().join(total, ["a", "b"], "left_anti"), "closure")
        if fresh.isEmpty():
            return total
        total = total.union(fresh)
    raise NotConverged(f"not settled in {max_rounds} rounds")
