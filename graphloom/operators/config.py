"""Key spaces: values with placeholders resolved through other keys, and what depends on a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import placeholders
from graphloom.operators.fixpoint import fixpoint


def resolved(values: DataFrame) -> DataFrame:
    """source, key, value, open: values (source, key, value) with one placeholder after the other replaced; open: some are left.

    A key of the same source wins; a placeholder without a value takes its default; one whose key needs itself stays open.
    All others end, so rounds go on until nothing changes."""
    from graphloom.operators.fixpoint import closure
    from graphloom.operators.staging import cut

    known = cut(values.groupBy("source", "key").agg(F.min("value").alias("v")), "keys")
    name = lambda key: F.concat("source", F.lit("\n"), key)
    needs = known.select(name(F.col("key")).alias("a"), "source", F.explode(placeholders(F.col("v"))).alias("on")).select("a", name(F.col("on")).alias("b"))
    cyclic = cut(closure(needs).filter("a = b").select(F.col("a").alias("cyclic")).distinct(), "cyclic")
    usable = cut(known.join(cyclic, name(F.col("key")) == F.col("cyclic"), "left").select("source", F.col("key").alias("asked"), "v", F.col("cyclic").isNotNull().alias("turns")), "usable")
    now = cut(values.select("source", "key", "value", F.lit(0).alias("done")))
    while True:
        # the first placeholder that isn't known to stay
        left = F.substring("value", F.col("done") + 1, 1 << 30)
        text = F.regexp_extract(left, r"(\$\{([^}:]+)(?::[^}]*)?\})", 1)
        pending = now.withColumn("text", text).withColumn("asked", F.when(F.col("text") != "", F.regexp_extract("text", r"\$\{([^}:]+)", 1)))
        if pending.filter("asked IS NOT NULL").isEmpty():
            break
        found = pending.join(usable, ["source", "asked"], "left")
        default = F.when(F.col("text").contains(":"), F.regexp_extract("text", r"\$\{[^}:]+:([^}]*)\}", 1))
        instead = F.when(F.coalesce("turns", F.lit(False)), F.lit(None).cast("string")).otherwise(F.coalesce("v", default))
        at = F.expr("locate(text, value, done + 1)")
        changed = F.concat(F.expr("substring(value, 1, locate(text, value, done + 1) - 1)"), instead, F.expr("substring(value, locate(text, value, done + 1) + length(text))"))
        stays = F.col("asked").isNotNull() & instead.isNull()
        now = cut(found.select("source", "key", F.when(F.col("asked").isNull() | stays, F.col("value")).otherwise(changed).alias("value"), F.when(stays, at - 1 + F.length("text")).otherwise(F.col("done")).cast("int").alias("done")))
    return now.select("source", "key", "value", (F.size(placeholders(F.col("value"))) > 0).alias("open"))


def depends(values: DataFrame, max_depth: int = 3) -> DataFrame:
    """key, on, depth: keys whose value needs another key's, directly or through others."""
    direct = values.select("key", F.explode(placeholders(F.col("value"))).alias("on")).distinct()
    steps = direct.select(F.col("key").alias("on"), F.col("on").alias("next"))
    return fixpoint(direct.withColumn("depth", F.lit(1)), lambda x: x.join(steps, "on").select("key", F.col("next").alias("on"), (F.col("depth") + 1).alias("depth")), ["key", "on"], max_depth - 1, bounded=True)


def three_states(conditions: DataFrame, values: DataFrame) -> DataFrame:
    """name, state of conditions (name, key, wanted): selected, excluded, or undecided where the key has no value."""
    held = values.groupBy("key").agg(F.min("value").alias("value"))
    state = F.when(F.col("value").isNull(), "undecided").when(F.col("value") == F.col("wanted"), "selected").otherwise("excluded")
    return conditions.join(held, "key", "left").select("name", state.alias("state"))
