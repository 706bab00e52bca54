import os

import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing

DATA = "/root/testdata/sf0.01"


def water(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, list(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if w[s] * level > most * sizes[s]]
        if not over:
            target |= {s: w[s] * level for s in free}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def test_targets_and_budgets(spark):
    rows = [(i, "w " * (i % 37), ["a", "b", "c", None, "hot", "hot"][i % 6], "x") for i in range(600)] + [(None, "null id words", "a", "x"), (700, None, "b", "x"), (701, "", "empty", "x"), (3, "w w w", "c", "x"), (3, "w w w", "c", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, h string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 5
        assert all(0 <= r.taken <= 2 * r.size for r in own)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)


def test_documents_of_the_mix(spark):
    rows = [(i, "w " * 10, "ab"[i % 2], "keep") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __s string")
    got = mixing.mixed_documents(df.drop("__s"))
    assert got.columns == ["doc_id", "text", "source"]
    by = {r.source: r.n for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    want = water({"a": 2000, "b": 2000})
    assert all(abs(by[s] * 10 - want[s]) <= 10 for s in by)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0 and mixing.mixed_documents(df).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    want = duckdb.sql(mixing.oracle(f"'{DATA}/documents.parquet'")).fetchall()
    got = mixing.mix(spark.read.parquet(f"{DATA}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_clashing_names_and_long_texts(spark):
    rows = [(i, "w " * (5 if i else 300_000), "ab"[i % 2], i, "x", "y") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, of_source int, copies string, edge string")
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns and {r.of_source for r in got.collect()} <= set(range(40))
    sizes = {r.doc_id: r.size for r in mixing.mix(df).collect()}
    assert sizes[0] == 300_000 and sizes[1] == 5
