import numpy as np
import pytest

from graphloom.llm import permindex


def exact(ids, v, q, k):
    cos = (v * v[q]).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((v[q] * v[q]).sum()))
    other = np.flatnonzero(ids != ids[q])
    return [int(ids[i]) for i in other[np.lexsort((ids[other], -cos[other]))][:k]], cos


def test_footrule_equals_its_definition():
    rng = np.random.default_rng(0)
    raw, pivots = rng.normal(size=(40, 6)), permindex.unit(rng.normal(size=(12, 6)))
    seen = permindex.orders(permindex.unit(raw), pivots, 5)
    wanted = permindex.orders(permindex.unit(rng.normal(size=(3, 6))), pivots, 8)
    place = lambda o, p: list(o).index(p) if p in o else 8
    assert permindex.footrule(wanted, seen, 12).tolist() == [[sum(abs(place(w, p) - j) for j, p in enumerate(s)) for s in seen] for w in wanted]


@pytest.mark.parametrize("crowded", [False, True])
def test_recall(spark, crowded, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 32)).astype(np.float32)
    if crowded:
        v[::3] = v[0] + 0.05 * rng.normal(size=v[::3].shape)
        v[1::30] = v[1]
    df = spark.createDataFrame([(i, x.tolist(), "x") for i, x in enumerate(v)], "vec_id long, embedding array<float>, id string")
    got = permindex.search(df.repartition(3), df.filter("vec_id % 50 = 0")).collect()
    monkeypatch.setattr(permindex, "BLOCK", 100)  # files in several blocks, queries in parts
    monkeypatch.setattr(permindex, "QUERY_BLOCK", 7)
    parts = permindex.search(df.repartition(7), df.filter("vec_id % 50 = 0"), share=1.0).collect()
    monkeypatch.undo()
    whole = permindex.search(df, df.filter("vec_id % 50 = 0"), share=1.0).collect()
    assert sorted(map(tuple, parts)) == sorted(map(tuple, whole))  # in any layout
    hits, v, ids = 0, v.astype(float), np.arange(3000)
    for q in range(0, 3000, 50):
        want, cos = exact(ids, v, q, 5)
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        assert all(abs(s - cos[i]) < 1e-12 for _, i, s in own)
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        hits += len({i for _, i, _ in own} & set(want))
    assert hits / 300 >= 0.9


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [2.0, 0.0]), (7, [2.0, 0.0]), (50, [0.0, 1.0]), (None, [1.0, 1.0]), (100, []), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.rank): r.vec_id for r in permindex.search(df, df.filter("vec_id % 50 = 0")).collect()}
    assert got == {(0, 1): 6, (0, 2): 7, (0, 3): 50, (50, 1): 0, (50, 2): 6, (50, 3): 7}
    assert permindex.search(df.limit(0), df.limit(0)).count() == 0
    far = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1e200, 0.0]), (3, [5e-324, 0.0]), (4, [1.0, -1.0])]
    df = spark.createDataFrame(far, "vec_id long, embedding array<double>")
    got = [(r.vec_id, round(r.score, 12)) for r in permindex.search(df, df.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, round(0.5**0.5, 12)), (3, round(0.5**0.5, 12)), (4, 0.0)]


def test_recall_of_the_query(spark):
    from graphloom.llm import queries

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in queries.op10_permutation_search(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.flatnonzero(ids % 50 == 0)
    assert sorted(got) == sorted(ids[asked].tolist())
    assert sum(len(got[int(ids[q])] & set(exact(ids, v, q, 5)[0])) for q in asked) >= 0.9 * 5 * len(asked)
