import random

import corpus_pipeline
from graphloom.llm import nearcopies, simhash


def texts():
    rnd = random.Random(5)
    base = [[f"w{rnd.randrange(3000)}" for _ in range(n)] for n in (3, 60, 60, 120, 300, 300)]
    rows = []
    for k in range(150):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 6, 12])):
            at = rnd.randrange(len(words))
            words[at : at + rnd.randrange(2)] = [f"n{rnd.randrange(10**6)}"]
        rows.append((k, " ".join(words)))
    rows += [(500 + k, f"text of its own number {k} which is like no other {k * k}") for k in range(40)]
    return rows + [(3, "another version of the row whose id is three"), (None, rows[7][1].upper()), (None, "without an id"), (None, "without an id"), (700, None), (701, ""), (702, " \n")]


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def near(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_no_two_near_copies_stay_and_none_goes_without_one(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int").select("doc_id", "text")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert len(got) == len(set(got)) and set(got) <= set(rows)
    own = [(i, sets(t)) for i, t in got]
    assert not [1 for k, (_, a) in enumerate(own) for _, b in own[:k] if near(a, b)]
    for i, t in set(rows) - set(got):
        assert any(near(sets(t), b) and (i is None or j is not None and j <= i) for j, b in own), (i, t)
    assert (3, "another version of the row whose id is three") in got and (None, "without an id") in got


def test_large_components_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "PART", 8)
    words = [f"u{k}" for k in range(60)]
    rows = [(k, " ".join([*words, f"end{k}"]), k, k) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_at int, gone_at int")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns and [r.doc_id for r in got.collect()] == [0]


def test_one_changed_word_goes(spark):
    words = [f"u{k}" for k in range(100)]
    other = [*words[:50], "changed", *words[51:]]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()] == [1]
    assert simhash.one_of_each(df.limit(0)).count() == 0
