import numpy as np
import xxhash

from graphloom.llm import components, simhash


def fingerprint(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()]
    if not words:
        return 0
    made = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in made]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_index_finds_exactly_the_near_pairs():
    rng = np.random.default_rng(0)
    fps = []
    for b in rng.integers(0, 2**63, 30).tolist():
        for _ in range(30):
            x = b
            for k in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                x ^= 1 << k
            fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    got = {p for i, j in simhash.near_pairs(fps) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(int(fps[i] ^ fps[j])).count("1") <= 3}


def test_gray_neighbours_differ_in_one_bit():
    ranks = np.arange(64, dtype=np.uint64)
    codes = ranks ^ (ranks >> np.uint64(1))
    assert np.array_equal(simhash.gray_rank(codes), ranks)


def near_texts():
    rng = np.random.default_rng(4)
    base = " ".join(f"w{k}" for k in rng.integers(0, 5000, 3000))
    rows = [(i, base + (" extra" * (i % 3)) + ("" if i < 40 else f" {i}"), "x") for i in range(60)]
    rows += [(100 + i, " ".join(f"u{k}" for k in rng.integers(0, 900, 30)), "x") for i in range(40)]
    return rows + [(200, None, "x"), (201, "", "x"), (202, " \n", "x"), (203, "Two words", "x"), (204, "two WORDS", "x"), (204, "two WORDS", "x"), (205, "É é", "x"), (206, "é é", "x")]


def groups(rows):
    fps = [fingerprint(t) for _, t, _ in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return fps, [min(r[0] for r, x in zip(rows, label, strict=True) if x == own) for own in label]


def test_equals_brute_force(spark, monkeypatch):
    rows = near_texts()
    fps, comps = groups(rows)
    want = sorted((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, comps, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    assert sorted(map(tuple, simhash.near_duplicates(df).collect())) == want
    monkeypatch.setattr(simhash, "LARGE", 2)  # groups that are split, again and again, find the same
    assert sorted(map(tuple, simhash.near_duplicates(df).collect())) == want


def test_index_of_real_fingerprints_prunes_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fps = np.unique(np.array([r.fp for r in simhash.fingerprints(docs).select("fp").collect()], np.int64)).view(np.uint64)
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    place = {int(f): i for i, f in enumerate(fps)}
    found, seen = set(), {}
    for mask in simhash.quarters(0):  # as in the query: the block comes first, pairs must agree on it
        own = fps[np.argsort(simhash.gray_rank(simhash.turned(fps, mask)))]
        assert len(simhash.index_levels(own)) >= 2
        found |= {tuple(sorted((place[int(own[x])], place[int(own[y])]))) for i, j in simhash.near_pairs(own, mask, seen=seen) for x, y in zip(i, j, strict=True)}
    assert seen["pruned"] > 0.5 * seen["compared"]
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    assert found == {(i, j) for i, j in np.argwhere(near).tolist() if i < j}


def test_no_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, None)], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 2
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 199), (200, 199)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {199: 199, 200: 199}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
