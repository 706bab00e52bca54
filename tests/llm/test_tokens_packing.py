import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
from graphloom.llm import ans, packing, tokens

SIGNS = ["a", "B", " ", "  ", "\n", "\t", "'s", "é", "¦", "!", "1", "23", "\x1c", "\xa0", "İ", "Σ", "<|endoftext|>", ",", ".", "J", ".\n", ",\n\n", "a.", "z,\nB", "\x02", "...", "̌", "\x85", ". ", "日本"]
FILES = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}


@pytest.mark.parametrize("kind", FILES)
def test_ids_equal_the_library(kind):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 30))) for _ in range(800)] + [None, "", " ", "x" * 5000]
    e = tokens.encoder(kind, tokens.default_path(FILES[kind]))
    ids, starts = e.ids(pa.array(texts, pa.string()))
    for i, want in enumerate(e.whole([t or "" for t in texts])):
        assert np.array_equal(want, ids[starts[i] : starts[i + 1]]), texts[i]


def test_table_is_bounded():
    e = tokens.ByteEncoder(tokens.default_path(FILES["byte"]), table_bytes=2000)
    for k in range(5):
        e.ids(pa.array([f"w{k} x{k} y{k} z{k} a b c d"]))
    assert len(e.place) <= 30
    e.ids(pa.array(["x" * 1000 + " y"]))
    e.ids(pa.array(["y"]))
    assert max(map(len, e.place)) < 1000  # a long piece stays for one batch


DOCS = [(1, "one two three " * 300, "a"), (2, None, "a"), (3, "", None), (4, "x", "b"), (4, "x", "b"), (5, "hello, world! " * 900, "b"), (6, "end", None)]


def ids_of(kind, text, end):
    e = tokens.encoder(kind, tokens.default_path(FILES[kind]))
    return np.concatenate([e.whole([text or ""])[0], [end]]).astype("<u4")


@pytest.mark.parametrize("weights", [None, {"a": 3, "b": 1}])
def test_packing_keeps_every_token_once(spark, weights):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, source string").selectExpr("*", "0 AS part", "'x' AS ids")
    got = packing.pack(df, weights=weights, group_windows=2).toPandas()
    by_id = {}
    for d, t, _ in DOCS:
        by_id.setdefault(d, []).append(ids_of("byte", t, 0))
    for r in got.itertuples():
        assert any(r.ids == x[r.start : r.start + r.length].tobytes() for x in by_id[r.doc_id])
        assert r.doc_tokens == len(by_id[r.doc_id][0])
    assert got.length.sum() == sum(len(x) for v in by_id.values() for x in v)
    for d, v in by_id.items():
        own = got[got.doc_id == d].sort_values("start")
        assert sorted(own.start.tolist() + [len(v[0])] * len(v)) == sorted([0] * len(v) + (own.start + own.length).tolist())
    sizes = got.groupby("sequence_id").length.sum()
    assert (sizes.sort_index()[:-1] == 1024).all() and sorted(sizes.index) == list(range(len(sizes)))
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset == s.length.cumsum() - s.length).all()


def test_packing_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_shares_are_exact_and_never_go_back():
    for weights in (None, [1, 1, 1, 0, 0, 5]):
        s = packing.Shares([1000, 10, 333, 7, 0, 5000], weights)
        before = [0] * 6
        for upto in range(s.total + 1):
            now = [s.taken(j, upto) for j in range(6)]
            assert sum(now) == upto and all(a >= b for a, b in zip(now, before, strict=True))
            before = now
        for j, total in enumerate([1000, 10, 333, 7, 0, 5000]):
            for p in range(0, total, 97):
                g = s.group(j, p, 256)
                assert s.taken(j, g * 256) <= p < s.taken(j, (g + 1) * 256)


def test_round_robin_holds_proportions():
    rnd = random.Random(3)
    queues = [[rnd.randint(1, n) for _ in range(n)] for n in (600, 200, 100, 1, 7)]
    total, amounts = sum(map(sum, queues)), [sum(q) for q in queues]
    got = list(zip(*(c.tolist() for c in packing.fill([np.array(q) for q in queues], 1024)), strict=True))

    def split(tokens, low, high):  # the same robin, one window after the other, by hand
        if high - low == 1:
            return [tokens]
        half, both = 1, sum(amounts[low:high])
        while half * 2 < high - low:
            half *= 2
        left = tokens * sum(amounts[low : low + half]) // both if both else 0
        return split(left, low, low + half) + split(tokens - left, low + half, high)

    starts = [sum(map(len, queues[:j])) for j in range(len(queues))]
    want, head, inside, before = [], [0] * 5, [0] * 5, [0] * 5
    for w in range(-(-total // 1024)):
        offset, now = 0, split(min((w + 1) * 1024, total), 0, 5)
        for j in range(5):
            owed = now[j] - before[j]
            assert abs(now[j] - min((w + 1) * 1024, total) * amounts[j] / total) <= 3  # of every window, to a token a level
            while owed:
                take = min(owed, queues[j][head[j]] - inside[j])
                want.append((starts[j] + head[j], inside[j], take, w, offset))
                owed, offset, inside[j] = owed - take, offset + take, inside[j] + take
                if inside[j] == queues[j][head[j]]:
                    head[j], inside[j] = head[j] + 1, 0
        before = now
    assert got == want


@pytest.mark.parametrize("weights", [None, {"a": 3, "b": 1}])
def test_every_window_holds_the_targets(spark, weights):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["the", "cat", "sat", "mat"]) for _ in range(rnd.randint(1, 400))), rnd.choice("aab")) for i in range(300)]
    source = dict((r[0], r[2]) for r in rows)
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), weights=weights, group_windows=3).toPandas()
    got["source"] = got.doc_id.map(source)
    sums = got.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0)
    total = sums.sum()
    share = total / total.sum() if weights is None else {"a": 0.75, "b": 0.25}
    full = sums[(sums.cumsum()["a"] < total["a"]) & (sums.cumsum()["b"] < total["b"])]  # until a source is empty
    assert len(full) > 5 and all((full[s] - 1024 * share[s]).abs().max() <= 4 for s in "ab")


def test_rans_round_trip_and_checksum():
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 150_000) % 40_000
    freq = ans.quantised(np.bincount(ids, minlength=49_408))
    assert freq.sum() == ans.TOTAL and (freq[np.unique(ids)] > 0).all()
    blocks = [ids[:70_000].astype(np.uint32), ids[:1].astype(np.uint32), ids[70_000:].astype(np.uint32), np.full(300, ids[0], np.uint32)]
    made = ans.encode_blocks(blocks, freq)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, ans.decode_blocks(made, freq), strict=True))
    assert len(made[0]) < 1.1 * 70_000 * 2
    with pytest.raises(ValueError):
        ans.decode_blocks([made[0][:-9] + bytes([made[0][-9] ^ 1]) + made[0][-8:]], freq)


def test_stored_set_is_in_order(spark):
    df = spark.createDataFrame([(9, "b c"), (None, "null id"), (2, None), (5, "tie"), (5, "tie"), (7, "long " * 70_000)], "doc_id long, text string")
    got = ans.round_trip(df).toPandas().sort_values("start")
    assert got.start.tolist() == (got.n_tokens.cumsum() - got.n_tokens).tolist()
    ids = [None if x != x else int(x) for x in got.doc_id]
    assert ids == [None, 2, 5, 5, 7, 9]
    texts = {None: "null id", 2: None, 5: "tie", 7: "long " * 70_000, 9: "b c"}
    assert all(zlib.crc32(bytes(x)) == zlib.crc32(ids_of("word", texts[i], 1).tobytes()) for i, x in zip(ids, got.ids, strict=True))


def test_stored_set_of_nothing(spark):
    assert ans.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0
