import random

import pytest

from graphloom.llm import linededup


def brute(docs, min_words):
    lines = {(i, k): tuple(x.split()) for i, t in docs for k, x in enumerate([x for x in (t or "").split("\n") if x.split()])}
    order, gone = sorted(lines), {}
    for a, (i, k) in enumerate(order):
        best = 0
        for j, m in order[:a]:
            n = 0
            while lines.get((i, k + n)) is not None and lines.get((i, k + n)) == lines.get((j, m + n)):
                n += 1
            best = max(best, n)
        if sum(len(lines[i, k + n]) for n in range(best)) >= min_words:
            for n in range(best):
                gone.setdefault(i, set()).add(k + n)
    return gone


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    voc = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 4))) for _ in range(12)] + [""]
    docs = []
    for i in range(40):
        if docs and rnd.random() < 0.4:
            t = rnd.choice(docs)[1].split("\n")
            a = rnd.randint(0, len(t))
            t = t[a : a + rnd.randint(1, 15)] + [rnd.choice(voc) for _ in range(rnd.randint(0, 4))] + [f"unique {i}"]
        else:
            t = [rnd.choice(voc) if rnd.random() < 0.8 else f"own {i} {k}" for k in range(rnd.randint(0, 14))]
        docs.append((i, "\n".join(t)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    key = {r.k: r.doc_id for r in df.select(linededup.document_key().alias("k"), "doc_id").collect()}
    assert {key[r.doc]: set(r.places) for r in linededup.later_copies(df, 5).collect()} == brute(docs, 5)


def test_sweep_over_cut_partitions():
    rnd = random.Random(5)
    for _ in range(200):
        n = rnd.randint(2, 12)
        lcps, pos = [0] + [rnd.randint(0, 4) for _ in range(n - 1)], rnd.sample(range(100), n)
        whole, _ = linededup.sweep([], lcps, pos)
        cut = rnd.randint(1, n - 1)
        _, first = linededup.sweep([], lcps[:cut], pos[:cut])
        second, end = linededup.sweep(list(first), lcps[cut:], pos[cut:])
        assert whole[cut:] == second
        alone = linededup.sweep([], lcps[cut:], pos[cut:])[1]
        assert [x for x in linededup.merged(first, min(lcps[cut:]), alone)] == [x for x in end if x[0]]
        for i in range(n):
            best = max((min(lcps[j + 1 : i + 1]) for j in range(i) if pos[j] < pos[i]), default=0)
            assert whole[i] == best


def test_edges(spark):
    run = "one two three four five\nsix seven eight nine ten"
    rows = [(1, f"{run}\nown line of the first", 5, "u"), (2, f"intro words here\n\n{run}\n\nlast", 5, "u"), (3, None, None, "u"), (4, "", 0, "u"), (5, run, 5, "u"), (5, run, 5, "u"), (None, f"{run}\nnull id", 7, "u"), (2**60 + 1, f"big id\n{run}", 7, "u"), (8, "short\nshort\nshort", 1, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, doc string")
    got = {r.doc_id: r for r in linededup.deduplicated(df).collect()}
    assert got[None].text == rows[6][1] and got[2**60 + 1].text == "big id"
    assert got[1].text == "own line of the first" and got[2].text == "intro words here\n\nlast" and got[2].n_chars == len(got[2].text)
    assert got[3].text is None and got[4].text == "" and got[5].text == "" and got[8].text == rows[8][1]
    assert linededup.deduplicated_rows(df).count() == 7
    assert linededup.deduplicated(df.limit(0)).count() == 0


def test_long_texts_clashing_names_and_scripts_without_blanks(spark):
    run = "\n".join(f"line number {k} of a very long table that was dumped twice" for k in range(3000))
    kanji = "漢字" * 80
    rows = [(1, run, 7, "a", 1), (2, f"own\n{run}\nend", 8, "b", 2), (3, f"x\n{kanji}\ny", 9, "c", 3), (4, f"z\n{kanji}", 9, "d", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key_of int, places_gone string, doc int")
    got = {r.doc_id: r for r in linededup.deduplicated(df).collect()}
    assert got[1].text == run and got[2].text == "own\nend" and got[2].removed_lines == 3000
    assert got[3].text == rows[2][1] and got[4].text == "z"  # one word, but a long one
    assert [got[i].key_of for i in (1, 2, 3, 4)] == [7, 8, 9, 9] and got[4].places_gone == "d" and got[2].doc == 2
