import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline

BASE = "the cat sat on the mat and looked at the {} for a very long while before it went home"


def documents(spark, tmp_path):
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        text = "\n".join((BASE if lang == "en" else "der hund und die katze gehen heute {} in das grosse haus am rand der stadt").format(f"x{i}y{k}") for k in range(4))
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    shared = "this very line of well over eight words stands in two of the documents"
    rows += [(100, rows[1][1], "en", "s1", 1), (101, f"{shared}\nown words of the document one hundred and one", "en", "s1", 1), (102, f"{shared}\nother words of the document one hundred and two", "en", "s2", 1), (103, None, "en", "s2", 0), (104, "12 34 !!", "en", "s2", 8), (105, "", None, None, 0)]
    rows.append(rows[-4])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    return spark.read.parquet(str(tmp_path / "documents.parquet"))


def test_stages_take_effect(spark, tmp_path):
    docs = documents(spark, tmp_path)
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"out-{name}"))
        docs = spark.read.parquet(str(tmp_path / f"out-{name}"))
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
    ids = {name: sorted(r.doc_id for r in df.select("doc_id").collect()) for name, df in seen.items()}
    assert {103, 104, 105}.isdisjoint(ids["language"]) and set(range(60)) <= set(ids["language"])
    assert 100 not in ids["line_dedup"] and set(range(60)) <= set(ids["line_dedup"])
    texts = {r.doc_id: r.text for r in seen["line_dedup"].collect()}
    assert texts[101].startswith("this very line") and texts[102] == "other words of the document one hundred and two"
    assert len(ids["near_duplicates"]) == len(set(ids["near_duplicates"])) and set(ids["near_duplicates"]) <= set(ids["line_dedup"])
    assert set(ids["mix"]) <= set(ids["near_duplicates"])
    pieces = seen["pack"].toPandas()
    assert sorted(set(pieces.doc_id)) == sorted(set(ids["mix"])) and (pieces.groupby("sequence_id").length.sum() <= 1024).all()


def test_run(spark, tmp_path):
    documents(spark, tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_on_odd_rows(spark):
    odd = [(None, "ein satz ohne nummer aber mit genug worten", "de", None, 1, 1, "x"), (1, None, None, None, None, None, None), (2, "", "en", "s", 0, 2, "y"), (3, "the same words again and again", "en", "s", 9, 3, "z"), (3, "the same words again and again", "en", "s", 9, 3, "z"), (4, "word " * 50_000, "en", "t", 250_000, 4, None)]
    df = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, row_at int, key_of string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (df, df.limit(0)):
            got = stage(spark, docs, "")
            assert got.columns == df.columns, name
            assert got.count() >= (0 if docs is not df or name == "language" else 3), name
    assert corpus_pipeline.near_duplicates(spark, df, "").filter("doc_id = 3").count() == 1
    pieces = corpus_pipeline.pack(spark, df, "").toPandas()
    assert pieces.length.sum() == pieces.drop_duplicates("doc_id").doc_tokens.sum() + pieces[pieces.doc_id == 3].doc_tokens.iloc[0]
    assert corpus_pipeline.pack(spark, df.limit(0), "").count() == 0


def test_stages_begin_without_the_garbage_of_the_one_before(spark, monkeypatch):
    beans = [b for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName()]
    full = lambda: sum(b.getCollectionCount() for b in beans)
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    pieces = spark.createDataFrame([], "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    for module, name in ((corpus_pipeline.langid, "identified"), (corpus_pipeline.linededup, "deduplicated_rows"), (corpus_pipeline.simhash, "one_of_each"), (corpus_pipeline.mixing, "mixed_documents")):
        monkeypatch.setattr(module, name, lambda docs: docs)
    monkeypatch.setattr(corpus_pipeline.packing, "pack", lambda docs, table_bytes: pieces)
    for name, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, docs, "")
        assert full() > before, name
