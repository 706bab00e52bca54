import pytest
from pyspark.sql import functions as F

from graphloom import schemas
from graphloom.sources import tables
from graphloom.streaming import refresh


def test_raw_tsv_counts_torn_rows(spark, tmp_path):
    (tmp_path / "x.tsv").write_text('a\t1\nb\t2\t3\n"c\t\n')
    good, torn = tables.read_raw_tsv(spark, str(tmp_path / "x.tsv"), ["n", "v"])
    assert sorted(map(tuple, good.collect())) == [('"c', ""), ("a", "1")] and torn.first()[0] == 1


def test_headered_tsv(spark, tmp_path):
    (tmp_path / "x.tsv").write_text('n\tv\n"a\tb"\t1\n')
    assert tables.read_headered_tsv(spark, str(tmp_path / "x.tsv")).collect()[0].n == "a\tb"


def test_properties(spark, tmp_path):
    (tmp_path / "a.properties").write_text("# note\nk = v\nlong: x\\\n  y\n\n! n\nflag\n")
    got = {r.key: r.value for r in tables.read_properties(spark, str(tmp_path / "a.properties")).collect()}
    assert got == {"k": "v", "long": "xy", "flag": ""}


def test_python_facts(spark):
    df = spark.createDataFrame([("a.py", "import os\nclass A(B):\n  def f(self):\n    return g(1)\n"), ("bad.py", "def (")], "path string, content string")
    got = {(r.file_path, r.kind, r.name, r.owner) for r in tables.python_facts(df).collect()}
    assert {("a.py", "import", "os", ""), ("a.py", "class", "A", ""), ("a.py", "base", "B", "A"), ("a.py", "function", "f", "A"), ("a.py", "call", "g", "A.f")} <= got
    assert any(k == ("bad.py", "skipped") for k in {g[:2] for g in got})


def test_absent_values_and_drift(spark):
    df = spark.createDataFrame([("",), ("-",), ("x",), ("7",)], "v string")
    assert [tuple(r) for r in df.select(schemas.absent_to_null(F.col("v")), schemas.fact_int(F.col("v"))).collect()] == [(None, None), (None, None), ("x", None), ("7", 7)]
    with pytest.raises(schemas.SchemaDrift):
        schemas.require(df, "missing")


def test_refresh_swaps_versions(spark, tmp_path):
    src, facts, out = (str(tmp_path / n) for n in ("in", "facts", "graph"))
    spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string").write.parquet(src)
    from graphloom.operators.fixpoint import closure

    stream = spark.readStream.schema("a string, b string").parquet(src)
    refresh.refresh(stream, facts, out, closure, ["a", "b"], str(tmp_path / "cp")).awaitTermination()
    assert refresh.current(spark, out).count() == 3
    spark.createDataFrame([("c", "d")], "a string, b string").write.mode("append").parquet(src)
    refresh.refresh(stream, facts, out, closure, ["a", "b"], str(tmp_path / "cp")).awaitTermination()
    assert refresh.current(spark, out).count() == 6
