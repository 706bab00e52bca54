"""Tables of a data folder, and the text formats in which fact tables travel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_headered_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted TSV with a header line; columns are found by name."""
    return spark.read.csv(path, sep="\t", header=True, multiLine=True, escape='"', quote='"')


def read_raw_tsv(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Unquoted positional TSV: rows of the right width, and (torn) the number of others."""
    lines = spark.read.text(path).select(F.split("value", "\t", -1).alias("f"))
    width = len(columns)
    good = lines.filter(F.size("f") == width).select(*[F.col("f")[k].alias(c) for k, c in enumerate(columns)])
    return good, lines.agg(F.count_if(F.size("f") != width).alias("torn"))


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """source, key, value of .properties files: = or : between key and value, # and ! comments, lines continued by a backslash."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value")
    joined = F.regexp_replace("value", r"\\\r?\n[ \t]*", "")
    line = whole.select("source", F.explode(F.split(joined, r"\r?\n")).alias("line"))
    kept = line.filter(~F.col("line").rlike(r"^\s*([#!].*)?$"))
    found = r"^\s*((?:\\.|[^\\=:\s])+)\s*[=:\s]?\s*(.*)$"
    return kept.select("source", F.regexp_replace(F.regexp_extract("line", found, 1), r"\\(.)", "$1").alias("key"), F.regexp_extract("line", found, 2).alias("value"))


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


PY_FACTS = T.StructType([T.StructField(n, T.StringType() if n not in ("start_line", "end_line") else T.IntegerType()) for n in ("file_path", "kind", "name", "owner", "target", "start_line", "end_line")])


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of Python source (path, content): functions, classes, bases, calls and imports; files that don't parse give one skipped row."""

    def run(frames):
        import ast

        import pandas as pd

        for frame in frames:
            out = []
            for path, text in zip(frame["path"], frame["content"], strict=True):
                try:
                    tree = ast.parse(text)
                except (SyntaxError, ValueError) as e:
                    out.append((path, "skipped", type(e).__name__, None, str(e)[:200], getattr(e, "lineno", None), None))
                    continue
                stack = [(tree, "")]
                while stack:
                    node, owner = stack.pop()
                    for child in ast.iter_child_nodes(node):
                        inner = owner
                        if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                            kind = "class" if isinstance(child, ast.ClassDef) else "function"
                            inner = f"{owner}.{child.name}".lstrip(".")
                            out.append((path, kind, child.name, owner, inner, child.lineno, child.end_lineno))
                            if kind == "class":
                                out += [(path, "base", ast.unparse(b), inner, str(k), child.lineno, child.lineno) for k, b in enumerate(child.bases)]
                        elif isinstance(child, ast.Call):
                            out.append((path, "call", ast.unparse(child.func), owner, None, child.lineno, child.end_lineno))
                        elif isinstance(child, ast.Import):
                            out += [(path, "import", a.name, owner, a.asname, child.lineno, child.lineno) for a in child.names]
                        elif isinstance(child, ast.ImportFrom):
                            out += [(path, "import", f"{child.module or ''}.{a.name}", owner, a.asname, child.lineno, child.lineno) for a in child.names]
                        stack.append((child, inner))
            made = pd.DataFrame(out, columns=PY_FACTS.names)
            for c in ("start_line", "end_line"):
                made[c] = made[c].astype("Int32")
            yield made

    return files.select("path", "content").mapInPandas(run, PY_FACTS)


def read_python(spark: SparkSession, path: str) -> DataFrame:
    return python_facts(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content")))
