"""Configuration files as key and value facts: YAML and Gradle dependencies."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = re.compile(r"^(\s*)(- )?(?:([^\s#'\"][^:#]*?|\"[^\"]*\"|'[^']*')\s*:(?:\s+(.*))?|(.*))$")


def flow(text: str):
    """The value of a flow collection or scalar: dict, list or text; None if it isn't closed."""

    def value(at: int):
        while at < len(text) and text[at].isspace():
            at += 1
        if at < len(text) and text[at] in "{[":
            close, out, at = {"{": "}", "[": "]"}[text[at]], {} if text[at] == "{" else [], at + 1
            while True:
                while at < len(text) and (text[at].isspace() or text[at] == ","):
                    at += 1
                if at >= len(text):
                    return None, at
                if text[at] == close:
                    return out, at + 1
                item, at = value(at)
                if item is None:
                    return None, at
                if isinstance(out, dict):
                    while at < len(text) and text[at].isspace():
                        at += 1
                    held = ""
                    if at < len(text) and text[at] == ":":
                        held, at = value(at + 1)
                        if held is None:
                            return None, at
                    out[str(item)] = held
                else:
                    out.append(item)
        if at < len(text) and text[at] in "\"'":
            end = text.find(text[at], at + 1)
            return (None, at) if end < 0 else (text[at + 1 : end], end + 1)
        end = at
        while end < len(text) and text[end] not in ",}]" and not (text[end] == ":" and (end + 1 == len(text) or text[end + 1] in " ,}]")):
            end += 1
        return text[at:end].strip(), end

    return value(0)[0]


def _flat(path: str, value) -> Iterator[tuple[str, str]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _flat(f"{path}.{k}" if path else k, v)
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from _flat(f"{path}.[{k}]", v)
    else:
        yield path, value


def flat_yaml(text: str) -> Iterator[tuple[int, str, str]]:
    """(document, dotted key, value): mappings, lists by index, comments, quotes, flow collections, block scalars, anchors with
    aliases and merges, several documents. Tags are dropped; a flow collection that isn't closed on its line stays text."""
    rows: list[tuple[int, str, str]] = []
    anchors: dict[tuple[int, str], str] = {}
    for document, path, value in _block_yaml(text):
        if found := re.match(r"&(\S+)\s*", value):
            anchors[document, found[1]] = path
            value = value[found.end() :]
            if not value:
                continue
        value = re.sub(r"^!\S+\s+", "", value)
        if (found := re.fullmatch(r"\*(\S+)", value)) and (document, found[1]) in anchors:
            base, merge = anchors[document, found[1]], path.endswith("<<")
            own = path[: -len(".<<")] if path.endswith(".<<") else "" if merge else path
            for d, p, v in list(rows):
                if d == document and (p == base or p.startswith(f"{base}.")):
                    rows.append((document, (own + p[len(base) :]).lstrip("."), v))
            continue
        held = flow(value) if value[:1] in ("{", "[") else None
        if isinstance(held, (dict, list)):
            rows += [(document, p, v) for p, v in _flat(path, held)]
        else:
            rows.append((document, path, value.strip("\"'") if value[:1] in "\"'" and len(value) > 1 else value))
    last = {(d, p): v for d, p, v in rows}  # what is written after a merge wins
    seen = set()
    for d, p, _ in rows:
        if (d, p) not in seen:
            seen.add((d, p))
            yield d, p, last[d, p]


def _block_yaml(text: str) -> Iterator[tuple[int, str, str]]:
    """(document, dotted key, text of the value) of block style."""
    document, stack, counters = 0, [], {}
    lines, at = (text or "").splitlines(), 0
    while at < len(lines):
        raw, at = lines[at], at + 1
        if raw.startswith("---"):
            document, stack, counters = document + bool(stack or counters), [], {}
            continue
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if not line.strip() or line.startswith("..."):
            continue
        found = LINE.match(line)
        indent = len(found[1])
        while stack and stack[-1][0] >= indent + (1 if found[2] else 0) and not (found[2] and stack[-1][0] < indent):
            stack.pop()
        if found[2]:
            while stack and stack[-1][0] >= indent + 1:
                stack.pop()
            path = ".".join(s[1] for s in stack)
            k = counters[document, path, indent] = counters.get((document, path, indent), -1) + 1
            stack.append((indent + 1, f"[{k}]"))
            indent += 2
        if found[3] is None:
            path, value = ".".join(s[1] for s in stack), found[5].strip()
        else:
            stack.append((indent, found[3].strip("\"'")))
            path, value = ".".join(s[1] for s in stack), (found[4] or "").strip()
        if block := re.fullmatch(r"(?:&\S+\s+)?([|>])[+-]?\d?[+-]?", value):
            held = []
            while at < len(lines) and (not lines[at].strip() or len(lines[at]) - len(lines[at].lstrip()) > len(found[1])):
                held.append(lines[at])
                at += 1
            deep = min((len(x) - len(x.lstrip()) for x in held if x.strip()), default=0)
            held = [x[deep:] for x in held]
            while held and not held[-1].strip():
                held.pop()
            value = "\n".join(held) if block[1] == "|" else re.sub(r"(?<=\S)\n(?=\S)", " ", "\n".join(held))
        if value:
            yield document, path, value
            if found[3] is not None and not found[2] and not value.startswith("&"):
                stack.pop()


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """source, document, key, value."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame([(s, d, k.replace(".[", "["), v) for s, t in zip(frame["source"], frame["value"], strict=True) for d, k, v in flat_yaml(t)], columns=["source", "document", "key", "value"])

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value").mapInPandas(run, "source string, document int, key string, value string")


def gradle_dependencies(files: DataFrame) -> DataFrame:
    """source, configuration, coordinate of build scripts (source, value): strings and project references after a configuration's name."""
    pattern = r"(?m)^\s*(\w*(?:[iI]mplementation|[aA]pi|[cC]ompileOnly|[rR]untimeOnly|annotationProcessor|kapt|compile|testCompile))[ (]+(?:platform\()?(['\"][^'\"]+['\"]|project\(\s*['\"][^'\"]+['\"]\s*\)|libs[\w.]+)"
    pairs = files.select("source", F.arrays_zip(F.regexp_extract_all("value", F.lit(pattern), 1).alias("c"), F.regexp_extract_all("value", F.lit(pattern), 2).alias("d")).alias("z")).select("source", F.explode("z").alias("z"))
    return pairs.select("source", F.col("z.c").alias("configuration"), F.regexp_replace(F.col("z.d"), r"project\(|[\s'\")]", "").alias("coordinate"))
