"""String functions of the rule language as columns: substr counts from 0, contains takes the needle first, match is a full match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cat(*parts: Column) -> Column:
    return F.concat(*parts)


def strlen(s: Column) -> Column:
    return F.length(s)


def substr(s: Column, start: int | Column, length: int | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.substring(s, lit(start) + 1, lit(length))


def contains(needle: Column | str, hay: Column) -> Column:
    return hay.contains(needle if isinstance(needle, Column) else F.lit(needle))


def match(pattern: str, s: Column) -> Column:
    return s.rlike(f"^(?:{pattern})$")


def to_number(s: Column) -> Column:
    return s.try_cast("int")


def to_string(n: Column) -> Column:
    return n.cast("string")


def starts_lower(s: Column) -> Column:
    return s.rlike("^[a-z]")


def upper_first(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


def strip_quotes(s: Column) -> Column:
    return F.regexp_replace(s, "^([\"'])(.*)\\1$", "$2")


def kebab(s: Column) -> Column:
    return F.lower(F.regexp_replace(s, "([a-z0-9])([A-Z])", "$1-$2"))


def last_segment(s: Column, separator: str = ".") -> Column:
    return F.substring_index(s, separator, -1)


def prefixes(s: Column, separator: str = ".") -> Column:
    """All leading parts of a separated name: a.b.c gives a, a.b, a.b.c."""
    parts = F.split(s, f"\\Q{separator}\\E")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), separator))


def placeholders(s: Column) -> Column:
    """Keys of ${key} and ${key:default} in a value."""
    return F.regexp_extract_all(s, F.lit(r"\$\{([^}:]+)(?::[^}]*)?\}"), 1)


def visibility(s: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(s)), "_ACCESS$", "")
