"""Schemas of fact tables and of the output graph, and the confidence tiers of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Core tables of a graph: name -> DDL.
CORE = {
    "run": "key string, value string",
    "methods": "id string, name string, qualified_name string, signature string, kind string, owner_type_id string, owner_qualified_name string, file_path string, start_line int, end_line int, provenance string, visibility string",
    "types": "id string, name string, qualified_name string, category string, file_path string, start_line int, end_line int, provenance string, visibility string",
    "call_sites": "id string, caller_id string, kind string, callee_name string, file_path string, start_line int, start_column int, end_line int, end_column int",
    "call_edges": "call_site_id string, caller_id string, callee_method_id string, callee_label string, callee_provenance string, tier string, kind string",
    "type_ancestors": "type_id string, ancestor_type_id string",
    "dispatch_candidates": "base_method_id string, candidate_method_id string, basis string",
    "overrides": "base_method_id string, override_method_id string",
    "entry_points": "method_id string, reason string",
    "entry_reachable": "method_id string",
    "unresolved_sites": "caller_id string, call_site_id string",
    "type_instantiated": "type_id string, how string",
    "fields": "id string, name string, kind string, owner_type_id string, owner_qualified_name string, type_name string, modifiers string, file_path string, start_line int, end_line int, provenance string",
    "field_access": "site string, caller_id string, field_id string, field_provenance string, access string, tier string, file_path string, start_line int, start_column int, end_line int, end_column int",
    "type_use": "ref string, type_id string, context string, depth int, owner_kind string, owner string, encl_method string, encl_type string, type_provenance string, tier string",
    "skipped": "file_path string, reason string, construct string, start_line int, start_column int, detail string",
}

#: Tiers by falling confidence; the rank orders alternatives of one site.
TIERS = ("known_edge", "known_implicit_ctor", "known_builtin_operator", "multi_inferred", "callback_registered", "callback_handed", "event_dispatch", "asserted", "boundary_lib", "ambient_terminal", "intrinsic_terminal", "implicit_constructor", "dynamic_terminal", "fan_capped", "ambiguous_dynamic", "ambiguous_anon", "ambiguous_unknown")


class SchemaDrift(ValueError):
    """A table lacks a column that is expected by name."""


def require(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise SchemaDrift(f"missing columns {missing}; found {df.columns}")
    return df


def tier_rank(tier: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[x for k, t in enumerate(TIERS) for x in (F.lit(t), F.lit(k))]), tier), F.lit(len(TIERS)))


def absent_to_null(value: Column) -> Column:
    """Facts write an absent column as an empty string and an unresolved target as a dash."""
    return F.nullif(F.nullif(value, F.lit("")), F.lit("-"))


def fact_int(value: Column) -> Column:
    """Facts hold numbers as text; what isn't one is null."""
    return value.try_cast("int")


def entity_id(prefix: str, *parts: Column) -> Column:
    """Content hash with a kind's prefix."""
    return F.concat(F.lit(prefix), F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])))
