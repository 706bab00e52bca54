"""Rule programs of this package, by name."""

from __future__ import annotations

from functools import cache
from importlib import resources

from graphloom.rules.language import Program, parse


@cache
def program(name: str) -> Program:
    return parse(resources.files(__name__).joinpath(f"{name}.dl").read_text())
