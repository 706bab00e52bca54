"""The call program on a small hand-written project: an interface, an abstract class, two classes and a main class."""

import pytest

from graphloom.rules.programs import program
from graphloom.rules.solve import solve

STRING = "lang.String"
TYPES = [("Shape", "Shape", "p", "A", "interface", ""), ("Base", "Base", "p", "A", "class", ""), ("Circle", "Circle", "p", "A", "class", ""), ("Square", "Square", "p", "A", "class", ""), ("Main", "Main", "q", "B", "class", ""), (STRING, "String", "lang", "L", "class", ""), ("D", "D", "p", "C", "class", ""), ("L1", "L1", "p", "C", "class", ""), ("L2", "L2", "p", "C", "class", ""), ("Root", "Root", "p", "C", "class", "")]
HERITAGE = [("Base", 0, "Shape", "implements"), ("Circle", 0, "Base", "extends"), ("Square", 0, "Base", "extends"), ("D", 0, "L1", "extends"), ("D", 1, "L2", "extends"), ("L1", 0, "Root", "extends")]
METHODS = [("Shape.area", "Shape", "area", 0, "abstract", ""), ("Base.label", "Base", "label", 0, "instance", "String"), ("Base.new", "Base", "Base", 0, "constructor", ""), ("Circle.new", "Circle", "Circle", 0, "constructor", ""), ("Circle.area", "Circle", "area", 0, "instance", ""), ("Square.area", "Square", "area", 0, "instance", ""), ("Square.label", "Square", "label", 0, "instance", "String"), ("Square.new", "Square", "Square", 0, "constructor", ""), ("Main.main", "Main", "main", 1, "static", ""), ("Main.helper", "Main", "helper", 1, "static", ""), ("Main.unused", "Main", "unused", 0, "static", ""), ("String.trim", STRING, "trim", 0, "instance", "String"), ("Main.run", "Main", "run", 1, "static", ""), ("lambda1", "Main", "", 0, "static", "")]
FIELDS = [("Base.name", "Base", "name", "String", "instance"), ("Circle.r", "Circle", "r", "double", "instance")]
VARIABLES = [("Main.main", "s", "Shape", "local"), ("Main.helper", "x", "Shape", "parameter"), ("Main.helper", "q", "Square", "local"), ("Main.run", "task", "Runnable", "parameter")]
# id, method, type, kind, name, line
EXPRS = [
    ("c1", "Circle.new", "Circle", "delegate", "super", 1), ("e1", "Circle.area", "Circle", "this", "", 2), ("e2", "Circle.area", "Circle", "select", "r", 2),
    ("e3", "Square.label", "Square", "super", "", 3), ("c2", "Square.label", "Square", "call", "label", 3), ("e4", "Base.label", "Base", "name", "name", 4),
    ("c3", "Main.main", "Main", "new", "Circle", 5), ("e5", "Main.main", "Main", "name", "s", 6), ("c4", "Main.main", "Main", "call", "area", 6), ("c5", "Main.main", "Main", "call", "helper", 7), ("c6", "Main.main", "Main", "call", "unknown", 8),
    ("e6", "Main.helper", "Main", "name", "q", 9), ("c7", "Main.helper", "Main", "call", "label", 9), ("c8", "Main.helper", "Main", "call", "trim", 9), ("c9", "Main.helper", "Main", "new", "Square", 9),
    ("e7", "Main.unused", "Main", "new", "Circle", 10), ("e8", "Main.unused", "Main", "select", "name", 10), ("c10", "", "Main", "call", "helper", 11),
    ("e9", "Main.run", "Main", "name", "task", 12), ("c11", "Main.run", "Main", "call", "go", 12), ("e10", "Main.unused", "Main", "lambda", "", 13), ("c12", "Main.unused", "Main", "call", "run", 13),
]
FACTS = {
    "type": TYPES, "library": [(STRING,), ("String.trim",)], "import": [("B", "Shape", "Shape"), ("B", "*", "p"), ("A", "String", STRING), ("B", "String", STRING)], "heritage": HERITAGE, "bound": [], "method": METHODS, "field": FIELDS, "variable": VARIABLES, "expr": EXPRS,
    "receiver": [("e2", "e1"), ("c2", "e3"), ("c4", "e5"), ("c7", "e6"), ("c8", "c7"), ("e8", "e7"), ("c11", "e9")], "argument": [("c12", 0, "e10")], "assigned": [("e8", "x", "write")],
    "arity": [("c1", 0), ("c2", 0), ("c3", 0), ("c4", 0), ("c5", 1), ("c6", 0), ("c7", 0), ("c8", 0), ("c9", 0), ("e7", 0), ("c10", 1), ("c11", 0), ("c12", 1)],
    "lambda": [("e10", "lambda1")], "annotated": [], "root": [], "cap": [(10,)], "parameter_at": [("Main.run", 0, "task")],
}


@pytest.fixture(scope="module")
def solved(spark):
    rules = program("calls")
    kinds = {"symbol": "string", "number": "long"}
    inputs = {n: spark.createDataFrame(rows, ", ".join(f"{c} {kinds[t]}" for c, t in rules.relations[n])) for n, rows in FACTS.items()}
    return {n: {tuple(r) for r in df.collect()} for n, df in solve(spark, rules, inputs).items()}


def test_every_site_has_an_edge(solved):
    edges = {(s, to, tier) for s, _, to, _, tier in solved["call_edge"]}
    assert edges == {
        ("c1", "Base.new", "known_edge"), ("c2", "Base.label", "known_edge"), ("c3", "Circle.new", "known_edge"), ("c4", "Circle.area", "multi_inferred"), ("c4", "Square.area", "multi_inferred"),
        ("c5", "Main.helper", "known_edge"), ("c6", "", "ambiguous_unknown"), ("c7", "Square.label", "known_edge"), ("c8", "String.trim", "boundary_lib"), ("c9", "Square.new", "known_edge"),
        ("e7", "Circle.new", "known_edge"), ("c10", "Main.helper", "known_edge"), ("c11", "lambda1", "known_edge"), ("c12", "Main.run", "known_edge"),
    }
    assert {f for s, f, *_ in solved["call_edge"] if s == "c10"} == {"Main"}  # an initializer runs in its type
    assert len(solved["tier"]) == len({s for s, *_ in solved["call_edge"]}) == 13


def test_fields_types_and_what_is_reached(solved):
    assert {(e, d, a) for e, _, d, a in solved["field_use"]} == {("e2", "Circle.r", "read"), ("e4", "Base.name", "read"), ("e8", "Base.name", "write")}
    assert {("Circle", "Base", "extends"), ("Base", "Shape", "implements"), ("Base.name", STRING, "field"), ("Main.helper", "Square", "new"), ("Main.main", "Shape", "local"), ("Base.label", STRING, "return")} <= solved["type_use"]
    assert solved["entry"] == {("Main.main",)}
    assert {m for (m,) in solved["reached"]} == {"Main.main", "Main.helper", "Circle.new", "Base.new", "Circle.area", "Square.area", "Square.label", "Base.label", "Square.new", "String.trim"}
    assert ("Main.unused",) in solved["never_called"] and ("Main.main", "c6") in solved["blind"]
    assert {("Circle.area", "Shape.area"), ("Square.area", "Shape.area"), ("Square.label", "Base.label")} == solved["overrides"]
    assert ("Circle", "double") in solved["unresolved_name"] and ("Main", "Runnable") in solved["unresolved_name"]


def test_order_of_bases_only_where_it_is_total(solved):
    assert {x for x in solved["place"] if x[0] == "Circle"} == {("Circle", "Circle", 0), ("Circle", "Base", 1), ("Circle", "Shape", 2)}
    assert not [x for x in solved["place"] if x[0] == "D"] and solved["incomparable"] == {("D", "L2", "Root")}  # written after L1, but not related to what L1 inherits
