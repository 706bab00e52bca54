"""Rule programs on Spark: each clause is one declarative plan of joins, anti-joins and aggregates that Catalyst optimises.

A relation is a DataFrame with set semantics. A conjunction starts with the atom that brings new rows (in recursion) or the
first one; next come those that share most variables with what is bound, tests and computed values as soon as they can be
decided, atoms without new variables as semi-joins, negated atoms as anti-joins. Aggregates count over the bindings that
reach them, so that none is 0. Relations that recur through each other are solved together, semi-naively, each round cut to
files. Columns that nothing needs any more are dropped after each join. Only what the wanted relations need is solved.

Null facts: an empty text, or for a number no fact. to_number of what is no number matches nothing. ord is a stable number
of a text and no order. Empty inputs give empty relations; repeated facts are one."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.fixpoint import mutual_fixpoint
from graphloom.operators.staging import cut
from graphloom.rules.language import TYPES, Aggregate, Atom, Call, Clause, Const, Not, Program, RuleError, Test, Var, Wild, atoms, parse, recurs, strata, variables

#: Plans of more scans than this are cut to files before others build on them.
WIDE = 10


def columns(program: Program, name: str) -> list[str]:
    return [f"c{i}" for i in range(len(program.relations[name]))]


def schema(program: Program, name: str) -> str:
    return ", ".join(f"c{i} {TYPES[t]}" for i, (_, t) in enumerate(program.relations[name]))


def facts(program: Program, name: str, df: DataFrame) -> DataFrame:
    """An input relation by position, in the declared types."""
    kinds = program.relations[name]
    if len(df.columns) != len(kinds):
        raise RuleError(f"{name} has {len(kinds)} places, the input {len(df.columns)} columns")
    named = df.toDF(*columns(program, name))
    typed = named.select(*[(F.coalesce(F.col(f"c{i}").cast("string"), F.lit("")) if t == "symbol" else F.col(f"c{i}").cast(TYPES[t])).alias(f"c{i}") for i, (_, t) in enumerate(kinds)])
    return typed.dropna().distinct()


class _Body:
    """The bindings of one conjunction, as a DataFrame with a column for each bound variable."""

    def __init__(self, spark: SparkSession, known, needed: set[str], seed: DataFrame | None = None, bound: set[str] = frozenset()):
        self.spark, self.known, self.needed, self.df, self.bound, self.fresh = spark, known, needed, seed, set(bound), 0

    def column(self, name: str) -> str:
        return "v_" + "".join(c if c.islower() or c.isdigit() else f"_{ord(c):x}_" for c in name)  # Spark's names have no case

    def value(self, x) -> Column:
        if isinstance(x, Var):
            return F.col(self.column(x.name))
        if isinstance(x, Const):
            return F.lit(x.value).cast("long") if isinstance(x.value, int) else F.lit(x.value)
        if isinstance(x, Call):
            return FUNCTIONS[x.name](*map(self.value, x.args))
        raise RuleError("a value is needed, not a free place or an aggregate")

    def ready(self, x) -> bool:
        return variables(x) <= self.bound

    def run(self, literals: list, first: int | None = None) -> DataFrame:
        rest = list(literals)
        if first is not None:
            self.atom(rest.pop(first), rest, True)
        while rest:
            if any(self.decide(x, rest) for x in list(rest)):
                continue
            open_ = [x for x in rest if isinstance(x, Atom)]
            if not open_:
                raise RuleError(f"variables {sorted(set().union(*map(variables, rest)) - self.bound)} aren't bound")
            best = max(open_, key=lambda x: (len(variables(x) & self.bound) + (sum(isinstance(a, Const) for a in x.args) if self.df is None else 0), -open_.index(x)))
            rest.remove(best)
            self.atom(best, rest)
        if self.df is None:
            self.df = self.spark.range(1).select()
        return self.df

    def decide(self, x, rest: list) -> bool:
        """Apply a literal that brings no new rows, if it can be decided."""
        if isinstance(x, Atom):
            if self.df is None or not variables(x) or not self.ready(x):
                return False
            self.meet(x, "left_semi")
        elif isinstance(x, Not):
            if not self.ready(x.inner):
                return False
            if isinstance(x.inner, Atom):
                self.meet(x.inner, "left_anti")
            else:
                self.keep(~F.coalesce(self.test(x.inner), F.lit(False)))
        else:
            sides = [(x.left, x.right), (x.right, x.left)]
            assigned = next(((v, e) for v, e in sides if x.op == "=" and isinstance(v, Var) and v.name not in self.bound), None)
            if assigned and isinstance(assigned[1], Aggregate):
                return self.aggregate(assigned[0].name, assigned[1], rest, x)
            if assigned and self.ready(assigned[1]) and not isinstance(assigned[1], Wild):
                self.assign(assigned[0].name, assigned[1])
            elif any(isinstance(s, Aggregate) for s in (x.left, x.right)):
                at = 0 if isinstance(x.left, Aggregate) else 1
                name = self.unused()
                if not self.aggregate(name, (x.left, x.right)[at], rest, x):
                    return False
                self.keep(self.test(Test(x.op, Var(name), x.right) if at == 0 else Test(x.op, x.left, Var(name))))
            elif self.ready(x):
                self.keep(self.test(x))
            else:
                return False
        rest.remove(x)
        self.drop(rest)
        return True

    def unused(self) -> str:
        self.fresh += 1
        return f"?{self.fresh}"

    def base(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(1).alias("one")) if self.df is None else self.df

    def keep(self, test: Column) -> None:
        self.df = self.base().filter(F.coalesce(test, F.lit(False)))

    def assign(self, name: str, x) -> None:
        value = self.value(x)
        self.df = self.base().withColumn(self.column(name), F.explode(value) if isinstance(x, Call) and x.name == "range" else value).filter(F.col(self.column(name)).isNotNull())
        self.bound.add(name)

    def test(self, x: Test) -> Column:
        left, right = self.value(x.left), self.value(x.right)
        if x.op == "contains":
            return right.contains(left)
        if x.op == "match":
            return F.regexp_like(right, F.concat(F.lit("^(?:"), left, F.lit(")$")))
        return {"=": left.__eq__, "!=": left.__ne__, "<": left.__lt__, ">": left.__gt__, "<=": left.__le__, ">=": left.__ge__}[x.op](right)

    def scan(self, x: Atom, fresh: bool = False) -> tuple[DataFrame, dict[str, int], list]:
        """The relation's rows that constants and repeated variables leave, the place of each variable, and computed places."""
        df = self.known(x.name, fresh)
        places, computed = {}, []
        for i, a in enumerate(x.args):
            if isinstance(a, Const):
                df = df.filter(F.col(f"c{i}") == self.value(a))
            elif isinstance(a, Var):
                if a.name in places:
                    df = df.filter(F.col(f"c{i}") == F.col(f"c{places[a.name]}"))
                else:
                    places[a.name] = i
            elif not isinstance(a, Wild):
                computed.append((i, a))
        return df, places, computed

    def atom(self, x: Atom, rest: list, fresh: bool = False) -> None:
        df, places, computed = self.scan(x, fresh)
        tests = []
        for i, a in computed:
            name = self.unused()
            places[name] = i
            tests.append(Test("=", Var(name), a))
        rest += tests
        shared = [v for v in places if v in self.bound]
        right = df.select(*[F.col(f"c{i}").alias(self.column(v)) for v, i in places.items()])
        if self.df is None:
            self.df = right
        elif shared:
            self.df = self.df.join(right, [self.column(v) for v in shared])
        else:
            self.df = self.df.crossJoin(right)  # the clause itself asks for all pairs
        self.bound |= set(places)
        self.drop(rest)

    def meet(self, x: Atom, how: str) -> None:
        """Keep, or drop, the bindings that the relation has."""
        df, places, computed = self.scan(x)
        keys = [(F.col(self.column(v)), i) for v, i in places.items()] + [(self.value(a), i) for i, a in computed]
        here, right = self.base(), df
        if not keys:
            right = right.select(F.lit(1).alias("k0")).limit(1)
            here, on = here.withColumn("one_k0", F.lit(1)), F.col("one_k0") == F.col("k0")
        else:
            right = right.select(*[F.col(f"c{i}").alias(f"k{n}") for n, (_, i) in enumerate(keys)])
            on = None
            for n, (value, _) in enumerate(keys):
                same = value == F.col(f"k{n}")
                on = same if on is None else on & same
        self.df = here.join(right, on, how).drop("one_k0")

    def aggregate(self, name: str, x: Aggregate, rest: list, own) -> bool:
        inside = {v for body in x.bodies for v in variables(body)} | variables(x.target)
        outside = self.needed | {v for y in rest if y is not own for v in variables(y)} | self.bound
        shared = sorted(inside & outside)
        if not set(shared) <= self.bound:
            return False
        keys = [self.column(v) for v in shared]
        seed = self.df.select(*keys).distinct() if shared else None
        found = None
        for body in x.bodies:
            named = tuple(_named(y, f"_{n}") for n, y in enumerate(body))  # a free place counts, too
            every = {v for y in named for v in variables(y)} | variables(x.target)
            part = _Body(self.spark, self.known, every, seed, set(shared))
            made = part.run(list(named))
            target = part.value(x.target).alias("target") if x.target is not None else F.lit(1).alias("target")
            made = made.select(*[F.col(part.column(v)) for v in sorted(every & part.bound)], target).distinct()
            if found is not None and set(made.columns) != set(found.columns):
                common = [*keys, "target"]
                made, found = made.select(*common), found.select(*common)
            found = made if found is None else found.unionByName(made).distinct()
        column = self.column(name)
        how = {"count": F.count("*"), "sum": F.sum("target"), "min": F.min("target"), "max": F.max("target"), "mean": F.avg("target")}[x.kind]
        if shared:
            # the seed's rows come back, so the keys have other names on that side
            summed = found.groupBy(*[F.col(k).alias(f"g_{k}") for k in keys]).agg(how.alias(column))
            on = None
            for k in keys:
                same = F.col(k) == F.col(f"g_{k}")
                on = same if on is None else on & same
            self.df = self.df.join(summed, on, "left" if x.kind in ("count", "sum") else "inner").drop(*[f"g_{k}" for k in keys])
        else:
            self.df = self.base().crossJoin(F.broadcast(found.agg(how.alias(column))))  # one row
        if x.kind in ("count", "sum"):
            self.df = self.df.withColumn(column, F.coalesce(F.col(column), F.lit(0)))
        self.df = self.df.filter(F.col(column).isNotNull())
        self.bound.add(name)
        return True

    def drop(self, rest: list) -> None:
        wanted = self.needed | {v for y in rest for v in variables(y)}
        gone = {v for v in self.bound if v not in wanted and not v.startswith("?")}
        if gone and len(gone) < len(self.bound):
            self.df = self.df.drop(*[self.column(v) for v in gone])
            self.bound -= gone


def _named(x, mark: str):
    """The literal with a variable of its own for each free place."""
    if isinstance(x, Atom):
        return Atom(x.name, tuple(Var(f"?w{mark}_{i}") if isinstance(a, Wild) else a for i, a in enumerate(x.args)))
    return x


def _substr(s: Column, start: Column, length: Column) -> Column:
    return F.when(start < 0, F.lit("")).otherwise(F.substring(s, (start + 1).cast("int"), length.cast("int")))


FUNCTIONS = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "%": lambda a, b: a % b,
    "/": lambda a, b: F.when(b != 0, F.floor(F.abs(a) / F.abs(b)).cast("long") * F.signum(a).cast("long") * F.signum(b).cast("long")), "^": lambda a, b: F.pow(a, b).cast("long"),
    "cat": lambda *a: F.concat(*a), "strlen": lambda a: F.length(a).cast("long"), "substr": _substr, "abs": lambda a: F.abs(a),
    "to_number": lambda a: a.try_cast("long"), "to_float": lambda a: a.try_cast("double"), "to_string": lambda a: a.cast("string"), "ord": lambda a: F.xxhash64(a),
    "min": lambda *a: F.least(*a), "max": lambda *a: F.greatest(*a),
    "range": lambda a, b, step=None: F.filter(F.sequence(a, F.greatest(a, b), *([step] if step is not None else [])), lambda x: x < b),
}


def _clause(spark: SparkSession, program: Program, clause: Clause, known, first: int | None = None) -> DataFrame:
    needed = {v for a in clause.head.args for v in variables(a)}
    body = _Body(spark, known, needed)
    literals, args = list(clause.body), []
    for a in clause.head.args:  # an aggregate in the head is a value like any other
        if isinstance(a, Aggregate):
            name = body.unused()
            literals.append(Test("=", Var(name), a))
            body.needed = body.needed | {name}
            a = Var(name)
        args.append(a)
    df = body.run(literals, first)
    if not needed <= body.bound:
        raise RuleError(f"{clause.head.name}: {sorted(needed - body.bound)} aren't bound")
    kinds = program.relations[clause.head.name]
    return df.select(*[body.value(a).cast(TYPES[t]).alias(f"c{i}") for i, (a, (_, t)) in enumerate(zip(args, kinds, strict=True))]).dropna()


def solve(spark: SparkSession, program: Program | str, inputs: Mapping[str, DataFrame], wanted: list[str] | None = None) -> dict[str, DataFrame]:
    """The wanted relations (default: those with .output) over the input relations, with their declared column names."""
    program = parse(program) if isinstance(program, str) else program
    wanted = wanted or program.outputs
    if missing := program.inputs - set(inputs) - {n for n in program.relations if any(c.head.name == n for c in program.clauses)}:
        inputs = {**inputs, **{n: spark.createDataFrame([], schema(program, n)) for n in missing}}
    done: dict[str, DataFrame] = {}
    width: dict[str, int] = {}
    uses: dict[str, int] = {}
    for clause in program.clauses:
        for a in atoms(clause.body):
            uses[a.name] = uses.get(a.name, 0) + 1

    def known(name: str, fresh: bool = False) -> DataFrame:
        return done[name]

    for group in strata(program, wanted):
        rules = [c for c in program.clauses if c.head.name in group]
        given = {n: facts(program, n, inputs[n]) for n in group if n in inputs}
        # facts written in the text are one small table
        plain: dict[str, list] = {n: [] for n in group}
        for c in rules:
            if not c.body and all(isinstance(a, Const) for a in c.head.args):
                plain[c.head.name].append(tuple(a.value for a in c.head.args))
        rules = [c for c in rules if c.body or not all(isinstance(a, Const) for a in c.head.args)]
        inner = lambda c: [i for i, x in enumerate(c.body) if isinstance(x, Atom) and x.name in group]  # noqa: E731, B023

        def seeds(name: str, own: list[Clause]) -> DataFrame:
            parts = [given[name]] if name in given else []  # noqa: B023
            if plain[name]:  # noqa: B023
                parts.append(spark.createDataFrame(plain[name], schema(program, name)))  # noqa: B023
            parts += [_clause(spark, program, c, known) for c in own]
            out = parts[0] if parts else spark.createDataFrame([], schema(program, name))
            for p in parts[1:]:
                out = out.union(p)
            return out if len(parts) == 1 and name in given else out.distinct()  # noqa: B023

        if not recurs(program, group):
            name = group[0]
            df = seeds(name, rules)
            width[name] = 1 + sum(width.get(a.name, 1) for c in rules for a in atoms(c.body))
            if rules and (width[name] > WIDE or uses.get(name, 0) > 1):
                df, width[name] = cut(df, name), 1
            done[name] = df
            continue
        base = {n: seeds(n, [c for c in rules if c.head.name == n and not inner(c)]) for n in group}

        def step(name: str):
            def run(total, new):
                out = None
                for c in rules:  # noqa: B023
                    for at in inner(c) if c.head.name == name else []:  # noqa: B023
                        see = lambda n, fresh=False: new[n] if fresh else total[n] if n in total else done[n]
                        part = _clause(spark, program, c, see, at)
                        out = part if out is None else out.union(part)
                return out if out is not None else total[name].limit(0)

            return run

        found = mutual_fixpoint(base, {n: step(n) for n in group})
        done |= found
        width |= dict.fromkeys(group, 1)
    return {n: done[n].toDF(*[c for c, _ in program.relations[n]]) for n in wanted}
