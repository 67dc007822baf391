"""The metric formula language, compiled to Spark columns.

A formula is one Python-like expression.  `parse` checks it and works out what it reads; `Plan` turns it into
(1) aggregate columns over the builds of a cell, (2) a scalar over those aggregates, with `minmax` and `z`
resolved against parameters taken over all cells.  All metrics of a run share one groupBy.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import IMPACT_CLASSES, MOST_FORMULA_CHARS, MOST_FORMULA_DEPTH, MOST_FORMULA_NODES, QUESTION_CLASSES

# Fixed names of the language.
NUMBERS = ("usage", "loc_added", "loc_removed", "bugs", "cost_usd", "lead_time_days", "loc_total", "age_days")
STRINGS = ("first_commit_ts", "ts", "deployed_at", "served_at", "build_id", "group", "question", "carried_into", "impact", "lead_time_source")
BOOLEANS = ("deployed", "served", "gate_unavailable")
REDUCERS = ("sum", "mean", "median", "p10", "p90", "min", "max")
COUNTERS = ("count", "share")
NORMALISERS = ("minmax", "z")
PLAIN = ("abs", "sqrt", "log", "clip")
GATE_INPUTS = ("deployed_at", "usage", "carried_into", "ts", "impact", "deployed")

COLUMNS = frozenset(NUMBERS + STRINGS + BOOLEANS)
CLASSES = frozenset(IMPACT_CLASSES + QUESTION_CLASSES)
#: Where a column of the language lives in a prepared builds frame, if not under its own name.
STORED = {"group": "grp", "ts": "ts_text", "first_commit_ts": "first_commit_text", "deployed_at": "deployed_text", "served_at": "served_text"}

_ARITHMETIC = (ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Pow)
_COMPARISONS = (ast.Eq, ast.NotEq, ast.Lt, ast.LtE, ast.Gt, ast.GtE)
_NODES = (ast.Expression, ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.Compare, ast.Call, ast.Name, ast.Constant, ast.Load, ast.UAdd, ast.USub, ast.And, ast.Or, ast.Not, *_ARITHMETIC, *_COMPARISONS)


class FormulaError(ValueError):
    """A formula that is refused, and why."""


@dataclass(frozen=True)
class Reads:
    """What a formula reads, known before there are data."""

    columns: frozenset[str]
    impact_parts: frozenset[str]
    question_parts: frozenset[str]
    functions: frozenset[str]

    def as_dict(self) -> dict:
        return {"columns": sorted(self.columns), "mix_parts": sorted(self.impact_parts), "question_parts": sorted(self.question_parts), "functions": sorted(self.functions)}


def _called(node: ast.AST) -> str | None:
    return node.func.id if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) else None


class Formula:
    """A checked expression."""

    def __init__(self, name: str, expression: str) -> None:
        self.name, self.expression = name, expression
        if len(expression) > MOST_FORMULA_CHARS:
            self._refuse(f"longer than {MOST_FORMULA_CHARS} characters")
        try:
            self.body = ast.parse(expression.strip(), mode="eval").body
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            raise FormulaError(f"{name}: cannot parse: {e}") from e
        self._check_shape()
        self._check_place(self.body, per_build=False)
        if self._kind(self.body) != "number":
            self._refuse("a metric must be a number")
        # normalisers in source order, the order of their parameters
        self.normalisers = sorted((n for n in ast.walk(self.body) if _called(n) in NORMALISERS), key=lambda n: (n.lineno, n.col_offset))
        self.reads = self._reads()

    def _refuse(self, why: str) -> None:
        raise FormulaError(f"{self.name}: {why}")

    def _check_shape(self) -> None:
        def walk(node: ast.AST, depth: int) -> Iterator[ast.AST]:
            stack = [(node, depth)]
            while stack:
                at, d = stack.pop()
                if d > MOST_FORMULA_DEPTH:
                    self._refuse(f"nested deeper than {MOST_FORMULA_DEPTH}")
                yield at
                stack += [(c, d + 1) for c in ast.iter_child_nodes(at)]

        n = 1
        for node in walk(self.body, 1):
            n += 1
            if n > MOST_FORMULA_NODES:
                self._refuse(f"more than {MOST_FORMULA_NODES} nodes")
            if not isinstance(node, _NODES):
                self._refuse(f"{type(node).__name__} is not allowed")
            if isinstance(node, ast.Call):
                f = _called(node)
                if f is None:
                    self._refuse("only plain functions may be called")
                if f not in REDUCERS + COUNTERS + NORMALISERS + PLAIN:
                    self._refuse(f"{f}() is not a function of the language")
                if node.keywords:
                    self._refuse("keyword arguments are not allowed")
            if isinstance(node, ast.Constant):
                if not isinstance(node.value, (bool, int, float, str)):
                    self._refuse(f"{type(node.value).__name__} literals are not allowed")
                if not isinstance(node.value, str):
                    try:
                        finite = math.isfinite(float(node.value))
                    except OverflowError:
                        finite = False
                    if not finite:
                        self._refuse("numbers must be finite")

    def _kind(self, node: ast.AST) -> str:
        """number, bool or string."""
        match node:
            case ast.Constant(value=bool()):
                return "bool"
            case ast.Constant(value=str()):
                return "string"
            case ast.Constant():
                return "number"
            case ast.Name(id=x):
                return "number" if x in NUMBERS else "bool" if x in BOOLEANS else "string"
            case ast.Compare():
                if len(node.ops) != 1 or self._kind(node.left) != self._kind(node.comparators[0]):
                    self._refuse("a comparison takes two values of one kind")
                return "bool"
            case ast.BoolOp() | ast.UnaryOp(op=ast.Not()):
                if any(self._kind(x) != "bool" for x in (node.values if isinstance(node, ast.BoolOp) else [node.operand])):
                    self._refuse("and, or and not take predicates")
                return "bool"
            case ast.Call() if _called(node) in COUNTERS:
                if node.args and not isinstance(node.args[0], ast.Name) and self._kind(node.args[0]) != "bool":
                    self._refuse(f"{_called(node)}() takes a predicate")
                return "number"
            case ast.Call():
                parts = node.args
            case ast.BinOp():
                parts = [node.left, node.right]
            case ast.UnaryOp():
                parts = [node.operand]
            case _:
                self._refuse(f"{type(node).__name__} has no value")
        if any(self._kind(p) != "number" for p in parts):
            self._refuse("arithmetic takes numbers")
        return "number"

    def _arguments(self, node: ast.Call, n: int) -> None:
        if len(node.args) != n:
            self._refuse(f"{_called(node)}() takes {n} argument(s)")

    def _check_place(self, node: ast.AST, per_build: bool) -> None:
        """Columns stand inside a reducer; reducers, counters and normalisers outside one."""
        f = _called(node)
        if isinstance(node, ast.Name):
            if node.id in COLUMNS:
                if not per_build:
                    self._refuse(f"'{node.id}' is a value per build: reduce it, as in sum({node.id})")
            elif node.id not in CLASSES:
                self._refuse(f"'{node.id}' is not a column")
        elif f in REDUCERS:
            if per_build:
                self._refuse("reducers cannot nest")
            self._arguments(node, 1)
            self._check_place(node.args[0], True)
        elif f in COUNTERS:
            if per_build:
                self._refuse("counters cannot stand in a reducer")
            if f == "share" or node.args:
                self._arguments(node, 1)
                self._check_predicate(node.args[0], f)
        elif f in NORMALISERS:
            if per_build or any(_called(x) in NORMALISERS for a in node.args for x in ast.walk(a)):
                self._refuse("a normaliser takes a cell's number and cannot nest")
            self._arguments(node, 1)
            self._check_place(node.args[0], False)
        elif f == "clip":
            self._arguments(node, 3)
            self._check_place(node.args[0], per_build)
            for bound in node.args[1:]:
                self._check_place(bound, False)
        elif f:
            self._arguments(node, 1)
            self._check_place(node.args[0], per_build)
        else:
            for child in ast.iter_child_nodes(node):
                self._check_place(child, per_build)

    def _check_predicate(self, node: ast.AST, f: str) -> None:
        match node:
            case ast.Name(id=x):
                if x not in CLASSES:
                    self._refuse(f"{f}({x}): a bare name must be a class")
            case ast.Compare():
                if len(node.ops) != 1:
                    self._refuse("comparisons cannot be chained")
                self._check_place(node.left, True)
                right = node.comparators[0]
                if not (isinstance(right, ast.Name) and right.id not in COLUMNS):  # else it reads as a string
                    self._check_place(right, True)
            case ast.BoolOp():
                for x in node.values:
                    self._check_predicate(x, f)
            case ast.UnaryOp(op=ast.Not()):
                self._check_predicate(node.operand, f)
            case _:
                self._refuse(f"{f}() takes a comparison or a class")

    def _reads(self) -> Reads:
        columns, impact, question = set(), set(), set()

        def add_class(x: object) -> None:
            if x in IMPACT_CLASSES:
                impact.add(x)
                return
            if x in QUESTION_CLASSES:
                question.add(x)

        for node in ast.walk(self.body):
            if isinstance(node, ast.Name) and node.id in COLUMNS:
                columns.add(node.id)
            if _called(node) in COUNTERS and node.args:
                for x in ast.walk(node.args[0]):
                    if isinstance(x, ast.Compare) and isinstance(x.left, ast.Name) and x.left.id in ("impact", "question"):
                        r = x.comparators[0]
                        add_class(r.id if isinstance(r, ast.Name) else getattr(r, "value", None))
                bare = node.args[0]
                if isinstance(bare, ast.Name):
                    add_class(bare.id)
                    columns.add("impact" if bare.id in IMPACT_CLASSES else "question")
        return Reads(frozenset(columns), frozenset(impact), frozenset(question), frozenset(filter(None, map(_called, ast.walk(self.body)))))


@dataclass(frozen=True)
class Term:
    """A number of a cell, over a value or a flag of each build (over the builds alone for `rows`)."""

    kind: str
    over: Column

    def column(self) -> Column:
        match self.kind:
            case "sum":
                return F.sum(self.over)
            case "mean":
                return F.avg(self.over)
            case "min":
                return F.min(self.over)
            case "max":
                return F.max(self.over)
            case "rows":
                return F.count(F.lit(1)).cast("double")
            case "hits":
                return F.count_if(self.over).cast("double")
            case "share":
                return F.count_if(self.over).cast("double") / F.count(F.lit(1))
        raise FormulaError(f"{self.kind} is not an aggregate")


#: Reducers that need an order of the values.
PERCENTILES = {"median": 0.5, "p10": 0.1, "p90": 0.9}


@dataclass
class Plan:
    """Columns of one formula: terms of a cell, and a scalar over them.

    Bounds of `clip` that are taken over the cell are plans of their own, `hoisted`, whose value builds are given first.
    """

    formula: Formula
    prefix: str
    hoisted: dict[str, Plan] = field(default_factory=dict)
    terms: dict[str, Term] = field(default_factory=dict)
    nulls: list[str] = field(default_factory=list)
    notes: list[tuple[Column, str]] = field(default_factory=list)
    overflows: list[Column] = field(default_factory=list)
    inner: dict[int, Column] = field(default_factory=dict)
    flags: dict[str, tuple[Column, str | None]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.value = self._scalar(self.formula.body, F.col)

    @property
    def percentiles(self) -> dict[str, tuple[Column, float]]:
        return {n: (t.over, PERCENTILES[t.kind]) for n, t in self.terms.items() if t.kind in PERCENTILES}

    # -- a cell's numbers ---------------------------------------------------

    def _term(self, kind: str, over: Column, tag: str = "a") -> str:
        name = f"{self.prefix}{tag}{len(self.terms)}"
        self.terms[name] = Term(kind, over)
        return name

    def _scalar(self, node: ast.AST, of) -> Column:
        f = _called(node)
        match node:
            case ast.Constant(value=x):
                return F.lit(x if isinstance(x, (bool, str)) else float(x))
            case ast.UnaryOp(op=ast.USub()):
                return -self._scalar(node.operand, of)
            case ast.UnaryOp(op=ast.UAdd()):
                return self._scalar(node.operand, of)
            case ast.BinOp():
                return self._binary(node.op, self._scalar(node.left, of), self._scalar(node.right, of), self._note)
        if f in REDUCERS:
            values = self._build(node.args[0])
            self.nulls.append(self._term("hits", values.isNull(), "n"))
            got = of(self._term(f, values))
            if f in ("sum", "mean"):
                # finite values whose sum is not, or infinities of both signs: what no number stands for
                most = of(self._term("max", F.abs(values), "b"))
                self.overflows.append(F.coalesce(finite(got).isNull() & got.isNotNull() & (finite(most).isNotNull() | (F.isnan(got) & ~F.isnan(most))), F.lit(False)))
            return got
        if f in COUNTERS:
            if not node.args:
                return of(self._term("rows", F.lit(True)))
            return of(self._term("hits" if f == "count" else "share", F.coalesce(self._flag(node.args[0]), F.lit(False))))
        if f in NORMALISERS:
            k = self.formula.normalisers.index(node)
            self.inner[k] = self._scalar(node.args[0], of)
            return F.col(f"{self.prefix}z{k}")
        if f == "clip":
            return clip(*(self._scalar(a, of) for a in node.args))
        return _plain(f, self._scalar(node.args[0], of))

    def _note(self, when: Column, message: str) -> None:
        self.notes.append((when, f"{self.formula.name}: {message}"))

    def _binary(self, op: ast.AST, a: Column, b: Column, note) -> Column:
        match op:
            case ast.Add():
                return a + b
            case ast.Sub():
                return a - b
            case ast.Mult():
                return a * b
            case ast.Div():
                note((b == 0) & a.isNotNull(), "division by zero -> null")
                return F.try_divide(a, b)
            case _:
                out = F.pow(a, b)
                note(out.isNotNull() & finite(out).isNull(), "power outside finite real numbers -> null")
                return finite(out)

    # -- a build's values ---------------------------------------------------

    def _build(self, node: ast.AST) -> Column:
        f = _called(node)
        match node:
            case ast.Constant(value=x):
                return F.lit(x if isinstance(x, (bool, str)) else float(x))
            case ast.Name(id=x) if x in COLUMNS:
                return F.col(STORED.get(x, x)).cast("double") if x in NUMBERS else F.col(STORED.get(x, x))
            case ast.Name(id=x):
                return F.lit(x)
            case ast.UnaryOp(op=ast.USub()):
                return -self._build(node.operand)
            case ast.UnaryOp(op=ast.UAdd()):
                return self._build(node.operand)
            case ast.UnaryOp(op=ast.Not()):
                return ~self._build(node.operand)
            case ast.Compare():
                return _compare(node.ops[0], self._build(node.left), self._build(node.comparators[0]))
            case ast.BoolOp():
                out = self._build(node.values[0])
                for x in node.values[1:]:
                    out = strict(node.op, out, self._build(x))
                return out
            case ast.BinOp():
                return self._binary(node.op, self._build(node.left), self._build(node.right), self._build_note)
        if f == "clip":
            # bounds may hold reducers, which are taken over the cell first
            return clip(self._build(node.args[0]), *(self._hoist(a) for a in node.args[1:]))
        return _plain(f, self._build(node.args[0]))

    def _build_note(self, when: Column, message: str) -> None:
        self._note(F.col(self._term("hits", when, "e")) > 0, message)

    def _hoist(self, node: ast.AST) -> Column:
        if not any(_called(x) in REDUCERS + COUNTERS for x in ast.walk(node)):
            return self._scalar(node, F.col)
        inner = Plan.__new__(Plan)
        inner.formula, inner.prefix = self.formula, f"{self.prefix}h{len(self.hoisted)}_"
        inner.hoisted, inner.terms, inner.nulls, inner.notes, inner.overflows, inner.inner, inner.flags = {}, {}, [], [], [], {}, {}
        inner.value = inner._scalar(node, F.col)
        name = f"{inner.prefix}v"
        self.hoisted[name] = inner
        # what its terms have to say is the cell's, so it is taken from any of its builds
        for flag, message in inner.notes:
            inner.flags[f"{inner.prefix}f{len(inner.flags)}"] = (flag, message)
        for flag in inner.overflows:
            inner.flags[f"{inner.prefix}f{len(inner.flags)}"] = (flag, None)
        for flag, (_, message) in inner.flags.items():
            seen = F.col(self._term("hits", F.coalesce(F.col(flag), F.lit(False)), "e")) > 0
            if message is None:
                self.overflows.append(seen)
            else:
                self.notes.append((seen, message))
        return F.col(name)

    def _flag(self, node: ast.AST) -> Column:
        if isinstance(node, ast.Name):
            return F.col("impact" if node.id in IMPACT_CLASSES else "question") == node.id
        match node:
            case ast.BoolOp():
                out = self._flag(node.values[0])
                for x in node.values[1:]:
                    out = strict(node.op, out, self._flag(x))
                return out
            case ast.UnaryOp(op=ast.Not()):
                return ~self._flag(node.operand)
        return self._build(node)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def clip(value: Column, lo: Column, hi: Column) -> Column:
    """Null if a bound is null: greatest and least alone would skip it."""
    return F.when(value.isNotNull() & lo.isNotNull() & hi.isNotNull(), F.greatest(lo, F.least(hi, value)))


def strict(op: ast.AST, a: Column, b: Column) -> Column:
    """and/or that are null when either side is."""
    return F.when(a.isNull() | b.isNull(), None).otherwise(a & b if isinstance(op, ast.And) else a | b)


def _plain(f: str | None, x: Column) -> Column:
    match f:
        case "abs":
            return F.abs(x)
        case "sqrt":
            return F.when(x >= 0, F.sqrt(x))
        case "log":
            return F.when(x > 0, F.ln(x))
    raise FormulaError(f"{f}() has no value here")


def _compare(op: ast.AST, a: Column, b: Column) -> Column:
    match op:
        case ast.Eq():
            return a == b
        case ast.NotEq():
            return a != b
        case ast.Lt():
            return a < b
        case ast.LtE():
            return a <= b
        case ast.Gt():
            return a > b
        case _:
            return a >= b


def normalise(kind: str, value: Column, a: Column, b: Column) -> Column:
    """minmax with bounds (a, b), or z with mean and deviation (a, b); a constant maps off 0.5 (minmax) or 0 (z)."""
    if kind == "minmax":
        return F.when(b == a, 0.5 + (value - a) / F.greatest(F.lit(1.0), F.abs(a))).otherwise((value - a) / F.nullif(b - a, F.lit(0.0)))
    return F.when(b == 0, (value - a) / F.greatest(F.lit(1.0), F.abs(a))).otherwise((value - a) / F.nullif(b, F.lit(0.0)))
