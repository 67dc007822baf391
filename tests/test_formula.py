import ast
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.functions.formula import Formula, FormulaError
from millrace.functions.metrics import DEFAULTS, Metric, by_name, definitions_hash, greyed, readings, told
from millrace.operators.cells import build_cells, evaluate

FORBIDDEN = [
    "cost_usd", "sum(sum(bugs))", "__import__('os')", "sum(bugs).x", "[1]", "count(nothing)", "share()", "minmax(z(count()))", "1 if 2 else 3", "'a'", "sum(question)", "lambda: 1", "count(1 < bugs < 3)", "True",
    "sum(bugs, 1)", "clip(1, 2)", "1e999", "sum(minmax(bugs))", "f'x'", "count(liability and sunk)", "sum(bugs) + 'x'", "not 1", "sum(x for x in bugs)", "bugs", "count(bugs)", "sum(bugs, key=1)", "1 @ 2", "{}", "sum(count())",
]
BUILDS = """grp string, win string, build_id string, usage double, loc_added double, loc_removed double, loc_total double, bugs double, cost_usd double, question string, carried_into string, impact string,
lead_time_days double, lead_time_source string, deployed boolean, served boolean, gate_unavailable boolean, age_days double"""


def rows(*four):
    return [("g", "w", f"b{i}", u, 100.0, 5.0, loc, bugs, cost, q, None, impact, lead, "SERVED", True, True, False, 50.0) for i, (u, loc, bugs, cost, q, impact, lead) in enumerate(four)]


FOUR = rows((10.0, 200.0, 1.0, 500.0, "features", "impactful", 3.0), (1.0, 205.0, None, 300.0, "features", "low_impact", 9.0), (0.0, 200.0, 0.0, None, "economics", "liability", None), (None, 200.0, 4.0, 600.0, None, "sunk", None))


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame(FOUR, BUILDS)


@pytest.mark.parametrize("bad", FORBIDDEN)
def test_refused(bad):
    with pytest.raises(FormulaError):
        Formula("x", bad)


def test_limits():
    for bad in ("1" + "+1" * 400, "sum(bugs)" + " " * 5000, "-" * 80 + "1"):
        with pytest.raises(FormulaError):
            Formula("x", bad)


@pytest.mark.parametrize(
    "expression, value",
    [
        ("sum(cost_usd)", 1400.0), ("mean(cost_usd)", 1400 / 3), ("sum(loc_total)", 805.0), ("median(lead_time_days)", 6.0), ("p90(lead_time_days)", 8.4), ("p10(lead_time_days)", 3.6), ("share(liability)", 0.25), ("share(features)", 0.5),
        ("count()", 4.0), ("count(impact == nothing)", 0.0), ("sum(cost_usd) / count(impact == bogus)", None), ("count(bugs > 0)", 2.0), ("share(not bugs > 0)", 0.25), ("count(bugs > 0 or usage > 100)", 1.0),
        ("(0 - 1) ** 0.5", None), ("10 ** 400", None), ("sqrt(0 - 1)", None), ("log(0)", None), ("log(1)", 0.0), ("abs(0 - 3)", 3.0), ("sum(clip(bugs, 0, median(bugs)))", 2.0), ("clip(5, 0, sum(bugs) / 0)", None),
        ("max(usage) - min(usage)", 10.0), ("sum(1)", 4.0), ("count(question == 'features')", 2.0), ("count(deployed == True)", 4.0), ("+1 - -2", 3.0), ("minmax(count())", 0.5), ("z(count())", 0.0),
    ],
)
def test_values(four, expression, value):
    r = evaluate(four, [Metric("x", "descriptor", "min", expression)]).first()
    assert r["x"] == (pytest.approx(value) if value is not None else None)


def test_nulls_and_notes(four):
    r = evaluate(four, [Metric("x", "descriptor", "min", "sum(cost_usd) / (count() - count())")]).first()
    assert r["null_x"] == 1 and r["note_x"] == ["x: division by zero -> null"]


def test_notes_of_normalisers_and_overflow(four):
    ask = lambda e: evaluate(four, [Metric("x", "descriptor", "min", e)]).first()
    r = ask("minmax(count())")
    assert r["x"] == 0.5 and r["note_x"] == ["x: minmax of a constant -> 0.5"]
    r = ask("z(count())")
    assert r["x"] == 0.0 and r["note_x"] == ["x: z of a constant -> 0.0"]
    r = ask("count() * 10 ** 308 * 10 ** 5")
    assert r["x"] is None and r["note_x"] == ["x: the result is not finite -> null"]
    r = ask("minmax(count() * 10 ** 308 * 10 ** 5)")
    assert r["x"] is None and r["note_x"] == ["x: minmax of a number that is not finite -> null"]
    assert ask("sum(clip(bugs, 0, sum(bugs) / 0))")["note_x"] == ["x: division by zero -> null"]
    assert ask("sum(usage * 10 ** 308)")["note_x"] == ["x: the result is not finite -> null"]  # an infinity among its values
    for e in ("sum(loc_total * 0 + 10 ** 308)", "mean(loc_total * 0 + 10 ** 308)", "sum((bugs - 0.5) * 10 ** 308 * 10 ** 5)", "sum(clip(bugs, 0, sum(loc_total * 0 + 10 ** 308)))"):
        with pytest.raises(Exception, match="outside the range"):
            ask(e)


def test_empty_and_all_null(spark):
    none = spark.createDataFrame([], BUILDS)
    assert build_cells(none, DEFAULTS).collect() == []
    r = evaluate(spark.createDataFrame(rows((None, 1.0, None, None, None, None, None)), BUILDS), [Metric("x", "descriptor", "min", "sum(cost_usd)"), Metric("y", "descriptor", "min", "median(bugs)")]).first()
    assert r["x"] is None and r["y"] is None


def test_reads_and_overlaps():
    m = by_name(DEFAULTS, ["cost", "lead_time", "debt_composite"])
    found = readings(m)
    assert [o["kind"] for o in told(found)] == ["mix_part"] and greyed(found) == {"liability": ["debt_composite"], "sunk": ["debt_composite"]}
    gate = Metric("g", "objective", "min", "mean(usage)")
    assert told(readings([gate]))[0]["line"].startswith("SHARED_INPUT")
    assert len(definitions_hash(m)) == 16 and definitions_hash(m) == definitions_hash(m[::-1])
    both = Metric("both", "objective", "min", "share(features) + count(impact == sunk) + mean(usage)")
    assert [tuple(r) for r in readings([gate, both])] == [("g", "gate", "usage"), ("both", "impact", "sunk"), ("both", "question", "features")]
    with pytest.raises(ValueError):
        by_name(DEFAULTS, ["nothing"])


# -- against an interpreter that is as plain as can be ----------------------

_NUMBERS = ["usage", "bugs", "cost_usd", "lead_time_days"]


def _vector(depth):
    leaf = st.sampled_from(_NUMBERS) | st.integers(0, 9).map(str)
    return leaf if not depth else leaf | st.tuples(_vector(depth - 1), st.sampled_from("+-*/"), _vector(depth - 1)).map(lambda t: f"({t[0]} {t[1]} {t[2]})")


def _flag(depth):
    leaf = st.tuples(_vector(1), st.sampled_from(["<", "<=", ">", ">=", "==", "!="]), _vector(1)).map(lambda t: f"({t[0]} {t[1]} {t[2]})")
    return leaf if not depth else leaf | st.tuples(_flag(depth - 1), st.sampled_from(["and", "or"]), _flag(depth - 1)).map(lambda t: f"({t[0]} {t[1]} {t[2]})") | _flag(depth - 1).map(lambda x: f"(not {x})")


_SCALAR = st.tuples(st.sampled_from(["sum", "mean", "median", "min", "max", "p90"]), _vector(2)).map(lambda t: f"{t[0]}({t[1]})") | st.tuples(st.sampled_from(["count", "share"]), _flag(2)).map(lambda t: f"{t[0]}({t[1]})")
NAMES = [c.split()[0] for c in BUILDS.replace("\n", " ").split(",")]
DICTS = [dict(zip([n.strip() for n in NAMES], r)) for r in FOUR]


def plain(node, b):
    """One build's value, null where anything it needs is."""
    match node:
        case ast.Constant(value=v):
            return float(v)
        case ast.Name(id=x):
            return b[x]
        case ast.UnaryOp():
            x = plain(node.operand, b)
            return None if x is None else not x
        case ast.BoolOp():
            xs = [plain(v, b) for v in node.values]
            return None if None in xs else all(xs) if isinstance(node.op, ast.And) else any(xs)
    left, right = (plain(node.left, b), plain(node.right if isinstance(node, ast.BinOp) else node.comparators[0], b))
    if left is None or right is None:
        return None
    op = type(node.op if isinstance(node, ast.BinOp) else node.ops[0]).__name__
    if op == "Div":
        return None if right == 0 else left / right
    return {"Add": left + right, "Sub": left - right, "Mult": left * right, "Lt": left < right, "LtE": left <= right, "Gt": left > right, "GtE": left >= right, "Eq": left == right, "NotEq": left != right}[op]


def interpreted(expression):
    call = ast.parse(expression, mode="eval").body
    xs = [plain(call.args[0], b) for b in DICTS]
    f = call.func.id
    if f in ("count", "share"):
        return sum(bool(x) for x in xs) / (len(xs) if f == "share" else 1)
    xs = sorted(x for x in xs if x is not None)
    if not xs:
        return None
    at = {"median": 0.5, "p90": 0.9}.get(f)
    if at is not None:
        p = at * (len(xs) - 1)
        lo, hi = math.floor(p), math.ceil(p)
        return xs[lo] + (xs[hi] - xs[lo]) * (p - lo)
    return {"sum": sum(xs), "mean": sum(xs) / len(xs), "min": xs[0], "max": xs[-1]}[f]


@settings(max_examples=4, deadline=None)
@given(st.lists(_SCALAR, min_size=12, max_size=12))
def test_compiled_equals_interpreted(spark, expressions):
    four = spark.createDataFrame(FOUR, BUILDS)
    r = evaluate(four, [Metric(f"m{i}", "descriptor", "min", e) for i, e in enumerate(expressions)]).first()
    for i, e in enumerate(expressions):
        want = interpreted(e)
        assert r[f"m{i}"] == (None if want is None else pytest.approx(want, rel=1e-9, abs=1e-9)), e
