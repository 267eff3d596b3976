"""Formulas of pipeline documents as Spark columns.

A formula is respelled as a Python expression and read by Python's own `ast` module; the tree is then folded into column
expressions that Catalyst optimises and compiles with the rest of the plan. Operators, lowest first: `||` `??`, `&&`,
comparisons, `+ -`, `* / %`, unary `! -`; all are left-associative. Texts stand in single or double quotes.

Comparisons are never null: null equals null and comes before everything else. What can go wrong in a row, a division by
zero or a text that is no date, is a second column beside the value, null where all is well; it is pruned from the plan
where nobody asks for it. Unknown functions, wrong numbers of arguments and bad syntax raise FormulaError at once.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import coerce
from .coerce import number, shown, truthy


class FormulaError(ValueError):
    """A formula that can't be compiled."""


@dataclass
class Value:
    col: Column
    kind: str
    err: Column | None = None
    literal: object = None
    bare: Column | None = None  # the same as a filter: null where the value is false

    def pair(self) -> tuple[Column, str]:
        return self.col, self.kind


TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d[\d.]*)|([^\W\d]\w*(?:\.[^\W\d]\w*)*)|(\?\?|&&|\|\||[=!<>]=|[-+*/%<>!(),]))""", re.S)
#: How operators are respelled; the mark between two `or` tells `??` from `||`.
MARK = "c_"
SPELLING = {"&&": "and", "||": "or", "??": f"or {MARK} or", "!": "~"}


def parse(source: str) -> ast.expr:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        found = TOKEN.match(source, at)
        if not found:
            raise FormulaError(f"{source[at:].strip()[:20]!r} can't be read at {at}")
        at = found.end()
        quoted, digits, word, operator = found.groups()
        if quoted is not None:
            out.append(repr(re.sub(r"\\(.)", r"\1", quoted[1:-1], flags=re.S)))
        elif digits is not None:
            try:
                out.append(repr(float(digits)))
            except ValueError:
                raise FormulaError(f"{digits} is no number") from None
        else:
            out.append(f"v_{word.replace('.', '.v_')}" if word else SPELLING.get(operator, operator))
    try:
        return ast.parse(" ".join(out), mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"{source!r} can't be read: {e.msg}") from None


def name_of(node: ast.expr) -> str:
    if isinstance(node, ast.Name):
        return node.id[2:]
    if isinstance(node, ast.Attribute):
        return f"{name_of(node.value)}.{node.attr[2:]}"
    raise FormulaError("a name is expected")


def first_error(*values: Value) -> Column | None:
    found = [v.err for v in values if v.err is not None]
    return F.coalesce(*found) if found else None


def loose_equal(l: Value, r: Value) -> Column:
    """Either null: both must be. A number on the left compares as numbers, all else as text."""
    if "null" in (l.kind, r.kind):
        return l.col.isNull() & r.col.isNull()
    if l.kind == r.kind and l.kind in ("long", "string", "boolean", "time"):
        return l.col.eqNullSafe(r.col)
    same = l.col.cast("double") == number(*r.pair()) if l.kind in ("long", "double") else shown(*l.pair()) == shown(*r.pair())
    return F.when(l.col.isNull() | r.col.isNull(), l.col.isNull() & r.col.isNull()).otherwise(same)


NUMERIC = ("long", "double")
COMPARE: dict[str, Callable[[Column, Column], Column]] = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
#: What a comparison gives if one side is null, which comes before everything else.
WITH_NULL: dict[str, Callable[[Column, Column], Column]] = {
    "<": lambda a, b: a.isNull() & b.isNotNull(), "<=": lambda a, b: a.isNull(), ">": lambda a, b: a.isNotNull() & b.isNull(), ">=": lambda a, b: b.isNull(),
}


def compare(op: str, l: Value, r: Value) -> Column:
    """Numbers and texts that spell numbers compare as numbers, all else as text with "" for null."""
    f = COMPARE[op]
    if l.kind in NUMERIC and r.kind in NUMERIC or l.kind == r.kind == "time":
        return F.coalesce(f(l.col, r.col), WITH_NULL[op](l.col, r.col))
    as_text = f(shown(*l.pair()), shown(*r.pair()))
    if {l.kind, r.kind} <= {"string", *NUMERIC}:
        a, b = (coerce.try_number(*v.pair(), trim=True) for v in (l, r))
        return F.when(a.isNotNull() & b.isNotNull(), f(a, b)).otherwise(as_text)
    return as_text


def bare_compare(op: str, l: Value, r: Value) -> Column | None:
    """A form that reaches the scan as a pushed filter: a column against a literal of its kind."""
    if r.literal is None or l.literal is not None:
        return None
    if op == "==" and (l.kind in NUMERIC and r.kind == "double" or l.kind == r.kind == "string"):
        return l.col == r.col
    if op in COMPARE and l.kind in NUMERIC and r.kind == "double":
        return COMPARE[op](l.col, r.col) if op in (">", ">=") else COMPARE[op](l.col, r.col) | l.col.isNull()
    return None


def add(l: Value, r: Value) -> Value:
    if "string" in (l.kind, r.kind):
        return Value(F.concat(shown(*l.pair()), shown(*r.pair())), "string", first_error(l, r))
    return Value(number(*l.pair()) + number(*r.pair()), "double", first_error(l, r))


def divide(l: Value, r: Value) -> Value:
    below = number(*r.pair())
    bad = F.when(below == 0, F.lit("expression: division by zero"))
    return Value(F.try_divide(number(*l.pair()), below), "double", first_error(l, r, Value(below, "double", bad)))


def modulo(l: Value, r: Value) -> Value:
    """Whole numbers, both cut towards 0; the sign is the left one's."""
    a, b = (number(*v.pair()).try_cast("bigint") for v in (l, r))
    bad = F.when(F.coalesce(b == 0, F.lit(True)), F.lit("expression: modulo by zero"))
    return Value(F.when(b != 0, F.try_mod(a, b)).cast("double"), "double", first_error(l, r, Value(b, "long", bad)))


def merged(values: list[Value], pick: Callable[[list[Column], str], Column]) -> Value:
    """One kind for all values."""
    cols, kind = coerce.same_kind([v.pair() for v in values])
    return Value(pick(cols, kind), kind, first_error(*values))


def rounded(x: Column, digits: Column) -> Column:
    """Half away from zero, on the double itself; negative digits count as 0."""
    m = F.pow(F.lit(10.0), F.greatest(digits.try_cast("bigint").cast("double"), F.lit(0.0)))
    a = F.abs(x) * m
    whole = F.floor(a).cast("double")
    return F.when((a < coerce.EXACT), F.signum(x) * (whole + F.when(a - whole >= 0.5, 1.0).otherwise(0.0)) / m).otherwise(x)


CLOCK = r"([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?"
DATE = rf"^(\d{{4}}-\d\d-\d\d(T{CLOCK}(Z|[+-]\d\d:\d\d)| {CLOCK})?|\d{{4}}/\d\d/\d\d)$"


def date_part(part: Callable[[Column], Column], v: Value) -> Value:
    """Of the date as written, whatever its zone."""
    if v.kind == "time":
        bad = F.when(v.col.isNull(), F.lit('expression: cannot parse date ""'))
        return Value(part(v.col).cast("double"), "double", first_error(v, Value(v.col, "time", bad)))
    written = shown(*v.pair())
    day = F.when(written.rlike(DATE), F.translate(F.substring(written, 1, 10), "/", "-").try_cast("date"))
    bad = F.when(day.isNull(), F.concat(F.lit('expression: cannot parse date "'), written, F.lit('"')))
    return Value(part(day).cast("double"), "double", first_error(v, Value(day, "time", bad)))


def piece(s: Column, start: Column, end: Column | None) -> Column:
    """Characters from start, counted from 0, up to but without end; both are clamped."""
    size = F.char_length(s)
    low = F.least(F.greatest(start.try_cast("int"), F.lit(0)), size)
    high = size if end is None else F.least(F.greatest(end.try_cast("int"), F.lit(0)), size)
    return F.substring(s, low + 1, F.greatest(high - low, F.lit(0)))


def replaced(s: Column, old: Value, new: Value) -> Column:
    if old.literal == "":
        if not isinstance(new.literal, str):
            raise FormulaError("replace: an empty text can only be replaced by a literal one")
        return F.regexp_replace(s, "", re.sub(r"([\\$])", r"\\\1", new.literal))
    return F.replace(s, shown(*old.pair()), shown(*new.pair()))


def scalar(kind: str, f: Callable[..., Column], convert: Callable[[Column, str], Column]) -> Callable[[list[Value]], Value]:
    return lambda a: Value(f(*(convert(*v.pair()) for v in a)), kind, first_error(*a))


def least_of(f: Callable[..., Column]) -> Callable[[list[Value]], Value]:
    return lambda a: Value(f(*(number(*v.pair()) for v in a)) if len(a) > 1 else number(*a[0].pair()), "double", first_error(*a))


def choose(a: list[Value]) -> Value:
    test, *rest = a
    out = merged(rest, lambda c, _: F.when(truthy(*test.pair()), c[0]).otherwise(c[1]))
    return Value(out.col, out.kind, first_error(*a))


def first_filled(cols: list[Column], kind: str) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) if kind == "string" else c for c in cols))


MOST_ARGUMENTS = 1 << 16
#: name: (least and most arguments, function of the argument values); missing arguments up to the most are null where `fill` is set.
FUNCTIONS: dict[str, tuple[int, int, Callable[[list[Value]], Value]]] = {
    "contains": (2, 2, scalar("boolean", F.contains, shown)),
    "startswith": (2, 2, scalar("boolean", F.startswith, shown)),
    "endswith": (2, 2, scalar("boolean", F.endswith, shown)),
    "upper": (1, 1, scalar("string", F.upper, shown)),
    "lower": (1, 1, scalar("string", F.lower, shown)),
    "trim": (1, 1, scalar("string", coerce.strip, shown)),
    "concat": (0, MOST_ARGUMENTS, lambda a: Value(F.concat(F.lit(""), *(shown(*v.pair()) for v in a)), "string", first_error(*a))),
    "length": (1, 1, scalar("double", lambda s: F.char_length(s).cast("double"), shown)),
    "len": (1, 1, scalar("double", lambda s: F.char_length(s).cast("double"), shown)),
    "replace": (3, 3, lambda a: Value(replaced(shown(*a[0].pair()), a[1], a[2]), "string", first_error(*a))),
    "substr": (2, 3, lambda a: Value(piece(shown(*a[0].pair()), number(*a[1].pair()), number(*a[2].pair()) if len(a) > 2 else None), "string", first_error(*a))),
    "round": (1, 2, lambda a: Value(rounded(number(*a[0].pair()), number(*a[1].pair()) if len(a) > 1 else F.lit(0.0)), "double", first_error(*a))),
    "abs": (1, 1, scalar("double", F.abs, number)),
    "min": (1, MOST_ARGUMENTS, least_of(F.least)),
    "max": (1, MOST_ARGUMENTS, least_of(F.greatest)),
    "isnull": (1, 1, lambda a: Value(a[0].col.isNull(), "boolean", first_error(*a))),
    "isempty": (1, 1, lambda a: Value(coerce.missing(*a[0].pair()), "boolean", first_error(*a))),
    "coalesce": (0, MOST_ARGUMENTS, lambda a: merged(a, first_filled) if a else Value(F.lit(None), "null")),
    "if": (2, 3, lambda a: choose([*a, Value(F.lit(None), "null")][:3])),
    "ifelse": (2, 3, lambda a: choose([*a, Value(F.lit(None), "null")][:3])),
    "now": (0, 0, lambda a: Value(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"), "string")),
    "year": (1, 1, lambda a: date_part(F.year, a[0])),
    "month": (1, 1, lambda a: date_part(F.month, a[0])),
    "day": (1, 1, lambda a: date_part(F.dayofmonth, a[0])),
}
BINARY: dict[type, Callable[[Value, Value], Value]] = {
    ast.Add: add,
    ast.Sub: lambda l, r: Value(number(*l.pair()) - number(*r.pair()), "double", first_error(l, r)),
    ast.Mult: lambda l, r: Value(number(*l.pair()) * number(*r.pair()), "double", first_error(l, r)),
    ast.Div: divide,
    ast.Mod: modulo,
}
SIGNS: dict[type, str] = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "==", ast.NotEq: "!="}


def compared(op: str, l: Value, r: Value) -> Value:
    if op in ("==", "!="):
        same = loose_equal(l, r)
        return Value(same if op == "==" else ~same, "boolean", first_error(l, r), bare=bare_compare(op, l, r))
    return Value(compare(op, l, r), "boolean", first_error(l, r), bare=bare_compare(op, l, r))


def either(l: Value, r: Value, both: bool) -> Value:
    """`&&` and `||`; the right side's error counts only where the left side doesn't decide."""
    a, b = truthy(*l.pair()), truthy(*r.pair())
    late = r.err if r.err is None else F.when(a if both else ~a, r.err)
    err = first_error(l, Value(b, "boolean", late))
    bare = ((l.bare if l.bare is not None else a) & (r.bare if r.bare is not None else b)) if both else None
    return Value(a & b if both else a | b, "boolean", err, bare=bare)


def fold(node: ast.expr, df: DataFrame) -> Value:
    each = lambda x: fold(x, df)
    match node:
        case ast.Constant(value=x):
            return Value(F.lit(x), "string" if isinstance(x, str) else "double", literal=x)
        case ast.Name() | ast.Attribute():
            return Value(*coerce.field(df, name_of(node)))
        case ast.UnaryOp(op=ast.Invert(), operand=x):
            v = each(x)
            return Value(~truthy(*v.pair()), "boolean", v.err)
        case ast.UnaryOp(op=ast.USub(), operand=x):
            v = each(x)
            return Value(-number(*v.pair()), "double", v.err, literal=-v.literal if isinstance(v.literal, float) else None)
        case ast.BinOp(left=l, op=op, right=r) if type(op) in BINARY:
            return BINARY[type(op)](each(l), each(r))
        case ast.Compare(left=l, ops=ops, comparators=others):
            v = each(l)
            for op, r in zip(ops, others, strict=True):
                v = compared(SIGNS[type(op)], v, each(r))
            return v
        case ast.BoolOp(op=ast.And(), values=values):
            v = each(values[0])
            for r in values[1:]:
                v = either(v, each(r), both=True)
            return v
        case ast.BoolOp(op=ast.Or(), values=values):
            v, fill = each(values[0]), False
            for r in values[1:]:
                if isinstance(r, ast.Name) and r.id == MARK:
                    fill = True
                elif fill:
                    v, fill = merged([v, each(r)], lambda c, _: F.coalesce(*c)), False
                else:
                    v = either(v, each(r), both=False)
            return v
        case ast.Call(func=ast.Name() as f, args=args, keywords=[]):
            known = name_of(f).lower()
            if known not in FUNCTIONS:
                raise FormulaError(f"there is no function {name_of(f)}")
            least, most, make = FUNCTIONS[known]
            if not least <= len(args) <= most:
                raise FormulaError(f"{known} takes {least} to {most} arguments, not {len(args)}")
            return make([each(x) for x in args])
    raise FormulaError(f"{ast.unparse(node)!r} is no formula")


def compile(source: str, df: DataFrame) -> Value:  # noqa: A001
    """The value of a formula over the columns of `df`; names that it lacks are null."""
    try:
        return fold(parse(source), df)
    except RecursionError:
        raise FormulaError("the formula is nested too deeply") from None


def validate(source: str, df: DataFrame | None = None) -> str | None:
    """What is wrong with a formula, or nothing; with a DataFrame its columns must exist too."""
    try:
        tree = parse(source)
        for node in ast.walk(tree):
            if isinstance(node, ast.Call) and (name_of(node.func).lower() not in FUNCTIONS):
                return f"there is no function {name_of(node.func)}"
        if df is not None:
            called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
            inner = {id(n.value) for n in ast.walk(tree) if isinstance(n, ast.Attribute)}
            unknown = [name_of(n) for n in ast.walk(tree) if isinstance(n, (ast.Name, ast.Attribute)) and id(n) not in called | inner and getattr(n, "id", "") != MARK and name_of(n) not in df.columns]
            if unknown:
                return f"there is no column {unknown[0]}"
            fold(tree, df)
    except FormulaError as e:
        return str(e)
    except RecursionError:
        return "the formula is nested too deeply"
    return None
