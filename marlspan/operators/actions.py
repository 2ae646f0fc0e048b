"""Actions in free text: balanced JSON objects, and arithmetic compiled to columns."""

from __future__ import annotations

import ast
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def decoded(text: str | None) -> Iterator[tuple[object, int, int]]:
    """(value, start, end) of the JSON values that begin with a brace, from every brace on."""
    decoder, at = json.JSONDecoder(), (text or "").find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
            yield value, at, end
        except ValueError:
            pass
        at = text.find("{", at + 1)


def json_objects(text: str | None, keys: tuple[str, ...] = ("action", "name")) -> list[tuple[str, int, int]]:
    """(canonical object, start, end) of the objects with one of the keys, none within another."""
    out, free = [], 0
    for value, start, end in decoded(text):
        if start >= free and any(k in value for k in keys):
            out.append((json.dumps(value, sort_keys=True), start, end))
            free = end
    return out


def only_field(text: str | None, field: str) -> str | None:
    """The value, as JSON, of the first object whose only key is the field."""
    return next((json.dumps(v[field]) for v, _, _ in decoded(text) if set(v) == {field}), None)


def numbers_of(text: str | None) -> list[float] | None:
    """Every finite number at any depth of a JSON text, in order; booleans are none; null for no JSON."""

    def walk(v):
        if isinstance(v, dict | list):
            for x in v.values() if isinstance(v, dict) else v:
                yield from walk(x)
        elif isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v):
            yield float(v)

    try:
        return list(walk(json.loads(text)))
    except (TypeError, ValueError):
        return None


ACTION = T.StructType([T.StructField("value", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def _each(work, kind: T.DataType, text: Column | str) -> Column:
    """A function of one text, for what only a parser can tell, on Arrow batches."""
    arrow = to_arrow_type(kind)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([work(t) for t in texts.to_pylist()], arrow)

    return F.arrow_udf(run, kind)(text)


def actions(text: Column | str) -> Column:
    """All actions of a text, in order: value, start, end."""
    return _each(lambda t: [{"value": v, "start": a, "end": b} for v, a, b in json_objects(t)], T.ArrayType(ACTION), text)


def first_action(text: Column | str) -> Column:
    """The first action with its span; null if there is none."""
    return F.get(actions(text), F.lit(0))


def strict_field(text: Column | str, field: str) -> Column:
    return _each(lambda t: only_field(t, field), T.StringType(), text)


def finite_numbers(text: Column | str) -> Column:
    return _each(numbers_of, T.ArrayType(T.DoubleType()), text)


# ---- the calculator ----


class CalculatorError(ValueError):
    """The program uses something that the calculator does not know."""


def _items(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def _mean(x: Column) -> Column:
    return F.try_divide(F.aggregate(_items(x), F.lit(0.0), lambda a, v: a + v), F.size(x).cast("double"))


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_items(a), _items(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


FUNCTIONS = {
    "abs": F.abs, "sqrt": F.sqrt, "hypot": F.hypot, "min": lambda *a: F.array_min(a[0]) if len(a) == 1 else F.least(*a), "max": lambda *a: F.array_max(a[0]) if len(a) == 1 else F.greatest(*a),
    "sum": lambda x: F.aggregate(_items(x), F.lit(0.0), lambda a, v: a + v), "round": lambda x, n=None: F.bround(x, 0 if n is None else n), "mean": _mean,
    "std": lambda x: F.sqrt(_mean(F.transform(_items(x), lambda v: (v - _mean(x)) * (v - _mean(x))))),
    "norm": lambda x: F.sqrt(F.aggregate(_items(x), F.lit(0.0), lambda a, v: a + v * v)), "dist": _distance,
    "path_length": lambda points: F.aggregate(F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), _distance), F.lit(0.0), lambda a, v: a + v),
}
_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a.cast("double"), b), ast.Pow: F.pow, ast.Mod: F.pmod}


def compile_program(code: str, bindings: dict[str, Column], most_statements: int = 32, most_chars: int = 4096) -> dict[str, Column]:
    """The program's variables as columns: assignments of arithmetic, lists, indexing and the known functions."""
    if len(code) > most_chars:
        raise CalculatorError("the program is too long")
    body = ast.parse(code).body
    if len(body) > most_statements:
        raise CalculatorError("the program has too many statements")
    scope, out = dict(bindings), {}

    def value(node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=v) if isinstance(v, int | float) and not isinstance(v, bool):
                return F.lit(v)
            case ast.Name(id=name):
                if name not in scope:
                    raise CalculatorError(f"unknown name {name}")
                return scope[name]
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](value(a), value(b))
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -value(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return value(x)
            case ast.List(elts=items) | ast.Tuple(elts=items):
                return F.array(*map(value, items))
            case ast.Subscript(value=x, slice=ast.Slice(lower=a, upper=b, step=None)):
                low = 0 if a is None else ast.literal_eval(a)
                size = F.size(value(x)) - low if b is None else F.lit(ast.literal_eval(b) - low)
                return F.slice(value(x), F.lit(low + 1), size)
            case ast.Subscript(value=x, slice=i):
                at = ast.literal_eval(i)
                return F.try_element_at(value(x), F.lit(at + 1 if at >= 0 else at))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FUNCTIONS:
                if name == "round" and len(args) == 2:
                    return FUNCTIONS[name](value(args[0]), ast.literal_eval(args[1]))
                return FUNCTIONS[name](*map(value, args))
        raise CalculatorError(f"not allowed: {ast.unparse(node)}")

    for statement in body:
        match statement:
            case ast.Assign(targets=[ast.Name(id=name)], value=node):
                scope[name] = out[name] = value(node)
            case ast.Expr(value=node):
                out["result"] = value(node)
            case _:
                raise CalculatorError(f"not allowed: {ast.unparse(statement)}")
    return out
