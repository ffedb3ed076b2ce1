"""Comparison metrics and whitelisted arithmetic over whole columns."""

from __future__ import annotations

import ast
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names an expression may use besides columns.
ALLOWED_FUNCTIONS = ("abs", "round", "min", "max", "sum", "len", "pow", "sqrt", "ceil", "floor", "log", "log10")
ALLOWED_CONSTANTS = {"pi": math.pi, "e": math.e}


def change_columns(old: Column, new: Column, digits: int | None = 2) -> dict[str, Column]:
    """Change from ``old`` to ``new``; a zero base gives status ``error``.

    Direction follows the unrounded difference. ``digits=None`` skips rounding.
    """
    base = old.cast("double")
    difference = new.cast("double") - base
    percent = F.try_divide(difference, base) * 100.0
    ok = base != 0.0

    def rounded(value: Column) -> Column:
        return value if digits is None else F.round(value, digits)

    return {
        "status": F.when(ok, F.lit("success")).when(base == 0.0, F.lit("error")),
        "absolute_difference": F.when(ok, rounded(difference)),
        "percentage_change": F.when(ok, rounded(percent)),
        "direction": F.when(
            ok,
            F.when(difference > 0, F.lit("up")).when(difference < 0, F.lit("down")).otherwise(F.lit("unchanged")),
        ),
    }


def share_columns(part: Column, total: Column, digits: int | None = 2) -> dict[str, Column]:
    """Share of ``part`` in ``total`` in percent; a zero total gives ``error``."""
    whole = total.cast("double")
    percent = F.try_divide(part.cast("double"), whole) * 100.0
    return {
        "status": F.when(whole != 0.0, F.lit("success")).when(whole == 0.0, F.lit("error")),
        "percentage": percent if digits is None else F.round(percent, digits),
    }


def derive(df: DataFrame, name: str, expression: str, status: str | None = None) -> DataFrame:
    """Add ``name``, computed by an arithmetic expression over numeric columns.

    The expression may use columns, numbers, lists, ``+ - * / // % **`` and the
    allowed names; any other name raises before a job starts. Rows that cannot
    be computed (zero divisor, value out of domain) are null, and ``error`` in
    the optional ``status`` column unless an input is null.
    """
    used: list[str] = []
    raw = _to_column(ast.parse(expression.strip(), mode="eval").body, set(df.columns), used)
    value = F.when(~F.isnan(raw) & (F.abs(raw) != float("inf")), raw)
    out = df.withColumn(name, value)
    if status is None:
        return out
    inputs_known = F.lit(True)
    for column in sorted(set(used)):
        inputs_known = inputs_known & F.col(f"`{column}`").isNotNull()
    return out.withColumn(
        status,
        F.when(F.col(f"`{name}`").isNotNull(), F.lit("success")).when(inputs_known, F.lit("error")),
    )


def _to_column(node: ast.expr, columns: set[str], used: list[str]) -> Column:
    def walk(inner: ast.expr) -> Column:
        return _to_column(inner, columns, used)

    match node:
        case ast.Constant(value=bool()):
            pass
        case ast.Constant(value=int() | float() as number):
            return F.lit(float(number))
        case ast.Name(id=name) if name in columns:
            used.append(name)
            return F.col(f"`{name}`").cast("double")
        case ast.Name(id=name) if name in ALLOWED_CONSTANTS:
            return F.lit(ALLOWED_CONSTANTS[name])
        case ast.UnaryOp(op=ast.USub(), operand=operand):
            return -walk(operand)
        case ast.UnaryOp(op=ast.UAdd(), operand=operand):
            return walk(operand)
        case ast.BinOp(left=left, op=operator, right=right):
            a, b = walk(left), walk(right)
            quotient = F.try_divide(a, b)
            match operator:
                case ast.Add():
                    return a + b
                case ast.Sub():
                    return a - b
                case ast.Mult():
                    return a * b
                case ast.Div():
                    return quotient
                case ast.FloorDiv():
                    return F.floor(quotient).cast("double")
                case ast.Mod():
                    return F.when(b != 0.0, F.pmod(F.pmod(a, b) + b, b))
                case ast.Pow():
                    return F.pow(a, b)
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in ALLOWED_FUNCTIONS:
            return _call(name, args, walk)
    raise ValueError(
        f"not allowed in an expression: {ast.unparse(node)!r}; use columns, numbers, arithmetic and "
        + ", ".join((*ALLOWED_FUNCTIONS, *ALLOWED_CONSTANTS))
    )


def _call(name: str, args: list[ast.expr], walk) -> Column:
    if name in ("min", "max", "sum", "len"):
        listed = args[0].elts if len(args) == 1 and isinstance(args[0], (ast.List, ast.Tuple)) else args
        items = [walk(item) for item in listed]
        if name == "len":
            return F.lit(float(len(items)))
        if name == "sum":
            return sum(items[1:], items[0]) if items else F.lit(0.0)
        known = F.lit(True)
        for item in items:
            known = known & item.isNotNull()
        if len(items) == 1:
            return items[0]
        return F.when(known, F.least(*items) if name == "min" else F.greatest(*items))
    if name == "round":
        digits = ast.literal_eval(args[1]) if len(args) == 2 else 0
        return F.bround(walk(args[0]), int(digits))
    values = [walk(arg) for arg in args]
    if name == "pow":
        return F.pow(values[0], values[1])
    if name == "log":
        if len(values) == 1:
            return F.log(values[0])
        return F.try_divide(F.log(values[0]), F.log(values[1]))
    one = {"abs": F.abs, "sqrt": F.sqrt, "ceil": F.ceil, "floor": F.floor, "log10": F.log10}[name]
    return one(values[0]).cast("double")
