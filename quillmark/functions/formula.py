"""Metric formulas: arithmetic text compiled to Spark columns.

Allowed are names, numbers, ``+ - * /``, signs and brackets.  A missing operand
or a division by zero gives null.  Formulas may use each other; a cycle is null.
"""

from __future__ import annotations

import ast
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPERATORS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide}


class FormulaError(ValueError):
    """The formula holds something other than arithmetic."""


def parse(formula: str) -> ast.expr:
    """The checked tree of a formula."""
    try:
        tree = ast.parse(formula, mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"not a formula: {formula!r}") from e
    _check(tree, formula)
    return tree


def _check(node: ast.AST, formula: str) -> None:
    match node:
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _OPERATORS:
            _check(a, formula)
            _check(b, formula)
        case ast.UnaryOp(op=ast.USub() | ast.UAdd(), operand=a):
            _check(a, formula)
        case ast.Constant(value=v) if isinstance(v, int | float) and not isinstance(v, bool):
            pass
        case ast.Name():
            pass
        case _:
            raise FormulaError(f"{type(node).__name__} isn't allowed in {formula!r}")


def names(tree: ast.AST) -> set[str]:
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)}


def to_column(tree: ast.expr, known: Mapping[str, Column]) -> Column:
    """The formula as a column; a name that isn't known is null."""
    match tree:
        case ast.BinOp(left=a, op=op, right=b):
            return _OPERATORS[type(op)](to_column(a, known), to_column(b, known))
        case ast.UnaryOp(op=ast.USub(), operand=a):
            return -to_column(a, known)
        case ast.UnaryOp(operand=a):
            return to_column(a, known)
        case ast.Constant(value=v):
            return F.lit(float(v))
    return known.get(tree.id, F.lit(None).cast("double"))


def layers(trees: Mapping[str, ast.expr]) -> list[list[str]]:
    """Formulas in groups that only use earlier groups; cycles are left out."""
    needs = {k: names(t) & trees.keys() for k, t in trees.items()}
    done: set[str] = set()
    out = []
    while now := [k for k in trees if k not in done and needs[k] <= done]:
        out.append(now)
        done |= set(now)
    return out


def with_metrics(wide: DataFrame, formulas: Mapping[str, str], inputs: Iterable[str] | None = None) -> DataFrame:
    """``wide`` with a double column for each formula.

    Each layer is one projection, so the optimiser sees plain expressions.
    ``inputs`` are the columns that formulas may name, by default all.  Where a
    formula is called like an input, others read the metric once it has a value
    and the input until then.
    """
    trees = {k: parse(f) for k, f in formulas.items()}
    given = list(wide.columns if inputs is None else inputs)
    known = {c: F.col(f"`{c}`").cast("double") for c in given}
    made = {k: f"_metric_{i}" for i, k in enumerate(trees)}
    for layer in layers(trees):
        wide = wide.withColumns({made[k]: to_column(trees[k], known) for k in layer})
        for k in layer:
            known[k] = F.coalesce(F.col(made[k]), known[k]) if k in known else F.col(made[k])
    missing = [k for k in trees if made[k] not in wide.columns]
    wide = wide.withColumns({made[k]: F.lit(None).cast("double") for k in missing}) if missing else wide
    rest = [F.col(f"`{c}`") for c in wide.columns if c not in made.values() and c not in made]
    return wide.select(*rest, *(F.col(made[k]).alias(k) for k in trees))
