"""SQL predicates on numpy columns: for folds and stream states, where a patch must be judged before the next scan is read.

Spark's own parser reads the expression; what it finds is turned into nested tuples that tasks can evaluate on arrays. Null is NaN; conditions follow three-valued
logic and a null counts as false. Numbers are doubles; a division by zero raises, as in Spark.
"""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import SparkSession


def _divided(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if np.any((y == 0) & ~np.isnan(x)):
        raise ZeroDivisionError("division by zero in a filter expression")
    return x / y


def _condition(test: np.ndarray, *inputs: np.ndarray) -> np.ndarray:
    """True and false as 1 and 0, null where an input is."""
    return np.where(np.any([np.isnan(x) for x in np.broadcast_arrays(*inputs)], axis=0), np.nan, test.astype(float))


def _both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.where((x == 0) | (y == 0), 0.0, x * y)


_NODES = {
    "Add": np.add, "Subtract": np.subtract, "Multiply": np.multiply, "Divide": _divided, "UnaryMinus": np.negative, "UnaryPositive": np.positive,
    "Remainder": np.fmod, "IntegralDivide": lambda x, y: np.trunc(_divided(x, y)),
    "EqualTo": lambda x, y: _condition(x == y, x, y), "LessThan": lambda x, y: _condition(x < y, x, y), "LessThanOrEqual": lambda x, y: _condition(x <= y, x, y),
    "GreaterThan": lambda x, y: _condition(x > y, x, y), "GreaterThanOrEqual": lambda x, y: _condition(x >= y, x, y),
    "And": _both, "Or": lambda x, y: 1 - _both(1 - x, 1 - y), "Not": lambda x: 1 - x,
    "IsNull": lambda x: np.isnan(x).astype(float), "IsNotNull": lambda x: (~np.isnan(x)).astype(float),
    "between": lambda x, low, high: _both(_condition(x >= low, x, low), _condition(x <= high, x, high)),
}
_FUNCTIONS = {
    "pi": lambda: np.float64(np.pi), "abs": np.abs, "sqrt": np.sqrt, "pow": np.power, "power": np.power, "exp": np.exp, "ln": np.log, "log10": np.log10, "sin": np.sin, "cos": np.cos,
    "tan": np.tan, "atan2": np.arctan2, "radians": np.radians, "degrees": np.degrees, "floor": np.floor, "ceil": np.ceil, "least": lambda *x: np.fmin.reduce(np.broadcast_arrays(*x)),
    "greatest": lambda *x: np.fmax.reduce(np.broadcast_arrays(*x)), "isnull": lambda x: np.isnan(x).astype(float), "isnotnull": lambda x: (~np.isnan(x)).astype(float),
    "if": lambda c, x, y: np.where(c == 1, x, y),
}
_FUNCTIONS |= {"between": _NODES["between"]}


def compiled(spark: SparkSession, expression: str) -> tuple:
    """The expression as nested tuples. A ValueError names what has no counterpart here."""
    return _turned(spark._jsparkSession.sessionState().sqlParser().parseExpression(expression), expression)


def _turned(node: Any, whole: str) -> tuple:
    kind = node.getClass().getSimpleName()
    children = node.children()
    parts = [_turned(children.apply(i), whole) for i in range(children.size())]
    if kind == "Literal":
        value = node.value()
        if value is None:
            return ("value", float("nan"))
        try:
            return ("value", float(value if isinstance(value, (int, float, bool)) else value.toString()))
        except ValueError:
            raise ValueError(f"not a number in a filter expression: {value}") from None
    if kind == "UnresolvedAttribute":
        return ("column", node.name())
    if kind == "UnresolvedFunction":
        name = node.nameParts().mkString(".").lower()
        if name in _FUNCTIONS:
            return ("function", name, *parts)
    elif kind in _NODES:
        return ("node", kind, *parts)
    raise ValueError(f"{kind} can't be part of a filter expression here: {whole}")


def evaluated(tree: tuple, columns: dict[str, np.ndarray]) -> np.ndarray:
    """The values of the expression: doubles, conditions as 1, 0 or NaN."""
    what, name, *parts = tree
    if what == "value":
        return np.float64(name)
    if what == "column":
        return np.asarray(columns[name], float)
    with np.errstate(all="ignore"):
        return (_NODES if what == "node" else _FUNCTIONS)[name](*(evaluated(p, columns) for p in parts))


def holds(tree: tuple, columns: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Which of n rows fulfil the condition; null doesn't."""
    return np.broadcast_to(evaluated(tree, columns) == 1, n)
