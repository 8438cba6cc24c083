"""Comparisons that treat NaN as "not known", and the small scalar functions the rules use.

Spark orders NaN above every number and finds NaN equal to NaN, so a bare ``x > cut`` would fire on an unreadable
value. Every threshold in this package goes through ``gt/ge/lt/le`` (false on null and NaN; infinities compare) or
``finite_gt`` and friends (false on infinities too).
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def number(col: Column) -> Column:
    """The value, with NaN as null."""
    return F.nanvl(col, F.lit(None).cast("double"))


def is_finite(col: Column) -> Column:
    """Neither null, NaN nor infinite. The value times zero is zero exactly for finite numbers, so the (possibly long)
    expression behind the column appears only once."""
    return F.coalesce(col * F.lit(0.0) == F.lit(0.0), F.lit(False))


def finite(col: Column) -> Column:
    """The value, or null when it is NaN or infinite."""
    return F.when(is_finite(col), col)


def _known(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def gt(a, b) -> Column:
    return _known(number(_c(a)) > number(_c(b)))


def ge(a, b) -> Column:
    return _known(number(_c(a)) >= number(_c(b)))


def lt(a, b) -> Column:
    return _known(number(_c(a)) < number(_c(b)))


def le(a, b) -> Column:
    return _known(number(_c(a)) <= number(_c(b)))


def finite_gt(col: Column, cut) -> Column:
    return is_finite(col) & gt(col, cut)


def finite_lt(col: Column, cut) -> Column:
    return is_finite(col) & lt(col, cut)


def unknown_as_infinity(sd: Column) -> Column:
    """A noise SD that is missing or NaN counts as infinite: unknown noise is never "quiet"."""
    return F.coalesce(number(sd), F.lit(math.inf))


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def count_true(conds) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, 1).otherwise(0) for c in conds], F.lit(0))


def clip(col: Column, lo=None, hi=None) -> Column:
    if lo is not None:
        col = F.when(lt(col, lo), F.lit(float(lo))).otherwise(col)
    if hi is not None:
        col = F.when(gt(col, hi), F.lit(float(hi))).otherwise(col)
    return col


def level_label(value: Column, levels: list[dict]) -> Column:
    """The label of the first level whose ``below`` exceeds the value, else the last label (null stays null)."""
    out = F.lit(levels[-1]["label"])
    for lv in reversed(levels[:-1]):
        out = F.when(lt(value, lv["below"]), F.lit(lv["label"])).otherwise(out)
    return F.when(number(value).isNotNull(), out)


def bin_index(value: Column, edges: list[float]) -> Column:
    """How many edges the value has reached."""
    return count_true([ge(value, e) for e in edges])


def pick_by_bin(index: Column, values: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), index + 1)


def piecewise_linear(x: Column, knots: list[float], values: list[float]) -> Column:
    """Linear interpolation between knots, constant beyond the end knots."""
    out = F.lit(float(values[-1]))
    for k0, k1, v0, v1 in reversed(list(zip(knots[:-1], knots[1:], values[:-1], values[1:]))):
        out = F.when(x <= k1, F.lit(float(v0)) + (x - k0) * ((v1 - v0) / (k1 - k0))).otherwise(out)
    return F.when(x <= knots[0], F.lit(float(values[0]))).otherwise(out)


def logistic(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def softmax(scores: Column) -> Column:
    """Softmax of an array column, shifted by its maximum so that exp cannot overflow."""
    top = F.transform(F.array(F.array_max(scores)), lambda m: F.transform(scores, lambda s: F.exp(s - m)))
    shared = F.transform(top, lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, w: a + w).alias("t")))
    return F.element_at(F.transform(shared, lambda p: F.transform(p["e"], lambda v: v / p["t"])), 1)


def inverse_response(value: Column, y_transform: dict | None) -> Column:
    """Back from the scale a model was fitted on to the reported scale."""
    kind = (y_transform or {}).get("type", "none")
    off = float((y_transform or {}).get("offset", 0.0))
    forms = {"none": lambda v: v, "log10": lambda v: F.pow(F.lit(10.0), v) - off,
             "ln": lambda v: F.exp(v) - off, "sqrt": lambda v: v * v - off}
    if kind not in forms:
        raise ValueError(f"unknown response transform {kind!r}")
    return forms[kind](value)


def expression(tree, env: dict[str, Column]) -> Column:
    """A small arithmetic tree over named columns (numbers, {"ref": name}, {"op": .., "args": [..]}) as one Column."""
    if isinstance(tree, (int, float)):
        return F.lit(float(tree))
    if "ref" in tree:
        return env[tree["ref"]]
    args = [expression(a, env) for a in tree["args"]]
    binary = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b,
              "div": lambda a, b: F.try_divide(a, b), "min": lambda a, b: F.least(a, b),
              "max": lambda a, b: F.greatest(a, b)}
    unary = {"neg": lambda a: -a, "abs": F.abs}
    op = tree["op"]
    if op in binary and len(args) == 2:
        return binary[op](*args)
    if op in unary and len(args) == 1:
        return unary[op](*args)
    raise ValueError(f"unknown expression operator {op!r}")
