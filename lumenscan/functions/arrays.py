"""Array-form channel arithmetic on a uniform grid (``wl_start``, ``wl_step`` columns, one array per scan).

Everything here is built from higher-order functions, so it stays in the JVM, needs no shuffle, and works for any
number of scans: one scan is one row. Windows that are not on the scan's grid give null, never a clipped read.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenscan.rulebook import WL_TOL


def channel(wl, start="wl_start", step="wl_step") -> Column:
    """0-based channel nearest a wavelength."""
    wl = wl if isinstance(wl, Column) else F.lit(float(wl))
    return F.round((wl - F.col(start)) / F.col(step)).cast("int")


def on_grid(wl, arr: Column, start="wl_start", step="wl_step") -> Column:
    """Whether a wavelength is a grid point of the scan."""
    w = wl if isinstance(wl, Column) else F.lit(float(wl))
    ch = channel(wl, start, step)
    return ((F.abs(F.col(start) + ch * F.col(step) - w) <= WL_TOL) & (ch >= 0) & (ch < F.size(arr)))


def span(arr: Column, first: Column, last: Column) -> Column:
    """Channels first..last (0-based, inclusive); null unless all of them exist."""
    ok = (first >= 0) & (last < F.size(arr)) & (last >= first)
    return F.when(ok, F.slice(arr, F.greatest(first, F.lit(0)) + 1, F.greatest(last - first + 1, F.lit(0))))


def window(arr: Column, lo, hi) -> Column:
    """The inclusive nm window [lo, hi]; null unless both ends are grid points."""
    return F.when(on_grid(lo, arr) & on_grid(hi, arr), span(arr, channel(lo), channel(hi)))


def covered(arr: Column, lo, hi) -> Column:
    """All grid points with lo <= wl <= hi (the ends need not be grid points); empty array when there are none."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    first = F.greatest(F.ceil((lo - WL_TOL - F.col("wl_start")) / F.col("wl_step")).cast("int"), F.lit(0))
    last = F.least(F.floor((hi + WL_TOL - F.col("wl_start")) / F.col("wl_step")).cast("int"), F.size(arr) - 1)
    return F.when(last >= first, F.slice(arr, first + 1, F.greatest(last - first + 1, F.lit(0)))).otherwise(
        F.slice(arr, 1, 0))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    A plain column used inside a lambda would be computed again for every array element, because the optimiser may
    move its expression into the lambda. Binding it as a lambda variable keeps it outside.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def listed(items: list[tuple[Column, Column]], of: str) -> Column:
    """The values (of type ``of``, never null) whose condition holds, in order. Joined arrays of one value, not ``array_compact``: Spark
    interprets all that stands within a higher-order function, so every value's whole expression would be interpreted on every row."""
    none = F.array().cast(f"array<{of}>")
    return F.concat(none, *[F.when(F.coalesce(c, F.lit(False)), F.array(v)).otherwise(none) for c, v in items])


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def mean(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, total(arr) / F.size(arr))


def dot(arr: Column, weights) -> Column:
    """Sum of products; ``weights`` is a list or an array column of the same length."""
    w = weights if isinstance(weights, Column) else F.lit([float(x) for x in weights])
    return total(F.zip_with(arr, w, lambda x, y: x * y))


def sd(arr: Column, ddof: int = 0) -> Column:
    ss = let(mean(arr), lambda m: F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)))
    return F.when(F.size(arr) > ddof, F.sqrt(ss / (F.size(arr) - ddof)))


def median(arr: Column) -> Column:
    """Median of the known values (nulls and NaN dropped); null when nothing is left."""
    def middle(s):
        n = F.size(s)
        lower = F.element_at(s, F.floor((n + 1) / 2).cast("int"))
        upper = F.element_at(s, F.floor(n / 2).cast("int") + 1)
        return F.when(n > 0, (lower + upper) / 2.0)
    return let(F.array_sort(F.filter(arr, lambda x: x.isNotNull() & ~F.isnan(x))), middle)


def argmax(arr: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def whole(arr: Column) -> Column:
    """No null items."""
    return F.size(F.array_compact(arr)) == F.size(arr)


def max_known(arr: Column) -> Column:
    """Maximum, or null when any value is null or NaN. Spark calls NaN the largest value, so one NaN shows as the
    maximum and no second pass is needed."""
    return F.when(whole(arr), F.nanvl(F.array_max(arr), F.lit(None).cast("double")))


def mean_sd(arr: Column) -> Column:
    """struct(mean, sd) with the population SD, in two passes."""
    def spread(m):
        ss = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m))
        return F.named_struct(F.lit("mean"), m, F.lit("sd"), F.when(F.size(arr) > 0, F.sqrt(ss / F.size(arr))))
    return let(mean(arr), spread)


def second_difference(arr: Column) -> Column:
    """x[i+1] - 2 x[i] + x[i-1] for i = 1 .. n-2 (element k belongs to channel k + 1)."""
    n = F.size(arr)
    inner = F.slice(arr, 2, F.greatest(n - 2, F.lit(0)))
    left = F.slice(arr, 1, F.greatest(n - 2, F.lit(0)))
    right = F.slice(arr, 3, F.greatest(n - 2, F.lit(0)))
    pair = F.zip_with(left, right, lambda a, b: a + b)
    return F.when(n >= 3, F.zip_with(pair, inner, lambda s, x: s - 2.0 * x)).otherwise(F.slice(arr, 1, 0))


def segments(joins: Column, n: Column, start="wl_start", step="wl_step") -> Column:
    """Detector segments as ``array<struct<start,end>>`` channel ranges [start, end); a join belongs to the lower
    one, and joins outside the grid are ignored."""
    s, d = F.col(start), F.col(step)
    last = s + d * (n - 1)
    inside = F.array_sort(F.filter(joins, lambda j: (j >= s) & (j < last) & ~F.isnan(j)))
    cuts = F.transform(inside, lambda j: (F.floor((j - s + WL_TOL) / d) + 1).cast("int"))
    edges = F.array_distinct(F.concat(F.array(F.lit(0)), F.coalesce(cuts, F.array().cast("array<int>")),
                                      F.array(n.cast("int"))))
    return let(edges, lambda e: F.transform(F.sequence(F.lit(1), F.greatest(F.size(e) - 1, F.lit(1))),
                                            lambda i: F.named_struct(F.lit("start"), F.element_at(e, i),
                                                                     F.lit("end"), F.element_at(e, i + 1))))


def segment_index(ch: Column, segs: Column) -> Column:
    """Index of the segment holding a channel."""
    return F.size(F.filter(segs, lambda s: s["end"] <= ch))
