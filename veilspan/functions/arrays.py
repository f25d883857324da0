"""Small helpers for array columns.

Everything here uses Spark's higher-order functions, so a whole page or
document is handled inside its own row without a shuffle.  The helpers ending
in ``_sql`` build expression text: a nested expression of hundreds of calls is
parsed by Spark in one go, instead of crossing to the JVM call by call.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number of elements folded at a time.  A fold that appends to an array copies
# it at each step, so one long fold is quadratic; folding block by block keeps
# rows with very many matches close to linear.
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def indexes(array: Column) -> Column:
    """``[0, 1, .., n-1]``, and an empty array for an empty input."""
    size = F.size(array)
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(
        F.array().cast("array<int>")
    )


def distinct_by(
    array: Column, key: Callable[[Column], Column], order: Callable[[Column], Column]
) -> Column:
    """Keep, per ``key``, the element that is least by ``order``.

    The survivors stand in the order in which their keys first occur.  Sorting
    and comparing neighbours keeps this from being quadratic in the row.
    """

    def heads(rows: Column) -> Column:
        return let(
            F.array_sort(rows),
            lambda ordered: F.filter(
                ordered,
                lambda row, i: (i == 0)
                | ~F.get(ordered, i - 1)["k"].eqNullSafe(row["k"]),
            ),
        )

    def select(rows: Column) -> Column:
        best = heads(
            F.transform(
                rows,
                lambda x, i: F.struct(
                    key(x).alias("k"), order(x).alias("o"), i.alias("i"), x.alias("x")
                ),
            )
        )
        first = heads(
            F.transform(rows, lambda x, i: F.struct(key(x).alias("k"), i.alias("i")))
        )
        placed = F.zip_with(
            first, best, lambda f, b: F.struct(f["i"].alias("i"), b["x"].alias("x"))
        )
        return F.transform(F.array_sort(placed), lambda row: row["x"])

    return let(array, select)


_names = count()


def let_sql(value: str, body: Callable[[str], str]) -> str:
    """SQL text that evaluates ``value`` once for many uses in ``body``."""
    if value.isidentifier():
        return body(value)
    name = fresh_name()
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


def fresh_name() -> str:
    return f"v{next(_names)}"


def running_sql(values: str, zero: str, combine: Callable[[str, str], str]) -> str:
    """Exclusive running fold as SQL text: ``zero`` and all values before each.

    ``combine`` must be associative (sum, greatest).
    """

    def append(acc: str, value: str) -> str:
        return f"concat({acc}, array({combine(f'element_at({acc}, -1)', value)}))"

    def fold(array: str) -> str:
        cut = (
            f"transform(sequence(0, (size({array}) - 1) div {_BLOCK}),"
            f" b -> slice({array}, b * {_BLOCK} + 1, {_BLOCK}))"
        )

        def over(blocks: str) -> str:
            total = f"aggregate(block, {zero}, (x, y) -> {combine('x', 'y')})"
            bases = f"aggregate({blocks}, array({zero}), (acc, block) -> {append('acc', total)})"
            return let_sql(
                bases,
                lambda base: f"flatten(transform({blocks}, (block, n) -> slice(aggregate(block,"
                f" array({base}[n]), (acc, y) -> {append('acc', 'y')}), 1, size(block))))",
            )

        return (
            f"CASE WHEN size({array}) > 0 THEN {let_sql(cut, over)}"
            f" ELSE slice(array({zero}), 1, 0) END"
        )

    return let_sql(values, fold)


def scanned_sql(items: str, zero: str, step: Callable[[str, str], str]) -> str:
    """The state before each item as SQL text: ``zero``, then ``step(state, item)``.

    Like ``running_sql`` with a step of any kind: items are folded block by block
    without keeping states, and states are kept within one block at a time.
    """
    x, y = fresh_name(), fresh_name()
    fold = f"({x}, {y}) -> {step(x, y)}"

    def append(acc: str, item: str) -> str:
        return f"concat({acc}, array({let_sql(f'element_at({acc}, -1)', lambda e: step(e, item))}))"

    def over(blocks: str) -> str:
        bases = (
            f"aggregate({blocks}, array({zero}), (acc, block) -> concat(acc, array("
            f"aggregate(block, element_at(acc, -1), {fold}))))"
        )
        return let_sql(
            bases,
            lambda base: f"flatten(transform({blocks}, (block, n) -> slice(aggregate(block,"
            f" array({base}[n]), (acc, item) -> {append('acc', 'item')}), 1, size(block))))",
        )

    def cut(array: str) -> str:
        pieces = (
            f"transform(sequence(0, (size({array}) - 1) div {_BLOCK}),"
            f" b -> slice({array}, b * {_BLOCK} + 1, {_BLOCK}))"
        )
        return f"CASE WHEN size({array}) > 0 THEN {let_sql(pieces, over)} ELSE slice(array({zero}), 1, 0) END"

    return let_sql(items, cut)
