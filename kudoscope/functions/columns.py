"""Column helpers that shape the plan rather than the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add expensive columns that later filters may read without evaluating them again.

    The optimiser copies a column's expression into every filter it pushes below
    the projection, so a filter on cleaned text would clean each text twice. A
    filter on the output of a generator stays above it, so passing the finished
    values through a one-element array keeps them from being computed again. They
    are computed in a projection below it, where repeated parts are shared.
    """
    held = {n: f"_once_{n}" for n in columns}
    one = F.array(F.struct(*[F.col(h).alias(n) for n, h in held.items()]))
    return (df.withColumns({held[n]: c for n, c in columns.items()})
            .select(*df.columns, F.inline(one)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once however often ``use`` names it.

    A column named twice in an expression is evaluated twice where array functions or
    generators are around it; steps that each name the one before twice double at every step.
    """
    return F.get(F.transform(F.array(value), use), 0)
