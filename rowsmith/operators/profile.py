"""What a table holds against what its rules allow, for columns of any type, in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.functions.checks import column_bounds
from rowsmith.functions.text import any_of, lit, name
from rowsmith.operators.shared import ref
from rowsmith.spec import Table


def outside_bounds(table: Table, column: str) -> str:
    """SQL of the values that the conjunctive rules of a table exclude; NULL is never outside."""
    bounds, value = column_bounds(table, column), name(column)
    beyond = []
    if bounds.minimum is not None:
        beyond.append(f"{value} {'<=' if bounds.minimum_exclusive else '<'} {lit(bounds.minimum)}")
    if bounds.maximum is not None:
        beyond.append(f"{value} {'>=' if bounds.maximum_exclusive else '>'} {lit(bounds.maximum)}")
    if bounds.allowed is not None:
        members = [lit(a) for a in bounds.allowed if a is not None]
        beyond.append(f"{value} NOT IN ({', '.join(members)})" if members else f"{value} IS NOT NULL")
    return any_of(beyond)


def bounds_profile(table: Table, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Observed range, distinct values, NULLs and rows outside the declared bounds of every column.

    Returns column_name, low, high (the values as text), distinct_values,
    n_nulls and outside. The values of each column are counted in a grouping
    set of their own, in their own type and order, so numbers of any precision,
    dates, times and texts share one scan and one shuffle, and a frequent value
    crosses it once a task.
    """
    wanted = [table.column(c).name for c in columns] if columns is not None else [c for c in table.column_names if c in df.columns]
    if not wanted:
        raise ValueError("a profile needs a column")
    sets = [[ref(c)] for c in wanted]
    counted = df.select(*[ref(c) for c in wanted]).groupingSets(sets, *[ref(c) for c in wanted])
    counted = counted.agg(F.count(F.lit(1)).alias("_n"), *[F.grouping(ref(c)).alias(f"_g{i}") for i, c in enumerate(wanted)])
    # In the sets of other columns a column is NULL, so it takes no part in these sums.
    sums = []
    for i, c in enumerate(wanted):
        v = name(c)
        sums += [f"min({v}) AS _low{i}", f"max({v}) AS _high{i}", f"count({v}) AS _distinct{i}"]
        sums.append(f"coalesce(sum(_n) FILTER (WHERE _g{i} = 0 AND {v} IS NULL), 0L) AS _nulls{i}")
        sums.append(f"coalesce(sum(_n) FILTER (WHERE {outside_bounds(table, c)}), 0L) AS _outside{i}")
    row = counted.agg(*[F.expr(s) for s in sums])
    lines = ", ".join(
        f"named_struct('column_name', {lit(c)}, 'low', CAST(_low{i} AS STRING), 'high', CAST(_high{i} AS STRING), "
        f"'distinct_values', _distinct{i}, 'n_nulls', _nulls{i}, 'outside', _outside{i})"
        for i, c in enumerate(wanted)
    )
    return row.selectExpr(f"inline(array({lines}))")
