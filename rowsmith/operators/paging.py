"""Pages of a table in key order, found through a directory of key ranges.

The directory cuts the table, sorted by key, into blocks of BLOCK_ROWS rows and
notes of each block its first and last key, its rows, and how many rows stand
before it. A page at any offset then reads only the blocks that it touches:
their key range goes to the scan as a filter, and no step handles more rows
than those blocks and the page have. The page after a known key needs no
directory at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from rowsmith.functions.text import name
from rowsmith.operators.shared import ref, shuffle_partitions, written
from rowsmith.spec import Table

PAGE_DEFAULT, PAGE_LIMIT = 50, 1_000
BLOCK_ROWS = 10_000


class PageError(ValueError):
    """A page cannot be given as asked."""


@dataclass(frozen=True)
class Page:
    """Rows in key order, and their place in the table. `rows` is lazy."""

    rows: DataFrame
    total: int
    limit: int
    offset: int

    @property
    def has_next(self) -> bool:
        return self.offset + self.limit < self.total


def page_order(table: Table) -> list[str]:
    """The key, or all columns where there is none."""
    return list(table.primary_key) or table.column_names


def check_page(limit: int, offset: int = 0) -> None:
    if not 1 <= limit <= PAGE_LIMIT:
        raise PageError(f"a page holds 1 to {PAGE_LIMIT} rows, not {limit}")
    if offset < 0:
        raise PageError(f"a page cannot start at {offset}")


def directory(table: Table, df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, first, last, rows, before, anchor, anchor_first) of every block of the sorted table.

    Only the key columns are read and moved. Where equal rows run over the
    border of a block, `anchor` and `anchor_first` are of the block at whose
    border they do not.
    """
    order = page_order(table)
    keys = df.select(*[ref(c) for c in order])
    ranged = keys.repartitionByRange(shuffle_partitions(df.sparkSession), *[ref(c) for c in order])
    # The number has the partition in its upper bits and the row in the lower 33.
    numbered = ranged.sortWithinPartitions(*[ref(c) for c in order]).withColumn("_place", F.monotonically_increasing_id())
    key = f"struct({', '.join(name(c) for c in order)})"
    blocks = numbered.selectExpr(
        f"{key} AS key", "shiftright(_place, 33) AS part", f"(_place & {(1 << 33) - 1}L) div {block_rows} AS cut"
    )
    blocks = blocks.groupBy("part", "cut").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count(F.lit(1)).alias("rows"))
    # One row a block.
    along = Window.orderBy("part", "cut")
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select(
        (F.row_number().over(along) - 1).alias("block"),
        "first", "last", "rows",
        F.coalesce(F.sum("rows").over(past), F.lit(0)).alias("before"),
        F.coalesce(F.col("first") == F.lag("last").over(along), F.lit(False)).alias("tied"),
    )
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select(
        "block", "first", "last", "rows", "before",
        F.last(F.expr("CASE WHEN NOT tied THEN before END"), ignorenulls=True).over(upto).alias("anchor"),
        F.last(F.expr("CASE WHEN NOT tied THEN first END"), ignorenulls=True).over(upto).alias("anchor_first"),
    )


def page_of(table: Table, df: DataFrame, blocks: DataFrame, limit: int = PAGE_DEFAULT, offset: int = 0) -> Page:
    """A page at an offset, by a written directory of the table."""
    check_page(limit, offset)
    order = page_order(table)
    total = blocks.agg(F.sum("rows").alias("n")).first()["n"] or 0
    rows = df.select(*[ref(c) for c in table.column_names])
    # Blocks are not empty, so a page touches at most as many as it has rows, and one more.
    touched = blocks.where((F.col("before") < offset + limit) & (F.col("before") + F.col("rows") > offset)).orderBy("block").collect()
    if not touched:
        return Page(rows.limit(0), total, limit, offset)
    skip = offset - touched[0]["anchor"]
    inside = rows.where(_within(order, touched[0]["anchor_first"], touched[-1]["last"]))
    place = F.row_number().over(Window.orderBy(*[ref(c) for c in order]))
    found = inside.withColumn("_place", place).where((F.col("_place") > skip) & (F.col("_place") <= skip + limit)).drop("_place")
    return Page(found, total, limit, offset)


def page_after(table: Table, df: DataFrame, last: Sequence[Any], limit: int = PAGE_DEFAULT) -> DataFrame:
    """The page that follows a key, for tables whose key tells rows apart."""
    check_page(limit)
    order = list(table.primary_key)
    if len(last) != len(order) or not order:
        raise PageError(f"the key of {table.name!r} has {len(order)} columns, not {len(last)}")
    later = F.lit(False)
    for position in reversed(range(len(order))):
        column, value = ref(order[position]), F.lit(last[position])
        later = (column > value) | ((column == value) & later)
    rows = df.select(*[ref(c) for c in table.column_names])
    # The first comparison alone is what a scan can use.
    return rows.where((ref(order[0]) >= F.lit(last[0])) & later).orderBy(*[ref(c) for c in order]).limit(limit)


def page_by_key(table: Table, df: DataFrame, limit: int = PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """The rows of one page; near the start without a directory, elsewhere by one made for it."""
    check_page(limit, offset)
    if offset + limit <= BLOCK_ROWS:
        ordered = df.select(*[ref(c) for c in table.column_names]).orderBy(*[ref(c) for c in page_order(table)])
        return ordered.offset(offset).limit(limit)
    return page_of(table, df, written(directory(table, df)), limit, offset).rows


def _within(order: Sequence[str], low: Row, high: Row) -> F.Column:
    """Keys from `low` to `high`, NULLs first; with comparisons of the first column that a scan can use."""
    key = F.struct(*[ref(c) for c in order])
    inside = (key >= _literal(order, low)) & (key <= _literal(order, high))
    first = ref(order[0])
    if low[0] is not None:
        inside = (first >= F.lit(low[0])) & inside
    if low[0] is not None and high[0] is not None:
        inside = (first <= F.lit(high[0])) & inside
    return inside


def _literal(order: Sequence[str], key: Row) -> F.Column:
    return F.struct(*[F.lit(v).alias(c) for c, v in zip(order, key)])
