"""Gap-free numbers over rows, without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.operators.shared import ref, written

BLOCK_ROWS = 1_000_000
MAX_BLOCKS = 65_536


def number_blocks(df: DataFrame, group: Sequence[str], block: Column, order: Sequence[str], name: str) -> DataFrame:
    """Number rows 0, 1, ... within each group, block by block.

    Each (group, block) is sorted on its own; the rows before a block are
    counted with partial aggregation and added. Numbers follow (block, order),
    so blocks that ascend with the order give the order itself. A group may
    hold any share of the rows: only its block counts meet in one task.
    """
    group = list(group)
    rows = df.withColumn("_block", block)
    inner = Window.partitionBy(*[ref(c) for c in group], F.col("_block")).orderBy(*[ref(c) for c in order])
    numbered = rows.withColumn("_inner", F.row_number().over(inner) - 1)
    before = Window.partitionBy(*[ref(c) for c in group], F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*[ref(c) for c in group], F.col("_block"))
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .drop("_size")
    )
    # Rows without a group are a group like any other, whatever the number of blocks.
    renamed = offsets.select(*[ref(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_block").alias("_of"), "_before")
    same = F.col("_block") == F.col("_of")
    for i, c in enumerate(group):
        same = same & ref(c).eqNullSafe(F.col(f"_g{i}"))
    joined = numbered.join(renamed, same)
    number = (F.col("_inner") + F.col("_before")).alias(name)
    return joined.select(*[ref(c) for c in df.columns], number)


def number_within(df: DataFrame, group: Sequence[str], row_id: str, rows: int, name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number the rows of each group from 0 in row-id order.

    Blocks are ranges of the row id. With few rows there is one block and the
    numbering is a plain window.
    """
    if rows <= block_rows:
        inner = Window.partitionBy(*[ref(c) for c in group]).orderBy(ref(row_id))
        return df.withColumn(name, (F.row_number().over(inner) - 1).cast("bigint"))
    size = max(block_rows, -(-rows // MAX_BLOCKS))
    return number_blocks(df, group, F.floor(ref(row_id) / size), [row_id], name)


def dense_index(df: DataFrame, columns: Sequence[str], name: str, rows: int, spread: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number the rows from 0 in the order of `columns`, then `spread`, whatever their number.

    Few rows are one block. More are dealt to range blocks that ascend with
    the order and are written once, so that a block is the same rows in the
    count and in the numbering. `spread` adds columns to the order where
    `columns` alone may repeat a value very often.
    """
    order = list(dict.fromkeys([*columns, *spread]))
    blocks = min(MAX_BLOCKS, -(-rows // block_rows))
    if blocks <= 1:
        window = Window.partitionBy(F.lit(0)).orderBy(*[ref(c) for c in order])
        return df.withColumn(name, (F.row_number().over(window) - 1).cast("bigint"))
    dealt = written(df.repartitionByRange(blocks, *[ref(c) for c in order]).withColumn("_range", F.spark_partition_id()))
    return number_blocks(dealt, [], F.col("_range"), order, name).drop("_range")
