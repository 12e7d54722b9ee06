"""Records of CSV files whose fields may hold line breaks, read by many tasks.

A line break ends a record where the number of quotes before it is even, since
a quote inside a field is doubled. Lines are read from ranges of each file, with
the number of their quotes. Sums over ranges, and running sums inside them, say
for every line whether it starts a record; the lines of the few records that run
over several lines are put together, all others are records by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsmith.operators.shared import fits_broadcast, written

_ODD = "(length(value) - length(replace(value, '\"', ''))) % 2"


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, value, odd): every line, the range of its file that it starts in, and its place there."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
        F.expr(f"CAST({_ODD} AS INT)").alias("odd"),
    )


def _sized(table: DataFrame) -> DataFrame:
    """A written table, broadcast where it is measured to be small."""
    return F.broadcast(table) if fits_broadcast(table, table.columns) else table


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record): the text of every record but the first of each file, which names the columns."""
    lines = csv_lines(spark, path)
    blocks = lines.groupBy("file", "block").agg(F.sum("odd").alias("odd"), F.min("line").alias("first"))
    ordered = Window.partitionBy("file").orderBy("block")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "file", "block", "odd", "first",
        (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).alias("inside"),
        (F.row_number().over(ordered) == 1).alias("opens"),
    )
    blocks = written(blocks)
    heads = blocks.where("opens").select("file", "first")
    if blocks.where("odd > 0").isEmpty():
        # No field holds a break, so each line is a record.
        return lines.join(_sized(heads), "file").where("line <> first").select("file", F.col("value").alias("record"))
    # The running sums need the lines of a range together: a range is at most as large as a task reads.
    placed = lines.join(_sized(blocks.select("file", "block", "inside")), ["file", "block"])
    inner = Window.partitionBy("file", "block").orderBy("line")
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = placed.withColumn("open", (F.col("inside") + F.sum("odd").over(upto) - F.col("odd")) % 2 == 1)
    marked = marked.withColumn("start", F.last(F.expr("CASE WHEN NOT open THEN line END"), ignorenulls=True).over(upto))
    marked = written(marked.select("file", "block", "line", "value", "odd", "open", "start"))
    # Lines before the first start of their range belong to the last record of the ranges before it.
    lasts = marked.groupBy("file", "block").agg(F.max("start").alias("last"))
    carried = lasts.select("file", "block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    joined = marked.join(_sized(written(carried)), ["file", "block"], "left").withColumn("record", F.coalesce("start", "carried"))
    joined = joined.join(_sized(heads), "file").where("record <> first")
    whole = joined.where("NOT open AND odd = 0").select("file", F.col("value").alias("record"))
    parts = joined.where("open OR odd = 1").groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("parts"))
    return whole.union(parts.select("file", F.expr("array_join(transform(parts, p -> p.value), '\n')").alias("record")))
