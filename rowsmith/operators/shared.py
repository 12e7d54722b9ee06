"""Building blocks for operators that must stay even when keys are not.

One key may hold a large share of all rows. The helpers here never gather the
rows of a key in one task: groups are counted with partial aggregation first,
and rows are matched back to groups by broadcast (few groups, size checked) or
by a shuffle join that sees no hot key.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.functions.text import lit, name, text

BROADCAST_BYTES = 32 * 1024 * 1024
COPY_CHUNK = 65_536


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local session without one gets a temporary folder; on a cluster a
    missing setting is an error, because a machine-local folder would be lost
    with its executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is not None:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="rowsmith-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


_scopes: list[str] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables that are written inside live in a folder of their own, which goes when the scope ends.

    Results must be written elsewhere before that: they still read from it.
    """
    folder = f"{checkpoint_dir(spark)}/scope-{uuid.uuid4().hex}"
    _scopes.append(folder)
    try:
        yield folder
    finally:
        _scopes.remove(folder)
        remove_folder(spark, folder)


def remove_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write a result once and read it from there; survives losing executors."""
    if _scopes:
        return written(df)
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_folder(spark: SparkSession) -> str:
    """Where `written` puts its tables: the folder of the innermost scope, or the shared one."""
    return _scopes[-1] if _scopes else checkpoint_dir(spark)


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a table once to the shared folder as Parquet and read it from there.

    For whole tables that several scans follow: each scan reads only its
    columns, and nothing is computed again. `folder` names an outer scope's.
    """
    spark = df.sparkSession
    path = f"{folder or table_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that begin inside go when each of them ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def at_once(action: Callable[[str], Any], names: Sequence[str]) -> list[Any]:
    """Start the Spark jobs of several tables together, so small ones fill the gaps of large ones."""
    with ThreadPoolExecutor(max_workers=max(1, min(8, len(names)))) as pool:
        return list(pool.map(action, names))


def ref(column: str) -> Column:
    return F.col(name(column))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def planned_bytes(df: DataFrame) -> int | None:
    """The size Catalyst assumes for a plan, or None where it is not readable."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return None


def broadcasts_by_itself(df: DataFrame) -> bool:
    """Whether Catalyst would broadcast this side under the session's threshold."""
    size = planned_bytes(df)
    if size is None:
        return False
    threshold = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return size <= _bytes(threshold)


def _bytes(text: str) -> int:
    units = {"b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}
    digits = text.strip().lower()
    suffix = digits.lstrip("-0123456789")
    number = int(digits[: len(digits) - len(suffix)])
    return number << units[suffix] if suffix and number > 0 else number


def narrow_key(df: DataFrame, column: str, declared_length: int | None) -> str:
    """A column to group and join by: long texts are replaced by their digest.

    The digest covers the whole text, so equal keys mean equal texts while the
    shuffle and any broadcast stay narrow.
    """
    is_text = isinstance(df.schema[column].dataType, T.StringType)
    if is_text and (declared_length is None or declared_length > 128):
        # Never NULL, so a join on it need not compute it once more to filter NULLs.
        return f"coalesce(sha2({name(column)}, 256), '')"
    return name(column)


def fits(size: int) -> bool:
    """Whether a table of this many bytes may be broadcast."""
    return size * 2 <= BROADCAST_BYTES


def fits_broadcast(df: DataFrame, columns: Sequence[str]) -> bool:
    """Whether a written table is small enough to broadcast, by measuring it."""
    width = " + ".join(f"coalesce(octet_length(CAST({name(c)} AS STRING)), 1) + 16" for c in columns)
    measured = df.agg(F.expr(f"sum(CAST({width} AS BIGINT))").alias("bytes")).first()
    return fits(measured["bytes"] or 0)


def rows_of_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join rows to the groups they belong to, whatever the size of a group.

    `groups` holds one row per key with the number of rows in `_n`. Its size is
    measured first.
    """
    groups = materialize(groups)
    return rows_of_measured(rows, groups, keys, fits_broadcast(groups, groups.columns))


def rows_of_measured(rows: DataFrame, groups: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """`rows_of_groups` with written groups that are known to be small enough to broadcast, or not.

    Few groups are broadcast, so rows do not move at all. With many, those that
    hold more than a fair part of a task's share of the rows are broadcast and
    the rest, which cannot dominate a partition, go through a shuffle join.
    """
    keys = list(keys)
    if small:
        return rows.join(F.broadcast(groups), keys)
    total = groups.agg(F.sum("_n").alias("n")).first()["n"] or 0
    least = max(2, total // _hot_parts(rows.sparkSession))
    return _split_join(rows, groups, keys, groups.where(F.col("_n") >= least), "inner")


def _hot_parts(spark: SparkSession) -> int:
    """Keys with at least this part of all rows are hot, so there are at most so many of them."""
    return 8 * shuffle_partitions(spark)


def heavy_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that hold a large part of all rows, by a frequent-items summary.

    Tasks summarise their rows in a bounded number of counters, and the
    summaries merge. Keys above the hot part stand out of the error bound; a
    key that is listed without need only takes the other way of a join.
    """
    spark = rows.sparkSession
    most = min(8192, _hot_parts(spark))
    packed = rows.selectExpr(f"to_json(struct({', '.join(name(k) for k in keys)})) AS k")
    items = 1 << max(10, (8 * most - 1).bit_length())
    top = packed.agg(F.expr(f"approx_top_k(k, {most}, {items})").alias("top"), F.count(F.lit(1)).alias("n"))
    kind = T.StructType([T.StructField(k, rows.schema[k].dataType) for k in keys])
    found = top.selectExpr("n", "inline(top)").where(f"count * {_hot_parts(spark)} >= n")
    return found.select(F.from_json("item", kind).alias("k")).select("k.*")


def even_join(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join rows to a table with one row per key, where a key may repeat in `rows` without bound.

    `how` is inner, left_semi or left_anti. Works as `rows_of_groups`, with the
    heaviest keys found by a summary of the rows. `small` says that the caller
    has measured a bound on the keyed table already.
    """
    keys = list(keys)
    if small:
        return rows.join(F.broadcast(keyed), keys, how)
    keyed = materialize(keyed)
    if fits_broadcast(keyed, keyed.columns):
        return rows.join(F.broadcast(keyed), keys, how)
    return _split_join(rows, keyed, keys, materialize(heavy_keys(rows, keys)), how)


def _split_join(rows: DataFrame, keyed: DataFrame, keys: list[str], hot: DataFrame, how: str) -> DataFrame:
    """Broadcast what belongs to the hot keys (a bounded number), shuffle the rest."""
    hot_keys = F.broadcast(hot.select(*keys))
    hot_rows = rows.join(hot_keys, keys, "left_semi").join(F.broadcast(keyed.join(hot_keys, keys, "left_semi")), keys, how)
    cold_rows = rows.join(hot_keys, keys, "left_anti").join(keyed.join(hot_keys, keys, "left_anti"), keys, how)
    return hot_rows.unionByName(cold_rows)


def repeat_rows(df: DataFrame, times: str, spread_by: Sequence[str]) -> DataFrame:
    """Repeat each row `times` times, in chunks spread over all tasks.

    A single row may have to appear billions of times, so the chunk numbers
    are shuffled before the chunks are unrolled.
    """
    kept = [c for c in df.columns if c != times]
    return (
        df.where(f"{name(times)} > 0")
        .selectExpr("*", f"explode(sequence(0L, ({name(times)} - 1) div {COPY_CHUNK})) AS _chunk")
        .repartition(shuffle_partitions(df.sparkSession), *spread_by, "_chunk")
        .selectExpr(
            *[name(c) for c in kept],
            f"explode(sequence(1L, least({COPY_CHUNK}L, {name(times)} - _chunk * {COPY_CHUNK}))) AS _copy",
        )
        .select(*kept)
    )


def literal_rows(spark: SparkSession, rows: Sequence[Sequence[str | None]], columns: Sequence[str]) -> DataFrame:
    """A few string rows known to the driver, built without Python workers."""
    if not rows:
        return spark.range(0).selectExpr(*[f"{text(None)} AS {name(c)}" for c in columns])
    structs = [
        "named_struct(" + ", ".join(f"{lit(c)}, {text(v)}" for c, v in zip(columns, row)) + ")" for row in rows
    ]
    return spark.range(1).selectExpr(f"inline(array({', '.join(structs)}))")
