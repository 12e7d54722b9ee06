"""Stored datasets: one Parquet folder per table, a list of their places, and the spec beside them.

The spec is written last. A folder without it is not a dataset, so a write
that fails half-way or fails validation leaves nothing visible. The list names
a place for every table, so a version of a dataset can share the tables that it
did not change with the version before it.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.functions.text import lit, name, sql_type
from rowsmith.operators.shared import at_once, ref
from rowsmith.operators.paging import PAGE_DEFAULT, Page, check_page, directory, page_of
from rowsmith.operators.update import update_table
from rowsmith.operators.validate import assert_valid
from rowsmith.sources.csv_records import csv_records
from rowsmith.spec import CURRENT_TIMESTAMP, DatasetSpec, Table, default_value

SPEC_FOLDER = "_dataset_spec"
PLACES_FOLDER = "_table_places"
PAGES_FOLDER = "_pages"


class StoreError(RuntimeError):
    """A path does not hold a readable dataset."""


def typed_projection(table: Table, df: DataFrame) -> DataFrame:
    """Declared columns in declared order and Spark types."""
    by_name = {c.casefold(): c for c in df.columns}
    return df.select(
        *[ref(by_name[c.name.casefold()]).cast(c.type.spark_type()).alias(c.name) for c in table.columns]
    )


def fill_defaults(table: Table, df: DataFrame) -> DataFrame:
    """Add columns that are absent from every row: the default, else NULL.

    A NULL in a column that is present stays NULL.
    """
    present = {c.casefold() for c in df.columns}
    added = []
    for column in table.columns:
        if column.name.casefold() in present:
            continue
        value = default_value(column, portable=True)
        if value == CURRENT_TIMESTAMP:
            filled = "current_date()" if column.type.name == "DATE" else "localtimestamp()"
        else:
            filled = lit(value)
        added.append(f"CAST({filled} AS {sql_type(column.type.spark_type())}) AS {name(column.name)}")
    return df.selectExpr("*", *added)


def write_dataset(spark: SparkSession, spec: DatasetSpec, data: Mapping[str, DataFrame], path: str) -> None:
    """Write a dataset, validate what was written, then publish its spec.

    Rows are computed once: validation reads the written files. Checks that
    cannot be evaluated do not block a write.
    """
    if is_published(spark, path):
        raise StoreError(f"{path} already holds a dataset; a new version needs its own path")
    given = {name.casefold(): df for name, df in data.items()}
    declared = {t.name.casefold() for t in spec.tables}
    # Problems with names and types must show before a cast could hide them.
    for table in spec.tables:
        if table.name.casefold() in given:
            df = given[table.name.casefold()]
            if any(not table.has_column(c) for c in df.columns) or not _storable(table, df):
                assert_valid(spark, spec, data, ignore=("unsupported_check",))

    def write(table_name: str) -> DataFrame:
        table = spec.table(table_name)
        exact = typed_projection(table, fill_defaults(table, given[table_name.casefold()]))
        exact.write.mode("overwrite").parquet(f"{path}/{table_name}")
        return spark.read.schema(exact.schema).parquet(f"{path}/{table_name}")

    stored = [t.name for t in spec.tables if t.name.casefold() in given]
    written = dict(zip(stored, at_once(write, stored)))
    extra = {name: df for name, df in data.items() if name.casefold() not in declared}
    assert_valid(spark, spec, {**written, **extra}, ignore=("unsupported_check",))
    publish(spark, spec, path, {n: f"{path}/{n}" for n in stored})


def publish(spark: SparkSession, spec: DatasetSpec, path: str, places: Mapping[str, str]) -> None:
    """Make written tables a dataset: where each of them is, then the spec."""
    _write_text(spark, json.dumps(dict(places)), f"{path}/{PLACES_FOLDER}")
    _write_text(spark, spec.to_json(), f"{path}/{SPEC_FOLDER}")


def _write_text(spark: SparkSession, content: str, path: str) -> None:
    spark.range(1).select(F.lit(content).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> str | None:
    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except AnalysisException:
        return None
    return rows[0]["value"] if rows else None


def _storable(table: Table, df: DataFrame) -> bool:
    """Whether casting to the declared types cannot change or reject a value."""
    by_name = {f.name.casefold(): f.dataType for f in df.schema.fields}
    for column in table.columns:
        kind = by_name.get(column.name.casefold())
        wanted = column.type.spark_type()
        if kind is None or kind == wanted:
            continue
        whole = isinstance(wanted, T.LongType) and isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType))
        if not whole:
            return False
    return True


def is_published(spark: SparkSession, path: str) -> bool:
    return _read_text(spark, f"{path}/{SPEC_FOLDER}") is not None


def read_spec(spark: SparkSession, path: str) -> DatasetSpec:
    found = _read_text(spark, f"{path}/{SPEC_FOLDER}")
    if found is None:
        raise StoreError(f"{path} holds no published dataset")
    return DatasetSpec.from_json(found)


def table_places(spark: SparkSession, path: str, spec: DatasetSpec) -> dict[str, str]:
    """Where each table of a dataset is stored; below the dataset where its list does not say."""
    listed = _read_text(spark, f"{path}/{PLACES_FOLDER}")
    return {t.name: f"{path}/{t.name}" for t in spec.tables} | (json.loads(listed) if listed else {})


def read_table(spark: SparkSession, location: str, table: Table) -> DataFrame:
    """One stored table with its columns in declared order. Sort it only for display."""
    return spark.read.parquet(location).select(*[ref(c) for c in table.column_names])


def read_dataset(spark: SparkSession, path: str) -> tuple[DatasetSpec, dict[str, DataFrame]]:
    spec = read_spec(spark, path)
    places = table_places(spark, path, spec)
    return spec, {t.name: read_table(spark, places[t.name], t) for t in spec.tables}


def update_stored_table(spark: SparkSession, path: str, table_name: str, edited: DataFrame, new_path: str) -> int:
    """Publish at `new_path` the dataset at `path` with one table updated; return the rows changed.

    Only that table is written; the new version names the places of the others.
    The old version stays readable, and both need the files that they share.
    What is stored is valid, so only the edited table and references to it are
    judged.
    """
    if is_published(spark, new_path):
        raise StoreError(f"{new_path} already holds a dataset; a new version needs its own path")
    spec, data = read_dataset(spark, path)
    table = spec.table(table_name)
    new, changed = update_table(spark, spec, data, table.name, edited, stored_valid=True)
    typed_projection(table, new).write.mode("overwrite").parquet(f"{new_path}/{table.name}")
    publish(spark, spec, new_path, table_places(spark, path, spec) | {table.name: f"{new_path}/{table.name}"})
    return changed.count()


def stored_page(spark: SparkSession, path: str, table_name: str, limit: int = PAGE_DEFAULT, offset: int = 0) -> Page:
    """One page of a stored table in key order, with the number of its rows.

    The directory of the table is made at the first page and stored beside it.
    """
    check_page(limit, offset)
    spec = read_spec(spark, path)
    table = spec.table(table_name)
    place = table_places(spark, path, spec)[table.name]
    df = read_table(spark, place, table)
    folder = f"{place.rsplit('/', 1)[0]}/{PAGES_FOLDER}/{place.rsplit('/', 1)[1]}"
    try:
        blocks = spark.read.parquet(folder)
    except AnalysisException:
        directory(table, df).write.mode("ignore").parquet(folder)
        blocks = spark.read.parquet(folder)
    return page_of(table, df, blocks, limit, offset)


# --- CSV ---------------------------------------------------------------------


def csv_columns(table: Table, df: DataFrame) -> DataFrame:
    """Columns as they are printed: booleans as True and False, everything else as it is."""
    present = {c.casefold(): c for c in df.columns}
    columns = []
    for column in table.columns:
        value = ref(present[column.name.casefold()])
        if isinstance(df.schema[present[column.name.casefold()]].dataType, T.BooleanType):
            value = F.when(value, "True").when(~value, "False")
        elif isinstance(df.schema[present[column.name.casefold()]].dataType, (T.TimestampType, T.TimestampNTZType, T.DecimalType)):
            # As text a timestamp keeps a fraction of a second where it has one, and (in ANSI mode) a decimal has no exponent.
            value = value.cast("string")
        columns.append(value.alias(column.name))
    return df.select(*columns)


def write_csv(table: Table, df: DataFrame, path: str, compression: str = "none") -> None:
    """Header, declared column order, NULL as empty, one file per partition."""
    stamp = "yyyy-MM-dd HH:mm:ss"
    writer = csv_columns(table, df).write.mode("overwrite").option("timestampNTZFormat", stamp)
    writer.csv(
        path,
        header=True,
        nullValue="",
        emptyValue="",
        dateFormat="yyyy-MM-dd",
        timestampFormat=stamp,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        compression=compression,
    )


def read_csv(spark: SparkSession, table: Table, path: str) -> DataFrame:
    """Read an exported table back as declared types; empty fields are NULL.

    Ranges of a file are read by different tasks, also where fields hold line breaks.
    """
    schema = ", ".join(f"c{i} STRING" for i in range(len(table.columns)))
    options = {"quote": '"', "escape": '"', "nullValue": "", "emptyValue": ""}
    parsed = csv_records(spark, path).select(F.from_csv("record", schema, options).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").cast(c.type.spark_type()).alias(c.name) for i, c in enumerate(table.columns)])


def export_dataset(spec: DatasetSpec, data: Mapping[str, DataFrame], path: str) -> None:
    """One gzip-compressed CSV folder per table."""
    given = {name.casefold(): df for name, df in data.items()}
    for table in spec.tables:
        df = given.get(table.name.casefold())
        if df is not None:
            write_csv(table, df, f"{path}/{table.name}.csv", compression="gzip")
