"""Keyed updates: compare an edited table with the stored one and merge it.

One join on the primary key answers all three questions: whether the keys are
unchanged, which rows differ, and what the new table is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from rowsmith.functions.text import any_of, array, lit, name, text
from rowsmith.operators.shared import ref, written
from rowsmith.operators.validate import assert_valid, raw_entries, row_key
from rowsmith.spec import DatasetSpec, Table


class UpdateError(ValueError):
    """A table cannot be updated row by row as asked."""


def keys_of(table: Table) -> list[str]:
    if not table.primary_key:
        raise UpdateError(f"without a primary key, the rows of {table.name!r} cannot be told apart for an update")
    return list(table.primary_key)


def compare(stored: DataFrame, edited: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Pair stored and edited rows by key and name the outcome in `_status`.

    Carries the key, the stored values as `old_<name>` and the edited values
    as `new_<name>`. NULL equals NULL.
    """
    key = [name(k) for k in keys]
    old = stored.selectExpr(*key, *[f"{name(v)} AS {name('old_' + v)}" for v in values], "TRUE AS _old")
    new = edited.selectExpr(*key, *[f"{name(v)} AS {name('new_' + v)}" for v in values], "TRUE AS _new")
    differs = any_of([f"NOT ({name('old_' + v)} <=> {name('new_' + v)})" for v in values])
    status = (
        "CASE WHEN _old IS NULL THEN 'added' WHEN _new IS NULL THEN 'removed' "
        f"WHEN {differs} THEN 'changed' ELSE 'same' END AS _status"
    )
    pairs = old.join(new, list(keys), "full_outer")
    return pairs.selectExpr(*[name(c) for c in pairs.columns if c not in ("_old", "_new")], status)


def key_changes(stored: DataFrame, edited: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, with `status` added or removed; empty when unchanged."""
    return compare(stored, edited, keys, []).where("_status <> 'same'").withColumnRenamed("_status", "status")


def paired(table: Table, stored: DataFrame, edited: DataFrame) -> DataFrame:
    """Stored and edited rows of a table, paired by primary key."""
    keys = keys_of(table)
    return compare(stored, edited, keys, [c for c in table.column_names if c not in keys])


def changed_of(table: Table, pairs: DataFrame) -> DataFrame:
    """The edited side of pairs whose values differ."""
    keys = table.primary_key
    return pairs.where("_status = 'changed'").selectExpr(
        *[name(c) if c in keys else f"{name('new_' + c)} AS {name(c)}" for c in table.column_names]
    )


def merged_of(table: Table, pairs: DataFrame) -> DataFrame:
    """The stored table with changed rows replaced; a change to NULL is kept."""
    chosen = "CASE WHEN _status = 'changed' THEN {new} ELSE {old} END AS {column}"
    return pairs.where("_status <> 'added'").selectExpr(
        *[
            name(c) if c in table.primary_key else chosen.format(new=name("new_" + c), old=name("old_" + c), column=name(c))
            for c in table.column_names
        ]
    )


def changed_rows(table: Table, stored: DataFrame, edited: DataFrame) -> DataFrame:
    """Edited rows whose values differ from the stored row of the same key."""
    return changed_of(table, paired(table, stored, edited))


def merged(table: Table, stored: DataFrame, edited: DataFrame) -> DataFrame:
    return merged_of(table, paired(table, stored, edited))


def update_table(
    spark: SparkSession,
    spec: DatasetSpec,
    data: Mapping[str, DataFrame],
    table_name: str,
    edited: DataFrame,
    stored_valid: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Check an edited table and return (new table, changed rows).

    The whole dataset with the edited table must be valid and the set of keys
    must not change; otherwise nothing is returned. The pairs are written
    once, and the key check and both results read them from there. With
    `stored_valid`, `data` is known to be valid, and only what the edit can
    break is judged.
    """
    table = spec.table(table_name)
    keys_of(table)
    edited = normalized(table, edited)
    others = {n: df for n, df in data.items() if n.casefold() != table.name.casefold()}
    stored = next(df for n, df in data.items() if n.casefold() == table.name.casefold())
    only = (table.name,) if stored_valid else None
    assert_valid(spark, spec, {**others, table.name: edited}, ignore=("unsupported_check",), only=only)
    pairs = written(paired(table, stored, edited))
    if not pairs.where("_status IN ('added', 'removed')").isEmpty():
        raise UpdateError(f"an update of {table.name!r} must keep its primary keys as they are")
    return merged_of(table, pairs), changed_of(table, pairs)


def normalized(table: Table, df: DataFrame) -> DataFrame:
    """A typed table in declared names and order; it must carry exactly the declared columns."""
    by_name = {c.casefold(): c for c in df.columns}
    unknown = [c for c in df.columns if not table.has_column(c)]
    absent = [c for c in table.column_names if c.casefold() not in by_name]
    if unknown or absent:
        raise UpdateError(f"{table.name}: columns {unknown} are not declared and {absent} are not given")
    return df.select(*[ref(by_name[c.casefold()]).alias(c) for c in table.column_names])


def normalized_rows(table: Table, df: DataFrame, raw: str, locator: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Resolve JSON rows to declared names and order, values as text.

    Returns (rows, violations). An edited row must be an object that carries
    every declared column, whatever the case of its names, and no other.
    """
    declared = {c.casefold(): c for c in table.column_names}
    where = [name(c) for c in locator]
    entries = df.selectExpr(*where, f"{raw_entries(raw)} AS _entries")
    entries = entries.selectExpr("*", "transform(_entries, e -> lower(e.key)) AS _names")
    values = [
        f"get(_entries, CAST(array_position(_names, {lit(low)}) AS INT) - 1).value AS {name(column)}"
        for low, column in declared.items()
    ]
    rows = entries.where("_entries IS NOT NULL").selectExpr(*where, *values)

    known = array(list(declared))
    report = "named_struct('kind', '{kind}', 'name', {column})"
    unknown = (
        f"transform(filter(_entries, e -> NOT array_contains({known}, lower(e.key))), "
        f"e -> {report.format(kind='unknown_column', column='e.key')})"
    )
    absent = f"transform(array_except({known}, _names), n -> {report.format(kind='missing_column', column='n')})"
    shape = f"array({report.format(kind='row_shape', column=text(None))})"
    violations = entries.selectExpr(
        *where, f"inline(CASE WHEN _entries IS NULL THEN {shape} ELSE concat({unknown}, {absent}) END)"
    ).selectExpr("kind", f"{lit(table.name)} AS table_name", "name AS column_name", f"{row_key(locator)} AS row_key")
    return rows, violations
