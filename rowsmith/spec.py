"""Dataset specifications: what the tables of a dataset must look like.

A spec is driver metadata only. It never holds rows, so it stays small however
large the tables are.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import types as T

from rowsmith.functions.checks import Node, node_from_dict, node_to_dict

CURRENT_TIMESTAMP = "CURRENT_TIMESTAMP"


class SpecError(ValueError):
    """A spec names something that does not exist or cannot be declared."""


@dataclass(frozen=True)
class ColumnType:
    name: str
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    values: tuple[str, ...] = ()

    @property
    def family(self) -> str:
        """The group of types whose values can be compared with each other."""
        return _FAMILIES[self.name]

    def spark_type(self) -> T.DataType:
        if self.name == "DECIMAL":
            return T.DecimalType(self.precision, self.scale or 0)
        return _SPARK_TYPES[self.name]

    def __str__(self) -> str:
        if self.name == "VARCHAR":
            return f"VARCHAR({self.length})"
        if self.name == "DECIMAL":
            return f"DECIMAL({self.precision}, {self.scale or 0})"
        return self.name


_FAMILIES = {
    "INT": "number",
    "DECIMAL": "number",
    "BOOLEAN": "number",
    "VARCHAR": "text",
    "TEXT": "text",
    "ENUM": "text",
    "DATE": "date",
    "DATETIME": "datetime",
}

_SPARK_TYPES: dict[str, T.DataType] = {
    "INT": T.LongType(),
    "VARCHAR": T.StringType(),
    "TEXT": T.StringType(),
    "ENUM": T.StringType(),
    "DATE": T.DateType(),
    "DATETIME": T.TimestampNTZType(),
    "BOOLEAN": T.BooleanType(),
}

INT = ColumnType("INT")
TEXT = ColumnType("TEXT")
DATE = ColumnType("DATE")
DATETIME = ColumnType("DATETIME")
BOOLEAN = ColumnType("BOOLEAN")


def VARCHAR(length: int) -> ColumnType:
    if length < 1:
        raise SpecError("VARCHAR needs a positive length")
    return ColumnType("VARCHAR", length=length)


def DECIMAL(precision: int, scale: int = 0) -> ColumnType:
    if not 1 <= precision <= 38 or not 0 <= scale <= precision:
        raise SpecError(f"DECIMAL({precision}, {scale}) is out of range")
    return ColumnType("DECIMAL", precision=precision, scale=scale)


def ENUM(*values: str) -> ColumnType:
    if not values:
        raise SpecError("ENUM needs at least one value")
    return ColumnType("ENUM", values=tuple(values))


@dataclass(frozen=True)
class Column:
    """One column. `default` is SQL literal text such as `"'Draft'"` or `"0"`."""

    name: str
    type: ColumnType
    nullable: bool = True
    unique: bool = False
    default: str | None = None
    checks: tuple[Node, ...] = ()


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str | None = None
    on_update: str | None = None

    def __str__(self) -> str:
        return f"({', '.join(self.columns)}) -> {self.parent}({', '.join(self.parent_columns)})"


@dataclass(frozen=True)
class Table:
    """One table with its keys and row rules.

    Key columns are always NOT NULL; a unique column is also listed in
    `unique` as a group of one, so key operators read `unique` alone.
    """

    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    checks: tuple[Node, ...] = ()
    _by_name: dict[str, Column] = field(init=False, repr=False, compare=False, default=None)

    def __post_init__(self) -> None:
        names = {c.name.casefold(): c.name for c in self.columns}
        if len(names) != len(self.columns):
            raise SpecError(f"table {self.name!r} declares a column twice")
        key = {self._canonical(names, c) for c in self.primary_key}
        single = {g[0].casefold() for g in self.unique if len(g) == 1}
        columns = tuple(
            Column(
                c.name,
                c.type,
                c.nullable and c.name not in key,
                c.unique or c.name.casefold() in single,
                c.default,
                tuple(c.checks),
            )
            for c in self.columns
        )
        groups = [tuple(self._canonical(names, c) for c in g) for g in self.unique]
        groups += [(c.name,) for c in columns if c.unique and (c.name,) not in groups]
        fks = tuple(
            ForeignKey(
                tuple(self._canonical(names, c) for c in fk.columns),
                fk.parent,
                tuple(fk.parent_columns),
                fk.on_delete,
                fk.on_update,
            )
            for fk in self.foreign_keys
        )
        put = object.__setattr__
        put(self, "columns", columns)
        put(self, "primary_key", tuple(self._canonical(names, c) for c in self.primary_key))
        put(self, "unique", tuple(groups))
        put(self, "foreign_keys", fks)
        put(self, "checks", tuple(self.checks))
        put(self, "_by_name", {c.name.casefold(): c for c in columns})

    def _canonical(self, names: dict[str, str], name: str) -> str:
        try:
            return names[name.casefold()]
        except KeyError:
            raise SpecError(f"table {self.name!r} has no column {name!r}") from None

    def column(self, name: str) -> Column:
        try:
            return self._by_name[name.casefold()]
        except KeyError:
            raise SpecError(f"table {self.name!r} has no column {name!r}") from None

    def has_column(self, name: str) -> bool:
        return name.casefold() in self._by_name

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def foreign_columns(self) -> set[str]:
        return {c for fk in self.foreign_keys for c in fk.columns}

    def is_key_column(self, name: str) -> bool:
        column = self.column(name).name
        return column in self.primary_key or column in self.foreign_columns

    def spark_schema(self) -> T.StructType:
        return T.StructType(
            [T.StructField(c.name, c.type.spark_type(), c.nullable) for c in self.columns]
        )

    def row_checks(self) -> list[tuple[str | None, Node]]:
        """Column checks first, then table checks, each with the column it hangs on."""
        listed: list[tuple[str | None, Node]] = [
            (c.name, check) for c in self.columns for check in c.checks
        ]
        return listed + [(None, check) for check in self.checks]


@dataclass(frozen=True)
class DatasetSpec:
    tables: tuple[Table, ...]

    def __post_init__(self) -> None:
        by_name = {t.name.casefold(): t for t in self.tables}
        if len(by_name) != len(self.tables):
            raise SpecError("a table is declared twice")
        resolved = []
        for table in self.tables:
            fks = []
            for fk in table.foreign_keys:
                parent = by_name.get(fk.parent.casefold())
                if parent is None:
                    raise SpecError(f"{table.name} references unknown table {fk.parent!r}")
                targets = fk.parent_columns or parent.primary_key
                if len(targets) != len(fk.columns):
                    raise SpecError(f"{table.name} {fk} pairs a different number of columns")
                names = tuple(parent.column(c).name for c in targets)
                fks.append(ForeignKey(fk.columns, parent.name, names, fk.on_delete, fk.on_update))
            resolved.append(
                Table(
                    table.name,
                    table.columns,
                    table.primary_key,
                    table.unique,
                    tuple(fks),
                    table.checks,
                )
            )
        object.__setattr__(self, "tables", tuple(resolved))

    def table(self, name: str) -> Table:
        for table in self.tables:
            if table.name.casefold() == name.casefold():
                return table
        raise SpecError(f"the dataset has no table {name!r}")

    def to_json(self) -> str:
        return json.dumps({"tables": [_table_to_dict(t) for t in self.tables]})

    @staticmethod
    def from_json(text: str) -> DatasetSpec:
        return DatasetSpec(tuple(_table_from_dict(t) for t in json.loads(text)["tables"]))


def _table_to_dict(table: Table) -> dict[str, Any]:
    return {
        "name": table.name,
        "columns": [
            {
                "name": c.name,
                "type": [c.type.name, c.type.length, c.type.precision, c.type.scale],
                "values": list(c.type.values),
                "nullable": c.nullable,
                "unique": c.unique,
                "default": c.default,
                "checks": [node_to_dict(n) for n in c.checks],
            }
            for c in table.columns
        ],
        "primary_key": list(table.primary_key),
        "unique": [list(g) for g in table.unique],
        "foreign_keys": [
            [list(fk.columns), fk.parent, list(fk.parent_columns), fk.on_delete, fk.on_update]
            for fk in table.foreign_keys
        ],
        "checks": [node_to_dict(n) for n in table.checks],
    }


def _table_from_dict(raw: dict[str, Any]) -> Table:
    return Table(
        raw["name"],
        tuple(
            Column(
                c["name"],
                ColumnType(*c["type"], values=tuple(c["values"])),
                c["nullable"],
                c["unique"],
                c["default"],
                tuple(node_from_dict(n) for n in c["checks"]),
            )
            for c in raw["columns"]
        ),
        tuple(raw["primary_key"]),
        tuple(tuple(g) for g in raw["unique"]),
        tuple(
            ForeignKey(tuple(cols), parent, tuple(targets), on_delete, on_update)
            for cols, parent, targets, on_delete, on_update in raw["foreign_keys"]
        ),
        tuple(node_from_dict(n) for n in raw["checks"]),
    )


def default_value(column: Column, *, portable: bool = False) -> Any:
    """Read a column default as a Python value; None when there is no usable one.

    CURRENT_TIMESTAMP is returned as that marker for date columns. `portable`
    also refuses text that is not quoted, as a stored table would.
    """
    raw = column.default
    if raw is None:
        return None
    kind = column.type.name
    if raw.upper() == CURRENT_TIMESTAMP:
        return CURRENT_TIMESTAMP if kind in ("DATE", "DATETIME") else None
    quoted = len(raw) > 1 and raw[0] in "'\"" and raw[-1] == raw[0]
    text = raw[1:-1] if quoted else raw
    if not quoted and raw.upper() == "NULL":
        return None
    if kind in ("VARCHAR", "TEXT", "ENUM"):
        if portable and not quoted:
            return None
        if kind == "ENUM":
            return text if text in column.type.values else None
        return text[: column.type.length] if column.type.length else text
    try:
        return _READERS[kind](text, column.type)
    except (ArithmeticError, KeyError, ValueError):
        return None


_READERS = {
    "INT": lambda text, _: int(text),
    "DECIMAL": lambda text, t: Decimal(text).quantize(Decimal(1).scaleb(-(t.scale or 0))),
    "BOOLEAN": lambda text, _: {"TRUE": True, "1": True, "FALSE": False, "0": False}[text.upper()],
    "DATE": lambda text, _: date.fromisoformat(text),
    "DATETIME": lambda text, _: datetime.fromisoformat(text),
}
