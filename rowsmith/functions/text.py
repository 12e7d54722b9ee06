"""Small pieces of Spark SQL text.

Operators build their expressions as SQL text and hand each to Spark once:
a wide table has hundreds of rules, and one call per expression keeps the
driver's share of the work flat.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date, datetime
from decimal import Decimal
from typing import Any


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def names(columns: Iterable[str]) -> str:
    return ", ".join(name(c) for c in columns)


def lit(value: Any) -> str:
    """A typed literal; datetimes carry no zone, whatever the session zone is."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return f"{value}L" if value >= 0 else f"({value}L)"
    if isinstance(value, Decimal):
        if value == value.to_integral_value() and abs(value) < 2**31:
            return f"({int(value)})"
        return f"{value:f}BD" if value >= 0 else f"({value:f}BD)"
    if isinstance(value, float):
        return f"{value!r}D" if value >= 0 else f"({value!r}D)"
    if isinstance(value, datetime):
        return f"TIMESTAMP_NTZ'{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE'{value.isoformat()}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def text(value: str | None) -> str:
    """A string literal, typed also when it is NULL."""
    return "CAST(NULL AS STRING)" if value is None else lit(value)


def array(values: Sequence[Any]) -> str:
    return f"array({', '.join(lit(v) for v in values)})"


def all_of(conditions: Sequence[str]) -> str:
    return " AND ".join(f"({c})" for c in conditions) if conditions else "TRUE"


def any_of(conditions: Sequence[str]) -> str:
    return " OR ".join(f"({c})" for c in conditions) if conditions else "FALSE"


def not_null(columns: Iterable[str]) -> str:
    return all_of([f"{name(c)} IS NOT NULL" for c in columns])


def sql_type(kind: Any) -> str:
    return kind.simpleString()
