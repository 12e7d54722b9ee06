"""The registered queries: a Spark function each, most with SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# --- SQL fragments -----------------------------------------------------------


def sql_violation(kind: str, table: str, column: str | None, key: str, source: str, where: str = "TRUE") -> str:
    """One SELECT of violations, in the columns every validation query returns."""
    name = "CAST(NULL AS VARCHAR)" if column is None else f"'{column}'"
    return (
        f"SELECT '{kind}' AS kind, '{table}' AS table_name, {name} AS column_name, "
        f"{key} AS row_key FROM {source} WHERE {where}"
    )


def sql_key(*columns: str) -> str:
    return " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), 'NULL')" for c in columns)


def sql_repeats(kind: str, table: str, keys: tuple[str, ...], order: str, key: str, source: str) -> str:
    """Rows after the first of their key, in the given order; NULL keys do not count."""
    present = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    ranked = (
        f"(SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {order}) AS rn "
        f"FROM {source} WHERE {present})"
    )
    return sql_violation(kind, table, keys[0] if len(keys) == 1 else None, key, ranked, "rn > 1")


def sql_draw(seed: int, table: str, column: str, row: str, n: int | str, label: str = "value") -> str:
    return (
        f"(('0x' || substr(md5('{seed}|{table}|{column}|{label}|' || CAST({row} AS VARCHAR)), 1, 15))::BIGINT % ({n}))"
    )


def sql_slices(seed: int, table: str, column: str, row: str) -> Callable[[str, int], str]:
    """The small draws that `Draws.slices` cuts for one text value: 60 bits at a time, ten of them kept back."""
    cut: dict[str, str] = {}
    place = [0, 1]

    def pick(label: str, n: int) -> str:
        if label not in cut:
            if place[1] > 1 and place[1] * n > 2**50:
                place[:] = [place[0] + 1, 1]
            half, digest = 1 + 15 * (place[0] % 2), f"md5('{seed}|{table}|{column}|text{place[0] // 2}|' || CAST({row} AS VARCHAR))"
            cut[label] = f"(('0x' || substr({digest}, {half}, 15))::BIGINT // {place[1]} % {n})"
            place[1] *= n
        return cut[label]

    return pick


def sql_permute(row: str, capacity: str, rows: str, salt: int) -> str:
    """The permutation of `rowsmith.functions.draw.permute` for counts known only to the data."""
    limit = 2**62
    largest = f"greatest(1, least(({capacity}) - 1, ({limit} - ({capacity})) // ({rows})))"
    start = f"greatest(1, least({largest}, CAST(floor(CAST({largest} AS DOUBLE) * 0.6180339887498949) AS BIGINT) + {salt % 97}))"
    multiplier = f"(SELECT max(m) FROM range(greatest(1, {start} - 300), {start} + 1) AS r(m) WHERE gcd(m, {capacity}) = 1)"
    return f"((({row}) * {multiplier} + {salt} % ({capacity})) % ({capacity}))"


def sql_words(words: tuple[str, ...] | list[str], position: str) -> str:
    listed = ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    return f"[{listed}][({position}) + 1]"


def sql_base36(number: str, width: int | str) -> str:
    return f"lpad(to_base({number}, 36), {width}, '0')"
