"""Queries for generated keys, values, texts, foreign keys and whole datasets.

Row ids come from the test tables, one generated row per given row, and given
tables serve as parents. Draws use md5 where SQL repeats them.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.functions import vocab
from rowsmith.functions.checks import between, cmp, col, in_
from rowsmith.operators.generate import ROW, ColumnPlan, Generator, Plan, TablePlan, generate
from rowsmith.operators.numbering import dense_index, number_within
from rowsmith.operators.shared import at_once, checkpoint_dir, written
from rowsmith.operators.validate import validate
from rowsmith.plans.registry import query, sql_base36, sql_draw, sql_permute, sql_slices, sql_words
from rowsmith.plans.tpch import load
from rowsmith.spec import BOOLEAN, DATE, DATETIME, DECIMAL, ENUM, INT, TEXT, VARCHAR, Column, DatasetSpec, ForeignKey, Table

SEED = 7


def salt(table: str, label: str) -> int:
    return zlib.crc32(f"{SEED}|{table}|{label}".encode())


def draw(column: str, n: int | str, label: str = "value", table: str = "t", row: str = "r") -> str:
    return sql_draw(SEED, table, column, row, n, label)


def ids(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    """One row id per row of a test table whose key counts from 0."""
    return load(spark, sf_dir, table).select(F.col(key).cast("bigint").alias(ROW))


def built(
    spark: SparkSession,
    tables: Table | tuple[Table, ...],
    scaffolds: Mapping[str, DataFrame],
    plans: tuple[ColumnPlan, ...] = (),
    existing: Mapping[str, DataFrame] | None = None,
    hash_method: str = "md5",
) -> DataFrame:
    """Generate the first table of a spec over given row ids."""
    tables = tables if isinstance(tables, tuple) else (tables,)
    spec = DatasetSpec(tables)
    first = tables[0]
    plan = None
    if plans:
        named = {p.column: p for p in plans}
        plan = Plan(
            tuple(
                TablePlan(t.name, None, tuple(named.get(c, ColumnPlan(c)) if t is first else ColumnPlan(c) for c in t.column_names))
                for t in tables
            )
        )
    rows = {name: df.count() for name, df in scaffolds.items()}
    generator = Generator(
        spark, spec, plan, rows, SEED, existing=existing, scaffolds=scaffolds, hash_method=hash_method
    )
    generator.build()
    return generator.frame(first.name, keep_row_id=True)


def over_events(
    spark: SparkSession,
    sf_dir: str,
    columns: tuple[Column, ...],
    plans: tuple[ColumnPlan, ...] = (),
    checks: tuple = (),
    hash_method: str = "md5",
) -> DataFrame:
    table = Table("t", columns, checks=checks)
    scaffolds = {"t": ids(spark, sf_dir, "events", "event_id")}
    return built(spark, table, scaffolds, plans, hash_method=hash_method)


def from_events(*columns: str) -> str:
    return f"SELECT r AS row_id, {', '.join(columns)} FROM (SELECT event_id AS r FROM events)"


EVENT_COUNT = "(SELECT count(*) FROM events)"

# --- scaffold and keys -------------------------------------------------------


@query(
    "gen_scaffold",
    """SELECT 'asked' AS table_name, count(*) AS n_rows, CAST(0 AS BIGINT) AS first_id, count(*) - 1 AS last_id, count(*) - count(*) AS filled FROM orders
       UNION ALL SELECT 'planned', count(*), 0, count(*) - 1, 0 FROM customer
       UNION ALL SELECT 'plain', 25, 0, 24, 0""",
)
def gen_scaffold(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = DatasetSpec(tuple(Table(n, (Column("note", TEXT),)) for n in ("asked", "planned", "plain")))
    plan = Plan(
        tuple(
            TablePlan(n, rows, (ColumnPlan("note", nullable_probability=1.0),))
            for n, rows in (("asked", 3), ("planned", load(spark, sf_dir, "customer").count()), ("plain", None))
        )
    )
    asked = {"asked": load(spark, sf_dir, "orders").count()}
    generator = Generator(spark, spec, plan, asked, SEED)
    generator.build()
    parts = [
        generator.frame(n, keep_row_id=True).agg(
            F.lit(n).alias("table_name"),
            F.count(F.lit(1)).alias("n_rows"),
            F.min(ROW).alias("first_id"),
            F.max(ROW).alias("last_id"),
            F.count("note").alias("filled"),
        )
        for n in ("asked", "planned", "plain")
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query("gen_seq_key", "SELECT o_orderkey AS row_id, o_orderkey + 1 AS id, o_orderkey + 1001 AS late_id FROM orders")
def gen_seq_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = {"t": ids(spark, sf_dir, "orders", "o_orderkey")}
    late = Table("t", (Column("late_id", INT, checks=(cmp(col("late_id"), ">", 1000),)),), ("late_id",))
    plain = built(spark, Table("t", (Column("id", INT),), ("id",)), rows)
    return plain.join(built(spark, late, rows), ROW)


def slices(column: str, table: str = "t", row: str = "r"):
    return sql_slices(SEED, table, column, row)


def _word(pick, label: str) -> str:
    return sql_words(vocab.WORDS, pick(label, len(vocab.WORDS)))


def _initcap(text: str) -> str:
    return f"upper(left({text}, 1)) || substr({text}, 2)"


def _sql_sentence(column: str, words: int) -> str:
    pick = slices(column)
    parts = [_word(pick, f"w{i}") for i in range(words)]
    return " || ' ' || ".join([f"({_initcap(parts[0])})", *parts[1:]])


# The suffix is as wide as the largest id needs.
_WIDTH = f"CASE WHEN {EVENT_COUNT} <= 36 THEN 1 WHEN {EVENT_COUNT} <= 1296 THEN 2 WHEN {EVENT_COUNT} <= 46656 THEN 3 WHEN {EVENT_COUNT} <= 1679616 THEN 4 ELSE 5 END"


@query(
    "gen_text_key",
    from_events(f"left({_sql_sentence('code', 4)}, 12 - {_WIDTH}) || {sql_base36('r', _WIDTH)} AS code"),
)
def gen_text_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Table("t", (Column("code", VARCHAR(12)),), ("code",))
    return built(spark, table, {"t": ids(spark, sf_dir, "events", "event_id")})


@query("gen_composite_key", from_events("r + 1 AS id", f"{sql_words(('x', 'y', 'z'), draw('part', 3))} AS part"))
def gen_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Table("t", (Column("id", INT), Column("part", ENUM("x", "y", "z"))), ("id", "part"))
    return built(spark, table, {"t": ids(spark, sf_dir, "events", "event_id")})


_N_ORDERS, _N_CUSTOMERS, _N_PARTS = (f"(SELECT count(*) FROM {t})" for t in ("orders", "customer", "part"))
_CUSTOMERS = "(SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS ci FROM customer)"
_PARTS = "(SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pi FROM part)"
_CUSTOMER_FK = ForeignKey(("c_custkey",), "customer", ("c_custkey",))
_PART_FK = ForeignKey(("p_partkey",), "part", ("p_partkey",))
_CUSTOMER_ONLY = Table("customer", (Column("c_custkey", INT),), ("c_custkey",))
_PART_ONLY = Table("part", (Column("p_partkey", INT),), ("p_partkey",))


def parents(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "customer": load(spark, sf_dir, "customer").select("c_custkey"),
        "part": load(spark, sf_dir, "part").select("p_partkey"),
    }


_PAIR = sql_permute("o_orderkey", f"({_N_CUSTOMERS} * {_N_PARTS})", _N_ORDERS, salt("t", "key"))


@query(
    "gen_junction_key",
    f"""SELECT row_id, c_custkey, p_partkey FROM (SELECT o_orderkey AS row_id, {_PAIR} AS k FROM orders)
        JOIN {_CUSTOMERS} ON ci = k % {_N_CUSTOMERS} JOIN {_PARTS} ON pi = (k // {_N_CUSTOMERS}) % {_N_PARTS}""",
)
def gen_junction_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Table(
        "t", (Column("c_custkey", INT), Column("p_partkey", INT)), ("c_custkey", "p_partkey"), foreign_keys=(_CUSTOMER_FK, _PART_FK)
    )
    tables = (table, _CUSTOMER_ONLY, _PART_ONLY)
    return built(spark, tables, {"t": ids(spark, sf_dir, "orders", "o_orderkey")}, existing=parents(spark, sf_dir))


def _dealt(columns: str) -> str:
    """Orders dealt to customers in rounds: `q` is the round, `c_custkey` the parent."""
    deal = sql_permute("o_orderkey", _N_ORDERS, _N_ORDERS, salt("t", "deal"))
    parent = sql_permute(f"(d % {_N_CUSTOMERS})", _N_CUSTOMERS, f"least({_N_CUSTOMERS}, {_N_ORDERS})", salt("t", "parent"))
    return f"""SELECT row_id, c_custkey, {columns}
        FROM (SELECT o_orderkey AS row_id, o_orderkey AS r, {deal} AS d FROM orders) AS a, LATERAL (SELECT {parent} AS g, d // {_N_CUSTOMERS} AS q) AS b
        JOIN {_CUSTOMERS} ON ci = g"""


def per_customer(spark: SparkSession, sf_dir: str, *columns: Column) -> DataFrame:
    key = ("c_custkey", *[c.name for c in columns])
    table = Table("t", (Column("c_custkey", INT), *columns), key, foreign_keys=(_CUSTOMER_FK,))
    existing = {"customer": parents(spark, sf_dir)["customer"]}
    return built(spark, (table, _CUSTOMER_ONLY), {"t": ids(spark, sf_dir, "orders", "o_orderkey")}, existing=existing)


@query("gen_discriminator", _dealt("q + 1 AS sequence_no"))
def gen_discriminator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_customer(spark, sf_dir, Column("sequence_no", INT))


# One base-36 digit is enough for the rounds of one parent at every scale here.
@query("gen_text_discriminator", _dealt(f"left({_sql_sentence('tag', 4)}, 7) || {sql_base36('q', 1)} AS tag"))
def gen_text_discriminator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_customer(spark, sf_dir, Column("tag", VARCHAR(8)))


@query(
    "gen_multi_discriminator",
    _dealt(f"{sql_words(('a', 'b', 'c', 'd', 'e', 'f', 'g'), 'q % 7')} AS slot, (q // 7) % 2 = 1 AS weekend"),
)
def gen_multi_discriminator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_customer(spark, sf_dir, Column("slot", ENUM(*"abcdefg")), Column("weekend", BOOLEAN))


@query(
    "gen_numbered_rows",
    "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS number FROM events",
)
def gen_numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_id", "user_id")
    return number_within(events, ["user_id"], "event_id", events.count(), "number")


@query(
    "gen_parent_index",
    """SELECT p_brand, p_type, row_number() OVER (ORDER BY p_brand, p_type, p_partkey) - 1 AS parent_index
       FROM (SELECT p_partkey, nullif(p_brand, 'Brand#2') AS p_brand, p_type FROM part) WHERE p_brand IS NOT NULL""",
)
def gen_parent_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").selectExpr("p_partkey", "nullif(p_brand, 'Brand#2') AS p_brand", "p_type")
    usable = part.where("p_brand IS NOT NULL AND p_type IS NOT NULL")
    indexed = dense_index(usable, ["p_brand", "p_type"], "parent_index", max(usable.count(), 1), ["p_partkey"])
    return indexed.select("p_brand", "p_type", "parent_index")


# --- values ------------------------------------------------------------------


@query(
    "gen_int",
    from_events(
        f"{draw('plain', 10001)} AS plain",
        f"-20 + {draw('checked', 16)} AS checked",
        f"-10010 + {draw('shifted', 10001)} AS shifted",
        f"500 + {draw('planned', 251)} AS planned",
    ),
)
def gen_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (
        Column("plain", INT),
        Column("checked", INT, checks=(between(col("checked"), -20, 10), cmp(col("checked"), "<", -4))),
        Column("shifted", INT, checks=(cmp(col("shifted"), "<=", -10),)),
        Column("planned", INT),
    )
    return over_events(spark, sf_dir, columns, (ColumnPlan("planned", minimum=500, maximum=750.9),))


@query(
    "gen_decimal",
    from_events(
        f"CAST({draw('price', 1000001)} AS DECIMAL(18,0)) * 0.01::DECIMAL(3,2) AS price_wide",
        f"CAST(CAST({draw('small', 99999)} + 1 AS DECIMAL(9,0)) * 0.01::DECIMAL(3,2) AS DECIMAL(5,2)) AS small",
    ).replace("AS price_wide", "AS price"),
)
def gen_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (Column("price", DECIMAL(18, 2)), Column("small", DECIMAL(5, 2), checks=(cmp(col("small"), ">", 0),)))
    return over_events(spark, sf_dir, columns)


@query(
    "gen_date",
    from_events(
        f"DATE '2015-01-01' + CAST({draw('day', 4018)} AS INTEGER) AS day",
        f"DATE '2024-02-10' + CAST({draw('late', (date(2025, 12, 31) - date(2024, 2, 10)).days + 1)} AS INTEGER) AS late",
        f"DATE '2030-01-01' + CAST({draw('future', 4018)} AS INTEGER) AS future",
    ),
)
def gen_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (
        Column("day", DATE),
        Column("late", DATE, checks=(cmp(col("late"), ">=", "2024-02-01"),)),
        Column("future", DATE, checks=(cmp(col("future"), ">=", "2030-01-01"),)),
    )
    return over_events(spark, sf_dir, columns, (ColumnPlan("late", minimum="2024-02-10T00:00"),))


_DAY = 86_400


@query(
    "gen_datetime",
    from_events(
        f"TIMESTAMP '2015-01-01' + to_seconds({draw('moment', 4018 * _DAY)}) AS moment",
        f"TIMESTAMP '2024-06-01 12:00:00' + to_seconds({draw('recent', 365 * _DAY + 1)}) AS recent",
        f"TIMESTAMP '2024-01-01' + to_seconds({draw('planned', 31 * _DAY)}) AS planned",
    ),
)
def gen_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (
        Column("moment", DATETIME),
        Column("recent", DATETIME, default="CURRENT_TIMESTAMP"),
        Column("planned", DATETIME),
    )
    return over_events(spark, sf_dir, columns, (ColumnPlan("planned", minimum="2024-01-01", maximum="2024-01-31"),))


@query(
    "gen_sequential",
    from_events(
        "least(10 + r, 900) AS step",
        "DATE '2020-01-01' + CAST(least(r, 365) AS INTEGER) AS day",
        "CAST([2, 5, 11][least(r, 2) + 1] AS BIGINT) AS listed",
    ),
)
def gen_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (Column("step", INT), Column("day", DATE), Column("listed", INT, checks=(in_(col("listed"), 11, 2, 5),)))
    plans = (
        ColumnPlan("step", minimum=10, maximum=900, distribution="sequential"),
        ColumnPlan("day", minimum="2020-01-01", maximum="2020-12-31", distribution="sequential"),
        ColumnPlan("listed", distribution="sequential"),
    )
    return over_events(spark, sf_dir, columns, plans)


@query(
    "gen_categories",
    from_events(
        f"{sql_words(('low', 'high'), draw('level', 2))} AS level",
        f"{sql_words(('red', 'blue'), draw('colour', 2))} AS colour",
        f"CAST([3, 7][{draw('size', 2)} + 1] AS BIGINT) AS size",
    ),
)
def gen_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (
        Column("level", VARCHAR(10), checks=(in_(col("level"), "low", "mid", "high"), in_(col("level"), "high", "low"))),
        Column("colour", ENUM("green", "red", "blue")),
        Column("size", INT, checks=(in_(col("size"), 7, 3, 99), cmp(col("size"), "<", 50))),
    )
    return over_events(spark, sf_dir, columns, (ColumnPlan("colour", categories=("red", "blue")),))


@query(
    "gen_enum_bool",
    from_events(f"{sql_words(('open', 'closed', 'lost'), draw('status', 3))} AS status", f"{draw('active', 2)} = 0 AS active"),
)
def gen_enum_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_events(spark, sf_dir, (Column("status", ENUM("open", "closed", "lost")), Column("active", BOOLEAN)))


@query(
    "gen_null_prob",
    from_events(
        f"CASE WHEN NOT {draw('score', 1000000, 'null')} < 300000 THEN {draw('score', 10001)} END AS score",
        f"{draw('sure', 10001)} AS sure",
    ),
)
def gen_null_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (Column("score", INT), Column("sure", INT, nullable=False))
    return over_events(spark, sf_dir, columns, (ColumnPlan("score", nullable_probability=0.3),))


@query(
    "gen_default_prob",
    from_events(
        f"CASE WHEN {draw('state_code', 4, 'default')} = 0 THEN 'draft' ELSE {sql_words(('draft', 'final'), draw('state_code', 2))} END AS state_code",
        f"CASE WHEN {draw('points', 1000000, 'null')} < 100000 THEN NULL WHEN {draw('points', 4, 'default')} = 0 THEN 0 ELSE {draw('points', 10001)} END AS points",
    ),
)
def gen_default_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (Column("state_code", ENUM("draft", "final"), default="'draft'"), Column("points", INT, default="0"))
    return over_events(spark, sf_dir, columns, (ColumnPlan("points", nullable_probability=0.1),))


def _padded(value: str, width: int) -> str:
    return f"lpad(CAST({value} AS VARCHAR), {width}, '0')"


_NAME, _PHONE, _STARTS, _LICENSE = (slices(c) for c in ("name", "phone", "starts", "license"))


@query(
    "gen_text_vocab",
    from_events(
        f"({_initcap(_word(_NAME, 'w0'))}) || ' ' || ({_initcap(_word(_NAME, 'w1'))}) AS name",
        " || '-' || ".join(_padded(_PHONE(f"p{i}", 10**n), n) for i, n in enumerate((3, 3, 4))) + " AS phone",
        f"{_padded(_STARTS('hour', 24), 2)} || ':' || {_padded(_STARTS('minute', 60), 2)} AS starts",
        "'ticket-' || CAST(r + 1 AS VARCHAR) AS ticket",
        f"chr(CAST({_LICENSE('l0', 26)} + 65 AS INTEGER)) || chr(CAST({_LICENSE('l1', 26)} + 65 AS INTEGER)) || {_padded(_LICENSE('digits', 10**6), 6)} AS license",
        f"left({_sql_sentence('brief', 4)}, 9) AS brief",
    ),
)
def gen_text_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (
        Column("name", VARCHAR(60)),
        Column("phone", VARCHAR(20)),
        Column("starts", VARCHAR(5)),
        Column("ticket", VARCHAR(40)),
        Column("license", VARCHAR(20)),
        Column("brief", VARCHAR(9)),
    )
    return over_events(spark, sf_dir, columns, (ColumnPlan("starts", generator="time"), ColumnPlan("ticket", generator="sequence")))


_KINDS = (*sorted(set(vocab.GENERATOR_ALIASES.values())), "opening_hours")


def _sql_kind(token: str, column: str) -> str:
    """A text value of a kind, drawn as the library draws it."""
    pick = slices(column)
    names = vocab.LOCALES[vocab.DEFAULT_LOCALE]

    def among(words, label: str) -> str:
        return sql_words(list(words), pick(label, len(words)))

    def capital(label: str) -> str:
        return f"({_initcap(_word(pick, label))})"

    def digits(count: int, label: str) -> str:
        return _padded(pick(label, 10**count), count)

    def sentence(words: int, label: str) -> str:
        parts = [_word(pick, f"{label}{i}") for i in range(words)]
        return " || ' ' || ".join([f"({_initcap(parts[0])})", *parts[1:]])

    match token:
        case "address":
            parts = f"CAST({pick('number', 999)} + 1 AS VARCHAR)", among(vocab.STREETS, "street"), among(vocab.STREET_KINDS, "kind")
            return " || ' ' || ".join(parts)
        case "city":
            return among(names["city"], "city")
        case "company":
            return f"{capital('w0')} || ' ' || {among(vocab.COMPANY_ENDS, 'end')}"
        case "country":
            return among(vocab.COUNTRIES, "country")
        case "email":
            return f"lower({among(names['first'], 'first')}) || '.' || lower({among(names['last'], 'last')}) || '@' || {among(vocab.DOMAINS, 'domain')}"
        case "first_name":
            return among(names["first"], "first")
        case "last_name":
            return among(names["last"], "last")
        case "full_name":
            return f"{among(names['first'], 'first')} || ' ' || {among(names['last'], 'last')}"
        case "isbn":
            d = digits(9, "isbn")
            weighted = " + ".join(f"CAST(substr({d}, {i + 1}, 1) AS INT) * {3 if i % 2 == 0 else 1}" for i in range(9))
            check = f"CAST((10 - (38 + {weighted}) % 10) % 10 AS VARCHAR)"
            return f"'978-' || substr({d}, 1, 1) || '-' || substr({d}, 2, 5) || '-' || substr({d}, 7, 3) || '-' || {check}"
        case "job":
            return among(vocab.JOBS, "job")
        case "label":
            return f"{capital('w0')} || ' ' || {capital('w1')}"
        case "license":
            letters = [f"chr(CAST({pick(f'l{i}', 26)} + 65 AS INTEGER))" for i in range(2)]
            return f"{letters[0]} || {letters[1]} || {digits(6, 'digits')}"
        case "opening_hours":
            return f"({pick('open', 6)} + 6) || ':00 AM - ' || ({pick('close', 7)} + 5) || ':00 PM'"
        case "phone":
            return " || '-' || ".join(digits(n, f"p{i}") for i, n in enumerate((3, 3, 4)))
        case "sentence":
            return sentence(5, "w")
        case "sequence":
            return f"'{column}-' || CAST(r + 1 AS VARCHAR)"
        case "state":
            return among(list(vocab.STATES.values()), "state")
        case "text":
            return " || ' ' || ".join(f"{sentence(6, f's{i}w')} || '.'" for i in range(3))
        case "time":
            return f"{_padded(pick('hour', 24), 2)} || ':' || {_padded(pick('minute', 60), 2)}"
        case "url":
            return f"'https://www.' || {_word(pick, 'w0')} || '-' || {_word(pick, 'w1')} || '.example.com/'"
        case "uuid":
            u = [f"format('{{:08x}}', {pick(f'u{i}', 16**8)})" for i in range(4)]
            variant = among("89ab", "variant")
            return f"{u[0]} || '-' || substr({u[1]}, 1, 4) || '-4' || substr({u[1]}, 6, 3) || '-' || {variant} || substr({u[2]}, 2, 3) || '-' || substr({u[2]}, 5, 4) || {u[3]}"
        case "word":
            return _word(pick, "w0")
        case "zip_code":
            return digits(5, "zip")
    raise ValueError(token)


def _kind_column(token: str) -> str:
    return token if token == "opening_hours" else f"c_{token}"


@query("gen_text_kinds", from_events(*[f"{_sql_kind(t, _kind_column(t))} AS {_kind_column(t)}" for t in _KINDS]))
def gen_text_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text generator once per event."""
    columns = tuple(Column(_kind_column(t), VARCHAR(200)) for t in _KINDS)
    return over_events(spark, sf_dir, columns, tuple(ColumnPlan(f"c_{t}", generator=t) for t in _KINDS[:-1]))


_LOCALES = ("en_US", "de_DE", "fr_FR", "xx_XX")


def _sql_first_name(locale: str) -> str:
    names = vocab.LOCALES.get(locale, vocab.LOCALES[vocab.DEFAULT_LOCALE])["first"]
    column = f"first_name_{locale.lower()}"
    return f"{sql_words(names, slices(column)('first', len(names)))} AS {column}"


@query("gen_locale", from_events(*[_sql_first_name(x) for x in _LOCALES]))
def gen_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names per locale; an unknown locale falls back to the default one."""
    columns = tuple(Column(f"first_name_{x.lower()}", VARCHAR(40)) for x in _LOCALES)
    return over_events(spark, sf_dir, columns, tuple(ColumnPlan(c.name, locale=x) for c, x in zip(columns, _LOCALES)))


@query(
    "gen_unique",
    from_events(
        f"{sql_permute('r', '1000001', EVENT_COUNT, salt('t', 'number'))} AS number",
        f"CAST(CAST({sql_permute('r', '1000001', EVENT_COUNT, salt('t', 'amount'))} AS DECIMAL(12,0)) * 0.01::DECIMAL(3,2) AS DECIMAL(9,2)) AS amount",
        f"TIMESTAMP '2015-01-01' + to_seconds({sql_permute('r', str(4018 * _DAY), EVENT_COUNT, salt('t', 'moment'))}) AS moment",
        f"left({_sql_sentence('code', 4)}, 15 - {_WIDTH}) || {sql_base36('r', _WIDTH)} AS code",
    ),
)
def gen_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (
        Column("number", INT, unique=True, checks=(between(col("number"), 0, 1_000_000),)),
        Column("amount", DECIMAL(9, 2), unique=True),
        Column("moment", DATETIME, unique=True),
        Column("code", VARCHAR(15), unique=True),
    )
    return over_events(spark, sf_dir, columns)


# --- labels ------------------------------------------------------------------


def _classify_sql(text: str, context: str) -> str:
    person = " OR ".join(f"contains(lower({place}), '{w}')" for w in vocab.PERSON_WORDS for place in (text, context))
    branches = " ".join(
        f"WHEN contains(lower({text}), '{fragment}') THEN "
        + (f"CASE WHEN {person} THEN 'full_name' ELSE 'label' END" if token == "full_name" else f"'{token}'")
        for fragment, token in vocab.NAME_FRAGMENTS
    )
    return f"CASE {branches} ELSE '' END"


@query(
    "classify_fragment",
    f"""SELECT doc_id AS id, 'documents' AS origin, {_classify_sql('text', 'source')} AS token FROM documents
        UNION ALL SELECT page_id, 'pages', {_classify_sql('html', 'url')} FROM pages
        UNION ALL SELECT c_custkey, 'customer', {_classify_sql("c_mktsegment || '_name'", 'c_name')} FROM customer""",
)
def classify_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id", "'documents' AS origin", f"{vocab.classify('text', 'source')} AS token"
    )
    pages = load(spark, sf_dir, "pages").selectExpr("page_id AS id", "'pages' AS origin", f"{vocab.classify('html', 'url')} AS token")
    segment = "concat(c_mktsegment, '_name')"
    customers = load(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "'customer' AS origin", f"{vocab.classify(segment, 'c_name')} AS token"
    )
    return documents.union(pages).union(customers)


EVENT_ALIASES = {"page_view": "view", "page_click": "click", "page_purchase": "sale", "page_sign_up": "join", "page_signup": "join"}
_LABEL = "' Page-' || upper(event_type) || ' '"
_FOLDED = f"replace(replace(lower(trim({_LABEL})), ' ', '_'), '-', '_')"
_CANONICAL = "CASE " + " ".join(f"WHEN {_FOLDED} = '{a}' THEN '{t}'" for a, t in EVENT_ALIASES.items()) + " END"


@query("canonical_label", f"SELECT event_id, {_CANONICAL} AS label FROM events")
def canonical_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = vocab.canonical_label("concat(' Page-', upper(event_type), ' ')", EVENT_ALIASES)
    return load(spark, sf_dir, "events").selectExpr("event_id", f"{label} AS label")


@query("repair_label", f"SELECT event_id, coalesce({_CANONICAL}, 'auto') AS label FROM events")
def repair_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_label(spark, sf_dir).fillna("auto", ["label"])


# --- foreign keys ------------------------------------------------------------


@query(
    "gen_fk",
    f"""SELECT r AS row_id, c_custkey FROM (SELECT event_id AS r, {draw('c_custkey', _N_CUSTOMERS, 'parent', row='event_id')} AS k FROM events)
        JOIN {_CUSTOMERS} ON ci = k""",
)
def gen_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Table("t", (Column("c_custkey", INT, nullable=False),), foreign_keys=(_CUSTOMER_FK,))
    existing = {"customer": parents(spark, sf_dir)["customer"]}
    return built(spark, (table, _CUSTOMER_ONLY), {"t": ids(spark, sf_dir, "events", "event_id")}, existing=existing)


@query(
    "gen_fk_distinct",
    f"""SELECT row_id, p_partkey FROM (SELECT c_custkey AS row_id, {sql_permute('c_custkey', _N_PARTS, _N_CUSTOMERS, salt('t', 'p_partkey'))} AS k FROM customer)
        JOIN {_PARTS} ON pi = k""",
)
def gen_fk_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Table("t", (Column("p_partkey", INT, unique=True, nullable=False),), foreign_keys=(_PART_FK,))
    existing = {"part": parents(spark, sf_dir)["part"]}
    return built(spark, (table, _PART_ONLY), {"t": ids(spark, sf_dir, "customer", "c_custkey")}, existing=existing)


_LINE_KEYS = "(SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS li FROM lineitem)"


@query(
    "gen_fk_null",
    f"""SELECT r AS row_id, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM (SELECT event_id AS r,
          CASE WHEN NOT {draw('l_orderkey|l_linenumber', 1000000, 'null', row='event_id')} < 250000
               THEN {draw('l_orderkey|l_linenumber', '(SELECT count(*) FROM lineitem)', 'parent', row='event_id')} END AS k FROM events)
        LEFT JOIN {_LINE_KEYS} ON li = k""",
)
def gen_fk_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    fk = ForeignKey(("l_orderkey", "l_linenumber"), "lineitem", ("l_orderkey", "l_linenumber"))
    table = Table("t", (Column("l_orderkey", INT), Column("l_linenumber", INT)), foreign_keys=(fk,))
    lines = Table("lineitem", (Column("l_orderkey", INT), Column("l_linenumber", INT)), ("l_orderkey", "l_linenumber"))
    existing = {"lineitem": load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint"))}
    plans = (ColumnPlan("l_orderkey", nullable_probability=0.25), ColumnPlan("l_linenumber"))
    return built(spark, (table, lines), {"t": ids(spark, sf_dir, "events", "event_id")}, plans, existing)


def _root_code(row: str) -> str:
    """The unique code of a root row: two words cut to fit, then the row id."""
    pick = slices("code", "roots", row)
    parts = [_word(pick, f"w{i}") for i in range(4)]
    sentence = " || ' ' || ".join([f"({_initcap(parts[0])})", *parts[1:]])
    return f"left({sentence}, 12 - w) || lpad(to_base({row}, 36), w, '0')"


_PART_WIDTH = f"(SELECT CASE WHEN {_N_PARTS} <= 36 THEN 1 WHEN {_N_PARTS} <= 1296 THEN 2 WHEN {_N_PARTS} <= 46656 THEN 3 ELSE 4 END AS w)"


@query(
    "gen_fk_chain",
    f"""SELECT row_id, {_root_code('root')} AS code FROM (
          SELECT row_id, {sql_permute('middle', _N_PARTS, _N_CUSTOMERS, salt('middles', 'code'))} AS root FROM (
            SELECT event_id AS row_id, {sql_draw(SEED, 'leaves', 'code', 'event_id', _N_CUSTOMERS, 'parent')} AS middle FROM events)), {_PART_WIDTH}""",
)
def gen_fk_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves reference middles, which reference roots, all through unique text columns."""
    code = Column("code", VARCHAR(12), nullable=False)
    unique = Column("code", VARCHAR(12), nullable=False, unique=True)
    tables = (
        Table("leaves", (code,), foreign_keys=(ForeignKey(("code",), "middles", ("code",)),)),
        Table("middles", (unique,), foreign_keys=(ForeignKey(("code",), "roots", ("code",)),)),
        Table("roots", (unique,)),
    )
    scaffolds = {
        "leaves": ids(spark, sf_dir, "events", "event_id"),
        "middles": ids(spark, sf_dir, "customer", "c_custkey"),
        "roots": ids(spark, sf_dir, "part", "p_partkey"),
    }
    return built(spark, tables, scaffolds)


@query(
    "gen_fk_cycle",
    f"""SELECT o_orderkey AS row_id, o_orderkey + 1 AS employee_id, CASE WHEN NOT {sql_draw(SEED, 'employees', 'department_id', 'o_orderkey', 1000000, 'null')} < 100000
          THEN 1 + {sql_draw(SEED, 'employees', 'department_id', 'o_orderkey', _N_CUSTOMERS, 'parent')} END AS department_id,
          1 + {sql_draw(SEED, 'departments', 'manager_id', 'o_orderkey % ' + _N_CUSTOMERS, _N_ORDERS, 'parent')} AS manager_of_row
        FROM orders""",
)
def gen_fk_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employees belong to departments, departments have an employee as manager."""
    tables = (
        Table(
            "employees",
            (Column("employee_id", INT), Column("department_id", INT)),
            ("employee_id",),
            foreign_keys=(ForeignKey(("department_id",), "departments", ("department_id",)),),
        ),
        Table(
            "departments",
            (Column("department_id", INT), Column("manager_id", INT)),
            ("department_id",),
            foreign_keys=(ForeignKey(("manager_id",), "employees", ("employee_id",)),),
        ),
    )
    plan = Plan(
        (
            TablePlan("employees", None, (ColumnPlan("department_id", nullable_probability=0.1),)),
            TablePlan("departments", None, (ColumnPlan("manager_id"),)),
        )
    )
    scaffolds = {"employees": ids(spark, sf_dir, "orders", "o_orderkey"), "departments": ids(spark, sf_dir, "customer", "c_custkey")}
    rows = {name: df.count() for name, df in scaffolds.items()}
    generator = Generator(spark, DatasetSpec(tables), plan, rows, SEED, scaffolds=scaffolds, hash_method="md5")
    generator.build()
    employees = generator.frame("employees", keep_row_id=True)
    departments = generator.frame("departments", keep_row_id=True)
    managers = departments.selectExpr(f"{ROW} AS _d", "manager_id AS manager_of_row")
    return employees.withColumn("_d", F.col(ROW) % rows["departments"]).join(managers, "_d").drop("_d")


@query(
    "gen_fk_self",
    f"""SELECT event_id AS row_id, event_id + 1 AS staff_id, CASE WHEN NOT {sql_draw(SEED, 'staff', 'manager_id', 'event_id', 1000000, 'null')} < 250000
          THEN 1 + {sql_draw(SEED, 'staff', 'manager_id', 'event_id', EVENT_COUNT, 'parent')} END AS manager_id FROM events""",
)
def gen_fk_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    fk = ForeignKey(("manager_id",), "staff", ("staff_id",))
    table = Table("staff", (Column("staff_id", INT), Column("manager_id", INT)), ("staff_id",), foreign_keys=(fk,))
    scaffolds = {"staff": ids(spark, sf_dir, "events", "event_id")}
    return built(spark, table, scaffolds, (ColumnPlan("manager_id", nullable_probability=0.25),))


# --- ordered columns and whole datasets --------------------------------------


@query(
    "gen_ordered_columns",
    f"""SELECT r AS row_id, DATE '1970-01-01' + CAST(a AS INTEGER) AS arrival, DATE '1970-01-01' + CAST(d AS INTEGER) AS departure, lo AS low_mark, mid AS mid_mark, hi AS high_mark
        FROM (SELECT *, mid + {sql_draw(SEED, 't', 'high_mark', 'r', '100 - mid + 1')} AS hi,
                     greatest(19724, a + 1) + {sql_draw(SEED, 't', 'departure', 'r', '20088 - greatest(19724, a + 1) + 1')} AS d
              FROM (SELECT *, greatest(0, coalesce(lo, 0)) + {sql_draw(SEED, 't', 'mid_mark', 'r', '100 - greatest(0, coalesce(lo, 0)) + 1')} AS mid
                    FROM (SELECT event_id AS r, 19723 + {sql_draw(SEED, 't', 'arrival', 'event_id', 365)} AS a,
                                 CASE WHEN NOT {sql_draw(SEED, 't', 'low_mark', 'event_id', 1000000, 'null')} < 200000
                                      THEN {sql_draw(SEED, 't', 'low_mark', 'event_id', 101)} END AS lo FROM events)))""",
)
def gen_ordered_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (
        Column("arrival", DATE, nullable=False, checks=(cmp(col("arrival"), ">=", "2024-01-01"),)),
        Column("departure", DATE, nullable=False, checks=(cmp(col("departure"), "<=", "2024-12-31"),)),
        Column("low_mark", INT),
        Column("mid_mark", INT),
        Column("high_mark", INT, checks=(cmp(col("high_mark"), "<=", 100),)),
    )
    checks = (
        cmp(col("arrival"), "<", col("departure")),
        cmp(col("mid_mark"), "<=", col("high_mark")),
        cmp(col("mid_mark"), ">=", col("low_mark")),
    )
    return over_events(spark, sf_dir, columns, (ColumnPlan("low_mark", nullable_probability=0.2),), checks)


SHOP = DatasetSpec(
    (
        Table("customer", (Column("c_custkey", INT),), ("c_custkey",)),
        Table(
            "accounts",
            (
                Column("account_id", INT),
                Column("owner", INT, nullable=False),
                Column("email", VARCHAR(255), unique=True, nullable=False),
                Column("first_name", VARCHAR(50), nullable=False),
                Column("tier", ENUM("basic", "gold"), default="'basic'"),
                Column("opened", DATE, nullable=False),
                Column("closed", DATE),
                Column("balance", DECIMAL(10, 2), checks=(between(col("balance"), -500, 5000),)),
            ),
            ("account_id",),
            foreign_keys=(ForeignKey(("owner",), "customer", ("c_custkey",)),),
            checks=(cmp(col("opened"), "<=", col("closed")),),
        ),
        Table(
            "payments",
            (
                Column("account_id", INT),
                Column("number", INT),
                Column("amount", DECIMAL(10, 2), nullable=False),
                Column("paid_at", DATETIME, default="CURRENT_TIMESTAMP"),
                Column("method", ENUM("card", "cash", "transfer"), nullable=False),
                Column("note", VARCHAR(60)),
            ),
            ("account_id", "number"),
            foreign_keys=(ForeignKey(("account_id",), "accounts", ("account_id",)),),
        ),
    )
)


def shop(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Accounts of the given customers, as many as orders; payments, as many as line items."""
    rows = {"accounts": load(spark, sf_dir, "orders").count(), "payments": load(spark, sf_dir, "lineitem").count()}
    existing = {"customer": load(spark, sf_dir, "customer").select("c_custkey")}
    data = generate(spark, SHOP, rows=rows, seed=SEED, existing=existing, check=False)
    own = [t for t in data if t not in existing]
    checkpoint_dir(spark)
    return {**data, **dict(zip(own, at_once(lambda t: written(data[t]), own)))}


@query(
    "gen_dataset_valid",
    """SELECT 'customer' AS table_name, count(*) AS n_rows, CAST(0 AS BIGINT) AS violations FROM customer
       UNION ALL SELECT 'accounts', count(*), 0 FROM orders UNION ALL SELECT 'payments', count(*), 0 FROM lineitem""",
)
def gen_dataset_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = shop(spark, sf_dir)
    counts = None
    for table, df in data.items():
        part = df.agg(F.lit(table).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
        counts = part if counts is None else counts.union(part)
    found = validate(spark, SHOP, data).groupBy("table_name").agg(F.count(F.lit(1)).alias("violations"))
    return counts.join(found, "table_name", "left").fillna(0, ["violations"])
