"""Queries for row rules, keys, foreign keys and whole-dataset validation."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.functions.checks import (
    Node,
    Opaque,
    SqlCheck,
    and_,
    between,
    cmp,
    col,
    evaluate,
    in_,
    is_null,
    not_,
    or_,
    resolve,
)
from rowsmith.operators import validate as v
from rowsmith.operators.profile import bounds_profile
from rowsmith.plans import tpch
from rowsmith.plans.registry import query, sql_key, sql_repeats, sql_violation
from rowsmith.plans.tpch import SPEC, load
from rowsmith.spec import BOOLEAN, DATE, DATETIME, DECIMAL, INT, TEXT, VARCHAR, Column, DatasetSpec, ForeignKey, Table

SHOWN = ("kind", "table_name", "column_name", "row_key")


def shown(violations: DataFrame) -> DataFrame:
    return violations.select(*SHOWN)


def rows_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tpch.tables(spark, sf_dir)[name]


def of_kind(spark: SparkSession, sf_dir: str, name: str, kind: str) -> DataFrame:
    table = SPEC.table(name)
    return shown(v.row_violations(table, rows_of(spark, sf_dir, name), kinds=[kind]))


# --- predicates --------------------------------------------------------------


def failing(df: DataFrame, table: Table, check: Node, key: str) -> DataFrame:
    """The answer of a rule per row: 1 true, 0 false, NULL unknown."""
    node = resolve(check, {c.name.casefold(): c for c in table.columns})
    return df.selectExpr(key, f"CAST({evaluate(node).holds} AS INT) AS answer")


@query(
    "chk_comparison",
    """SELECT o_orderkey, CAST(CASE
         WHEN CAST(o_totalprice AS DECIMAL(12,2)) > 100000 AND o_orderdate >= TIMESTAMP '1996-01-01'
              AND o_custkey <> o_orderkey AND 5 < o_custkey THEN 1 ELSE 0 END AS INTEGER) AS answer FROM orders""",
)
def chk_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = and_(
        cmp(col("o_totalprice"), ">", 100_000),
        cmp(col("o_orderdate"), ">=", "1996-01-01"),
        cmp(col("o_custkey"), "<>", col("o_orderkey")),
        cmp(5, "<", col("o_custkey")),
    )
    return failing(rows_of(spark, sf_dir, "orders"), tpch.ORDERS, check, "o_orderkey")


_SIZES = Table("sizes", (Column("p_partkey", INT), Column("p_size", INT), Column("low", INT)), ("p_partkey",))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    return part.select("p_partkey", F.expr("nullif(p_size, 7)").alias("p_size"), F.expr("nullif(p_partkey % 10, 3)").alias("low"))


@query(
    "chk_between",
    """SELECT p_partkey, CAST(CASE WHEN s IS NULL OR low IS NULL THEN NULL WHEN s BETWEEN low AND 20 THEN 0 ELSE 1 END AS INTEGER) AS answer
       FROM (SELECT p_partkey, nullif(p_size, 7) AS s, nullif(p_partkey % 10, 3) AS low FROM part)""",
)
def chk_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = between(col("p_size"), col("low"), 20, negated=True)
    return failing(sizes(spark, sf_dir), _SIZES, check, "p_partkey")


@query(
    "chk_in_list",
    """SELECT p_partkey, CAST(CASE WHEN s IS NULL THEN NULL WHEN s IN (1, 2, 30) OR coalesce(s = low, FALSE) THEN 0 ELSE 1 END AS INTEGER) AS answer
       FROM (SELECT p_partkey, nullif(p_size, 7) AS s, nullif(p_partkey % 10, 3) AS low FROM part)""",
)
def chk_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = in_(col("p_size"), 1, 2, 30, None, col("low"), negated=True)
    return failing(sizes(spark, sf_dir), _SIZES, check, "p_partkey")


@query(
    "chk_is_null",
    """SELECT p_partkey, CAST(CASE WHEN nullif(p_size, 7) IS NULL AND nullif(p_partkey % 10, 3) IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS answer FROM part""",
)
def chk_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = and_(is_null(col("p_size")), is_null(col("low"), negated=True))
    return failing(sizes(spark, sf_dir), _SIZES, check, "p_partkey")


@query(
    "chk_three_valued",
    """SELECT p_partkey, CAST(CASE WHEN r IS NULL THEN NULL WHEN r THEN 1 ELSE 0 END AS INTEGER) AS answer
       FROM (SELECT p_partkey, (s > 10 AND low < 5) OR NOT (s < 30) AS r
             FROM (SELECT p_partkey, nullif(p_size, 7) AS s, nullif(p_partkey % 10, 3) AS low FROM part))""",
)
def chk_three_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = or_(and_(cmp(col("p_size"), ">", 10), cmp(col("low"), "<", 5)), not_(cmp(col("p_size"), "<", 30)))
    return failing(sizes(spark, sf_dir), _SIZES, check, "p_partkey")


# Events as JSON text whose members are sometimes wrong, by rule.
RAW_SQL = """(SELECT event_id, event_type, user_id, value,
  CASE event_type
    WHEN 'view' THEN CASE WHEN user_id % 2 = 0 THEN '[1, 2]' ELSE '"text"' END
    ELSE '{"EVENT_ID": ' || CAST(event_id AS VARCHAR)
      || CASE WHEN event_type = 'signup' THEN '' ELSE ', "User_Id": ' || CASE WHEN user_id % 3 = 0 THEN '"u' || CAST(user_id AS VARCHAR) || '"' ELSE CAST(user_id AS VARCHAR) END END
      || ', "day": ' || CASE WHEN user_id % 4 = 0 THEN '"2024-1-5"' WHEN user_id % 4 = 1 THEN 'null' ELSE '"2024-01-05"' END
      || ', "active": ' || CASE WHEN user_id % 5 = 0 THEN '1' ELSE 'true' END
      || CASE WHEN event_type = 'error' THEN ', "extra": 1' ELSE '' END || '}'
  END AS raw FROM events)"""

RAW_TABLE = Table(
    "raw_events",
    (
        Column("event_id", INT),
        Column("user_id", INT, nullable=False),
        Column("day", DATE),
        Column("active", BOOLEAN),
        Column("score", INT, default="0", nullable=False),
    ),
    ("event_id",),
    checks=(
        or_(cmp(col("user_id"), ">", 100), cmp(col("day"), "<", "2020-01-01")),
        between(col("user_id"), 10, 60),
    ),
)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    user_id = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit('"u'), user, F.lit('"'))).otherwise(user)
    day = (
        F.when(F.col("user_id") % 4 == 0, '"2024-1-5"').when(F.col("user_id") % 4 == 1, "null").otherwise('"2024-01-05"')
    )
    body = F.concat(
        F.lit('{"EVENT_ID": '),
        F.col("event_id").cast("string"),
        F.when(F.col("event_type") == "signup", "").otherwise(F.concat(F.lit(', "User_Id": '), user_id)),
        F.lit(', "day": '),
        day,
        F.lit(', "active": '),
        F.when(F.col("user_id") % 5 == 0, "1").otherwise("true"),
        F.when(F.col("event_type") == "error", ', "extra": 1').otherwise(""),
        F.lit("}"),
    )
    shape = F.when(F.col("user_id") % 2 == 0, "[1, 2]").otherwise('"text"')
    raw = F.when(F.col("event_type") == "view", shape).otherwise(body)
    return load(spark, sf_dir, "events").select("event_id", raw.alias("raw"))


def raw_of_kind(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    found = v.raw_violations(RAW_TABLE, raw_events(spark, sf_dir), "raw", ["event_id"])
    return found.where(F.col("kind").isin(*kinds)).select(*SHOWN)


_ID = "CAST(event_id AS VARCHAR)"


@query("val_row_shape", sql_violation("row_shape", "raw_events", None, _ID, "events", "event_type = 'view'"))
def val_row_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_of_kind(spark, sf_dir, "row_shape")


@query("val_unknown_column", sql_violation("unknown_column", "raw_events", "extra", _ID, "events", "event_type = 'error'"))
def val_unknown_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_of_kind(spark, sf_dir, "unknown_column")


@query("val_missing_column", sql_violation("missing_column", "raw_events", "user_id", _ID, "events", "event_type = 'signup'"))
def val_missing_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_of_kind(spark, sf_dir, "missing_column")


_MISTYPED = [
    sql_violation("type_mismatch", "raw_events", "user_id", _ID, "events", "event_type NOT IN ('view', 'signup') AND user_id % 3 = 0"),
    sql_violation("type_mismatch", "raw_events", "day", _ID, "events", "event_type <> 'view' AND user_id % 4 = 0"),
    sql_violation("type_mismatch", "raw_events", "active", _ID, "events", "event_type <> 'view' AND user_id % 5 = 0"),
]


@query("val_type_mismatch_raw", " UNION ALL ".join(_MISTYPED))
def val_type_mismatch_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_of_kind(spark, sf_dir, "type_mismatch")


# user_id: unknown when absent, incomparable when it is not a number.
# day: unknown when null, incomparable when badly formed.
_CHECKED = """(SELECT event_id,
   CASE WHEN event_type = 'signup' THEN 'unknown' WHEN user_id % 3 = 0 THEN 'bad' WHEN user_id > 100 THEN 'true' ELSE 'false' END AS a,
   CASE WHEN user_id % 4 = 1 THEN 'unknown' WHEN user_id % 4 = 0 THEN 'bad' ELSE 'false' END AS b,
   CASE WHEN event_type = 'signup' THEN 'unknown' WHEN user_id % 3 = 0 THEN 'bad' WHEN user_id BETWEEN 10 AND 60 THEN 'true' ELSE 'false' END AS c
   FROM events WHERE event_type <> 'view')"""
_EVALUATED = [
    sql_violation("check_failed", "raw_events", None, _ID, _CHECKED, "a = 'false' AND b = 'false'"),
    sql_violation("check_unevaluable", "raw_events", None, _ID, _CHECKED, "a <> 'true' AND (a = 'bad' OR b = 'bad')"),
    sql_violation("check_failed", "raw_events", None, _ID, _CHECKED, "c = 'false'"),
    sql_violation("check_unevaluable", "raw_events", None, _ID, _CHECKED, "c = 'bad'"),
]


@query("chk_unevaluable", " UNION ALL ".join(_EVALUATED))
def chk_unevaluable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_of_kind(spark, sf_dir, "check_failed", "check_unevaluable")


_PROFILED = replace(
    tpch.LINEITEM,
    columns=tuple(
        replace(c, checks=(*c.checks, between(col(c.name), 2, 900), cmp(col(c.name), ">", 5))) if c.name in ("l_partkey", "l_rebate") else c
        for c in tpch.LINEITEM.columns
    ),
)


def _sql_profile(column: str, value: str, outside: str, source: str) -> str:
    return (
        f"SELECT '{column}' AS column_name, CAST(min({value}) AS VARCHAR) AS low, CAST(max({value}) AS VARCHAR) AS high, "
        f"count(DISTINCT {value}) AS distinct_values, count(*) FILTER (WHERE {value} IS NULL) AS n_nulls, "
        f"count(*) FILTER (WHERE {outside}) AS outside FROM {source}"
    )


_REBATES = "(SELECT CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS r FROM lineitem)"


@query(
    "chk_bounds_profile",
    _sql_profile("l_partkey", "l_partkey", "l_partkey <= 5 OR l_partkey > 900", "lineitem")
    + " UNION ALL "
    + _sql_profile("l_rebate", "r", "r <= 5 OR r > 900", _REBATES),
)
def chk_bounds_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds_profile(_PROFILED, rows_of(spark, sf_dir, "lineitem"), ["l_partkey", "l_rebate"])


_FAMILIES = Table(
    "events",
    (
        Column("event_id", INT, checks=(cmp(col("event_id"), ">=", 10),)),
        Column("ts", DATETIME, checks=(cmp(col("ts"), "<", datetime(2024, 1, 20, 12)),)),
        Column("day", DATE, checks=(between(col("day"), date(2024, 1, 3), date(2024, 1, 28)),)),
        Column("event_type", VARCHAR(20), checks=(in_(col("event_type"), "view", "click", None),)),
        Column("share", DECIMAL(20, 10), checks=(cmp(col("share"), ">", Decimal("3.1234567891")),)),
        Column("note", TEXT),
    ),
)
_FAMILY_ROWS = """(SELECT event_id, ts, CAST(ts AS DATE) AS day, nullif(event_type, 'error') AS event_type,
   CAST(value AS DECIMAL(10,2)) * CAST(1.00000003 AS DECIMAL(9,8)) AS share FROM events)"""


@query(
    "chk_bounds_families",
    " UNION ALL ".join(
        [
            _sql_profile("event_id", "event_id", "event_id < 10", _FAMILY_ROWS),
            _sql_profile("ts", "ts", "ts >= TIMESTAMP '2024-01-20 12:00:00'", _FAMILY_ROWS),
            _sql_profile("day", "day", "day NOT BETWEEN DATE '2024-01-03' AND DATE '2024-01-28'", _FAMILY_ROWS),
            _sql_profile("event_type", "event_type", "event_type NOT IN ('view', 'click')", _FAMILY_ROWS),
            _sql_profile("share", "share", "share <= 3.1234567891", _FAMILY_ROWS),
        ]
    ),
)
def chk_bounds_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, times, dates and texts of one table, profiled together."""
    share = tpch.dec("value", 10) * F.lit(Decimal("1.00000003"))
    rows = load(spark, sf_dir, "events").select(
        "event_id", "ts", F.to_date("ts").alias("day"), F.nullif("event_type", F.lit("error")).alias("event_type"), share.cast("decimal(20,10)").alias("share")
    )
    return bounds_profile(_FAMILIES, rows)


_TEXT_CHECKS = (SqlCheck("1000 / (o_custkey % 5) >= 300"), SqlCheck("o_orderkey * 9223372036854775807 > 0"))


@query(
    "chk_sql_runtime",
    " UNION ALL ".join(
        [
            sql_violation("check_unevaluable", "orders", None, sql_key("o_orderkey"), "orders", "o_custkey % 5 = 0"),
            sql_violation("check_failed", "orders", None, sql_key("o_orderkey"), "orders", "o_custkey % 5 > 0 AND 1000 < 300 * (o_custkey % 5)"),
            sql_violation("check_unevaluable", "orders", None, sql_key("o_orderkey"), "orders", "o_orderkey > 1"),
            sql_violation("check_failed", "orders", None, sql_key("o_orderkey"), "orders", "o_orderkey = 0"),
        ]
    ),
)
def chk_sql_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions as SQL text whose arithmetic fails on some rows."""
    table = replace(tpch.ORDERS, columns=tuple(replace(c, checks=()) for c in tpch.ORDERS.columns), checks=_TEXT_CHECKS)
    return shown(v.row_violations(table, load(spark, sf_dir, "orders"), kinds=["check_failed", "check_unevaluable"]))


_RAW_TEXT_TABLE = replace(RAW_TABLE, checks=(SqlCheck("60 / (user_id - 7) < 5 OR day IS NULL"), SqlCheck("user_id % 4 <> 1")))
# The first check names both columns, so a badly formed value in either makes it unevaluable unless day is null.
_RAW_TEXT = """(SELECT event_id, event_type <> 'signup' AND user_id % 3 = 0 AS bad_user, user_id % 4 = 0 AS bad_day, user_id % 4 = 1 AS no_day,
   CASE WHEN event_type <> 'signup' THEN user_id END AS u FROM events WHERE event_type <> 'view')"""


@query(
    "chk_sql_raw",
    " UNION ALL ".join(
        [
            sql_violation("check_unevaluable", "raw_events", None, _ID, _RAW_TEXT, "bad_user OR bad_day OR u = 7"),
            sql_violation(
                "check_failed", "raw_events", None, _ID, _RAW_TEXT, "NOT bad_user AND NOT bad_day AND NOT no_day AND u > 7 AND 60 >= 5 * (u - 7)"
            ),
            sql_violation("check_unevaluable", "raw_events", None, _ID, _RAW_TEXT, "bad_user"),
            sql_violation("check_failed", "raw_events", None, _ID, _RAW_TEXT, "NOT bad_user AND u % 4 = 1"),
        ]
    ),
)
def chk_sql_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions as SQL text over rows that arrive as JSON."""
    found = v.raw_violations(_RAW_TEXT_TABLE, raw_events(spark, sf_dir), "raw", ["event_id"])
    return shown(found.where("kind IN ('check_failed', 'check_unevaluable')"))


@query(
    "chk_unsupported",
    sql_violation("unsupported_check", "orders", None, "CAST(NULL AS VARCHAR)", "(SELECT 1)")
    + " UNION ALL "
    + sql_violation("unsupported_check", "orders", "o_totalprice", "CAST(NULL AS VARCHAR)", "(SELECT 1)")
    + " UNION ALL "
    + sql_violation("check_failed", "orders", None, sql_key("o_orderkey"), "orders", "NOT (o_custkey + o_orderkey >= 900)"),
)
def chk_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = tuple(
        replace(c, checks=(cmp(col("o_totalprice"), ">", "cheap"),) if c.name == "o_totalprice" else ())
        for c in tpch.ORDERS.columns
    )
    table = replace(
        tpch.ORDERS,
        columns=priced,
        foreign_keys=(),
        checks=(Opaque("custom_rule(o_totalprice)"), SqlCheck("o_custkey + o_orderkey >= 900")),
    )
    spec = DatasetSpec((table,))
    orders = load(spark, sf_dir, "orders").withColumn("o_totalprice", tpch.dec("o_totalprice"))
    return shown(v.validate(spark, spec, {"orders": orders}))


# --- value rules -------------------------------------------------------------


@query(
    "val_table_presence",
    """SELECT 'unknown_table' AS kind, source AS table_name, CAST(NULL AS VARCHAR) AS column_name, CAST(NULL AS VARCHAR) AS row_key
       FROM (SELECT DISTINCT source FROM documents) WHERE lower(source) NOT IN ('src3', 'src5', 'src98', 'src99')
       UNION ALL
       SELECT 'missing_table', name, NULL, NULL FROM (VALUES ('SRC3'), ('src5'), ('Src98'), ('src99')) AS t(name)
       WHERE lower(name) NOT IN (SELECT lower(source) FROM documents)""",
)
def val_table_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir, "documents").select(F.col("source").alias("table_name")).distinct()
    spec = DatasetSpec(tuple(Table(n, (Column("id", INT),), ("id",)) for n in ("SRC3", "src5", "Src98", "src99")))
    return shown(v.table_presence(spark, spec, names))


@query("val_not_null", sql_violation("not_null", "orders", "o_orderstatus", sql_key("o_orderkey"), "orders", "o_orderstatus = 'P'"))
def val_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_kind(spark, sf_dir, "orders", "not_null")


@query(
    "val_type_mismatch",
    sql_violation("type_mismatch", "customer", "c_acctbal", sql_key("c_custkey"), "customer", "c_acctbal IS NOT NULL"),
)
def val_type_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(v.row_violations(tpch.CUSTOMER, load(spark, sf_dir, "customer"), kinds=["type_mismatch"]))


@query(
    "val_varchar_length",
    sql_violation("varchar_length", "documents", "text", sql_key("doc_id"), "documents", "length(text) > 2000"),
)
def val_varchar_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_kind(spark, sf_dir, "documents", "varchar_length")


REBATES = """(SELECT *, CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS rebate FROM lineitem)"""


@query(
    "val_decimal_precision",
    sql_violation(
        "decimal_precision", "lineitem", "l_rebate", sql_key("l_orderkey", "l_linenumber"), REBATES, "rebate <> round(rebate, 2) OR abs(rebate) >= 10000"
    ),
)
def val_decimal_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_kind(spark, sf_dir, "lineitem", "decimal_precision")


@query(
    "val_enum",
    sql_violation(
        "enum_value", "customer", "c_mktsegment", sql_key("c_custkey"), "customer", "c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE')"
    ),
)
def val_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_kind(spark, sf_dir, "customer", "enum_value")


@query(
    "val_check",
    sql_violation(
        "check_failed", "lineitem", "l_shipdate", sql_key("l_orderkey", "l_linenumber"), "lineitem", "NOT (l_shipdate < TIMESTAMP '2000-01-01')"
    ),
)
def val_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_kind(spark, sf_dir, "lineitem", "check_failed")


# --- keys --------------------------------------------------------------------


@query(
    "val_pk_null",
    sql_violation(
        "primary_key_null",
        "lineitem",
        None,
        sql_key("o", "n"),
        "(SELECT nullif(l_orderkey, 5) AS o, nullif(l_linenumber, 3) AS n FROM lineitem)",
        "o IS NULL OR n IS NULL",
    ),
)
def val_pk_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    holed = load(spark, sf_dir, "lineitem").select(
        F.expr("nullif(l_orderkey, 5)").alias("l_orderkey"), F.expr("nullif(l_linenumber, 3)").alias("l_linenumber")
    )
    return shown(v.primary_key_null(tpch.LINEITEM, holed, tpch.LINEITEM.primary_key))


@query(
    "val_pk_duplicate",
    sql_repeats("primary_key_duplicate", "lineitem", ("l_orderkey", "l_linenumber"), "l_partkey", sql_key("l_orderkey", "l_linenumber"), "lineitem").replace(
        "'l_orderkey' AS column_name", "CAST(NULL AS VARCHAR) AS column_name"
    ),
)
def val_pk_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(v.primary_key_duplicate(tpch.LINEITEM, load(spark, sf_dir, "lineitem")))


@query("val_unique_duplicate", sql_repeats("unique_duplicate", "documents", ("text",), "doc_id", sql_key("doc_id"), "documents"))
def val_unique_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(v.unique_duplicate(tpch.DOCUMENTS, load(spark, sf_dir, "documents"), ["text"]))


@query(
    "val_unique_tuple",
    sql_repeats(
        "unique_duplicate", "lineitem", ("l_partkey", "l_suppkey"), "l_orderkey, l_linenumber", sql_key("l_orderkey", "l_linenumber"),
        "(SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_suppkey, 7) AS l_suppkey FROM lineitem)",
    ),
)
def val_unique_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").withColumn("l_suppkey", F.expr("nullif(l_suppkey, 7)"))
    return shown(v.unique_duplicate(tpch.LINEITEM, rows, ["l_partkey", "l_suppkey"]))


# --- foreign keys ------------------------------------------------------------


@query(
    "val_fk_missing",
    sql_violation(
        "foreign_key_missing", "documents", "doc_id", sql_key("doc_id"), "documents", "doc_id NOT IN (SELECT doc_id FROM labels)"
    ),
)
def val_fk_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = tpch.DOCUMENTS
    documents, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return shown(v.foreign_key_missing(table, documents, table.foreign_keys[0], labels))


@query(
    "val_fk_large",
    sql_violation(
        "foreign_key_missing",
        "lineitem",
        "l_orderkey",
        sql_key("l_orderkey", "l_linenumber"),
        "lineitem",
        "NOT EXISTS (SELECT 1 FROM events WHERE event_id = l_orderkey)",
    ),
)
def val_fk_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large parent that lacks some of the keys that its child names."""
    reference = ForeignKey(("l_orderkey",), "events", ("event_id",))
    return shown(v.foreign_key_missing(tpch.LINEITEM, load(spark, sf_dir, "lineitem"), reference, load(spark, sf_dir, "events")))


@query(
    "val_fk_composite",
    sql_violation(
        "foreign_key_missing",
        "turns",
        None,
        sql_key("conv_id", "turn"),
        "(SELECT conv_id, turn, nullif(turn + 1, 4) AS next_turn FROM conversations) AS c",
        "next_turn IS NOT NULL AND NOT EXISTS (SELECT 1 FROM conversations AS p WHERE p.conv_id = c.conv_id AND p.turn = c.next_turn)",
    ),
)
def val_fk_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Table(
        "turns",
        (Column("conv_id", INT), Column("turn", INT), Column("next_turn", INT)),
        ("conv_id", "turn"),
        foreign_keys=(ForeignKey(("conv_id", "next_turn"), "turns", ("conv_id", "turn")),),
    )
    table = DatasetSpec((table,)).table("turns")
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr("nullif(turn + 1, 4)").alias("next_turn"))
    return shown(v.foreign_key_missing(table, turns, table.foreign_keys[0], turns))


@query(
    "val_fk_cycle",
    sql_violation(
        "foreign_key_missing", "customer", "best_order", sql_key("c_custkey"), "customer", "c_custkey * 11 NOT IN (SELECT o_orderkey FROM orders)"
    )
    + " UNION ALL "
    + sql_violation(
        "foreign_key_missing", "orders", "o_custkey", sql_key("o_orderkey"), "orders", "o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)"
    ),
)
def val_fk_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = DatasetSpec(
        (
            Table(
                "customer",
                (Column("c_custkey", INT), Column("best_order", INT)),
                ("c_custkey",),
                foreign_keys=(ForeignKey(("best_order",), "orders", ("o_orderkey",)),),
            ),
            Table(
                "orders",
                (Column("o_orderkey", INT), Column("o_custkey", INT, nullable=False)),
                ("o_orderkey",),
                foreign_keys=(ForeignKey(("o_custkey",), "customer", ("c_custkey",)),),
            ),
        )
    )
    data = {
        "customer": load(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 11).alias("best_order")),
        "orders": load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("o_custkey")),
    }
    return shown(v.validate(spark, spec, data))


# --- whole dataset -----------------------------------------------------------


def _dataset_sql() -> str:
    def missing(table: str, column: str, key: str, parent: str, target: str) -> str:
        return sql_violation("foreign_key_missing", table, column, key, table, f"{column} NOT IN (SELECT {target} FROM {parent})")

    line = sql_key("l_orderkey", "l_linenumber")
    turn = sql_key("conv_id", "turn")
    money = "CAST(c_acctbal AS DECIMAL(10,2))"
    repeats = sql_repeats("primary_key_duplicate", "lineitem", ("l_orderkey", "l_linenumber"), "l_partkey", line, "lineitem")
    parts = [
        sql_violation("check_failed", "customer", "c_acctbal", sql_key("c_custkey"), "customer", f"{money} < 0"),
        sql_violation("decimal_precision", "customer", "c_acctbal", sql_key("c_custkey"), "customer", f"abs({money}) >= 1000000"),
        sql_violation("varchar_length", "customer", "c_name", sql_key("c_custkey"), "customer", "length(c_name) > 18"),
        sql_violation("enum_value", "customer", "c_mktsegment", sql_key("c_custkey"), "customer", "c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE')"),
        sql_violation("check_failed", "part", "p_size", sql_key("p_partkey"), "part", "p_size NOT BETWEEN 1 AND 40"),
        sql_violation("varchar_length", "part", "p_name", sql_key("p_partkey"), "part", "length(p_name) > 10"),
        sql_violation("not_null", "orders", "o_orderstatus", sql_key("o_orderkey"), "orders", "o_orderstatus = 'P'"),
        sql_violation("check_failed", "orders", "o_orderpriority", sql_key("o_orderkey"), "orders", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')"),
        sql_violation("decimal_precision", "lineitem", "l_rebate", line, REBATES, "rebate <> round(rebate, 2) OR abs(rebate) >= 10000"),
        sql_violation("check_failed", "lineitem", "l_shipdate", line, "lineitem", "NOT (l_shipdate < TIMESTAMP '2000-01-01')"),
        repeats.replace("'l_orderkey' AS column_name", "CAST(NULL AS VARCHAR) AS column_name"),
        sql_violation("enum_value", "events", "event_type", sql_key("event_id"), "events", "event_type NOT IN ('click', 'view', 'purchase')"),
        sql_violation("varchar_length", "documents", "text", sql_key("doc_id"), "documents", "length(text) > 2000"),
        sql_repeats("unique_duplicate", "documents", ("text",), "doc_id", sql_key("doc_id"), "documents"),
        sql_violation("check_failed", "labels", None, sql_key("doc_id"), "labels", "NOT (quality = 1 OR toxic = 0)"),
        sql_repeats("unique_duplicate", "pages", ("url",), "page_id", sql_key("page_id"), "pages"),
        sql_violation("varchar_length", "pages", "url", sql_key("page_id"), "pages", "length(url) > 500"),
        sql_violation("enum_value", "conversations", "role", turn, "conversations", "role NOT IN ('user', 'assistant')"),
        missing("nation", "n_regionkey", sql_key("n_nationkey"), "region", "r_regionkey"),
        missing("customer", "c_nationkey", sql_key("c_custkey"), "nation", "n_nationkey"),
        missing("supplier", "s_nationkey", sql_key("s_suppkey"), "nation", "n_nationkey"),
        missing("orders", "o_custkey", sql_key("o_orderkey"), "customer", "c_custkey"),
        missing("lineitem", "l_orderkey", line, "orders", "o_orderkey"),
        missing("lineitem", "l_partkey", line, "part", "p_partkey"),
        missing("lineitem", "l_suppkey", line, "supplier", "s_suppkey"),
        missing("events", "user_id", sql_key("event_id"), "customer", "c_custkey"),
        missing("documents", "doc_id", sql_key("doc_id"), "labels", "doc_id"),
        missing("labels", "doc_id", sql_key("doc_id"), "documents", "doc_id"),
    ]
    return " UNION ALL ".join(parts)


@query("validate_dataset", _dataset_sql())
def validate_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(v.validate(spark, SPEC, tpch.tables(spark, sf_dir)))


@query(
    "val_summary",
    f"""WITH found AS ({_dataset_sql()}),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY kind, table_name, column_name ORDER BY row_key) AS rn FROM found)
        SELECT kind, table_name, column_name, count(*) AS violations,
               string_agg(row_key, ',' ORDER BY row_key) FILTER (WHERE rn <= 3) AS samples
        FROM ranked GROUP BY kind, table_name, column_name""",
)
def val_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.summarize(v.validate(spark, SPEC, tpch.tables(spark, sf_dir)))


@query(
    "cap_unique_domain",
    """SELECT 'orders(o_orderstatus, o_orderpriority)' AS unique_group, CAST(count(DISTINCT o_orderstatus) * count(DISTINCT o_orderpriority) AS BIGINT) AS capacity,
              count(*) AS n_rows, count(DISTINCT o_orderstatus) * count(DISTINCT o_orderpriority) >= count(*) AS fits FROM orders
       UNION ALL
       SELECT 'conversations(conv_id, turn)', CAST(count(DISTINCT conv_id) * count(DISTINCT turn) AS BIGINT), count(*),
              count(DISTINCT conv_id) * count(DISTINCT turn) >= count(*) FROM conversations""",
)
def cap_unique_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = v.unique_capacity(load(spark, sf_dir, "orders"), "orders", ["o_orderstatus", "o_orderpriority"])
    turns = v.unique_capacity(load(spark, sf_dir, "conversations"), "conversations", ["conv_id", "turn"])
    return orders.unionByName(turns)
