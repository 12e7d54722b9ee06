"""Profiles of any type, SQL text as checks, and scopes of intermediate tables."""

import os
from datetime import date, datetime
from decimal import Decimal

import pytest
from rowsmith.functions.checks import SqlCheck, and_, between, cmp, col, in_, or_
from rowsmith.operators import shared
from rowsmith.operators import validate as v
from rowsmith.operators.profile import bounds_profile
from rowsmith.spec import BOOLEAN, DATE, DATETIME, DECIMAL, INT, VARCHAR, Column, Table

MIXED = Table(
    "mixed",
    (
        Column("n", INT, checks=(cmp(col("n"), ">", 1),)),
        Column("d", DECIMAL(20, 10), checks=(between(col("d"), Decimal("0.0000000002"), 5),)),
        Column("day", DATE, checks=(cmp(col("day"), "<", date(2024, 1, 3)),)),
        Column("at", DATETIME),
        Column("word", VARCHAR(9), checks=(in_(col("word"), "a", None),)),
        Column("flag", BOOLEAN),
    ),
    ("n",),
)


def test_profile_of_all_families(spark):
    rows = [
        (1, Decimal("0.0000000001"), date(2024, 1, 1), datetime(2024, 1, 1, 5), "a", True),
        (2, Decimal("0.0000000002"), date(2024, 1, 5), datetime(2023, 1, 1), "Z", None),
        (2, Decimal("12345.0000000001"), None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "n long, d decimal(20,10), day date, at timestamp_ntz, word string, flag boolean")
    got = {r["column_name"]: tuple(r)[1:] for r in bounds_profile(MIXED, df).collect()}
    assert got == {
        "n": ("1", "2", 2, 0, 1),
        "d": ("0.0000000001", "12345.0000000001", 3, 0, 2),
        "day": ("2024-01-01", "2024-01-05", 2, 1, 1),
        "at": ("2023-01-01 00:00:00", "2024-01-01 05:00:00", 2, 1, 0),
        "word": ("Z", "a", 2, 1, 1),
        "flag": ("true", "true", 1, 2, 0),
    }
    plan = bounds_profile(MIXED, df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1
    empty = {r["column_name"]: (r["low"], r["distinct_values"], r["outside"]) for r in bounds_profile(MIXED, df.limit(0), ["n", "word"]).collect()}
    assert empty == {"n": (None, 0, 0), "word": (None, 0, 0)}


@pytest.mark.parametrize(
    ("check", "failed", "unevaluable"),
    [
        (SqlCheck("10 / x > 5"), {"3"}, {"1"}),
        (SqlCheck("x * 9223372036854775807 > 0"), {"1"}, {"3"}),
        (SqlCheck("CAST(t AS INT) > 1"), {"3"}, {"1"}),
        (and_(SqlCheck("10 / x > 0"), cmp(col("x"), ">", 4)), {"1", "2"}, set()),
        (or_(SqlCheck("10 / x > 99"), cmp(col("x"), "=", 0)), {"2", "3"}, set()),
    ],
)
def test_text_that_fails_on_a_row_makes_the_check_unevaluable(spark, check, failed, unevaluable):
    table = Table("t", (Column("id", INT), Column("x", INT), Column("t", VARCHAR(9))), ("id",), checks=(check,))
    rows = [(1, 0, "word"), (2, 1, "7"), (3, 5, "0"), (4, None, None)]
    found = v.row_violations(table, spark.createDataFrame(rows, "id long, x long, t string")).collect()
    by_kind = {k: {r["row_key"] for r in found if r["kind"] == k} for k in ("check_failed", "check_unevaluable")}
    assert by_kind["check_unevaluable"] == unevaluable
    assert by_kind["check_failed"] == failed and len(found) == len(failed) + len(unevaluable)


def test_text_on_raw_rows_sees_declared_names_only(spark):
    """The rows' own columns may bear any name, also that of a declared column."""
    table = Table("t", (Column("id", INT), Column("x", INT), Column("raw", INT)), ("id",), checks=(SqlCheck("x + raw > 10"), SqlCheck("upper(x) IS NOT NULL")))
    rows = [(90, '{"id": 1, "X": 8, "raw": 3}'), (91, '{"id": 2, "x": 1, "raw": 3}'), (92, '{"id": 3, "x": "no", "raw": 3}'), (93, '{"id": 4, "raw": 3, "x": null}'), (94, "[]")]
    df = spark.createDataFrame(rows, "x long, raw string")
    found = v.raw_violations(table, df, "raw", ["x"]).where("kind LIKE 'check%'").collect()
    assert {(r["kind"], r["row_key"]) for r in found} == {("check_failed", "91"), ("check_unevaluable", "92"), ("check_failed", "93")}


def test_a_scope_takes_its_tables_along(spark):
    base = shared.checkpoint_dir(spark).removeprefix("file:")
    with shared.scope(spark) as folder:
        kept = shared.written(spark.range(5))
        also = shared.materialize(kept.selectExpr("id * 2 AS id"))
        assert also.count() == 5 and len(os.listdir(folder.removeprefix("file:"))) == 2
        with shared.scope(spark) as inner:
            shared.written(spark.range(3))
            assert inner != folder and len(os.listdir(inner.removeprefix("file:"))) == 1
        assert not os.path.exists(inner.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:")) and os.path.exists(base)
    assert shared.written(spark.range(2)).count() == 2
