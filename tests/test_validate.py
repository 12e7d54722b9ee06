"""One broken row per kind of violation, and rules about NULL."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from fixtures import MAIN
from pyspark.sql import functions as F
from rowsmith.functions.checks import Opaque, SqlCheck, between, cmp, col, in_, is_null, not_, or_
from rowsmith.operators import validate as v
from rowsmith.spec import DATE, DATETIME, DECIMAL, INT, VARCHAR, Column, DatasetSpec, ForeignKey, SpecError, Table

CUSTOMER_DDL = (
    "customer_id bigint, email string, nickname string, tier string, balance decimal(12,4), joined_on date, created_at timestamp_ntz, active boolean"
)
GOOD = (1, "a@b.c", "al", "gold", Decimal("10.50"), date(2024, 1, 1), datetime(2024, 1, 1, 8), True)


def customers(spark, *rows, ddl=CUSTOMER_DDL):
    return spark.createDataFrame(list(rows), ddl)


def reviews(spark, *rows):
    return spark.createDataFrame(list(rows), "review_id bigint, customer_id bigint, rating int")


def found(spark, spec, data, **options):
    rows = v.validate(spark, spec, data, **options).collect()
    return sorted((r["kind"], r["table_name"], r["column_name"], r["row_key"]) for r in rows)


def change(**fields):
    names = [part.split()[0] for part in CUSTOMER_DDL.split(", ")]
    return tuple(fields.get(n, g) for n, g in zip(names, GOOD))


def main_data(spark, *customer_rows, review_rows=((1, 1, 5),)):
    return {"customers": customers(spark, *customer_rows), "Reviews": reviews(spark, *review_rows)}


def test_valid_dataset_has_no_violations(spark):
    assert found(spark, MAIN, main_data(spark, GOOD)) == []
    v.assert_valid(spark, MAIN, main_data(spark, GOOD))


@pytest.mark.parametrize(
    "fields, kind, column",
    [
        ({"tier": None}, "not_null", "tier"),
        ({"nickname": "x" * 11}, "varchar_length", "nickname"),
        ({"nickname": "\U0001f600" * 11}, "varchar_length", "nickname"),
        ({"balance": Decimal("1.2345")}, "decimal_precision", "balance"),
        ({"balance": Decimal("1000")}, "decimal_precision", "balance"),
        ({"tier": "silver"}, "enum_value", "tier"),
    ],
)
def test_value_kinds(spark, fields, kind, column):
    data = main_data(spark, change(**fields))
    assert found(spark, MAIN, data) == [(kind, "Customers", column, "1")]


def test_text_at_its_length_and_decimal_by_value_pass(spark):
    assert found(spark, MAIN, main_data(spark, change(nickname="\U0001f600" * 10, balance=Decimal("1.5000")))) == []


def test_mistyped_column_is_reported_once_per_row(spark):
    rows = spark.createDataFrame([(1, 1, "five"), (2, 1, None)], "review_id bigint, customer_id bigint, rating string")
    kinds = found(spark, MAIN, {"Customers": customers(spark, GOOD), "Reviews": rows})
    # The text is no number, so both rating checks cannot be evaluated; NULL only breaks NOT NULL.
    assert kinds == [
        ("check_unevaluable", "Reviews", "rating", "1"),
        ("check_unevaluable", "Reviews", "rating", "1"),
        ("not_null", "Reviews", "rating", "2"),
        ("type_mismatch", "Reviews", "rating", "1"),
    ]


def test_float_is_no_decimal_and_int_is_no_boolean(spark):
    rows = customers(spark, GOOD).withColumn("balance", F.lit(1.5)).withColumn("active", F.lit(1))
    kinds = {(k, c) for k, _, c, _ in found(spark, MAIN, {"Customers": rows, "Reviews": reviews(spark, (1, 1, 5))})}
    assert kinds == {("type_mismatch", "balance"), ("type_mismatch", "active")}


def test_unknown_and_missing_columns(spark):
    rows = customers(spark, GOOD).drop("tier", "active").withColumn("extra", F.lit(1))
    assert found(spark, MAIN, {"Customers": rows, "Reviews": reviews(spark, (1, 1, 5))}) == [
        ("missing_column", "Customers", "tier", "1"),
        ("unknown_column", "Customers", "extra", "1"),
    ]


def test_unknown_and_missing_tables(spark):
    data = {"customers": customers(spark, GOOD), "Other": customers(spark, GOOD)}
    assert found(spark, MAIN, data) == [("missing_table", "Reviews", None, None), ("unknown_table", "Other", None, None)]
    empty = {"customers": customers(spark), "reviews": reviews(spark)}
    assert found(spark, MAIN, empty) == []


def test_keys(spark):
    rows = [GOOD, change(email="b@b.c"), change(customer_id=None, email="c@b.c"), change(customer_id=2)]
    assert found(spark, MAIN, main_data(spark, *rows)) == [
        ("not_null", "Customers", "customer_id", "NULL"),
        ("primary_key_duplicate", "Customers", "customer_id", "1"),
        ("primary_key_null", "Customers", "customer_id", "NULL"),
        ("unique_duplicate", "Customers", "email", "2"),
    ]


def test_foreign_key_skips_null_and_missing_parent_table(spark):
    data = main_data(spark, GOOD, review_rows=((1, 1, 5), (2, None, 5), (3, 9, 5)))
    assert found(spark, MAIN, data) == [("foreign_key_missing", "Reviews", "customer_id", "3")]
    del data["customers"]
    assert found(spark, MAIN, data) == [("missing_table", "Customers", None, None)]


def test_foreign_key_of_another_type_never_matches(spark):
    rows = reviews(spark, (1, 1, 5)).withColumn("customer_id", F.col("customer_id").cast("string"))
    kinds = {k for k, *_ in found(spark, MAIN, {"Customers": customers(spark, GOOD), "Reviews": rows})}
    assert "foreign_key_missing" in kinds


MEMBERS = Table(
    "Memberships",
    (Column("tenant_id", INT), Column("user_id", INT), Column("email", VARCHAR(50)), Column("label", VARCHAR(50))),
    ("tenant_id", "user_id"),
    (("tenant_id", "email"),),
)


def test_composite_keys_and_null_tuples(spark):
    rows = spark.createDataFrame(
        [(1, 1, "a", "x"), (1, 2, "a", "x"), (1, 2, None, "x"), (1, 3, None, "x"), (2, 1, "a", "x"), (None, 4, "a", "x")],
        "tenant_id bigint, user_id bigint, email string, label string",
    )
    assert found(spark, DatasetSpec((MEMBERS,)), {"Memberships": rows}) == [
        ("not_null", "Memberships", "tenant_id", "NULL|4"),
        ("primary_key_duplicate", "Memberships", None, "1|2"),
        ("primary_key_null", "Memberships", None, "NULL|4"),
        ("unique_duplicate", "Memberships", None, "1|2"),
    ]


def check_kinds(spark, check, column, value, ddl):
    t = Table("t", (Column("id", INT), column), ("id",), checks=(check,))
    rows = spark.createDataFrame([(1, value)], f"id bigint, {column.name} {ddl}")
    return [r[0] for r in found(spark, DatasetSpec((t,)), {"t": rows})]


X = Column("x", INT)


@pytest.mark.parametrize(
    "check, value, kinds",
    [
        (between(col("x"), 1, 3), 4, ["check_failed"]),
        (between(col("x"), 1, 3), None, []),
        (between(col("x"), 1, None), 0, []),
        (between(col("x"), 1, 3, negated=True), 2, ["check_failed"]),
        (in_(col("x"), 1, None), 2, ["check_failed"]),
        (in_(col("x"), 1, None, negated=True), 2, []),
        (is_null(col("x"), negated=True), None, ["check_failed"]),
        (not_(cmp(col("x"), "=", 1)), 1, ["check_failed"]),
        (or_(cmp(col("x"), "=", 1), cmp(col("x"), ">", 5)), None, []),
        (cmp(3, "<", col("x")), 3, ["check_failed"]),
        (SqlCheck("x + id >= 10"), 8, ["check_failed"]),
        (SqlCheck("nothing > 1"), 8, ["unsupported_check"]),
        (Opaque("(x + id) >= 0"), 8, ["unsupported_check"]),
        (cmp(col("x"), ">", "many"), 8, ["unsupported_check"]),
        (cmp(col("absent"), ">", 1), 8, ["unsupported_check"]),
    ],
)
def test_check_forms(spark, check, value, kinds):
    assert check_kinds(spark, check, X, value, "bigint") == kinds


def test_temporal_literals(spark):
    day, moment = Column("day", DATE), Column("moment", DATETIME)
    assert check_kinds(spark, cmp(col("day"), ">=", "2020-01-01"), day, date(2019, 12, 31), "date") == ["check_failed"]
    before = cmp(col("moment"), "<", "2024-01-01 00:00:00")
    assert check_kinds(spark, before, moment, datetime(2024, 1, 1), "timestamp_ntz") == ["check_failed"]
    assert check_kinds(spark, cmp(col("day"), ">=", "yesterday"), day, date(2019, 12, 31), "date") == ["unsupported_check"]


def test_columns_of_different_families_do_not_compare(spark):
    t = Table("t", (Column("id", INT), Column("day", DATE)), ("id",), checks=(cmp(col("id"), "<", col("day")),))
    rows = spark.createDataFrame([(1, date(2024, 1, 1))], "id bigint, day date")
    assert found(spark, DatasetSpec((t,)), {"t": rows}) == [("unsupported_check", "t", None, None)]


def test_incomparable_loses_to_what_decides(spark):
    """false AND bad is false, true OR bad is true; otherwise bad wins over unknown."""
    t = Table(
        "raw",
        (Column("id", INT), Column("a", INT), Column("b", INT)),
        ("id",),
        checks=(or_(cmp(col("a"), ">", 0), cmp(col("b"), ">", 0)), not_(or_(cmp(col("a"), ">", 0), cmp(col("b"), ">", 0)))),
    )
    rows = spark.createDataFrame(
        [(1, '{"id":1,"a":1,"b":"x"}'), (2, '{"id":2,"a":-1,"b":"x"}'), (3, '{"id":3,"a":null,"b":"x"}'), (4, '{"id":4,"a":null,"b":1}')],
        "no bigint, raw string",
    )
    got = sorted((r["kind"], r["row_key"]) for r in v.raw_violations(t, rows, "raw", ["no"]).collect() if r["kind"].startswith("check"))
    assert got == [
        ("check_failed", "1"),
        ("check_failed", "4"),
        ("check_unevaluable", "2"),
        ("check_unevaluable", "2"),
        ("check_unevaluable", "3"),
        ("check_unevaluable", "3"),
    ]


def test_raw_rows_that_are_no_mappings(spark):
    t = Table("raw", (Column("id", INT), Column("price", DECIMAL(5, 2))), ("id",))
    texts = ["[1]", '"x"', "7", "{broken", '{"ID": 1, "price": 1.234}', '{"Id": "07", "price": "12a"}', "{}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "no bigint, raw string")
    got = sorted((r["row_key"], r["kind"]) for r in v.raw_violations(t, rows, "raw", ["no"]).collect())
    assert got == [
        ("0", "row_shape"),
        ("1", "row_shape"),
        ("2", "row_shape"),
        ("3", "row_shape"),
        ("4", "decimal_precision"),
        ("5", "type_mismatch"),
        ("6", "missing_column"),
    ]


def test_gate_names_count_and_first_messages(spark):
    data = main_data(spark, change(tier=None), change(customer_id=2, tier="x"), review_rows=((1, 9, 9),))
    with pytest.raises(v.DataValidationError, match=r"^5 violations, first: .*;.*;.*; \.\.\.$") as error:
        v.assert_valid(spark, MAIN, data)
    assert error.value.violations.count() == 5
    summary = {(r["kind"], r["column_name"]): (r["violations"], r["samples"]) for r in v.summarize(error.value.violations).collect()}
    assert summary[("unique_duplicate", "email")] == (1, "2")
    assert sum(n for n, _ in summary.values()) == 5


def test_unknown_foreign_key_targets_are_refused():
    bad = Table("t", (Column("id", INT),), ("id",), foreign_keys=(ForeignKey(("id",), "nowhere", ("id",)),))
    with pytest.raises(SpecError):
        DatasetSpec((bad,))


def test_spec_survives_json():
    from fixtures import COMPANY, LIBRARY, RESTAURANTS

    for spec in (MAIN, COMPANY, LIBRARY, RESTAURANTS, DatasetSpec((MEMBERS,))):
        assert DatasetSpec.from_json(spec.to_json()) == spec
