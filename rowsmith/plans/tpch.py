"""A constraint spec for the test tables, and the tables shaped to fit it.

Money columns are doubles in the files; they become decimals first. The rules
are chosen so that every kind of violation finds rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.functions.checks import between, cmp, col, in_, or_
from rowsmith.spec import DATETIME, DECIMAL, ENUM, INT, TEXT, VARCHAR, Column, DatasetSpec, ForeignKey, Table


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE")

REGION = Table("region", (Column("r_regionkey", INT), Column("r_name", VARCHAR(25))), ("r_regionkey",))
NATION = Table(
    "nation",
    (Column("n_nationkey", INT), Column("n_name", VARCHAR(25), nullable=False), Column("n_regionkey", INT)),
    ("n_nationkey",),
    foreign_keys=(ForeignKey(("n_regionkey",), "region", ("r_regionkey",)),),
)
CUSTOMER = Table(
    "customer",
    (
        Column("c_custkey", INT),
        Column("c_name", VARCHAR(18)),
        Column("c_nationkey", INT),
        Column("c_acctbal", DECIMAL(8, 2), checks=(cmp(col("c_acctbal"), ">=", 0),)),
        Column("c_mktsegment", ENUM(*SEGMENTS)),
    ),
    ("c_custkey",),
    foreign_keys=(ForeignKey(("c_nationkey",), "nation", ("n_nationkey",)),),
)
SUPPLIER = Table(
    "supplier",
    (Column("s_suppkey", INT), Column("s_name", VARCHAR(30)), Column("s_nationkey", INT), Column("s_acctbal", DECIMAL(8, 2))),
    ("s_suppkey",),
    foreign_keys=(ForeignKey(("s_nationkey",), "nation", ("n_nationkey",)),),
)
PART = Table(
    "part",
    (
        Column("p_partkey", INT),
        Column("p_name", VARCHAR(10)),
        Column("p_brand", VARCHAR(20)),
        Column("p_type", VARCHAR(30)),
        Column("p_size", INT, checks=(between(col("p_size"), 1, 40),)),
        Column("p_retailprice", DECIMAL(8, 2)),
    ),
    ("p_partkey",),
)
ORDERS = Table(
    "orders",
    (
        Column("o_orderkey", INT),
        Column("o_custkey", INT, nullable=False),
        Column("o_orderstatus", VARCHAR(1), nullable=False),
        Column("o_totalprice", DECIMAL(12, 2)),
        Column("o_orderdate", DATETIME),
        Column("o_orderpriority", VARCHAR(20), checks=(in_(col("o_orderpriority"), *PRIORITIES),)),
    ),
    ("o_orderkey",),
    foreign_keys=(ForeignKey(("o_custkey",), "customer", ("c_custkey",)),),
)
LINEITEM = Table(
    "lineitem",
    (
        Column("l_orderkey", INT),
        Column("l_linenumber", INT),
        Column("l_partkey", INT),
        Column("l_suppkey", INT),
        Column("l_rebate", DECIMAL(6, 2)),
        Column("l_shipdate", DATETIME, checks=(cmp(col("l_shipdate"), "<", datetime(2000, 1, 1)),)),
    ),
    ("l_orderkey", "l_linenumber"),
    foreign_keys=(
        ForeignKey(("l_orderkey",), "orders", ("o_orderkey",)),
        ForeignKey(("l_partkey",), "part", ("p_partkey",)),
        ForeignKey(("l_suppkey",), "supplier", ("s_suppkey",)),
    ),
)
EVENTS = Table(
    "events",
    (
        Column("event_id", INT),
        Column("ts", DATETIME),
        Column("user_id", INT, nullable=False),
        Column("event_type", ENUM("click", "view", "purchase")),
        Column("value", DECIMAL(8, 2)),
    ),
    ("event_id",),
    foreign_keys=(ForeignKey(("user_id",), "customer", ("c_custkey",)),),
)
DOCUMENTS = Table(
    "documents",
    (Column("doc_id", INT), Column("text", VARCHAR(2000), unique=True), Column("lang", VARCHAR(5)), Column("source", VARCHAR(20)), Column("n_chars", INT)),
    ("doc_id",),
    foreign_keys=(ForeignKey(("doc_id",), "labels", ("doc_id",)),),
)
LABELS = Table(
    "labels",
    (Column("doc_id", INT), Column("quality", INT), Column("toxic", INT)),
    ("doc_id",),
    foreign_keys=(ForeignKey(("doc_id",), "documents", ("doc_id",)),),
    checks=(or_(cmp(col("quality"), "=", 1), cmp(col("toxic"), "=", 0)),),
)
PAGES = Table("pages", (Column("page_id", INT), Column("url", VARCHAR(500), unique=True), Column("html", TEXT)), ("page_id",))
BENCHMARK = Table("benchmark", (Column("item_id", INT), Column("text", TEXT)), ("item_id",))
CONVERSATIONS = Table(
    "conversations",
    (Column("conv_id", INT), Column("turn", INT), Column("role", ENUM("user", "assistant")), Column("text", TEXT)),
    ("conv_id", "turn"),
)

SPEC = DatasetSpec(
    (REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDERS, LINEITEM, EVENTS, DOCUMENTS, LABELS, PAGES, BENCHMARK, CONVERSATIONS)
)


def dec(name: str, precision: int = 12, scale: int = 2):
    return F.col(name).cast(f"decimal({precision},{scale})")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The test tables with decimals for money and NULLs made by rule."""

    def t(name: str) -> DataFrame:
        return load(spark, sf_dir, name)

    rebate = (dec("l_extendedprice") * dec("l_discount", 4)).cast("decimal(18,4)")
    return {
        "region": t("region"),
        "nation": t("nation"),
        "customer": t("customer").withColumn("c_acctbal", dec("c_acctbal", 10)),
        "supplier": t("supplier").withColumn("s_acctbal", dec("s_acctbal", 10)),
        "part": t("part").withColumn("p_retailprice", dec("p_retailprice", 10)),
        "orders": t("orders")
        .withColumn("o_totalprice", dec("o_totalprice"))
        .withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P"))),
        "lineitem": t("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rebate.alias("l_rebate"), "l_shipdate"
        ),
        "events": t("events").select("event_id", "ts", "user_id", "event_type", dec("value", 10).alias("value")),
        "documents": t("documents"),
        "labels": t("labels"),
        "pages": t("pages"),
        "benchmark": t("benchmark"),
        "conversations": t("conversations"),
    }
