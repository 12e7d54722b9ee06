"""Queries for edits, keyed updates, paging, stored datasets and CSV."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.operators import paging
from rowsmith.operators import update as u
from rowsmith.operators.edit import Regenerate, Replace, Transform, apply_edits
from rowsmith.operators.shared import checkpoint_dir, written
from rowsmith.operators.validate import apply_rules, typed_rules
from rowsmith.plans import tpch
from rowsmith.plans.registry import query, sql_draw, sql_key, sql_violation
from rowsmith.plans.tpch import load
from rowsmith.plans.validation_queries import SHOWN
from rowsmith.sources import store
from rowsmith.spec import BOOLEAN, DATE, DATETIME, DECIMAL, ENUM, INT, VARCHAR, Column, DatasetSpec, ForeignKey, Table

STATUSES = ENUM("F", "O", "P")
ORDERS = Table(
    "orders",
    (
        Column("o_orderkey", INT),
        Column("o_custkey", INT, nullable=False),
        Column("o_orderstatus", STATUSES),
        Column("o_totalprice", DECIMAL(12, 2)),
        Column("o_orderdate", DATE),
        Column("o_placed", DATETIME),
        Column("o_lines", INT),
        Column("o_orderpriority", VARCHAR(20)),
    ),
    ("o_orderkey",),
    foreign_keys=(ForeignKey(("o_custkey",), "customer", ("c_custkey",)),),
)
CUSTOMER = Table("customer", (Column("c_custkey", INT),), ("c_custkey",))
SPEC = DatasetSpec((CUSTOMER, ORDERS))

ORDERS_SQL = """(SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice,
   CAST(o_orderdate AS DATE) AS o_orderdate, o_orderdate + INTERVAL 90 MINUTE AS o_placed,
   CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey % 7 END AS o_lines, o_orderpriority FROM orders)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "o_custkey",
        "nullif(o_orderstatus, 'P') AS o_orderstatus",
        "CAST(o_totalprice AS DECIMAL(12, 2)) AS o_totalprice",
        "CAST(o_orderdate AS DATE) AS o_orderdate",
        "o_orderdate + INTERVAL 90 MINUTE AS o_placed",
        "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey % 7 END AS o_lines",
        "o_orderpriority",
    )


def dataset(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"customer": load(spark, sf_dir, "customer").select("c_custkey"), "orders": orders(spark, sf_dir)}


def edited(spark: SparkSession, sf_dir: str, *edits: object, column: str) -> DataFrame:
    """One edited column of orders, after the whole dataset passed validation."""
    data = apply_edits(
        spark, SPEC, dataset(spark, sf_dir), edits, seed=5, row_ids={"orders": "o_orderkey"}, hash_method="md5"
    )
    return data["orders"].select("o_orderkey", column)


# --- edits -------------------------------------------------------------------


@query(
    "edit_regenerate",
    f"SELECT o_orderkey, {sql_draw(5, 'orders', 'o_lines', 'o_orderkey', 10001)} AS o_lines FROM orders",
)
def edit_regenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(spark, sf_dir, Regenerate("orders", ("o_lines", "o_orderdate")), column="o_lines")


@query("edit_add", f"SELECT o_orderkey, CAST(o_totalprice + 12.5 AS DECIMAL(12,2)) AS o_totalprice FROM {ORDERS_SQL}")
def edit_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(spark, sf_dir, Transform("orders", "o_totalprice", "add", value=12.5), column="o_totalprice")


@query("edit_multiply", f"SELECT o_orderkey, CAST(o_totalprice * 3 AS DECIMAL(12,2)) AS o_totalprice FROM {ORDERS_SQL}")
def edit_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(spark, sf_dir, Transform("orders", "o_totalprice", "multiply", value=3.0), column="o_totalprice")


@query(
    "edit_multiply_misfit",
    sql_violation("decimal_precision", "orders", "o_totalprice", sql_key("o_orderkey"), ORDERS_SQL, "o_totalprice * 1.005 <> round(o_totalprice * 1.005, 2)"),
)
def edit_multiply_misfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product with too many decimal places is a violation, not a rounded value."""
    edits = [Transform("orders", "o_totalprice", "multiply", value=1.005)]
    wide = apply_edits(spark, SPEC, dataset(spark, sf_dir), edits, check=False)["orders"]
    return apply_rules(wide, ORDERS, typed_rules(ORDERS, wide), ["o_orderkey"]).select(*SHOWN)


@query("edit_clamp", f"SELECT o_orderkey, CASE WHEN o_lines IS NULL THEN NULL ELSE least(greatest(o_lines, 2), 4) END AS o_lines FROM {ORDERS_SQL}")
def edit_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(spark, sf_dir, Transform("orders", "o_lines", "clamp", minimum=2, maximum=4), column="o_lines")


@query("edit_shift_days", f"SELECT o_orderkey, o_placed - INTERVAL 45 DAY AS o_placed FROM {ORDERS_SQL}")
def edit_shift_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = [Transform("orders", c, "shift_days", value=-45) for c in ("o_orderdate", "o_placed")]
    return edited(spark, sf_dir, *shift, column="o_placed")


@query(
    "edit_replace",
    f"SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'O' WHEN 'O' THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM {ORDERS_SQL}",
)
def edit_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(spark, sf_dir, Replace("orders", "o_orderstatus", {"F": "O", "O": "F"}), column="o_orderstatus")


@query(
    "edit_sequence",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, CAST(least(greatest(o_totalprice + 100, 5000), 400000) AS DECIMAL(12,2)) AS o_totalprice,
        CAST(o_orderdate + INTERVAL 10 DAY AS DATE) AS o_orderdate, o_placed, o_lines * 2 + 1 AS o_lines,
        CASE o_orderpriority WHEN '5-LOW' THEN 'LOW' ELSE o_orderpriority END AS o_orderpriority FROM {ORDERS_SQL}""",
)
def edit_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = [
        Transform("orders", "o_totalprice", "add", value=100),
        Transform("orders", "o_totalprice", "clamp", minimum=5_000, maximum=400_000),
        Transform("orders", "o_orderdate", "shift_days", value=10),
        Transform("orders", "o_lines", "multiply", value=2),
        Transform("orders", "o_lines", "add", value=1),
        Replace("orders", "o_orderpriority", {"5-LOW": "LOW"}),
    ]
    return apply_edits(spark, SPEC, dataset(spark, sf_dir), edits)["orders"]


# --- keyed updates -----------------------------------------------------------

EDITED_SQL = f"""(SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
   CAST(CASE WHEN o_lines > 4 THEN o_totalprice + 1 ELSE o_totalprice END AS DECIMAL(12,2)) AS o_totalprice, o_orderdate, o_placed, o_lines, o_orderpriority
   FROM {ORDERS_SQL})"""


def edited_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).selectExpr(
        "o_orderkey",
        "o_custkey",
        "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus",
        "CAST(CASE WHEN o_lines > 4 THEN o_totalprice + 1 ELSE o_totalprice END AS DECIMAL(12, 2)) AS o_totalprice",
        "o_orderdate",
        "o_placed",
        "o_lines",
        "o_orderpriority",
    )


@query(
    "upd_key_set",
    """SELECT o_orderkey, 'removed' AS status FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 3 = 0
       UNION ALL SELECT -1 - o_orderkey, 'added' FROM orders WHERE o_orderpriority = '1-URGENT'""",
)
def upd_key_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = load(spark, sf_dir, "orders")
    kept = stored.where("NOT (o_orderstatus = 'P' AND o_custkey % 3 = 0)").select("o_orderkey")
    added = stored.where("o_orderpriority = '1-URGENT'").selectExpr("-1 - o_orderkey AS o_orderkey")
    return u.key_changes(stored, kept.union(added), ["o_orderkey"])


_CHANGED = f"""SELECT e.* FROM {EDITED_SQL} AS e JOIN {ORDERS_SQL} AS s ON s.o_orderkey = e.o_orderkey
   WHERE e.o_orderstatus IS DISTINCT FROM s.o_orderstatus OR e.o_totalprice IS DISTINCT FROM s.o_totalprice"""


@query("upd_changed_rows", _CHANGED)
def upd_changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.changed_rows(ORDERS, orders(spark, sf_dir), edited_orders(spark, sf_dir))


@query("upd_apply", f"SELECT * FROM {EDITED_SQL}")
def upd_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.merged(ORDERS, orders(spark, sf_dir), edited_orders(spark, sf_dir))


@query("upd_flow", _CHANGED)
def upd_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.update_table(spark, SPEC, dataset(spark, sf_dir), "orders", edited_orders(spark, sf_dir))[1]


@query("page_by_key", f"SELECT * FROM {ORDERS_SQL} ORDER BY o_orderkey LIMIT 100 OFFSET 350")
def page_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page_by_key(ORDERS, orders(spark, sf_dir), limit=100, offset=350)


@query(
    "page_total",
    f"SELECT *, (SELECT count(*) FROM orders) AS total, 1100 + 100 < (SELECT count(*) FROM orders) AS has_next FROM {ORDERS_SQL} ORDER BY o_orderkey LIMIT 100 OFFSET 1100",
)
def page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page far from the start, found by the directory of the table, and the number of rows."""
    table = orders(spark, sf_dir)
    page = paging.page_of(ORDERS, table, written(paging.directory(ORDERS, table, block_rows=64)), limit=100, offset=1100)
    return page.rows.withColumns({"total": F.lit(page.total), "has_next": F.lit(page.has_next)})


@query(
    "page_next",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL) "
    "WHERE (l_orderkey, l_linenumber) > (200, 3) ORDER BY l_orderkey, l_linenumber LIMIT 50",
)
def page_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a key of two columns."""
    table = Table("lines", (Column("l_orderkey", INT), Column("l_linenumber", INT), Column("l_partkey", INT)), ("l_orderkey", "l_linenumber"))
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    return paging.page_after(table, rows, (200, 3), limit=50)


@query("page_stored", f"SELECT *, (SELECT count(*) FROM orders) AS total FROM {EDITED_SQL} ORDER BY o_orderkey LIMIT 60 OFFSET 700")
def page_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a stored table that the second version of its dataset holds anew."""
    path = work_path(spark)
    store.write_dataset(spark, SPEC, dataset(spark, sf_dir), path)
    store.update_stored_table(spark, path, "orders", edited_orders(spark, sf_dir), f"{path}-v2")
    page = store.stored_page(spark, f"{path}-v2", "orders", 60, 700)
    return page.rows.withColumn("total", F.lit(page.total))


# --- rows as JSON ------------------------------------------------------------

_NORM = Table("norm", (Column("event_id", INT), Column("event_type", VARCHAR(20)), Column("user_id", INT)), ("event_id",))
_NORM_RAW = """CASE event_type WHEN 'view' THEN '[1]' WHEN 'signup' THEN '{"EVENT_ID": ' || event_id || ', "Extra": "x", "user_id": ' || user_id || '}'
   ELSE '{"User_ID": ' || user_id || ', "event_TYPE": "' || event_type || '", "event_id": ' || event_id || '}' END"""


def norm_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr("event_id AS row_no", f"{_NORM_RAW} AS raw")


@query(
    "norm_rows",
    """SELECT event_id AS row_no, CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_type <> 'signup' THEN event_type END AS event_type,
       CAST(user_id AS VARCHAR) AS user_id FROM events WHERE event_type <> 'view'""",
)
def norm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.normalized_rows(_NORM, norm_source(spark, sf_dir), "raw", ["row_no"])[0]


_NO = "CAST(event_id AS VARCHAR)"


@query(
    "norm_row_violations",
    " UNION ALL ".join(
        [
            sql_violation("row_shape", "norm", None, _NO, "events", "event_type = 'view'"),
            sql_violation("unknown_column", "norm", "Extra", _NO, "events", "event_type = 'signup'"),
            sql_violation("missing_column", "norm", "event_type", _NO, "events", "event_type = 'signup'"),
        ]
    ),
)
def norm_row_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.normalized_rows(_NORM, norm_source(spark, sf_dir), "raw", ["row_no"])[1]


# --- stored datasets ---------------------------------------------------------


def work_path(spark: SparkSession) -> str:
    """A new folder that every executor can reach."""
    return f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"


@query("src_read_table", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def src_read_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read_table(spark, f"{sf_dir}/supplier.parquet", tpch.SUPPLIER)


@query(
    "src_typed_projection",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_extendedprice AS DECIMAL(12,2)) AS l_extendedprice,
       CAST(l_shipdate AS DATE) AS l_shipdate, l_returnflag FROM lineitem""",
)
def src_typed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Table(
        "lineitem",
        (
            Column("l_orderkey", INT),
            Column("l_linenumber", INT),
            Column("l_extendedprice", DECIMAL(12, 2)),
            Column("l_shipdate", DATE),
            Column("l_returnflag", ENUM("A", "N", "R")),
        ),
    )
    return store.typed_projection(table, load(spark, sf_dir, "lineitem"))


@query(
    "sink_default_fill",
    """SELECT p_partkey, nullif(p_brand, 'Brand#2') AS p_brand, 'active' AS status, CAST(0 AS BIGINT) AS stock, CAST(1.50 AS DECIMAL(8,2)) AS price,
       DATE '2020-01-01' AS since, TRUE AS listed, CAST(NULL AS VARCHAR) AS remark FROM part""",
)
def sink_default_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Table(
        "part",
        (
            Column("p_partkey", INT),
            Column("p_brand", VARCHAR(20), default="'none'"),
            Column("status", ENUM("active", "old"), default="'active'"),
            Column("stock", INT, default="0"),
            Column("price", DECIMAL(8, 2), default="1.5"),
            Column("since", DATE, default="'2020-01-01'"),
            Column("listed", BOOLEAN, default="TRUE"),
            Column("remark", VARCHAR(20), default="unquoted"),
        ),
        ("p_partkey",),
    )
    part = load(spark, sf_dir, "part").selectExpr("p_partkey", "nullif(p_brand, 'Brand#2') AS p_brand")
    return store.fill_defaults(table, part)


@query("sink_roundtrip", f"SELECT * FROM {ORDERS_SQL}")
def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark)
    store.write_dataset(spark, SPEC, dataset(spark, sf_dir), path)
    return store.read_dataset(spark, path)[1]["orders"]


@query("sink_update_roundtrip", f"SELECT * FROM {EDITED_SQL}")
def sink_update_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table updated into a new version of its dataset."""
    path = work_path(spark)
    store.write_dataset(spark, SPEC, dataset(spark, sf_dir), path)
    store.update_stored_table(spark, path, "orders", edited_orders(spark, sf_dir), f"{path}-v2")
    return store.read_dataset(spark, f"{path}-v2")[1]["orders"]


CSV_TABLE = replace(ORDERS, columns=(*ORDERS.columns, Column("o_large", BOOLEAN)), foreign_keys=())


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).selectExpr("*", "nullif(o_totalprice, 0) > 250000 AS o_large")


@query("sink_csv_roundtrip", f"SELECT *, o_totalprice > 250000 AS o_large FROM {ORDERS_SQL}")
def sink_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark)
    store.write_csv(CSV_TABLE, csv_rows(spark, sf_dir), path)
    return store.read_csv(spark, CSV_TABLE, path)


@query(
    "sink_csv_text",
    f"""SELECT o_orderkey || ',' || coalesce(o_orderstatus, '') || ',' || o_totalprice || ',' || strftime(o_placed, '%Y-%m-%d %H:%M:%S') || ',' || o_orderdate
        || ',' || CASE WHEN o_totalprice > 250000 THEN 'True' ELSE 'False' END AS line FROM {ORDERS_SQL}""",
)
def sink_csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an exported table, as text."""
    names = ("o_orderkey", "o_orderstatus", "o_totalprice", "o_placed", "o_orderdate", "o_large")
    table = replace(CSV_TABLE, columns=tuple(CSV_TABLE.column(n) for n in names))
    path = work_path(spark)
    store.write_csv(table, csv_rows(spark, sf_dir), path)
    return spark.read.text(path).where(F.col("value") != ",".join(names)).withColumnRenamed("value", "line")


_EXPORTED = (
    "CAST(c_custkey AS VARCHAR)",
    "concat_ws('|', o_orderkey, o_custkey, coalesce(o_orderstatus, ''), CAST(o_totalprice AS VARCHAR), CAST(o_orderdate AS VARCHAR), "
    "CAST(o_placed AS VARCHAR), coalesce(CAST(o_lines AS VARCHAR), ''), o_orderpriority)",
)


@query(
    "sink_export",
    f"""SELECT 'customer' AS table_name, {_EXPORTED[0]} AS line FROM customer
        UNION ALL SELECT 'orders', {_EXPORTED[1]} FROM {ORDERS_SQL}""",
)
def sink_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of an exported dataset, read back."""
    path = work_path(spark)
    store.export_dataset(SPEC, dataset(spark, sf_dir), path)
    parts = [
        store.read_csv(spark, t, f"{path}/{t.name}.csv").selectExpr(f"'{t.name}' AS table_name", f"{line.replace('VARCHAR', 'STRING')} AS line")
        for t, line in zip(SPEC.tables, _EXPORTED)
    ]
    return parts[0].union(parts[1])
