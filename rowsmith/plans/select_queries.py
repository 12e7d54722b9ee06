"""Read-only SELECTs: the guard, the row cap, and the SQL families users run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowsmith.operators.shared import repeat_rows, rows_of_groups
from rowsmith.plans import tpch
from rowsmith.plans.registry import query
from rowsmith.plans.select import guarded_select
from rowsmith.plans.tpch import load
from rowsmith.spec import TEXT, Column, DatasetSpec, Table


def _plain(spark: SparkSession, sf_dir: str, name: str) -> Table:
    """The file's own columns as a table the guard may show."""
    return Table(name, tuple(Column(c, TEXT) for c in load(spark, sf_dir, name).columns))


def ask(spark: SparkSession, sf_dir: str, text: str, max_rows: int) -> DataFrame:
    names = ("nation", "region", "customer", "orders")
    spec = DatasetSpec(tuple(_plain(spark, sf_dir, n) for n in names))
    return guarded_select(spark, spec, {n: f"{sf_dir}/{n}.parquet" for n in names}, text, max_rows)


# --- guarded -----------------------------------------------------------------

_GROUPED = """WITH placed AS (SELECT o.o_orderkey, c.c_mktsegment FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey)
SELECT c_mktsegment AS segment, count(*) AS n FROM placed GROUP BY c_mktsegment"""


@query("q_guarded", _GROUPED)
def q_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask(spark, sf_dir, _GROUPED + ";", 200)


_ORDERED = 'SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500'


@query("q_limit_cap", f"SELECT * FROM ({_ORDERED}) LIMIT 200")
def q_limit_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask(spark, sf_dir, _ORDERED, 200)


# --- families ----------------------------------------------------------------


@query(
    "q_filter_project",
    """SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS net
       FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_returnflag = 'R' AND l_quantity < 24""",
)
def q_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = load(spark, sf_dir, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ'1998-01-01' AND l_returnflag = 'R' AND l_quantity < 24")
    net = tpch.dec("l_extendedprice") * (F.lit(1) - tpch.dec("l_discount", 4))
    return kept.select("l_orderkey", "l_linenumber", net.alias("net"))


_CTE = """WITH big AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 200000)
SELECT n.n_name AS nation, count(*) AS n_orders, count(DISTINCT c.c_custkey) AS buyers
FROM big JOIN customer c ON c.c_custkey = big.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name"""


@query("q_cte_join", _CTE)
def q_cte_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = load(spark, sf_dir, "orders").where("o_totalprice > 200000").select("o_orderkey", "o_custkey")
    customer, nation = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    # Orders are counted per customer before they meet the nations.
    per_customer = big.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    joined = per_customer.join(customer, F.col("c_custkey") == F.col("o_custkey")).join(
        nation, F.col("n_nationkey") == F.col("c_nationkey")
    )
    return joined.groupBy(F.col("n_name").alias("nation")).agg(
        F.sum("n").alias("n_orders"), F.count(F.lit(1)).alias("buyers")
    )


@query(
    "q_outer_join",
    """SELECT d.doc_id AS doc_id, l.doc_id AS label_id, l.quality FROM (SELECT doc_id FROM documents) AS d
       FULL OUTER JOIN (SELECT doc_id, quality FROM labels) AS l ON l.doc_id = d.doc_id""",
)
def q_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents").select("doc_id")
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), "quality")
    return documents.join(labels, F.col("doc_id") == F.col("label_id"), "full_outer")


@query(
    "q_semi_anti",
    """SELECT c_custkey, 'buyer' AS side FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
       UNION ALL SELECT c_custkey, 'idle' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
def q_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer").select("c_custkey")
    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    buyers = customer.join(orders.where("o_totalprice > 400000"), "c_custkey", "left_semi")
    idle = customer.join(orders, "c_custkey", "left_anti")
    return buyers.withColumn("side", F.lit("buyer")).union(idle.withColumn("side", F.lit("idle")))


_BAND = 4_000


@query(
    "q_range_join",
    f"""SELECT n_name AS band, count(*) AS n FROM lineitem JOIN nation
        ON l_extendedprice >= n_nationkey * {_BAND} AND l_extendedprice < (n_nationkey + 1) * {_BAND} GROUP BY n_name""",
)
def q_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items per price band, one band of equal width per nation.

    Prices are cut at the band width, so the range join becomes an equi join
    on the cut with the exact range checked after it. No pair is formed that
    is not in the result.
    """
    cut = F.floor(F.col("l_extendedprice") / _BAND).alias("cut")
    prices = load(spark, sf_dir, "lineitem").select("l_extendedprice", cut)
    low = F.col("n_nationkey") * _BAND
    bands = load(spark, sf_dir, "nation").select(
        F.col("n_name").alias("band"), F.col("n_nationkey").cast("bigint").alias("cut"), low.alias("low"), (low + _BAND).alias("high")
    )
    inside = prices.join(bands, "cut").where("l_extendedprice >= low AND l_extendedprice < high")
    return inside.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


_GROUP = """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS quantity,
 count(*) FILTER (WHERE l_discount > 0.05) AS discounted FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10"""


@query("q_group_count", _GROUP)
def q_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = load(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(tpch.dec("l_quantity")).alias("quantity"),
        F.count_if(F.col("l_discount") > 0.05).alias("discounted"),
    ).where("n > 10")


@query(
    "q_distinct_agg",
    "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY event_type",
)
def q_distinct_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("event_type").agg(
        F.countDistinct("user_id").alias("users"), F.countDistinct(F.to_date("ts")).alias("days")
    )


@query(
    "q_rollup_cube",
    """SELECT 'rollup' AS form, o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
       UNION ALL SELECT 'cube', o_orderstatus, o_orderpriority, count(*) FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
       UNION ALL SELECT 'sets', o_orderstatus, o_orderpriority, count(*) FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))""",
)
def q_rollup_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    names = ["o_orderstatus", "o_orderpriority"]
    count = F.count(F.lit(1)).alias("n")
    both = [
        ("rollup", orders.rollup(*names).agg(count)),
        ("cube", orders.cube(*names).agg(count)),
        ("sets", orders.groupingSets([("o_orderstatus",), ("o_orderpriority",)], *names).agg(count)),
    ]
    parts = [df.select(F.lit(form).alias("form"), *names, "n") for form, df in both]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    "q_window_rank",
    """SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place
       FROM orders) WHERE place <= 3""",
)
def q_window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest orders of each customer.

    The rank limit also runs before the shuffle, so a customer with very many
    orders sends three rows per task.
    """
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).cast("bigint").alias("place"))
    return ranked.where("place <= 3")


@query(
    "q_window_frame",
    """WITH daily AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(CAST(value AS DECIMAL(10,2))) AS total FROM events GROUP BY ALL)
       SELECT user_id, day, CAST(sum(total) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DECIMAL(30,2)) AS last_three,
       count(*) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS days, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS before FROM daily""",
)
def q_window_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals over the days of each user.

    Events are summed per user and day first, so a window holds at most one
    row per day however many events a user has.
    """
    daily = load(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum(tpch.dec("value", 10)).alias("total"))
    w = Window.partitionBy("user_id").orderBy("day")
    return daily.select(
        "user_id",
        "day",
        F.sum("total").over(w.rowsBetween(-2, 0)).alias("last_three"),
        F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("days"),
        F.lag("day").over(w).alias("before"),
    )


@query("q_topk", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5")
def q_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = load(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey")
    return best.select("c_custkey", "c_acctbal").offset(5).limit(20)


@query(
    "q_set_ops",
    """SELECT 'union' AS op, k FROM (SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier)
       UNION ALL SELECT 'intersect', k FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events)
       UNION ALL SELECT 'except', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)
       UNION ALL SELECT 'except_all', k FROM (SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT user_id FROM events)""",
)
def q_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    def keys(table: str, column: str) -> DataFrame:
        return load(spark, sf_dir, table).select(F.col(column).alias("k"))

    customer, orders, events = keys("customer", "c_custkey"), keys("orders", "o_custkey"), keys("events", "user_id")
    parts = {
        "union": customer.union(keys("supplier", "s_suppkey")).distinct(),
        "intersect": orders.intersect(events),
        "except": customer.subtract(orders),
        "except_all": except_all(orders, events, "k"),
    }
    tagged = [df.select(F.lit(op).alias("op"), "k") for op, df in parts.items()]
    return tagged[0].union(tagged[1]).union(tagged[2]).union(tagged[3])


def except_all(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """EXCEPT ALL by counting: a value with very many copies is unrolled by all tasks."""
    kept = left.groupBy(key).agg(F.count(F.lit(1)).alias("_left"))
    lost = right.groupBy(key).agg(F.count(F.lit(1)).alias("_right"))
    times = (F.col("_left") - F.coalesce("_right", F.lit(0))).alias("_times")
    return repeat_rows(kept.join(lost, key, "left").select(key, times), "_times", [key])


@query(
    "q_subquery",
    """SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT avg(CAST(o_totalprice AS DECIMAL(12,2))) * 1.5 FROM orders i WHERE i.o_custkey = o.o_custkey)
       OR o_totalprice = (SELECT max(o_totalprice) FROM orders)""",
)
def q_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated average becomes an aggregate matched back to its rows."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    means = orders.groupBy("o_custkey").agg(
        (F.avg(tpch.dec("o_totalprice")) * F.lit(1.5)).alias("bar"), F.count(F.lit(1)).alias("_n")
    )
    top = orders.agg(F.max("o_totalprice").alias("top")).first()["top"]
    kept = rows_of_groups(orders, means, ["o_custkey"])
    return kept.where((F.col("o_totalprice") > F.col("bar")) | (F.col("o_totalprice") == F.lit(top))).select("o_orderkey", "o_totalprice")


@query(
    "q_scalar_functions",
    """SELECT doc_id, upper(lang) AS lang, length(text) AS n_chars, n_chars AS declared, split_part(source, 'c', 2) AS source_no,
       md5(text) AS digest, length(text) - length(replace(text, ' ', '')) AS spaces FROM documents""",
)
def q_scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "upper(lang) AS lang",
        "CAST(length(text) AS BIGINT) AS n_chars",
        "n_chars AS declared",
        "split_part(source, 'c', 2) AS source_no",
        "md5(text) AS digest",
        "CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS spaces",
    )


@query(
    "q_dates",
    """SELECT event_id, CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS hour, year(ts) AS y, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS since FROM events""",
)
def q_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr(
        "event_id",
        "CAST(ts AS DATE) AS day",
        "CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ) AS hour",
        "CAST(year(ts) AS BIGINT) AS y",
        "datediff(CAST(ts AS DATE), DATE'2024-01-01') AS since",
    )


@query(
    "q_json_array",
    """SELECT 'events' AS origin, event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS number FROM events
       UNION ALL SELECT 'embeddings', vec_id, len(embedding) FROM embeddings
       UNION ALL SELECT 'positive', vec_id, len(list_filter(embedding, lambda x: x > 0)) FROM embeddings""",
)
def q_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").selectExpr(
        "'events' AS origin", "event_id AS id", "CAST(get_json_object(props, '$.k') AS BIGINT) AS number"
    )
    vectors = load(spark, sf_dir, "embeddings")
    sizes = vectors.selectExpr("'embeddings' AS origin", "vec_id AS id", "CAST(size(embedding) AS BIGINT) AS number")
    positive = vectors.selectExpr(
        "'positive' AS origin", "vec_id AS id", "CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS number"
    )
    return events.union(sizes).union(positive)
