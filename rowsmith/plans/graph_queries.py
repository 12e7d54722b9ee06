"""Dependency order and cycles among the rows of the test tables.

Each row depends on the rows its foreign keys name. Two extra references close
cycles: a region names its first nation, and a nation its richest customer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from rowsmith.operators import graph
from rowsmith.plans.registry import query
from rowsmith.plans.tpch import load

_REFERENCES = (
    ("orders", "o_orderkey", "o_custkey", "customer"),
    ("events", "event_id", "user_id", "customer"),
    ("customer", "c_custkey", "c_nationkey", "nation"),
    ("supplier", "s_suppkey", "s_nationkey", "nation"),
    ("nation", "n_nationkey", "n_regionkey", "region"),
)


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        load(spark, sf_dir, table).selectExpr(
            f"concat('{table}|', CAST({key} AS STRING)) AS src", f"concat('{parent}|', CAST({fk} AS STRING)) AS dst"
        )
        for table, key, fk, parent in _REFERENCES
    ]
    return reduce(DataFrame.union, parts)


def circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg({"n_nationkey": "min"})
    customers = load(spark, sf_dir, "customer").selectExpr("c_nationkey", "struct(c_acctbal, c_custkey) AS best")
    richest = customers.groupBy("c_nationkey").agg({"best": "max"}).toDF("n", "best")
    capitals = first.toDF("r", "n").selectExpr("concat('region|', r) AS src", "concat('nation|', n) AS dst")
    favourites = richest.selectExpr("concat('nation|', n) AS src", "concat('customer|', best.c_custkey) AS dst")
    return references(spark, sf_dir).union(capitals).union(favourites)


EDGES_SQL = " UNION ALL ".join(
    f"SELECT '{table}|' || {key} AS src, '{parent}|' || {fk} AS dst FROM {table}" for table, key, fk, parent in _REFERENCES
)
CIRCULAR_SQL = f"""{EDGES_SQL} UNION ALL SELECT 'region|' || n_regionkey, 'nation|' || min(n_nationkey) FROM nation GROUP BY n_regionkey
 UNION ALL SELECT 'nation|' || c_nationkey, 'customer|' || arg_max(c_custkey, (c_acctbal, c_custkey)) FROM customer GROUP BY c_nationkey"""

_REACH = f"""WITH RECURSIVE edges AS (SELECT DISTINCT src, dst FROM ({CIRCULAR_SQL})),
 reach(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON e.src = r.dst),
 nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
 mutual AS (SELECT a.src AS node, a.dst AS peer FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src),
 labelled AS (SELECT n.node, least(n.node, coalesce(min(m.peer), n.node)) AS component FROM nodes n LEFT JOIN mutual m ON m.node = n.node GROUP BY n.node)"""


@query(
    "dep_levels",
    f"""WITH RECURSIVE edges AS (SELECT DISTINCT src, dst FROM ({EDGES_SQL})),
        walk(node, level) AS (SELECT dst, 0 FROM edges WHERE dst NOT IN (SELECT src FROM edges)
          UNION SELECT e.src, w.level + 1 FROM walk w JOIN edges e ON e.dst = w.node)
        SELECT node, CAST(max(level) AS BIGINT) AS level FROM walk GROUP BY node""",
)
def dep_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(references(spark, sf_dir))


@query("dep_components", f"{_REACH} SELECT node, component FROM labelled")
def dep_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(circular(spark, sf_dir))


@query("dep_cycles", f"{_REACH} SELECT node, component FROM labelled WHERE node IN (SELECT node FROM mutual)")
def dep_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(circular(spark, sf_dir))


@query(
    "dep_groups",
    f"""{_REACH}, between AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM edges JOIN labelled a ON a.node = edges.src
          JOIN labelled b ON b.node = edges.dst WHERE a.component <> b.component),
        walk(node, level) AS (SELECT DISTINCT component, 0 FROM labelled WHERE component NOT IN (SELECT src FROM between)
          UNION SELECT e.src, w.level + 1 FROM walk w JOIN between e ON e.dst = w.node),
        deep AS (SELECT node, max(level) AS level FROM walk GROUP BY node)
        SELECT l.node, l.component, CAST(d.level AS BIGINT) AS level FROM labelled l JOIN deep d ON d.node = l.component""",
)
def dep_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependency_groups(circular(spark, sf_dir))
