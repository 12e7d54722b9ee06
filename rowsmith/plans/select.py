"""Read-only SELECT over the tables of one dataset, with a row cap.

Spark parses and plans the text. The text only ever runs as a subquery in a
session of its own that knows the dataset's tables and lacks the functions
that reach outside a query. What it names is judged on the nodes of the
analysed plan: every relation must be one that the dataset's own views read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from rowsmith.operators.shared import ref
from rowsmith.spec import DatasetSpec

ROWS_DEFAULT, ROWS_LIMIT = 200, 1_000

# Functions that call code of the host.
FORBIDDEN_FUNCTIONS = ("reflect", "java_method", "try_reflect")
FORBIDDEN_EXPRESSIONS = {"CallMethodViaReflection", "TryReflect"}
# Leaves that hold no table: constants, number ranges, and references to parts of the plan itself.
PLAIN_LEAVES = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef"}
# What a SELECT is made of above its leaves. Anything else, such as a script that rows are sent to, is refused.
QUERY_NODES = set(
    "Project Filter Aggregate Expand Window Generate Sample Sort Distinct Deduplicate Offset GlobalLimit LocalLimit LimitAll "
    "Join LateralJoin Union Intersect Except WithCTE CTERelationDef UnionLoop Repartition RepartitionByExpression "
    "RebalancePartitions ResolvedHint".split()
)


class QueryError(ValueError):
    """The text is not one read-only SELECT over the dataset's tables."""


def _kind(node: Any) -> str:
    return node.getClass().getSimpleName().removesuffix("$")


def _items(sequence: Any) -> Iterator[Any]:
    return (sequence.apply(i) for i in range(sequence.size()))


def _tree(node: Any) -> Iterator[Any]:
    """A node of a plan or expression and all below it."""
    waiting = [node]
    while waiting:
        node = waiting.pop()
        yield node
        waiting.extend(_items(node.children()))


def plan_nodes(plan: Any) -> Iterator[Any]:
    """Every node of an analysed plan, inside CTE definitions and subqueries at any depth as well."""
    for part in [plan, *_items(plan.subqueriesAll())]:
        yield from _tree(part)


class Guard:
    """What the plans over a dataset's own views are made of; other relations and views are foreign."""

    def __init__(self, session: SparkSession, tables: list[str]) -> None:
        # Compared by identity: an equal relation at another place in the catalog is still another one.
        self.relations = session._jvm.java.util.IdentityHashMap()
        self.views = {t.casefold() for t in tables}
        for table in tables:
            for node in plan_nodes(session.table(table)._jdf.queryExecution().analyzed()):
                if _kind(node) == "LogicalRelation":
                    self.relations.put(node.relation(), table)

    def judge(self, plan: Any) -> None:
        """Raise `QueryError` for anything that the dataset does not hold."""
        for node in plan_nodes(plan):
            kind = _kind(node)
            if kind == "SubqueryAlias":
                known = node.identifier().qualifier().isEmpty()
            elif kind == "View":
                name = node.desc().identifier()
                known = node.isTempView() and name.database().isEmpty() and name.table().casefold() in self.views
            elif kind == "LogicalRelation":
                known = self.relations.containsKey(node.relation())
            else:
                known = kind in (PLAIN_LEAVES if node.children().isEmpty() else QUERY_NODES)
            if not known:
                raise QueryError("the query reads or does something beyond a SELECT over the tables of the dataset")
            for expression in _items(node.expressions()):
                if any(_kind(e) in FORBIDDEN_EXPRESSIONS for e in _tree(expression)):
                    raise QueryError("the query calls a function that is not allowed")


def guarded_select(
    spark: SparkSession, spec: DatasetSpec, paths: dict[str, str], text: str, max_rows: int = ROWS_DEFAULT
) -> DataFrame:
    """Run one SELECT; at most `max_rows` rows are returned.

    `paths` gives the Parquet location of each table.
    """
    if not 1 <= max_rows <= ROWS_LIMIT:
        raise QueryError(f"{max_rows} rows cannot be asked for: the cap is a number from 1 to {ROWS_LIMIT}")
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    session.conf.set("spark.sql.ansi.enabled", "true")
    session.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    state = session._jsparkSession.sessionState()
    for function in FORBIDDEN_FUNCTIONS:
        # The registry is the session's own copy.
        state.functionRegistry().dropFunction(session._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(function))
    tables = [t.name for t in spec.tables if t.name in paths]
    for table in tables:
        columns = [ref(c) for c in spec.table(table).column_names]
        session.read.parquet(paths[table]).select(*columns).createOrReplaceTempView(table)
    body = text.strip().rstrip(";")
    try:
        # Text with unbalanced parentheses must fail on its own, not inside the wrapper.
        state.sqlParser().parsePlan(body)
        asked = session.sql(f"SELECT * FROM (\n{body}\n) AS q")
    except PySparkException as error:
        raise QueryError(f"the query was refused: {error.getCondition()}") from error
    Guard(session, tables).judge(asked._jdf.queryExecution().analyzed())
    return asked.limit(max_rows)
