"""Edits, keyed updates, stored datasets, guarded SELECT and dependency graphs."""

import glob
import random
import re
from datetime import date, datetime
from decimal import Decimal

import pytest
from rowsmith.functions.checks import Opaque, SqlCheck, cmp, col
from rowsmith.operators import graph, paging, shared, update
from rowsmith.operators.edit import EditError, Regenerate, Replace, Transform, apply_edits
from rowsmith.operators.validate import DataValidationError
from rowsmith.plans.select import QueryError, guarded_select
from rowsmith.sources import csv_records, store
from rowsmith.spec import BOOLEAN, DATE, DATETIME, DECIMAL, ENUM, INT, TEXT, VARCHAR, Column, DatasetSpec, ForeignKey, Table, default_value

ITEM = Table(
    "Item",
    (
        Column("item_id", INT),
        Column("label", VARCHAR(40), nullable=False),
        Column("price", DECIMAL(6, 2), nullable=False),
        Column("status", ENUM("open", "closed"), nullable=False),
        Column("due", DATE),
        Column("stock", INT),
        Column("flag", BOOLEAN),
    ),
    ("item_id",),
)
SPEC = DatasetSpec((ITEM,))
DDL = "item_id bigint, label string, price decimal(6,2), status string, due date, stock bigint, flag boolean"
ROWS = [(1, "lamp", Decimal("10.00"), "open", date(2024, 1, 31), 5, True), (2, "desk", Decimal("20.50"), "closed", None, None, False)]


def items(spark, rows=ROWS):
    return {"Item": spark.createDataFrame(rows, DDL)}


def edit(spark, *edits, column, **options):
    data = apply_edits(spark, SPEC, items(spark), edits, **options)
    return [r[column] for r in data["Item"].orderBy("item_id").collect()]


def test_transforms_keep_null_and_type(spark):
    assert edit(spark, Transform("item", "PRICE", "add", value=0.25), column="price") == [Decimal("10.25"), Decimal("20.75")]
    assert edit(spark, Transform("Item", "price", "multiply", value=2.0), column="price") == [Decimal("20.00"), Decimal("41.00")]
    assert edit(spark, Transform("Item", "stock", "clamp", minimum=1, maximum=3), column="stock") == [3, None]
    assert edit(spark, Transform("Item", "due", "shift_days", value=-31), column="due") == [date(2023, 12, 31), None]
    assert edit(spark, Replace("Item", "status", {"open": "closed"}), column="status") == ["closed", "closed"]
    assert edit(spark, Replace("Item", "flag", {"true": "false"}), column="flag") == [True, False]


def test_sequence_applies_in_order(spark):
    edits = [Transform("Item", "stock", "add", value=2), Transform("Item", "stock", "multiply", value=10)]
    assert edit(spark, *edits, column="stock") == [70, None]


def test_regenerate_replaces_only_the_named_columns(spark):
    data = apply_edits(spark, SPEC, items(spark), [Regenerate("Item", ("label", "stock"))], seed=3)["Item"]
    rows = data.orderBy("item_id").collect()
    assert [r["item_id"] for r in rows] == [1, 2] and [r["price"] for r in rows] == [Decimal("10.00"), Decimal("20.50")]
    assert rows[0]["label"] != "lamp" and all(r["stock"] is not None for r in rows)
    again = apply_edits(spark, SPEC, items(spark), [Regenerate("Item", ("label", "stock"))], seed=3)["Item"]
    assert again.orderBy("item_id").collect() == rows


@pytest.mark.parametrize(
    "bad",
    [
        Transform("Item", "price", "multiply", value=1.001),
        Transform("Item", "price", "add", value=99_999),
        Transform("Item", "stock", "multiply", value=0.5),
        Transform("Item", "stock", "clamp", minimum=0.5, maximum=2.5),
        Replace("Item", "label", {"lamp": "x" * 41}),
    ],
)
def test_results_that_do_not_fit_are_refused(spark, bad):
    with pytest.raises(EditError, match="not valid"):
        edit(spark, bad, column="price")


def test_integer_overflow_is_a_violation_not_a_crash(spark):
    rows = [(1, "lamp", Decimal("1.00"), "open", None, 2**62, True)]
    with pytest.raises(EditError, match="after the edit"):
        apply_edits(spark, SPEC, items(spark, rows), [Transform("Item", "stock", "multiply", value=1000)])


@pytest.mark.parametrize(
    "make",
    [
        lambda: Transform("Item", "item_id", "add", value=1),
        lambda: Transform("Item", "label", "add", value=1),
        lambda: Transform("Item", "due", "add", value=1),
        lambda: Transform("Item", "price", "shift_days", value=1),
        lambda: Transform("Item", "price", "add"),
        lambda: Transform("Item", "price", "add", value=2_000_000),
        lambda: Transform("Item", "due", "shift_days", value=1.5),
        lambda: Transform("Item", "due", "shift_days", value=4000),
        lambda: Transform("Item", "price", "clamp", minimum=5, maximum=1),
        lambda: Replace("Item", "price", {"a": "b"}),
        lambda: Replace("Item", "status", {"open": "lost"}),
        lambda: Replace("Item", "label", {}),
        lambda: Regenerate("Item", ("item_id",)),
        lambda: Regenerate("Nothing", ("label",)),
    ],
)
def test_edit_contract(spark, make):
    with pytest.raises(EditError):
        apply_edits(spark, SPEC, items(spark), [make()])


# --- updates -----------------------------------------------------------------


def changed(spark, rows):
    new, diff = update.update_table(spark, SPEC, items(spark), "item", spark.createDataFrame(rows, DDL))
    return sorted(map(tuple, new.collect())), sorted(r["item_id"] for r in diff.collect())


def test_update_changes_only_what_differs_even_to_null(spark):
    edited = [ROWS[1], (1, "lamp", Decimal("10.00"), "open", None, 5, True)]
    new, diff = changed(spark, edited)
    assert diff == [1] and new[0][4] is None and new[1] == ROWS[1]
    assert changed(spark, ROWS) == (sorted(ROWS), [])


def test_update_refuses_new_keys_bad_rows_and_keyless_tables(spark):
    with pytest.raises(update.UpdateError, match="must keep its primary keys"):
        changed(spark, [ROWS[0]])
    with pytest.raises(update.UpdateError, match="must keep its primary keys"):
        changed(spark, [ROWS[0], (3, *ROWS[1][1:])])
    with pytest.raises(DataValidationError):
        changed(spark, [ROWS[0], (2, None, *ROWS[1][2:])])
    with pytest.raises(update.UpdateError, match="are not given"):
        update.update_table(spark, SPEC, items(spark), "Item", items(spark)["Item"].drop("flag"))
    with pytest.raises(update.UpdateError, match="without a primary key"):
        update.keys_of(Table("k", (Column("a", INT),)))


def test_pages(spark):
    table = items(spark, [(i, *ROWS[0][1:]) for i in range(30, 0, -1)])["Item"]
    assert [r["item_id"] for r in paging.page_by_key(ITEM, table, 3, 10).collect()] == [11, 12, 13]
    for limit, offset in ((0, 0), (1001, 0), (1, -1)):
        with pytest.raises(paging.PageError):
            paging.page_by_key(ITEM, table, limit, offset)


PAIRS = Table("pairs", (Column("a", INT), Column("b", VARCHAR(9)), Column("c", INT)), ("a", "b"))


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("block", [1, 7, 1000])
def test_pages_by_a_directory(spark, keyed, block):
    table = PAIRS if keyed else Table("pairs", PAIRS.columns)
    rows = [(i // 4, f"k{i % 4}", i) for i in range(90)]
    if not keyed:
        # Equal rows run over the borders of blocks, and NULLs come first.
        rows += [(None, "x", 1), (None, None, None), (3, None, 5)] + [(5, "k1", 21)] * 30
    df = spark.createDataFrame(rows, "a long, b string, c long").repartition(5)
    ordered = sorted(rows, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in (r[:2] if keyed else r)))
    blocks = shared.written(paging.directory(table, df, block))
    for limit, offset in ((10, 0), (7, 13), (40, 25), (50, len(rows) - 5), (3, len(rows)), (1000, 0)):
        page = paging.page_of(table, df, blocks, limit, offset)
        assert [tuple(r) for r in page.rows.collect()] == ordered[offset : offset + limit]
        assert page.total == len(rows) and page.has_next == (offset + limit < len(rows))


def test_a_far_page_reads_its_blocks_and_limits_nothing_by_its_offset(spark, tmp_path):
    table = Table("big", (Column("id", INT), Column("v", INT)), ("id",))
    spark.range(50_000).selectExpr("id", "id * 2 AS v").repartitionByRange(8, "id").write.parquet(str(tmp_path / "big"))
    df = spark.read.parquet(str(tmp_path / "big"))
    page = paging.page_of(table, df, shared.written(paging.directory(table, df, 500)), 20, 41_230)
    plan = page.rows._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters:")[1].split("]")[0]
    low, high = (int(re.search(rf"{side}\(id,(\d+)\)", pushed)[1]) for side in ("GreaterThanOrEqual", "LessThanOrEqual"))
    assert low <= 41_230 and high >= 41_249 and high - low < 1000
    assert "41250" not in plan and [r["v"] for r in page.rows.collect()] == [2 * i for i in range(41_230, 41_250)]
    assert [r["id"] for r in paging.page_by_key(table, df, 5, 49_990).collect()] == list(range(49_990, 49_995))


def test_the_page_after_a_key(spark):
    rows = [(i // 4, f"k{i % 4}", i) for i in range(90)]
    df = spark.createDataFrame(rows, "a long, b string, c long").repartition(5)
    assert [r["c"] for r in paging.page_after(PAIRS, df, (3, "k2"), 6).collect()] == [15, 16, 17, 18, 19, 20]
    assert paging.page_after(PAIRS, df, (22, "k1"), 6).isEmpty()
    with pytest.raises(paging.PageError):
        paging.page_after(PAIRS, df, (3,), 6)


# --- stored datasets ---------------------------------------------------------

TEAM = DatasetSpec(
    (
        Table("Team", (Column("team_id", INT), Column("title", VARCHAR(20)), Column("budget", DECIMAL(9, 2), nullable=False, default="100.00"), Column("lead_id", INT)), ("team_id",), foreign_keys=(ForeignKey(("lead_id",), "Member", ("member_id",)),)),
        Table("Member", (Column("member_id", INT), Column("full_name", VARCHAR(30)), Column("team_id", INT, nullable=False), Column("role", ENUM("lead", "engineer"), nullable=False)), ("member_id",), foreign_keys=(ForeignKey(("team_id",), "Team", ("team_id",)),), checks=(Opaque("member_id + 1 > 0"),)),
    )
)


def team(spark, lead=7):
    return {
        "team": spark.createDataFrame([(1, "core", lead)], "team_id int, title string, lead_id bigint"),
        "Member": spark.createDataFrame([(7, "Ada", 1, "lead")], "member_id bigint, full_name string, team_id bigint, role string"),
    }


def test_circular_dataset_round_trip_with_defaults(spark, tmp_path):
    path = str(tmp_path / "d")
    store.write_dataset(spark, TEAM, team(spark), path)
    spec, data = store.read_dataset(spark, path)
    assert spec == TEAM
    assert data["Team"].first() == (1, "core", Decimal("100.00"), 7)
    assert data["Team"].schema["budget"].dataType.simpleString() == "decimal(9,2)"
    with pytest.raises(store.StoreError, match="already holds"):
        store.write_dataset(spark, TEAM, team(spark), path)


def test_failed_write_publishes_nothing(spark, tmp_path):
    path = str(tmp_path / "d")
    with pytest.raises(DataValidationError):
        store.write_dataset(spark, TEAM, team(spark, lead=8), path)
    with pytest.raises(store.StoreError):
        store.read_dataset(spark, path)
    mistyped = {**team(spark), "Member": team(spark)["Member"].withColumn("member_id", col_text())}
    with pytest.raises(DataValidationError):
        store.write_dataset(spark, TEAM, mistyped, path)


def col_text():
    from pyspark.sql import functions as F

    return F.col("member_id").cast("string")


def test_stored_update_writes_a_new_version(spark, tmp_path):
    old, new = str(tmp_path / "v1"), str(tmp_path / "v2")
    store.write_dataset(spark, TEAM, team(spark), old)
    edited = store.read_dataset(spark, old)[1]["Team"].selectExpr("team_id", "'ops' AS title", "budget", "lead_id")
    assert store.update_stored_table(spark, old, "team", edited, new) == 1
    assert store.read_dataset(spark, new)[1]["Team"].first()["title"] == "ops"
    assert store.read_dataset(spark, old)[1]["Team"].first()["title"] == "core"
    # Only the updated table is stored anew; a third version builds on the second.
    assert {p.name for p in (tmp_path / "v2").iterdir() if not p.name.startswith("_")} == {"Team"}
    member = store.read_dataset(spark, new)[1]["Member"].selectExpr("member_id", "'Bea' AS full_name", "team_id", "role")
    third = str(tmp_path / "v3")
    assert store.update_stored_table(spark, new, "Member", member, third) == 1
    found = store.read_dataset(spark, third)[1]
    assert found["Team"].first()["title"] == "ops" and found["Member"].first()["full_name"] == "Bea"
    with pytest.raises(store.StoreError):
        store.update_stored_table(spark, old, "team", edited, new)


def test_stored_update_judges_what_it_can_break(spark, tmp_path):
    """A reference to a column that is not the key breaks when the edit takes its value away."""
    lists = DatasetSpec(
        (
            Table("codes", (Column("id", INT), Column("code", VARCHAR(5))), ("id",), (("code",),)),
            Table("uses", (Column("id", INT), Column("code", VARCHAR(5))), ("id",), foreign_keys=(ForeignKey(("code",), "codes", ("code",)),)),
        )
    )
    old = str(tmp_path / "v1")
    data = {n: spark.createDataFrame([(1, "a"), (2, "b")], "id long, code string") for n in ("codes", "uses")}
    store.write_dataset(spark, lists, data, old)
    edited = spark.createDataFrame([(1, "a"), (2, "c")], "id long, code string")
    with pytest.raises(DataValidationError, match="names a codes"):
        store.update_stored_table(spark, old, "codes", edited, str(tmp_path / "v2"))
    assert not store.is_published(spark, str(tmp_path / "v2"))


def test_pages_of_a_stored_table(spark, tmp_path):
    spec = DatasetSpec((PAIRS,))
    rows = [(i // 4, f"k{i % 4}", i) for i in range(90)]
    path = str(tmp_path / "v1")
    store.write_dataset(spark, spec, {"pairs": spark.createDataFrame(rows, "a long, b string, c long")}, path)
    first = store.stored_page(spark, path, "PAIRS", 20, 30)
    assert [r["c"] for r in first.rows.collect()] == list(range(30, 50)) and first.total == 90
    assert [r["c"] for r in store.stored_page(spark, path, "pairs", 20, 80).rows.collect()] == list(range(80, 90))
    with pytest.raises(paging.PageError):
        store.stored_page(spark, path, "pairs", 0)


def test_csv_text(spark, tmp_path):
    t = Table("t", (Column("id", INT), Column("note", TEXT), Column("at", DATETIME), Column("day", DATE), Column("n", DECIMAL(5, 2)), Column("ok", BOOLEAN)))
    rows = [(1, 'a "b", c', datetime(2024, 1, 2, 3, 4, 5), date(2024, 1, 2), Decimal("1.50"), True), (2, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id bigint, note string, at timestamp_ntz, day date, n decimal(5,2), ok boolean").coalesce(1)
    path = str(tmp_path / "csv")
    store.write_csv(t, df, path)
    lines = open(glob.glob(path + "/part-*")[0], encoding="utf-8").read().splitlines()
    assert lines == ["id,note,at,day,n,ok", '1,"a ""b"", c",2024-01-02 03:04:05,2024-01-02,1.50,True', "2,,,,,"]
    assert sorted(map(tuple, store.read_csv(spark, t, path).collect())) == rows


def test_defaults():
    def read(kind, raw, portable=False):
        return default_value(Column("c", kind, default=raw), portable=portable)

    assert read(INT, "0") == 0 and read(INT, "'7'") == 7 and read(INT, "x") is None
    assert read(DECIMAL(5, 2), "1.5") == Decimal("1.50")
    assert read(BOOLEAN, "1") is True and read(BOOLEAN, "false") is False
    assert read(DATE, "'2024-02-01'") == date(2024, 2, 1) and read(DATE, "CURRENT_TIMESTAMP") == "CURRENT_TIMESTAMP"
    assert read(INT, "CURRENT_TIMESTAMP") is None
    assert read(VARCHAR(3), "abcdef") == "abc" and read(VARCHAR(3), "abc", portable=True) is None
    assert read(ENUM("a"), "'b'") is None and read(TEXT, "NULL") is None


@pytest.mark.parametrize("breaks", [True, False])
def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path, breaks):
    """Fields with line breaks, quotes and commas, over ranges that begin anywhere in a record."""
    rng = random.Random(9)
    table = Table("notes", (Column("id", INT), Column("note", TEXT), Column("tail", VARCHAR(20))), ("id",))
    pool = ["a", "b c", '"', ",", "'", "é", '""', *(["\n", "\n\n", "\r\n"] if breaks else [])]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(1, 30))).strip() or "x", rng.choice([None, "t", "\n" if breaks else "u"])) for i in range(3000)]
    path = str(tmp_path / "csv")
    store.write_csv(table, spark.createDataFrame(rows, "id long, note string, tail string").coalesce(1), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = csv_records.csv_lines(spark, path)
        assert lines.rdd.getNumPartitions() > 5 and lines.select("block").distinct().count() > 5
        assert sorted(tuple(r) for r in store.read_csv(spark, table, path).collect()) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


# --- guarded SELECT ----------------------------------------------------------

QUERY_SPEC = DatasetSpec(
    (
        Table("Customers", (Column("id", INT), Column("category", ENUM("retail", "business"), nullable=False)), ("id",)),
        Table("Orders", (Column("id", INT), Column("customer_id", INT, nullable=False)), ("id",)),
    )
)


@pytest.fixture(scope="module")
def places(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("q")
    spark.createDataFrame([(i, "retail" if i % 2 else "business") for i in range(300)], "id bigint, category string").write.parquet(f"{root}/c")
    spark.createDataFrame([(i, i % 300) for i in range(600)], "id bigint, customer_id bigint").write.parquet(f"{root}/o")
    return {"Customers": f"{root}/c", "Orders": f"{root}/o"}


@pytest.mark.parametrize(
    "text",
    [
        "DROP VIEW Customers",
        "INSERT INTO Customers VALUES (1, 'retail')",
        "UPDATE Customers SET id = 1",
        "DELETE FROM Customers",
        "CREATE TABLE x AS SELECT 1",
        "SELECT 1; SELECT 2",
        "SELECT 1) AS a; DROP VIEW Customers; SELECT * FROM (SELECT 1",
        "SET spark.sql.ansi.enabled=false",
        "CACHE TABLE Customers",
        "EXPLAIN SELECT 1",
        "SELECT * FROM secrets",
        "SELECT * FROM other.Customers",
        "SELECT * FROM parquet.`/tmp`",
        "SELECT reflect('java.lang.System', 'exit', 1)",
        "SELECT `java_method`('java.lang.System', 'exit', 1)",
        "SELECT id INTO copy FROM Customers",
        "not sql at all",
        "",
    ],
)
def test_guard_refuses(spark, places, text):
    with pytest.raises(QueryError):
        guarded_select(spark, QUERY_SPEC, places, text).collect()


def test_guard_accepts_cte_join_and_caps_rows(spark, places):
    spark.range(3).createOrReplaceTempView("secrets")
    text = 'WITH r AS (SELECT "id" FROM customers WHERE category = \'retail\') SELECT count(*) AS n FROM r JOIN Orders o ON o.customer_id = r.id;'
    assert guarded_select(spark, QUERY_SPEC, places, text).collect() == [(300,)]
    assert guarded_select(spark, QUERY_SPEC, places, "SELECT * FROM Orders").count() == 200
    assert guarded_select(spark, QUERY_SPEC, places, "SELECT * FROM Orders LIMIT 5").count() == 5
    assert guarded_select(spark, QUERY_SPEC, places, "SELECT * FROM Orders LIMIT 900", 1000).count() == 600
    for cap in (0, 1001):
        with pytest.raises(QueryError):
            guarded_select(spark, QUERY_SPEC, places, "SELECT 1", cap)


# --- graphs ------------------------------------------------------------------


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def test_levels_components_and_groups(spark):
    graph_edges = edges(spark, ("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("e", "e"), ("f", "a"), ("g", "h"), ("h", "i"), ("i", "g"), ("i", "h"))
    groups = {r["node"]: (r["component"], r["level"]) for r in graph.dependency_groups(graph_edges).collect()}
    assert groups == {
        "a": ("a", 2), "b": ("b", 1), "c": ("b", 1), "d": ("d", 0), "e": ("e", 0), "f": ("f", 3), "g": ("g", 0), "h": ("g", 0), "i": ("g", 0),
    }
    cyclic = {(r["node"], r["component"]) for r in graph.cycles(graph_edges).collect()}
    assert cyclic == {("b", "b"), ("c", "b"), ("e", "e"), ("g", "g"), ("h", "g"), ("i", "g")}
    with pytest.raises(graph.CycleError):
        graph.levels(graph_edges)
    deep = graph.levels(edges(spark, ("a", "b"), ("b", "c"), ("a", "c")))
    assert {tuple(r) for r in deep.collect()} == {("a", 2), ("b", 1), ("c", 0)}


def brute_levels(pairs):
    out = {}

    def level(node):
        if node not in out:
            out[node] = max((1 + level(d) for s, d in pairs if s == node), default=0)
        return out[node]

    for pair in pairs:
        for node in pair:
            level(node)
    return out


def brute_components(pairs):
    nodes = {n for p in pairs for n in p}
    reach = {n: {n} for n in nodes}
    while True:
        grown = {n: reach[n] | {x for s, d in pairs if s == n for x in reach[d]} for n in nodes}
        if grown == reach:
            return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
        reach = grown


@pytest.mark.parametrize(("seed", "plain"), [(0, 1), (1, 4)])
def test_graphs_of_runs_against_brute_force(spark, monkeypatch, seed, plain):
    """Random graphs whose edges are runs of different lengths."""
    monkeypatch.setattr(graph, "PLAIN_ROUNDS", plain)
    rng = random.Random(seed)
    acyclic, cyclic = [], []
    for n in range(14):
        a, b = sorted(rng.sample(range(9), 2))
        run = [f"v{a}", *[f"r{n}-{k}" for k in range(rng.choice([0, 1, 2, 7]))], f"v{b}"]
        acyclic += list(zip(run, run[1:]))
        if rng.random() < 0.4:
            run = [rng.choice(run)] * 2 if rng.random() < 0.2 else run[::-1]
        cyclic += list(zip(run, run[1:]))
    acyclic += [("head", "v0"), ("head", "v1"), ("tail-2", "tail-1"), ("tail-1", "v2"), ("v8", "last")]
    cyclic += [(f"c{k}", f"c{(k + 1) % 5}") for k in range(5)] + [("v1", "loop-a"), ("loop-a", "loop-b"), ("loop-b", "v1")]
    assert {r["node"]: r["level"] for r in graph.levels(edges(spark, *acyclic)).collect()} == brute_levels(acyclic)
    assert {r["node"]: r["component"] for r in graph.components(edges(spark, *cyclic)).collect()} == brute_components(cyclic)
    with pytest.raises(graph.CycleError):
        graph.levels(edges(spark, *cyclic))


def test_a_long_path_and_a_long_circle_take_few_rounds(spark, monkeypatch):
    steps = []
    original = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df: (steps.append(1), original(df))[1])
    path = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(600)]
    assert {r["node"]: r["level"] for r in graph.levels(edges(spark, *path)).collect()} == {f"n{i:04d}": 600 - i for i in range(601)}
    circle = [(f"n{i:04d}", f"n{(i + 1) % 600:04d}") for i in range(600)]
    assert {r["component"] for r in graph.components(edges(spark, *circle)).collect()} == {"n0000"}
    assert len(steps) < 90


def test_fixture_dependency_graph(spark):
    from fixtures import LIBRARY

    pairs = [(t.name, fk.parent) for t in LIBRARY.tables for fk in t.foreign_keys]
    groups = {r["node"]: (r["component"], r["level"]) for r in graph.dependency_groups(edges(spark, *pairs)).collect()}
    circle = {n for n, (c, _) in groups.items() if c == "Departments"}
    assert circle == {"Departments", "Employees", "Library_Branches"}
    assert (groups["Books"][1], groups["Book_Inventory"][1], groups["Book_Loans"][1]) == (1, 2, 3)


def test_row_rules_run_on_a_stream(spark, tmp_path):
    from rowsmith.operators.validate import row_violations

    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 5), (2, 0)], "id bigint, n bigint").write.parquet(source)
    t = Table("t", (Column("id", INT), Column("n", INT)), ("id",), checks=(cmp(col("n"), ">", 0), SqlCheck("n < 100")))
    stream = spark.readStream.schema("id bigint, n bigint").parquet(source)
    query = row_violations(t, stream).writeStream.format("memory").queryName("bad_rows").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [r["row_key"] for r in spark.table("bad_rows").collect()] == ["2"]
