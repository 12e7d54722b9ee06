"""One key holds a third of all rows: results stay whole on every path."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F
from rowsmith.operators import shared
from rowsmith.operators import validate as v
from rowsmith.spec import INT, VARCHAR, Column, DatasetSpec, ForeignKey, Table

ROWS = 6000


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    """Every broadcast limit at zero, so the large-data paths run."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(shared, "_hot_parts", lambda spark: 5)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def rows(spark):
    key = "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 700 END"
    return spark.range(ROWS).selectExpr("id", f"{key} AS k", f"concat('word ', {key}) AS t")


TABLE = Table(
    "t",
    (Column("id", INT), Column("k", INT), Column("t", VARCHAR(500))),
    ("id",),
    (("t",),),
    (ForeignKey(("k",), "p", ("k",)),),
)
PARENT = Table("p", (Column("k", INT),), ("k",))


def repeats():
    keys = [0 if i % 3 == 0 else i % 700 for i in range(ROWS)]
    seen, out = set(), []
    for i, k in enumerate(keys):
        if k in seen:
            out.append(str(i))
        seen.add(k)
    return keys, out


@pytest.mark.parametrize("large", [False, True])
def test_unique_repeats_of_a_hot_key(spark, large, request):
    if large:
        request.getfixturevalue("no_broadcast")
    got = v.unique_duplicate(TABLE, rows(spark), ["t"])
    assert sorted(r["row_key"] for r in got.collect()) == sorted(repeats()[1])


def test_primary_key_repeats_of_a_hot_key_are_counted_not_gathered(spark):
    table = Table("t", (Column("k", INT),), ("k",))
    got = v.primary_key_duplicate(table, rows(spark).select("k"))
    expected = Counter({str(k): n - 1 for k, n in Counter(repeats()[0]).items() if n > 1})
    assert Counter(r["row_key"] for r in got.collect()) == expected
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_copies_cross_chunk_borders(spark, monkeypatch):
    monkeypatch.setattr(shared, "COPY_CHUNK", 7)
    df = spark.createDataFrame([("a", 20), ("b", 7), ("c", 1), ("d", 0)], "k string, n bigint")
    assert Counter(r["k"] for r in shared.repeat_rows(df, "n", ["k"]).collect()) == Counter(a=20, b=7, c=1)


def test_rows_that_cannot_be_told_apart(spark):
    table = Table("t", (Column("id", INT), Column("u", INT)), ("id",), (("u",),))
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 5), (2, 5), (3, 6), (None, 5)], "id bigint, u bigint")
    got = v.unique_duplicate(table, df, ["u"]).collect()
    assert Counter(r["row_key"] for r in got) == Counter({"1": 2, "2": 1, "NULL": 1})


@pytest.mark.parametrize("large", [False, True])
def test_missing_parent_of_a_hot_key(spark, large, request):
    if large:
        request.getfixturevalue("no_broadcast")
    parents = spark.range(1, 700).where("id % 2 = 0").withColumnRenamed("id", "k")
    spec = DatasetSpec((TABLE, PARENT))
    got = v.foreign_key_missing(spec.table("t"), rows(spark), spec.table("t").foreign_keys[0], parents)
    expected = [str(i) for i, k in enumerate(repeats()[0]) if k == 0 or k % 2]
    assert sorted(r["row_key"] for r in got.collect()) == sorted(expected)


def test_many_keys_that_are_warm_but_not_hot(spark, no_broadcast):
    """5,000 keys with 0.02 % of the rows each: none is hot by share, and no list of hot keys is cut."""
    table = Table("t", (Column("id", INT), Column("t", VARCHAR(500))), ("id",), (("t",),))
    df = spark.range(25_000).selectExpr("id", "concat('key ', id % 5000) AS t")
    got = v.unique_duplicate(table, df, ["t"])
    assert got.count() == got.distinct().count() == 20_000
    assert got.agg(F.min(F.col("row_key").cast("long"))).first()[0] == 5_000
    assert shared.heavy_keys(df, ["t"]).isEmpty()


def test_heavy_keys_are_found_by_a_summary(spark, monkeypatch):
    monkeypatch.setattr(shared, "_hot_parts", lambda spark: 16)
    # A third of the rows under one key, a ninth under another, among many; NULL is a key of its own.
    df = spark.range(90_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 9 = 1 THEN NULL ELSE id END AS a", "CASE WHEN id % 3 = 0 THEN 'x' WHEN id % 9 = 1 THEN 'y' ELSE 'z' END AS b"
    )
    assert sorted(tuple(r) for r in shared.heavy_keys(df, ["a", "b"]).collect() if r["a"]) == [(7, "x")]


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_even_join_with_hot_keys(spark, no_broadcast, how):
    keyed = spark.range(0, 700, 2).selectExpr("id AS k", "id * 10 AS v")
    got = shared.even_join(rows(spark).select("id", "k"), keyed, ["k"], how)
    want = rows(spark).select("id", "k").join(keyed, "k", how)
    assert Counter(tuple(r) for r in got.select(*sorted(got.columns)).collect()) == Counter(tuple(r) for r in want.select(*sorted(want.columns)).collect())


def test_clean_tables_are_read_twice_and_not_matched_back(spark, tmp_path):
    """Two scans a table, and no third one where nothing is broken."""
    spark.range(500).selectExpr("id", "id AS k", "concat('w', id) AS t").write.parquet(str(tmp_path / "t"))
    spark.range(500).selectExpr("id AS k").write.parquet(str(tmp_path / "p"))
    data = {n: spark.read.parquet(str(tmp_path / n)) for n in ("t", "p")}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    read = []
    try:
        original = v.materialize
        v.materialize = lambda df: (read.append(df._jdf.queryExecution().executedPlan().toString()), original(df))[1]
        found = v.validate(spark, DatasetSpec((TABLE, PARENT)), data)
        rest = found._jdf.queryExecution().executedPlan().toString()
        assert found.isEmpty()
    finally:
        v.materialize = original
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(read) == 1 and read[0].count("FileScan") == 2 and rest.count("FileScan") <= 2


@pytest.mark.parametrize("large", [False, True])
def test_keys_of_every_type_count_as_they_are(spark, large, request):
    """Parts of a key cannot run into each other, and equal values are one key whatever their type."""
    if large:
        request.getfixturevalue("no_broadcast")
    columns = (Column("id", INT), Column("a", VARCHAR(10)), Column("b", VARCHAR(10)), Column("n", INT), Column("m", INT), Column("o", INT))
    table = Table("t", columns, ("id",), (("a", "b"), ("n", "m", "o"), ("a", "n")))
    data = [(1, "1:x", "y", 1, 2, 3), (2, "1", "x1:y", 1, 2, 4), (3, "1:x", "y", 1, 2, 3), (4, "", "1:x", 2, 1, 3), (5, "1:x", "", None, 2, 3), (6, "1:x", "", 9, 2, 3)]
    df = spark.createDataFrame(data, "id long, a string, b string, n int, m long, o short")
    found = v.validate(spark, DatasetSpec((table,)), {"t": df}).where("kind = 'unique_duplicate'").collect()
    assert Counter((r["row_key"], r["message"]) for r in found) == Counter(
        [("3", "t: unique (a, b) stands in more than one row"), ("6", "t: unique (a, b) stands in more than one row"),
         ("3", "t: unique (n, m, o) stands in more than one row"), ("3", "t: unique (a, n) stands in more than one row")]
    )


def test_foreign_keys_between_types_that_differ(spark, no_broadcast):
    child = Table("c", (Column("id", INT), Column("p", INT)), ("id",), foreign_keys=(ForeignKey(("p",), "p", ("k",)),))
    children = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id long, p int")
    for kind in ("long", "decimal(10,2)", "short"):
        parents = spark.sql(f"SELECT CAST(5 AS {kind}) AS k")
        assert [r["row_key"] for r in v.foreign_key_missing(child, children, child.foreign_keys[0], parents).collect()] == ["2"]


def test_foreign_key_to_a_column_that_repeats(spark, no_broadcast):
    child = Table("c", (Column("id", INT), Column("t", VARCHAR(500))), ("id",), foreign_keys=(ForeignKey(("t",), "t", ("t",)),))
    parent = Table("t", TABLE.columns, ("id",))
    spec = DatasetSpec((child, parent))
    children = spark.createDataFrame([(1, "word 0"), (2, "word 9999"), (3, None)], "id bigint, t string")
    got = v.foreign_key_missing(spec.table("c"), children, spec.table("c").foreign_keys[0], rows(spark))
    assert [r["row_key"] for r in got.collect()] == ["2"]


def test_summary_limits_rows_before_its_shuffle(spark):
    found = rows(spark).select(
        F.when(F.col("id") >= 0, "kind").alias("kind"), F.lit("t").alias("table_name"), F.lit(None).cast("string").alias("column_name"), F.col("t").alias("row_key"), F.lit("m").alias("message")
    )
    summary = v.summarize(found)
    assert summary.first()["violations"] == ROWS
    assert "WindowGroupLimit" in summary._jdf.queryExecution().executedPlan().toString()


def test_row_rules_read_only_their_columns_once(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(100).selectExpr("id", "id AS a", "id AS b", "repeat('x', 50) AS unused").write.parquet(path)
    from rowsmith.functions.checks import cmp, col

    table = Table("w", (Column("id", INT), Column("a", INT), Column("b", INT), Column("unused", VARCHAR(500))), ("id",), checks=(cmp(col("a"), ">", 5), cmp(col("b"), ">", 7)))
    got = v.row_violations(table, spark.read.parquet(path), kinds=["check_failed"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "unused" not in plan.split("ReadSchema")[1]
    assert got.count() == 14


def test_checkpoint_folder_is_taken_from_the_session(spark):
    folder = shared.checkpoint_dir(spark)
    assert folder == spark.sparkContext.getCheckpointDir()


def test_graph_steps_on_the_large_path(spark, no_broadcast):
    from rowsmith.operators import graph

    pairs = [(f"leaf{i:03d}", "hub") for i in range(200)] + [("hub", "root"), ("root", "hub"), ("root", "base")]
    groups = graph.dependency_groups(spark.createDataFrame(pairs, "src string, dst string"))
    found = {r["node"]: (r["component"], r["level"]) for r in groups.collect()}
    assert found["base"] == ("base", 0) and found["hub"] == found["root"] == ("hub", 1)
    assert len(found) == 203 and all(found[f"leaf{i:03d}"] == (f"leaf{i:03d}", 2) for i in range(200))
