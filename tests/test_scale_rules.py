"""Rules that must hold alike on both sides of a size limit, and the guard against foreign tables."""

from decimal import Decimal

import pytest

from rowsmith.functions.checks import cmp, col
from rowsmith.operators.edit import EditError, Regenerate, Transform, apply_edits
from rowsmith.operators.generate import Generator, generate
from rowsmith.operators.numbering import dense_index, number_within
from rowsmith.operators.validate import raw_violations, unique_capacity, validate
from rowsmith.plans.select import QueryError, guarded_select
from rowsmith.sources.store import read_csv, write_csv
from rowsmith.spec import DATE, DECIMAL, ENUM, INT, VARCHAR, Column, DatasetSpec, ForeignKey, Table


def test_rows_without_a_group_are_numbered_in_blocks_too(spark):
    df = spark.range(20).selectExpr("id", "IF(id % 2 = 0, id % 4, NULL) AS g")
    both = [sorted(map(tuple, number_within(df, ["g"], "id", 20, "n", block_rows=b).select("id", "n").collect())) for b in (100, 5)]
    assert len(both[0]) == 20 and both[0] == both[1]


def test_capacity_does_not_overflow(spark):
    df = spark.range(4_000_000).selectExpr("id AS a", "id AS b", "id AS c")
    row = unique_capacity(df, "t", ["a", "b", "c"]).first()
    assert row["fits"] and row["capacity"] == 2**63 - 1


@pytest.fixture
def spec():
    return DatasetSpec((Table("pets", (Column("id", INT), Column("name", VARCHAR(40))), ("id",)),))


def test_guard_does_not_read_the_text_of_a_plan(spark, spec, tmp_path):
    """A long plan whose text is cut, and literals that look like parts of a plan."""
    path = str(tmp_path / "pets")
    spark.range(3).selectExpr("CAST(id AS INT) AS id", "'x' AS name").write.parquet(path)
    spark.sql(f"CREATE TABLE IF NOT EXISTS psecret (id INT) USING parquet LOCATION '{tmp_path}/secret'")
    before = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", "4000")
    try:
        many = "UNION ALL SELECT id FROM pets WHERE id < 0 " * 60
        for secret in ("psecret", "global_temp.gsecret"):
            spark.range(1).createOrReplaceGlobalTempView("gsecret")
            with pytest.raises(QueryError):
                guarded_select(spark, spec, {"pets": path}, f"SELECT id FROM pets WHERE id < 0 {many} UNION ALL SELECT id + 100 FROM {secret}")
        assert guarded_select(spark, spec, {"pets": path}, f"SELECT id FROM pets WHERE id < 0 {many}").count() == 0
        for word in ("RelationV2", "HiveTableRelation", "SubqueryAlias a.b", "reflect"):
            assert guarded_select(spark, spec, {"pets": path}, f"SELECT '{word}' AS w, count(*) AS n FROM pets").collect() == [(word, 3)]
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", before)
        spark.catalog.dropGlobalTempView("gsecret")
        spark.sql("DROP TABLE psecret")


@pytest.mark.parametrize(
    "text",
    [
        "TABLE pets",
        "FROM pets |> SELECT id",
        "SELECT * FROM VALUES (1), (2)",
        "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 3) SELECT * FROM t",
        "SELECT name, count(*), grouping(name) FROM pets GROUP BY CUBE(name) HAVING count(*) > 0 ORDER BY 1 LIMIT 3 OFFSET 1",
        "SELECT DISTINCT name, rank() OVER (ORDER BY id) AS r FROM pets TABLESAMPLE (50 PERCENT)",
        "SELECT id FROM pets INTERSECT SELECT id FROM pets EXCEPT ALL SELECT 5",
        "SELECT * FROM pets UNPIVOT (v FOR c IN (id))",
        "SELECT * FROM pets PIVOT (count(name) FOR id IN (1, 2))",
        "SELECT * FROM pets LATERAL VIEW explode(array(1)) t AS z",
        "SELECT * FROM pets p, LATERAL (SELECT p.id + 1 AS j)",
        "SELECT /*+ REPARTITION(3) */ id FROM pets DISTRIBUTE BY id SORT BY id",
        "SELECT (SELECT count(*) FROM pets q WHERE q.id < p.id) AS n FROM pets p",
    ],
)
def test_guard_lets_selects_of_every_form_through(spark, spec, tmp_path, text):
    path = str(tmp_path / "pets")
    spark.range(3).selectExpr("CAST(id AS INT) AS id", "'x' AS name").write.parquet(path)
    guarded_select(spark, spec, {"pets": path}, text).collect()


def test_guard_knows_only_the_dataset(spark, spec, tmp_path):
    path = str(tmp_path / "pets")
    spark.range(3).selectExpr("CAST(id AS INT) AS id", "'x' AS name").write.parquet(path)
    spark.range(1).createOrReplaceGlobalTempView("gsecret")
    spark.sql(f"CREATE TABLE IF NOT EXISTS psecret (id INT) USING parquet LOCATION '{tmp_path}/secret'")
    try:
        for text in (
            "SELECT * FROM global_temp.gsecret", "SELECT * FROM psecret", "SELECT * FROM spark_catalog.default.psecret",
            "WITH psecret AS (SELECT * FROM psecret) SELECT * FROM psecret", "SELECT * FROM pets WHERE id IN (SELECT id FROM psecret)",
            "SELECT (SELECT max(id) FROM global_temp.gsecret) AS m FROM pets",
            "SELECT * FROM pets WHERE EXISTS (SELECT 1 FROM pets q WHERE q.id IN (SELECT id FROM psecret))",
            "SELECT * FROM pets, LATERAL (SELECT id AS z FROM psecret)",
            "SELECT transform(name) USING 'cat' FROM pets",
            "SELECT builtin.reflect('java.lang.System', 'currentTimeMillis')",
            "SELECT session.try_reflect('java.lang.System', 'currentTimeMillis')",
        ):
            with pytest.raises(QueryError):
                guarded_select(spark, spec, {"pets": path}, text)
        assert guarded_select(spark, spec, {"pets": path}, "WITH p AS (SELECT * FROM pets) SELECT count(*) AS n FROM p JOIN pets AS q USING (id)").first()["n"] == 3
    finally:
        spark.catalog.dropGlobalTempView("gsecret")
        spark.sql("DROP TABLE psecret")


def test_csv_keeps_spaces_and_plain_decimals(spark, tmp_path):
    table = Table("t", (Column("id", INT), Column("s", VARCHAR(40)), Column("d", DECIMAL(12, 8))), ("id",))
    rows = [(1, "  lead and trail  ", Decimal("0.00000012")), (2, 'a "quote", and\nbreak', Decimal("0.00000000")), (3, None, None)]
    df = spark.createDataFrame(rows, "id int, s string, d decimal(12,8)").coalesce(1)
    write_csv(table, df, str(tmp_path / "t.csv"))
    text = "".join(p.read_text() for p in (tmp_path / "t.csv").glob("part-*"))
    assert "0.00000012" in text and "E-" not in text
    assert sorted(map(tuple, read_csv(spark, table, str(tmp_path / "t.csv")).collect())) == rows


def test_dense_index_follows_the_order_in_any_number_of_blocks(spark):
    df = spark.range(200).selectExpr("id", "IF(id % 10 = 3, NULL, CAST(pmod(id * 7, 31) AS STRING)) AS s")
    both = [sorted(map(tuple, dense_index(df, ["s"], "n", 200, ["id"], block_rows=b).select("n", "id").collect())) for b in (1_000, 7)]
    assert [n for n, _ in both[0]] == list(range(200)) and both[0] == both[1]


def test_wide_combinations_differ_and_spread(spark):
    one = Table("one", (Column("id", INT),), ("id",))
    maker = Generator(spark, DatasetSpec((one,)), None, 10, 3)
    for sizes, rows in (((2_000_000_000,) * 3, 1_000), ((10**9, 3, 2, 10**12), 1_000), ((7, 20, 11, 2**62 - 5), 5_000), ((40, 30, 2**62), 2_000)):
        indexes = maker.places(one, "key", sizes, rows)
        found = spark.range(rows).selectExpr(*[f"{f('id')} AS i{k}" for k, f in enumerate(indexes)]).collect()
        assert len(set(found)) == rows
        for k, size in enumerate(sizes):
            values = [r[k] for r in found]
            assert 0 <= min(values) and max(values) < size
            assert len(set(values)) > min(size, rows) * 0.6 and max(values) - min(values) > size * 0.3


def test_junction_of_three_large_parents(spark):
    sides = [Table(f"p{i}", (Column("id", INT),), ("id",)) for i in range(3)]
    link = Table("link", tuple(Column(f"k{i}", INT) for i in range(3)), ("k0", "k1", "k2"),
                 foreign_keys=tuple(ForeignKey((f"k{i}",), f"p{i}", ("id",)) for i in range(3)))
    rows = {"p0": 2_000_000_000, "p1": 2_000_000_000, "p2": 2_000_000_000, "link": 1_000}
    made = generate(spark, DatasetSpec((*sides, link)), rows=rows, seed=1, check=False)["link"].collect()
    assert len(set(made)) == 1_000 and all(len({r[i] for r in made}) > 900 for i in range(3))


def test_a_chain_of_thirty_ordered_columns(spark):
    names = [f"d{i}" for i in range(30)]
    table = Table("t", (Column("id", INT), *(Column(n, DATE) for n in names)), ("id",),
                  checks=tuple(cmp(col(a), "<", col(b)) for a, b in zip(names, names[1:])))
    maker = Generator(spark, DatasetSpec((table,)), None, 50, 1)
    rows = maker.build()["t"].collect()
    assert len(rows) == 50 and all(r[a] < r[b] for r in rows for a, b in zip(names, names[1:]))
    sizes = [len(f("id")) for level in maker.tables["t"].levels for f in level.values()]
    assert len(sizes) == 30 and max(sizes) < 2 * sizes[1]


def test_edits_judge_only_their_own_table(spark):
    big = Table("big", (Column("id", INT), Column("v", INT)), ("id",))
    small = Table("small", (Column("k", ENUM("a", "b")),), ("k",))
    data = {"big": spark.range(10).selectExpr("CAST(id AS INT) AS id", "0 AS v"), "small": spark.createDataFrame([("a",)], "k string")}
    made = apply_edits(spark, DatasetSpec((big, small)), data, [Regenerate("big", ("v",))], seed=4)["big"]
    assert made.count() == 10


@pytest.mark.parametrize(
    "value, by, fine",
    [("1.00", "0.50000001", False), ("2.00", "0.5000000000", True), ("100000000.00", "0.50000001", True), ("0.00", "0.50000001", True),
     ("999999999999999999999999999999999999.99", "1000", False), (None, "0.50000001", True)],
)
def test_decimal_products_are_exact_or_reported(spark, value, by, fine):
    table = Table("t", (Column("id", INT), Column("d", DECIMAL(38, 2))), ("id",))
    df = spark.createDataFrame([(1, None if value is None else Decimal(value))], "id int, d decimal(38,2)")
    edit = [Transform("t", "d", "multiply", Decimal(by))]
    if fine:
        got = apply_edits(spark, DatasetSpec((table,)), {"t": df}, edit)["t"].first()["d"]
        assert got == (None if value is None else Decimal(value) * Decimal(by))
    else:
        with pytest.raises(EditError):
            apply_edits(spark, DatasetSpec((table,)), {"t": df}, edit)


def found(df):
    return sorted((r["kind"], r["table_name"], r["column_name"]) for r in df.collect())


def test_an_absent_key_column_is_reported(spark):
    table = Table("t", (Column("id", INT, nullable=False), Column("u", INT)), ("id",))
    df = spark.createDataFrame([(1,), (2,)], "u int")
    kinds = {k for k, _, _ in found(validate(spark, DatasetSpec((table,)), {"t": df}))}
    assert kinds == {"missing_column", "primary_key_null"}


def test_letter_case_of_columns_does_not_matter(spark):
    parent = Table("p", (Column("Pid", INT),), ("Pid",))
    child = Table("c", (Column("Id", INT), Column("U", INT, unique=True), Column("Ref", INT)), ("Id",), foreign_keys=(ForeignKey(("Ref",), "p", ("Pid",)),))
    data = {"p": spark.createDataFrame([(1,), (1,)], "pid int"), "c": spark.createDataFrame([(1, 5, 1), (2, 5, 9)], "id int, u int, ref int")}
    assert found(validate(spark, DatasetSpec((parent, child)), data)) == [
        ("foreign_key_missing", "c", "Ref"), ("primary_key_duplicate", "p", "Pid"), ("unique_duplicate", "c", "U")
    ]


def test_a_parent_without_the_referenced_column_matches_nothing(spark):
    parent = Table("p", (Column("pid", INT), Column("x", INT)), ("pid",))
    child = Table("c", (Column("id", INT), Column("r", INT)), ("id",), foreign_keys=(ForeignKey(("r",), "p", ("pid",)),))
    data = {"p": spark.createDataFrame([(1,)], "x int"), "c": spark.createDataFrame([(1, 1), (2, None)], "id int, r int")}
    assert ("foreign_key_missing", "c", "r") in found(validate(spark, DatasetSpec((parent, child)), data))


@pytest.mark.parametrize(
    "text, kinds",
    [("1.50", []), ("-001.5000000000000000000000000000000000000000", []), ("1.0000000001", ["decimal_precision"]), ("1234.5", ["decimal_precision"]),
     ("9" * 36, ["decimal_precision"]), ("9" * 50, ["decimal_precision"]), ("1e3", ["type_mismatch"]), ("", ["type_mismatch"])],
)
def test_decimal_text_is_judged_by_its_digits(spark, text, kinds):
    table = Table("t", (Column("d", DECIMAL(5, 2)),), ())
    df = spark.createDataFrame([(1, '{"d": "%s"}' % text)], "n int, raw string")
    assert [r["kind"] for r in raw_violations(table, df, "raw", ["n"]).collect()] == kinds
