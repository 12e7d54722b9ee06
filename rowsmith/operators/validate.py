"""Find every violation of a dataset spec.

All operators return the same columns: kind, table_name, column_name, row_key
and message. Row rules cost one scan per table; keys cost one aggregation per
group of columns; foreign keys cost one join.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.functions.checks import (
    Node,
    Operand,
    Outcome,
    SqlCheck,
    UnsupportedCheck,
    evaluate,
    node_text,
    resolve,
    sql_outcome,
    with_sql,
)
from rowsmith.functions.text import any_of, lit, name, names, not_null, sql_type, text
from rowsmith.operators.shared import (
    broadcasts_by_itself,
    fits,
    literal_rows,
    materialize,
    narrow_key,
    repeat_rows,
    rows_of_groups,
    rows_of_measured,
    written,
)
from rowsmith.spec import Column as SpecColumn
from rowsmith.spec import DatasetSpec, ForeignKey, Table

FIELDS = ("kind", "table_name", "column_name", "row_key", "message")
VIOLATION_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])


class DataValidationError(ValueError):
    """A dataset violates its spec. `violations` is the DataFrame with all of them."""

    def __init__(self, text: str, violations: DataFrame) -> None:
        super().__init__(text)
        self.violations = violations


# --- naming rows -------------------------------------------------------------


def row_key(columns: Sequence[str]) -> str:
    """SQL naming a row by the text of its locating columns, NULL shown as NULL."""
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST({name(c)} AS STRING), 'NULL')" for c in columns) + ")"


def locator_of(table: Table, df: DataFrame, locators: Mapping[str, Sequence[str]] | None) -> list[str]:
    """The columns that name a row: as given, else the key columns that are there, else every column."""
    chosen = (locators or {}).get(table.name) or table.primary_key
    present = {c.casefold() for c in df.columns}
    return [c for c in chosen if c.casefold() in present] or list(df.columns)


def declared_names(table: Table, df: DataFrame) -> DataFrame:
    """The same rows with column names in the letter case of the spec."""
    declared = {c.name.casefold(): c.name for c in table.columns}
    wanted = [declared.get(c.casefold(), c) for c in df.columns]
    return df if wanted == df.columns else df.selectExpr(*[f"{name(c)} AS {name(w)}" for c, w in zip(df.columns, wanted)])


def referenced(parent_table: Table, parent: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A parent under the spec's names; a referenced column that it lacks counts as NULL, so it matches nothing."""
    parent = declared_names(parent_table, parent)
    absent = [c for c in columns if c not in parent.columns]
    nulls = [f"CAST(NULL AS {sql_type(parent_table.column(c).type.spark_type())}) AS {name(c)}" for c in absent]
    return parent.selectExpr("*", *nulls) if absent else parent


def _violation(kind: str, table: Table, column: str | None, message: str, key: str) -> list[str]:
    return [
        f"{lit(kind)} AS kind",
        f"{lit(table.name)} AS table_name",
        f"{text(column)} AS column_name",
        f"{key} AS row_key",
        f"{lit(message)} AS message",
    ]


def _single(columns: Sequence[str]) -> str | None:
    return columns[0] if len(columns) == 1 else None


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


# --- row rules ---------------------------------------------------------------


class Rule:
    """One row rule: when it is broken, and what to report. Conditions are SQL."""

    def __init__(self, kind: str, column: str | None, message: str, broken: str, dynamic: bool = False) -> None:
        self.kind, self.column, self.broken = kind, column, broken
        self.message = message if dynamic else lit(message)

    def report(self) -> str:
        return (
            f"CASE WHEN {self.broken} THEN named_struct('kind', {lit(self.kind)}, "
            f"'column_name', {text(self.column)}, 'message', {self.message}) END"
        )


def matches_type(declared: SpecColumn, physical: T.DataType) -> bool:
    """Whether a physical column type can hold values of the declared type."""
    kind = declared.type.name
    if kind == "INT":
        return isinstance(physical, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if kind == "DATETIME":
        return isinstance(physical, (T.TimestampType, T.TimestampNTZType))
    if kind in ("VARCHAR", "TEXT", "ENUM"):
        return isinstance(physical, T.StringType)
    expected = {"DECIMAL": T.DecimalType, "DATE": T.DateType, "BOOLEAN": T.BooleanType}[kind]
    return isinstance(physical, expected)


def value_rules(table: Table, column: SpecColumn, value: str, physical: T.DataType | None = None) -> list[Rule]:
    """Length, precision and domain of one column whose type is right.

    NULL breaks none of them. A physical decimal that cannot hold a misfit is
    not examined at all.
    """
    where = f"{table.name}.{column.name}"
    kind = column.type
    if kind.name == "VARCHAR":
        return [Rule("varchar_length", column.name, f"{where} is longer than {kind}", f"char_length({value}) > {kind.length}")]
    if kind.name == "DECIMAL":
        scale = kind.scale or 0
        if isinstance(physical, T.DecimalType):
            whole = physical.precision - physical.scale
            if physical.scale <= scale and whole <= kind.precision - scale:
                return []
        broken = too_wide(value, kind.precision, scale)
        return [Rule("decimal_precision", column.name, f"{where} does not fit {kind}", broken)]
    if kind.name == "ENUM":
        listed = ", ".join(lit(v) for v in kind.values)
        return [Rule("enum_value", column.name, f"{where} is none of the values listed for it", f"{value} NOT IN ({listed})")]
    return []


def too_wide(value: str, precision: int, scale: int) -> str:
    """More decimal places than `scale`, or more integer digits than fit."""
    places = f"{value} <> round({value}, {scale})"
    if precision - scale >= 38:
        return places
    return f"{places} OR abs({value}) >= 1{'0' * (precision - scale)}BD"


def typed_rules(table: Table, df: DataFrame) -> list[Rule]:
    """Row rules of a table whose columns already have physical types."""
    physical = {f.name.casefold(): f for f in df.schema.fields}
    rules: list[Rule] = []
    operands: dict[str, Operand] = {}
    for given in df.columns:
        if not table.has_column(given):
            message = f"{table.name} has column {given!r} that is not in the spec"
            rules.append(Rule("unknown_column", given, message, "TRUE"))
    for column in table.columns:
        field = physical.get(column.name.casefold())
        typed_null = f"CAST(NULL AS {sql_type(column.type.spark_type())})"
        if field is None:
            operands[column.name] = Operand(comparable(column, typed_null), "TRUE")
            if not column.nullable and column.default is None:
                rules.append(_missing(table, column, "TRUE"))
            continue
        value = name(field.name)
        if not column.nullable:
            rules.append(_null(table, column, f"{value} IS NULL"))
        if matches_type(column, field.dataType):
            operands[column.name] = Operand(comparable(column, value), f"{value} IS NULL")
            rules.extend(value_rules(table, column, value, field.dataType))
        else:
            rules.append(_mistyped(table, column, f"{value} IS NOT NULL"))
            operands[column.name] = Operand(comparable(column, typed_null), f"{value} IS NULL", f"{value} IS NOT NULL")
    if table.primary_key:
        rules.append(key_null_rule(table, [c for c in table.primary_key if c.casefold() not in physical]))
    return rules + check_rules(table, operands, supported_checks(table, df)[0])


def comparable(column: SpecColumn, value: str) -> str:
    """A value as checks compare it: booleans count as the numbers 0 and 1."""
    return f"CAST({value} AS INT)" if column.type.name == "BOOLEAN" else value


def _missing(table: Table, column: SpecColumn, broken: str) -> Rule:
    return Rule("missing_column", column.name, f"{table.name}: {column.name!r} has no default and is absent", broken)


def _null(table: Table, column: SpecColumn, broken: str) -> Rule:
    return Rule("not_null", column.name, f"{table.name}.{column.name} may not be NULL", broken)


def _mistyped(table: Table, column: SpecColumn, broken: str) -> Rule:
    return Rule("type_mismatch", column.name, f"{table.name}.{column.name} is not {column.type}", broken)


Check = tuple[str | None, Node, str]
Refusal = tuple[str | None, str, str]


def supported_checks(table: Table, df: DataFrame | None = None) -> tuple[list[Check], list[Refusal]]:
    """Split the row checks into resolved ones and refused ones with a reason."""
    columns = {c.name.casefold(): c for c in table.columns}
    good, refused = [], []
    for column, check in table.row_checks():
        words = node_text(check)
        try:
            node = resolve(check, columns)
            if df is not None:
                with_sql(node, lambda text_node: _require_condition(df, text_node))
            good.append((column, node, words))
        except UnsupportedCheck as error:
            refused.append((column, words, str(error)))
        except AnalysisException as error:
            refused.append((column, words, error.getCondition() or "the expression does not analyse"))
    return good, refused


def _require_condition(df: DataFrame, check: SqlCheck) -> SqlCheck:
    kind = df.select(F.expr(check.text).alias("c")).schema["c"].dataType
    if not isinstance(kind, T.BooleanType):
        raise UnsupportedCheck("the expression is not a condition")
    return check


def check_rules(table: Table, operands: Mapping[str, Operand], checks: Sequence[Check]) -> list[Rule]:
    rules = []
    for column, node, words in checks:
        answer = evaluate(node, lambda c: operands[table.column(c).name])
        rules.append(Rule("check_failed", column, f"{table.name}: the row breaks the rule {words}", answer.failed))
        if answer.unevaluable is not None:
            message = f"{table.name}: the rule {words} has no answer for the row"
            rules.append(Rule("check_unevaluable", column, message, answer.unevaluable))
    return rules


def apply_rules(df: DataFrame, table: Table, rules: Sequence[Rule], locator: Sequence[str]) -> DataFrame:
    """Report every broken rule of every row in one scan.

    Clean rows leave at the filter; only the others build and unroll reports.
    """
    if not rules:
        return literal_rows(df.sparkSession, [], FIELDS)
    reports = ", ".join(r.report() for r in rules)
    hits = df.where(any_of([r.broken for r in rules])).selectExpr(
        f"{row_key(locator)} AS row_key", f"explode(array({reports})) AS _v"
    )
    return hits.where("_v IS NOT NULL").selectExpr(
        "_v.kind AS kind", f"{lit(table.name)} AS table_name", "_v.column_name AS column_name", "row_key", "_v.message AS message"
    )


def row_violations(
    table: Table, df: DataFrame, locator: Sequence[str] | None = None, kinds: Sequence[str] | None = None
) -> DataFrame:
    """Row-level violations of a typed table, all or of some kinds; also runs on a stream."""
    where = list(locator or ()) or locator_of(table, df, None)
    rules = [r for r in typed_rules(table, df) if kinds is None or r.kind in kinds]
    return apply_rules(df, table, rules, where)


# --- rows that still are text ------------------------------------------------

_RAW_FORMS = {
    "INT": r"^[+-]?[0-9]+$",
    "DECIMAL": r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$",
    "DATE": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "DATETIME": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?$",
    "BOOLEAN": r"^(true|false)$",
}


def raw_typed(column: SpecColumn, source: str) -> str:
    """Read text as the declared type, NULL when it has another form.

    DECIMAL is read with some more places than declared; text with digits
    beyond those is NULL here, because its precision is judged on the text.
    """
    form = _RAW_FORMS.get(column.type.name)
    if form is None:
        return source
    if column.type.name == "DECIMAL":
        places = min((column.type.scale or 0) + 6, 38)
        return f"CASE WHEN {source} RLIKE {lit(form)} AND {_places(source)} <= {places} THEN try_cast({source} AS DECIMAL(38, {places})) END"
    else:
        target = sql_type(column.type.spark_type())
    return f"CASE WHEN {source} RLIKE {lit(form)} THEN try_cast({source} AS {target}) END"


def _places(source: str) -> str:
    """Digits after the point of a decimal text, without the zeros at its end."""
    return f"length(regexp_extract({source}, '[.]([0-9]*?)0*$', 1))"


def raw_too_wide(column: SpecColumn, source: str) -> str:
    """A decimal text of the right form whose digits do not fit the declared type."""
    scale = column.type.scale or 0
    whole = f"length(regexp_extract({source}, '^[+-]?0*([0-9]*)', 1))"
    form = f"{source} RLIKE {lit(_RAW_FORMS['DECIMAL'])}"
    return f"({form} AND ({_places(source)} > {scale} OR {whole} > {column.type.precision - scale}))"


def raw_entries(raw: str) -> str:
    """SQL of the members of a JSON object as entries; NULL for anything else."""
    return f"map_entries(from_json({name(raw)}, 'map<string,string>'))"


def raw_violations(table: Table, df: DataFrame, raw: str, locator: Sequence[str]) -> DataFrame:
    """All row-level violations of a table that arrives as one JSON text per row."""
    known = ", ".join(lit(c.name.casefold()) for c in table.columns)
    # Names that differ only in case: the first one counts.
    parsed = df.selectExpr(*[f"{name(c)} AS _l{i}" for i, c in enumerate(locator)], f"{raw_entries(raw)} AS _entries")
    locator = [f"_l{i}" for i in range(len(locator))]
    parsed = parsed.selectExpr("*", "transform(_entries, e -> lower(e.key)) AS _names")
    parsed = parsed.selectExpr(
        "*",
        *[
            f"get(_entries, CAST(array_position(_names, {lit(c.name.casefold())}) AS INT) - 1).value AS _t{i}"
            for i, c in enumerate(table.columns)
        ],
    )
    parsed = parsed.selectExpr("*", *[f"{raw_typed(c, f'_t{i}')} AS _v{i}" for i, c in enumerate(table.columns)])

    mapping = "_entries IS NOT NULL"
    rules = [Rule("row_shape", None, f"{table.name}: the row is no JSON object", "_entries IS NULL")]
    operands: dict[str, Operand] = {}
    for position, column in enumerate(table.columns):
        source, value = f"_t{position}", f"_v{position}"
        present = f"array_contains(_names, {lit(column.name.casefold())})"
        if not column.nullable:
            if column.default is None:
                rules.append(_missing(table, column, f"{mapping} AND NOT {present}"))
            rules.append(_null(table, column, f"{mapping} AND {present} AND {source} IS NULL"))
        wrong = f"({source} IS NOT NULL AND {value} IS NULL)"
        if column.type.name == "DECIMAL":
            rules.append(_mistyped(table, column, f"{source} IS NOT NULL AND NOT {source} RLIKE {lit(_RAW_FORMS['DECIMAL'])}"))
            message = f"{table.name}.{column.name} does not fit {column.type}"
            rules.append(Rule("decimal_precision", column.name, message, raw_too_wide(column, source)))
        elif column.type.name in _RAW_FORMS:
            rules.append(_mistyped(table, column, wrong))
        rules.extend(value_rules(table, column, value) if column.type.name != "DECIMAL" else [])
        operands[column.name] = Operand(comparable(column, value), f"{source} IS NULL", wrong)
    # Text of checks is resolved against the typed values under their declared names.
    typed = parsed.selectExpr(*[f"_v{i} AS {name(c.name)}" for i, c in enumerate(table.columns)])
    checks = supported_checks(table, typed)[0]
    parsed, checks = _raw_outcomes(table, parsed, typed, checks, operands)
    for rule in check_rules(table, operands, checks):
        rules.append(Rule(rule.kind, rule.column, rule.message, f"{mapping} AND ({rule.broken})", dynamic=True))

    strangers = (
        parsed.where("_entries IS NOT NULL")
        .selectExpr(
            *[name(c) for c in locator],
            f"explode(filter(transform(_entries, e -> e.key), k -> lower(k) NOT IN ({known}))) AS _name",
        )
        .selectExpr(
            "'unknown_column' AS kind",
            f"{lit(table.name)} AS table_name",
            "_name AS column_name",
            f"{row_key(locator)} AS row_key",
            f"concat({lit(table.name + ' has column ')}, _name, ' that is not in the spec') AS message",
        )
    )
    return apply_rules(parsed, table, rules, locator).union(strangers)


def _raw_outcomes(
    table: Table, parsed: DataFrame, typed: DataFrame, checks: Sequence[Check], operands: dict[str, Operand]
) -> tuple[DataFrame, list[Check]]:
    """Evaluate SQL text on raw rows: its outcome becomes a column, and the check a comparison with it.

    A value of the wrong type in a column that the text names makes it unevaluable.
    """
    told: list[Check] = []
    texts: dict[str, str] = {}

    def evaluated(check: SqlCheck) -> Outcome:
        wrong = any_of([operands[c].bad for c in named_columns(typed, check.text) if operands[c].bad])
        outcome = f"_c{len(texts)}"
        texts[outcome] = sql_outcome(check.text)
        return Outcome(outcome, wrong)

    for column, node, words in checks:
        told.append((column, with_sql(node, evaluated), words))
    if texts:
        # The declared names stand alone in this projection, whatever the rows' own columns are called.
        values = [f"{name(c)} AS {name('_own_' + c)}" for c in parsed.columns]
        declared = [f"_v{i} AS {name(c.name)}" for i, c in enumerate(table.columns)]
        kept = [f"{name('_own_' + c)} AS {name(c)}" for c in parsed.columns]
        parsed = parsed.selectExpr(*values, *declared).selectExpr(*kept, *[f"{t} AS {o}" for o, t in texts.items()])
    return parsed, told


def named_columns(df: DataFrame, text: str) -> list[str]:
    """The columns of a table that a condition names."""
    named = df.select(F.expr(text))._jdf.queryExecution().analyzed().references().toSeq()
    return [c for c in df.columns if c in {named.apply(i).name() for i in range(named.size())}]


# --- keys --------------------------------------------------------------------


def key_null_rule(table: Table, absent: Sequence[str] = ()) -> Rule:
    """A NULL in the primary key; the message lists the NULL columns. Absent ones are NULL in every row."""
    key = table.primary_key
    listed = ", ".join(lit(c) if c in absent else f"CASE WHEN {name(c)} IS NULL THEN {lit(c)} END" for c in key)
    message = f"concat({lit(table.name + ': parts of the primary key are NULL: ')}, concat_ws(', ', {listed}))"
    return Rule("primary_key_null", _single(key), message, "TRUE" if absent else f"NOT ({not_null(key)})", dynamic=True)


def primary_key_null(table: Table, df: DataFrame, locator: Sequence[str] | None = None) -> DataFrame:
    return apply_rules(df, table, [key_null_rule(table)], locator or table.primary_key)


@dataclass(frozen=True)
class KeyGroup:
    """One key whose entries are counted: a primary key, a unique group, or a foreign key (number below 0)."""

    number: int
    kind: str
    table: Table
    key: tuple[str, ...]
    locator: tuple[str, ...]
    message: str
    parts: tuple[str, str, str]
    counted: bool

    def entry(self, parts: Sequence[str], complete: str, label: str, parent: bool = False) -> str:
        first, second, rest = parts
        return (
            f"struct(CASE WHEN {complete} THEN {self.number} END AS _g, {first} AS _i, {second} AS _j, "
            f"{rest} AS _k, {label} AS _label, {str(parent).upper()} AS _parent)"
        )


KEY = ["_g", "_i", "_j", "_k"]
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def key_parts(df: DataFrame, key: Sequence[str], lengths: Sequence[int | None]) -> tuple[str, str, str]:
    """A key of any columns in three of one type: the first two whole numbers as they are, the rest as text.

    Equal parts mean equal keys. Long texts enter as their digest.
    """
    whole = [c for c in key if isinstance(df.schema[c].dataType, _WHOLE)][:2]
    rest = [_as_text(df, c, n) for c, n in zip(key, lengths) if c not in whole]
    if len(rest) > 1:
        # With its length before it, a text cannot run into its neighbour.
        rest = [f"concat({', '.join(x for r in rest for x in (f'octet_length({r})', lit(':'), r))})"]
    numbers = [f"coalesce(CAST({name(c)} AS BIGINT), 0L)" for c in whole] + ["0L", "0L"]
    return numbers[0], numbers[1], f"coalesce({rest[0]}, '')" if rest else "''"


def _as_text(df: DataFrame, column: str, length: int | None) -> str:
    kind, value = df.schema[column].dataType, name(column)
    if isinstance(kind, T.StringType):
        return narrow_key(df, column, length)
    if isinstance(kind, T.TimestampType):
        return f"CAST(unix_micros({value}) AS STRING)"  # local times repeat when clocks go back
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return f"CAST({value} + 0 AS STRING)"  # no negative zero
    if isinstance(kind, (T.ArrayType, T.StructType, T.BinaryType)):
        return f"to_json(named_struct('v', {value}))"
    return f"CAST({value} AS STRING)"


class Keys:
    """Keys of any number of tables, counted in one aggregation.

    Every table is read once: a row gives an entry for each key that it holds
    or names. The entries of all tables are counted together by group and key,
    so a frequent key crosses the shuffle once a task. The broken keys are
    written, and a few sums over them say which groups they belong to and how
    large they are. Only tables with broken keys that do not name their rows
    are read a second time.
    """

    def __init__(self) -> None:
        self.groups: dict[int, KeyGroup] = {}
        self.frames: dict[int, DataFrame] = {}
        self.entries: dict[int, list[str]] = {}
        self.owners: dict[int, int] = {}

    def _enter(self, group: KeyGroup, df: DataFrame, entry: str) -> None:
        self.frames[id(df)] = df
        self.entries.setdefault(id(df), []).append(entry)
        self.groups[group.number] = group

    def unique(self, kind: str, table: Table, df: DataFrame, key: Sequence[str], locator: Sequence[str], message: str) -> None:
        """Every occurrence of a key after its first, in the order of the locator, breaks it; a NULL in it never does."""
        lengths = [table.column(c).type.length if table.has_column(c) else None for c in key]
        parts = key_parts(df, key, lengths)
        # Where the key itself names the row, counting is enough.
        counted = set(locator) <= set(key)
        group = KeyGroup(len(self.groups) + 1, kind, table, tuple(key), tuple(locator), message, parts, counted)
        numbers = list(locator) == list(key) and len(key) <= 2 and all(isinstance(df.schema[c].dataType, _WHOLE) for c in key)
        label = row_key(locator) if counted and not numbers else text(None)
        self.owners[group.number] = id(df)
        self._enter(group, df, group.entry(parts, not_null(key), label))

    def foreign(self, table: Table, child: DataFrame, fk: ForeignKey, parent: DataFrame, locator: Sequence[str]) -> None:
        """Rows whose complete foreign key is no key of the parent break it."""
        message = foreign_key_message(table, fk)
        lengths = [None] * len(fk.columns)
        parts = key_parts(child, fk.columns, lengths)
        group = KeyGroup(-len(self.groups) - 1, "foreign_key_missing", table, tuple(fk.columns), tuple(locator), message, parts, False)
        self.owners[group.number] = id(child)
        self._enter(group, child, group.entry(parts, not_null(fk.columns), text(None)))
        if all(c in parent.columns for c in fk.parent_columns):
            there = key_parts(parent, fk.parent_columns, lengths)
            self._enter(group, parent, group.entry(there, not_null(fk.parent_columns), text(None), parent=True))

    def violations(self) -> list[DataFrame]:
        """The reports of all keys; nothing but the count runs when none is broken."""
        if not self.groups:
            return []
        listed = [df.selectExpr(f"inline(array({', '.join(self.entries[k])}))").where("_g IS NOT NULL") for k, df in self.frames.items()]
        counts = _union(listed).groupBy(*KEY, "_label").agg(
            F.expr("count_if(NOT _parent)").alias("_n"), F.expr("bool_or(_parent)").alias("_met")
        )
        broken = materialize(counts.where("CASE WHEN _g > 0 THEN _n > 1 ELSE _n > 0 AND NOT _met END").drop("_met"))
        width = "octet_length(_k) + coalesce(octet_length(_label), 0) + 64"
        sizes = {r["_g"]: r["size"] for r in broken.groupBy("_g").agg(F.expr(f"sum(CAST({width} AS BIGINT))").alias("size")).collect()}
        reports, repeats = [], []
        named = [g for g in sizes if self.groups[g].counted]
        if named:
            found = broken.where(f"_g IN ({', '.join(map(str, named))})")
            key = "coalesce(_label, CASE {} END)".format(
                " ".join(f"WHEN _g = {g} THEN concat_ws('|', {', '.join(['_i', '_j'][: len(self.groups[g].key)])})" for g in named)
            )
            repeats.append(found.selectExpr(*self._report(named, key), "_n - 1 AS _times"))
        for owner, df in self.frames.items():
            mine = [g for g in sizes if not self.groups[g].counted and self.owners[g] == owner]
            if mine:
                self._match_back(df, mine, broken, fits(sum(sizes[g] for g in mine)), reports, repeats)
        if repeats:
            reports.append(repeat_rows(_union(repeats), "_times", ["table_name", "row_key"]))
        return reports

    def _report(self, numbers: Sequence[int], key: str) -> list[str]:
        """The columns of a report, as the group of each row says."""

        def chosen(value) -> str:
            return "CASE " + " ".join(f"WHEN _g = {g} THEN {value(self.groups[g])}" for g in numbers) + " END"

        return [
            f"{chosen(lambda g: lit(g.kind))} AS kind",
            f"{chosen(lambda g: lit(g.table.name))} AS table_name",
            f"{chosen(lambda g: text(_single(g.key)))} AS column_name",
            f"{key} AS row_key",
            f"{chosen(lambda g: lit(g.message))} AS message",
        ]

    def _match_back(self, df: DataFrame, numbers: list[int], broken: DataFrame, small: bool, reports: list[DataFrame], repeats: list[DataFrame]) -> None:
        """The rows of one table that hold or name broken keys."""
        groups = [self.groups[g] for g in numbers]
        locator = groups[0].locator
        entries = ", ".join(g.entry(g.parts, not_null(g.key), text(None)) for g in groups)
        rows = df.selectExpr(*[name(c) for c in locator], f"inline(array({entries}))").where("_g IS NOT NULL").drop("_label", "_parent")
        wanted = broken.where(f"_g IN ({', '.join(map(str, numbers))})").select(*KEY, "_n")
        members = rows_of_measured(rows, wanted, KEY, small)
        key = row_key(locator)
        missing = [g for g in numbers if g < 0]
        repeated = [g for g in numbers if g > 0]
        if repeated:
            # Broken rows only; they are read for the first of each key and for the rest.
            members = written(members)
            place = name(locator[0]) if len(locator) == 1 else f"struct({names(locator)})"
            found = members.where("_g > 0")
            firsts = found.groupBy(*KEY).agg(F.expr(f"min({place})").alias("_first"), F.max("_n").alias("_n"))
            placed = rows_of_groups(found.drop("_n"), firsts, KEY)
            reports.append(placed.where(f"NOT ({place} <=> _first)").selectExpr(*self._report(repeated, key)))
            # Rows that cannot be told apart from the first count as copies of it: one is left out.
            copies = placed.where(f"{place} <=> _first").groupBy(*KEY, *[name(c) for c in locator]).agg(F.count(F.lit(1)).alias("_same"))
            repeats.append(copies.where("_same > 1").selectExpr(*self._report(repeated, key), "_same - 1 AS _times"))
        if missing:
            reports.append(members.where("_g < 0").selectExpr(*self._report(missing, key)))


def _key_message(table: Table) -> str:
    return f"{table.name}: primary key ({', '.join(table.primary_key)}) stands in more than one row"


def _unique_message(table: Table, group: Sequence[str]) -> str:
    return f"{table.name}: unique ({', '.join(group)}) stands in more than one row"


def primary_key_duplicate(table: Table, df: DataFrame, locator: Sequence[str] | None = None) -> DataFrame:
    key, where = list(table.primary_key), list(locator or table.primary_key)
    if not set(where) <= set(key):
        return _keys_frame(df, lambda keys: keys.unique("primary_key_duplicate", table, df, key, where, _key_message(table)))
    # The key names its rows and is alone: its columns are counted as they are.
    counted = df.where(not_null(key)).groupBy(*[name(c) for c in key]).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    report = _violation("primary_key_duplicate", table, _single(key), _key_message(table), row_key(where))
    return repeat_rows(counted.selectExpr(*report, "_n - 1 AS _times"), "_times", ["table_name", "row_key"])


def unique_duplicate(table: Table, df: DataFrame, group: Sequence[str], locator: Sequence[str] | None = None) -> DataFrame:
    where = list(locator or table.primary_key) or list(df.columns)
    return _keys_frame(df, lambda keys: keys.unique("unique_duplicate", table, df, list(group), where, _unique_message(table, group)))


def _keys_frame(df: DataFrame, enter: Callable[[Keys], None]) -> DataFrame:
    keys = Keys()
    enter(keys)
    return _union([literal_rows(df.sparkSession, [], FIELDS), *keys.violations()])


def enter_keys(keys: Keys, table: Table, df: DataFrame, locator: Sequence[str]) -> None:
    """The primary key and every unique group of a table."""
    present = {c.casefold() for c in df.columns}
    if table.primary_key and all(c.casefold() in present for c in table.primary_key):
        keys.unique("primary_key_duplicate", table, df, table.primary_key, locator, _key_message(table))
    for group in table.unique:
        if all(c.casefold() in present for c in group):
            keys.unique("unique_duplicate", table, df, group, locator, _unique_message(table, group))


# --- foreign keys ------------------------------------------------------------


def _parent_keys(child: DataFrame, fk: ForeignKey, parent: DataFrame, shared: Sequence[str]) -> DataFrame:
    """The parent keys, named `shared` and in the child's types."""
    pairs = zip(fk.columns, fk.parent_columns, shared)
    return parent.selectExpr(*[f"{_as_child(child, parent, c, p)} AS {s}" for c, p, s in pairs])


def _comparable(child: DataFrame, fk: ForeignKey, parent: DataFrame) -> bool:
    return all(_same_family(child.schema[c], parent.schema[p]) for c, p in zip(fk.columns, fk.parent_columns))


def _same_parts(child: DataFrame, fk: ForeignKey, parent: DataFrame) -> bool:
    """Whether equal values have equal key parts on both sides."""

    def kind(df: DataFrame, column: str) -> str:
        found = df.schema[column].dataType
        return "whole" if isinstance(found, _WHOLE) else found.simpleString()

    return all(kind(child, c) == kind(parent, p) for c, p in zip(fk.columns, fk.parent_columns))


class Lookups:
    """Foreign keys of a table, split by the size of their parents.

    A parent small enough for Catalyst to broadcast is looked up in the same
    scan as the row rules. For a large one the keys of both sides are counted
    with all other keys. Where child and parent have different types, the
    distinct child keys are probed by a join that compares them as Spark does.
    """

    def __init__(self, table: Table, child: DataFrame, keys: Keys, locator: Sequence[str]) -> None:
        self.table, self.child, self.probed = table, child, child
        self.keys, self.locator = keys, list(locator)
        self.rules: list[Rule] = []
        self.mixed: list[DataFrame] = []

    def add(self, fk: ForeignKey, parent_table: Table | None, parent: DataFrame) -> None:
        complete = not_null(fk.columns)
        whole_parent = referenced(parent_table, parent, fk.parent_columns) if parent_table else parent
        if not _comparable(self.child, fk, whole_parent):
            self._rule(fk, complete)
            return
        position = len(self.rules)
        shared = [f"_f{position}_{i}" for i in range(len(fk.columns))]
        found = f"_p{position}"
        keys = _parent_keys(self.child, fk, whole_parent, shared).distinct().selectExpr(*shared, f"TRUE AS {found}")
        if not broadcasts_by_itself(keys):
            if _same_parts(self.child, fk, whole_parent):
                self.keys.foreign(self.table, self.child, fk, parent, self.locator)
            else:
                self.mixed.append(self._probed(fk, whole_parent))
            return
        match = " AND ".join(f"{name(c)} = {s}" for c, s in zip(fk.columns, shared))
        self.probed = self.probed.join(keys, F.expr(match), "left")
        self._rule(fk, f"{complete} AND {found} IS NULL")

    def _rule(self, fk: ForeignKey, broken: str) -> None:
        self.rules.append(Rule("foreign_key_missing", _single(fk.columns), foreign_key_message(self.table, fk), broken))

    def _probed(self, fk: ForeignKey, parent: DataFrame) -> DataFrame:
        shared = [f"_f{i}" for i in range(len(fk.columns))]
        report = _violation(
            "foreign_key_missing", self.table, _single(fk.columns), foreign_key_message(self.table, fk), row_key(self.locator)
        )
        keyed = self.child.where(not_null(fk.columns)).selectExpr(
            *[f"{name(c)} AS {s}" for c, s in zip(fk.columns, shared)], *[name(c) for c in self.locator]
        )
        # The join needs this shuffle anyway, and repeats leave before it.
        keys = _parent_keys(self.child, fk, parent, shared).distinct()
        wanted = keyed.groupBy(*shared).agg(F.count(F.lit(1)).alias("_n"))
        missing = wanted.join(keys, shared, "left_anti")
        return rows_of_groups(keyed, missing, shared).selectExpr(*report)


def foreign_key_message(table: Table, fk: ForeignKey) -> str:
    return f"{table.name} names a {fk.parent} ({', '.join(fk.parent_columns)}) that is not there"


def foreign_key_missing(
    table: Table, child: DataFrame, fk: ForeignKey, parent: DataFrame, locator: Sequence[str] | None = None
) -> DataFrame:
    """Child rows whose complete foreign key has no parent row."""
    where = list(locator or table.primary_key) or list(child.columns)
    keys = Keys()
    lookups = Lookups(table, child, keys, where)
    lookups.add(fk, None, parent)
    return _union([apply_rules(lookups.probed, table, lookups.rules, where), *lookups.mixed, *keys.violations()])


def _as_child(child: DataFrame, parent: DataFrame, field: str, target: str) -> str:
    """A parent column in the child's type where every parent value fits it."""
    widths = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8}
    a, b = child.schema[field].dataType, parent.schema[target].dataType
    fits = type(a) in widths and type(b) in widths and widths[type(a)] >= widths[type(b)]
    return f"CAST({name(target)} AS {sql_type(a)})" if fits and a != b else name(target)


def _same_family(a: T.StructField, b: T.StructField) -> bool:
    def family(kind: T.DataType) -> str:
        if isinstance(kind, (T.NumericType, T.BooleanType)):
            return "number"
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return "datetime"
        return kind.typeName()

    return family(a.dataType) == family(b.dataType)


# --- whole dataset -----------------------------------------------------------


def table_presence(spark: SparkSession, spec: DatasetSpec, given: DataFrame) -> DataFrame:
    """Unknown and missing tables. `given` lists the dataset's tables in `table_name`."""
    declared = literal_rows(spark, [(t.name,) for t in spec.tables], ["table_name"])
    found = given.selectExpr("table_name", "lower(table_name) AS _k")
    wanted = declared.selectExpr("table_name", "lower(table_name) AS _k")

    def report(df: DataFrame, kind: str, ending: str) -> DataFrame:
        return df.selectExpr(
            f"{lit(kind)} AS kind",
            "table_name",
            f"{text(None)} AS column_name",
            f"{text(None)} AS row_key",
            f"concat('Table ', table_name, {lit(ending)}) AS message",
        )

    unknown = report(found.join(wanted, "_k", "left_anti"), "unknown_table", " is not declared by the spec")
    return unknown.union(report(wanted.join(found, "_k", "left_anti"), "missing_table", " has no data"))


def unsupported_notes(table: Table, df: DataFrame | None = None) -> list[tuple[str | None, ...]]:
    """One note per check that cannot be evaluated; it names no row."""
    return [
        ("unsupported_check", table.name, column, None, f"{table.name}: the rule {words} is left out: {reason}")
        for column, words, reason in supported_checks(table, df)[1]
    ]


def _lookup(data: Mapping[str, DataFrame], name: str) -> DataFrame | None:
    return next((df for key, df in data.items() if key.casefold() == name.casefold()), None)


def validate(
    spark: SparkSession,
    spec: DatasetSpec,
    data: Mapping[str, DataFrame],
    locators: Mapping[str, Sequence[str]] | None = None,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """Every violation of every kind, as one DataFrame.

    A table is read twice, for its rows and for its keys, and once more where
    keys are broken that do not name their rows.

    `locators` names, per table, the columns that identify a row in reports;
    the primary key is used by default. With `only`, just these tables are
    judged, and the references of others to them.
    """
    judged = {n.casefold() for n in only} if only is not None else {t.name.casefold() for t in spec.tables}
    known = {t.name.casefold() for t in spec.tables}
    notes: list[tuple[str | None, ...]] = [
        ("unknown_table", name, None, None, f"The spec declares no table {name}")
        for name in data
        if name.casefold() not in known
    ]
    frames = {}
    for table in spec.tables:
        df = _lookup(data, table.name)
        if df is None:
            notes.append(("missing_table", table.name, None, None, f"Table {table.name} has no data"))
        else:
            frames[table.name.casefold()] = declared_names(table, df)
    parts: list[DataFrame] = []
    keys = Keys()
    for table in spec.tables:
        df = frames.get(table.name.casefold())
        if df is None:
            continue
        locator = locator_of(table, df, locators)
        mine = table.name.casefold() in judged
        if mine:
            notes.extend(unsupported_notes(table, df))
        lookups = Lookups(table, df, keys, locator)
        present = {c.casefold() for c in df.columns}
        for fk in table.foreign_keys:
            parent = frames.get(fk.parent.casefold()) if mine or fk.parent.casefold() in judged else None
            if parent is not None and all(c.casefold() in present for c in fk.columns):
                lookups.add(fk, spec.table(fk.parent), parent)
        rules = [*typed_rules(table, df), *lookups.rules] if mine else lookups.rules
        if rules:
            parts.append(apply_rules(lookups.probed, table, rules, locator))
        parts.extend(lookups.mixed)
        if mine:
            enter_keys(keys, table, df, locator)
    return _union([literal_rows(spark, notes, FIELDS), *parts, *keys.violations()])


def summarize(violations: DataFrame, samples: int = 3) -> DataFrame:
    """Violation counts per kind, table and column, with the first row keys.

    The violations are written once and read twice. The rank limit is applied
    before the shuffle as well, so a kind with very many violations sends at
    most `samples` rows per task to its group.
    """
    group = ["kind", "table_name", "column_name"]
    violations = written(violations)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("row_key"))
    first = (
        violations.select(*group, "row_key")
        .withColumn("_rank", rank)
        .where(F.col("_rank") <= samples)
        .groupBy(*group)
        .agg(F.concat_ws(",", F.array_sort(F.collect_list("row_key"))).alias("samples"))
    )
    totals = violations.groupBy(*group).agg(F.count(F.lit(1)).alias("violations"))
    same = reduce(lambda a, b: a & b, [totals[c].eqNullSafe(first[c]) for c in group])
    return totals.join(first, same).select(*[totals[c] for c in group], "violations", "samples")


def assert_valid(
    spark: SparkSession,
    spec: DatasetSpec,
    data: Mapping[str, DataFrame],
    *,
    ignore: Sequence[str] = (),
    locators: Mapping[str, Sequence[str]] | None = None,
    only: Sequence[str] | None = None,
) -> None:
    """Raise `DataValidationError` when anything but the ignored kinds is violated."""
    violations = validate(spark, spec, data, locators, only)
    if ignore:
        violations = violations.where(~F.col("kind").isin(*ignore))
    violations = written(violations)
    first = violations.limit(4).collect()
    if first:
        head = "; ".join(row["message"] for row in first[:3])
        more = "; ..." if len(first) > 3 else ""
        raise DataValidationError(f"{violations.count()} violations, first: {head}{more}", violations)


def unique_capacity(df: DataFrame, table_name: str, group: Sequence[str]) -> DataFrame:
    """Whether the values seen in each member could give every row its own tuple.

    Values are counted per member first, so a frequent value crosses the
    shuffle once per task.
    """
    members = ", ".join(f"named_struct('member', {lit(c)}, 'value', CAST({name(c)} AS STRING))" for c in group)
    values = df.selectExpr(f"inline(array({members}))").groupBy("member", "value").agg(F.count(F.lit(1)).alias("n"))
    sizes = values.groupBy("member").agg(F.count("value").alias("size"), F.sum("n").alias("n_rows"))
    title = f"{table_name}({', '.join(group)})"
    return sizes.agg(
        F.lit(title).alias("unique_group"),
        F.expr(f"aggregate(collect_list(size), 1L, (a, s) -> CASE WHEN s > 0 AND a > {2**63 - 1}L div s THEN {2**63 - 1}L ELSE a * s END)").alias("capacity"),
        F.max("n_rows").alias("n_rows"),
    ).selectExpr("*", "capacity >= n_rows AS fits")
