"""Quality rules: an isolation forest on rule statistics, calibrated from labelled rows.

Every document gets rule statistics of its whole text. A forest of random
splits is grown on all labelled rows that pass the base rules: equal statistics are
one row with counts, and each such row is dealt to one tree at least, to more where
a tree would hold fewer than `tree_rows`. Split values are drawn
over the range of all rows of a node, while a path ends where few *good* rows
are left, so odd documents have short paths. The threshold is the one with the least
share of bad rows kept plus `good_cost` times the share of good rows lost, counted over
all of these rows at `LEVELS` levels of the anomaly.

Texts are read once for the statistics; the model is bounded by its trees and their depth.

Defined cases: a null or empty text has no words and fails the base rules; a
null doc_id is kept as null; repeated rows are judged each alone; labels that are
null, or of unknown documents, do not count, and a repeated label is good when
any of its rows is; without good and bad labels only the base rules decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm import text as tx
from rowsmith.operators.shared import even_join, written

BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
UPPER = np.isin(np.arange(256), np.arange(0x41, 0x5B))
PUNCTUATION = np.isin(np.arange(256), [b for b in range(0x21, 0x7F) if not chr(b).isalnum()])
SENTENCE_END = np.isin(np.arange(256), np.frombuffer(b"!?", dtype=np.uint8))
FEATURES = ("word_length", "symbols", "repeat_words", "upper", "punctuation", "loud")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Levels of the anomaly at which thresholds are tried, a power of two.
LEVELS = 1 << 16


@dataclass(frozen=True)
class ForestSettings:
    """`tree_rows` is the least number of different rows of a tree, where there are so many."""

    trees: int = 100
    tree_rows: int = 256
    depth: int = 12
    good_cost: float = 30.0
    seed: int = 11


def statistics(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Rule statistics of each row of a batch."""
    n = len(bounds) - 1
    start, end, row = tx.word_spans(data, bounds)
    n_words = np.bincount(row, minlength=n)
    begins = (data & 0xC0) != 0x80
    word_chars = tx.row_sums(begins & tx.IS_WORD[data], bounds)

    hashes = tx.span_hashes(data, start, end)
    repeated = np.zeros(len(row), dtype=np.int64)
    if len(row) >= 3:
        three = tx.joined(tx.joined(hashes[:-2], hashes[1:-1]), hashes[2:])
        at = np.flatnonzero(row[2:] == row[:-2])
        order = at[np.lexsort((three[at], row[at]))]
        same = (three[order][1:] == three[order][:-1]) & (row[order][1:] == row[order][:-1])
        twice = np.zeros(len(order), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        for shift in range(3):
            repeated[order[twice] + shift] = 1
    n_repeat = np.bincount(row, weights=repeated, minlength=n).astype(np.int64)

    line_start, line_end, line_row = tx.runs(data != 0x0A, bounds)
    word_sum = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(tx.IS_WORD[data], out=word_sum[1:])
    lines = np.flatnonzero(word_sum[line_end] > word_sum[line_start])
    line_hash = tx.span_hashes(data, line_start[lines], line_end[lines])
    distinct_row, _ = tx.distinct_in_rows(line_row[lines], line_hash)
    n_lines = np.bincount(line_row[lines], minlength=n)
    n_dup = n_lines - np.bincount(distinct_row, minlength=n)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": tx.row_sums(SYMBOLS[data], bounds),
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "n_upper": tx.row_sums(UPPER[data], bounds),
        "n_punctuation": tx.row_sums(PUNCTUATION[data], bounds),
        "n_loud": tx.row_sums(SENTENCE_END[data], bounds),
    }


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.column_stack(
        [
            s["word_chars"] / words,
            s["n_symbols"] / words,
            s["n_repeat_words"] / words,
            s["n_upper"] / chars,
            s["n_punctuation"] / chars,
            s["n_loud"] / words,
        ]
    ).astype(np.float64)


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < BASE_MIN_WORDS) | (100 * s["n_repeat_words"] > BASE_MAX_REPEAT_PERCENT * s["n_words"])


# --- the forest --------------------------------------------------------------


def average_path(n: int) -> float:
    """Mean depth of a random tree over n rows: what a path that stops early still lacks."""
    if n <= 1:
        return 0.0
    return 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays: feature (-1 at a leaf), split value, left child, length at a leaf."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    depth: int
    scale: float

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 for odd rows."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= self.split[node]
                node = np.where(inner, self.left[node] + right, node)
            total += self.length[node]
        return np.exp2(-total / (len(self.roots) * self.scale))


def grow(x: np.ndarray, good: np.ndarray, settings: ForestSettings, number: int) -> tuple[list, ...]:
    """One tree over the rows `x` with their numbers of good ones: feature, split, left (from 0 in the tree), length."""
    rng = np.random.default_rng([settings.seed, number])
    feature, split, left, length = [], [], [], []

    def node() -> int:
        for column, value in ((feature, -1), (split, 0.0), (left, 0), (length, 0.0)):
            column.append(value)
        return len(feature) - 1

    open_nodes = [(node(), np.arange(len(x)), 0)]
    while open_nodes:
        at, rows, depth = open_nodes.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        spread = np.flatnonzero(high > low)
        n_good = int(good[rows].sum())
        if n_good <= 1 or depth >= settings.depth or not len(spread):
            length[at] = depth + average_path(n_good)
            continue
        f = int(rng.choice(spread))
        value = rng.uniform(low[f], high[f])
        # Both sides hold a row: a draw at the lower edge would leave the left one empty.
        value = value if value > low[f] else high[f]
        feature[at], split[at], left[at] = f, value, node()
        node()
        below = x[rows, f] < value
        open_nodes += [(left[at], rows[below], depth + 1), (left[at] + 1, rows[~below], depth + 1)]
    return feature, split, left, length


@dataclass(frozen=True)
class QualityModel:
    forest: Forest | None
    threshold: float

    def accepts(self, x: np.ndarray) -> np.ndarray:
        if self.forest is None or not len(x):
            return np.ones(len(x), dtype=bool)
        return self.forest.anomaly(x) <= self.threshold


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and the features `x` of every row."""

    def run(rows, data, bounds):
        s = statistics(data, bounds)
        # Typed, as a piece may have no row.
        x = pa.array(list(features(s)), pa.list_(pa.float64()))
        return {"doc_id": rows.column("doc_id")} | {k: s[k] for k in COUNTS} | {"base_failed": base_failed(s), "x": x}

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return tx.map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, f"doc_id long, {counts}, base_failed boolean, x array<double>")


def _features(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def learning_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """x, good, bad: how many good and bad labelled rows have these features, of all that pass the base rules.

    The forest only has a say on documents that pass them, so it learns from those.
    """
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.max("quality") > 0).alias("_good"))
    passed = rows.where("NOT base_failed AND doc_id IS NOT NULL").select("doc_id", "x")
    known = even_join(passed, marked.select(F.col("doc_id").cast("long"), "_good"), ["doc_id"])
    return known.groupBy("x").agg(F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad"))


def forest_of(learned: DataFrame, n: int, n_good: int, settings: ForestSettings) -> Forest:
    """A forest over `n` different rows, each in one tree at least."""
    copies = min(settings.trees, max(1, -(-settings.trees * settings.tree_rows // n)))
    first = F.pmod(F.xxhash64("x", F.lit(settings.seed)), F.lit(settings.trees))
    dealt = learned.withColumn("_first", first).select(
        "x", "good", F.explode(F.expr(f"transform(sequence(0, {copies - 1}), i -> cast((_first + i) % {settings.trees} AS int))")).alias("tree")
    )
    schema = "tree int, feature array<int>, split array<double>, left array<int>, length array<double>"

    def run(table: pa.Table) -> pa.Table:
        x = _features(table.column("x").combine_chunks())
        order = np.lexsort(x.T)
        number = table.column("tree")[0].as_py()
        grown = grow(x[order], table.column("good").to_numpy()[order], settings, number)
        kinds = pa.int32(), pa.float64(), pa.int32(), pa.float64()
        columns = [pa.array([c], pa.list_(kind)) for c, kind in zip(grown, kinds)]
        return pa.table([pa.array([number], pa.int32()), *columns], names=["tree", "feature", "split", "left", "length"])

    # At most 2^(depth + 1) nodes a tree, whatever the input.
    trees = sorted(dealt.groupBy("tree").applyInArrow(run, schema).collect(), key=lambda r: r["tree"])
    sizes = np.array([len(t["feature"]) for t in trees])
    roots = np.cumsum(sizes) - sizes
    feature, split, left, length = (np.concatenate([np.array(t[c]) for t in trees]) for c in ("feature", "split", "left", "length"))
    left += np.repeat(roots, sizes)
    scale = max(average_path(max(1, round(n_good * copies / settings.trees))), 1.0)
    return Forest(feature, split, left, length, roots, depth=settings.depth, scale=scale)


def threshold_of(learned: DataFrame, forest: Forest, settings: ForestSettings) -> float:
    """The level with the least cost over all learning rows."""

    def run(batches):
        for t in batches:
            if t.num_rows:
                level = np.ceil(forest.anomaly(_features(t.column("x"))) * LEVELS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(level), t.column("good"), t.column("bad")], ["level", "good", "bad"])

    counted = learned.mapInArrow(run, "level long, good long, bad long").groupBy("level").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    rows = sorted(counted.collect())  # as many as levels at most
    level, good, bad = (np.array(c, dtype=np.float64) for c in zip(*rows))
    bad_kept, good_lost = np.cumsum(bad) / bad.sum(), 1 - np.cumsum(good) / good.sum()
    return float(level[np.argmin(bad_kept + settings.good_cost * good_lost)] / LEVELS)


def learn(rows: DataFrame, labels: DataFrame, settings: ForestSettings = ForestSettings()) -> QualityModel:
    """Grow and calibrate on all labelled rows of a `measured` table that pass the base rules."""
    learned = written(learning_rows(rows, labels))
    size = learned.agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if (size["good"] or 0) < 10 or (size["bad"] or 0) < 1:
        return QualityModel(None, 1.0)
    forest = forest_of(learned, size["n"], size["good"], settings)
    return QualityModel(forest, threshold_of(learned, forest, settings))


def fit(docs: DataFrame, labels: DataFrame, settings: ForestSettings = ForestSettings()) -> QualityModel:
    """Grow and calibrate on all labelled documents that pass the base rules."""
    return learn(written(measured(docs)), labels, settings)


def verdicts(rows: DataFrame, model: QualityModel) -> DataFrame:
    """The verdict on every row of a `measured` table: doc_id, the counts, base_failed, kept, anomaly-based `accepted`."""

    def run(batches):
        for t in batches:
            accepted = model.accepts(_features(t.column("x")))
            kept = accepted & ~t.column("base_failed").to_numpy(zero_copy_only=False)
            given = ["doc_id", *COUNTS, "base_failed"]
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in given), pa.array(kept), pa.array(accepted)], [*given, "kept", "accepted"])

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(run, f"doc_id long, {counts}, base_failed boolean, kept boolean, accepted boolean")


def judge(docs: DataFrame, model: QualityModel) -> DataFrame:
    """`verdicts` on every row of `docs`."""
    return verdicts(measured(docs), model)


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of `docs` that pass, with all their columns, in one pass over the texts."""
    forest, threshold = model.forest, model.threshold
    place = docs.columns.index("text")

    def run(batches):
        for rows in tx.pieces(_named(batches), f"c{place}"):
            data, bounds = tx.text_bytes(rows.column(place))
            s = statistics(data, bounds)
            kept = QualityModel(forest, threshold).accepts(features(s)) & ~base_failed(s)
            yield rows.filter(pa.array(kept))

    def _named(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(b.columns, [f"c{i}" for i in range(b.num_columns)])

    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return docs.mapInArrow(run, fields).toDF(*docs.columns)
