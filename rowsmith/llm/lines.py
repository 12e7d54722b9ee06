"""Line dedup by the spread of a line over sites.

Every line with a word gets a 128-bit hash. Sketches (HyperLogLog) of the sites
of each line merge by aggregation. Where the estimate lies near the threshold,
the sites are counted exactly. Lines on at least `sites` sites are boilerplate:
they stay in the document with the smallest doc_id that has them and go
from all others, so no passage is lost altogether.

A set of boilerplate lines that is measured to be small travels to the texts;
a larger one is joined to the lines, and the affected lines to the texts by doc_id.

Defined cases: a null text stays null and an empty one empty; blank lines
stay; a null source is the site with the empty name; rows without doc_id count
towards the spread and keep their lines; rows with the same doc_id are one document
for the choice of the one that keeps a line.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm import text as tx
from rowsmith.operators.shared import fits_broadcast, rows_of_groups, written

SECOND_SEED = 77


@dataclass(frozen=True)
class LineSettings:
    sites: int = 10
    sketch_bits: int = 12
    small: bool | None = None  # None: measure; a fixed value is for tests


def line_spans(data: np.ndarray, bounds: np.ndarray):
    """Start, end, row and whether it has a word, of every non-empty line."""
    start, end, row = tx.runs(data != 0x0A, bounds)
    words = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(tx.IS_WORD[data], out=words[1:])
    return start, end, row, words[end] > words[start]


def line_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tx.span_hashes(data, start, end).view(np.int64), tx.span_hashes(data, start, end, SECOND_SEED).view(np.int64)


def line_rows(docs: DataFrame) -> DataFrame:
    """The different lines of each document: k1, k2, site, doc_id."""

    def run(rows, data, bounds):
        start, end, row, wordy = line_spans(data, bounds)
        start, end, row = start[wordy], end[wordy], row[wordy]
        k1, k2 = line_keys(data, start, end)
        order = np.lexsort((k2, k1, row))
        k1, k2, row = k1[order], k2[order], row[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        at = pa.array(row[new])
        return {"k1": k1[new], "k2": k2[new], "site": rows.column("site").take(at), "doc_id": rows.column("doc_id").take(at)}

    columns = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), "text")
    return tx.map_texts(columns, run, "k1 long, k2 long, site string, doc_id long")


def boilerplate(lines: DataFrame, settings: LineSettings = LineSettings()) -> DataFrame:
    """k1, k2, keeper of every line on enough sites; keeper is the smallest doc_id."""
    key = ["k1", "k2"]
    spread = lines.groupBy(*key).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", settings.sketch_bits)).alias("_about"),
        F.min("doc_id").alias("keeper"),
        F.count(F.lit(1)).alias("_n"),
    )
    margin = max(1, round(4 * 1.04 / 2 ** (settings.sketch_bits / 2) * settings.sites))
    wide = written(spread.where(F.col("_about") >= settings.sites - margin))
    sure = wide.where(F.col("_about") > settings.sites + margin)
    near = wide.where(F.col("_about") <= settings.sites + margin)
    if near.isEmpty():
        return sure.select(*key, "keeper")
    # Only the lines near the threshold are counted; each (line, site) pair crosses the shuffle once a task.
    counted = (
        rows_of_groups(lines.select(*key, "site"), near.select(*key, "keeper", "_n"), key)
        .groupBy(*key, "keeper", "site")
        .agg(F.lit(1).alias("_one"))
        .groupBy(*key, "keeper")
        .agg(F.count("_one").alias("_sites"))
        .where(F.col("_sites") >= settings.sites)
    )
    return sure.select(*key, "keeper").unionByName(counted.select(*key, "keeper"))


def _without(data: np.ndarray, bounds: np.ndarray, doomed) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts without the lines for which doomed(row, k1, k2) holds; lines with a word, and those removed, by row."""
    n = len(bounds) - 1
    start, end, row, wordy = line_spans(data, bounds)
    start, end, row = start[wordy], end[wordy], row[wordy]
    k1, k2 = line_keys(data, start, end)
    gone = doomed(row, k1, k2)
    keep = np.ones(len(data), dtype=bool)
    for a, b, r in zip(start[gone], end[gone], row[gone]):
        # A line goes with the break after it, or with the one before it at the end of the text.
        keep[a : min(b + 1, bounds[r + 1])] = False
    left = []
    raw = data[keep].tobytes()
    size = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(keep, out=size[1:])
    ends_with_gone = np.zeros(n, dtype=bool)
    ends_with_gone[row[gone][end[gone] == bounds[row[gone] + 1]]] = True
    for r in range(n):
        text = raw[size[bounds[r]] : size[bounds[r + 1]]]
        left.append(text[:-1] if ends_with_gone[r] and text.endswith(b"\n") else text)
    return left, np.bincount(row, minlength=n), np.bincount(row[gone], minlength=n)


def dedup(docs: DataFrame, settings: LineSettings = LineSettings()) -> DataFrame:
    """`docs` with the boilerplate lines out of `text`, and n_lines and n_removed added.

    The counts take these names unless `docs` has such columns, which are then replaced.
    """
    lines = line_rows(docs)
    common = written(boilerplate(lines, settings))
    columns = docs.columns
    place, id_place = columns.index("text"), columns.index("doc_id")
    names = [f"d{i}" for i in range(len(columns))]
    named = docs.toDF(*names)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema)
    small = fits_broadcast(common, common.columns) if settings.small is None else settings.small
    if small:
        # Measured above: at most the size that may be broadcast.
        rows = sorted((r["k1"], r["k2"], r["keeper"]) for r in common.where("keeper IS NOT NULL").collect())
        table = np.array(rows, dtype=np.int64).reshape(len(rows), 3)
        held = docs.sparkSession.sparkContext.broadcast(table)
        source = named

        def doomed_of(rows):
            table = held.value
            ids = rows.column(id_place)
            known = np.array(ids.is_valid())
            ids = ids.cast(pa.int64()).fill_null(0).to_numpy()

            def doomed(row, k1, k2):
                at = np.searchsorted(table[:, 0], k1)
                gone = np.zeros(len(k1), dtype=bool)
                # Equal first hashes stand together; nearly always there is one.
                while True:
                    inside = at < len(table)
                    same = inside.copy()
                    same[inside] = table[at[inside], 0] == k1[inside]
                    if not same.any():
                        return gone
                    s = np.flatnonzero(same)
                    gone[s] |= (table[at[s], 1] == k2[s]) & known[row[s]] & (table[at[s], 2] != ids[row[s]])
                    at[~same] = len(table)
                    at[s] += 1

            return doomed

    else:
        own = (
            lines.join(common, ["k1", "k2"])
            .where("keeper IS NOT NULL AND doc_id IS NOT NULL AND doc_id <> keeper")
            .select("doc_id", "k1", "k2")
            .distinct()
            .groupBy("doc_id")
            .agg(F.sort_array(F.collect_list(F.struct("k1", "k2"))).alias("_gone"))
        )
        source = named.join(own, F.col(f"d{id_place}").cast("long") == F.col("doc_id"), "left").select(*named.columns, "_gone")

        def doomed_of(rows):
            lists = rows.column(len(columns)).to_pylist()
            sets = [{(g["k1"], g["k2"]) for g in x} if x else set() for x in lists]

            def doomed(row, k1, k2):
                return np.array([(a, b) in sets[r] for r, a, b in zip(row, k1.tolist(), k2.tolist())], dtype=bool)

            return doomed

    def run(batches):
        for rows in tx.pieces(batches, f"d{place}"):
            data, bounds = tx.text_bytes(rows.column(place))
            texts, n_lines, n_removed = _without(data, bounds, doomed_of(rows))
            column = rows.column(place)
            out = pa.array([t.decode() for t in texts], column.type, mask=np.array(column.is_null()))
            arrays = [out if i == place else rows.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines), pa.array(n_removed)], [*names, "n_lines", "n_removed"])

    result = source.mapInArrow(run, f"{fields}, n_lines long, n_removed long")
    kept = [(i, c) for i, c in enumerate(columns) if c not in ("n_lines", "n_removed")]
    return result.select(*[F.col(f"d{i}").alias(c) for i, c in kept], "n_lines", "n_removed")
