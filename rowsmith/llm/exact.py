"""Exact dedup: a tree merge of sorted digest runs.

Each partition reduces its rows to a sorted run of (digest, smallest doc_id,
count). Runs are cut into slices of the digest space, so no task ever holds
all digests. In binomial rounds, groups of `fan` runs of a slice meet in one
task and are merged into one sorted run; the smallest identifier of each digest
survives every level. At each level, entries with one digest must agree on a
second hash and on the length of the text, else the job stops.

Defined cases: null counts as empty and forms one group with the other texts
that are empty; blank texts are one space; a null doc_id is never the one that
stays if any row of the group has an id; repeated rows with the same doc_id are
members like any other, and all rows that bear the smallest id are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm import text as tx
from rowsmith.operators.shared import shuffle_partitions, written

FAN = 8
RUN = "slice int, run long, digest binary, mark long, keep_id long, size long"


def normalised(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every run of separators becomes one space; the bounds of the rows follow."""
    space = ~tx.IS_WORD[data]
    again = np.zeros(len(data), dtype=bool)
    again[1:] = space[1:] & space[:-1]
    again[bounds[:-1][bounds[:-1] < len(data)]] = False
    kept = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(~again, out=kept[1:])
    return np.where(space, np.uint8(0x20), data)[~again], kept[bounds]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, SHA-256 of the normalised text, and a second hash with the length mixed in."""

    def run(rows, data, bounds):
        clean, limits = normalised(data, bounds)
        raw = clean.tobytes()
        parts = [raw[a:b] for a, b in zip(limits[:-1], limits[1:])]
        return {
            "doc_id": rows.column("doc_id"),
            "digest": pa.array([hashlib.sha256(x).digest() for x in parts], pa.binary()),
            "mark": tx.span_hashes(clean, limits[:-1], limits[1:]).view(np.int64),
        }

    return tx.map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, digest binary, mark long")


def merged(runs: pa.Table) -> pa.Table:
    """One sorted run from several: smallest identifier and total size by digest, verified."""
    out = runs.group_by("digest").aggregate([("mark", "min"), ("mark", "max"), ("keep_id", "min"), ("size", "sum")])
    if not pc.all(pc.equal(out["mark_min"], out["mark_max"])).as_py() and out.num_rows:
        raise ValueError("two different texts share a SHA-256 digest")
    return out.select(["digest", "mark_min", "keep_id_min", "size_sum"]).rename_columns(["digest", "mark", "keep_id", "size"]).sort_by("digest")


def first_runs(rows: DataFrame, slices: int) -> DataFrame:
    """A sorted run for each partition, cut into slices by the first bytes of the digest."""

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t.rename_columns(["keep_id", "digest", "mark"]).append_column("size", pa.array(np.ones(len(t), dtype=np.int64)))
            held.append(merged(t))
        if not held:
            return
        t = merged(pa.concat_tables(held))
        head = np.frombuffer(b"".join(d[:4] for d in t["digest"].to_pylist()), dtype=">u4").astype(np.int64)
        number = TaskContext.get().partitionId()
        t = t.append_column("slice", pa.array((head * slices >> 32).astype(np.int32))).append_column("run", pa.array(np.full(len(t), number)))
        yield from t.select(["slice", "run", "digest", "mark", "keep_id", "size"]).to_batches()

    return rows.select("doc_id", "digest", "mark").mapInArrow(run, RUN)


def merge_round(runs: DataFrame, fan: int) -> DataFrame:
    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out = merged(table.select(["digest", "mark", "keep_id", "size"]))
        n = len(out)
        out = out.add_column(0, "run", pa.array(np.full(n, key[1].as_py(), dtype=np.int64)))
        return out.add_column(0, "slice", pa.array(np.full(n, key[0].as_py(), dtype=np.int32)))

    return runs.withColumn("run", F.floor(F.col("run") / fan)).groupBy("slice", "run").applyInArrow(merge, RUN)


def groups(rows: DataFrame, slices: int | None = None, fan: int = FAN) -> DataFrame:
    """digest, keep_id, size of every group, from rows of `digests`."""
    runs = rows.rdd.getNumPartitions()
    merged_runs = first_runs(rows, slices or max(64, shuffle_partitions(rows.sparkSession)))
    while runs > 1:
        merged_runs, runs = merge_round(merged_runs, fan), -(-runs // fan)
    return merged_runs.select("digest", "keep_id", "size")


def dedup(docs: DataFrame, slices: int | None = None, fan: int = FAN) -> DataFrame:
    """Every row with its group: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = written(digests(docs))
    found = groups(rows, slices, fan)
    return rows.join(found, "digest").select(
        "doc_id",
        "keep_id",
        F.col("size").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
