"""Mixing sources to target weights by Sainte-Laguë apportionment.

Source totals give the targets. The mix is made of equal blocks of words:
sources receive blocks by the highest quotients target / (2k - 1), then the
shards of each source receive that source's blocks by their word counts in the
same way. Inside a shard the documents stand in seeded order, are cut into
equal blocks, and a seeded choice of blocks is taken; a quota beyond one pass
over the shard takes whole passes first. A shard holds about `shard_words`
words, so a source of any share is spread over many tasks.

The driver sees one row per source (its name and total), nothing per document.

Defined cases: a null or empty text has size 0 and nothing is taken of it; null
is a source of its own, last in order; a null doc_id is kept; repeated rows
are documents each; an empty table gives an empty mix.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.llm import text as tx
from rowsmith.operators.shared import written


@dataclass(frozen=True)
class MixSettings:
    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: float = 2.0
    block_words: int = 64
    shard_words: int = 1_000_000
    seed: int = 23


def targets(sizes: list[int], weights: list[int], share: float, most: float) -> list[float]:
    """Words per source: `share` of all by weight; none above `most` times its size, excess shared again."""
    goal, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if goal * weights[i] / total >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = goal * weights[i] / total
            break
        rate = goal / total
        for i in full:
            if rate * weights[i] >= most * sizes[i]:
                out[i] = most * sizes[i]
                goal -= out[i]
                open_.discard(i)
    return out


def sainte_lague(votes: list[float] | np.ndarray, seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes / (2k - 1); ties go to the earlier entry; none above its cap."""
    total = float(sum(votes))
    if not total or seats <= 0:
        return [0] * len(votes)
    limit = caps or [seats] * len(votes)
    # Rounding by one divisor is a Sainte-Laguë allocation of nearly `seats`; go on from it by quotients.
    held = [min(math.floor(v * seats / total + 0.5), c) for v, c in zip(votes, limit)]
    excess = sum(held) - seats
    if excess > 0:
        lowest = [(v / (2 * h - 1), -i) for i, (v, h) in enumerate(zip(votes, held)) if h]
        heapq.heapify(lowest)
        for _ in range(excess):
            _, i = heapq.heappop(lowest)
            held[-i] -= 1
            if held[-i]:
                heapq.heappush(lowest, (votes[-i] / (2 * held[-i] - 1), i))
    else:
        highest = [(-v / (2 * h + 1), i) for i, (v, h) in enumerate(zip(votes, held)) if v and h < limit[i]]
        heapq.heapify(highest)
        for _ in range(-excess):
            if not highest:
                break
            _, i = heapq.heappop(highest)
            held[i] += 1
            if held[i] < limit[i]:
                heapq.heappush(highest, (-votes[i] / (2 * held[i] + 1), i))
    return held


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text), and a hash that spreads and orders the rows."""

    def run(rows, data, bounds):
        start, _, row = tx.word_spans(data, bounds)
        whole = tx.span_hashes(data, bounds[:-1], bounds[1:]).view(np.int64)
        return {
            "doc_id": rows.column("doc_id"),
            "source": rows.column("source"),
            "size": np.bincount(row, minlength=len(bounds) - 1),
            "mark": whole,
        }

    columns = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")
    return tx.map_texts(columns, run, "doc_id long, source string, size long, mark long")


def source_plan(sizes: DataFrame, settings: MixSettings) -> list[dict]:
    """One entry per source: size, target, blocks, number of shards; in code point order, null last."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    total = [int(r["size"]) for r in rows]
    weights = [settings.weights[i % len(settings.weights)] for i in range(len(rows))]
    goal = targets(total, weights, settings.share, settings.most)
    blocks = sainte_lague(goal, round(sum(goal) / settings.block_words))
    return [
        {"source": r["source"], "source_size": n, "target": t, "blocks": b, "shards": max(1, -(-n // settings.shard_words))}
        for r, n, t, b in zip(rows, total, goal, blocks)
    ]


def chosen_words(sizes: np.ndarray, blocks: int, quota: int, rng: np.random.Generator) -> tuple[int, list[list[tuple[int, int]]]]:
    """Whole passes over a shard, and the word ranges taken of each of its documents besides."""
    total = int(sizes.sum())
    ranges: list[list[tuple[int, int]]] = [[] for _ in sizes]
    if not total or not quota:
        return 0, ranges
    passes, rest = divmod(quota, blocks)
    edges = np.arange(blocks + 1, dtype=np.int64) * total // blocks
    picked = np.zeros(blocks + 2, dtype=np.int8)
    picked[1 + rng.permutation(blocks)[:rest]] = 1
    begin, stop = edges[np.flatnonzero(np.diff(picked) == 1)], edges[np.flatnonzero(np.diff(picked) == -1)]
    offset = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offset[1:])
    for a, b in zip(begin, stop):
        doc = int(np.searchsorted(offset, a, side="right")) - 1
        while doc < len(sizes) and offset[doc] < b:
            low, high = max(a, offset[doc]), min(b, offset[doc + 1])
            if low < high:
                ranges[doc].append((int(low - offset[doc]), int(high - offset[doc])))
            doc += 1
    return passes, ranges


CHOICE = "_passes int, _ranges array<struct<first:long,past:long>>"


def mix(rows: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """Add to rows with source, size and mark: source_size, target, _passes and _ranges.

    `_passes` is how often the whole document is taken, `_ranges` which words
    are taken once more. Other columns are carried along.
    """
    spark = rows.sparkSession
    plan = source_plan(rows, settings)
    known = spark.createDataFrame(
        [(p["source"], p["source"] is None, p["source_size"], p["target"], p["blocks"], p["shards"]) for p in plan],
        "_name string, _null boolean, source_size long, target double, _blocks long, _shards long",
    )
    name, missing = F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()
    columns = rows.columns
    placed = (
        rows.join(known, (name == F.coalesce("_name", F.lit(""))) & (missing == F.col("_null")))
        .withColumn("_shard", F.pmod(F.xxhash64("doc_id", "mark", F.lit(settings.seed)), F.col("_shards")))
        .withColumn("_source", name)
    )
    key = ["_source", "_null", "_shard"]
    shards = placed.groupBy(*key).agg(F.sum("size").alias("_words"), F.first("_blocks").alias("_blocks"))
    seed, block_words, most = settings.seed, settings.block_words, settings.most

    def share_out(group: pa.Table) -> pa.Table:
        group = group.sort_by("_shard")
        words = group["_words"].to_numpy()
        cut = [-(-int(w) // block_words) for w in words]
        caps = [math.floor(most * c) for c in cut]
        quota = sainte_lague(words.tolist(), min(group["_blocks"][0].as_py(), sum(caps)), caps)
        return pa.table({k: group[k] for k in key} | {"_cut": pa.array(cut, pa.int64()), "_quota": pa.array(quota, pa.int64())})

    quotas = shards.groupBy("_source", "_null").applyInArrow(share_out, "_source string, _null boolean, _shard long, _cut long, _quota long")
    carried = [f for f in placed.schema if f.name in columns or f.name in ("source_size", "target")]
    out = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(carried)])
    names = [f.name for f in carried]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out) + ", " + CHOICE
    range_type = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))

    def choose(group: pa.Table, quota: pa.Table) -> pa.Table:
        order = np.lexsort((group["mark"].to_numpy(), group["_order"].to_numpy()))
        group = group.take(pa.array(order))
        cut, seats = quota["_cut"][0].as_py(), quota["_quota"][0].as_py()
        source, shard = quota["_source"][0].as_py(), quota["_shard"][0].as_py()
        rng = np.random.default_rng([seed, shard, *source.encode()])
        passes, ranges = chosen_words(group["size"].to_numpy(), max(cut, 1), seats, rng)
        columns = {f"c{i}": group[n] for i, n in enumerate(names)}
        return pa.table(
            columns
            | {
                "_passes": pa.array(np.full(len(group), passes, dtype=np.int32)),
                "_ranges": pa.array([[{"first": a, "past": b} for a, b in r] for r in ranges], range_type),
            }
        )

    ordered = placed.withColumn("_order", F.xxhash64("mark", "doc_id", F.lit(settings.seed + 1)))
    mixed = ordered.groupBy(*key).cogroup(quotas.groupBy(*key)).applyInArrow(choose, schema)
    return mixed.toDF(*names, "_passes", "_ranges")


def taken() -> F.Column:
    return (
        F.col("_passes") * F.col("size") + F.aggregate("_ranges", F.lit(0).cast("long"), lambda n, r: n + r["past"] - r["first"])
    ).cast("long")


def report(docs: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    mixed = mix(written(sized(docs)), settings)
    return mixed.select("doc_id", "size", "source_size", "target", taken().alias("taken"), "source", F.size("_ranges").alias("n_ranges"))


def mixed_documents(docs: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """The mix as documents: whole texts once per pass, and one row with the words taken besides.

    Columns are those of `docs`; n_chars follows the text. Words taken in part
    are joined by one space, ranges by a line break.
    """
    place, schema = docs.columns.index("text"), docs.schema
    source, doc_id = docs.columns.index("source"), docs.columns.index("doc_id")
    inner = docs.toDF(*[f"d{i}" for i in range(len(docs.columns))])

    def measure(batches):
        for rows in tx.pieces(batches, f"d{place}"):
            data, bounds = tx.text_bytes(rows.column(place))
            _, _, row = tx.word_spans(data, bounds)
            size = pa.array(np.bincount(row, minlength=len(bounds) - 1))
            mark = pa.array(tx.span_hashes(data, bounds[:-1], bounds[1:]).view(np.int64))
            yield pa.RecordBatch.from_arrays([*rows.columns, size, mark], [*rows.schema.names, "size", "mark"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema)
    marked = inner.mapInArrow(measure, f"{fields}, size long, mark long")
    marked = marked.withColumn("doc_id", F.col(f"d{doc_id}").cast("long")).withColumn("source", F.col(f"d{source}").cast("string"))
    mixed = mix(marked, settings).where(F.col("size") > 0).where("_passes > 0 OR size(_ranges) > 0")

    def write(batches):
        for batch in batches:
            for rows in tx.pieces(iter([batch]), f"d{place}"):
                yield from emit(rows)

    def emit(rows):
        data, bounds = tx.text_bytes(rows.column(f"d{place}"))
        start, end, row = tx.word_spans(data, bounds)
        first = tx.group_bounds(row, rows.num_rows)
        source_row, texts = [], []
        for i, (passes, ranges) in enumerate(zip(rows.column("_passes").to_pylist(), rows.column("_ranges").to_pylist())):
            whole = rows.column(f"d{place}")[i].as_py() if passes else None
            source_row += [i] * passes
            texts += [whole] * passes
            if ranges:
                parts = []
                for r in ranges:
                    words = range(first[i] + r["first"], first[i] + r["past"])
                    parts.append(b" ".join(data[start[w] : end[w]].tobytes() for w in words).decode())
                source_row.append(i)
                texts.append("\n".join(parts))
        if source_row:
            out = rows.select([f"d{i}" for i in range(len(schema))]).take(pa.array(source_row))
            yield out.set_column(place, f"d{place}", pa.array(texts, out.column(place).type))

    texts = mixed.select(*inner.columns, "_passes", "_ranges").mapInArrow(write, fields).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        texts = texts.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return texts
