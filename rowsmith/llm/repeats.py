"""Removal of repeated byte strings of a minimum length, within and across documents.

A string of `length` bytes is removed wherever it starts more than once. The work is
confined to places where that is possible:

1. The 16-byte gram with the smallest hash in a window of `length` bytes is its
   anchor, so equal windows have their anchors at the same distance. The possible
   distances are cut into `parts`; all windows of a part share a core around the
   anchor. A core that occurs once rules its windows out.
2. The segment of a part (its core with all its windows) that occurs twice is
   repeated as a whole.
3. The different segments of the other repeated cores are laid end to end, thousands at
   a time. A Burrows-Wheeler transform is built over them, and breadth-first
   backward extension of its intervals derives the common prefixes by increasing value,
   stopping at `length`: neighbours without a value by then share a string.

Segments of one core meet in one task. A core with more than `crowd` different
segments (the edge of a passage that very many documents share) is spread: there each
window of each segment is hashed and counted, which decides the same.

Defined cases: null counts as empty; texts shorter than `length` lose
nothing; a null doc_id is kept; equal rows repeat each other.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm import text as tx
from rowsmith.operators.shared import rows_of_groups, shuffle_partitions, written

GRAM = 16
KEY = ["_id", "_mark"]


@dataclass(frozen=True)
class RepeatSettings:
    length: int = 400
    parts: int = 4
    crowd: int = 1024
    block_bytes: int = 1 << 20


# --- anchors -----------------------------------------------------------------


def byte_sums(data: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and the inverse powers that shift a span to the origin."""
    rng = np.random.default_rng(salt)
    table = rng.integers(0, 2**64, 256, dtype=np.uint64)
    base = np.uint64(int(rng.integers(0, 2**63)) * 2 + 1)
    inverse = np.uint64(pow(int(base), -1, 2**64))
    n = len(data)
    powers, back = np.full(n + 1, base), np.full(n + 1, inverse)
    powers[0] = back[0] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(back, out=back)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(table[data] * powers[:-1], out=sums[1:])
    return sums, back


def sums_hash(prepared: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums, back = prepared
    return tx.mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams that are the smallest (leftmost of equals) of a window: their start, and the first and last start of such windows.

    Each window within a row belongs to one anchor.
    """
    n, width = len(data), length - GRAM + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.zeros(n + GRAM, dtype=np.uint8)
    padded[:n] = data
    eight = np.ndarray((n + GRAM - 7,), dtype="<u8", buffer=padded, strides=(1,))
    gram = tx.joined(tx.mix(eight[:n].astype(np.uint64)), eight[8 : n + 8])
    # The place in the low half breaks ties to the left, alike in every copy of a window.
    order = ((gram >> np.uint64(32)) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    full = -(-(n + width) // width) * width
    line = np.full(full, np.iinfo(np.uint64).max, dtype=np.uint64)
    line[:n] = order
    square = line.reshape(-1, width)
    forward = np.minimum.accumulate(square, axis=1).reshape(-1)
    backward = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(backward[: n - length + 1], forward[width - 1 : width - 1 + n - length + 1])
    inside = np.zeros(n + 1, dtype=np.int64)
    size = np.diff(bounds)
    long = size >= length
    np.add.at(inside, bounds[:-1][long], 1)
    np.add.at(inside, bounds[1:][long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(inside)[: n - length + 1] > 0)
    place = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # The place of the smallest never goes back, so the windows of an anchor stand together.
    change = np.flatnonzero(place[1:] != place[:-1]) + 1
    first, last = np.concatenate([[0], change]), np.concatenate([change - 1, [len(place) - 1]])
    if not len(place):
        return place, place, place
    return place[first], window[first], window[last]


def segments(data: np.ndarray, bounds: np.ndarray, settings: RepeatSettings):
    """Row, segment start, segment end, core hash and segment hash of every part of every anchor."""
    length, parts = settings.length, settings.parts
    place, earliest, latest = anchors(data, bounds, length)
    row = np.searchsorted(bounds, place, side="right") - 1
    reach = length - GRAM  # the earliest start is so far before the anchor
    edges = [reach * k // parts for k in range(parts)] + [reach + 1]
    first_sums, second_sums = byte_sums(data, 1), byte_sums(data, 2)
    out = []
    for k in range(parts):
        low, high = place - reach + edges[k], place - reach + edges[k + 1] - 1  # first and last start
        begin, last = np.maximum(low, earliest), np.minimum(high, latest)
        core_from, core_to = high, low + length
        # Any start that exists lies in the text with its whole window, and the core with it.
        at = np.flatnonzero(begin <= last)
        core = tx.mix(sums_hash(first_sums, core_from[at], core_to[at]) + np.uint64(k + 1))
        segment = sums_hash(second_sums, begin[at], last[at] + length)
        out.append((row[at], begin[at], last[at] + length, core, segment))
    return tuple(np.concatenate(x) for x in zip(*out))


# --- the transform -----------------------------------------------------------


def suffix_order(symbols: np.ndarray, most: int) -> np.ndarray:
    """Suffixes in order, by doubling; all differ within `most` symbols because separators are unique."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    k = 1
    order = np.argsort(rank, kind="stable")
    while True:
        following = np.zeros(n, dtype=np.int64)
        following[: n - k] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + following
        order = np.argsort(key)
        ordered = key[order]
        step = np.ones(n, dtype=np.int64)
        step[0] = 0
        step[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(step)
        k *= 2
        if rank[order[-1]] == n - 1 or k > most or k >= n:
            return order


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which starts begin a string of `length` bytes that starts anywhere else among the texts."""
    count = len(texts)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    n = int(begin[-1])
    symbols = np.empty(n, dtype=np.int64)
    symbols[begin[1:] - 1] = np.arange(count)  # each text ends with a separator of its own, below all bytes
    body = np.ones(n, dtype=bool)
    body[begin[1:] - 1] = False
    symbols[body] = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64) + count
    order = suffix_order(symbols, int(size.max()) + 1)
    transform = symbols[order - 1]  # the symbol before each suffix; before the first one, the last separator
    by_symbol = np.argsort(transform, kind="stable")
    forward = np.empty(n, dtype=np.int64)
    forward[by_symbol] = np.arange(n)
    same = transform[by_symbol][1:] == transform[by_symbol][:-1]
    earlier, later = np.full(n, -1), np.full(n, n)
    earlier[by_symbol[1:][same]] = by_symbol[:-1][same]
    later[by_symbol[:-1][same]] = by_symbol[1:][same]
    composite = transform[by_symbol] * n + by_symbol
    present = np.unique(symbols[body]) if body.any() else np.zeros(0, np.int64)

    known = np.zeros(n + 1, dtype=bool)  # boundaries with a common prefix shorter than `length`
    known[: count + 1] = known[n] = True
    # Level 0: one interval for each symbol, all boundaries between them known.
    ordered = np.sort(symbols)
    low = np.concatenate([np.arange(count), np.searchsorted(ordered, present)])
    high = np.concatenate([np.arange(count) + 1, np.searchsorted(ordered, present, side="right")])
    low, high = low[high < n], high[high < n]
    known[high] = True
    for _ in range(1, length):
        if not len(low):
            break
        width = high - low
        single = width == 1
        new_low, new_high = [forward[low[single]]], [forward[low[single]] + 1]
        some = (width > 1) & (width <= 256)
        if some.any():
            l, h = low[some], high[some]
            w = h - l
            owner = np.repeat(np.arange(len(l)), w)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(w) - w, w) + l[owner]
            head, tail = earlier[at] < l[owner], later[at] >= h[owner]
            a, b = owner[head] * n + forward[at[head]], owner[tail] * n + forward[at[tail]]
            new_low.append(np.sort(a) % n)
            new_high.append(np.sort(b) % n + 1)
        wide = width > 256
        if wide.any():
            for c in present.tolist():
                new_low.append(np.searchsorted(composite, c * n + low[wide]))
                new_high.append(np.searchsorted(composite, c * n + high[wide]))
        low, high = np.concatenate(new_low), np.concatenate(new_high)
        fresh = (high > low) & ~known[high]
        low, high = low[fresh], high[fresh]
        known[high] = True
    alike = np.zeros(n, dtype=bool)
    alike[order] = ~known[:-1] | ~known[1:]
    out = []
    for i in range(count):
        starts = alike[begin[i] : begin[i + 1] - 1]
        starts[max(0, size[i] - length + 1) :] = False
        out.append(starts)
    return out


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by strings of `length` bytes that begin at the marked starts."""
    at = np.flatnonzero(starts)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length) + 1
    begin, end = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])] + length
    return list(zip(begin.tolist(), end.tolist()))


# --- the operator ------------------------------------------------------------


def keyed(docs: DataFrame) -> DataFrame:
    """Rows named by doc_id and text hash; equal rows share a name and everything that follows from it."""
    id_ = F.col("doc_id").cast("long")
    return docs.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(-(2**63))).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_mark"), "text")


def segment_rows(rows: DataFrame, settings: RepeatSettings) -> DataFrame:
    def run(t, data, bounds):
        row, start, end, core, segment = segments(data, bounds, settings)
        if not len(row):
            return None
        at = pa.array(row)
        return {
            "core": core.view(np.int64),
            "segment": segment.view(np.int64),
            "_id": t.column("_id").take(at),
            "_mark": t.column("_mark").take(at),
            "start": start - bounds[row],
            "size": (end - start).astype(np.int32),
        }

    return tx.map_texts(rows.select("_id", "_mark", "text"), run, "core long, segment long, _id long, _mark long, start long, size int")


def _table(core, segment, ranges) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
    return pa.RecordBatch.from_pydict(
        {
            "core": pa.array(core, pa.int64()),
            "segment": pa.array(segment, pa.int64()),
            "ranges": pa.array([[{"first": a, "past": b} for a, b in r] for r in ranges], kind),
        }
    )


RANGES = "core long, segment long, ranges array<struct<first:long,past:long>>"


def by_transform(different: DataFrame, settings: RepeatSettings) -> DataFrame:
    """Repeated ranges of the different segments (core, segment, bytes) whose cores are not crowded."""
    length, limit = settings.length, settings.block_bytes

    def run(batches):
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def solve():
            marks = repeated_starts([b for _, _, b in held], length)
            return _table([c for c, _, _ in held], [s for _, s, _ in held], [covered(m, length) for m in marks])

        for t in batches:
            for core, segment, raw in zip(*(t.column(c).to_pylist() for c in ("core", "segment", "bytes"))):
                # Rows come sorted by core; a block ends between cores.
                if size >= limit and held and held[-1][0] != core:
                    yield solve()
                    held, size = [], 0
                held.append((core, segment, raw))
                size += len(raw)
        if held:
            yield solve()

    spread = different.repartition(shuffle_partitions(different.sparkSession), "core").sortWithinPartitions("core")
    return spread.select("core", "segment", "bytes").mapInArrow(run, RANGES)


def by_counting(different: DataFrame, settings: RepeatSettings) -> DataFrame:
    """The same for crowded cores: every window is hashed and counted, whatever task it is in."""
    length = settings.length

    def run(batches):
        for t in batches:
            for first in range(0, t.num_rows, 500):
                rows = t.slice(first, 500)
                texts = rows.column("bytes").to_pylist()
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
                data = np.frombuffer(b"".join(texts), dtype=np.uint8)
                per = np.diff(bounds) - length + 1
                owner = np.repeat(np.arange(len(per)), per)
                local = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
                start = bounds[:-1][owner] + local
                h1, h2 = (sums_hash(byte_sums(data, salt), start, start + length).view(np.int64) for salt in (3, 4))
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("core").take(at), rows.column("segment").take(at), pa.array(local), pa.array(h1), pa.array(h2)],
                    ["core", "segment", "at", "h1", "h2"],
                )

    windows = written(different.select("core", "segment", "bytes").mapInArrow(run, "core long, segment long, at long, h1 long, h2 long"))
    twice = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h1", "h2")
    found = windows.join(twice, ["h1", "h2"])
    single = F.struct(F.col("at").alias("first"), (F.col("at") + length).alias("past"))
    return found.groupBy("core", "segment").agg(F.collect_list(single).alias("ranges"))


def repeated_ranges(docs: DataFrame, settings: RepeatSettings = RepeatSettings()) -> DataFrame:
    """_id, _mark, ranges: for each named text the byte ranges that are covered by repeated strings."""
    texts = keyed(docs)
    rows = written(segment_rows(texts, settings))
    cores = (
        rows.groupBy("core").agg(F.count(F.lit(1)).alias("_n"), F.min("segment").alias("_low"), F.max("segment").alias("_high"))
        .where("_n > 1").selectExpr("core", "_n", "_low < _high AS _mixed")
    )
    # A passage that many documents share is one core: such cores travel to the rows.
    alive = written(rows_of_groups(rows, cores, ["core"]).drop("_n"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("size").cast("long").alias("past")))
    plain = alive.where("NOT _mixed").select(*KEY, "start", whole.alias("ranges"))

    mixed = alive.where("_mixed")
    named = F.struct("_id", "_mark", "start", "size")
    one = written(mixed.groupBy("core", "segment").agg(F.count(F.lit(1)).alias("_n"), F.min(named).alias("at")))
    crowd = one.groupBy("core").agg(F.count(F.lit(1)).alias("_k"), F.min("_n").alias("_fewest"))
    # If all segments of a core occur twice, nothing is left to decide. A crowded core travels to its segments.
    undecided = crowd.where("_fewest = 1").selectExpr("core", "_k", "_k AS _n")
    needed = rows_of_groups(one.drop("_n"), undecided, ["core"])
    wanted = needed.select("core", "segment", "_k", F.col("at._id").alias("_id"), F.col("at._mark").alias("_mark"), "at.start", "at.size")
    per_text = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("core", "segment", "_k", "start", "size")).alias("_wanted"))

    def cut(batches):
        for t in tx.pieces(batches, "text"):
            data, bounds = tx.text_bytes(t.column("text"))
            out = {"core": [], "segment": [], "_k": [], "bytes": []}
            for r, wanted in enumerate(t.column("_wanted").to_pylist()):
                for w in wanted:
                    at = bounds[r] + w["start"]
                    for name in ("core", "segment", "_k"):
                        out[name].append(w[name])
                    out["bytes"].append(data[at : at + w["size"]].tobytes())
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), types)})

    named_texts = texts.select(*KEY, "text").join(per_text, KEY).select("text", "_wanted")
    pieces = named_texts.mapInArrow(cut, "core long, segment long, _k long, bytes binary")
    # Equal rows name the same segment each; once is enough.
    different = written(pieces.dropDuplicates(["core", "segment"]))
    solved = by_transform(different.where(F.col("_k") <= settings.crowd), settings).unionByName(
        by_counting(different.where(F.col("_k") > settings.crowd), settings)
    )
    decided = rows_of_groups(mixed, one.select("core", "segment", "_n"), ["core", "segment"])
    often = decided.where("_n > 1").select(*KEY, "start", whole.alias("ranges"))
    once = decided.where("_n = 1").join(written(solved), ["core", "segment"]).select(*KEY, "start", "ranges")
    every = plain.unionByName(often).unionByName(once).where("size(ranges) > 0")
    shifted = F.transform("ranges", lambda r: F.struct((r["first"] + F.col("start")).alias("first"), (r["past"] + F.col("start")).alias("past")))
    return every.select(*KEY, shifted.alias("ranges")).groupBy(*KEY).agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def removal(docs: DataFrame, settings: RepeatSettings = RepeatSettings()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed `spans` of every row."""
    found = written(repeated_ranges(docs, settings))
    rows = keyed(docs).join(found, KEY, "left").select("doc_id", "text", "ranges")

    def run(t, data, bounds):
        n = len(bounds) - 1
        edge = np.zeros(len(data) + 1, dtype=np.int64)
        lists = t.column("ranges").to_pylist()
        for r, ranges in enumerate(lists):
            for x in ranges or ():
                edge[bounds[r] + x["first"]] += 1
                edge[bounds[r] + x["past"]] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        start, end, row = tx.runs(gone, bounds)
        kept, size = data[~gone].tobytes(), np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(~gone, out=size[1:])
        spans: list[list[dict]] = [[] for _ in range(n)]
        for a, b, r in zip(start.tolist(), end.tolist(), row.tolist()):
            spans[r].append({"first": a - int(bounds[r]), "past": b - int(bounds[r])})
        kind = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
        return {
            "doc_id": t.column("doc_id"),
            "n_bytes": np.diff(bounds),
            "n_removed": tx.row_sums(gone, bounds),
            "n_spans": np.bincount(row, minlength=n),
            "kept_sha256": [hashlib.sha256(kept[size[a] : size[b]]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])],
            "spans": pa.array(spans, kind),
        }

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:long,past:long>>"
    return tx.map_texts(rows, run, schema)
