"""Best-fit packing of documents into bins of a fixed number of words, with conflicts.

Bins stand in the order of their residual. For a piece of text, the successor
search starts at the first bin with room enough and goes on until it meets the
tightest compatible one: a bin carries bitmaps of the sources and of the
duplicate clusters in it, and takes no second piece of either. Two names that
share a bit of the 64 only make a bin refuse a piece it could hold.

Texts longer than a bin are cut: full pieces are bins by themselves, the rest
is packed. Rows are dealt by a hash of their id, cluster and number in the
written table to shards of about `shard_rows`, each packed in one task by
itself, so a hot source or cluster and rows that repeat are spread evenly.

Defined cases: a null or empty text has one piece without words, which is
packed like the others; a null source or cluster is a source or cluster of its own;
null doc_ids and repeated rows are packed each alone.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm import text as tx

PIECE = "doc_id long, piece long, first_word long, n_words long, bin_id string, source string, cluster long"


@dataclass(frozen=True)
class PackSettings:
    capacity: int = 2048
    shard_rows: int = 4096
    seed: int = 31


class OpenBins:
    """Bins by residual, under a tree that knows what all bins below a node conflict with.

    A node holds the sources and the clusters that every bin below it has. A
    piece of one of them finds nothing there, so the search passes over the
    whole branch: pieces that conflict with all bins cost no more than others.
    """

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.in_all = [(-1, -1)] * (2 * self.width)
        self.bins: dict[int, dict[tuple[int, int], list[int]]] = {}

    def add(self, residual: int, masks: tuple[int, int], number: int) -> None:
        heapq.heappush(self.bins.setdefault(residual, {}).setdefault(masks, []), number)
        self._renew(residual)

    def take(self, size: int, source: int, cluster: int) -> tuple[int, tuple[int, int], int] | None:
        """Remove and return the tightest compatible bin, of equal ones the first: (residual, masks, number)."""
        waiting = [(1, 0, self.width)]
        while waiting:
            node, low, high = waiting.pop()
            sources, clusters = self.in_all[node]
            if high <= size or sources & source or clusters & cluster:
                continue
            if high - low > 1:
                middle = (low + high) // 2
                waiting += [(2 * node + 1, middle, high), (2 * node, low, middle)]
                continue
            fitting = [(numbers[0], masks) for masks, numbers in self.bins[low].items() if not (masks[0] & source or masks[1] & cluster)]
            if fitting:
                number, masks = min(fitting)
                heapq.heappop(self.bins[low][masks])
                if not self.bins[low][masks]:
                    del self.bins[low][masks]
                self._renew(low)
                return low, masks, number
        return None

    def _renew(self, residual: int) -> None:
        sources = clusters = -1
        for a, b in self.bins[residual]:
            sources, clusters = sources & a, clusters & b
        node = self.width + residual
        self.in_all[node] = sources, clusters
        while node > 1:
            node //= 2
            (a, b), (c, d) = self.in_all[2 * node], self.in_all[2 * node + 1]
            if self.in_all[node] == (a & c, b & d):
                return
            self.in_all[node] = a & c, b & d


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """Bin number of each piece; pieces come largest first, ties as given. Bits of sources and clusters are masks."""
    bins, count = OpenBins(capacity), 0
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = bins.take(sizes[i], sources[i], clusters[i])
        if found is None:
            found, count = (capacity, (0, 0), count), count + 1
        residual, (source, cluster), number = found
        bins.add(residual - sizes[i], (source | sources[i], cluster | clusters[i]), number)
        out[i] = number
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, cluster: documents with the same words are one cluster."""

    def run(rows, data, bounds):
        start, end, row = tx.word_spans(data, bounds)
        n = len(bounds) - 1
        h = tx.span_hashes(data, start, end)
        place = tx.positions_in_row(row, n)
        # The sum over (word, place) hashes names a word sequence; it does not depend on the separators.
        cluster = tx.row_sums(tx.joined(h, place.astype(np.uint64)).view(np.int64), tx.group_bounds(row, n))
        return {
            "doc_id": rows.column("doc_id"),
            "source": rows.column("source"),
            "size": np.bincount(row, minlength=n),
            "cluster": cluster,
        }

    columns = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")
    return tx.map_texts(columns, run, "doc_id long, source string, size long, cluster long")


def pack(rows: DataFrame, settings: PackSettings = PackSettings()) -> DataFrame:
    """A row per piece, from a written table of doc_id, source, size and cluster."""
    capacity = settings.capacity
    total = rows.count()
    shards = max(1, -(-total // settings.shard_rows))

    def place(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        order = np.lexsort((group["cluster"].fill_null(0).to_numpy(), group["doc_id"].fill_null(-1).to_numpy()))
        group = group.take(pa.array(order))
        size = group["size"].to_numpy()
        shard = key[0].as_py()
        full = np.maximum(-(-size // capacity), 1)
        owner = np.repeat(np.arange(len(size)), full)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        words = np.minimum(size[owner] - piece * capacity, capacity)
        source = [1 << (int(b) & 63) for b in group["_source_bit"].to_numpy()]
        cluster = [1 << (int(b) & 63) for b in group["_cluster_bit"].to_numpy()]
        open_ = np.flatnonzero(words < capacity)
        number = np.zeros(len(owner), dtype=np.int64)
        number[open_] = best_fit(
            words[open_].tolist(), [source[owner[i]] for i in open_], [cluster[owner[i]] for i in open_], capacity
        )
        closed = np.flatnonzero(words >= capacity)
        number[closed] = (number[open_].max() + 1 if len(open_) else 0) + np.arange(len(closed))
        return pa.table(
            {
                "doc_id": group["doc_id"].take(pa.array(owner)),
                "piece": pa.array(piece.astype(np.int64)),
                "first_word": pa.array((piece * capacity).astype(np.int64)),
                "n_words": pa.array(words.astype(np.int64)),
                "bin_id": pa.array([f"{shard}-{b}" for b in number.tolist()]),
                "source": group["source"].take(pa.array(owner)),
                "cluster": group["cluster"].take(pa.array(owner)),
            }
        )

    dealt = rows.select(
        "doc_id",
        "source",
        "size",
        "cluster",
        # The number of a row in the written table parts rows that repeat.
        F.pmod(F.xxhash64("doc_id", "cluster", F.lit(settings.seed), F.monotonically_increasing_id()), F.lit(shards)).alias("_shard"),
        F.xxhash64(F.coalesce("source", F.lit("\x00"))).alias("_source_bit"),
        F.xxhash64(F.coalesce("cluster", F.lit(-1).cast("long"))).alias("_cluster_bit"),
    )
    return dealt.groupBy("_shard").applyInArrow(place, PIECE)
