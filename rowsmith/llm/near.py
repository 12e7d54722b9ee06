"""Near-duplicate documents by HyperMinHash sketches.

A document is its set of 5-word shingles. Its sketch has 128 buckets; each keeps
the smallest shingle hash of the bucket, compressed to a count of leading zeros and
ten mantissa bits. Empty buckets borrow from a seeded probe order, so short
texts agree in as many registers as long ones. Four registers make a band, and 32
bands give candidates. The Jaccard estimate, corrected for chance
collisions of registers, drops poor candidates; the rest are confirmed on full sets.

Documents with the same set are one class. Classes in a band bucket are estimated against
the smallest of it, never all against all; classes that this leaves in several
families of one bucket are estimated across the families. Likely pairs make families.
A family that fits one task is settled there on full sets. In a larger one
every class is confirmed against its smallest likely partner first; what that leaves
outside the main component is compared with all of the family, block by block. No pair of a
bucket stays uncompared unless it is connected already.

At a similarity of 0.75 a pair shares no band with probability 5e-6, at 0.8 with 5e-8.

Defined cases: documents without words, with null text or without
doc_id are linked with nothing; rows with the same doc_id are one document with
the links of all its rows; repeated rows are returned each.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm import text as tx
from rowsmith.llm.components import components
from rowsmith.operators.shared import shuffle_partitions, written

BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
REST_BITS = 64 - BUCKET_BITS
MANTISSA_BITS = 10
EMPTY = np.uint16(0xFFFF)
BLOCK_ROWS = 1024
BLOCK_BYTES = 8 << 20


@dataclass(frozen=True)
class NearSettings:
    words: int = 5
    percent: int = 75
    band: int = 4
    slack: float = 0.25  # of the estimate below the similarity, over six standard errors


def shingles(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every different shingle, ascending; fewer words are one shingle."""
    data = tx.LOWER[data]
    start, end, row = tx.word_spans(data, bounds)
    h = tx.span_hashes(data, start, end)
    n = len(bounds) - 1
    first = tx.group_bounds(row, n)
    count = np.diff(first)
    rows, hashes = [], []
    if len(h) >= words:
        whole = h[: len(h) - words + 1]
        for k in range(1, words):
            whole = tx.joined(whole, h[k : len(h) - words + 1 + k])
        inside = row[words - 1 :] == row[: len(row) - words + 1]
        rows.append(row[: len(inside)][inside])
        hashes.append(whole[inside])
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        value = h[first[short]]
        for k in range(1, words - 1):
            more = count[short] > k
            value[more] = tx.joined(value[more], h[first[short][more] + k])
        rows.append(short)
        hashes.append(tx.mix(value + count[short].astype(np.uint64)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tx.distinct_in_rows(np.concatenate(rows), np.concatenate(hashes))


def probe_order() -> np.ndarray:
    """For each bucket the order in which it asks the others when it is empty."""
    rng = np.random.default_rng(5)
    return np.stack([rng.permutation(BUCKETS) for _ in range(BUCKETS)])


PROBES = probe_order()


def registers(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """n x 128 registers from ascending (row, hash): the first hash of each bucket is its smallest."""
    out = np.full((n, BUCKETS), EMPTY, dtype=np.uint16)
    if not len(rows):
        return out
    bucket = (hashes >> np.uint64(REST_BITS)).astype(np.int64)
    slot = rows * BUCKETS + bucket
    head = np.ones(len(slot), dtype=bool)
    head[1:] = slot[1:] != slot[:-1]
    rest = (hashes[head] & np.uint64((1 << REST_BITS) - 1)).astype(np.float64)
    fraction, exponent = np.frexp(rest)
    mantissa = np.maximum((fraction - 0.5) * (2 << MANTISSA_BITS), 0).astype(np.int64)
    zeros = REST_BITS - exponent
    out.reshape(-1)[slot[head]] = (zeros << MANTISSA_BITS) + np.minimum(mantissa, (1 << MANTISSA_BITS) - 1)
    own = out.copy()
    lacking = np.flatnonzero((own == EMPTY) & (own != EMPTY).any(axis=1)[:, None])
    r, b = lacking // BUCKETS, lacking % BUCKETS
    for turn in range(BUCKETS):
        if not len(r):
            break
        lent = own[r, PROBES[b, turn]]
        found = lent != EMPTY
        out[r[found], b[found]] = lent[found]
        r, b = r[~found], b[~found]
    return out


def sketches(docs: DataFrame, settings: NearSettings = NearSettings()) -> DataFrame:
    """doc_id, n (shingles), digest of the set, registers."""
    words = settings.words

    def run(rows, data, bounds):
        n = len(bounds) - 1
        row, h = shingles(data, bounds, words)
        limits = tx.group_bounds(row, n)
        raw = h.tobytes()
        digest = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(limits[:-1], limits[1:])]
        regs = registers(row, h, n)
        return {
            "doc_id": rows.column("doc_id"),
            "n": np.diff(limits),
            "digest": pa.array(digest, pa.binary()),
            "registers": pa.array([r.tobytes() for r in regs], pa.binary()),
        }

    return tx.map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n long, digest binary, registers binary")


def bands(classes: DataFrame, width: int) -> DataFrame:
    """key, node: 64 bits name a band and its registers."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            regs = np.frombuffer(b"".join(b.column("registers").to_pylist()), dtype=np.uint16).reshape(b.num_rows, BUCKETS // width, width)
            key = np.zeros(regs.shape[:2], dtype=np.uint64) + np.arange(BUCKETS // width, dtype=np.uint64)
            for k in range(width):
                key = tx.joined(key, regs[:, :, k].astype(np.uint64))
            node = np.repeat(b.column("node").to_numpy(), BUCKETS // width)
            yield pa.RecordBatch.from_pydict({"key": pa.array(key.reshape(-1).view(np.int64)), "node": pa.array(node)})

    return classes.select("node", "registers").mapInArrow(run, "key long, node long")


def estimated(agree: np.ndarray, na: np.ndarray, nb: np.ndarray, settings: NearSettings) -> np.ndarray:
    """Whether sizes allow the similarity and the share of equal registers, corrected for chance, comes near it."""
    less, more = np.minimum(na, nb), np.maximum(na, nb)
    ratio = more / less
    # Chance that different minima share a register: about 0.17 / 2^mantissa, less for unequal sizes.
    chance = 0.169919487159739093975315012348 / (1 << MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2
    return (less * 100 >= more * settings.percent) & ((agree - chance) / (1 - chance) >= settings.percent / 100 - settings.slack)


def likely(pairs: DataFrame, classes: DataFrame, settings: NearSettings) -> DataFrame:
    """The pairs (a, b) whose sizes allow the similarity and whose corrected estimate comes near it."""
    a = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    b = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    fits = f"least(na, nb) * 100 >= greatest(na, nb) * {settings.percent}"
    both = pairs.join(a, "a").join(b, "b").where(fits)

    def run(batches):
        for t in batches:
            if not t.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(t.column(c).to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
            good = estimated((ra == rb).mean(axis=1), t.column("na").to_numpy(), t.column("nb").to_numpy(), settings)
            yield t.select(["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long").distinct()


def full_sets(docs: DataFrame, nodes: DataFrame, settings: NearSettings) -> DataFrame:
    """node, set: the sorted shingle hashes of the documents named by `nodes`."""
    wanted = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node", "left_semi")
    words = settings.words

    def run(rows, data, bounds):
        row, h = shingles(data, bounds, words)
        limits, raw = tx.group_bounds(row, len(bounds) - 1), h.tobytes()
        return {"node": rows.column("node"), "shingles": pa.array([raw[8 * a : 8 * b] for a, b in zip(limits[:-1], limits[1:])], pa.binary())}

    return tx.map_texts(wanted, run, "node long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, settings: NearSettings) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    percent = settings.percent
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"
    )

    def run(batches):
        for t in batches:
            good = []
            for x, y in zip(t.column("sa"), t.column("sb")):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                common = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * common >= percent * (len(p) + len(q) - common) and common > 0)
            yield t.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def blocks(rows: DataFrame) -> DataFrame:
    """Deal rows (g, label, node, bytes, payload) to blocks (g, q, j) in which all labels of a group meet.

    The most common label of a group is its main one. Rows of other labels are
    asked against all rows, so they go to every block of their column, and all rows
    to every block of their line: block sizes stay fixed, and no row of the main
    label meets another one for nothing.
    """
    count = rows.groupBy("g", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("bytes").alias("size"))
    main = count.groupBy("g").agg(
        F.max(F.struct("k", "label"))["label"].alias("main"), F.sum("k").alias("k"), F.sum("size").alias("size"),
        F.max(F.struct("k", "size")).alias("most"),
    )
    parts = lambda k, size: F.ceil(F.greatest(k / BLOCK_ROWS, size / BLOCK_BYTES, F.lit(1e-9)))
    plan = main.select(
        "g", "main", parts(F.col("k"), F.col("size")).alias("lines"), parts(F.col("k") - F.col("most.k"), F.col("size") - F.col("most.size")).alias("columns")
    )
    placed = rows.join(plan, "g")
    spread = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    home = placed.select("g", every(F.col("columns")).alias("q"), spread(F.col("lines"), 1).alias("j"), F.lit(False).alias("asks"), "label", "node", "payload")
    asked = placed.where("label <> main").select(
        "g", spread(F.col("columns"), 2).alias("q"), every(F.col("lines")).alias("j"), F.lit(True).alias("asks"), "label", "node", "payload"
    )
    return home.unionByName(asked)


def one_per_label(x: np.ndarray, y: np.ndarray, nodes_x, nodes_y, labels_y) -> pa.Table:
    """Pairs (x, y) by place, one for each x and label of y."""
    order = np.lexsort((nodes_y[y], labels_y[y], x))
    x, y = x[order], y[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (labels_y[y][1:] != labels_y[y][:-1])
    return pa.table({"a": pa.array(nodes_x[x[new]]), "b": pa.array(nodes_y[y[new]])})


def compare_blocks(dealt: DataFrame, alike) -> DataFrame:
    """Pairs of different labels for which alike(payloads, payloads) holds."""

    def run(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        asks = block["asks"].to_numpy()
        x, y = (block.filter(pa.array(m)) for m in (asks, ~asks))
        if not len(x) or not len(y):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        nx, ny, lx, ly = (t[c].to_numpy() for c in ("node", "label") for t in (x, y))
        good = alike(x["payload"].to_pylist(), y["payload"].to_pylist()) & (lx[:, None] != ly[None, :])
        return one_per_label(*np.nonzero(good), nx, ny, ly)

    return dealt.groupBy("g", "q", "j").applyInArrow(run, "a long, b long")


def similar(sets: list[bytes], others: list[bytes], percent: int) -> np.ndarray:
    """Matrix of whether 100 * common >= percent * union, for sets of shingle hashes; by products of incidence matrices."""
    x, y = ([np.frombuffer(v, dtype=np.uint64) for v in s] for s in (sets, others))
    if len(x) * len(y) <= 64:
        common = np.array([[len(np.intersect1d(p, q, assume_unique=True)) for q in y] for p in x], dtype=np.int64)
    else:
        # Only shingles in both sides can be common.
        shared = np.intersect1d(np.unique(np.concatenate(x)), np.unique(np.concatenate(y)))
        common = np.zeros((len(x), len(y)), dtype=np.int64)
        for at in range(0, len(shared), 4096):
            part = shared[at : at + 4096]
            a, b = np.zeros((len(x), len(part)), dtype=np.float32), np.zeros((len(y), len(part)), dtype=np.float32)
            for m, own in ((a, x), (b, y)):
                for i, s in enumerate(own):
                    s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")]
                    k = np.minimum(np.searchsorted(part, s), len(part) - 1)
                    m[i, k[part[k] == s]] = 1
            common += (a @ b.T).astype(np.int64)
    size_x, size_y = np.array([len(p) for p in x]), np.array([len(q) for q in y])
    return (100 * common >= percent * (size_x[:, None] + size_y[None, :] - common)) & (common > 0)


def settled(families: DataFrame, percent: int) -> DataFrame:
    """node, root for families (f, node, shingles) that fit one task."""

    def solve(nodes: list[int], sets: list[bytes]):
        linked = similar(sets, sets, percent)
        label = np.arange(len(nodes))
        while True:
            # The smallest label among the neighbours, then that one's own.
            lower = np.where(linked, label[None, :], len(nodes)).min(axis=1)
            lower = np.minimum(lower, label)
            lower = lower[lower]
            if (lower == label).all():
                break
            label = lower
        order = np.array(nodes)
        return order, order[label]

    def run(batches):
        current, nodes, sets, out = None, [], [], ([], [])

        def close():
            if nodes:
                for held, more in zip(out, solve(nodes, sets)):
                    held.append(more)

        for t in batches:
            for f, node, shingle in zip(t.column("f").to_pylist(), t.column("node").to_pylist(), t.column("shingles").to_pylist()):
                if f != current:
                    close()
                    current, nodes, sets = f, [], []
                nodes.append(node)
                sets.append(shingle)
        close()
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["node", "root"])

    spread = families.repartition(shuffle_partitions(families.sparkSession), "f").sortWithinPartitions("f", "node")
    return spread.select("f", "node", "shingles").mapInArrow(run, "node long, root long")


def links(docs: DataFrame, classes: DataFrame, settings: NearSettings) -> DataFrame:
    """node, root for every class that has a likely partner; without a link the root is the node's own."""
    percent = settings.percent
    keyed = bands(classes, settings.band)
    buckets = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("_last")).where("a < _last").select("key", "a")
    met = written(keyed.join(buckets, "key").select("key", "a", F.col("node").alias("b")))
    good = written(likely(met.where("a < b").select("a", "b").distinct(), classes, settings))
    family = written(components(good))

    # Buckets that hold several families: estimate across them.
    placed = met.join(family.withColumnRenamed("node", "b"), "b", "left").select("key", F.col("b").alias("node"), F.coalesce("root", "b").alias("label"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high").select("key")
    sized = F.concat(F.unhex(F.lpad(F.hex("n"), 16, "0")), F.col("registers"))
    open_ = placed.join(mixed, "key").join(classes.select("node", sized.alias("payload")), "node")
    rows = written(open_.select(F.col("key").alias("g"), "label", "node", F.lit(8 + 2 * BUCKETS).alias("bytes"), "payload"))

    def near(x, y):
        # The whole test, as only one pair of those that pass is kept for each label.
        held = [np.frombuffer(b"".join(v), dtype=[("n", ">i8"), ("registers", np.uint16, BUCKETS)]) for v in (x, y)]
        (na, a), (nb, b) = ((h["n"].astype(np.int64), np.ascontiguousarray(h["registers"])) for h in held)
        return np.array([estimated((b == one).mean(axis=1), n, nb, settings) for one, n in zip(a, na)])

    more = written(compare_blocks(blocks(rows), near).distinct())
    if not more.isEmpty():
        good = good.unionByName(more)
        family = written(components(good))

    nodes = family.select("node", F.col("root").alias("f"))
    sets = written(full_sets(docs, nodes.select("node"), settings).join(nodes, "node"))
    size = sets.groupBy("f").agg(F.count(F.lit(1)).alias("_k"), F.sum(F.octet_length("shingles")).alias("_size"))
    large = written(size.where((F.col("_k") > BLOCK_ROWS) | (F.col("_size") > 2 * BLOCK_BYTES)).select("f"))
    if large.isEmpty():
        return settled(sets, percent)
    small = settled(sets.join(large, "f", "left_anti"), percent)
    members = written(sets.join(large, "f", "left_semi"))
    first = good.groupBy(F.greatest("a", "b").alias("b")).agg(F.min(F.least("a", "b")).alias("a")).join(members.select(F.col("node").alias("b")), "b", "left_semi")
    sure = written(confirmed(first.select("a", "b"), members, settings))
    found = written(components(sure))
    rows = members.join(found, "node", "left").select(
        F.col("f").alias("g"), F.coalesce("root", "node").alias("label"), "node", F.octet_length("shingles").alias("bytes"), F.col("shingles").alias("payload")
    )
    across = compare_blocks(blocks(written(rows)), lambda x, y: similar(x, y, percent))
    return small.unionByName(components(sure.unionByName(across)))


def near_duplicates(docs: DataFrame, settings: NearSettings = NearSettings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows = written(sketches(docs, settings))
    smallest = F.min(F.struct("doc_id", "n", "registers")).alias("s")
    linked = rows.where("doc_id IS NOT NULL AND n > 0")
    classes = written(linked.groupBy("digest").agg(smallest).select("digest", "s.n", "s.registers", F.col("s.doc_id").alias("node")))
    found = links(docs, classes, settings)
    # One id may stand for several rows with different texts; its class is then that of all of them.
    member = linked.select("doc_id", "digest").join(classes.select("digest", "node"), "digest").select("doc_id", "node").distinct()
    own = member.join(found, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    clash = own.groupBy("doc_id").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low < _high")
    clash = written(clash)
    if not clash.isEmpty():
        joined = components(clash.select(F.col("_low").alias("a"), F.col("_high").alias("b")).union(own.select(F.col("doc_id").alias("a"), F.col("root").alias("b"))))
        own = own.join(joined.select(F.col("node").alias("doc_id"), F.col("root").alias("_r")), "doc_id", "left").select("doc_id", F.coalesce("_r", "root").alias("root"))
    own = written(own.distinct())
    named = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    whole = own.join(named, "root").select("doc_id", "component_id")
    return (
        rows.join(whole, "doc_id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
    )


def one_of_each(docs: DataFrame, settings: NearSettings = NearSettings()) -> DataFrame:
    """`docs` with one document of each group: the rows that are kept, in all their columns."""
    gone = near_duplicates(docs, settings).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    inner = docs.toDF(*[f"d{i}" for i in range(len(docs.columns))])
    key = F.col(f"d{docs.columns.index('doc_id')}").cast("long")
    return inner.join(gone, key == F.col("_gone"), "left_anti").toDF(*docs.columns)
