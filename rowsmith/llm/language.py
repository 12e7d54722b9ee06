"""Scoring by a probabilistic suffix tree over words.

Symbols are the tokens of a text: its words and one end. Contexts are the last one to
`depth` words. Sequences that stand `fewest` times in the training texts, a fixed number at any
size of the input, are candidates (a share of the tokens can be asked for besides). A context is retained when its
next-symbol distribution diverges enough from that of its longest retained suffix, and
its distribution is smoothed with that one's; the root is the smoothed word
distribution. A token is scored from the longest retained suffix of its history.

All counts are exact and cover all training texts. A context, its suffixes and the tokens that follow it end with the
same word, so all places of a text are dealt to parts by the word before them, and each part grows the tree
under its words and scores its places by itself. Where a context stands more often than half a part (only
a few can), its followers are counted by an aggregation over all tasks and its places are dealt by the next longer
context; the followers' chances travel to the parts that hold them, and the tree is grown from there.
Words of the highest counts (at most 1 / `frequent`) travel as small numbers, with their chances; the chances of the others come by a
join. Words that stand once in training texts are never part of a sequence that stands twice: a bitmap of
a fixed size tells most of them, so that they take no room (it may miss some, which are counted like others).

Defined cases: a null or empty text is the end token alone; a row without
doc_id is held out; equal rows are scored each; without training rows every
token is unseen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm import text as tx
from rowsmith.operators.shared import scope, shuffle_partitions, shuffles_removed, table_folder, written

END = np.uint64(0x5DEECE66D1234567)  # the hash that stands for the end of a text
GATE_BITS = 27
#: Words travel as 1, 2, ... by falling counts, else as their hash with this bit; 0 stands for none and for those that stand once.
RARE = np.uint64(1 << 63)
FIRST_BITS = 20
ESCAPE = np.uint64(2**32 - 1)
BLOCK_TOKENS = 1_000_000
#: Rows that pass between the JVM and Python at once: of texts, which are long, and of sequences.
BATCH_ROWS = 500
OUT_ROWS = 65_536
#: Work is dealt to so many parts at least, unless they would have fewer tokens than LEAST_PART.
LEAST_PARTS = 256
LEAST_PART = 50_000
#: The places are dealt and scored in so many rounds, each over its share of the parts, as their shuffle outweighs the tables.
ROUNDS = 2


@dataclass(frozen=True)
class TreeSettings:
    depth: int = 3
    fewest: int = 2
    least: float = 0.0  # share of the training tokens that a sequence must have besides
    divergence: float = 8.0
    smoothing: float = 2.0
    frequent: float = 2e-6
    unseen: float = 0.1
    part: int = 500_000  # places that a task handles together


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, text."""
    id_ = F.col("doc_id").cast("long")
    held = F.coalesce(F.crc32(id_.cast("string")) % 10, F.lit(0)) == 0
    return docs.select(id_.alias("doc_id"), held.alias("held_out"), "text")


# --- counting ----------------------------------------------------------------


def with_ends(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and their rows: the words of each row and its end."""
    tokens = np.empty(len(h) + n, dtype=np.uint64)
    tokens[np.arange(len(h)) + row] = h
    tokens[tx.group_bounds(row, n)[1:] + np.arange(n)] = END
    owner = np.repeat(np.arange(n), np.bincount(row, minlength=n) + 1)
    return tokens, owner


def sequences(tokens: np.ndarray, owner: np.ndarray, depth: int):
    """All sequences of 2 to depth + 1 tokens of one text.

    Yields n, the places, the hashes, the hashes of the contexts (without the
    last token) and of the suffixes (without the first).
    """
    before = tokens
    for n in range(2, depth + 2):
        size = max(len(tokens) - n + 1, 0)
        whole = tx.joined(before[:size], tokens[n - 1 :])
        at = np.flatnonzero(owner[n - 1 :] == owner[:size])
        if not len(at):
            return
        yield n, at, whole[at], before[at], before[at + 1]
        before = whole


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys ascending, the place of one of each, and their counts."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return ordered[new], order[new], np.diff(np.append(new, len(keys)))


class Blocks:
    """Tokens of training texts gathered to blocks of about BLOCK_TOKENS."""

    def __init__(self):
        self.tokens, self.sizes, self.held = [], [], 0

    def add(self, tokens: np.ndarray, owner: np.ndarray, rows: np.ndarray) -> bool:
        """Take the tokens of the marked rows; whether the block is full."""
        keep = rows[owner]
        self.tokens.append(tokens[keep])
        self.sizes.append(np.bincount(owner, minlength=len(rows))[rows])
        self.held += int(keep.sum())
        return self.held >= BLOCK_TOKENS

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        tokens, sizes = np.concatenate(self.tokens), np.concatenate(self.sizes)
        self.__init__()
        return tokens, np.repeat(np.arange(len(sizes)), sizes)


def by_part(part: np.ndarray, parts: int):
    """Each part that there is, and its places in their order."""
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        yield p, order[bounds[p] : bounds[p + 1]]


def dealt(keys: np.ndarray, columns: list[np.ndarray], parts: int):
    """part, and the keys and columns of each part of the keys."""
    for p, mine in by_part((keys % np.uint64(parts)).astype(np.int64), parts):
        yield p, [x[mine].tobytes() for x in (keys, *columns)]


def summed(blocks: DataFrame, key: str, columns: dict[str, type]) -> DataFrame:
    """Sums by key of blocks that were dealt: part, and the bytes of the keys and of each column."""
    kinds = {np.int64: "long", np.float64: "double"}

    def run(t: pa.Table) -> pa.Table:
        keys, *values = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in ((key, np.uint64), *columns.items()))
        distinct, at = np.unique(keys, return_inverse=True)
        sums = [np.bincount(at, weights=v, minlength=len(distinct)).astype(v.dtype) for v in values]
        return pa.table([pa.array(distinct.view(np.int64)), *(pa.array(v) for v in sums)], names=[key, *columns])

    return blocks.groupBy("part").applyInArrow(run, ", ".join([f"{key} long", *(f"{c} {kinds[k]}" for c, k in columns.items())]))


def word_counts(rows: DataFrame) -> DataFrame:
    """h, trained, total: how often each word stands in training texts and in all."""
    parts = shuffle_partitions(rows.sparkSession)

    def run(batches):
        held, size = [], 0

        def words():
            h, trains = (np.concatenate(x) for x in zip(*held))
            held.clear()
            (mine, n), (others, m) = (np.unique(h[yes], return_counts=True) for yes in (trains, ~trains))
            counts = [np.concatenate(x) for x in ((n, np.zeros_like(m)), (n, m))]
            found = list(dealt(np.concatenate([mine, others]), counts, parts))
            columns = [pa.array([p for p, _ in found], pa.int32()), *(pa.array([x[i] for _, x in found], pa.binary()) for i in range(3))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "h", "trained", "total"])

        for t in tx.pieces(batches, "text"):
            data, bounds = tx.text_bytes(t.column("text"))
            data = tx.LOWER[data]
            start, end, row = tx.word_spans(data, bounds)
            held.append((tx.span_hashes(data, start, end), ~t.column("held_out").to_numpy(zero_copy_only=False)[row]))
            size += len(start)
            if size >= 2 * BLOCK_TOKENS:
                yield from words()
                size = 0
        if size:
            yield from words()

    found = rows.select("held_out", "text").mapInArrow(run, "part int, h binary, trained binary, total binary")
    return summed(found, "h", {"trained": np.int64, "total": np.int64})


def passes(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys a bitmap does not rule out."""
    place = keys >> np.uint64(64 - GATE_BITS)
    return (marks[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def counted_sequences(rows: DataFrame, length: int, shorter: DataFrame, least: float) -> DataFrame:
    """key, context, suffix, count of the sequences of `length` tokens that stand `least` times in training texts.

    For counts on their own; `score` counts within its parts.
    `shorter` has the keys of those one token shorter, that of the END included.
    """
    held = rows.sparkSession.sparkContext.broadcast(gate(shorter))
    names = ["context", "word", *(["suffix"] if length > 2 else []), "count"]  # of two tokens, the suffix is the word

    def run(batches):
        blocks = Blocks()

        def solve():
            tokens, owner = blocks.take()
            for n, at, key, context, suffix in sequences(tokens, owner, length - 1):
                if n < length:
                    continue
                word = tokens[at + n - 1]
                open_ = np.flatnonzero(passes(held.value, context) & passes(held.value, suffix if n > 2 else word))
                _, one, count = counted(key[open_])
                one = open_[one]
                long = [context[one], word[one], *([suffix[one]] if n > 2 else [])]
                out = pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in long), pa.array(count)], names)
                for first in range(0, out.num_rows, OUT_ROWS):
                    yield out.slice(first, OUT_ROWS)

        for t in tx.pieces(batches, "text"):
            data, bounds = tx.text_bytes(t.column("text"))
            data = tx.LOWER[data]
            start, end, row = tx.word_spans(data, bounds)
            n = len(bounds) - 1
            if blocks.add(*with_ends(tx.span_hashes(data, start, end), row, n), np.ones(n, dtype=bool)):
                yield from solve()
        if blocks.held:
            yield from solve()

    def keys(batches):
        for t in batches:
            context, word = (t.column(c).to_numpy().view(np.uint64) for c in ("context", "word"))
            key = pa.array(tx.joined(context, word).view(np.int64))
            columns = [key, *(t.column(c) for c in ("context", "suffix" if length > 2 else "word", "count"))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "context", "suffix", "count"])

    found = rows.where("NOT held_out").select("text").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    suffixes = [F.first("suffix").alias("suffix")] if length > 2 else []
    whole = found.groupBy("context", "word").agg(*suffixes, F.sum("count").alias("count")).where(F.col("count") >= least)
    out = written(whole.select(*names).mapInArrow(keys, "key long, context long, suffix long, count long"))
    held.destroy()  # its copies are files on every machine
    return out


# --- the tree ----------------------------------------------------------------


def lookup(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted keys exist, and the places of those."""
    if not len(sorted_keys) or not len(wanted):
        return np.zeros(len(wanted), dtype=bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    hit = sorted_keys[at] == wanted
    return hit, at[hit]


@dataclass(frozen=True)
class Words:
    """What travels of the words: hashes ascending, their numbers, the chances by number, the bitmap of the others that stand twice.

    `first`: the place of the first hash of each `FIRST_BITS` leading bits.
    """

    keys: np.ndarray
    first: np.ndarray
    number: np.ndarray
    chance: np.ndarray
    known: np.ndarray
    marks: np.ndarray

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes as they travel, and which of them have a number."""
        at = self.first[(h >> np.uint64(64 - FIRST_BITS)).astype(np.int64)]
        less = np.flatnonzero((self.keys[at] < h) & (at < len(self.keys) - 1))
        while len(less):
            at[less] += 1
            less = less[(self.keys[at[less]] < h[less]) & (at[less] < len(self.keys) - 1)]
        hit = self.keys[at] == h
        out = np.empty(len(h), np.uint64)
        out[hit] = self.number[at[hit]]
        others = np.flatnonzero(~hit)
        other = h[others]
        out[others] = np.where(passes(self.marks, other), other | RARE, np.uint64(0))
        return out, hit


@dataclass(frozen=True)
class Crowded:
    """Contexts of one length that stand too often for one part, ascending, and the number of parts of each."""

    keys: np.ndarray
    shares: np.ndarray


def read(t: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of texts, their rows, and a mark of each row, which equal rows share; its lowest bit is 1 for training texts."""
    data, bounds = tx.text_bytes(t.column("text"))
    ids = t.column("doc_id")
    own_id = ids.fill_null(0).to_numpy().view(np.uint64)
    mark = tx.joined(tx.span_hashes(data, bounds[:-1], bounds[1:]), own_id)
    mark = tx.joined(mark, ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint64))
    trains = ~t.column("held_out").to_numpy(zero_copy_only=False)
    mark = mark & ~np.uint64(1) | trains
    data = tx.LOWER[data]
    start, end, row = tx.word_spans(data, bounds)
    tokens, owner = with_ends(tx.span_hashes(data, start, end), row, len(bounds) - 1)
    return tokens, owner, mark


def words_before(ids: np.ndarray, owner: np.ndarray, depth: int) -> list[np.ndarray]:
    """The last, the second last, ... word before each token; 0 from the first that is missing or stands once."""
    out = []
    for n in range(1, depth + 1):
        word = np.zeros_like(ids)
        word[n:] = np.where(owner[n:] == owner[:-n], ids[:-n], np.uint64(0))
        if out:
            word[out[-1] == 0] = 0
        out.append(word)
    return out


def contexts(words: list[np.ndarray]) -> list[np.ndarray]:
    """The hashes of the contexts of 1, 2, ... words; 0 where there is none."""
    out = []
    for n in range(len(words)):
        h = words[n]
        for word in reversed(words[:n]):
            h = tx.joined(h, word)
        out.append(np.where(words[n] != 0, h, np.uint64(0)))
    return out


def first_part(context: np.ndarray, parts: int) -> np.ndarray:
    return (tx.mix(context) % np.uint64(parts)).astype(np.int64)


def crowded_levels(found: list[np.ndarray], crowded: list[Crowded]):
    """How many of the contexts of each token are crowded, and what is found of each length: length - 1, places, their keys' places."""
    start, hits = np.zeros(len(found[0]), np.int8), []
    for n, level in enumerate(crowded):
        live = np.flatnonzero(start == n)
        hit, at = lookup(level.keys, found[n][live])
        start[live[hit]] = n + 1
        hits.append((n, live[hit], at))
    return start, hits


def dealt_places(words: np.ndarray, mark: np.ndarray, crowded: list[Crowded], parts: int) -> np.ndarray:
    """The part of each token: by its last word, by the next longer context while that is crowded, at last by its text."""
    part = first_part(words[0], parts)
    if crowded:
        first = np.flatnonzero(lookup(crowded[0].keys, words[0])[0])
        found = contexts([w[first] for w in words])
        for n, at, key in crowded_levels(found, crowded)[1]:
            longer = found[n + 1][at] if n + 1 < len(found) else np.zeros(len(at), np.uint64)
            share = tx.mix(np.where(longer != 0, longer, mark[first[at]])) % crowded[n].shares[key].astype(np.uint64)
            part[first[at]] = (first_part(found[n][at], parts) + share.astype(np.int64)) % parts
    return part


FACTS = pa.schema(
    [("kind", pa.int32()), ("mark", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("copies", pa.int64()), ("n_tokens", pa.int64()),
     ("n_known", pa.int64()), ("base", pa.float64()), ("part", pa.int32()), ("h", pa.int64()), ("c", pa.int64()), ("suffix", pa.int64()), ("n", pa.int64())]
)


def facts(rows: DataFrame, held, crowd: np.ndarray, parts: int, below: float, settings: TreeSettings) -> DataFrame:
    """Rows of several kinds: 0 the documents, 1 their words without a number, 1 + n the tokens after n crowded words.

    h is 0 for a word that stands once. `crowd`: the crowded words.
    """

    def table(n: int, /, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in FACTS], schema=FACTS)

    def run(batches):
        after, size = [], 0
        logs = np.log10(held.value.chance)

        def followers():
            level, c, suffix, h, trains = (np.concatenate(x) for x in zip(*after))
            after.clear()
            _, one, at = np.unique(tx.joined(tx.joined(c, h), level.astype(np.uint64)), return_index=True, return_inverse=True)
            n = np.bincount(at, weights=trains, minlength=len(one)).astype(np.int64)
            longs = {k: pa.array(v[one].view(np.int64)) for k, v in (("c", c), ("suffix", suffix), ("h", h))}
            out = table(len(one), kind=pa.array(1 + level[one]), n=pa.array(n), **longs)
            for first in range(0, out.num_rows, OUT_ROWS):
                yield out.slice(first, OUT_ROWS)

        for t in tx.pieces(batches, "text"):
            words, n = held.value, t.num_rows
            tokens, owner, mark = read(t)
            ids, hit = words.ids(tokens)
            trains = (mark & np.uint64(1)).astype(bool)[owner]
            number = (ids[hit] - np.uint64(1)).astype(np.int64)
            # A word of a training text that neither has a number nor passes the bitmap stands once.
            once = ~hit & (ids == 0) & trains
            base = np.bincount(owner[hit], weights=logs[number], minlength=n)
            base += np.bincount(owner[once], minlength=n) * np.log10((1 + settings.unseen) / below)
            known = np.bincount(owner[hit], weights=words.known[number], minlength=n) + np.bincount(owner[once], minlength=n)
            yield table(
                n, kind=pa.array(np.zeros(n, np.int32)), mark=pa.array(mark.view(np.int64)), doc_id=t.column("doc_id"), held_out=t.column("held_out"),
                copies=pa.array(np.ones(n, np.int64)), n_tokens=pa.array(np.bincount(owner, minlength=n)), n_known=pa.array(known.astype(np.int64)),
                base=pa.array(base),
            )
            before = words_before(ids, owner, settings.depth)
            crowds = lookup(crowd, before[0])[0]
            rare = np.flatnonzero(~hit & ~once)
            part = np.where(crowds[rare] | (before[0][rare] == 0) | (ids[rare] == 0), -1, first_part(before[0][rare], parts))
            if len(rare):
                yield table(
                    len(rare), kind=pa.array(np.ones(len(rare), np.int32)), mark=pa.array(mark[owner[rare]].view(np.int64)),
                    part=pa.array(part.astype(np.int32)), h=pa.array(tokens[rare].view(np.int64)),
                )
            if not len(crowd):
                continue
            at = np.flatnonzero(crowds)
            shown = np.where(ids != 0, tokens, np.uint64(0))
            for level in range(1, settings.depth + 1):
                if level > 1:
                    at = at[lookup(crowd, before[level - 1][at])[0]]
                found = contexts([w[at] for w in before[:level]])
                suffix = found[level - 2] if level > 1 else np.zeros(len(at), np.uint64)
                after.append((np.full(len(at), level, np.int32), found[-1], suffix, shown[at], trains[at]))
                size += len(at)
            if size >= BLOCK_TOKENS:
                yield from followers()
                size = 0
        if size:
            yield from followers()

    kinds = {pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}
    return written(rows.mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in FACTS)))


def crowded_chances(found: DataFrame, words: DataFrame, most: float, least: float, parts: int, settings: TreeSettings, folder: str):
    """The crowded contexts of each length, and part, c, h, root, chance of the tokens that follow them anywhere.

    `found`: level, c, suffix, h, n as in `facts`; `words`: h, chance. A context is crowded that stands over `most` times.
    What travels is written to `folder`.
    """
    spark, crowded, travel, above = found.sparkSession, [], [], None
    counts = written(found.groupBy("level", "c", "h").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n")))
    for level in range(1, settings.depth + 1):
        mine = counts.where(F.col("level") == level)
        over = mine.groupBy("c").agg(F.sum("n").alias("total")).where(F.col("total") > most).collect()  # a bounded number
        if not over:
            break
        keys = np.array([r["c"] for r in over], np.int64).view(np.uint64)
        order = np.argsort(keys)
        shares = np.minimum(np.ceil(np.array([r["total"] for r in over]) / most).astype(np.int64), parts)
        crowded.append(Crowded(keys[order], shares[order]))
        places = list(zip(keys.view(np.int64).tolist(), [r["total"] for r in over], first_part(keys, parts).tolist(), shares.tolist()))
        named = mine.join(F.broadcast(spark.createDataFrame(places, "c long, total long, first int, shares long")), "c")
        if above is None:
            own = named.join(words, "h", "left").withColumn("root", F.coalesce("chance", F.lit(1.0))).withColumn("parent", F.col("root")).drop("chance")
        else:
            own = named.join(above, ["suffix", "h"])
        own = written(own.withColumn("listed", (F.col("n") >= least) & (F.col("h") != 0)))
        sums = own.groupBy("c").agg(
            F.sum(F.expr("if(listed, n, 0)")).alias("seen"), F.count_if("listed").alias("k"),
            F.coalesce(F.sum(F.expr("if(listed, n * (ln(n) - ln(parent)), 0)")), F.lit(0.0)).alias("gain"),
        )
        full = own.join(F.broadcast(sums), "c").withColumns(
            {
                "keep": F.expr(f"k > 0 AND gain - seen * ln(total) >= {settings.divergence} + k"),
                "scale": F.col("total") + settings.smoothing,
            }
        )
        chance = "CASE WHEN keep THEN if(listed, n / scale, 0) + (scale - seen) / scale * parent ELSE parent END"
        full = written(full.select("c", "h", "root", F.expr(chance).alias("chance"), "first", "shares"), folder)
        travel.append(
            full.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
            .select(F.pmod(F.col("first") + F.col("_share"), F.lit(parts)).cast("int").alias("part"), "c", "h", "root", "chance")
        )
        above = full.select(F.col("c").alias("suffix"), "h", "root", F.col("chance").alias("parent"))
    return crowded, travel


def grown(x: np.ndarray, trains: np.ndarray, found: list[np.ndarray], start: np.ndarray, chance: np.ndarray, least: float, settings: TreeSettings):
    """The chances of tokens, level by level: given the root's (or that after the longest crowded context), that after the longest retained one.

    Tokens x after contexts `found`; all places of every context that is not crowded are here. `trains`: 1 in training texts, else 0.
    """
    for n, context in enumerate(found):
        live = np.flatnonzero((context != 0) & (start <= n))
        if not len(live):
            continue
        key = tx.joined(context[live], x[live])
        order = np.argsort(key)
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        live = live[order]
        count = np.add.reduceat(trains[live], new)
        one = live[new]
        parent = chance[one]
        keys, at = np.unique(context[one], return_inverse=True)
        total = np.bincount(at, weights=count)
        listed = (count >= least) & (x[one] != 0)
        of, often = at[listed], count[listed]
        seen, k = (np.bincount(of, weights=w, minlength=len(keys)) for w in (often, None))
        gain = np.bincount(of, weights=often * (np.log(often) - np.log(parent[listed])), minlength=len(keys))
        keep = (k > 0) & (gain - seen * np.log(np.maximum(total, 1)) >= settings.divergence + k)
        scale = total + settings.smoothing
        rest = (scale - seen) / scale
        own = np.where(keep[at], np.where(listed, count / scale[at], 0.0) + rest[at] * parent, parent)
        chance[live] = np.repeat(own, np.diff(np.append(new, len(key))))
    return chance


def packed(columns: np.ndarray) -> tuple[bytes, bytes]:
    """Columns of numbers, the first bytes of each together, then the second ones, ..., compressed; and their hashes, which are not."""
    rare = columns >= RARE
    planes = np.where(rare, ESCAPE, columns).astype(np.uint32).view(np.uint8).reshape(len(columns), -1, 4).transpose(0, 2, 1)
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(planes), asbytes=True), columns[rare].tobytes()


def unpacked(data: bytes, hashes: bytes, out: np.ndarray) -> None:
    columns, n = out.shape
    planes = np.frombuffer(pa.decompress(data, decompressed_size=columns * 4 * n, codec="zstd"), np.uint8)
    out[:] = np.ascontiguousarray(planes.reshape(columns, 4, n).transpose(0, 2, 1)).view(np.uint32).reshape(columns, n)
    out[out == ESCAPE] = np.frombuffer(hashes, np.uint64)


def dealt_texts(rows: DataFrame, held, crowded, parts: int, settings: TreeSettings, number: int = 0, rounds: int = 1) -> DataFrame:
    """The tokens of all texts that follow a word, with the words before them, dealt to the parts of one round.

    part, block, n, places, rare: the places of a block of texts in a part. A negative part has the marks of a block's texts.
    """
    names = ["part", "block", "n", "places", "rare", "marks"]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    targets = shuffle_partitions(rows.sparkSession)

    def run(batches):
        gathered, size, texts, block = [], 0, 0, TaskContext.get().partitionId() << 32

        def batch(*values):
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        def solve():
            place = np.concatenate([g[0] for g in gathered], axis=1)
            part, mark = (np.concatenate([g[k] for g in gathered]) for k in (1, 2))
            gathered.clear()
            yield batch(-1 - block % targets, block, 0, None, None, mark.tobytes())
            for p, at in by_part(part, parts):
                mine = np.take(place, at, axis=1)
                text = mine[0].copy()
                # Texts ascend: steps to the next take less room. The lowest bit tells a training text.
                mine[0] = np.diff(text, prepend=np.uint64(0)) << np.uint64(1) | mark[text.astype(np.int64)] & np.uint64(1)
                yield batch(p, block, mine.shape[1], *packed(mine), None)

        for t in tx.pieces(batches, "text"):
            tokens, owner, mark = read(t)
            ids, _ = held.value.ids(tokens)
            before = words_before(ids, owner, settings.depth)
            at = np.flatnonzero(before[0] != 0)
            before = np.stack([w[at] for w in before])
            part = dealt_places(before, mark[owner[at]], crowded.value, parts)
            if rounds > 1:
                here = np.flatnonzero(part % rounds == number)
                at, before, part = at[here], before[:, here], part[here]
            gathered.append((np.stack([owner[at].astype(np.uint64) + np.uint64(texts), ids[at], *before]), part, mark))
            size += len(at)
            texts += len(mark)
            if size >= BLOCK_TOKENS:
                yield from solve()
                size, texts, block = 0, 0, block + 1
        if size:
            yield from solve()

    return rows.mapInArrow(run, "part int, block long, n long, places binary, rare binary, marks binary")


def scored_parts(texts: DataFrame, chances: DataFrame, held, crowded, least: float, settings: TreeSettings) -> DataFrame:
    """mark, own: what the tree adds to the log10 chance of each text. `chances`: part, c, h, root, chance; c is 0 for the root's."""
    names = ["block", "marks", "n", "steps", "own"]
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())

    def run(dealt_: pa.Table, given: pa.Table) -> pa.Table:
        blocks = dealt_.column("block")
        if not dealt_.num_rows or dealt_.column("part")[0].as_py() < 0:
            marks = [blocks, dealt_.column("marks"), *(pa.nulls(dealt_.num_rows, k) for k in kinds[2:])]
            return pa.table(marks, schema=pa.schema(zip(names, kinds)))
        words, sizes = held.value, dealt_.column("n").to_pylist()
        ends = np.cumsum([0, *sizes])
        place = np.empty((settings.depth + 2, ends[-1]), np.uint64)
        for data, hashes, first, end in zip(dealt_.column("places"), dealt_.column("rare"), ends, ends[1:]):
            unpacked(data.as_py(), hashes.as_py(), place[:, first:end])
        del dealt_
        steps, x, found = place[0].astype(np.uint32), place[1].copy(), contexts(list(place[2:]))
        del place
        c, h = (given.column(k).to_numpy().view(np.uint64) for k in ("c", "h"))
        root, chance = (given.column(k).to_numpy() for k in ("root", "chance"))
        ids = np.where(h != 0, words.ids(h)[0], np.uint64(0))

        def told(where, context, tokens, column):
            """What is told of tokens after a context; 1 for those that no sequence that counts ends with."""
            key = tx.joined(c[where], ids[where])
            order = np.argsort(key)
            hit, at = lookup(key[order], tx.joined(context, tokens))
            out = np.ones(len(tokens))
            out[hit] = column[where][order][at]
            return out

        before = np.ones(len(x))
        numbered = np.flatnonzero((x != 0) & (x < RARE))
        before[numbered] = words.chance[(x[numbered] - np.uint64(1)).astype(np.int64)]
        at = np.flatnonzero(x >= RARE)
        before[at] = told(np.flatnonzero(c == 0), np.zeros(len(at), np.uint64), x[at], root)
        after = before.copy()
        start, hits = crowded_levels(found, crowded.value)
        others = np.flatnonzero(c != 0)
        for n, at, _ in hits:
            before[at], after[at] = (told(others, found[n][at], x[at], column) for column in (root, chance))
        after = grown(x, (steps & 1).astype(np.int64), found, start, after, least, settings)
        own = np.log10(after) - np.log10(before)
        out = []
        for first, end in zip(ends, ends[1:]):
            text = np.cumsum(steps[first:end] >> 1, dtype=np.int64)
            sums = np.bincount(text, weights=own[first:end])
            text = np.flatnonzero(sums)
            out.append((len(text), packed(np.diff(text, prepend=0).astype(np.uint64)[None])[0], sums[text].tobytes()))
        columns = [blocks, pa.nulls(len(out), pa.binary()), *(pa.array(v, k) for v, k in zip(zip(*out), kinds[2:]))]
        return pa.table(columns, schema=pa.schema(zip(names, kinds)))

    def together(t: pa.Table) -> pa.Table:
        """The sums of the texts of a block over all parts."""
        mark = np.frombuffer(next(m for m in t.column("marks").to_pylist() if m is not None), np.uint64)
        own = np.zeros(len(mark))
        for n, data, sums in zip(t.column("n").to_pylist(), t.column("steps"), t.column("own")):
            if n:
                steps = np.empty((1, n), np.uint64)
                unpacked(data.as_py(), b"", steps)
                own[np.cumsum(steps[0].astype(np.int64))] += np.frombuffer(sums.as_py(), np.float64)
        return pa.table([pa.array(mark.view(np.int64)), pa.array(own)], names=["mark", "own"])

    schema = "block long, marks binary, n long, steps binary, own binary"
    parts = texts.groupBy("part").cogroup(chances.groupBy("part")).applyInArrow(run, schema)
    return parts.groupBy("block").applyInArrow(together, "mark long, own double")


def gate(keys: DataFrame) -> np.ndarray:
    """A bitmap of the leading bits of the keys."""
    place = F.shiftrightunsigned("key", 64 - GATE_BITS)
    bits = keys.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - GATE_BITS}) & 63 AS int))").alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # a bounded number
    out = np.zeros(1 << (GATE_BITS - 6), dtype=np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def numbered_words(words: DataFrame, least: float, settings: TreeSettings) -> Words:
    """At most 1 / `frequent` words of the highest counts, and the end."""
    level = F.floor(F.log2(F.greatest("total", F.lit(1))) * 8)
    sizes = words.where("total IS NOT NULL").groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # under 512
    bound, room = 512, 1 / settings.frequent
    for r in sizes:
        room -= r["count"]
        if room < 0:
            break
        bound = r["level"]
    common = words.where(F.col("total").isNull() | (level >= bound)).select("h", "trained", "chance").toArrow()
    keys, trained, chance = (common[c].to_numpy() for c in ("h", "trained", "chance"))
    by_count = np.argsort(-trained, kind="stable")
    number = np.empty(len(keys), np.uint64)
    number[by_count] = np.arange(1, len(keys) + 1, dtype=np.uint64)
    keys = keys.view(np.uint64)
    order = np.argsort(keys)
    first = np.searchsorted(keys[order], np.arange(1 << FIRST_BITS, dtype=np.uint64) << np.uint64(64 - FIRST_BITS))
    first = np.minimum(first, len(keys) - 1)  # the end is always among them
    twice = words.where((level < bound) & (F.col("trained") >= min(2, least))).select(F.col("h").alias("key"))
    return Words(keys[order], first.astype(np.int32), number[order], chance[by_count], (trained > 0)[by_count], gate(twice))


def score(docs: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark, key = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS)
    try:
        with shuffles_removed(spark):
            return _scored(docs, settings)
    finally:
        spark.conf.set(key, before)


def _scored(docs: DataFrame, settings: TreeSettings) -> DataFrame:
    rows, spark, folder = marked(docs), docs.sparkSession, table_folder(docs.sparkSession)
    with scope(spark) as parts_folder:
        with scope(spark):
            counts = written(word_counts(rows))
            sums = counts.agg(F.sum("trained").alias("trained"), F.sum("total").alias("total"), F.count_if(F.col("trained") > 0).alias("types")).first()
            texts = rows.agg(F.count_if(~F.col("held_out")).alias("trained"), F.count(F.lit(1)).alias("total")).first()
            train_tokens = int(sums["trained"] or 0) + texts["trained"]
            below = train_tokens + settings.unseen * (int(sums["types"] or 0) + (1 if texts["trained"] else 0) + 1)
            ends = spark.range(1).select(
                F.lit(int(END.view(np.int64))).alias("h"), F.lit(texts["trained"]).cast("long").alias("trained"), F.lit(None).cast("long").alias("total")
            )
            words = counts.unionByName(ends).withColumn("chance", (F.col("trained") + settings.unseen) / below)
            least = max(settings.fewest, settings.least * train_tokens)
            known = numbered_words(words, least, settings)
            held = spark.sparkContext.broadcast(known)

            # Parts of about `part` tokens, or smaller ones where there would be few.
            tokens = int(sums["total"] or 0) + texts["total"]
            parts = max(1, -(-tokens // settings.part), min(LEAST_PARTS, tokens // LEAST_PART))
            most = tokens / parts / 2
            crowd = np.zeros(0, np.uint64)
            if parts > 1:
                over = counts.where(F.col("trained") > most).select("h").toArrow()["h"].to_numpy()  # at most 2 * parts
                crowd = np.sort(known.ids(over.view(np.uint64))[0])
            told = facts(rows, held, crowd, parts, below, settings)
            plain = written(told.where("kind = 0").select("mark", "doc_id", "held_out", "copies", "n_tokens", "n_known", "base"), folder)
            rare = written(told.where("kind = 1").select("mark", "part", "h").join(words.select("h", "trained", "chance"), "h"))
            others = rare.groupBy("mark").agg(F.sum((F.col("trained") > 0).cast("long")).alias("n_known"), F.sum(F.log10("chance")).alias("base"))
            others = written(others, folder)
            given = rare.where((F.col("part") >= 0) & (F.col("trained") >= least)).select("part", "h", "chance").distinct()
            given = written(given.select("part", F.lit(0).cast("long").alias("c"), "h", F.col("chance").alias("root"), "chance"), parts_folder)
            crowded = []
            if len(crowd):
                found = told.where("kind > 1").select((F.col("kind") - 1).alias("level"), "c", "suffix", "h", "n")
                crowded, travel = crowded_chances(found, words.select("h", "chance"), most, least, parts, settings, parts_folder)
                for more in travel:
                    given = given.unionByName(more)
        levels = spark.sparkContext.broadcast(crowded)
        rounds, own = min(ROUNDS, parts), []
        for number in range(rounds):
            texts = dealt_texts(rows, held, levels, parts, settings, number, rounds)
            here = given.where(F.pmod("part", F.lit(rounds)) == number)
            own.append(written(scored_parts(texts, here, held, levels, least, settings), folder))
        held.destroy()  # its copies are files on every machine
        levels.destroy()
    whole = plain.unionByName(others, allowMissingColumns=True)
    for more in own:
        whole = whole.unionByName(more, allowMissingColumns=True)
    # Equal rows (same id and text) were summed together: each gets its part.
    summed_ = whole.groupBy("mark").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("copies", "n_tokens", "n_known", "base", "own")],
    )
    return summed_.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "doc_id",
        "held_out",
        (F.col("n_tokens") / F.col("copies")).cast("long").alias("n_tokens"),
        (F.col("n_known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        ((F.col("base") + F.col("own")) / F.col("copies")).alias("score"),
    )
