"""Spelling variants: words that differ by one letter, found by blocked Gram matrices.

A word is the vector of its letter counts. One inserted, deleted or replaced
letter moves that vector by a squared distance of one or two, so words whose
distance is larger are no variants. Squared distances of whole blocks come from
one matrix product: |x|^2 + |y|^2 - 2 xy. Pairs at a distance of at most two are
kept and their edits verified letter by letter.

Only blocks that can hold such pairs meet. The letters form a few classes; a
block holds words with the same number of letters of each class, and so of one
length. An edit changes these numbers by one letter added, or one taken and one
added, so a block meets itself and its few neighbours of the same and of the
next length. Large blocks are cut into pieces of at most about PIECE_WORDS
words or PIECE_LETTERS letters; pieces meet in tasks one pair at a time.

Defined cases: a null or empty text has no words; a null id is the empty text
in the check that decides a deletion. Repeated rows count each time. Very long
runs are handled like others, in pieces of their own. Empty tables have no
words. Only `doc_id` and `text` are read; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.text import LOWER, code_points, map_texts, runs
from rowsmith.operators.shared import even_join, written

MIN_LETTERS = 7
MIN_COUNT = 2
DOMINANCE = 10
DELETE_EVERY = 31

PIECE_WORDS = 1024
PIECE_LETTERS = 1 << 16
#: Letters of pairs that are verified together.
VERIFIED_LETTERS = 1 << 22
#: Counts up to this length have exact sums of products in single precision.
EXACT_LETTERS = 2048

#: Letters are a to z and U+00C0 to U+00FF; each has a dimension.
LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
DIMENSION = np.zeros(0x100, dtype=np.int64)
DIMENSION[LETTERS] = np.arange(len(LETTERS))

_CRC = np.zeros(256, dtype=np.uint32)
for _bit in range(256):
    _value = _bit
    for _ in range(8):
        _value = _value >> 1 ^ (0xEDB88320 if _value & 1 else 0)
    _CRC[_bit] = _value


# --- words ---------------------------------------------------------------------------


def letter_mask(data: np.ndarray) -> np.ndarray:
    """Bytes that belong to a letter: ASCII letters, and the two bytes of U+00C0 to U+00FF."""
    low = LOWER[data]
    ascii_letter = (low >= 0x61) & (low <= 0x7A)
    lead = data == 0xC3
    tail = np.zeros(len(data), dtype=bool)
    tail[1:] = lead[:-1]
    return ascii_letter | lead | tail


def check_sums(start: np.ndarray, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """CRC-32 of each span, carried on from the sums of what stands before it."""
    state = start.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    live = np.arange(len(first))
    at = 0
    while len(live):
        state[live] = _CRC[(state[live] ^ data[first[live] + at]) & 0xFF] ^ (state[live] >> np.uint32(8))
        at += 1
        live = live[last[live] - first[live] > at]
    return state ^ np.uint32(0xFFFFFFFF)


def words_of(rows: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray, least: int) -> dict:
    """Words of a piece of texts with their number of occurrences there."""
    start, end, row = runs(letter_mask(data), bounds)
    points = code_points(data)
    letters = points[end] - points[start]
    keep = letters >= least
    start, end, row, letters = start[keep], end[keep], row[keep], letters[keep]
    low = LOWER[data]
    ids = rows.column("doc_id").cast(pa.string()).fill_null("").to_pylist()
    heads = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)
    sums = check_sums(heads[row], low, start, end)
    struck = sums % np.uint32(DELETE_EVERY) == 0
    # The untouched words as one Arrow array: their bytes one after the other.
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[start[~struck]] += 1
    inside[end[~struck]] -= 1
    offsets = np.zeros(int((~struck).sum()) + 1, dtype=np.int64)
    np.cumsum((end - start)[~struck], out=offsets[1:])
    content = low[np.cumsum(inside[:-1]).astype(bool)]
    whole = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(content))
    cut = []
    for a, b, n, h in zip(start[struck], end[struck], letters[struck], sums[struck]):
        if n > least:
            word, at = low[a:b].tobytes().decode(), int(h) % int(n)
            cut.append(word[:at] + word[at + 1 :])
    counted = pc.value_counts(pa.concat_arrays([whole, pa.array(cut, pa.large_string())]))
    return {"word": counted.field("values").cast(pa.string()), "n": counted.field("counts")}


def vocabulary(docs: DataFrame, least: int = MIN_LETTERS, count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of at least `least` letters that occur at least `count` times."""
    found = map_texts(docs.select("doc_id", "text"), lambda *piece: words_of(*piece, least), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


# --- blocks --------------------------------------------------------------------------


def classes_for(words: int) -> int:
    """Number of letter classes: one more for every tenfold vocabulary, which keeps blocks small at every size."""
    return min(16, max(2, len(str(words))))


def letter_counts(words: np.ndarray) -> np.ndarray:
    """The letter counts of words of one length, given as a row of code points each."""
    n = len(words)
    cells = np.arange(n)[:, None] * len(LETTERS) + DIMENSION[words]
    return np.bincount(cells.ravel(), minlength=n * len(LETTERS)).reshape(n, len(LETTERS))


def blocks(words: DataFrame, classes: int) -> DataFrame:
    """Words with the number of letters of each class, as `block`."""
    class_of = np.arange(len(LETTERS)) % classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                words = rows.column("word").to_pylist()
                codes = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
                owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
                sizes = np.bincount(owner * classes + class_of[DIMENSION[codes]], minlength=len(words) * classes)
                block = pa.FixedSizeListArray.from_arrays(pa.array(sizes, pa.int32()), classes).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column("word"), rows.column("n"), block], ["word", "n", "block"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, block array<int>")


def pieces_of(blocked: DataFrame) -> DataFrame:
    """(block, piece, words, counts): blocks in pieces of bounded size, their words one after the other."""
    letters = F.expr("aggregate(block, 0, (a, b) -> a + b)")
    most = F.greatest(F.lit(1), F.least(F.lit(PIECE_WORDS), F.floor(F.lit(PIECE_LETTERS) / F.max(letters))))
    sizes = blocked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / most).alias("pieces"))
    dealt = even_join(blocked, sizes, ["block"]).withColumn("piece", F.expr("pmod(xxhash64(word), pieces)"))
    gathered = dealt.groupBy("block", "piece").agg(F.collect_list(F.struct("word", "n")).alias("members"))
    return gathered.selectExpr(
        "block", "piece", "array_join(transform(members, m -> m.word), '') AS words", "transform(members, m -> m.n) AS counts"
    )


def neighbours(classes: int) -> str:
    """SQL of the blocks that a block visits: itself, those one letter on, and half of those with one letter exchanged."""
    shifts = [[0] * classes]
    for i in range(classes):
        shifts.append([int(c == i) for c in range(classes)])
        shifts += [[(c == i) - (c == j) for c in range(classes)] for j in range(i)]
    listed = ", ".join(f"array({', '.join(map(str, s))})" for s in shifts)
    return f"explode(transform(array({listed}), s -> zip_with(block, s, (a, b) -> a + b)))"


def differ_by_one(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of equal length differ in one place, or those of `y` have one letter more and are otherwise those of `x`."""
    n = x.shape[1]
    if y.shape[1] == n:
        return (x != y).sum(axis=1) == 1
    ahead = np.cumprod(x == y[:, :n], axis=1).sum(axis=1)
    behind = np.cumprod(x[:, ::-1] == y[:, :0:-1], axis=1).sum(axis=1)
    return ahead + behind >= n


def near_in_blocks(x: np.ndarray, y: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of near words of two pieces, the first not the longer; within one piece each pair once."""
    alone = y is None
    y = x if alone else y
    exact = np.float32 if y.shape[1] <= EXACT_LETTERS else np.float64
    a = letter_counts(x).astype(exact)
    b = a if alone else letter_counts(y).astype(exact)
    # The squares enter the product as two further columns, so it holds the squared distances.
    ones = np.ones(max(len(a), len(b)), dtype=exact)
    a, b = (
        np.column_stack([a, (a * a).sum(axis=1), ones[: len(a)]]),
        np.column_stack([-2 * b, ones[: len(b)], (b * b).sum(axis=1)]),
    )
    i, j = np.divmod(np.flatnonzero(a @ b.T <= 2), len(b))
    if alone:
        i, j = i[i < j], j[i < j]
    verified = np.zeros(len(i), dtype=bool)
    step = max(1, VERIFIED_LETTERS // y.shape[1])
    for at in range(0, len(i), step):
        part = slice(at, at + step)
        verified[part] = differ_by_one(x[i[part]], y[j[part]])
    return i[verified], j[verified]


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, n): every word with each word near to it and how often that occurs."""
    classes = classes_for(words.count())
    pieces = written(pieces_of(written(blocks(words, classes))))
    homes = pieces.selectExpr("block AS station", "piece AS home", "words AS one", "counts AS one_n")
    guests = pieces.selectExpr(
        f"{neighbours(classes)} AS station", "block", "piece AS guest", "words AS other", "counts AS other_n"
    ).selectExpr("station", "block = station AS own", "guest", "other", "other_n")
    # A guest has one letter less than its station, or one exchanged; at home each two pieces meet once.
    # Spark sizes the guests as the file of the pieces, where each visits dozens of stations: they never go to the driver.
    meetings = homes.join(guests.hint("merge"), "station").where("NOT own OR home <= guest")
    meetings = meetings.selectExpr("own AND home = guest AS alone", "one", "one_n", "other", "other_n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone = batch.column("alone").to_pylist()
            for k in range(batch.num_rows):
                x, y = (_piece(batch.column(c)[k], batch.column(f"{c}_n")[k]) for c in ("other", "one"))
                i, j = near_in_blocks(x[0], None if alone[k] else y[0])
                if len(i):
                    one, two = _words(x[0][i]), _words(y[0][j])
                    n = np.concatenate([y[1][j], x[1][i]])
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([one, two]), pa.concat_arrays([two, one]), pa.array(n)], ["word", "near", "n"])

    return meetings.mapInArrow(run, "word string, near string, n long")


def _piece(words: pa.Scalar, counts: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    n = counts.values.to_numpy()
    return np.frombuffer(words.as_py().encode("latin-1"), dtype=np.uint8).reshape(len(n), -1), n


def _words(codes: np.ndarray) -> pa.Array:
    text, width = codes.tobytes().decode("latin-1"), codes.shape[1]
    return pa.array([text[at : at + width] for at in range(0, len(text), width)], pa.string())


# --- forms ---------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following the forms of a word ends. Each step is to a word at least DOMINANCE times as frequent.

    Half of what is left of every path goes in a round. A table of words takes ten times its file in
    memory, so none is broadcast by the size of its file.
    """
    current = written(forms.selectExpr("word", "form AS root"))
    while True:
        onward = current.selectExpr("word AS root", "root AS beyond").hint("merge")
        step = written(current.join(onward, "root", "left").selectExpr("word", "coalesce(beyond, root) AS root", "beyond IS NOT NULL AS moved"))
        current = step.select("word", "root")
        if step.where("moved").isEmpty():
            return current


def variants(docs: DataFrame, least: int = MIN_LETTERS, count: int = MIN_COUNT, dominance: int = DOMINANCE) -> DataFrame:
    """Every word with its form, its root, and how many words are near to it.

    Returns word, form, root, n, n_near and form_n.
    """
    words = written(vocabulary(docs, least, count))
    best = near_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("rank"), F.col("near").alias("near"))).alias("best")
    )
    judged = written(
        words.join(best, "word", "left").selectExpr(
            "word", "n", "coalesce(n_near, 0L) AS n_near",
            f"CASE WHEN -best.rank >= {dominance} * n THEN best.near END AS form",
            f"CASE WHEN -best.rank >= {dominance} * n THEN -best.rank END AS form_n",
        )
    )
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends.hint("merge"), "word", "left").selectExpr("word", "form", "coalesce(root, word) AS root", "n", "n_near", "form_n")
