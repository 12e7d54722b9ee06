"""Benchmark decontamination: a prefix-filtered set join of item windows and document texts.

A window is a run of consecutive words of a benchmark item (ten by default; a
shorter item is one window of its own). It is treated as the set of its word
shingles. A document that holds the window holds all of them, so one necessary
shingle, the rarest of the window over all documents, is joined first: the
prefix. Candidates must lie inside their document (position and length bounds)
and are then verified: the shingles that tile the window must stand at their
exact positions, which fixes every word of it.

Texts are read once. All steps are built-in expressions, joins and aggregations.

Defined cases: a null or empty text has no words, and neither hits nor is hit.
Every document row is judged by itself, so repeated rows and ids and null ids
each give a row. Items that share an id count as one; a null `item_id` is the id
of the empty text. Items without words have no windows. Empty tables give no
rows, or documents without hits. Only `doc_id`, `text` and `item_id` are read;
other columns play no part, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.operators.shared import fits_broadcast, written

WINDOW_WORDS = 10
SHINGLE_WORDS = 5

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> str:
    """SQL of the words of a text: letters and digits, A-Z lowered, other alphabets as they are."""
    capitals = string.ascii_uppercase
    # In a text of ASCII alone the faster lower() changes the same letters.
    low = (
        f"CASE WHEN octet_length({text}) = char_length({text}) THEN lower({text}) "
        f"ELSE translate(coalesce({text}, ''), '{capitals}', '{capitals.lower()}') END"
    )
    return f"array_remove(split({low}, r'{_SEPARATORS}'), '')"


def _shingle(k: int) -> str:
    return "concat_ws(' ', " + ", ".join(f"zipped.`{i}`" for i in range(k)) + ")"


def item_windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows as (window, content, n), and their items as (window, item)."""
    split = items.selectExpr("coalesce(CAST(item_id AS STRING), '') AS item", f"{words('text')} AS w").where("size(w) > 0")
    placed = split.selectExpr(
        "item", f"least(size(w), {window}) AS n", f"w", f"explode(sequence(0, greatest(size(w) - {window}, 0))) AS i"
    )
    pairs = written(placed.selectExpr("item", "n", "array_join(slice(w, i + 1, n), ' ') AS content").distinct())
    contents = pairs.select("content", "n").distinct().coalesce(64)
    numbered = written(contents.selectExpr("monotonically_increasing_id() AS window", "content", "n"))
    return numbered, pairs.select("content", "item").join(numbered.select("window", "content"), "content").select("window", "item")


def window_shingles(windows: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The shingles of every window as (window, n, k, at, sid), and distinct shingles as (sid, shingle, k)."""
    split = windows.selectExpr("window", "n", f"least(n, {width}) AS k", "split(content, ' ') AS w")
    placed = split.selectExpr("window", "n", "k", "w", "explode(sequence(0, n - k)) AS at")
    placed = placed.selectExpr("window", "n", "k", "at", "array_join(slice(w, at + 1, k), ' ') AS shingle")
    distinct = written(placed.select("shingle", "k").distinct().selectExpr("monotonically_increasing_id() AS sid", "shingle", "k"))
    return written(placed.join(distinct, ["shingle", "k"]).select("window", "n", "k", "at", "sid")), distinct


def matched_positions(docs: DataFrame, shingles: DataFrame, width: int) -> DataFrame:
    """Where item shingles stand in the texts: (row, doc_id, n_words, head, pos, sid).

    One row of each document has `head`, whether or not a shingle stands there.
    `row` numbers the documents; the table is written, which fixes the numbers.
    """
    shorter = sorted(r["k"] for r in shingles.where(f"k < {width}").select("k").distinct().collect())  # at most width - 1
    slices = ", ".join(f"slice(w, {i + 1}, size(w))" for i in range(width))
    texts = docs.selectExpr("monotonically_increasing_id() AS row", "doc_id", f"{words('text')} AS w")
    placed = texts.selectExpr("row", "doc_id", "size(w) AS n_words", f"posexplode_outer(arrays_zip({slices})) AS (pos, zipped)")
    # Keys that match nothing differ from row to row, so they do not meet in one task.
    nothing = "concat(' ', CAST(row AS STRING))"
    forms = [
        f"struct({k} AS k, CASE WHEN pos + {k} <= n_words THEN {_shingle(k)} ELSE {nothing} END AS shingle)" for k in (width, *shorter)
    ]
    if shorter:
        keyed = placed.selectExpr("row", "doc_id", "n_words", "pos", f"inline(array({', '.join(forms)}))")
    else:
        keyed = placed.selectExpr("row", "doc_id", "n_words", "pos", f"{width} AS k", f"{forms[0]}.shingle AS shingle")
    known = shingles.select("shingle", "sid")
    if fits_broadcast(shingles, ["shingle", "sid"]):
        known = F.broadcast(known)
    found = keyed.join(known, "shingle", "left").withColumn("head", F.expr(f"k = {width} AND coalesce(pos, 0) = 0"))
    return written(found.where("sid IS NOT NULL OR head").select("row", "doc_id", "n_words", "head", "pos", "sid"))


def prefixes(shingled: DataFrame, places: DataFrame) -> DataFrame:
    """The rarest shingle of every window that can occur, and the others that tile it.

    (sid, at, window, n, rest): `rest` lists (at, sid) of the tiles besides the prefix.
    """
    frequency = places.where("sid IS NOT NULL").groupBy("sid").agg(F.count(F.lit(1)).alias("seen"))
    ranked = shingled.join(frequency, "sid", "left")
    chosen = ranked.groupBy("window").agg(
        F.expr("min(struct(coalesce(seen, 0L) AS seen, at, sid))").alias("rarest"),
        F.max("n").alias("n"),
        F.expr("collect_list(CASE WHEN at % k = 0 OR at = n - k THEN struct(at, sid) END)").alias("tiles"),
    )
    # A window with a shingle that no document has cannot occur.
    return chosen.where("rarest.seen > 0").selectExpr(
        "rarest.sid AS sid", "rarest.at AS at", "window", "n", "filter(tiles, t -> t.at <> rarest.at) AS rest"
    )


def occurrences(places: DataFrame, chosen: DataFrame) -> DataFrame:
    """Verified places of windows: (row, window, start, n), each once."""
    chosen = written(chosen)
    small = fits_broadcast(chosen.selectExpr("CAST(sid AS STRING) AS s", "CAST(rest AS STRING) AS r", "CAST(window AS STRING) AS w"), ["s", "r", "w"])
    spots = places.where("sid IS NOT NULL").select("row", "n_words", "pos", "sid")
    candidates = (
        spots.join(F.broadcast(chosen) if small else chosen, "sid")
        .withColumn("start", F.expr("pos - at"))
        .where("start >= 0 AND start + n <= n_words")
        .select("row", "window", "start", "n", "rest")
    )
    whole = candidates.where("size(rest) = 0").select("row", "window", "start", "n")
    needed = candidates.where("size(rest) > 0").selectExpr("row", "window", "start", "n", "size(rest) AS needs", "inline(rest)")
    checked = (
        needed.selectExpr("row", "window", "start", "n", "needs", "start + at AS pos", "sid")
        .join(spots.select("row", "pos", "sid"), ["row", "pos", "sid"])
        .groupBy("row", "window", "start", "n")
        .agg(F.count(F.lit(1)).alias("met"), F.max("needs").alias("needs"))
        .where("met = needs")
        .select("row", "window", "start", "n")
    )
    return written(whole.union(checked))


def hit_words(found: DataFrame) -> DataFrame:
    """(row, n_hit, spans, windows): words inside any occurrence, as maximal spans (first, last), and the windows there."""
    before = Window.partitionBy("row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = found.withColumn("fresh", F.expr("start") > F.coalesce(F.max(F.expr("start + n")).over(before), F.lit(-1)))
    islands = marked.withColumn("island", F.sum(F.col("fresh").cast("int")).over(upto))
    spans = islands.groupBy("row", "island").agg(
        F.min("start").alias("first"), F.max(F.expr("start + n - 1")).alias("last"), F.collect_set("window").alias("here")
    )
    return spans.groupBy("row").agg(
        F.sum(F.expr("CAST(last - first + 1 AS BIGINT)")).alias("n_hit"),
        F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"),
        F.expr("array_sort(array_distinct(flatten(collect_list(here))))").alias("windows"),
    )


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, width: int = SHINGLE_WORDS) -> DataFrame:
    """Every document with the benchmark words it holds.

    Returns doc_id, n_words, n_hit, spans (array of first and last word, from 0)
    and items (sorted ids of the items whose windows occur).
    """
    if not 1 <= width <= window:
        raise ValueError("a shingle has at least one word and at most as many as a window")
    windows, pairs = item_windows(items, window)
    shingled, shingles = window_shingles(windows, width)
    places = matched_positions(docs, shingles, width)
    hits = written(hit_words(occurrences(places, prefixes(shingled, places))))
    # Documents with the same windows name the same items: each such list is made once.
    hits = hits.withColumn("listing", F.expr("sha2(array_join(transform(windows, w -> CAST(w AS STRING)), ','), 256)"))
    listed = hits.groupBy("listing").agg(F.first("windows").alias("windows")).selectExpr("listing", "explode(windows) AS window")
    named = written(listed.join(pairs, "window").groupBy("listing").agg(F.expr("array_sort(collect_set(item))").alias("items")))
    small = fits_broadcast(named.selectExpr("listing", "CAST(items AS STRING) AS items"), ["listing", "items"])
    hits = hits.drop("windows").join(F.broadcast(named) if small else named, "listing")
    heads = places.where("head").select("row", "doc_id", "n_words")
    return heads.join(hits, "row", "left").selectExpr(
        "doc_id",
        "CAST(n_words AS BIGINT) AS n_words",
        "coalesce(n_hit, 0L) AS n_hit",
        "coalesce(spans, CAST(array() AS ARRAY<STRUCT<first: INT, last: INT>>)) AS spans",
        "coalesce(items, CAST(array() AS ARRAY<STRING>)) AS items",
    )


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`contaminated` with the list of items as its digest."""
    return contaminated(docs, items).selectExpr(
        "doc_id",
        "n_words",
        "n_hit",
        "CAST(size(items) AS BIGINT) AS n_items",
        "sha2(array_join(items, ','), 256) AS items_sha256",
        "n_hit > 0 AS contaminated",
    )
