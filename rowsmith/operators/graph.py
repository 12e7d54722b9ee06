"""Dependency order, cycles and strongly connected components of an edge table.

An edge (src, dst) says that src depends on dst. All steps are joins and
aggregations over edges; each round is written to the shared checkpoint
folder, so plans stay short. Shallow graphs are settled from their ends inwards
in a few rounds. What is left then is contracted: nodes with one way in and one
way out form runs, and pointer doubling gives each of them both ends of its run
in a number of rounds that is the logarithm of its length. A node may hold any
share of the edges: edges meet node tables through `even_join`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.operators.shared import even_join, fits_broadcast, shuffle_partitions
from rowsmith.operators.shared import materialize as _materialize

#: Rounds of plain settling before runs are contracted.
PLAIN_ROUNDS = 4


def materialize(df: DataFrame) -> DataFrame:
    """Written in at most as many parts as a shuffle has: unions of rounds would double them each time."""
    return _materialize(df.coalesce(shuffle_partitions(df.sparkSession)))


class CycleError(ValueError):
    """Levels were asked of a graph that has a cycle."""


def _small(edges: DataFrame) -> bool:
    """Whether the names in an edge table, and so any table of its nodes, fit a broadcast."""
    return fits_broadcast(edges, ["src", "dst"])


def nodes_of(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node")))
    return ends.distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, ways_in, ways_out) of every node of distinct edges."""
    ends = edges.selectExpr("src AS node", "0L AS i", "1L AS o").union(edges.selectExpr("dst AS node", "1L AS i", "0L AS o"))
    return ends.groupBy("node").agg(F.sum("i").alias("ways_in"), F.sum("o").alias("ways_out"))


# --- runs ----------------------------------------------------------------------


def follow(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where runs end: (node, stop, w, floor, least), and the nodes of closed circles.

    `steps` holds (node, stop, w, floor, least, going): the next node, the
    length of the step, a lower bound of what the node itself counts, its name,
    and whether the next node is in a run too. No two nodes have the same next
    node in a run. Each round doubles the part of the run that a row spans.
    """
    state = materialize(steps)
    total, going, spans = state.count(), state.where("going").count(), 1
    # Spans longer than all runs together have no end: they go round in a circle.
    while going and spans <= total:
        ahead = state.selectExpr("node AS stop", "stop AS stop_2", "w AS w_2", "floor AS floor_2", "least AS least_2", "going AS going_2")
        moved = (
            state.where("going")
            .join(ahead, "stop")
            .selectExpr(
                "node", "stop_2 AS stop", "w + w_2 AS w", "greatest(floor, floor_2 + w) AS floor", "least(least, least_2) AS least", "going_2 AS going"
            )
        )
        state = materialize(state.where("NOT going").unionByName(moved))
        going, spans = state.where("going").count(), spans * 2
    return state.where("NOT going").drop("going"), state.where("going").select("node", "least")


def _steps(edges: DataFrame, members: DataFrame, small: bool) -> DataFrame:
    """The one step of each member of a run, from edges (src, dst, w); `members` has (node, floor)."""
    mine = even_join(edges, members.withColumnRenamed("node", "src"), ["src"], small=small)
    inside = members.select(F.col("node").alias("dst"), F.lit(True).alias("inner"))
    within = even_join(mine, inside, ["dst"], small=small).drop("inner").withColumn("going", F.lit(True))
    leaving = even_join(mine, inside, ["dst"], "left_anti", small).withColumn("going", F.lit(False))
    return within.unionByName(leaving).selectExpr("src AS node", "dst AS stop", "w", "floor", "src AS least", "going")


# --- levels --------------------------------------------------------------------


def levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Depth of each node of an acyclic graph: 0 without targets, else 1 + the deepest target.

    A round settles all nodes whose targets are settled. After a few rounds,
    runs are contracted to one weighted edge, and nodes that nothing depends on
    are set aside, between the rounds; their levels follow at the end.
    """
    waiting = materialize(edges.select("src", "dst").distinct())
    small = _small(waiting)
    open_nodes = materialize((nodes.select("node") if nodes is not None else nodes_of(waiting)).distinct())
    settled: list[DataFrame] = []
    for level in range(PLAIN_ROUNDS):
        blocked = waiting.select(F.col("src").alias("node")).distinct()
        ready = materialize(open_nodes.join(blocked, "node", "left_anti"))
        settled.append(ready.select("node", F.lit(level).cast("bigint").alias("level")))
        open_nodes = materialize(open_nodes.join(blocked, "node", "left_semi"))
        if open_nodes.isEmpty():
            return _all(settled)
        if ready.isEmpty():
            raise CycleError("the graph has a cycle; order its components instead")
        settled_targets = ready.select(F.col("node").alias("dst"))
        waiting = materialize(even_join(waiting, settled_targets, ["dst"], "left_anti", small).select("src", "dst"))
    # Every node left is at least this deep.
    floors = open_nodes.withColumn("floor", F.lit(PLAIN_ROUNDS).cast("bigint"))
    return _weighted_levels(waiting.withColumn("w", F.lit(1).cast("bigint")), materialize(floors), settled, small)


def _all(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result


def _weighted_levels(edges: DataFrame, nodes: DataFrame, settled: list[DataFrame], small: bool) -> DataFrame:
    """Levels where an edge adds its weight and a node has a lower bound, contracting between the rounds."""
    aside: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    while True:
        edges, nodes, runs, peaks, peak_edges = _contract(edges, nodes, small)
        aside.append((runs, peaks, peak_edges))
        blocked = edges.select(F.col("src").alias("node")).distinct()
        ready = materialize(nodes.join(blocked, "node", "left_anti"))
        settled.append(ready.selectExpr("node", "floor AS level"))
        nodes = nodes.join(blocked, "node", "left_semi")
        targets = ready.selectExpr("node AS dst", "floor AS level")
        raised = even_join(edges, targets, ["dst"], small=small).groupBy(F.col("src").alias("node")).agg(F.max(F.expr("level + w")).alias("raised"))
        nodes = materialize(nodes.join(raised, "node", "left").selectExpr("node", "greatest(floor, raised) AS floor"))
        edges = materialize(even_join(edges, targets.select("dst"), ["dst"], "left_anti", small).select("src", "dst", "w"))
        if nodes.isEmpty():
            break
        if ready.isEmpty() and runs.isEmpty() and peaks.isEmpty():
            raise CycleError("the graph has a cycle; order its components instead")
    known = _all(settled)
    for runs, peaks, peak_edges in reversed(aside):
        ends = known.selectExpr("node AS stop", "level")
        found = even_join(runs, ends, ["stop"], small=small).selectExpr("node", "greatest(floor, level + w) AS level")
        known = known.union(materialize(found))
        targets = known.selectExpr("node AS dst", "level")
        reached = even_join(peak_edges, targets, ["dst"], small=small).groupBy(F.col("src").alias("node")).agg(F.max(F.expr("level + w")).alias("deep"))
        known = known.union(materialize(peaks.join(reached, "node").selectExpr("node", "greatest(floor, deep) AS level")))
    return known


def _contract(edges: DataFrame, nodes: DataFrame, small: bool):
    """Take out runs, and nodes with several ways out and none in; every way through a run becomes one edge."""
    ways = degrees(edges).join(nodes, "node")
    ways = materialize(ways)
    members = ways.where("ways_out = 1 AND ways_in <= 1").select("node", "floor")
    peaks = ways.where("ways_out > 1 AND ways_in = 0").select("node", "floor")
    runs, circles = follow(_steps(edges, members, small))
    if not circles.isEmpty():
        raise CycleError("the graph has a cycle; order its components instead")
    gone = members.select("node").union(peaks.select("node"))
    peak_edges = materialize(even_join(edges, peaks.select(F.col("node").alias("src")), ["src"], "left_semi", small))
    rest = materialize(even_join(edges, gone.withColumnRenamed("node", "src"), ["src"], "left_anti", small))
    through = runs.selectExpr("node AS dst", "stop", "w AS further", "floor")
    joined = materialize(even_join(rest, through, ["dst"], small=small))
    direct = even_join(rest, through.select("dst"), ["dst"], "left_anti", small)
    contracted = direct.select("src", "dst", "w").union(joined.selectExpr("src", "stop AS dst", "w + further AS w"))
    contracted = materialize(contracted.groupBy("src", "dst").agg(F.max("w").alias("w")))
    raised = joined.groupBy(F.col("src").alias("node")).agg(F.max(F.expr("w + floor")).alias("raised"))
    left = nodes.join(gone, "node", "left_anti").join(raised, "node", "left").selectExpr("node", "greatest(floor, raised) AS floor")
    return contracted, materialize(left), runs, peaks, peak_edges


# --- components ------------------------------------------------------------------


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Strongly connected components as (node, component), named by their smallest node.

    Nodes that cannot lie on a cycle are trimmed away and runs contracted, in
    turns, which leaves a small core in dependency graphs and takes whole
    circles out. In the core the smallest name is passed along edges; nodes
    that also reach back to it form its component. A run belongs to the
    component that holds both its ends.
    """
    edges = materialize(edges.select("src", "dst").distinct())
    small = _small(edges)
    everyone = (nodes.select("node") if nodes is not None else nodes_of(edges)).distinct()
    core = edges.where("src <> dst")
    found: list[DataFrame] = []
    runs: list[DataFrame] = []
    while True:
        core, circles, contracted = _reduce(core, small)
        runs.extend(contracted)
        found.extend(circles)
        if core.isEmpty():
            break
        colour = _spread_smallest(core, small)
        starts = even_join(core, colour.withColumnsRenamed({"node": "src", "colour": "a"}), ["src"], small=small)
        both = even_join(starts, colour.withColumnsRenamed({"node": "dst", "colour": "b"}), ["dst"], small=small)
        coloured = both.where("a = b").select("src", "dst", F.col("a").alias("colour"))
        members = _reach_back(materialize(coloured), colour, small)
        found.append(members.select("node", "component"))
        done = members.select("node")
        outside = even_join(core, done.withColumnRenamed("node", "src"), ["src"], "left_anti", small)
        outside = even_join(outside, done.withColumnRenamed("node", "dst"), ["dst"], "left_anti", small)
        core = materialize(outside.select("src", "dst"))
    if not found and not runs:
        return everyone.select("node", F.col("node").alias("component"))
    named = _with_runs(found, runs, everyone, small)
    return everyone.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _with_runs(found: list[DataFrame], runs: list[DataFrame], everyone: DataFrame, small: bool) -> DataFrame:
    """Components with the contracted nodes back in them, each under its smallest name."""
    if not runs:
        return _all(found)
    named = _all(found) if found else everyone.limit(0).select("node", F.col("node").alias("component"))
    for part in reversed(runs):
        # A node outside all components counts as one of its own.
        inside = []
        for end in ("head", "stop"):
            hits = even_join(part, named.withColumnsRenamed({"node": end, "component": f"{end}_in"}), [end], small=small)
            inside.append(hits.select("node", f"{end}_in"))
        homes = part.join(inside[0], "node", "left").join(inside[1], "node", "left")
        homes = homes.selectExpr("node", "head", "coalesce(head_in, head) AS a", "coalesce(stop_in, stop) AS b", "head_in IS NULL AS fresh").where("a = b")
        # A run from a node back to itself makes a component of it.
        own = homes.where("fresh").selectExpr("head AS node", "a AS component").distinct()
        named = materialize(named.union(homes.selectExpr("node", "a AS component")).union(own))
    smallest = named.groupBy("component").agg(F.min("node").alias("name"))
    return even_join(named, smallest, ["component"], small=small).selectExpr("node", "name AS component")


def _reduce(core: DataFrame, small: bool) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Trim and contract until neither changes anything: the core, whole circles, and the runs taken out in order."""
    circles: list[DataFrame] = []
    runs: list[DataFrame] = []
    while True:
        core, trimmed = _trim(core, small, PLAIN_ROUNDS)
        if core.isEmpty():
            break
        ways = degrees(core)
        members = materialize(ways.where("ways_in = 1 AND ways_out = 1").selectExpr("node", "0L AS floor"))
        if members.isEmpty():
            if trimmed:
                break
            continue
        weighted = core.withColumn("w", F.lit(1).cast("bigint"))
        ahead, around = follow(_steps(weighted, members, small))
        behind, _ = follow(_steps(weighted.selectExpr("dst AS src", "src AS dst", "w"), members, small))
        circles.append(materialize(around.selectExpr("node", "least AS component")))
        runs.append(materialize(ahead.select("node", "stop").join(behind.selectExpr("node", "stop AS head"), "node")))
        rest = materialize(even_join(core, members.select(F.col("node").alias("src")), ["src"], "left_anti", small))
        through = ahead.selectExpr("node AS dst", "stop")
        joined = even_join(rest, through, ["dst"], small=small).selectExpr("src", "stop AS dst")
        direct = even_join(rest, through.select("dst"), ["dst"], "left_anti", small).select("src", "dst")
        core = materialize(direct.union(joined).where("src <> dst").distinct())
    return core, circles, runs


def cycles(edges: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Members of every cycle group: several nodes, or one node with an edge to itself."""
    labelled = labelled if labelled is not None else components(edges)
    sizes = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    several = labelled.join(sizes.where("members > 1").select("component"), "component", "left_semi")
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    single = labelled.join(loops, "node", "left_semi")
    return several.select("node", "component").union(single.select("node", "component")).distinct()


def dependency_groups(edges: DataFrame) -> DataFrame:
    """(node, component, level): components in dependency-first layers."""
    edges = materialize(edges.select("src", "dst").distinct())
    small = _small(edges)
    labelled = materialize(components(edges))
    starts = even_join(edges, labelled.withColumnsRenamed({"node": "src", "component": "a"}), ["src"], small=small)
    both = even_join(starts, labelled.withColumnsRenamed({"node": "dst", "component": "b"}), ["dst"], small=small)
    between = both.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    groups = labelled.select(F.col("component").alias("node")).distinct()
    order = levels(between, groups).withColumnRenamed("node", "component")
    return labelled.join(order, "component").select("node", "component", "level")


def _trim(core: DataFrame, small: bool, rounds: int) -> tuple[DataFrame, bool]:
    """Drop edges from nodes nothing points to and to nodes that point nowhere; also whether none is left to drop."""
    size = None
    for _ in range(rounds):
        heads = core.select(F.col("dst").alias("src")).distinct()
        tails = core.select(F.col("src").alias("dst")).distinct()
        kept = even_join(even_join(core, heads, ["src"], "left_semi", small), tails, ["dst"], "left_semi", small)
        core = materialize(kept.select("src", "dst"))
        left = core.count()
        if left == 0 or left == size:
            return core, True
        size = left
    return core, False
def _spread_smallest(core: DataFrame, small: bool) -> DataFrame:
    """(node, colour): the smallest name that reaches each node."""
    colour = materialize(nodes_of(core).select("node", F.col("node").alias("colour")))
    while True:
        passed = (
            even_join(core, colour.withColumnRenamed("node", "src"), ["src"], small=small)
            .groupBy(F.col("dst").alias("node"))
            .agg(F.min("colour").alias("offer"))
        )
        step = materialize(
            colour.join(passed, "node", "left").select(
                "node",
                F.least("colour", "offer").alias("colour"),
                (F.col("offer") < F.col("colour")).alias("moved"),
            )
        )
        colour = step.select("node", "colour")
        if step.where("moved").isEmpty():
            return colour


def _reach_back(coloured: DataFrame, colour: DataFrame, small: bool) -> DataFrame:
    """Nodes that reach the node their colour is named after, inside the colour."""
    members = materialize(colour.where("node = colour").select("node", F.col("colour").alias("component")))
    frontier = members
    while True:
        step = (
            even_join(coloured, frontier.select(F.col("node").alias("dst"), F.col("component").alias("colour")), ["dst", "colour"], small=small)
            .select(F.col("src").alias("node"), F.col("colour").alias("component"))
            .distinct()
            .join(members, ["node", "component"], "left_anti")
        )
        frontier = materialize(step)
        if frontier.isEmpty():
            return members
        members = materialize(members.union(frontier))
