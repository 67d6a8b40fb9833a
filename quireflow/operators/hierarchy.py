"""Parent-child links to full hierarchies: paths, depths, roots, descendants, cycles.

Method: level-wise frontier joins. From the roots, the frontier joins the links and extends path,
depth, root and inherited value of what it reaches. A round takes many levels at once: first the links
are joined with themselves to ways of exactly 2, 4, 8, ... steps; then the frontier takes the longest
ways first, and what it has reached so far the next shorter ones, so each node is reached once, over the
binary digits of its depth, and a tree of n levels takes log2(n) rounds of either kind. Ways that would
repeat a node are dropped, which ends rings.

Ancestor pairs, the nodes of each way with its end, give the nodes below each node. Links that are
on no way from a root (a second parent, the link that closes a ring, links between unreached nodes)
are few: the pairs they add are closed by joins with themselves; a node paired with itself is on a cycle.

Every join is on the space and a node (path, obj), so a large space is spread like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.session import cut, forget, has_rows

_NODE = ["path", "obj"]


def _best(way: str = "way") -> Column:
    """Orders ways to one node: the shortest first, then the one over the smallest parent."""
    return F.struct(F.size(way).alias("n"), F.reverse(way).alias("r"))


def _nodes(page_nodes: DataFrame) -> DataFrame:
    """path, obj, gen, kids, res: one row for each node, the one recorded last."""
    slim = page_nodes.select(
        "path", F.col("obj").cast("bigint").alias("obj"), F.coalesce(F.col("gen").cast("bigint"), F.lit(0)).alias("gen"),
        F.transform("kids", lambda k: F.struct(k["obj"].cast("bigint").alias("obj"), k["gen"].cast("bigint").alias("gen"))).alias("kids"),
        F.col("resources_ref.obj").cast("bigint").alias("res"), F.coalesce(F.col("recorded_at").cast("string"), F.lit("")).alias("at"),
    ).dropna(subset=_NODE)
    rank = F.struct("at", F.xxhash64("gen", "kids", "res"))
    return slim.groupBy(*_NODE).agg(F.max_by(F.struct("gen", "kids", "res"), rank).alias("x")).select(*_NODE, "x.*")


def _shortest(ways: DataFrame, key: list[str]) -> DataFrame:
    """One way for each ``key``: only ways through a node of several parents (joint) can have others beside them."""
    best = ways.where("joint").groupBy(*key).agg(F.min_by(F.struct("way", "res", "joint"), _best()).alias("x")).select(*key, "x.*")
    return ways.where("not joint").select(*key, "way", "res", "joint").unionByName(best)


def _extended(l: DataFrame, r: DataFrame) -> DataFrame:
    """The ways of ``l`` followed by those of ``r`` that begin where they end; no node twice."""
    l, r = l.alias("l"), r.alias("r")
    met = l.join(r, [F.col("l.path") == F.col("r.path"), F.col("l.obj") == F.col("r.up")])
    met = met.select("l.path", "l.up", "r.obj", F.concat("l.way", "r.way").alias("way"), F.coalesce("r.res", "l.res").alias("res"), (F.col("l.joint") | F.col("r.joint")).alias("joint"))
    # a way starts behind its node up, except from a root; without a joint node only a ring comes back
    again = (F.size(F.array_distinct("way")) < F.size("way")) | F.coalesce(F.array_contains("way", F.col("up")), F.lit(False))
    return met.where(~again)


def _ways(nodes: DataFrame, edges: DataFrame, made: list[DataFrame]) -> DataFrame:
    """path, obj, way, res: of each node that a root reaches, the nodes from the root to it and the nearest own res."""
    cols = ["path", "up", "obj", "way", "res", "joint"]
    above = edges.groupBy(*_NODE).agg(F.min("up").alias("up"), F.count(F.lit(1)).alias("parents"))
    known = cut(nodes.select(*_NODE, "res").join(above, _NODE, "left").select("*", F.array("obj").alias("way"), (F.coalesce("parents", F.lit(0)) > 1).alias("joint")))
    made.append(known)
    more = edges.join(known.where("joint").select(*_NODE, "way", "res", "joint"), _NODE)
    steps = [known.where("parents = 1").select(*cols).unionByName(more.select(*cols))]
    while True:
        both = cut(_extended(steps[-1], steps[-1]))
        made.append(both)
        if not has_rows(both):
            break
        steps.append(_shortest(both, ["path", "up", "obj"]))
    reached = known.where("parents is null").select(*cols)
    for step in reversed(steps):
        made.append(cut(reached.unionByName(_extended(reached, step))))
        reached = _shortest(made[-1], _NODE).withColumn("up", F.lit(None).cast("bigint"))
    return reached.select(*_NODE, "way", "res")


def _odd_pairs(odd: DataFrame, ways: DataFrame) -> DataFrame:
    """path, anc, obj: the nodes that nodes reach over at least one odd link (up to obj), the last step being one."""
    above = odd.join(ways.select("path", F.col("obj").alias("up"), "way"), ["path", "up"], "left")
    first = cut(above.select("path", F.explode(F.coalesce("way", F.array("up"))).alias("anc"), "obj").distinct())
    # further steps: an odd link leaves what lies below the end of the one before, which first has as pairs
    pairs, n = first, first.count()
    while True:
        l, r = pairs.alias("l"), pairs.alias("r")
        further = l.join(r, [F.col("l.path") == F.col("r.path"), F.col("l.obj") == F.col("r.anc")]).select("l.path", "l.anc", "r.obj")
        more = cut(pairs.unionByName(further).distinct())
        forget(pairs)  # ``more`` has all of them
        pairs, before, n = more, n, more.count()
        if n == before:
            return pairs


def _below(ways: DataFrame, odd: DataFrame) -> DataFrame:
    """path, obj, n_below, on_cycle of the nodes that have others below or lie on a cycle."""
    down = ways.select("path", F.explode(F.slice("way", F.lit(1), F.size("way") - 1)).alias("anc"), "obj")
    plain = down.groupBy("path", F.col("anc").alias("obj")).agg(F.count(F.lit(1)).cast("int").alias("n_below"), F.lit(0).alias("on_cycle"))
    if not has_rows(odd):
        return plain
    jumps = _odd_pairs(odd, ways)
    ends = jumps.select("path", F.col("obj").alias("anc")).distinct()
    reach = down.join(ends, ["path", "anc"], "left_semi").select("path", F.col("anc").alias("end"), "obj")
    over = jumps.withColumnRenamed("obj", "end").join(reach, ["path", "end"]).select("path", "anc", "obj")
    starts = jumps.select("path", "anc").distinct()
    every = down.join(starts, ["path", "anc"], "left_semi").unionByName(jumps).unionByName(over).distinct()
    counted = every.groupBy("path", F.col("anc").alias("obj")).agg(F.count_if(F.col("anc") != F.col("obj")).cast("int").alias("n_below"), F.max((F.col("anc") == F.col("obj")).cast("int")).alias("on_cycle"))
    return plain.join(starts.withColumnRenamed("anc", "obj"), _NODE, "left_anti").unionByName(counted)


def hierarchy(page_nodes: DataFrame) -> DataFrame:
    """One row for each (path, obj): root, depth, path, cycle flag, number of nodes below, inherited resource.

    Needs path, obj, gen, kids, resources_ref, recorded_at; other columns are ignored. Rows with a
    null path or obj are no nodes, a null gen counts as 0. Of several rows of a node the one recorded
    last counts (ties: by content). Null, empty, repeated or dangling kids are ignored. A node reached
    over several ways takes the shortest, then the one over the smallest parent. A node no root
    reaches has root_obj -1, depth_no -1, tree_path '' and res_obj -1. An empty table gives no rows.
    """
    nodes = cut(_nodes(page_nodes))
    wanted = nodes.select("path", F.col("obj").alias("up"), F.explode("kids").alias("k")).select("path", "up", "k.obj", "k.gen").dropna()
    edges = cut(wanted.join(nodes.select(*_NODE, "gen"), [*_NODE, "gen"], "left_semi").select("path", "up", "obj").distinct())
    made: list[DataFrame] = []
    ways = cut(_ways(nodes, edges, made))
    forget(*made)
    taken = ways.where("size(way) > 1").select("path", F.element_at("way", -2).alias("up"), "obj")
    odd = cut(edges.join(taken, ["path", "up", "obj"], "left_anti"))
    forget(edges)
    out = nodes.select(*_NODE).join(ways, _NODE, "left").join(_below(ways, odd), _NODE, "left")
    return out.select(
        *_NODE,
        F.coalesce(F.try_element_at("way", F.lit(1)), F.lit(-1)).alias("root_obj"),
        F.coalesce(F.size("way") - 1, F.lit(-1)).alias("depth_no"),
        F.coalesce(F.array_join(F.transform("way", lambda x: x.cast("string")), "/"), F.lit("")).alias("tree_path"),
        F.coalesce("on_cycle", F.lit(0)).alias("on_cycle"),
        F.coalesce("n_below", F.lit(0)).alias("n_below"),
        F.coalesce("res", F.lit(-1)).alias("res_obj"),
    )
