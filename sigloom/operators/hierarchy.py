"""Parent-child links to full hierarchies, with loops.

Deterministic hash splitters cut the chains of parents into short stretches:
first every node walks to its next splitter (or root) by pointer jumping that
stops there, then the pointer graph reduced to the splitters is solved the same
way, and exact paths are put together from both parts. A walk that meets itself
without having met a splitter belongs to a splitterless loop and is taken out
on the spot, so every round doubles only what still moves: the number of rounds
is the logarithm of the longest stretch, not the depth. Each round is one
shuffle join whose right side has one row per node; pointers that very many
walkers share are joined by broadcast instead.

Defined results: a node with several parents keeps the smallest; null ends are
ignored; repeated links count once; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.session import cut, squeezed

#: One node in so many is a splitter.
SPLITTER_RATE = 8
SEPARATOR = "/"
#: Walkers at one pointer that a shuffle join takes as they are.
HOT_ROWS = 200_000


def is_splitter(c: Column, rate: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(rate)) == 0


def _settled(x: DataFrame, stop: Column) -> DataFrame:
    """node, ptr, seg with the walker's state: ``loop`` once it met itself, ``done`` at a stop, else ``active``.

    seg holds the passed nodes, nearest to ptr first, the node itself last; of a walker that met itself, the part up
    to ptr is one turn of the loop, so it tells whether the node is on the loop or only below it.
    """
    seg, ptr = F.col("seg"), F.col("ptr")
    turn = F.slice(seg, F.lit(1), F.array_position(seg, ptr).cast("int"))
    met = F.array_contains(seg, ptr)
    return x.select("node", "ptr", "seg", F.when(met, "loop").when(stop, "done").otherwise("active").alias("st"), (met & F.array_contains(turn, F.col("node"))).alias("on_ring"))


def jump(start: DataFrame, stop, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pointer jumping until no walker is active: node, ptr, seg, st, on_ring.

    ``stop(ptr)`` tells the pointers to stop at; a pointer without a row of its own is a root and stops too. Walkers that
    have settled are written once and only read from then on. After doubling, whole subtrees point at one node: pointers
    of more walkers than ``hot_rows`` and a thousandth of all are at most a thousand, so theirs are broadcast.
    """
    state = cut(start)
    parts = []
    while True:
        parts.append(state.where("st != 'active'"))
        moving = state.where("st = 'active'").select("node", "ptr", "seg")
        n = moving.count()
        if not n:
            return reduce(DataFrame.unionByName, parts)
        # no pointer is crowded if there are not even so many walkers
        most = moving.groupBy("ptr").count().agg(F.max("count")).first()[0] if n > hot_rows else n
        ahead = reduce(DataFrame.unionByName, [*parts, state.where("st = 'active'")]).select(F.col("node").alias("ptr"), F.col("ptr").alias("p2"), F.col("seg").alias("s2"))
        if most > max(hot_rows, n // 1000):
            hot = F.broadcast(moving.groupBy("ptr").count().where(F.col("count") > max(hot_rows, n // 1000)).select("ptr"))
            led = moving.join(hot, "ptr", "left_semi").join(F.broadcast(ahead.join(hot, "ptr", "left_semi")), "ptr", "left")
            met = led.unionByName(moving.join(hot, "ptr", "left_anti").join(ahead, "ptr", "left"))
        else:
            met = moving.join(ahead, "ptr", "left")
        moved = met.select("node", F.coalesce("p2", "ptr").alias("ptr"), F.when(F.col("p2").isNull(), F.col("seg")).otherwise(F.concat("s2", "seg")).alias("seg"), F.col("p2").isNull().alias("at_root"))
        state = cut(_settled(moved, F.col("at_root") | stop(F.col("ptr"))))


def solve(links: DataFrame, rate: int = SPLITTER_RATE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """links (child, parent: bigint) -> node, root, path (array from root to node), state (tree, cycle, below_cycle)."""
    splits = lambda c: is_splitter(c, rate)
    links = cut(links.where("child is not null and parent is not null").groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("ptr")))
    walked = jump(_settled(links.select("node", "ptr", F.array("node").alias("seg")), splits(F.col("ptr"))), splits, hot_rows)
    # the reduced graph: only splitters, each pointing at its next splitter or root
    again = F.when((F.col("st") == "done") & splits(F.col("ptr")), "active").otherwise(F.col("st"))
    solved = jump(walked.where(splits(F.col("node"))).withColumn("st", again), lambda _: F.lit(False), hot_rows)
    # every node of a loop with splitters lies on the walk of one of its splitters
    on_walk = walked.join(solved.where("on_ring").select("node"), "node", "left_semi").select(F.explode("seg").alias("node"))
    rings = walked.where("on_ring").select("node").union(on_walk).distinct().withColumn("ring", F.lit(True))
    ahead = solved.select(F.col("node").alias("ptr"), F.col("ptr").alias("far"), F.col("seg").alias("far_seg"), F.col("st").alias("far_st"))
    x = walked.join(ahead, "ptr", "left").join(rings, "node", "left")
    looped = (F.col("st") == "loop") | (F.coalesce("far_st", F.lit("done")) == "loop")
    root = F.coalesce("far", "ptr")
    path = F.concat(F.array(root), F.coalesce("far_seg", F.expr("cast(array() as array<bigint>)")), F.col("seg"))
    below = x.select(
        "node",
        F.when(~looped, root).alias("root"),
        F.when(~looped, path).alias("path"),
        F.when(~looped, "tree").when(F.col("ring"), "cycle").otherwise("below_cycle").alias("state"),
    )
    roots = links.select(F.col("ptr").alias("node")).distinct().join(links.select("node"), "node", "left_anti")
    return below.unionByName(roots.select("node", F.col("node").alias("root"), F.array("node").alias("path"), F.lit("tree").alias("state")))


def subtype_links(related: DataFrame, reports: DataFrame) -> DataFrame:
    """(child, parent) from the subtype and supertype statements whose both ends occur among the reports."""
    typ = squeezed("typ")
    sub, sup = typ == "is subtype of", typ == "is supertype of"
    ends = related.where(sub | sup).select(F.when(sub, F.col("report_id")).otherwise(F.col("related_id")).alias("child"), F.when(sub, F.col("related_id")).otherwise(F.col("report_id")).alias("parent")).distinct()
    known = reports.select("report_id").where("report_id is not null").distinct()
    return ends.join(known, ends.child == known.report_id, "left_semi").join(known, ends.parent == known.report_id, "left_semi")


def report_hierarchy(related: DataFrame, reports: DataFrame, rate: int = SPLITTER_RATE) -> DataFrame:
    """report_id, root_id, node_depth, node_path, node_state; nodes in or below a loop get -1, -1 and ''."""
    x = solve(subtype_links(related, reports), rate)
    return x.select(
        F.col("node").alias("report_id"),
        F.coalesce("root", F.lit(-1).cast("bigint")).alias("root_id"),
        F.when(F.col("path").isNull(), -1).otherwise(F.size("path") - 1).cast("int").alias("node_depth"),
        F.coalesce(F.array_join(F.col("path").cast("array<string>"), SEPARATOR), F.lit("")).alias("node_path"),
        F.col("state").alias("node_state"),
    )


def descendants(related: DataFrame, reports: DataFrame, rate: int = SPLITTER_RATE) -> DataFrame:
    """ancestor_id, report_id, distance: every pair of a tree node and one of its descendants."""
    x = solve(subtype_links(related, reports), rate).where("state = 'tree'")
    return x.select("node", F.size("path").alias("n"), F.posexplode("path").alias("i", "ancestor_id")).where("i < n - 1").select("ancestor_id", F.col("node").alias("report_id"), (F.col("n") - 1 - F.col("i")).cast("int").alias("distance"))
