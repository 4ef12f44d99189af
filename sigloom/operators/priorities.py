"""Priority graphs and format sets as DataFrames: closure, dominance, difference, expansion, order.

Graphs here are catalogues' (edges between formats), but the operators make no
use of that. Closure sends the graph, which is far smaller than its closure, to
all tasks, and each makes the pairs of its own superiors, so no pair is
shuffled or written twice. A graph too large to be sent runs as a semi-naive
join loop that carries only new pairs, with the lineage cut per round. Defined
results: self-links and links with empty or null ends are no edges; loops are
allowed; a node is never its own superior.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.session import cut

#: Edges up to which a graph is broadcast.
MAX_EDGES = 500_000
#: Bits of reached nodes that a task holds, nodes a task has at least, and words of reached nodes that are made pairs at once.
TASK_BITS, LEAST_NODES, WORDS = 1 << 29, 512, 1 << 14


def clean(edges: DataFrame) -> DataFrame:
    """Distinct (sub, sup) edges without self-links and empty ends."""
    return edges.where("sub is not null and sup is not null and sub != sup and cast(sub as string) != '' and cast(sup as string) != ''").select("sub", "sup").distinct()


def grown(parts: list[DataFrame], step, most: int | None = None) -> list[DataFrame]:
    """``parts`` and all rows that ``step`` (fresh rows -> rows) leads to; the last part is the fresh one.

    Every row is written once, in the round that finds it. With ``most`` the growth pauses once there are more rows; then
    the last part is not empty.
    """
    names, n = parts[0].columns, 0
    while most is None or n <= most:
        fresh = cut(step(parts[-1]).distinct().join(reduce(DataFrame.unionByName, parts), names, "left_anti"))
        more = fresh.count()
        parts, n = [*parts, fresh], n + more
        if not more:
            break
    return parts


def closure(edges: DataFrame, most: int = MAX_EDGES) -> DataFrame:
    """All (sub, sup) pairs joined by a chain of edges. Loops make this quadratic in their nodes, as every pair of them is a row.

    The edges are counted: up to ``most`` the graph is broadcast, beyond that the pairs are joined round by round.
    """
    e = clean(edges)
    kinds = [e.schema[c].dataType for c in ("sub", "sup")]
    if kinds[0] == kinds[1] and kinds[0].simpleString() in ("tinyint", "smallint", "int", "bigint", "string"):
        known = e.limit(most + 1).toArrow()
        if known.num_rows <= most:
            return reached(e.sparkSession, known, kinds[0])
    return walked(e)


def walked(edges: DataFrame, near: int = 16) -> DataFrame:
    """The closure of distinct edges of any number, as a loop of joins.

    First the pairs of a few hops, up to ``near`` times as many as there are edges; then every round goes on by as many hops
    at once, so there are far fewer rounds than the longest chain has edges.
    """
    e = cut(edges)
    on = lambda by: lambda fresh: fresh.join(by.select(F.col("sub").alias("sup"), F.col("sup").alias("next")), "sup").select("sub", F.col("next").alias("sup")).where("sub != sup")
    first = grown([e], on(e), near * e.count())
    return reduce(DataFrame.unionByName, grown(first, on(reduce(DataFrame.unionByName, first))))


def components(n: int, start: list[int], to: list[int]) -> np.ndarray:
    """The strong component of each of ``n`` nodes, numbered so that an edge leads to its own component or a lower one.

    The edges of node v end at to[start[v] : start[v + 1]]. Tarjan's algorithm with a stack of its own, as chains are long.
    """
    seen, low, comp = [0] * n, [0] * n, [-1] * n
    at, held, path = start[:n], [], []
    when = found = 0
    for root in range(n):
        if seen[root]:
            continue
        path.append(root)
        while path:
            v = path[-1]
            if not seen[v]:
                when += 1
                seen[v] = low[v] = when
                held.append(v)
            if at[v] < start[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if not seen[w]:
                    path.append(w)
                elif comp[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            path.pop()
            if low[v] == seen[v]:
                while comp[v] < 0:
                    comp[held.pop()] = found
                found += 1
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
    return np.array(comp, dtype=np.int64)


def reached(spark: SparkSession, edges: pa.Table, kind) -> DataFrame:
    """The closure of edges that fit into memory.

    The graph of strong components, which has no loops, goes to all tasks. The nodes, in the order of their components, are
    dealt out to the tasks as superiors. A task finds by bit sets which of its own each component reaches, and gives lists
    of subs and sups; pairs are made of them in the JVM.
    """
    out = f"sub {kind.simpleString()}, sup {kind.simpleString()}"
    if not edges.num_rows:
        return spark.createDataFrame([], out)
    ends = pa.chunked_array([*edges["sub"].chunks, *edges["sup"].chunks]).combine_chunks().dictionary_encode()
    sub, sup = np.split(ends.indices.to_numpy(zero_copy_only=False).astype(np.int64), 2)
    n = len(ends.dictionary)
    sup = sup[np.argsort(sub, kind="stable")]
    start = np.concatenate(([0], np.cumsum(np.bincount(sub, minlength=n))))
    sub = np.sort(sub)
    comp = components(n, start.tolist(), sup.tolist())
    k = int(comp.max()) + 1
    order = np.argsort(comp, kind="stable")
    links = np.unique(np.stack((comp[sub], comp[sup]), 1)[comp[sub] != comp[sup]], axis=0)
    cores = spark.sparkContext.defaultParallelism
    tasks = max(-(-n // max(64, TASK_BITS // k)), min(4 * cores, -(-n // LEAST_NODES)))
    shared = spark.sparkContext.broadcast((ends.dictionary.take(pa.array(order)), comp[order], links))
    per = WORDS

    def run(batches):
        nodes, comp, links = shared.value
        k = int(comp[-1]) + 1
        members = pa.ListArray.from_arrays(pa.array(np.searchsorted(comp, np.arange(k + 1)), pa.int32()), nodes)
        for batch in batches:
            for task in batch.column(0).to_pylist():
                mine = np.arange(task, len(comp), tasks)
                wide = -(-len(mine) // 64)
                bits = np.zeros((k, 8 * wide), np.uint8)
                j = np.arange(len(mine))
                np.bitwise_or.at(bits, (comp[mine], j >> 3), (1 << (j & 7)).astype(np.uint8))
                words = bits.view(np.uint64)
                for x, y in links.tolist():  # from low to high, so y is whole
                    words[x] |= words[y]
                some = np.flatnonzero(words)
                for i in range(0, len(some), per):
                    at = some[i : i + per]
                    word, bit = np.nonzero(np.unpackbits(bits.reshape(-1, 8)[at], axis=1, bitorder="little"))
                    at = at[word]
                    comps = at // wide
                    first = np.flatnonzero(np.diff(comps, prepend=-1))
                    sups = nodes.take(pa.array(mine[(at % wide) * 64 + bit]))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), sups)
                    yield pa.RecordBatch.from_arrays([members.take(pa.array(comps[first])), lists], names=["subs", "sups"])

    lists = spark.range(0, tasks, 1, tasks).mapInArrow(run, f"subs array<{kind.simpleString()}>, sups array<{kind.simpleString()}>")
    return lists.select(F.explode("subs").alias("sub"), "sups").select("sub", F.explode("sups").alias("sup")).where("sub != sup")


def apply(hits: DataFrame, edges: DataFrame, group: str = "grp") -> DataFrame:
    """Hits (group, id) without those that have a superior among the hits of their group."""
    over = hits.select(group, F.col("id").alias("sup")).join(edges, "sup").select(group, F.col("sub").alias("id")).distinct()
    return hits.join(over, [group, "id"], "left_anti")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges both of whose ends are among the ids."""
    return edges.join(ids.select(F.col("id").alias("sub")), "sub", "left_semi").join(ids.select(F.col("id").alias("sup")), "sup", "left_semi").select("sub", "sup")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges of a that b lacks."""
    return clean(a).join(clean(b), ["sub", "sup"], "left_anti")


def elements(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges, and the ids without any edge with a null superior."""
    ends = edges.select(F.col("sub").alias("id")).union(edges.select(F.col("sup").alias("id")))
    alone = ids.select("id").join(ends, "id", "left_anti").distinct()
    return edges.select("sub", "sup").unionByName(alone.select(F.col("id").alias("sub"), F.lit(None).cast(edges.schema["sup"].dataType).alias("sup")))


def relation_edges(related: DataFrame) -> DataFrame:
    """(sub, sup) edges from the relations of format reports."""
    from sigloom.session import squeezed

    typ = squeezed("typ")
    below = typ.isin("has lower priority than", "is supertype of")
    above = typ.isin("has priority over", "is subtype of")
    x = related.where(below | above).select(F.when(below, F.col("report_id")).otherwise(F.col("related_id")).alias("sub"), F.when(below, F.col("related_id")).otherwise(F.col("report_id")).alias("sup"))
    return clean(x)


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    """(set, member) of sets files: JSON objects from a set's name to its list of members."""
    df = spark.read.text(path, wholetext=True)
    sets = F.from_json("value", "map<string, array<string>>")
    return df.select(F.explode(sets).alias("set", "members")).select("set", F.explode("members").alias("member"))


def expand_sets(members: DataFrame, wanted: list[str]) -> DataFrame:
    """(set, member) of the wanted sets with members that are @sets expanded, whatever the depth and the loops.

    A set that is named and exists nowhere is an error, as in a list that misses formats without telling.
    """
    member = F.regexp_extract("member", r"^\s*(\S+)", 1)
    rows = cut(members.select("set", member.alias("member")).where("member != ''").distinct())
    inner = rows.withColumnRenamed("set", "inner")
    start = cut(rows.where(F.col("set").isin(wanted)))
    parts = grown([start], lambda fresh: fresh.where("member like '@%'").select("set", F.expr("substring(member, 2)").alias("inner")).join(inner, "inner").select("set", "member"))
    out = reduce(DataFrame.unionByName, parts)
    named = out.where("member like '@%'").select(F.expr("substring(member, 2)").alias("set")).union(members.sparkSession.createDataFrame([(w,) for w in wanted], "set string"))
    lost = [r.set for r in named.distinct().join(rows.select("set"), "set", "left_anti").orderBy("set").limit(10).collect()]
    if lost:
        raise ValueError(f"unknown sets: {', '.join(lost)}")
    return out.where("member not like '@%'")


def format_order(c) -> list:
    """Sort keys of format ids: fmt/n by number, then x-fmt/n by number, then the others by text."""
    n = F.expr(f"try_cast(regexp_extract({c}, '^(?:x-)?fmt/([0-9]+)$', 1) as bigint)")
    rank = F.when(n.isNull(), 2).when(F.col(c).startswith("x-"), 1).otherwise(0)
    return [rank, n, F.col(c)]
