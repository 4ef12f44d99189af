"""Queries and operators do the whole job: cases beyond the shapes of the query fixtures."""

from pathlib import Path

import __spark_entry__ as entry
from sigloom.operators import priorities
from sigloom.session import shared_folder

QUERIES = entry.queries()


def reachable(edges: set) -> set:
    """All (sub, sup) pairs joined by a chain, by brute force."""
    out, fresh = set(edges), set(edges)
    while fresh:
        fresh = {(a, d) for a, b in fresh for c, d in edges if b == c and a != d} - out
        out |= fresh
    return out


def test_priority_edges_of_all_kinds(spark, tmp_path):
    said = [(1, "Has lower priority than", 2), (3, "HAS  priority over", 2), (3, "Is supertype of", 4), (5, " is subtype of", 4), (5, "Equivalent to", 1), (6, "Is supertype of", 6), (None, "Is subtype of", 1)]
    spark.createDataFrame(said, "report_id bigint, typ string, related_id bigint").write.parquet(str(tmp_path / "related_formats.parquet"))
    spark.createDataFrame([(i,) for i in range(1, 7)], "report_id bigint").write.parquet(str(tmp_path / "report_snapshots.parquet"))
    edges = {(1, 2), (2, 3), (3, 4), (4, 5)}
    got = lambda name: {(r.sub, r.sup) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got("priority_edges") == edges
    assert got("priority_closure") == reachable(edges)
    chosen = {i for i in range(1, 7) if i % 3}
    induced = {(a, b) for a, b in edges if a in chosen and b in chosen}
    assert got("priority_filter") == induced
    assert got("priority_difference") == edges - induced
    assert got("priority_elements") == induced | {(i, None) for i in chosen - {x for e in induced for x in e}}
    assert [r.id for r in QUERIES["priority_apply"](spark, str(tmp_path)).orderBy("id").collect()] == [1, 2, 3, 4, 5, 6]


def test_closure_of_large_loops_writes_no_pairs_between_rounds(spark, monkeypatch):
    ring, into, beyond = list(range(300)), list(range(1000, 1040)), list(range(2000, 2050))
    edges = {*zip(ring, ring[1:] + ring[:1]), *zip(into, into[1:] + [7]), *zip([11, *beyond], beyond), (3000, 3001), (3001, 3000), (3002, 3000)}
    e = spark.createDataFrame([*edges, (5, 5), (None, 5), (0, 1)], "sub bigint, sup bigint")
    held = lambda: sum(p.stat().st_size for p in Path(shared_folder(spark).removeprefix("file:")).rglob("*") if p.is_file())
    before = held()
    got = [tuple(r) for r in priorities.closure(e).collect()]
    assert held() == before
    want = reachable(edges)
    assert len(got) == len(want) and set(got) == want
    # parts of a task: several tasks, and lists cut within a component
    monkeypatch.setattr(priorities, "LEAST_NODES", 64)
    monkeypatch.setattr(priorities, "WORDS", 3)
    assert sorted(tuple(r) for r in priorities.closure(e).collect()) == sorted(want)


def test_closure_of_texts_and_of_nothing(spark):
    e = spark.createDataFrame([("fmt/1", "fmt/2"), ("fmt/2", "x"), ("", "fmt/1"), ("x", "")], "sub string, sup string")
    for most in (2, 1):  # broadcast, and one edge more than is broadcast
        assert sorted(tuple(r) for r in priorities.closure(e, most).collect()) == [("fmt/1", "fmt/2"), ("fmt/1", "x"), ("fmt/2", "x")]
    none = priorities.closure(e.where("sub = sup"))
    assert none.collect() == [] and none.dtypes == [("sub", "string"), ("sup", "string")]
