"""Archives are opened whole: every member, every level."""

import gzip

from sigloom.sources import archives


def test_all_members_of_a_gzip(spark):
    two = gzip.compress(b"one ", mtime=0) + gzip.compress(b"two", mtime=0)
    rows = [("a.gz", bytearray(two)), ("tail.gz", bytearray(two + b"junk")), ("short.gz", bytearray(two[:-3]))]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {(r.path, r.content and bytes(r.content), r.error is None) for r in archives.expand(df).where("depth > 0").collect()}
    assert got == {("a.gz#a", b"one two", True), ("tail.gz#tail", b"one two", True), ("tail.gz#", None, False), ("short.gz#short", b"one ", True), ("short.gz#", None, False)}


def test_any_depth(spark):
    data = b"deep"
    for _ in range(9):
        data = gzip.compress(data, mtime=0)
    df = spark.createDataFrame([("a", bytearray(data))], "path string, content binary")
    deepest = max(archives.expand(df).collect(), key=lambda r: r.depth)
    assert deepest.depth == 9 and bytes(deepest.content) == b"deep" and deepest.error is None
    limited = {r.depth: r.error for r in archives.expand(df, max_depth=2).collect()}
    assert set(limited) == {0, 1, 2} and limited[1] is None and "limit" in limited[2]
