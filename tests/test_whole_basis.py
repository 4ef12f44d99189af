"""The basis of byte hits, whatever the number of signatures."""

from sigloom.functions import patterns as P
from sigloom.functions.frames import BOF, EOF, PREV, SUCC, Frame, Signature
from sigloom.operators import matchers
from sigloom.sources.catalog import Catalog


def test_basis_of_large_catalogues(spark):
    lit = lambda s: P.Seq(s.encode())
    c = Catalog("n", signatures=[("n", f"i/{k:03}", Signature((Frame(lit(f"<{k:03}>"), BOF, 2, 9),)), 0) for k in range(100)])
    c.signatures += [
        ("n", "two", Signature((Frame(lit("xx"), BOF), Frame(lit("c"), PREV, 0, 8), Frame(lit("e"), SUCC, 1, 3), Frame(lit("f"), EOF, 0, 2))), 0),
        ("n", "wild", Signature((Frame(lit("07"), BOF, 0, None),)), 0),
        ("n", "free", Signature((Frame(lit("7>"), SUCC, 0, None),)), 0),
    ]
    df = spark.createDataFrame([("a", bytearray(b"xxab<007>cde.fz"))], "path string, content binary")
    got = {(r.id, r.basis) for r in matchers.byte_hits(df, [c]).collect()}
    assert got == {("i/007", "byte match at 4, 5"), ("two", "byte match at [[0 10] [11 3]]"), ("wild", "byte match at 6, 2"), ("free", "byte match at 7, 2")}
