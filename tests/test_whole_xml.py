"""The XML root is found behind a prolog of any length."""

from sigloom.operators import matchers
from sigloom.sources.catalog import Catalog

import __spark_entry__ as entry
from sigloom.plans import identification


def test_long_prologs(spark):
    root = "<m:feed a='1' xmlns:m='urn:x'>"
    texts = {
        "comment": "<!-- " + "x" * 100_000 + " -->" + root,
        "comments": "<!-- > -->\n" * 20_000 + root,
        "instructions": "<?a b?>" * 20_000 + root,
        "subset": "<!DOCTYPE x [" + "<!ENTITY a \"]>\"><!-- it's ] -->" * 10_000 + "]>" + root,
        "blanks": "\ufeff" + " \n" * 50_000 + root,
        "none": "<!-- " + "x" * 100_000 + root,
        "bracket": "<!DOCTYPE x PUBLIC \"a>b\" 'c[d'>" + root,
    }
    df = spark.createDataFrame([(k, bytearray(v.encode())) for k, v in texts.items()], "path string, content binary")
    got = {(r.path, r.id) for r in matchers.xml_hits(df, [Catalog("x", xmls=[("x", "f", "feed", "urn:x")])]).collect()}
    assert got == {(k, "f") for k in texts if k != "none"}


def test_query_holds_the_whole_text(spark, data):
    files, n = identification.xml_files(spark, data), spark.read.parquet(f"{data}/documents.parquet").selectExpr("sum(octet_length(encode(text, 'UTF-8')))").first()[0]
    assert files.selectExpr("sum(octet_length(content))").first()[0] > n
    assert entry.queries()["xml_root"](spark, data).count() > 0
