"""Problems 1 to 7 against brute force on whole tables, and their defined results on small fixtures."""

import pytest
from pyspark.sql import functions as F

from sigloom.operators import drift, hierarchy, hotkeys, nested, orphans, rejects, snapshots
from sigloom.session import table
from tests import brute

FOUND = {
    "p1": (lambda t: snapshots.report_changes(t("report_snapshots")), lambda r: brute.p1(r("report_snapshots"))),
    "p2": (lambda t: rejects.rejected(t("raw_results")), lambda r: brute.p2(r("raw_results"))),
    "p3": (lambda t: hierarchy.report_hierarchy(t("related_formats"), t("report_snapshots")), lambda r: brute.p3(brute.p3_links(r("related_formats"), r("report_snapshots")))),
    "p4": (lambda t: nested.report_children(t("report_json")), lambda r: brute.p4(r("report_json"))),
    "p5": (lambda t: hotkeys.heavy_ids(t("identifications"), t("scan_files")), lambda r: brute.p5(r("identifications"))),
    "p6": (lambda t: drift.head_changes(t("scan_heads")).select("scan_no", "item", "change_kind"), lambda r: brute.p6(r("scan_heads"))),
    "p7": (lambda t: orphans.orphan_references(t("related_formats"), t("report_snapshots")), lambda r: brute.p7(r("related_formats"), r("report_snapshots"))),
}
#: Names that operators use inside; the input may have columns of these names too.
CLASHING = ["key", "snap", "state", "pos", "line", "width", "reason", "node", "ptr", "seg", "st", "x", "v", "items", "previous", "_b", "ident", "path", "ords", "kind", "period", "held", "n", "collection"]


def result(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("name", FOUND)
def test_found_is_brute_force(spark, data, rows, name):
    run, expected = FOUND[name]
    assert result(run(lambda t: table(spark, data, t))) == expected(rows)


@pytest.mark.parametrize("name", FOUND)
def test_empty_tables_and_clashing_columns(spark, data, name):
    run, _ = FOUND[name]
    assert result(run(lambda t: table(spark, data, t).limit(0))) == set()
    plain = result(run(lambda t: table(spark, data, t)))
    assert result(run(lambda t: table(spark, data, t).withColumns({c: F.lit("other") for c in CLASHING}))) == plain


@pytest.mark.parametrize("name", FOUND)
def test_null_and_repeated_rows(spark, data, name):
    """A row of nulls changes nothing (or is a row of its own with null keys), rows delivered again change nothing."""
    run, _ = FOUND[name]

    def dirty(t):
        df = table(spark, data, t)
        none = df.limit(1).select(*(F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns))
        return df.unionByName(none).unionByName(df)

    plain = result(run(lambda t: table(spark, data, t)))
    assert {r for r in result(run(dirty)) if None not in r} == plain


def test_rejects_edges(spark):
    head = "filename,filesize,modified,errors,md5"
    cases = {
        'a,1,2024-02-29T00:00:00Z,,x': None,
        'a,1,2023-02-29T00:00:00Z,,x': "modified",
        'a,9223372036854775807,,,x': None,
        'a,9223372036854775808,,,x': "filesize",
        'a,00009223372036854775807,,,x': None,
        'a,-1,,,x\r': None,
        'a,-2,,,x': "filesize",
        '" ",1,,,x': "filename",
        '"""",1,,,x': None,
        '"a\nb",1,,,"say ""hi"", now"': None,
        'a"b,1,,,x': "quoting",
        '"a"b,1,,,x': "quoting",
        '"a,1,,,x': "quoting",
        "a,1,,": "column_count",
        'a,"12",2024-01-01T23:59:59.123456789+14:00,,x': None,
        "a,1,2024-01-01T24:00:00Z,,x": "modified",
        "a,1,2024-01-01T00:00:00+25:00,,x": "modified",
        "a,1,0000-01-01T00:00:00,,x": "modified",
        "": "column_count",
        "x" * 300_000 + ",1,,,x": None,
        '"' + 'y""' * 100_000 + '",1,,,x': None,
        '"' + 'y""' * 100_000 + ",1,,,x": "quoting",
    }
    lines = [(1, 1, head), *((1, i + 2, c) for i, c in enumerate(cases)), (2, 2, "a,1,,,x"), (1, 99, None)]
    df = spark.createDataFrame(lines, "scan_no bigint, line_no int, raw_line string")
    got = {(r.scan_no, r.line_no): r.reason for r in rejects.rejected(df).collect()}
    expected = {(1, i + 2): why for i, why in enumerate(cases.values()) if why} | {(2, 2): "column_count", (1, 99): "column_count"}
    assert got == expected
    # beyond the bound of compiled schemas the pattern is built per row
    assert {(r.scan_no, r.line_no): r.reason for r in rejects.rejected(df, max_schemas=0).collect()} == expected
    good = {r.line_no: r for r in rejects.loaded(df).collect()}
    assert set(good) == {i + 2 for i, why in enumerate(cases.values()) if not why}
    by = {c: good[i + 2] for i, c in enumerate(cases) if i + 2 in good}
    assert by['"""",1,,,x'].path == '"' and by['a,-1,,,x\r'].size == -1
    assert by['a,"12",2024-01-01T23:59:59.123456789+14:00,,x'].mod_utc == "2024-01-01 09:59:59"


@pytest.mark.parametrize("hot_rows", [0, hierarchy.HOT_ROWS])
@pytest.mark.parametrize("rate", [1, 2, 3, 8, 10**6])
def test_hierarchies_of_all_shapes(spark, rate, hot_rows):
    """Chains, trees, loops with and without splitters, tails below loops; every rate of splitters gives the same."""
    links = [(i + 1, i) for i in range(1, 70)] + [(100 + i, 1 + i % 9) for i in range(40)]
    links += [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(300 + i, 200 + i) for i in range(5)] + [(400, 301), (500, 500), (501, 500), (600, 601), (601, 600)]
    df = spark.createDataFrame([*links, *links, (None, 3), (3, None)], "child bigint, parent bigint")
    x = hierarchy.solve(df, rate, hot_rows).selectExpr("node", "coalesce(root, -1)", "case when path is null then -1 else size(path) - 1 end", "coalesce(array_join(path, '/'), '')", "state")
    assert result(x) == brute.p3(set(links))


def test_several_parents_keep_the_smallest(spark):
    df = spark.createDataFrame([(3, 2), (3, 1), (2, 1)], "child bigint, parent bigint")
    assert {(r.node, tuple(r.path)) for r in hierarchy.solve(df).collect()} == {(1, (1,)), (2, (1, 2)), (3, (1, 3))}


JSON = [
    '{"Signatures": [{"ByteSequences": [{"Hex": "AB", "Offset": 0}, null, {}]}, null, {}], "Relations": {"Typ": "x", "Id": 1}, "Identifiers": "[{\\"Typ\\": \\"a\\"}]"}',
    '{"Signatures": "[{\\"ByteSequences\\": \\"[{\\\\\\"Hex\\\\\\": \\\\\\"AA\\\\\\"}, {}]\\"}]"}',
    '{"Signatures": "no json", "Relations": [], "Identifiers": null}',
    '{"Signatures": [{}], "Signatures": [{}, {}]}',
    '[{"Signatures": [{}]}]', '{"Signatures": [{}]} x', '{"Signatures": [{}],}', '{"a": 01, "Signatures": [{}]}', '{"a": NaN, "Signatures": [{}]}', "", "null", '{"Signatures": [{}]',
    '{"a": "\x01", "Signatures": [{}]}', ' \n{"Relations": [1, "x", [{}], {"Id": "é\\u00e9"}], "b": {"Relations": [{}]}} ', "[" * 5000, '{"Signatures": [' + ",".join(['{"ByteSequences": {"Hex": "00"}}'] * 3000) + "]}",
]


def test_nested_edges(spark):
    rows = [{"rec_no": i, "payload": p} for i, p in enumerate(JSON)]
    df = spark.createDataFrame([(r["rec_no"], r["payload"]) for r in rows] + [(99, None)], "rec_no bigint, payload string")
    assert result(nested.report_children(df)) == brute.p4(rows)
    table_ = {(r.rec_no, r.pos, r.sub_pos): r.hex for r in nested.report_table(df, "byte_sequence").where("rec_no < 2").collect()}
    assert table_ == {(0, 0, 0): "AB", (0, 0, 1): None, (1, 0, 0): "AA", (1, 0, 1): None}
    assert [(r.rec_no, r.id) for r in nested.report_table(df, "relation").where("id is not null").orderBy("rec_no").collect()] == [(0, "1"), (13, "éé")]


def test_long_texts_are_walked_without_holding_triples():
    texts = [*JSON, '{"Signatures": [{"ByteSequences": [{"Hex": "1"}], "ByteSequences": {"Hex": "2", "Hex": "3"}}], "a": {"b": 1, "b": [2, {"c": 3}]}, "a": 5}', '{"Signatures": "[{\\"Note\\": 1, \\"Note\\": 2}]"}', '{"a": [1, 2', '{"Relations": [{}], "Relations": null}']
    for t in filter(None, texts):
        assert list(nested.streamed(t, nested.REPORT, held=0)) == (nested.triples(t, nested.REPORT) or [])
    big = '{"Signatures": [' + ",".join('{"ByteSequences": [{"Hex": "%d"}]}' % i for i in range(60_000)) + "]}"
    assert len(big) > nested.HELD and sum(1 for t in nested.streamed(big, nested.REPORT) if t[2] == "object") == 120_001


def test_all_members_of_all_tables(spark):
    text = '{"Id": 7, "Owner": {"Name": "n", "Tags": ["a", null, "b"]}, "Extensions": ["x", "y"], "Signatures": {"Note": "s", "Extra": [[1]], "ByteSequences": {"Hex": "AB", "Odd": true}}, "Relations": [{"Typ": "t"}, {}]}'
    df = spark.createDataFrame([(1, text), (1, text), (2, '{"Extensions": "z"}'), (3, "[]")], "rec_no bigint, payload string")
    got = {n: sorted(tuple(r) for r in t.collect()) for n, t in nested.flat_tables(df).items()}
    assert got["report"] == [(1, "7", None, None, None, '{"Owner.Name":"n","Owner.Tags[*]@0":"a","Owner.Tags[*]@2":"b"}'), (2, None, None, None, None, None)]
    assert got["signature"] == [(1, 0, "s", '{"Extra[*][*]@0,0":"1"}')]
    assert got["byte_sequence"] == [(1, 0, 0, None, None, None, None, "AB", None, '{"Odd":"true"}')]
    assert got["relation"] == [(1, 0, "t", None, None), (1, 1, None, None, None)] and got["identifier"] == []
    assert got["extension"] == [(1, 0, "x", None), (1, 1, "y", None), (2, 0, "z", None)]
    assert all(r.n_lost == 0 for r in nested.table_links(df).collect())


def test_hot_keys_join_is_exact(spark):
    """The eager aggregate equals the join that is never built."""
    idents = [(i, i % 40, ["HOT ", "hot", "a", "b", None][i % 5], "x") for i in range(300)] * 2
    files = [(i, ["Hot", "a", "a"] if i % 2 else ["c", None], i * 10 - 10) for i in range(40)]
    a = spark.createDataFrame(idents, "ident_no bigint, file_no bigint, ident_id string, other string")
    b = spark.createDataFrame(files, "file_no bigint, ids array<string>, filesize bigint")
    got = {r.ident_id: tuple(r)[1:] for r in hotkeys.id_results(a, b).collect()}
    once = {i[0]: (i[1], i[2].strip().lower()) for i in idents if i[2]}
    listed = {(f, i.lower()): max(size, 0) for f, ids, size in files for i in ids if i}
    for key in {v[1] for v in once.values()} | {k[1] for k in listed}:
        mine, theirs = [v for v in once.values() if v[1] == key], [s for (f, i), s in listed.items() if i == key]
        assert got[key] == (len(mine), len({f for f, _ in mine}), len(theirs), sum(theirs), len(mine) * len(theirs), len(mine) * sum(theirs))
    assert {r.ident_id for r in hotkeys.heavy_ids(a, b, 40).collect()} == {"hot"}


@pytest.mark.parametrize("ranges", [1, 7, None])
def test_previous_in_two_levels(spark, ranges):
    rows = [("a", i * 7 % 100, i) for i in range(100)] + [("b", 1, 500)]
    df = spark.createDataFrame(rows, "k string, t int, val int")
    got = {(r.k, r.t): r.previous for r in drift.with_previous(df, "k", ["t"], "val", ranges).collect()}
    order = sorted(r[1:] for r in rows if r[0] == "a")
    assert got == {("a", t): (order[i - 1][1] if i else None) for i, (t, _) in enumerate(order)} | {("b", 1): None}


def test_drift_edges(spark):
    heads = [
        (1, "c", "2030-01-01", '{"program": "1.0", "hash_header": "md5", "identifiers": [["p", "x"]], "fields": [["namespace", "id"]]}'),
        (2, "c", "2030-02-01", '{"version": [1, 1, 0], "hash_header": "MD5", "identifiers": [["p", "x"], ["q", "y"]], "fields": ["ns,ID", "id"]}'),
        (3, "c", "2030-02-01", "no json"),
        (4, "d", "2030-02-01", '{"program": null, "hash_header": "", "fields": []}'),
        (5, None, "2030-02-01", "{}"),
        (6, "c", None, "{}"),
    ]
    df = spark.createDataFrame(heads, "scan_no bigint, collection_code string, scanned string, head_json string").withColumn("scanned", F.to_timestamp("scanned")).withColumn("arrived_at", F.col("scanned"))
    got = result(drift.head_changes(df).select("scan_no", "item", "change_kind"))
    two = {("version", "renamed"), ("version", "retyped"), ("hash", "renamed"), ("fields", "retyped"), ("p.namespace", "renamed"), ("p.id", "renamed"), ("q.id", "added")}
    three = {(i, "removed") for i in ("version", "hash", "fields", "p.namespace", "p.id", "q.id")}
    assert got == {(2, *x) for x in two} | {(3, *x) for x in three}
    assert {r.scan_no: r.version for r in drift.unified_heads(df).collect()}[2] == "1.1.0"
    assert result(drift.head_changes(df, 5).select("scan_no", "item", "change_kind")) == got


def test_lattice_and_cast(spark):
    heads = ['{"a": 1, "b": true, "c": [1, "x"], "d": {"k": 1}, "e": 1.5, "f": 3, "scan_no": "own", "it\'s": 1, "version": 2}', '{"a": 3000000000, "b": false, "c": ["y"], "d": {"k": 2}, "e": 2, "f": "t"}', '{"a": null, "b": null, "f": [3], "it\'s": 2}', "no json", None]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "scan_no bigint, head_json string").selectExpr("scan_no", "'c' as collection_code", "timestamp'2030-01-01' + make_dt_interval(cast(scan_no as int)) as scanned", "timestamp'2030-01-01' as arrived_at", "head_json")
    union = {r["item"]: r.union_type for r in drift.union_schema(df).collect()}
    assert union == {"head.a": "long", "head.b": "bool", "head.c": "list", "head.d": "object", "head.e": "double", "head.f": "text", "head.scan_no": "text", "head.it's": "int", "version": "int"}
    x = drift.unified_heads(df)
    types = dict(x.dtypes)
    assert types["a"] == "bigint" and types["b"] == "boolean" and types["c"] == "array<string>" and types["e"] == "double" and types["f"] == types["d"] == "string" and types["it's"] == "int"
    rows = {r.scan_no: r for r in x.collect()}
    assert (rows[0].a, rows[1].a, rows[2].a) == (1, 3000000000, None) and rows[0].c == ["1", "x"] and rows[0].d == '{"k":1}' and (rows[0].f, rows[1].f, rows[2].f) == ("3", "t", "[3]")
    assert rows[0].head_scan_no == "own" and rows[0]["it's"] == 1 and rows[2]["it's"] == 2 and rows[3].a is None and rows[0].version == 2 and len(rows) == 5
    with pytest.raises(ValueError, match="long form"):
        drift.unified_heads(df, 3)
    assert {(r.scan_no, r["item"]) for r in drift.head_changes(df).where("change_kind = 'retyped'").collect()} == set()
    lub = lambda *t: spark.range(1).select(drift.fold(F.array(*map(F.lit, t)))).first()[0]
    assert [lub("int", "double", "long"), lub("int", "bool"), lub("list", "object"), lub("list"), lub("int", "long"), lub("text", "int")] == ["double", "text", "text", "list", "long", "text"]


def test_orphans_with_hot_keys(spark):
    related = [(i, 1 + i % 3, 7 if i % 3 else i % 11) for i in range(200)] + [(900, None, 7), (901, 2, None)]
    reports = [(1, 7), (3, 5), (2, 4), (2, None), (None, 8)]
    r = spark.createDataFrame(related, "rel_no bigint, snap_no int, related_id bigint")
    p = spark.createDataFrame(reports, "snap_no int, report_id bigint")
    expected = brute.p7([dict(rel_no=a, snap_no=b, related_id=c) for a, b, c in related if b is not None], [dict(snap_no=a, report_id=b) for a, b in reports]) | {(900, None, "missing")}
    for share in (0.0, 0.1, 2.0):
        assert result(orphans.orphan_references(r, p, share)) == expected
