"""Vocabularies, archives, results files, resolution and streaming on small fixtures."""

import gzip
import io
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from sigloom.functions import scalars
from sigloom.operators import matchers, priorities
from sigloom.operators import results as R
from sigloom.operators.identify import ScanOptions, identify, scan
from sigloom.operators.resolve import waiting
from sigloom.plans.vocabularies import CONTAINERS, DROID, LIBRARY, MIMEINFO
from sigloom.sources import archives, files, library, linked, mimeinfo, registry, results
from sigloom.sources.catalog import Catalog, combined, load
from sigloom.streaming.identify import arriving, identify_stream

REPORT = """<?xml version="1.0"?><PRONOM-Report xmlns="http://pronom.nationalarchives.gov.uk"><report_format_detail><FileFormat><FormatID>{n}</FormatID><FormatName>{name}</FormatName><FormatVersion>1.0</FormatVersion><FormatTypes>Image (Raster)</FormatTypes>
<FormatIdentifier><Identifier>fmt/{n}</Identifier><IdentifierType>PUID</IdentifierType></FormatIdentifier><FormatIdentifier><Identifier>{mime}</Identifier><IdentifierType>MIME</IdentifierType></FormatIdentifier>
<ExternalSignature><ExternalSignatureID>1</ExternalSignatureID><Signature>{ext}</Signature><SignatureType>File extension</SignatureType></ExternalSignature>
<InternalSignature><SignatureID>1</SignatureID>{seqs}</InternalSignature>{related}</FileFormat></report_format_detail></PRONOM-Report>"""
SEQ = "<ByteSequence><PositionType>{0}</PositionType><Offset>{1}</Offset><MaxOffset></MaxOffset><ByteSequenceValue>{2}</ByteSequenceValue></ByteSequence>"


@pytest.fixture(scope="module")
def pictures(spark, tmp_path_factory):
    """A catalogue from report files."""
    d = tmp_path_factory.mktemp("reports")
    bof, eof = "Absolute from BOF", "Absolute from EOF"
    rel = "<RelatedFormat><RelationshipType>Has priority over</RelationshipType><RelatedFormatID>3</RelatedFormatID><RelatedFormatName>x</RelatedFormatName></RelatedFormat>"
    made = [
        (11, "Picture", "image/png", "png", SEQ.format(bof, 0, "89504E470D0A1A0A0000000D49484452") + SEQ.format(eof, 0, "0000000049454E44AE426082"), ""),
        (14, "Document", "application/pdf", "pdf", SEQ.format(bof, 0, "255044462D312E30") + SEQ.format(eof, 0, "2525454F46"), ""),
        (3, "Animation", "image/gif", "gif", SEQ.format(bof, 0, "474946383761") + SEQ.format(eof, 0, "3B"), ""),
        (4, "Newer animation", "image/gif", "gif", SEQ.format(bof, 0, "474946383761"), rel),
    ]
    for n, name, mime, ext, seqs, related in made:
        (d / f"fmt{n}.xml").write_text(REPORT.format(n=n, name=name, mime=mime, ext=ext, seqs=seqs, related=related))
    reports = registry.read_reports(spark, str(d))
    assert {r.puid for r in reports.collect()} == {"fmt/11", "fmt/14", "fmt/3", "fmt/4"}
    assert {tuple(r) for r in registry.report_relations(reports).collect()} == {("fmt/3", "fmt/4")}
    assert registry.report_mimes(reports).count() == 4
    return registry.from_reports(reports)


PNG = bytes.fromhex("89504e470d0a1a0a0000000d494844520000000049454e44ae426082")
PDF = bytes.fromhex("255044462d312e302525454f46")
GIF = bytes.fromhex("4749463837613b")


def held(spark, *rows):
    return spark.createDataFrame([(p, m, bytearray(c)) for p, m, c in rows], "path string, mime string, content binary")


def test_one_scan_for_all_matchers_and_namespaces(spark, pictures, tmp_path):
    held(spark, ("a.png", "", PNG)).write.parquet(str(tmp_path / "f"))
    plan = identify(spark.read.parquet(str(tmp_path / "f")), [pictures, Catalog("loc", fourccs=[("loc", "l", "WAVE")], xmls=[("loc", "l", "a", "")], texts=[("loc", "l", True)])])._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("MapInArrow") == 1


def test_exact_rows(spark, pictures):
    some = pictures.limit(["fmt/11", "fmt/14", "fmt/3"])
    df = held(spark, ("a.png", "", PNG), ("a.pdf", "", PDF), ("a.gif", "image/gif", GIF), ("badf00d.unknown", "", bytes.fromhex("badf00")), ("b.doc", "image/png", PNG))
    got = {r.path: (r.id, r.basis, r.warning) for r in identify(df, [some]).collect()}
    assert got["a.png"] == ("fmt/11", "extension match png; byte match at [[0 16] [16 12]]", "")
    assert got["a.pdf"] == ("fmt/14", "extension match pdf; byte match at [[0 8] [8 5]]", "")
    assert got["a.gif"] == ("fmt/3", "extension match gif; mime match image/gif; byte match at [[0 6] [6 1]]", "")
    assert got["badf00d.unknown"] == ("UNKNOWN", "", "no match")
    assert got["b.doc"] == ("fmt/11", "mime match image/png; byte match at [[0 16] [16 12]]", "extension mismatch")


def test_modes(spark, pictures):
    df = held(spark, ("a.gif", "", GIF), ("only.pdf", "", b"?"), ("e.pdf", "", b""))
    ids = lambda mode, dom="set": {(r.path, r.id) for r in identify(df, [pictures], mode, dom).collect()}
    assert ids("conclusive") == {("a.gif", "fmt/4"), ("only.pdf", "UNKNOWN"), ("e.pdf", "UNKNOWN")}
    assert ids("droid") == ids("conclusive") and ids("conclusive", "ordered") == ids("conclusive")
    assert ids("comprehensive") == {("a.gif", "fmt/3"), ("a.gif", "fmt/4"), ("only.pdf", "UNKNOWN"), ("e.pdf", "UNKNOWN")}
    assert ids("exhaustive") == {("a.gif", "fmt/3"), ("a.gif", "fmt/4"), ("only.pdf", "fmt/14"), ("e.pdf", "fmt/14")}
    with pytest.raises(ValueError, match="mode"):
        identify(df, [pictures], "best")
    notes = {r.path: r.warning for r in identify(df, [pictures]).collect()}
    assert notes["only.pdf"] == "no match; possibilities based on extension are fmt/14"


def test_ordered_dominance(spark):
    c = Catalog("n", priorities=[("n", "a", "b"), ("n", "a", "c"), ("n", "b", "c")], signatures=[])
    hits = [("f", "n", i, matchers.BYTE, 1, 1, 1, k, "byte") for k, i in enumerate("axb")] + [("g", "n", "x", matchers.BYTE, 1, 1, 1, 0, "byte"), ("g", "n", "y", matchers.BYTE, 1, 1, 1, 1, "byte"), ("g", "n", "y", matchers.NAME, 0, 1, 0, 0, "ext")]
    df = spark.createDataFrame(hits, "path string, ns string, id string, matcher int, sig_no int, sig_total int, phase int, offset bigint, basis string")
    # a, then x (no superior of a) is left out, then b; y stays alive by its extension
    assert {(r.path, r.id, r.matcher) for r in waiting(df, [c]).collect()} == {("f", "a", 5), ("f", "b", 5), ("g", "x", 5), ("g", "y", 5), ("g", "y", 0)}


def test_catalogs(spark, pictures, tmp_path):
    pictures.save(spark, str(tmp_path / "cat"))
    again = load(spark, str(tmp_path / "cat"))
    assert len(again.stored) == len(pictures.signatures) and len(again.priorities) == 1 and again.ids() == pictures.ids()
    same = held(spark, ("a.gif", "", GIF), ("b.png", "", PNG), ("c.pdf", "", b"?"), ("d", "", b""))
    assert {tuple(r) for r in identify(same, [again]).collect()} == {tuple(r) for r in identify(same, [pictures]).collect()}
    assert pictures.without("byte", "name").signatures == [] and pictures.without("name").globs == []
    assert "fmt/3\" -> \"fmt/4" in pictures.priority_graph()
    assert pictures.inspect("fmt/11")["globs"] == [("ext", "png", 0, 50)]
    assert pictures.implicit_priorities() == [("pronom", "fmt/4", "fmt/3")] and pictures.missing_priorities() == [("pronom", "fmt/4", "fmt/3")]
    with pytest.raises(ValueError, match="differ"):
        combined(pictures, pictures)
    assert pictures.scan_limits(no_eof=True).signatures[0][2].runs[0].from_end is False
    two = identify(held(spark, ("a.png", "", PNG)), [pictures, library.from_library([])]).collect()
    assert {(r.ns, r.id) for r in two} == {("pronom", "fmt/11"), ("loc", "UNKNOWN")}


def test_build_options():
    from sigloom.sources.presets import PRESETS, BuildOptions, apply, log_options, preset

    d = registry.add_containers(registry.from_droid(DROID), CONTAINERS)
    x = apply(d, BuildOptions(name="own", exclude=("fmt/3",), without=("mime",), bof=100, eof=100, multi="droid", zip_default="z"))
    assert x.ns == "own" and not x.mimes and {i for _, i in x.ids()} == {"fmt/1", "fmt/2", "fmt/4"} and x.multi == "droid" and x.zip_default == "z"
    assert x.details == "DROID signatures; multi set to droid; excluding ids: fmt/3; no mime matcher; max BOF 100; max EOF 100"
    assert all(r[0] == "own" for r in x.globs)
    extended = apply(d, BuildOptions(extensions=(Catalog("e", "more", globs=[("e", "e/1", "ext", "x", 0, 50)]),)))
    assert ("pronom", "e/1", "ext", "x", 0, 50) in extended.globs
    both = preset("deluxe", {"registry": d, "tika": Catalog("tika"), "freedesktop": Catalog("freedesktop"), "library": Catalog("loc"), "linked": Catalog("wikidata")})
    assert [c.ns for c in both] == ["pronom", "tika", "freedesktop", "loc", "wikidata"] and set(PRESETS) >= {"default", "wikidata"}
    more = {f"archivematica-fmt{n}.xml": Catalog("e", globs=[("e", f"fmt{n}", "ext", "x", 0, 50)]) for n in range(2, 6)}
    (one,) = preset("archivematica", {"registry": d, **more})
    assert {r[1] for r in one.globs if r[3] == "x"} == {"fmt2", "fmt3", "fmt4", "fmt5"}
    assert d.recognise("byte_sigs", 0) == "pronom: fmt/1 (signature 1/1)" and d.recognise("byte_sigs", 99) == "not recognised"
    assert d.blame(bytes.fromhex("89504E470102AE426082")) == ["pronom: fmt/1 (signature 1/1) matches", "pronom: fmt/2 (signature 1/1) is a candidate"]
    assert log_options("e, w,fmt/1,@set") == ({"error", "warning"}, ["fmt/1", "@set"])


def test_mimeinfo_rules():
    assert mimeinfo.unquote("a\\x41\\101\\9\\n\\\\") == b"aAA\t\n\\"
    assert mimeinfo.offsets("4") == (4, 4) and mimeinfo.offsets("2:8") == (2, 8) and mimeinfo.offsets(":8") == (0, 8)
    assert mimeinfo.magic_pattern("unicodeLE", "ab", None).data == b"a\0b\0" and mimeinfo.magic_pattern("little32", "0x01020304", None).data == b"\4\3\2\1"
    assert mimeinfo.magic_pattern("regex", "x", None) is None
    with pytest.raises(ValueError, match="unknown"):
        mimeinfo.magic_pattern("odd", "x", None)
    with pytest.raises(ValueError, match="twice"):
        mimeinfo.from_mimeinfo('<a><mime-type type="x"/><mime-type type="x"/></a>')


def test_mimeinfo_results(spark):
    c = mimeinfo.from_mimeinfo(MIMEINFO)
    svg = b'<?xml version="1.0"?><svg xmlns="http://www.w3.org/2000/svg"></svg>'
    df = held(spark, ("a.svg", "", svg), ("b.xml", "", b"<?xml ?><a/>"), ("c.txt", "", b"words"), ("README", "", b"\0\1"), ("d", "image/svg+xml", b"\0"))
    got = {r.path: (r.id, r.warning) for r in identify(df, [c]).collect()}
    assert got["a.svg"] == ("image/svg+xml", "") and got["b.xml"] == ("application/xml", "")
    assert got["c.txt"] == ("text/plain", "match on filename and text only")
    assert got["README"] == ("application/x-demo", "match on filename only; byte/xml signatures for this format did not match")
    assert got["d"][0] == "image/svg+xml" and got["d"][1].startswith("match on MIME only")


def test_library_rules(tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("fddXML/fdd1.xml", LIBRARY[0])
        z.writestr("fddXML/test.xml", "<broken")
        z.writestr("fddXML/empty.xml", "")
        z.writestr("other.xml", "<broken")
    docs = library.read_documents(out.getvalue())
    c = library.from_library(docs)
    assert len(docs) == 1 and c.fourccs == [("loc", "fdd1", "fmt ")] and c.details.endswith("2015-06-07")
    (s,) = [s for _, _, s, _ in c.signatures]
    assert s.matches(b"RIFF1234WAVEfmt ") and not s.matches(b"RIFF1234WAVEfm")
    assert [p.regex() for _, p in library.dehex("0xFF 0xD8")] == ["\\xFF\\xD8"]
    assert library.puid_of("http://x/PRONOM/x-fmt/12") == "x-fmt/12" and library.puid_of("http://x") is None


def test_linked_catalog(spark, tmp_path):
    cell = lambda **k: {n: {"value": v} for n, v in k.items()}
    import json

    (tmp_path / "r.json").write_text(json.dumps({"results": {"bindings": [
        cell(uri="http://x/Q1", uriLabel="One", extension="one", encoding="http://x/Q82828", sig="4142", relativity="http://x/Q35436009", offset="0", referenceLabel="Src", date="2020-01-01T00:00:00Z"),
        cell(uri="http://x/Q1", uriLabel="One", extension="one", encoding="http://x/Q82828", sig="5A", relativity="http://x/Q1148480", offset="0", referenceLabel="Src", date="2020-01-01T00:00:00Z"),
        cell(uri="http://x/Q2", uriLabel="Two", puid="fmt/1"),
    ]}}))
    records = linked.condense(linked.read_bindings(spark, str(tmp_path / "r.json")))
    c = linked.from_linked(records, registry=registry.from_droid(DROID))
    assert sorted({i for _, i, _, _ in c.signatures}) == ["Q1", "Q2"]
    one = next(s for _, i, s, _ in c.signatures if i == "Q1")
    assert one.matches(b"AB..Z") and not one.matches(b"AB..")


def test_own_properties(spark):
    text = '{"PronomProp": "http://own/entity/Q2", "BofProp": "http://own/entity/Q3", "EofProp": "http://own/entity/Q4"}'
    encodings, relativities = linked.own_properties(text)
    assert encodings["Q2"] == "pronom" and "Q35432091" not in encodings and relativities == {"Q3": "BOF", "Q4": "EOF"}
    with pytest.raises(ValueError, match="BofProp, EofProp"):
        linked.own_properties('{"PronomProp": "x"}')
    rows = [("http://own/Q9", None, None, "http://own/entity/Q2", None, None, r, o, "4142", b) for r, o, b in (("http://own/entity/Q3", "0", True), ("http://own/entity/Q4", "7", False))]
    df = spark.createDataFrame(rows, "uri string, puid string, extension string, encoding string, referenceLabel string, date string, relativity string, offset string, sig string, offsetBlank boolean").selectExpr("*", "'n' as uriLabel", "null as mimetype")
    (r,) = linked.condense(df, encodings, relativities).collect()
    assert [(x.notation, x.relativity, x.offset) for x in r.signatures] == [("4142", "BOF", 0), ("4142", "EOF", 7)]
    assert ("Q9", "blank offset", False) in {tuple(x) for x in linked.lint(df, encodings, relativities).collect()}


def ole2(streams: dict[str, bytes]) -> bytes:
    """A small compound file; names with / lie in a storage."""
    free, end, fat_mark = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD
    storages = sorted({n.split("/")[0] for n in streams if "/" in n})
    entries = [["Root Entry", 5, free, free, free, end, 0]]
    place = {}
    for s in storages:
        place[s] = len(entries)
        entries.append([s, 1, free, free, free, 0, 0])
    body, sectors = [], 2  # sector 0: FAT, sector 1: directory (grows below)
    n_dir = (1 + len(storages) + len(streams) + 3) // 4
    fat = [fat_mark] + [i + 2 for i in range(n_dir - 1)] + [end]
    sectors = 1 + n_dir
    kids = {}
    for name, data in streams.items():
        data = data.ljust(4096, b"\0") if len(data) < 4096 else data
        n = (len(data) + 511) // 512
        entries.append([name.split("/")[-1], 2, free, free, free, sectors, len(data)])
        kids.setdefault(name.split("/")[0] if "/" in name else "", []).append(len(entries) - 1)
        fat += [sectors + i + 1 for i in range(n - 1)] + [end]
        body.append(data.ljust(n * 512, b"\0"))
        sectors += n
    kids.setdefault("", []).extend(place.values())
    for parent, items in kids.items():
        entries[place[parent] if parent else 0][4] = items[0]
        for a, b in zip(items, items[1:]):
            entries[a][3] = b
    folder = b"".join(n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBBIII", 2 * len(n) + 2, k, 1, left, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size) for n, k, left, right, child, start, size in entries)
    folder = folder.ljust(n_dir * 512, b"\0")
    head = archives.OLE2 + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, 1, 1, 0, 4096, end, 0, end, 0) + struct.pack("<109I", 0, *[free] * 108)
    return head + struct.pack("<128I", *fat, *[free] * (128 - len(fat))) + folder + b"".join(body)


def test_containers(spark):
    c = registry.add_containers(registry.from_droid(DROID), CONTAINERS)
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("mimetype", "application/x")
        f.writestr("content.xml", "<a/>")
    o = ole2({"Part1": b"one", "Store/Inner": b"two" * 2000})
    assert dict(archives.ole2_entries(o))["Store/Inner"] == b"two" * 2000
    df = held(spark, ("a.zip", "", z.getvalue()), ("b.doc", "", o), ("broken.zip", "", b"PK\x03\x04broken"), ("short", "", b"PK\x03\x04"))
    got = {r.path: r.basis for r in matchers.container_hits(df, [c]).collect()}
    assert got == {"a.zip": "container name mimetype with byte match; name content.xml with name only (signature 1/2)", "b.doc": "container name Part1 with name only (signature 2/2)"}
    assert {r.path for r in identify(df, [c]).where("errors like 'container error:%'").collect()} == {"broken.zip"}


def test_zip_default_and_archive_ids(spark):
    from dataclasses import replace

    c = replace(registry.add_containers(registry.from_droid(DROID), CONTAINERS), zip_default="x-fmt/263")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("other", "x")
    df = held(spark, ("a.zip", "", z.getvalue()), ("b.ZIP", "", z.getvalue()), ("c.zip", "", b"no archive at all"))
    for catalog in (c, Catalog("pronom", zip_default="x-fmt/263", globs=c.globs)):
        got = {r.path: (r.id, r.basis) for r in identify(df, [catalog]).collect()}
        assert got["a.zip"] == ("x-fmt/263", "container match with trigger and default extension") and got["b.ZIP"][0] == got["c.zip"][0] == "UNKNOWN"
    ids = spark.createDataFrame([(x,) for x in ("x-fmt/263", "application/x-tar", "application/gzip", "fdd000235", "application/x-warc", "")], "id string")
    kind = lambda text: [r.k for r in ids.select(archives.archive_class(F.col("id"), archives.chosen_kinds(text)).alias("k")).collect()]
    assert kind("all") == ["zip", "tar", "gzip", "arc", "warc", None]
    assert kind("TAR") == [None, "tar", None, None, None, None] and kind("gZip")[2] == "gzip" and kind("zip, arc") == ["zip", None, None, "arc", None, None]
    found = archives.identified_archives(df, identify(df, [c]), archives.chosen_kinds("zip"))
    assert [(r.path, r.kind) for r in found.collect()] == [("a.zip", "zip")]
    opened, _ = scan(df, [c], ScanOptions(expand=("zip",), by_id=True))
    assert {r.path for r in opened.collect()} == {"a.zip", "a.zip#other", "b.ZIP", "c.zip"}  # b.ZIP is an archive, but is not identified as one


def test_archives(spark):
    inner = gzip.compress(b"hello", mtime=0)
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w") as f:
        for name, data in (("d/a.txt", b"A"), ("b.txt.gz", inner)):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            f.addfile(info, io.BytesIO(data))
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("x.tar", t.getvalue())
    df = held(spark, ("top.zip", "", z.getvalue()), ("bad.gz", "", b"\x1f\x8bxx"), ("plain", "", b"text"))
    got = {r.path: (r.depth, r.error is None) for r in archives.expand(df).collect()}
    assert got["top.zip#x.tar#b.txt.gz#b.txt"] == (3, True) and got["top.zip#x.tar#d/a.txt"] == (2, True) and got["bad.gz#"] == (1, False) and len(got) == 8
    assert {r.path for r in archives.expand(df, ("gzip",)).collect()} == {"top.zip", "bad.gz", "plain", "bad.gz#"}
    assert {r.path for r in archives.expand(df, max_depth=1).collect()} == {"top.zip", "bad.gz", "plain", "bad.gz#", "top.zip#x.tar"}
    all_files, found = scan(df, [registry.from_droid(DROID)], ScanOptions(expand=("zip", "tar"), checksum="crc"))
    assert "hash" in all_files.columns and found.select("path").distinct().count() == 6


def test_results_layouts(spark):
    droid = '"ID","PARENT_ID","URI","FILE_PATH","NAME","METHOD","STATUS","SIZE","TYPE","EXT","LAST_MODIFIED","EXTENSION_MISMATCH","MD5_HASH","FORMAT_COUNT","PUID","MIME_TYPE","FORMAT_NAME","FORMAT_VERSION"\n"1","","u","/d","d","","Done","","Folder","","","false","","","","","",""\n"2","1","u","/d/a","a","Signature","Done","5","File","","2024-01-01T00:00:00","TRUE","ff","2","fmt/1","m","One","1","fmt/2","m","Two","2"\n"3","1","u","/d/b","b","","Done","0","File","","","false","","0","","","",""\n'
    texts = [
        ("csv", 'filename,filesize,modified,errors,md5,namespace,id,warning,namespace,id\n"a,1",5,2024,,ff,p,fmt/1,w,l,fdd1\n"a,1",5,2024,,ff,p,fmt/2,,,\nb,x,,bad,,p,UNKNOWN,,l,\n'),
        ("json", '{"signature":"s","files":[{"filename":"a\\nb","filesize":7,"modified":"m","errors":"","md5":"ff","matches":[{"ns":"p","id":"fmt/1"}]}]}'),
        ("yaml", "---\nsignature  : x\nidentifiers :\n  - name : 'p'\n---\nfilename : 'it''s'\nfilesize : 3\nmodified : m\nerrors   : ''\nmatches  :\n  - ns      : 'p'\n    id      : 'fmt/1'\n    warning : 'w: x'\n  - ns      : 'q'\n    id      : 'UNKNOWN'\n"),
        ("droid", droid),
        ("droid_list", "DROID 6\nInput: x\n/a,b/c,fmt/1\n/a,b/c,fmt/2\n/d,Unknown\n"),
        ("fido", "OK,10,fmt/1,One,sig,5,/a,m,signature\nOK,10,fmt/2,Two,sig,5,/a,None,signature\nKO,1,,,,3,/b,None,fail\n"),
        ("unknown", "???"),
    ]
    df = spark.createDataFrame(texts, "source string, text string")
    assert [results.layout(t) for _, t in texts] == [s for s, _ in texts]
    bad = [("cut", '{"files": ['), ("short", 'filename,filesize,modified,errors,namespace,id,basis\na,1\nb,2,,,p,fmt/1,\n')]
    told = {(r.source, r.filename): r.errors for r in results.parse(spark.createDataFrame(bad + texts[-1:], "source string, text string")).collect()}
    assert told["cut", ""].startswith("results file error") and told["short", "a"] == "results row error: 2 of 7 columns" and told["short", "b"] == "" and "layout" in told["unknown", ""]
    df = df.where("source != 'unknown'")
    got = {(r.source, r.filename): r for r in results.parse(df).collect()}
    ids = {k: [m.id for m in r.matches] for k, r in got.items()}
    assert ids == {("csv", "a,1"): ["fmt/1", "fdd1", "fmt/2"], ("csv", "b"): ["UNKNOWN", ""], ("json", "a\nb"): ["fmt/1"], ("yaml", "it's"): ["fmt/1", "UNKNOWN"], ("droid", "/d/a"): ["fmt/1", "fmt/2"], ("droid", "/d/b"): ["UNKNOWN"], ("droid_list", "/a,b/c"): ["fmt/1", "fmt/2"], ("droid_list", "/d"): ["UNKNOWN"], ("fido", "/a"): ["fmt/1", "fmt/2"], ("fido", "/b"): ["UNKNOWN"]}
    assert got["csv", "b"].filesize is None and got["csv", "b"].errors == "bad" and got["csv", "a,1"].hash == "ff" and got["yaml", "it's"].matches[0].warning == "w: x"
    assert got["droid", "/d/a"].matches[0].warning == "extension mismatch" and got["fido", "/a"].matches[1].mime == ""
    r = results.parse(df)
    assert R.keep(r, "unknown").count() == 4 and R.keep(r, "warning").count() == 3 and R.keep(r, "error").count() == 1 and R.keep(r, "ids", ["fmt/2"]).count() == 4


def test_written_results_read_back(spark, tmp_path):
    m = [("p", "fmt/1", "One", "1", "m/1", "byte match at 0, 4", ""), ("p", "fmt/2", "Two, \"2\"", "", "", "", "it's odd")]
    rows = [("s", 0, "a\nb \"q\"", 5, "2024-01-01T00:00:00Z", "", "", m), ("s", 1, "plain.txt", None, "", "bad", "", [])]
    df = spark.createDataFrame(rows, results.RESULTS)
    results.write_json(df, {"signature": "x", "identifiers": [{"name": "p"}]}, str(tmp_path / "json"))
    results.write_yaml(df.repartition(3), {"signature": "x"}, [("p", "d")], str(tmp_path / "yaml"))
    results.write_csv(df, ["p"], str(tmp_path / "csv"))
    yaml = results.yaml_head({"signature": "x"}, [("p", "d")]) + "".join(r.value for r in results.yaml_documents(df).orderBy("seq").collect())
    assert 'filename : "a\\nb \\"q\\""' in yaml
    whole = results.parse(spark.createDataFrame([("x", yaml)], "source string, text string"))
    for found in (whole, *(results.read(spark, str(tmp_path / k)) for k in ("json", "yaml", "csv"))):
        back = found.orderBy("filename").collect()
        assert [(r.filename, r.filesize, r.errors) for r in back] == [(r[2], r[3], r[5]) for r in rows]
        assert [tuple(x) for x in back[0].matches] == m
    droid = {(r.FILE_PATH, r.PUID): r for r in results.droid_rows(df).collect()}
    assert len(droid) == 3 and droid["plain.txt", None].FORMAT_COUNT == 0 and droid["plain.txt", None].STATUS == "bad"


def test_priorities_and_sets(spark):
    e = spark.createDataFrame([("clay", "brick"), ("brick", "wall"), ("brick", "oven"), ("wall", "house"), ("oven", "house"), ("house", "town"), ("town", "house")], "sub string, sup string")
    closed = priorities.closure(e)
    n = {r.sub: r["count"] for r in closed.groupBy("sub").count().collect()}
    assert n == {"clay": 5, "brick": 4, "wall": 2, "oven": 2, "house": 1, "town": 1}
    hits = spark.createDataFrame([(1, x) for x in ("clay", "wall", "oven")] + [(2, "brick"), (2, "town")], "grp int, id string")
    assert {tuple(r) for r in priorities.apply(hits, closed).collect()} == {(1, "wall"), (1, "oven"), (2, "town")}
    kept = priorities.induced(closed, spark.createDataFrame([("clay",), ("wall",), ("town",)], "id string"))
    assert {tuple(r) for r in kept.collect()} == {("clay", "wall"), ("clay", "town"), ("wall", "town")}
    ids = spark.createDataFrame([(x,) for x in ("x-fmt/3", "fmt/95", "fdd1", "fmt/2", "fmt/354", "x-fmt/20")], "id string")
    assert [r.id for r in ids.orderBy(*priorities.format_order("id")).collect()] == ["fmt/2", "fmt/95", "fmt/354", "x-fmt/3", "x-fmt/20", "fdd1"]


def test_sets_files(spark, tmp_path):
    import json

    (tmp_path / "a.json").write_text(json.dumps({"wood": ["oak", "ash tree", "@fruit"], "fruit": ["pear", "@wood"]}))
    (tmp_path / "b.json").write_text(json.dumps({"stone": ["flint", "@gems"]}))
    sets = priorities.read_sets(spark, str(tmp_path))
    assert {tuple(r) for r in priorities.expand_sets(sets, ["wood"]).collect()} == {("wood", m) for m in ("oak", "ash", "pear")}
    for wanted in (["stone"], ["paper"]):
        with pytest.raises(ValueError, match="unknown sets: (gems|paper)"):
            priorities.expand_sets(sets, wanted)


def test_releases(spark, tmp_path):
    note = '<release_note><release_date>{d}</release_date><release_outline type="{k}"><format><puid type="fmt">{p}</puid></format><format><puid type="fmt">9</puid></format></release_outline></release_note>'
    (tmp_path / "n.xml").write_text("<release_notes>" + note.format(d="1 January 2010", k="new", p=1) + note.format(d="5 May 2010", k="updated", p=2) + note.format(d="6 May 2011", k="signatures", p=3) + "</release_notes>")
    notes = registry.read_releases(spark, str(tmp_path / "n.xml"))
    assert {tuple(r) for r in registry.release_stats(notes).collect()} == {("2010", 2, 2, 2, 0), ("2011", 1, 0, 0, 2)}
    assert {r.set: r.members for r in registry.release_sets(notes).collect()}["1 January 2010 new"] == ["fmt/1", "fmt/9"]


def test_checksums(spark):
    import hashlib
    import zlib

    df = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b""),)], "c binary")
    for kind in ("md5", "sha1", "sha256", "sha512"):
        assert [r.h for r in df.select(scalars.checksum(F.col("c"), kind).alias("h")).collect()] == [hashlib.new(kind, b).hexdigest() for b in (b"abc", b"")]
    assert [r.h for r in df.select(scalars.checksum(F.col("c"), "crc").alias("h")).collect()] == [f"{zlib.crc32(b):08x}" for b in (b"abc", b"")]


def test_text_classes(spark):
    runes = "зелёный лес".encode()
    cases = {b"\x00\x01\x32\xff": "data", runes: "UTF-8 Unicode", b"hello world": "ASCII", b"\xef\xbb\xbfhi": "UTF-8 Unicode (with BOM)", b"\xff\xfeh\0": "UTF-16 Little Endian", b"\xfe\xff\0h": "UTF-16 Big Endian", b"": "data", b"caf\xe9": "ISO-8859-1", b"caf\x80 x": "extended", b"+/v8-": "UTF-7 Unicode", b"x" * 4095 + "é".encode(): "UTF-8 Unicode", b"a\tb\r\n\x1b[0m": "ASCII"}
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, c binary")
    assert [r.k for r in df.orderBy("i").select(scalars.text_class(F.col("c")).alias("k")).collect()] == list(cases.values())


def test_xml_roots(spark):
    c = Catalog("x", xmls=[("x", "0", "plan", ""), ("x", "1", "plan", "urn:house"), ("x", "2", "", "urn:feed")])
    df = held(spark, ("a", "", b"plain words"), ("b", "", b"<plan>rooms"), ("c", "", b"<plan xmlns='urn:house'>"), ("d", "", b"<item xmlns='urn:feed'>"), ("e", "", b"<\xff\xfe"), ("f", "", "\ufeff<?xml?><plan xmlns='urn:house'/>".encode("utf-16-le")), ("g", "", "<h:plan xmlns:h='urn:house'>".encode("utf-16-be")))
    got = {}
    for r in matchers.xml_hits(df, [c]).orderBy("path", "phase").collect():
        got.setdefault(r.path, []).append(r.id)
    assert got == {"b": ["0"], "c": ["1", "0"], "d": ["2"], "f": ["1", "0"], "g": ["1", "0"]}


def test_globs():
    import re

    ok = lambda g, s: re.search(matchers.glob_regex(g).replace("\\z", "\\Z"), s) is not None
    assert ok("*.wav", "apple.wav") and not ok("*.wav", "apple.wave") and ok("READ??", "README") and ok("[a-c]*", "bx") and not ok("[^a-c]*", "bx")
    assert ok("a\\*b", "a*b") and not ok("a\\*b", "axb") and not ok("[a", "[a") and not ok("*", "a/b")


def test_files_and_stream(spark, pictures, tmp_path):
    d = tmp_path / "in" / "deep"
    d.mkdir(parents=True)
    (d / "a.png").write_bytes(PNG)
    (tmp_path / "in" / "b.gif").write_bytes(GIF)
    (tmp_path / "in" / "empty").write_bytes(b"")
    assert files.scan(spark, str(tmp_path / "in"), empty=True).count() == 3 and files.scan(spark, str(tmp_path / "in"), recurse=False).count() == 1
    assert files.scan(spark, str(tmp_path / "in"), glob="*.png").count() == 1
    assert files.scan(spark, str(tmp_path / "in"), empty=True).where("error = 'empty source'").count() == 1
    (tmp_path / "list.txt").write_text(f"{d}/a.png\n\n")
    assert files.listed(spark, str(tmp_path / "list.txt")).count() == 1
    assert files.single(spark, "x.png", PNG).first().length == len(PNG)
    listed = spark.createDataFrame([(str(d / "a.png"),), (f"file://{d}/none",), (str(d),), (f"file:{tmp_path}/in/empty",)], "path string")
    told = {r.path.rsplit("/", 1)[-1]: (r.error, r.content and bytes(r.content)) for r in files.read_listed(listed).collect()}
    assert told == {"a.png": (None, PNG), "none": ("no such file", None), "deep": ("not a regular file", None), "empty": ("empty source", b"")}
    q = identify_stream(arriving(spark, str(tmp_path / "in")), [pictures], str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r.path.rsplit("/", 1)[-1]: r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"b.gif": "fmt/4"}
