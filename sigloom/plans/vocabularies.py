"""Queries on catalogues built from small vocabularies written here; the SQL twins state the results that follow from them by hand."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions import scalars
from sigloom.operators import priorities
from sigloom.session import shared_path
from sigloom.session import table as T
from sigloom.sources import library, linked, mimeinfo, registry
from sigloom.sources.catalog import Catalog

DROID = """<FFSignatureFile><InternalSignatureCollection>
<InternalSignature ID="1"><ByteSequence Reference="BOFoffset"><SubSequence Position="1" SubSeqMinOffset="0" SubSeqMaxOffset="0"><Sequence>89504E47</Sequence></SubSequence></ByteSequence>
<ByteSequence Reference="EOFoffset"><SubSequence Position="1" SubSeqMinOffset="0" SubSeqMaxOffset="4"><Sequence>AE4260</Sequence><RightFragment Position="1" MinOffset="0" MaxOffset="0">82</RightFragment></SubSequence></ByteSequence></InternalSignature>
<InternalSignature ID="2"><ByteSequence Reference="BOFoffset"><SubSequence Position="1" SubSeqMinOffset="0" SubSeqMaxOffset="0"><Sequence>89504E47</Sequence></SubSequence><SubSequence Position="2" SubSeqMinOffset="2"><Sequence>6163544C</Sequence><LeftFragment Position="1" MinOffset="1" MaxOffset="1">00</LeftFragment></SubSequence></ByteSequence></InternalSignature>
<InternalSignature ID="3"><ByteSequence Reference="Variable"><SubSequence Position="1"><Sequence>3C68746D6C</Sequence></SubSequence></ByteSequence></InternalSignature>
</InternalSignatureCollection><FileFormatCollection>
<FileFormat ID="11" Name="Picture" PUID="fmt/1" Version="1.0" MIMEType="image/x-a, image/x-b"><InternalSignatureID>1</InternalSignatureID><Extension>png</Extension></FileFormat>
<FileFormat ID="12" Name="Moving picture" PUID="fmt/2" MIMEType="image/x-c"><InternalSignatureID>2</InternalSignatureID><Extension>PNG</Extension><HasPriorityOverFileFormatID>11</HasPriorityOverFileFormatID></FileFormat>
<FileFormat ID="13" Name="Page" PUID="fmt/3"><InternalSignatureID>3</InternalSignatureID><Extension>html</Extension></FileFormat>
<FileFormat ID="14" Name="Package" PUID="fmt/4"><Extension>pkg</Extension><HasPriorityOverFileFormatID>12</HasPriorityOverFileFormatID></FileFormat>
</FileFormatCollection></FFSignatureFile>"""

CONTAINERS = """<ContainerSignatureMapping><ContainerSignatures>
<ContainerSignature Id="100" ContainerType="ZIP"><Files><File><Path>mimetype</Path><BinarySignatures><InternalSignatureCollection><InternalSignature><ByteSequence Reference="BOFoffset"><SubSequence Position="1" SubSeqMinOffset="0" SubSeqMaxOffset="0"><Sequence>'app'</Sequence></SubSequence></ByteSequence></InternalSignature></InternalSignatureCollection></BinarySignatures></File><File><Path>content.xml</Path></File></Files></ContainerSignature>
<ContainerSignature Id="101" ContainerType="OLE2"><Files><File><Path>Part?</Path></File></Files></ContainerSignature>
</ContainerSignatures><FileFormatMappings><FileFormatMapping signatureId="100" Puid="fmt/4"/><FileFormatMapping signatureId="101" Puid="fmt/4"/></FileFormatMappings></ContainerSignatureMapping>"""

MIMEINFO = """<mime-info>
<mime-type type="text/plain"><comment>plain text</comment><glob pattern="*.txt"/></mime-type>
<mime-type type="application/xml"><comment>XML</comment><magic priority="40"><match value="&lt;?xml" type="string" offset="0"/></magic><glob pattern="*.xml"/><alias type="text/xml"/><sub-class-of type="text/plain"/></mime-type>
<mime-type type="image/svg+xml"><comment>SVG</comment><sub-class-of type="application/xml"/><sub-class-of type="text/plain"/><root-XML namespaceURI="http://www.w3.org/2000/svg" localName="svg"/><glob pattern="*.svg" weight="60"/></mime-type>
<mime-type type="application/x-demo"><magic><match value="0x1234" type="big16" offset="0"><match value="\\x41b" type="string" offset="2:4"/><match value="7" type="byte" offset="9" mask="0x0f"/></match></magic><glob pattern="README*"/></mime-type>
<mime-type type="application/x-regex"><magic><match value="a.*b" type="regex" offset="0"/></magic></mime-type>
</mime-info>"""

LIBRARY = [
    '<FDD id="fdd1" shortName="WAVE" titleName="Wave audio"><date>2012-01-02</date><date>2015-06-07</date><filenameExtension><sigValue>WAV</sigValue></filenameExtension><internetMediaType><sigValue>audio/wav</sigValue></internetMediaType><magicNumbers><sigValue>Hex: 52 49 46 46 xx xx xx xx 57 41 56 45 66 6D 74 20</sigValue><sigValue>ASCII: RIFF</sigValue></magicNumbers><other><tag>Microsoft FOURCC</tag><values><sigValue>fmt </sigValue><sigValue>toolong</sigValue></values></other><urlReference>http://www.nationalarchives.gov.uk/PRONOM/fmt/1</urlReference></FDD>',
    '<FDD id="fdd2" shortName="BWF"><date>2011-01-01</date><magicNumbers><sigValue>ASCII: msid</sigValue></magicNumbers><relationship><typeOfRelationship>Subtype of</typeOfRelationship><relatedTo><id>fdd1</id></relatedTo></relationship></FDD>',
    '<FDD id="fdd3" shortName="MPEG"><magicNumbers><sigValue>00 00 01 Bx</sigValue></magicNumbers></FDD>',
]

BINDINGS = [
    # uri, name, puid, extension, mimetype, encoding, reference, date, relativity, offset, sig
    ("http://x/Q1", "One", "fmt/1", "ONE", "a/one", "http://x/Q82828", "Source", "2020-01-01T00:00:00Z", "http://x/Q35436009", "0", "41 42"),
    ("http://x/Q1", "One", "fmt/2", "one", "a/one", "http://x/Q82828", "Source", "2020-01-01T00:00:00Z", "http://x/Q1148480", "0", "5A"),
    ("http://x/Q2", "Two", None, "two", None, "http://x/Q8815", None, None, "http://x/Q35436009", "4", "magic"),
    ("http://x/Q3", "Three", None, None, "a/three", "http://x/Q98056564", "Source", "no date", None, "-1", "ab.{4}cd"),
    ("http://x/Q4", "Four", "fmt/9", None, None, "http://x/Q5532625", "Source", None, "http://x/Q77", None, "{0000}"),
    ("http://x/Q6", "Six", None, "six", None, "http://x/Q82828", "Source", "2020-01-01", "http://x/Q1148480", "0", "61"),
    ("http://x/Q6", "Six", None, "six", None, "http://x/Q82828", "Source", "2020-01-01", "http://x/Q1148480", "2", "62"),
    ("http://x/Q7", "Seven", None, None, None, "http://x/Q82828", "", "2020-01-01", None, "x", "0x71"),
    ("http://x/Q7", "Seven", None, None, None, "http://x/Q82828", "Source", None, None, "1", "72"),
    ("http://x/Q7", "Seven", None, None, None, "http://x/Q82828", "Source", None, None, "1", "\\x73"),
    ("http://x/Q8", "Eight", None, None, None, "http://x/Q82828", "Source", "2020", "http://x/Q35436009", "1", "81"),
    ("http://x/Q8", "Eight", None, None, None, "http://x/Q8815", "Source", "2020", "http://x/Q1148480", "1", "end"),
    ("http://x/Q5", "Five", "fmt/5", "five", None, None, None, None, None, None, None),
]
COLUMNS = "uri string, uriLabel string, puid string, extension string, mimetype string, encoding string, referenceLabel string, date string, relativity string, offset string, sig string"

INLINE_SETS = [("t", "a"), ("t", "a"), ("t", "b first"), ("t", "c"), ("u", "b"), ("u", "d"), ("v", "@t"), ("v", "@u"), ("w", "@x"), ("x", "@w"), ("x", "z")]
NAMES = ["LICENSE", "\\\\share\\scans\\page.TIF", "d:\\music\\Track 1.Flac", "reports/2024/summary.final.ODT", "https://files.example.org/get/plan.dwg?rev=7 10.0.0.1", "http://example.net/pages/index.xhtml#top", "/store/b.warc#20240102030405/http://example.com/img/logo.svg?x=1", "/store/what?.csv", "a/.hidden/", "", "no.dot.at.end."]
CHAIN = [("ore", "iron"), ("iron", "steel"), ("steel", "blade"), ("blade", "steel"), ("iron", "rust"), ("rust", "dust"), ("ore", "ore"), ("", "dust"), ("steel", "rust")]


def droid() -> Catalog:
    return registry.add_containers(registry.from_droid(DROID), CONTAINERS)


def shown(c: Catalog, relation: str, *keep: int):
    """Rows of a relation as texts joined by |."""

    def query(s, d) -> DataFrame:
        rows = [("|".join(str(r[i]) for i in (keep or range(len(r)))),) for r in c.rows(relation)]
        return s.createDataFrame(rows, "row string")

    return query


def _documents():
    import xml.etree.ElementTree as ET

    return [ET.fromstring(d) for d in LIBRARY]


def implicit(s, d) -> DataFrame:
    """Which names of formats, and first words of names, lie inside others, taken as byte signatures of the formats."""
    from sigloom.functions.frames import BOF, Frame, Signature
    from sigloom.functions.patterns import Seq

    names = T(s, d, "format_registry").select("ident_id", F.trim("format_name").alias("name")).where("ident_id is not null and name != ''").distinct().collect()
    held = {(r.ident_id, r["name"]) for r in names} | {("w/" + r["name"].split(" ")[0], r["name"].split(" ")[0]) for r in names}
    c = Catalog("p", signatures=[("p", i, Signature((Frame(Seq(t.encode()), BOF, 0, None),)), 0) for i, t in sorted(held)])
    return s.createDataFrame([(f"{a}|{b}",) for _, a, b in c.implicit_priorities()], "row string")


def bindings(s) -> DataFrame:
    return s.createDataFrame(BINDINGS, COLUMNS)


def linked_read(s, d) -> DataFrame:
    """The bindings as a SPARQL result in JSON, written and read again, condensed."""
    cells = [{n: {"type": "literal", "value": v} for n, v in zip(linked.VARIABLES, r) if v is not None} for r in BINDINGS]
    path = shared_path(s, "bindings")
    s.createDataFrame([(json.dumps({"results": {"bindings": cells}}),)], "value string").coalesce(1).write.text(path)
    return records(linked.read_bindings(s, path))


def records(found: DataFrame) -> DataFrame:
    sig = F.transform("signatures", lambda x: F.concat(F.coalesce(x["notation"], F.lit("-")), F.lit("@"), x["relativity"], x["offset"].cast("string")))
    return linked.condense(found).select("uri", "name", F.array_join("puids", ",").alias("puids"), F.array_join("extensions", ",").alias("extensions"), F.array_join(sig, ",").alias("signatures"))


def _rows(values):
    return lambda s, d: s.createDataFrame([(v,) for v in values()], "row string")


def matches_of(c: Catalog, samples: list[bytes]):
    """Which formats of a catalogue each sample has, by its byte signatures: i:id."""

    def query(s, d):
        from sigloom.operators.matchers import byte_hits

        files = s.createDataFrame([(str(i), bytearray(b)) for i, b in enumerate(samples)], "path string, content binary")
        return byte_hits(files, [c]).select(F.concat_ws(":", "path", "id").alias("row")).distinct()

    return query


PICTURES = [bytes.fromhex("89504E470102AE426082"), bytes.fromhex("89504E47010000AA6163544C"), bytes.fromhex("00") + b"..<html>", bytes.fromhex("89504E47AE42608200"), b"x" * 20]
SOUNDS = [b"RIFF....WAVEfmt rest", b"RIFF....WAVEfmx rest", b"msid", bytes.fromhex("000001B7"), bytes.fromhex("000001C7")]
DEMOS = [bytes.fromhex("1234") + b"Ab", bytes.fromhex("1234") + b"..Ab", bytes.fromhex("1234") + b"......." + b"\x17", bytes.fromhex("1234") + b"x" * 9, b"<?xml "]


def queries():
    d, m = droid(), mimeinfo.from_mimeinfo(MIMEINFO)
    lib = library.from_library(_documents(), registry=d)
    return {
        "droid_priorities": shown(d, "priorities", 1, 2),
        "droid_globs": shown(d, "globs", 1, 3),
        "droid_signatures": matches_of(d, PICTURES),
        "container_rows": shown(d, "parts", 1, 2, 3, 4, 5, 6),
        "doubles_filter": shown(Catalog("p", containers=[("p", "a")], signatures=[("p", "a", s, 0) for _, _, s, _ in d.signatures[:1]] + [("p", "b", s, 0) for _, _, s, _ in d.signatures]).no_doubles(), "byte_sigs", 1, 2, 3),
        "catalog_join": _rows(lambda: sorted(i for _, i in d.join(Catalog("pronom", infos=[("pronom", "fmt/1", "Other", "", "", ""), ("pronom", "fmt/7", "New", "", "", "")])).ids())),
        "catalog_limit": shown(d.limit(["fmt/1", "fmt/2"]), "priorities", 1, 2),
        "catalog_exclude": _rows(lambda: sorted(i for _, i in d.exclude(["fmt/2"]).ids())),
        "implicit_priorities": implicit,
        "mimeinfo_magic": shown(m, "byte_sigs", 1, 2, 3, 9),
        "mimeinfo_globs": shown(m, "globs", 1, 2, 3, 5),
        "mimeinfo_matches": matches_of(m, DEMOS),
        "library_matches": matches_of(library.from_library(_documents()), SOUNDS),
        "library_priorities": shown(lib, "priorities", 1, 2),
        "library_borrowed": _rows(lambda: sorted({i for _, i, _, _ in lib.signatures})),
        "linked_records": lambda s, _: records(bindings(s)),
        "linked_read": linked_read,
        "linked_lint": lambda s, _: linked.lint(bindings(s)),
        "linked_summary": lambda s, _: linked.summary(linked.condense(bindings(s)), linked.lint(bindings(s))),
        "sets_inline": lambda s, _: priorities.expand_sets(s.createDataFrame(INLINE_SETS, "set string, member string"), ["v", "x"]),
        "names_inline": lambda s, _: s.createDataFrame([(n,) for n in NAMES], "name string").select("name", scalars.base_name(F.col("name")).alias("base"), scalars.extension(scalars.base_name(F.col("name"))).alias("ext")),
        "closure_inline": lambda s, _: priorities.closure(s.createDataFrame(CHAIN, "sub string, sup string")),
    }


def _values(*rows: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("('" + r.replace("'", "''") + "')" for r in rows) + ") AS v(row)"


def _list(rows: list) -> str:
    """Texts or tuples of texts as an SQL VALUES list."""
    quote = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, [r] if isinstance(r, str) else r)) + ")" for r in rows)


_LINKED = rf"""v AS (SELECT * FROM (VALUES {_list(BINDINGS)}) AS v(uri, name, puid, extension, mimetype, encoding, reference, date, relativity, "offset", sig)),
    e AS (SELECT *, regexp_extract(uri, '[^/]*$') AS id, CASE regexp_extract(encoding, '[^/]*$') WHEN 'Q82828' THEN 'hexadecimal' WHEN 'Q98056596' THEN 'hexadecimal' WHEN 'Q8815' THEN 'ascii' WHEN 'Q5532625' THEN 'guid' WHEN 'Q98056564' THEN 'perl' WHEN 'Q35432091' THEN 'pronom' ELSE 'unknown' END AS enc,
      CASE WHEN relativity IS NULL THEN 'BOF' WHEN relativity LIKE '%Q35436009' THEN 'BOF' WHEN relativity LIKE '%Q1148480' THEN 'EOF' END AS rel, regexp_replace(regexp_replace(sig, '\s', '', 'g'), '\\x|0x', '', 'g') AS bare FROM v),
    b AS (SELECT *, CASE enc WHEN 'guid' THEN NULL WHEN 'pronom' THEN sig WHEN 'ascii' THEN hex(encode(sig)) WHEN 'perl' THEN upper(regexp_replace(regexp_replace(regexp_replace(sig, '\\x', '', 'g'), '\.\{{(\d+)\}}', '{{\1}}', 'g'), '\s', '', 'g')) ELSE CASE WHEN regexp_full_match(bare, '([0-9A-Fa-f]{{2}})+') THEN upper(bare) END END AS notation FROM e),
    n AS (SELECT id, count(DISTINCT [sig, coalesce("offset", ''), coalesce(encoding, ''), coalesce(relativity, '')]) AS n, count(DISTINCT relativity) AS places, count(DISTINCT sig) AS sigs, count(DISTINCT coalesce(encoding, '')) AS encodings, count(DISTINCT enc) AS encs, count(DISTINCT rel) AS sides,
      count(DISTINCT [sig, coalesce("offset", ''), coalesce(encoding, ''), relativity]) FILTER (WHERE relativity IS NOT NULL) AS stated, bool_or(rel IS NULL OR notation IS NULL) AS broken, count(DISTINCT CASE WHEN rel = 'EOF' THEN notation END) AS ends FROM b WHERE sig IS NOT NULL GROUP BY id),
    sound AS (SELECT id, NOT broken AND (n = 2 AND (places = 2 OR sigs = 2) OR (n <= 2 OR encodings = 1 AND places <= 1) AND (stated = 0 OR stated = n)) AND ends <= 1 AND NOT (sides = 2 AND encs > 1) AS sound FROM n),
    s AS (SELECT b.*, sound FROM b JOIN sound USING (id) WHERE sig IS NOT NULL),
    lint AS (SELECT id AS uri, 'no encoding' AS code, false AS critical FROM s WHERE sound AND enc = 'unknown' UNION ALL SELECT id, 'no relativity', false FROM s WHERE sound AND relativity IS NULL UNION ALL SELECT id, 'bad offset', false FROM s WHERE sound AND "offset" IS NOT NULL AND try_cast("offset" AS INTEGER) IS NULL
      UNION ALL SELECT id, 'no offset', false FROM s WHERE sound AND "offset" IS NULL UNION ALL SELECT id, 'no provenance', false FROM s WHERE sound AND coalesce(reference, '') = '' UNION ALL SELECT id, 'no provenance date', false FROM s WHERE sound AND coalesce(date, '') = ''
      UNION ALL SELECT id, 'bad heuristic', true FROM s WHERE NOT sound UNION ALL SELECT id, 'unknown relativity', false FROM s WHERE NOT sound AND rel IS NULL UNION ALL SELECT id, 'bad sequence', false FROM s WHERE NOT sound AND notation IS NULL)"""


def oracle_sql():
    out = {
        "droid_priorities": _values("fmt/1|fmt/2", "fmt/1|fmt/4", "fmt/2|fmt/4"),
        "droid_globs": _values("fmt/1|png", "fmt/2|png", "fmt/3|html", "fmt/4|pkg"),
        "droid_signatures": _values("0:fmt/1", "1:fmt/2", "2:fmt/3", "3:fmt/1"),
        "container_rows": _values("fmt/4|ZIP|1|1|mimetype|False", "fmt/4|ZIP|1|2|content.xml|False", "fmt/4|OLE2|2|1|Part?|True"),
        "doubles_filter": _values("b|1|3", "b|2|3", "b|3|3"),
        "catalog_join": _values("fmt/1", "fmt/2", "fmt/3", "fmt/4", "fmt/7"),
        "catalog_limit": _values("fmt/1|fmt/2"),
        "catalog_exclude": _values("fmt/1", "fmt/3", "fmt/4"),
        "implicit_priorities": """WITH n AS (SELECT ident_id AS id, trim(format_name) AS lit FROM format_registry WHERE ident_id IS NOT NULL AND trim(format_name) != ''), l AS (SELECT * FROM n UNION SELECT 'w/' || split_part(lit, ' ', 1), split_part(lit, ' ', 1) FROM n)
            SELECT DISTINCT a.id || '|' || b.id AS row FROM l a JOIN l b ON contains(b.lit, a.lit) AND a.lit != b.lit AND a.id != b.id""",
        "mimeinfo_magic": _values("application/x-demo|1|2|50", "application/x-demo|2|2|50", "application/xml|1|1|40", "image/svg+xml|1|1|39"),
        "mimeinfo_globs": _values("text/plain|ext|txt|50", "application/xml|ext|xml|50", "image/svg+xml|ext|svg|60", "application/x-demo|glob|README*|50"),
        "mimeinfo_matches": _values("0:application/x-demo", "1:application/x-demo", "2:application/x-demo", "4:application/xml", "4:image/svg+xml"),
        "library_matches": _values("0:fdd1", "2:fdd2", "3:fdd3"),
        "library_priorities": _values("fdd1|fdd2"),
        "library_borrowed": _values("fdd1", "fdd2", "fdd3"),
        "linked_records": f"""WITH {_LINKED} SELECT b.id AS uri, max(name) AS name, coalesce(array_to_string(list_sort(list(DISTINCT puid)), ','), '') AS puids, coalesce(array_to_string(list_sort(list(DISTINCT lower(extension))), ','), '') AS extensions,
            coalesce(array_to_string(list_transform(list_sort(list(DISTINCT [notation, rel, coalesce(CAST(try_cast("offset" AS INTEGER) AS VARCHAR), '0'), coalesce(reference, ''), coalesce(date, '')]) FILTER (WHERE sig IS NOT NULL AND sound)), lambda x: x[1] || '@' || x[2] || x[3]), ','), '') AS signatures FROM b LEFT JOIN sound USING (id) GROUP BY b.id""",
        "linked_lint": f"WITH {_LINKED} SELECT DISTINCT * FROM lint",
        "linked_summary": f"""WITH {_LINKED}, r AS (SELECT b.id, count(DISTINCT puid) AS p, count(extension) AS e, count(mimetype) AS m, bool_or(coalesce(sound, false)) AS s FROM b LEFT JOIN sound USING (id) GROUP BY b.id), l AS (SELECT DISTINCT * FROM lint)
            SELECT count(*) AS n_records, count(*) FILTER (WHERE p > 0) AS with_puid, count(*) FILTER (WHERE e > 0) AS with_extension, count(*) FILTER (WHERE m > 0) AS with_mime, count(*) FILTER (WHERE s) AS with_signature, count(*) FILTER (WHERE p > 1) AS with_several_puids,
              (SELECT count(*) FROM l) AS n_findings, (SELECT count(*) FILTER (WHERE critical) FROM l) AS n_critical FROM r""",
        "sets_inline": f"""WITH RECURSIVE m AS (SELECT set, regexp_extract(member, '^\\s*(\\S+)', 1) AS member FROM (VALUES {_list(INLINE_SETS)}) AS v(set, member)), up AS (SELECT set, member FROM m WHERE set IN ('v', 'x') UNION SELECT up.set, m.member FROM up JOIN m ON up.member = '@' || m.set)
            SELECT set, member FROM up WHERE NOT starts_with(member, '@')""",
        "names_inline": rf"""WITH n AS (SELECT * FROM (VALUES {_list(NAMES)}) AS v(name)), p AS (SELECT name, CASE WHEN regexp_matches(name, '(^|[/#])https?://') THEN regexp_extract(name, '(?:^|[/#])https?://[^/?#]*([^?#]*)', 1) ELSE name END AS path FROM n),
            b AS (SELECT name, regexp_extract(regexp_replace(path, '[/\\]+$', ''), '[^/\\]*$') AS base FROM p) SELECT name, base, lower(regexp_extract(base, '\.([^.]*)$', 1)) AS ext FROM b""",
        "closure_inline": f"""WITH RECURSIVE e AS (SELECT DISTINCT sub, sup FROM (VALUES {_list(CHAIN)}) AS v(sub, sup) WHERE sub != sup AND sub != '' AND sup != ''),
            up AS (SELECT sub, sup FROM e UNION SELECT up.sub, e.sup FROM up JOIN e ON up.sup = e.sub) SELECT sub, sup FROM up WHERE sub != sup""",
    }
    return out | {"linked_read": out["linked_records"]}
