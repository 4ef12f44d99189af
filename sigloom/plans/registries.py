"""Queries on catalogues built from the whole format registry: it is told as a signature file, as MIME-info and as library descriptions,
these are read as any such file, and the catalogues are matched against the documents. The SQL twins start from the registry itself."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators import matchers
from sigloom.plans.identification import doc_files
from sigloom.session import shared_path
from sigloom.session import table as T
from sigloom.sources import library, mimeinfo, registry
from sigloom.sources.catalog import Catalog


def formats(s, d, ns: str) -> list:
    """The formats of a namespace, by id: (number from 0, id, name, MIME type, extensions, class)."""
    rows = T(s, d, "format_registry").where((F.col("ns") == ns) & F.col("ident_id").isNotNull()).orderBy("ident_id").collect()
    return [(k, r.ident_id, (r.format_name or "").strip(), (r.mime_type or "").strip(), [e for e in r.exts or [] if e], r.format_class) for k, r in enumerate(rows)]


def droid_file(s, d) -> str:
    """A signature file: the name of each format as its signature anywhere; of every five formats the second to fourth have priority over the one before."""
    fs = formats(s, d, "pronom")
    one = '<InternalSignature ID="{0}"><ByteSequence Reference="Variable"><SubSequence Position="1"><Sequence>{1}</Sequence></SubSequence></ByteSequence></InternalSignature>'
    sigs = "".join(one.format(k, name.encode().hex().upper()) for k, _, name, _, _, _ in fs if name)
    kids = lambda k, name, exts: (f"<InternalSignatureID>{k}</InternalSignatureID>" if name else "") + "".join(f"<Extension>{escape(e)}</Extension>" for e in exts) + (f"<HasPriorityOverFileFormatID>{k - 1}</HasPriorityOverFileFormatID>" if k % 5 in (1, 2, 3) else "")
    body = "".join(f'<FileFormat ID="{k}" Name={quoteattr(name)} PUID={quoteattr(i)} MIMEType={quoteattr(mime)}>{kids(k, name, exts)}</FileFormat>' for k, i, name, mime, exts, _ in fs)
    return f"<FFSignatureFile><InternalSignatureCollection>{sigs}</InternalSignatureCollection><FileFormatCollection>{body}</FileFormatCollection></FFSignatureFile>"


def mime_file(s, d) -> str:
    """A MIME-info file: a glob per extension, the first word of the name as magic in the first 200 bytes; every fourth type's next one inherits from it."""
    fs = formats(s, d, "tika")
    parent = lambda k: f'<sub-class-of type={quoteattr(fs[k - 1][1])}/>' if k % 4 == 1 else ""
    magic = lambda name: f'<magic priority="50"><match value={quoteattr(name.split(" ")[0])} type="string" offset="0:200"/></magic>' if name else ""
    globs = lambda k, exts: "".join(f'<glob pattern={quoteattr("*." + e)} weight="{40 + k % 3 * 10}"/>' for e in exts)
    return "<mime-info>" + "".join(f"<mime-type type={quoteattr(i)}><comment>{escape(name)}</comment>{magic(name)}{globs(k, exts)}{parent(k)}</mime-type>" for k, i, name, _, exts, _ in fs) + "</mime-info>"


def library_documents(s, d) -> list[ET.Element]:
    """Library descriptions: the first two letters of the name as magic; every third's next one is a subtype of it, every second links to a registry format."""
    fs, linked = formats(s, d, "loc"), formats(s, d, "pronom")
    sig = lambda tag, v: f"<{tag}><sigValue>{escape(v)}</sigValue></{tag}>" if v else ""
    below = lambda k: f"<relationship><typeOfRelationship>Subtype of</typeOfRelationship><relatedTo><id>{escape(fs[k - 1][1])}</id></relatedTo></relationship>" if k % 3 == 1 else ""
    link = lambda k: f"<urlReference>http://example.org/{linked[k][1]}</urlReference>" if k % 2 == 0 else ""
    return [ET.fromstring(f"<FDD id={quoteattr(i)} shortName={quoteattr(name)}>{''.join(sig('filenameExtension', e) for e in exts)}{sig('internetMediaType', mime)}{sig('magicNumbers', 'ASCII: ' + name[:2])}{below(k)}{link(k)}</FDD>") for k, i, name, mime, exts, _ in fs]


def reports_read(s, d) -> DataFrame:
    """Format reports written as XML and read again: puid, name, version, exts, mimes."""
    r = T(s, d, "format_registry").where("ns = 'pronom' and ident_id is not null")
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    ident = lambda c, kind: F.concat(F.lit("<FormatIdentifier><Identifier>"), safe(c), F.lit(f"</Identifier><IdentifierType>{kind}</IdentifierType></FormatIdentifier>"))
    exts = F.array_join(F.transform("exts", lambda e: F.concat(F.lit("<ExternalSignature><Signature>"), safe(e), F.lit("</Signature><SignatureType>File extension</SignatureType></ExternalSignature>"))), "")
    xml = F.concat(F.lit("<FileFormat><FormatName>"), safe(F.col("format_name")), F.lit("</FormatName><FormatVersion>"), safe(F.col("format_version")), F.lit("</FormatVersion>"), ident(F.col("ident_id"), "PUID"), F.coalesce(ident(F.nullif("mime_type", F.lit("")), "MIME"), F.lit("")), F.coalesce(exts, F.lit("")), F.lit("</FileFormat>"))
    path = shared_path(s, "reports")
    r.groupBy(F.pmod(F.xxhash64("ident_id"), F.lit(20))).agg(F.concat(F.lit("<reports>"), F.array_join(F.collect_list(xml), ""), F.lit("</reports>")).alias("value")).select("value").repartition(20, "value").write.option("maxRecordsPerFile", 1).text(path)
    x = registry.read_reports(s, path)
    own = F.array_join(F.array_sort(F.transform(F.filter("ExternalSignature", lambda e: e["SignatureType"] == "File extension"), lambda e: e["Signature"])), ",")
    mimes = F.array_join(F.transform(F.filter("FormatIdentifier", lambda i: i["IdentifierType"] == "MIME"), lambda i: i["Identifier"]), ",")
    return x.select("puid", F.col("FormatName").alias("name"), F.coalesce("FormatVersion", F.lit("")).alias("version"), F.coalesce(own, F.lit("")).alias("exts"), mimes.alias("mimes"))


def shown(make, relation: str, *keep: int):
    """Rows of a relation of a catalogue as texts joined by |."""
    return lambda s, d: s.createDataFrame([("|".join(str(r[i]) for i in keep),) for r in make(s, d).rows(relation)], "row string").distinct()


def hits(make):
    """The documents with the formats whose byte signatures they match."""
    return lambda s, d: matchers.byte_hits(doc_files(s, d), [make(s, d)]).select("path", "id").distinct()


def droid(s, d) -> Catalog:
    return registry.from_droid(droid_file(s, d))


def types(s, d) -> Catalog:
    return mimeinfo.from_mimeinfo(mime_file(s, d))


def described(s, d) -> Catalog:
    return library.from_library(library_documents(s, d))


def borrowing(s, d) -> Catalog:
    return library.from_library(library_documents(s, d), registry=droid(s, d))


def of_class(s, d, name: str) -> set:
    return {i for _, i, _, _, _, c in formats(s, d, "pronom") if c == name}


def joined(s, d) -> DataFrame:
    """The signature file joined with the formats of the registry that have a version, whose names then hold."""
    rows = T(s, d, "format_registry").where("ns = 'pronom' and format_version is not null").collect()
    other = Catalog("pronom", infos=[("pronom", r.ident_id, f"{r.format_name} {r.format_version}", "", "", "") for r in rows])
    return s.createDataFrame([(r[1], r[2]) for r in droid(s, d).join(other).infos], "id string, name string")


def undoubled(s, d) -> DataFrame:
    """The ids that keep byte signatures once the formats of class GIS own container signatures."""
    c = droid(s, d)
    c.containers = [("pronom", i, "ZIP", 1, 1, 1) for i in sorted(of_class(s, d, "GIS"))]
    return s.createDataFrame([(i,) for i in sorted({r[1] for r in c.no_doubles().signatures})], "id string")


def queries():
    return {
        "reports_read": reports_read,
        "priority_graph_all": lambda s, d: s.createDataFrame([(x,) for x in droid(s, d).priority_graph().splitlines()], "line string"),
        "droid_globs_all": shown(droid, "globs", 1, 3),
        "droid_priorities_all": shown(droid, "priorities", 1, 2),
        "droid_signatures_all": hits(droid),
        "mimeinfo_globs_all": shown(types, "globs", 1, 2, 3, 5),
        "mimeinfo_magic_all": shown(types, "byte_sigs", 1, 2, 3, 9),
        "mimeinfo_matches_all": hits(types),
        "library_priorities_all": shown(described, "priorities", 1, 2),
        "library_matches_all": hits(described),
        "library_borrowed_all": hits(borrowing),
        "catalog_join_all": joined,
        "catalog_limit_all": shown(lambda s, d: droid(s, d).limit(of_class(s, d, "Audio")), "globs", 1, 3),
        "catalog_exclude_all": shown(lambda s, d: droid(s, d).exclude(of_class(s, d, "Audio")), "priorities", 1, 2),
        "doubles_filter_all": undoubled,
    }


_OF = """
reg AS (SELECT ident_id AS id, ns, trim(coalesce(format_name, '')) AS name, exts, format_class, format_version, row_number() OVER (PARTITION BY ns ORDER BY ident_id) - 1 AS k FROM format_registry WHERE ident_id IS NOT NULL),
p AS (SELECT * FROM reg WHERE ns = 'pronom'), m AS (SELECT *, split_part(name, ' ', 1) AS word FROM reg WHERE ns = 'tika'), l AS (SELECT * FROM reg WHERE ns = 'loc'),
prio AS (SELECT a.id AS sub, b.id AS sup FROM p a JOIN p b ON a.k // 5 = b.k // 5 AND a.k < b.k AND b.k % 5 < 4),
docs AS (SELECT 'docs/' || doc_id || CASE WHEN e = '' THEN '' ELSE '.' || e END AS path, t, hex(encode(t)) AS h FROM (SELECT doc_id, coalesce(text, '') AS t, split_part('txt,yaml,md,log,,text,bin', ',', CAST(doc_id % 7 + 1 AS INTEGER)) AS e FROM documents))
"""


def oracle_sql():
    own = "SELECT id, word FROM m WHERE name != '' UNION ALL SELECT a.id, b.word FROM m a JOIN m b ON a.k = b.k + 1 AND a.k % 4 = 1 WHERE b.name != ''"
    return {
        "priority_graph_all": f"""WITH {_OF} SELECT '  "' || sub || '" -> "' || sup || '"' AS line FROM prio UNION ALL VALUES ('digraph {{'), ('}}')""",
        "reports_read": "SELECT ident_id AS puid, format_name AS name, coalesce(format_version, '') AS version, coalesce(array_to_string(list_sort(exts), ','), '') AS exts, CASE WHEN mime_type IS NULL OR mime_type = '' THEN '' ELSE mime_type END AS mimes FROM format_registry WHERE ns = 'pronom' AND ident_id IS NOT NULL",
        "droid_globs_all": f"WITH {_OF} SELECT DISTINCT id || '|' || lower(e) AS row FROM (SELECT id, unnest(exts) AS e FROM p) WHERE e != ''",
        "droid_priorities_all": f"WITH {_OF} SELECT sub || '|' || sup AS row FROM prio",
        "droid_signatures_all": f"WITH {_OF} SELECT DISTINCT path, id FROM docs JOIN p ON name != '' AND contains(t, name)",
        "mimeinfo_globs_all": f"WITH {_OF} SELECT DISTINCT id || '|ext|' || lower(e) || '|' || (40 + k % 3 * 10) AS row FROM (SELECT id, k, unnest(exts) AS e FROM m) WHERE e != ''",
        "mimeinfo_magic_all": f"WITH {_OF}, o AS (SELECT id, 50 AS w FROM m WHERE name != '' UNION ALL SELECT a.id, 49 FROM m a JOIN m b ON a.k = b.k + 1 AND a.k % 4 = 1 WHERE b.name != '') SELECT id || '|' || row_number() OVER (PARTITION BY id ORDER BY w DESC) || '|' || count(*) OVER (PARTITION BY id) || '|' || w AS row FROM o",
        "mimeinfo_matches_all": f"WITH {_OF}, o AS ({own}), c AS (SELECT DISTINCT path, h, id, word FROM docs JOIN o ON contains(t, word)) SELECT DISTINCT path, id FROM c WHERE regexp_matches(h, '^(?:..){{0,200}}' || hex(encode(word)))",
        "library_priorities_all": f"WITH {_OF} SELECT b.id || '|' || a.id AS row FROM l a JOIN l b ON a.k = b.k + 1 AND a.k % 3 = 1",
        "library_matches_all": f"WITH {_OF} SELECT DISTINCT path, id FROM docs JOIN l ON name != '' AND starts_with(t, left(name, 2))",
        "library_borrowed_all": f"WITH {_OF} SELECT DISTINCT path, l.id FROM docs JOIN l ON l.name != '' AND starts_with(t, left(l.name, 2)) UNION SELECT path, l.id FROM docs JOIN p ON p.name != '' AND contains(t, p.name) JOIN l ON l.k = p.k AND l.k % 2 = 0",
        "catalog_join_all": f"WITH {_OF} SELECT id, name || CASE WHEN format_version IS NULL THEN '' ELSE ' ' || format_version END AS name FROM p",
        "catalog_limit_all": f"WITH {_OF} SELECT DISTINCT id || '|' || lower(e) AS row FROM (SELECT id, unnest(exts) AS e FROM p WHERE format_class = 'Audio') WHERE e != ''",
        "catalog_exclude_all": f"WITH {_OF}, a AS (SELECT id FROM p WHERE format_class = 'Audio') SELECT sub || '|' || sup AS row FROM prio WHERE sub NOT IN (SELECT id FROM a) AND sup NOT IN (SELECT id FROM a)",
        "doubles_filter_all": f"WITH {_OF} SELECT id FROM p WHERE name != '' AND format_class IS DISTINCT FROM 'GIS'",
    }
