"""Queries on priorities, sets, results files, comparison, checksums and archives, over whole tables, with SQL twins."""

from __future__ import annotations

import gzip
import io
import struct
import tarfile
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions import scalars
from sigloom.operators import priorities
from sigloom.operators import results as R
from sigloom.operators.matchers import container_hits, riff_hits
from sigloom.session import shared_path
from sigloom.session import table as T
from sigloom.sources import archives, registry, results
from sigloom.sources.catalog import Catalog


def edges(s, d) -> DataFrame:
    """(sub, sup) from the relations of all snapshots: priorities, supertypes and subtypes."""
    return priorities.relation_edges(T(s, d, "related_formats"))


def hit_groups(s, d) -> DataFrame:
    """(grp, id): groups of reports that stand in for the hits of a file."""
    return T(s, d, "report_snapshots").where("report_id is not null").select(F.pmod("report_id", F.lit(50)).alias("grp"), F.col("report_id").alias("id")).distinct()


def some_ids(s, d) -> DataFrame:
    return T(s, d, "report_snapshots").where("report_id is not null and report_id % 3 != 0").select(F.col("report_id").alias("id")).distinct()


def set_members(s, d) -> DataFrame:
    """Sets of registry ids by class, and sets of sets by namespace; one pair of sets holds each other."""
    reg = T(s, d, "format_registry")
    leaf = reg.select(F.concat(F.col("ns"), F.lit(" "), F.col("format_class")).alias("set"), F.concat("ident_id", F.lit(" "), F.coalesce("format_name", F.lit(""))).alias("member"))
    leaf = leaf.withColumn("set", F.regexp_replace("set", "[^A-Za-z0-9]+", "_"))
    inner = reg.select(F.concat(F.lit("all_"), F.col("ns")).alias("set"), F.concat(F.lit("@"), F.regexp_replace(F.concat("ns", F.lit(" "), "format_class"), "[^A-Za-z0-9]+", "_")).alias("member"))
    loop = inner.select(F.lit("all_pronom").alias("set"), F.lit("@ring").alias("member")).union(inner.select(F.lit("ring"), F.lit("@all_pronom"))).distinct()
    return leaf.union(inner).union(loop)


def scan_results(s, d, changed: bool = False) -> DataFrame:
    """scan_files as results, once per file number; ``changed`` gives a second result that lacks some files and differs in others."""
    once = T(s, d, "scan_files").groupBy("file_no").agg(F.max(F.struct("filename", "filesize", "errors", "hash_value", "ids", F.col("modified").cast("string").alias("modified"))).alias("x")).select("file_no", "x.*")
    ids = F.coalesce("ids", F.expr("cast(array() as array<string>)"))
    if changed:
        once = once.where("file_no % 10 != 3")
        ids = F.when(F.col("file_no") % 7 == 2, F.slice(ids, 1, 1)).otherwise(F.reverse(ids))
    empty = F.lit("")
    m = F.transform(ids, lambda i: F.struct(F.lit("pronom").alias("ns"), F.coalesce(i, empty).alias("id"), empty.alias("format"), empty.alias("version"), empty.alias("mime"), F.lit("extension match").alias("basis"), empty.alias("warning")))
    name = F.concat_ws("/", F.col("file_no").cast("string"), "filename")
    return once.select(F.lit("scan").alias("source"), F.col("file_no").alias("seq"), name.alias("filename"), "filesize", F.coalesce("modified", empty).alias("modified"), F.coalesce("errors", empty).alias("errors"), F.lower(F.coalesce("hash_value", empty)).alias("hash"), m.alias("matches"))


def json_files(s, d) -> DataFrame:
    """Every file of scan_files as a JSON results file of its own."""
    r = scan_results(s, d)
    m = F.transform("matches", lambda m: F.struct(m["ns"].alias("ns"), m["id"].alias("id"), m["basis"].alias("basis")))
    f = F.struct("filename", "filesize", "modified", "errors", m.alias("matches"))
    return r.select(F.col("seq").cast("string").alias("source"), F.to_json(F.struct(F.lit("demo.sig").alias("signature"), F.array(f).alias("files"))).alias("text"))


def yaml_files(s, d) -> DataFrame:
    r = results.yaml_documents(scan_results(s, d))
    return r.select(F.col("seq").cast("string").alias("source"), F.concat(F.lit(results.yaml_head({"signature": "demo.sig"}, [("pronom", "demo")])), F.col("value")).alias("text"))


def csv_files(s, d) -> DataFrame:
    q = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    r = results.csv_rows(scan_results(s, d), ["pronom"])
    line = F.concat_ws(",", *(q(c) for c in ("filename", "filesize", "modified", "errors", "ns", "id", "basis")))
    g = r.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("row", line.alias("line")))).alias("ls"))
    return g.select(F.col("seq").cast("string").alias("source"), F.concat(F.lit("filename,filesize,modified,errors,namespace,id,basis\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("text"))


def quoted(c) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def droid_files(s, d) -> DataFrame:
    """Every file of scan_files in a DROID export of its own, with its folders."""
    columns = ("ID", "PARENT_ID", "URI", "FILE_PATH", "NAME", "METHOD", "STATUS", "SIZE", "TYPE", "EXT", "LAST_MODIFIED", "EXTENSION_MISMATCH", "MD5_HASH", "FORMAT_COUNT", "PUID", "MIME_TYPE", "FORMAT_NAME", "FORMAT_VERSION")
    known = F.filter("matches", lambda m: ~m["id"].isin(*results.UNKNOWNS))
    one = {"FILE_PATH": F.col("filename"), "SIZE": F.col("filesize"), "TYPE": F.lit("File"), "STATUS": F.when(F.col("errors") == "", "Done").otherwise(F.col("errors"))}
    line = F.concat_ws(",", *(quoted(one.get(c, F.col("puid") if c == "PUID" else F.lit(""))) for c in columns))
    r = scan_results(s, d).withColumn("puid", F.explode_outer(F.transform(known, lambda m: m["id"])))
    g = r.groupBy("seq").agg(F.array_sort(F.collect_list(line)).alias("ls"))
    folder = F.concat_ws(",", *(quoted(F.lit({"FILE_PATH": "d", "TYPE": "Folder", "STATUS": "Done"}.get(c, ""))) for c in columns))
    return g.select(F.col("seq").cast("string").alias("source"), F.concat_ws("\n", F.concat_ws(",", *(quoted(F.lit(c)) for c in columns)), folder, F.array_join("ls", "\n")).alias("text"))


def fido_files(s, d) -> DataFrame:
    """Every file of scan_files in a FIDO list of its own."""
    r = scan_results(s, d).withColumn("m", F.explode_outer(F.transform("matches", lambda m: m["id"])))
    known = ~F.coalesce(F.col("m"), F.lit("")).isin(*results.UNKNOWNS)
    cells = (F.when(known, "OK").otherwise("KO"), F.lit("1"), F.when(known, F.col("m")).otherwise(""), F.lit("x"), F.lit("x"), F.col("filesize"), F.col("filename"), F.lit("None"), F.when(known, "extension").otherwise("fail"))
    line = F.concat_ws(",", *(c if i == 0 else quoted(c) for i, c in enumerate(cells)))
    g = r.groupBy("seq").agg(F.collect_list(line).alias("ls"))
    return g.select(F.col("seq").cast("string").alias("source"), F.array_join("ls", "\n").alias("text"))


def release_sets(s, d) -> DataFrame:
    return registry.release_sets(release_notes(s, d)).select("set", F.array_join("members", ",").alias("members"))


def zip_default(s, d) -> DataFrame:
    """The default id of the zip files in which no container signature is held whole."""
    c = Catalog("demo", zip_default="x-fmt/263", containers=[("demo", "c/1", "ZIP", 1, 1, 1)], parts=[("demo", "c/1", "ZIP", 1, 1, "folder/a.txt", False, (r"\Afmt",))])
    return container_hits(packed_files(s, d, "zip"), [c]).select("path", "id", "basis")


def csv_lines(s, d) -> DataFrame:
    """All files of scan_files in CSV part files, read back line by line."""
    path = shared_path(s, "csv")
    results.write_csv(scan_results(s, d), ["pronom"], path)
    x = results.read_csv(s, path)
    return x.select("filename", "filesize", R.id_text(F.transform("matches", lambda m: m["id"])).alias("ids"), results.is_known(F.col("matches")).alias("known"))


def read_back(texts) -> DataFrame:
    """What a results file of one object says: filename, filesize, ids."""
    return results.parse(texts).select("filename", "filesize", R.id_text(F.transform("matches", lambda m: m["id"])).alias("ids"), results.is_known(F.col("matches")).alias("known"))


#: The time in the archives that are built, and the levels of the deep ones.
WHEN = (2024, 1, 2, 3, 4, 6)
DEEP = 12


# -- archives built from the documents ------------------------------------------------------------------------------------
def _packed(kind: str, k: int, text: str) -> bytes:
    data, out = (text or "").encode(), io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(zipfile.ZipInfo("folder/", WHEN), "")
            z.writestr(zipfile.ZipInfo("folder/a.txt", WHEN), data)
            z.writestr(zipfile.ZipInfo("b.md", WHEN), data[:10])
    elif kind == "tar":
        with tarfile.open(fileobj=out, mode="w") as t:
            info = tarfile.TarInfo("a.txt")
            info.size, info.mtime = len(data), 1_704_164_646
            t.addfile(info, io.BytesIO(data))
    elif kind == "gzip":
        out.write(gzip.compress(data, mtime=0))
    elif kind == "multi.gz":
        return gzip.compress(data[:10], mtime=1_704_164_646) + gzip.compress(data[10:], mtime=0)
    elif kind == "deep":
        for _ in range(DEEP):
            data = gzip.compress(data, mtime=0)
        return data
    elif kind == "nested":
        return gzip.compress(_packed("tar", k, text), mtime=0)
    elif kind == "warc":
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\n" + data
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://example.org/{k}\r\nWARC-Date: 2024-01-02T03:04:05Z\r\nContent-Length: {len(body)}\r\n\r\n"
        out.write(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n" + head.encode() + body + b"\r\n\r\n")
    elif kind == "arc":
        first = b"1 0 test\nURL IP-address Archive-date Content-type Archive-length\n"
        out.write(f"filedesc://x.arc 0.0.0.0 20240102030405 text/plain {len(first)}\n".encode() + first + b"\n" + f"http://example.org/{k} 1.2.3.4 20240102030405 text/plain {len(data)}\n".encode() + data + b"\n")
    elif kind == "riff":
        chunk = lambda c, b: c + struct.pack("<I", len(b)) + b + b"\0" * (len(b) & 1)
        body = b"WAVE" + chunk(b"fmt ", b"\0" * 16) + chunk(b"LIST", b"INFO" + chunk(b"ISFT", data[:9])) + (chunk(b"bext", data[:20]) if k % 2 else b"") + chunk(b"data", data)
        out.write(b"RIFF" + struct.pack("<I", len(body)) + body)
    elif kind == "container":
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("mimetype", b"application/x-demo" if k % 2 else b"other")
            z.writestr(f"part{k % 3}.xml", data)
    return out.getvalue()


def packed_files(s, d, kind: str) -> DataFrame:
    """Every document in an archive of its own."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = [(f"{k}.{kind}", _packed(kind, k, t)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return T(s, d, "documents").select("doc_id", "text").mapInArrow(run, "path string, content binary")


def unpacked(kind: str, **options):
    """Everything in the archives; length and hash of what is no archive itself."""

    def query(s, d):
        x = archives.expand(packed_files(s, d, kind), **options).where("depth > 0")
        if kind not in ("nested", "deep"):
            return x.select("path", "mime", "length", "modified", F.md5("content").alias("md5"), "depth", F.coalesce("error", F.lit("")).alias("error"))
        leaf = ~(F.startswith("content", F.lit(bytearray(b"\x1f\x8b"))) | (F.substring("content", 258, 5) == F.lit(bytearray(b"ustar"))))
        return x.select("path", F.when(leaf, F.col("length")).alias("length"), F.when(leaf, F.md5("content")).alias("md5"), "depth", F.coalesce("error", F.lit("")).alias("error"))

    return query


def container_catalog() -> Catalog:
    c = Catalog("demo", containers=[("demo", "c/1", "ZIP", 1, 1, 2), ("demo", "c/2", "ZIP", 1, 1, 1)])
    c.parts = [("demo", "c/1", "ZIP", 1, 1, "mimetype", False, (r"\Aapplication/x-demo",)), ("demo", "c/1", "ZIP", 1, 2, "part1.xml", False, ()), ("demo", "c/2", "ZIP", 1, 1, "part[02].*", True, ())]
    return c


def riff_catalog() -> Catalog:
    return Catalog("demo", fourccs=[("demo", "r/1", "WAVE"), ("demo", "r/2", "bext"), ("demo", "r/3", "ISFT")])


def uri_query(s, d):
    names = T(s, d, "scan_files").where("filename is not null").select("filename").distinct()
    return names.select("filename", scalars.uri_escape(F.col("filename")).alias("escaped"), scalars.file_uri(F.col("filename")).alias("uri"))


def path_helpers(s, d):
    """Per file: its folders, the URI of an entry were it a zip, its time, and its name out of URL-safe base64."""
    f = T(s, d, "scan_files").where("filename is not null").select("file_no", "filename", "modified").distinct()
    name = F.col("filename")
    coded = F.translate(F.base64(F.encode(name, "UTF-8")), "+/\r\n", "-_")
    uri = scalars.archive_uri(F.lit("zip"), scalars.file_uri(name), F.lit("a b/ü.txt"))
    return f.select("file_no", "filename", F.array_join(scalars.path_folders(name), "|").alias("folders"), uri.alias("uri"), scalars.rfc3339(F.col("modified")).alias("modified"), scalars.decoded_path(coded).alias("decoded"))


def version_helpers(s, d):
    """Per format: its label and the numbers of its version."""
    r = T(s, d, "format_registry")
    return r.select("ident_id", scalars.label(F.col("format_name"), F.col("format_version")).alias("label"), F.array_join(scalars.version_numbers(F.concat(F.coalesce("format_version", F.lit("")), F.lit(".0.1"))), ".").alias("numbers"))


def checksums(s, d):
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return T(s, d, "documents").select("doc_id", *(scalars.checksum(content, k).alias(k) for k in ("md5", "sha1", "sha256")))


def families(s, d):
    return R.family_sets(T(s, d, "report_snapshots").withColumn("member", F.col("report_id").cast("string")), "families", "member")


def log_counts(s, d):
    r = scan_results(s, d)
    m = F.col("matches")
    n = lambda c, a: F.sum(c.cast("bigint")).alias(a)
    return r.agg(n(results.is_known(m), "known"), n(~results.is_known(m), "unknown"), n(results.has_warning(m), "warned"), n(F.col("errors") != "", "failed"))


def droid_projection(s, d) -> DataFrame:
    """The DROID layout of the files, with the path of the row that PARENT_ID names in place of the two numbers."""
    x = results.droid_rows(scan_results(s, d))
    owners = x.select(F.col("ID").alias("PARENT_ID"), F.col("FILE_PATH").alias("parent_path")).distinct()
    y = x.join(owners, "PARENT_ID", "left").drop("ID", "PARENT_ID").withColumn("FORMAT_COUNT", F.col("FORMAT_COUNT").cast("bigint"))
    return y.select(*(F.col(c).alias(c.lower()) for c in y.columns))


def compared_by(key: str):
    return lambda s, d: R.compare([scan_results(s, d), scan_results(s, d, True)], key).select("key", "r1", "r2")


def release_notes(s, d):
    """Release notes told by the snapshots: a report is new in its first, updated in later ones."""
    x = T(s, d, "report_snapshots").where("report_id is not null").select("snap_date", "report_id").distinct()
    first = x.groupBy("report_id").agg(F.min("snap_date").alias("first"))
    return x.join(first, "report_id").select(F.date_format("snap_date", "d MMMM yyyy").alias("release_date"), F.when(F.col("snap_date") == F.col("first"), "new").otherwise("updated").alias("kind"), F.col("report_id").cast("string").alias("puid"))


def queries():
    return {
        "priority_edges": edges,
        "priority_closure": lambda s, d: priorities.closure(edges(s, d)),
        "priority_apply": lambda s, d: priorities.apply(hit_groups(s, d), edges(s, d)),
        "priority_filter": lambda s, d: priorities.induced(edges(s, d), some_ids(s, d)),
        "priority_difference": lambda s, d: priorities.difference(edges(s, d), priorities.induced(edges(s, d), some_ids(s, d))),
        "priority_elements": lambda s, d: priorities.elements(priorities.induced(edges(s, d), some_ids(s, d)), some_ids(s, d)),
        "sets_expand": lambda s, d: priorities.expand_sets(set_members(s, d), ["all_pronom", "all_loc"]),
        "format_order": lambda s, d: T(s, d, "format_registry").select("ident_id", F.row_number().over(_order()).cast("bigint").alias("place")),
        "extension_sets": lambda s, d: R.extension_sets(T(s, d, "format_registry")).select("set", F.array_join("members", ",").alias("members")),
        "family_sets": lambda s, d: families(s, d).select("set", F.array_join("members", ",").alias("members")),
        "release_stats": lambda s, d: registry.release_stats(release_notes(s, d)),
        "format_chart": lambda s, d: R.chart(T(s, d, "identifications").groupBy("ident_no").agg(F.min("ns").alias("ns"), F.lower(F.trim(F.min("ident_id"))).alias("id")).where("id is not null and ns is not null")),
        "log_counts": log_counts,
        "compare_results": lambda s, d: R.compare([scan_results(s, d), scan_results(s, d, True)]).select("path", "r1", "r2"),
        "compare_by_hash": lambda s, d: R.compare([scan_results(s, d).where("hash != ''"), scan_results(s, d, True).where("hash != ''")], "hash").select("key", "r1", "r2"),
        **{f"compare_by_{k}": compared_by(k) for k in ("name", "name_size", "name_modified", "name_hash")},
        "compare_matches": lambda s, d: R.compare([scan_results(s, d), scan_results(s, d, True)], differences=False).select("path", "r1", "r2"),
        "results_json_read": lambda s, d: read_back(json_files(s, d)),
        "results_yaml_read": lambda s, d: read_back(yaml_files(s, d)),
        "results_csv_read": lambda s, d: read_back(csv_files(s, d)),
        "results_csv_lines": csv_lines,
        "results_droid_read": lambda s, d: read_back(droid_files(s, d)),
        "results_fido_read": lambda s, d: read_back(fido_files(s, d)),
        "release_sets": release_sets,
        "zip_default": zip_default,
        "csv_projection": lambda s, d: results.csv_rows(scan_results(s, d), ["pronom"]).withColumn("row", F.col("row").cast("bigint")),
        "droid_projection": droid_projection,
        "reply_text": lambda s, d: R.fpr_reply(scan_results(s, d)),
        "checksums": checksums,
        "checksum_crc_sha512": lambda s, d: T(s, d, "documents").select("doc_id", *(scalars.checksum(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), k).alias(k) for k in ("crc", "sha512"))),
        "uri_escape": uri_query,
        "path_helpers": path_helpers,
        "version_helpers": version_helpers,
        **{f"unpack_{k}": unpacked(k) for k in ("zip", "tar", "gzip", "nested", "deep", "warc", "arc")},
        "unpack_multi_gzip": unpacked("multi.gz"),
        "unpack_selected": unpacked("nested", kinds=("gzip", "zip")),
        "riff_codes": lambda s, d: riff_hits(packed_files(s, d, "riff"), [riff_catalog()]).select("path", "id", "basis"),
        "container_parts": lambda s, d: container_hits(packed_files(s, d, "container"), [container_catalog()]).select("path", "id", "basis"),
    }


def _order():
    from pyspark.sql import Window

    return Window.orderBy(*priorities.format_order("ident_id"))


_EDGES = r"""
said AS (SELECT regexp_replace(trim(lower(typ)), '\s+', ' ', 'g') AS typ, report_id, related_id FROM related_formats WHERE report_id IS NOT NULL AND related_id IS NOT NULL),
edges AS (SELECT report_id AS sub, related_id AS sup FROM said WHERE typ IN ('has lower priority than', 'is supertype of') AND report_id != related_id
  UNION SELECT related_id, report_id FROM said WHERE typ IN ('has priority over', 'is subtype of') AND report_id != related_id),
chosen AS (SELECT DISTINCT report_id AS id FROM report_snapshots WHERE report_id IS NOT NULL AND report_id % 3 != 0),
induced AS (SELECT sub, sup FROM edges WHERE sub IN (SELECT id FROM chosen) AND sup IN (SELECT id FROM chosen))
"""


def _results(name: str, changed: bool) -> str:
    ids = "CASE WHEN file_no % 7 = 2 THEN ids[1:1] ELSE ids END" if changed else "ids"
    where = "WHERE file_no % 10 != 3" if changed else ""
    return f"""{name} AS (SELECT file_no AS seq, concat_ws('/', CAST(file_no AS VARCHAR), x.filename) AS filename, x.filesize AS filesize, coalesce(x.errors, '') AS errors, lower(coalesce(x.hash_value, '')) AS hash, coalesce(strftime(x.modified, '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond(x.modified) % 1000000 = 0 THEN '' ELSE rtrim('.' || lpad(CAST(microsecond(x.modified) % 1000000 AS VARCHAR), 6, '0'), '0') END, '') AS modified, list_transform(coalesce({ids.replace('ids', 'x.ids')}, []), lambda i: coalesce(i, '')) AS ids
      FROM (SELECT file_no, max({{'filename': filename, 'filesize': filesize, 'errors': errors, 'hash_value': hash_value, 'ids': ids, 'modified': modified}}) AS x FROM (SELECT * FROM scan_files) GROUP BY file_no) {where})"""


def _text(ids: str) -> str:
    return f"array_to_string(list_sort({ids}), ';')"


_NAME = r"regexp_extract(regexp_replace(filename, '[/\\]+$', ''), '[^/\\]*$')"
_KNOWN = "len(list_filter(ids, lambda i: i NOT IN ('', 'unknown', 'UNKNOWN'))) > 0"


def oracle_sql():
    compare = f"WITH {_results('a', False)}, {_results('b', True)}, c AS (SELECT coalesce(a.filename, b.filename) AS path, coalesce({_text('a.ids')}, 'MISSING') AS r1, coalesce({_text('b.ids')}, 'MISSING') AS r2 FROM a FULL JOIN b ON a.filename = b.filename)"
    read = f"WITH {_results('a', False)} SELECT filename, filesize, {_text('ids')} AS ids, {_KNOWN} AS known FROM a"
    doc = "SELECT doc_id, coalesce(text, '') AS t FROM documents"
    out = lambda path, mime, body, depth=1, when="": f"SELECT {path} AS path, {mime} AS mime, octet_length(encode({body})) AS length, '{when}' AS modified, md5({body}) AS md5, CAST({depth} AS INTEGER) AS depth, '' AS error FROM d"
    return {
        "priority_edges": f"WITH {_EDGES} SELECT sub, sup FROM edges",
        "priority_closure": f"WITH RECURSIVE {_EDGES}, up(sub, sup) AS (SELECT sub, sup FROM edges UNION SELECT up.sub, e.sup FROM up JOIN edges e ON up.sup = e.sub) SELECT DISTINCT sub, sup FROM up WHERE sub != sup",
        "priority_apply": f"""WITH {_EDGES}, hits AS (SELECT DISTINCT report_id % 50 AS grp, report_id AS id FROM report_snapshots WHERE report_id IS NOT NULL)
            SELECT grp, id FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o JOIN edges e ON o.id = e.sup WHERE o.grp = h.grp AND e.sub = h.id)""",
        "priority_filter": f"WITH {_EDGES} SELECT sub, sup FROM induced",
        "priority_difference": f"WITH {_EDGES} SELECT sub, sup FROM edges EXCEPT SELECT sub, sup FROM induced",
        "priority_elements": f"WITH {_EDGES} SELECT sub, sup FROM induced UNION ALL SELECT id, NULL FROM chosen WHERE id NOT IN (SELECT sub FROM induced UNION SELECT sup FROM induced)",
        "sets_expand": """SELECT DISTINCT 'all_' || ns AS set, ident_id AS member FROM format_registry WHERE ns IN ('pronom', 'loc')""",
        "format_order": r"""SELECT ident_id, row_number() OVER (ORDER BY CASE WHEN n IS NULL THEN 2 WHEN starts_with(ident_id, 'x-') THEN 1 ELSE 0 END, n, ident_id) AS place
            FROM (SELECT ident_id, try_cast(regexp_extract(ident_id, '^(?:x-)?fmt/([0-9]+)$', 1) AS BIGINT) AS n FROM format_registry)""",
        "extension_sets": "SELECT ext AS set, array_to_string(list_sort(list(DISTINCT ident_id)), ',') AS members FROM (SELECT lower(trim(unnest(exts))) AS ext, ident_id FROM format_registry) WHERE ext != '' GROUP BY ext",
        "family_sets": r"""SELECT f AS set, array_to_string(list_sort(list(DISTINCT member)), ',') AS members FROM (
            SELECT array_to_string(list_transform(string_split_regex(trim(w), '[^A-Za-z0-9]+'), lambda x: upper(x[1]) || lower(x[2:])), '') AS f, member FROM (SELECT unnest(string_split_regex(families, '[,;]')) AS w, CAST(report_id AS VARCHAR) AS member FROM report_snapshots))
            WHERE f != '' AND member IS NOT NULL GROUP BY f""",
        "release_stats": """WITH x AS (SELECT DISTINCT snap_date, report_id FROM report_snapshots WHERE report_id IS NOT NULL), f AS (SELECT report_id, min(snap_date) AS first FROM x GROUP BY 1)
            SELECT CAST(year(snap_date) AS VARCHAR) AS year, count(DISTINCT snap_date) AS n_releases, count(*) FILTER (WHERE snap_date = first) AS n_new, count(*) FILTER (WHERE snap_date != first) AS n_updated, 0::BIGINT AS n_signatures FROM x JOIN f USING (report_id) GROUP BY 1""",
        "format_chart": """WITH o AS (SELECT ident_no, min(ns) AS ns, lower(trim(min(ident_id))) AS id FROM identifications GROUP BY 1), n AS (SELECT ns, id, count(*) AS n FROM o WHERE id IS NOT NULL AND ns IS NOT NULL GROUP BY 1, 2)
            SELECT ns, id, n, repeat('■', greatest(1, CAST(n * 10 // max(n) OVER (PARTITION BY ns) AS INTEGER))) AS bar FROM n""",
        "log_counts": f"WITH {_results('a', False)} SELECT count(*) FILTER (WHERE {_KNOWN}) AS known, count(*) FILTER (WHERE NOT ({_KNOWN})) AS unknown, 0::BIGINT AS warned, count(*) FILTER (WHERE errors != '') AS failed FROM a",
        "compare_results": f"{compare} SELECT * FROM c WHERE r1 != r2",
        **{f"compare_by_{k}": f"""WITH {_results('a', False)}, {_results('b', True)}, la AS (SELECT {key} AS key, {_text('ids')} AS ids FROM a QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY seq DESC) = 1),
            lb AS (SELECT {key} AS key, {_text('ids')} AS ids FROM b QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY seq DESC) = 1),
            c AS (SELECT coalesce(la.key, lb.key) AS key, coalesce(la.ids, 'MISSING') AS r1, coalesce(lb.ids, 'MISSING') AS r2 FROM la FULL JOIN lb ON la.key = lb.key) SELECT * FROM c WHERE r1 != r2"""
            for k, key in (("name", _NAME), ("name_size", f"{_NAME} || coalesce(CAST(filesize AS VARCHAR), '')"), ("name_modified", f"{_NAME} || modified"), ("name_hash", f"{_NAME} || hash"))},
        "compare_matches": f"{compare} SELECT * FROM c WHERE r1 = r2",
        "compare_by_hash": f"""WITH {_results('a', False)}, {_results('b', True)}, la AS (SELECT hash, {_text('ids')} AS ids FROM a WHERE hash != '' QUALIFY row_number() OVER (PARTITION BY hash ORDER BY seq DESC) = 1),
            lb AS (SELECT hash, {_text('ids')} AS ids FROM b WHERE hash != '' QUALIFY row_number() OVER (PARTITION BY hash ORDER BY seq DESC) = 1),
            c AS (SELECT coalesce(la.hash, lb.hash) AS key, coalesce(la.ids, 'MISSING') AS r1, coalesce(lb.ids, 'MISSING') AS r2 FROM la FULL JOIN lb ON la.hash = lb.hash) SELECT * FROM c WHERE r1 != r2""",
        "results_json_read": read,
        "results_yaml_read": read,
        "results_csv_read": f"WITH {_results('a', False)} SELECT filename, filesize, CASE WHEN len(ids) = 0 THEN '' ELSE {_text('ids')} END AS ids, {_KNOWN} AS known FROM a",
        "results_droid_read": f"WITH {_results('a', False)}, k AS (SELECT filename, filesize, list_filter(ids, lambda i: i NOT IN ('', 'unknown', 'UNKNOWN')) AS k FROM a) SELECT filename, filesize, CASE WHEN len(k) = 0 THEN 'UNKNOWN' ELSE {_text('k')} END AS ids, len(k) > 0 AS known FROM k",
        "results_fido_read": f"WITH {_results('a', False)}, k AS (SELECT filename, filesize, list_transform(CASE WHEN len(ids) = 0 THEN [''] ELSE ids END, lambda i: CASE WHEN i IN ('', 'unknown', 'UNKNOWN') THEN 'UNKNOWN' ELSE i END) AS k FROM a) SELECT filename, filesize, {_text('k')} AS ids, len(list_filter(k, lambda i: i != 'UNKNOWN')) > 0 AS known FROM k",
        "release_sets": """WITH x AS (SELECT DISTINCT snap_date, report_id FROM report_snapshots WHERE report_id IS NOT NULL), f AS (SELECT report_id, min(snap_date) AS first FROM x GROUP BY 1),
            n AS (SELECT strftime(snap_date, '%-d %B %Y') || CASE WHEN snap_date = first THEN ' new' ELSE ' updated' END AS set, CAST(report_id AS VARCHAR) AS m FROM x JOIN f USING (report_id)) SELECT set, array_to_string(list_sort(list(DISTINCT m)), ',') AS members FROM n GROUP BY set""",
        "zip_default": f"""WITH d AS ({doc}) SELECT doc_id || '.zip' AS path, CASE WHEN starts_with(t, 'fmt') THEN 'c/1' ELSE 'x-fmt/263' END AS id, CASE WHEN starts_with(t, 'fmt') THEN 'container name folder/a.txt with byte match' ELSE 'container match with trigger and default extension' END AS basis FROM d""",
        "results_csv_lines": f"WITH {_results('a', False)} SELECT filename, filesize, CASE WHEN len(ids) = 0 THEN '' ELSE {_text('ids')} END AS ids, {_KNOWN} AS known FROM a",
        "csv_projection": f"""WITH {_results('a', False)} SELECT seq, r AS row, filename, filesize, modified, errors, 'pronom' AS ns, coalesce(ids[r + 1], '') AS id, '' AS format, '' AS version, '' AS mime, CASE WHEN r < len(ids) THEN 'extension match' ELSE '' END AS basis, '' AS warning FROM (SELECT *, unnest(range(greatest(1, len(ids)))) AS r FROM a)""",
        "droid_projection": rf"""WITH {_results('a', False)}, f AS (SELECT replace(filename, '\', '/') AS p, errors, filesize, modified, hash, list_filter(ids, lambda i: i NOT IN ('', 'unknown', 'UNKNOWN')) AS k FROM a),
            dirs AS (SELECT DISTINCT array_to_string(parts[1:n], '/') AS p FROM (SELECT parts, unnest(range(1, greatest(len(parts), 2))) AS n FROM (SELECT string_split(p, '/') AS parts FROM f))),
            base AS (SELECT p, regexp_extract(regexp_replace(p, '[/\\]+$', ''), '[^/\\]*$') AS name, 'File' AS type, errors, k, filesize, modified, hash FROM f UNION ALL SELECT p, regexp_extract(p, '[^/]*$'), 'Folder', '', NULL, NULL, NULL, NULL FROM dirs WHERE p != '' AND p NOT IN (SELECT p FROM f))
            SELECT p AS file_path, name, type, CASE WHEN type = 'File' AND len(k) > 0 THEN 'Extension' ELSE '' END AS method, CASE WHEN errors != '' THEN errors ELSE 'Done' END AS status,
              CASE WHEN type = 'File' THEN lower(regexp_extract(name, '\.([^.]*)$', 1)) ELSE '' END AS ext, CASE WHEN type = 'File' THEN CAST(len(k) AS BIGINT) END AS format_count, puid,
              'file:/' || regexp_replace(replace(replace(url_encode(p), '%2F', '/'), '%3A', ':'), '^/+', '') || CASE WHEN type = 'Folder' THEN '/' ELSE '' END AS uri, filesize AS size, modified AS last_modified, 'false' AS extension_mismatch, hash AS md5_hash,
              CASE WHEN puid IS NOT NULL THEN '' END AS mime_type, CASE WHEN puid IS NOT NULL THEN '' END AS format_name, CASE WHEN puid IS NOT NULL THEN '' END AS format_version, nullif(regexp_replace(regexp_replace(p, '[/\\]+$', ''), '[/\\]?[^/\\]*$', ''), '') AS parent_path
            FROM (SELECT *, unnest(CASE WHEN len(k) > 0 THEN k ELSE [NULL] END) AS puid FROM base)""",
        "reply_text": f"""WITH {_results('a', False)}, r AS (SELECT filename, CASE WHEN errors != '' AND len(ids) = 0 THEN 'error: failed to scan ' || filename || '; got ' || errors WHEN len(ids) = 0 THEN 'error: scanning ' || filename || ': no formats returned'
            WHEN len(ids) > 1 THEN 'error: multiple formats returned; got ' || array_to_string(ids, ', ') WHEN ids[1] IN ('', 'unknown', 'UNKNOWN') THEN 'error: format unknown; got ' ELSE ids[1] END AS reply FROM a)
            SELECT filename, CASE WHEN octet_length(encode(reply)) <= 1024 THEN reply ELSE list_aggregate(list_transform(list_filter(range(1, length(reply) + 1), lambda i: octet_length(encode(reply[1:i])) <= 1024), lambda i: reply[i]), 'string_agg', '') END AS reply FROM r""",
        "checksums": "SELECT doc_id, md5(coalesce(text, '')) AS md5, sha1(coalesce(text, '')) AS sha1, sha256(coalesce(text, '')) AS sha256 FROM documents",
        "uri_escape": r"""WITH n AS (SELECT DISTINCT filename FROM scan_files WHERE filename IS NOT NULL), e AS (SELECT filename, replace(replace(url_encode(filename), '%2F', '/'), '%3A', ':') AS escaped FROM n)
            SELECT filename, escaped, 'file:/' || regexp_replace(escaped, '^/+', '') AS uri FROM e""",
        "path_helpers": r"""WITH n AS (SELECT DISTINCT file_no, filename, modified FROM scan_files WHERE filename IS NOT NULL), e AS (SELECT *, 'file:/' || regexp_replace(replace(replace(url_encode(replace(filename, '\', '/')), '%2F', '/'), '%3A', ':'), '^/+', '') AS uri, string_split_regex(regexp_replace(filename, '[/\\]+$', ''), '[/\\]') AS parts FROM n)
            SELECT file_no, filename, array_to_string(list_transform(range(1, greatest(len(parts) - 1, 1) + 1), lambda i: array_to_string(parts[1:i], '/')), '|') AS folders, 'zip:' || uri || '!/a%20b/%C3%BC.txt' AS uri, strftime(modified, '%Y-%m-%dT%H:%M:%S') || 'Z' AS modified, filename AS decoded FROM e""",
        "version_helpers": r"""SELECT ident_id, concat_ws(' ', nullif(format_name, ''), nullif(format_version, '')) AS label,
            CASE WHEN regexp_full_match(coalesce(format_version, '') , '[+-]?\d+') AND try_cast(format_version AS INTEGER) IS NOT NULL THEN try_cast(format_version AS INTEGER) || '.0.1' END AS numbers FROM format_registry""",
        "unpack_zip": f"WITH d AS ({doc}), b AS (SELECT doc_id, encode(t) AS e FROM d) SELECT doc_id || '.zip#folder/a.txt' AS path, '' AS mime, octet_length(e) AS length, '2024-01-02T03:04:06Z' AS modified, md5(e) AS md5, 1 AS depth, '' AS error FROM b UNION ALL SELECT doc_id || '.zip#b.md', '', least(octet_length(e), 10), '2024-01-02T03:04:06Z', md5(unhex(hex(e)[1:20])), 1, '' FROM b",
        "unpack_tar": f"WITH d AS ({doc}) {out(chr(39).join(['doc_id || ', '.tar#a.txt', '']), chr(39) * 2, 't', 1, '2024-01-02T03:04:06Z')}",
        "unpack_multi_gzip": f"WITH d AS ({doc}) {out(chr(39).join(['doc_id || ', '.multi.gz#', ' || doc_id || ', '.multi', '']), chr(39) * 2, 't', 1, '2024-01-02T03:04:06Z')}",
        "unpack_nested": f"""WITH d AS ({doc}), g AS (SELECT doc_id || '.nested#' || doc_id || '.nested' AS path, t FROM d) SELECT path, NULL::BIGINT AS length, NULL AS md5, 1 AS depth, '' AS error FROM g
            UNION ALL SELECT path || '#a.txt', octet_length(encode(t)), md5(t), 2, '' FROM g""",
        "unpack_selected": f"SELECT doc_id || '.nested#' || doc_id || '.nested' AS path, NULL::BIGINT AS length, NULL AS md5, 1 AS depth, '' AS error FROM ({doc})",
        "unpack_deep": f"""WITH d AS ({doc}) SELECT doc_id || repeat('.deep#' || doc_id, CAST(k AS INTEGER)) || '.deep' AS path, CASE WHEN k = {DEEP} THEN octet_length(encode(t)) END AS length, CASE WHEN k = {DEEP} THEN md5(t) END AS md5,
            CAST(k AS INTEGER) AS depth, '' AS error FROM d, (SELECT unnest(range(1, {DEEP} + 1)) AS k)""",
        "unpack_gzip": f"WITH d AS ({doc}) {out(chr(39).join(['doc_id || ', '.gzip#', ' || doc_id']), chr(39) * 2, 't')}",
        "unpack_warc": f"WITH d AS ({doc}) {out(chr(39).join(['doc_id || ', '.warc#20240102030405/http://example.org/', ' || doc_id']), chr(39) + 'text/plain' + chr(39), 't', 1, '2024-01-02T03:04:05Z')}",
        "unpack_arc": f"WITH d AS ({doc}) {out(chr(39).join(['doc_id || ', '.arc#20240102030405/http://example.org/', ' || doc_id']), chr(39) + 'text/plain' + chr(39), 't', 1, '2024-01-02T03:04:05Z')}",
        "riff_codes": """SELECT doc_id || '.riff' AS path, 'r/1' AS id, 'fourCC matches WAVE' AS basis FROM documents UNION ALL SELECT doc_id || '.riff', 'r/3', 'fourCC matches ISFT' FROM documents
            UNION ALL SELECT doc_id || '.riff', 'r/2', 'fourCC matches bext' FROM documents WHERE doc_id % 2 = 1""",
        "container_parts": """SELECT doc_id || '.container' AS path, 'c/1' AS id, 'container name mimetype with byte match; name part1.xml with name only' AS basis FROM documents WHERE doc_id % 2 = 1 AND doc_id % 3 = 1
            UNION ALL SELECT doc_id || '.container', 'c/2', 'container name part' || doc_id % 3 || '.xml with name only' FROM documents WHERE doc_id % 3 != 1""",
    }
