"""Queries of identification: names, types, bytes, text, XML, containers, scores, modes - over whole tables, with SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions import patterns as P
from sigloom.functions import scalars
from sigloom.functions.frames import BOF, EOF, PREV, Frame, Signature
from sigloom.operators import matchers
from sigloom.operators.identify import identify
from sigloom.operators.resolve import gated, resolve_mime, scored, waiting
from sigloom.session import cut, shared_path, spread
from sigloom.session import table as T
from sigloom.sources import files, registry, results
from sigloom.sources.catalog import Catalog, load

NS = "demo"


def demo() -> Catalog:
    """A small catalogue of formats of the texts in ``documents``."""
    c = Catalog(NS, "formats of the test texts")
    lit = lambda s: P.Seq(s.encode())
    for i, name, mime, exts in (("d/1", "Results", "application/yaml", ["yaml", "yml"]), ("d/2", "Registry note", "text/x-note", ["md"]), ("d/3", "Signature note", "text/x-note", ["log"]), ("d/4", "German text", "text/plain", ["txt"]), ("d/5", "Plain text", "text/plain", ["txt", "text"])):
        c.infos.append((NS, i, name, "1", mime, "text"))
        c.mimes.append((NS, i, mime))
        c.globs += [(NS, i, "ext", e, 0, 50) for e in exts]
    c.globs.append((NS, "d/2", "glob", "README*", 1, 60))
    c.globs.append((NS, "d/3", "glob", "*[13579].n?te", 2, 40))
    c.texts.append((NS, "d/5", True))
    c.signatures = [
        (NS, "d/1", Signature((Frame(lit("---\nfilename"), BOF),)), 0),
        (NS, "d/1", Signature((Frame(lit("---"), BOF), Frame(lit("warning :"), EOF, 0, 2))), 0),
        (NS, "d/2", Signature((Frame(lit("fmt/"), BOF, 0, None),)), 0),
        (NS, "d/3", Signature((Frame(P.IgnoreCase(b"signature"), BOF, 0, 120),)), 0),
        (NS, "d/4", Signature((Frame(P.Alt((lit("Die "), lit("Das "))), BOF), Frame(lit("e"), PREV, 0, 40))), 0),
    ]
    c.priorities = [(NS, "d/2", "d/1"), (NS, "d/3", "d/2")]
    return c.closed_priorities()


EXTENSIONS = ("txt", "yaml", "md", "log", "", "text", "bin")


def doc_files(s, d) -> DataFrame:
    """documents as files: a name with one of the extensions, a declared type for every third, the text's bytes."""
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.pmod("doc_id", F.lit(len(EXTENSIONS))) + 1).cast("int"))
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    mime = F.when(F.pmod("doc_id", F.lit(3)) == 0, "text/plain; charset=utf-8").when(F.pmod("doc_id", F.lit(11)) == 1, "application/yaml").otherwise("")
    return T(s, d, "documents").select(path.alias("path"), mime.alias("mime"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


#: name -> pattern, tried at the place given; each becomes a boolean column
PREDICATES = {
    "bof_fixed": Signature((Frame(P.Seq(b"---\n"), BOF),)),
    "bof_offset": Signature((Frame(P.Seq(b"e"), BOF, 2, 2),)),
    "bof_window": Signature((Frame(P.Seq(b"the"), BOF, 1, 30),)),
    "bof_wild": Signature((Frame(P.Seq(b"fmt/"), BOF, 0, None),)),
    "bof_wild_min": Signature((Frame(P.Seq(b"fmt/"), BOF, 100, None),)),
    "eof_fixed": Signature((Frame(P.Seq(b"."), EOF),)),
    "eof_window": Signature((Frame(P.Seq(b"on"), EOF, 2, 25),)),
    "choice": Signature((Frame(P.Alt((P.Seq(b"The "), P.Seq(b"Die "), P.Seq(b"A"))), BOF),)),
    "list": Signature((Frame(P.Cat((P.Seq(b"Th"), P.Range(b"a", b"i"))), BOF),)),
    "negated": Signature((Frame(P.Not(P.Seq(b"The")), BOF), Frame(P.Seq(b" "), PREV))),
    "ranged": Signature((Frame(P.Range(b"The", b"Wha"), BOF),)),
    "mask": Signature((Frame(P.Mask(0x60), BOF),)),
    "any_mask": Signature((Frame(P.AnyMask(0x0A), BOF),)),
    "ignore_case": Signature((Frame(P.IgnoreCase(b"signature"), BOF, 0, 120),)),
    "masked": Signature((Frame(P.Masked(b"T\0e", b"\xff\0\xff"), BOF),)),
    "big16": Signature((Frame(P.big(0x5468, 2), BOF),)),
    "little16": Signature((Frame(P.little(0x6854, 2), BOF),)),
    "host32": Signature((Frame(P.host(0x20656854, 4), BOF),)),
    "two_runs": Signature((Frame(P.Seq(b"-"), BOF, 0, 2), Frame(P.Seq(b"filename"), PREV, 0, 8), Frame(P.Seq(b":"), EOF, 0, 3))),
}

_H = "(?:[0-9A-F]{2})"


def _hx(text: str) -> str:
    return text.encode().hex().upper()


#: the same predicates as regular expressions over the hex text of the bytes
_PREDICATE_SQL = {
    "bof_fixed": f"^{_hx('---')}0A",
    "bof_offset": f"^{_H}{{2}}{_hx('e')}",
    "bof_window": f"^{_H}{{1,30}}{_hx('the')}",
    "bof_wild": f"^{_H}*?{_hx('fmt/')}",
    "bof_wild_min": f"^{_H}{{100}}{_H}*?{_hx('fmt/')}",
    "eof_fixed": f"^{_H}*{_hx('.')}$",
    "eof_window": f"^{_H}*{_hx('on')}{_H}{{2,25}}$",
    "choice": f"^(?:{_hx('The ')}|{_hx('Die ')}|{_hx('A')})",
    "list": f"^{_hx('Th')}6[1-9]",
    "negated": f"^(?:{_hx('Th')}(?:[0-57-9A-F][0-9A-F]|6[0-46-9A-F])|{_hx('T')}(?:[0-57-9A-F][0-9A-F]|6[0-79A-F]){_H}|(?:[0-46-9A-F][0-9A-F]|5[0-35-9A-F]){_H}{{2}})20",
    "ranged": "^(?:54(?:68(?:6[5-9A-F]|[7-9A-F].)|(?:69|6[A-F]|[7-9A-F].)..)|5[56]....|57(?:[0-5].|6[0-7])..|5768(?:[0-5].|6[01]))",
    "mask": "^[67EF].",
    "any_mask": "^(?:.[2367ABEF]|.[89ABCDEF])",
    "ignore_case": f"^{_H}{{0,120}}" + "".join(f"(?:{a:02X}|{a - 32:02X})" for a in b"signature"),
    "masked": f"^54{_H}65",
    "big16": "^5468",
    "little16": "^5468",
    "host32": "^(?:20656854|54686520)",
    "two_runs": "",
}


def predicates(s, d):
    latin = F.decode(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), "ISO-8859-1")
    x = T(s, d, "documents").select("doc_id", latin.alias("t"))
    cols = []
    for name, sig in PREDICATES.items():
        hit = F.lit(True)
        for r in sig.regexes():
            hit = hit & F.col("t").rlike(r)
        cols.append(hit.alias(name))
    return x.select("doc_id", *cols)


def registry_catalogs(s, d) -> list[Catalog]:
    """A catalogue of extensions and types per namespace of the format registry."""
    by: dict[str, Catalog] = {}
    reg = T(s, d, "format_registry").where("ns is not null and ident_id is not null")
    for r in reg.select("ns", "ident_id", F.trim("mime_type").alias("mime"), F.array_distinct(F.transform("exts", lambda e: F.lower(F.trim(e)))).alias("exts")).distinct().orderBy("ns", "ident_id").collect():
        c = by.setdefault(r.ns, Catalog(r.ns, "format registry"))
        c.globs += [(r.ns, r.ident_id, "ext", e, 0, 50) for e in r.exts or [] if e]
        c.mimes += [(r.ns, r.ident_id, r.mime)] if r.mime else []
    for c in by.values():
        c.globs, c.mimes = list(dict.fromkeys(c.globs)), list(dict.fromkeys(c.mimes))
    return list(by.values())


def named_files(s, d, mimes: list[str] = ()) -> DataFrame:
    """Every file of scan_files once: file number and name as the path; the types are declared in turn, with a parameter for every other file."""
    path = F.concat_ws("/", F.col("file_no").cast("string"), F.coalesce("filename", F.lit("")))
    mime = F.lit("")
    if mimes:
        plain = F.element_at(F.array(*map(F.lit, mimes)), (F.pmod("file_no", F.lit(len(mimes))) + 1).cast("int"))
        mime = F.when(F.pmod(F.floor(F.col("file_no") / len(mimes)), F.lit(2)) == 0, plain).otherwise(F.concat(plain, F.lit("; charset=utf-8")))
    return T(s, d, "scan_files").select(path.alias("path"), mime.alias("mime")).distinct()


def registry_names(s, d) -> DataFrame:
    """Every extension hit of the registry's formats on the files."""
    return matchers.name_hits(named_files(s, d), registry_catalogs(s, d)).select("path", "ns", "id", "basis")


def registry_mimes(s, d) -> DataFrame:
    """Every hit of the registry's types on the files, declared with and without a parameter."""
    catalogs = registry_catalogs(s, d)
    return matchers.mime_hits(named_files(s, d, sorted({r[2] for c in catalogs for r in c.mimes})), catalogs).select("path", "ns", "id", "phase")


def xml_files(s, d) -> DataFrame:
    """The whole texts of documents wrapped as XML of several shapes."""
    lang = F.coalesce("lang", F.lit("none"))
    k = F.pmod("doc_id", F.lit(4))
    text = F.coalesce("text", F.lit(""))
    body = F.concat(text, F.lit("</x>"))
    xml = (
        F.when(k == 0, F.concat(F.lit('<?xml version="1.0"?>\n<!-- note -->\n<record xmlns="urn:'), lang, F.lit('" a="1">'), body))
        .when(k == 1, F.concat(F.lit("<record>"), body))
        .when(k == 2, F.concat(F.lit('<m:feed xmlns:m="urn:'), lang, F.lit('">'), body))
        .otherwise(F.concat(F.lit("this is not xml"), text))
    )
    return T(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("").alias("mime"), F.encode(xml, "UTF-8").alias("content"))


def xml_catalog() -> Catalog:
    return Catalog("x", xmls=[("x", "x/1", "record", ""), ("x", "x/2", "record", "urn:en"), ("x", "x/3", "", "urn:de"), ("x", "x/4", "feed", "urn:en")])


def notation(s, d) -> DataFrame:
    """Every distinct byte sequence of the format reports compiled at its place: position, low, high, value, n_frames, least, sound, regexes (as a hash)."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    places = {"position": "b.position_type", "low": "b.min_offset", "high": "b.max_offset", "value": "b.hex_value"}
    seqs = T(s, d, "report_snapshots").select(F.explode("signatures").alias("s")).select(F.explode("s.byte_sequences").alias("b")).select(*(text(F.col(c)).alias(n) for n, c in places.items())).where("value != ''").distinct()
    x = registry.compile_notation(seqs.withColumn("key", F.to_json(F.struct(*places))), "key", "position", "low", "high", "value")
    back = F.from_json("key", ", ".join(f"{n} string" for n in places)).alias("k")
    return x.select(back, "n_frames", "least", F.col("error").isNull().alias("sound"), F.md5(F.array_join("regexes", "\n")).alias("regexes")).select("k.*", "n_frames", "least", "sound", "regexes")


def mode_query(mode: str):
    return lambda s, d: identify(doc_files(s, d), [demo()], mode).select("path", "rank", "id", "confidence", "basis", "warning")


#: Signatures of ``many``, besides those of ``demo``.
N_MANY = 2000


def many() -> Catalog:
    """The demo catalogue and a signature for every number of four digits below ``N_MANY``: anywhere, near the beginning, near the end, behind 50 bytes."""
    c = demo()
    frames = ((BOF, 0, None), (BOF, 0, 200), (EOF, 0, 60), (BOF, 50, None))
    c.signatures = c.signatures + [(NS, f"n/{k:04}", Signature((Frame(P.Seq(f"{k:04}".encode()), *frames[k % 4]),)), 0) for k in range(N_MANY)]
    return c


def numbers() -> Catalog:
    """The signatures of numbers alone."""
    c = many()
    return Catalog(NS, signatures=[r for r in c.signatures if r[1].startswith("n/")])


def scanned(s, d) -> DataFrame:
    """Every document written to a file of its own, and the folder scanned."""
    path = shared_path(s, "files")
    T(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("value")).where("doc_id is not null").write.partitionBy("doc_id").text(path)
    x = files.scan(s, path, glob="*.txt")
    return x.select(F.regexp_extract("path", r"doc_id=(\d+)/", 1).cast("bigint").alias("doc_id"), "length", F.md5("content").alias("md5"), F.coalesce("error", F.lit("")).alias("error"))


def library_demo() -> Catalog:
    """A catalogue under the library's rules: l/1 owns a RIFF code, l/2 only a container signature, which rules nothing out there."""
    parts = [("loc", "l/2", "ZIP", 1, 1, "mimetype", False, ())]
    return Catalog("loc", globs=[("loc", i, "ext", "riff", 0, 50) for i in ("l/1", "l/2")], fourccs=[("loc", "l/1", "bext")], containers=[("loc", "l/2", "ZIP", 1, 1, 1)], parts=parts)


def library_files(s, d) -> DataFrame:
    """Every document in a RIFF file of its own."""
    from sigloom.plans.resultsets import packed_files

    return packed_files(s, d, "riff").withColumn("mime", F.lit(""))


def saved_catalog(s, d) -> DataFrame:
    """Identification with a catalogue that was saved and loaded again."""
    path = shared_path(s, "catalogue")
    demo().save(s, path)
    return identify(doc_files(s, d), [load(s, path)]).select("path", "rank", "id", "confidence", "basis", "warning")


def written_results(s, d) -> DataFrame:
    """Files scanned, identified, written in three layouts as part files and read back: layout, filename, filesize, format, ids, known."""
    files = doc_files(s, d).withColumn("length", F.octet_length("content").cast("bigint"))
    infos = demo().frames(s)["infos"]
    found = cut(results.from_identification(files, identify(files, [demo()]), infos))
    out = []
    for name in ("csv", "yaml", "json"):
        path = shared_path(s, name)
        head = {"signature": "demo"}
        {"csv": lambda p: results.write_csv(found, [NS], p), "yaml": lambda p: results.write_yaml(found, head, [(NS, "demo")], p), "json": lambda p: results.write_json(found, head, p)}[name](path)
        back = results.read(s, path)
        ids = F.array_join(F.array_sort(F.transform("matches", lambda m: m["id"])), ";")
        out.append(back.select(F.lit(name).alias("layout"), "filename", "filesize", F.array_join(F.array_sort(F.transform("matches", lambda m: m["format"])), ";").alias("format"), ids.alias("ids"), results.is_known(F.col("matches")).alias("known"), "errors"))
    return reduce(DataFrame.unionByName, out)


def glob_files(s, d) -> DataFrame:
    """scan_files' names, some of them shaped for the globs."""
    name = F.when(F.pmod("file_no", F.lit(5)) == 0, F.concat(F.lit("a/README-"), F.col("file_no").cast("string"))).when(F.pmod("file_no", F.lit(5)) == 1, F.concat(F.lit("b\\x"), F.col("file_no").cast("string"), F.lit(".note"))).otherwise(F.coalesce("filename", F.lit("")))
    return T(s, d, "scan_files").groupBy("file_no").agg(F.max("filename").alias("filename")).select(name.alias("path"))


def mime_demo() -> Catalog:
    """The demo catalogue under the rules of MIME-info, with weights."""
    c = demo()
    name = {"d/1": "application/yaml", "d/2": "text/x-note", "d/3": "text/x-log", "d/4": "text/x-german", "d/5": "text/plain"}
    move = lambda rel: [("mimeinfo", name[r[1]], *r[2:]) for r in rel]
    return Catalog("mimeinfo", infos=move(c.infos), globs=move(c.globs), mimes=[("mimeinfo", m, m) for m in name.values()], texts=move(c.texts), signatures=[("mimeinfo", name[i], sig, w) for (_, i, sig, _), w in zip(c.signatures, (50, 60, 40, 40, 50))])


def queries():
    return {
        "name_normalise": lambda s, d: T(s, d, "scan_files").select("file_no", scalars.base_name(F.col("filename")).alias("base"), scalars.extension(scalars.base_name(F.col("filename"))).alias("ext")).distinct(),
        "name_ext_match": registry_names,
        "name_glob_first": lambda s, d: matchers.name_hits(glob_files(s, d), [demo()]).where("phase = 1").select("path", "id", "basis"),
        "mime_match": registry_mimes,
        "byte_predicates": predicates,
        "byte_hits": lambda s, d: matchers.byte_hits(doc_files(s, d), [demo()]).select("path", "id", "sig_no", "sig_total", "phase", "offset"),
        "byte_basis": lambda s, d: matchers.byte_hits(doc_files(s, d), [demo()]).select("path", "id", "sig_no", "basis"),
        "byte_basis_many": lambda s, d: matchers.byte_hits(doc_files(s, d), [many()]).select("path", "id", "sig_no", "offset", "basis"),
        "byte_limits": lambda s, d: matchers.byte_hits(doc_files(s, d), [numbers().scan_limits(100, 50)]).select("path", "id", "offset", "basis"),
        "files_scan": scanned,
        "byte_notation": notation,
        "catalog_saved": saved_catalog,
        "results_written": written_results,
        "identify_gated": lambda s, d: gated(matchers.all_hits(doc_files(s, d), [demo()]), [demo()]).where("id is not null").select("path", "id", "matcher", "sig_no", "phase", "offset", "basis"),
        "identify_loc": lambda s, d: identify(library_files(s, d), [library_demo()]).select("path", "rank", "id", "confidence", "basis", "warning"),
        "text_class": lambda s, d: T(s, d, "documents").select("doc_id", scalars.text_class(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("class")),
        "xml_root": lambda s, d: matchers.xml_hits(xml_files(s, d), [xml_catalog()]).select("path", "id", "phase"),
        "score_aggregate": lambda s, d: scored(matchers.all_hits(doc_files(s, d), [demo()])).select("path", "id", "confidence", "has_ext", "has_mime", "has_text", "has_strong", "basis"),
        "waitset_fold": lambda s, d: waiting(matchers.all_hits(doc_files(s, d), [demo()]), [demo()]).where("id is not null").select("path", "id", "matcher", "sig_no", "phase"),
        **{f"identify_{m}": mode_query(m) for m in ("single", "conclusive", "positive", "comprehensive", "exhaustive", "droid")},
        "identify_summary": lambda s, d: identify(doc_files(s, d), [demo()]).groupBy("id", "warning").agg(F.count("*").alias("n")),
        "identify_ordered": lambda s, d: identify(doc_files(s, d), [demo()], "conclusive", "ordered").select("path", "rank", "id", "confidence", "basis", "warning"),
        "mimeinfo_rank": lambda s, d: resolve_mime(matchers.all_hits(spread(doc_files(s, d)), [mime_demo()]), [mime_demo()]).select("path", "rank", "id", "warning"),
    }


_EXT = "split_part('" + ",".join(EXTENSIONS) + "', ',', CAST(doc_id % 7 + 1 AS INTEGER))"
_BASE = r"regexp_extract(regexp_replace(coalesce(filename, ''), '[/\\]+$', ''), '[^/\\]*$')"
_FILES = f"""
files AS (SELECT 'docs/' || doc_id || CASE WHEN {_EXT} = '' THEN '' ELSE '.' || {_EXT} END AS path, {_EXT} AS ext,
  CASE WHEN doc_id % 3 = 0 THEN 'text/plain; charset=utf-8' WHEN doc_id % 11 = 1 THEN 'application/yaml' ELSE '' END AS mime,
  coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS size FROM documents)
"""
_CASED = "".join(f"(?:{a:02X}|{a - 32:02X})" for a in b"signature")
_BYTES = rf"""
{_FILES},
found AS (
  SELECT path, 'd/1' AS id, 1 AS sig_no, 2 AS sig_total, 1 AS phase, 12 AS "offset", '0, 12' AS place FROM files WHERE starts_with(t, '---' || chr(10) || 'filename')
  UNION ALL SELECT path, 'd/1', 2, 2, 3, g + 9, '[[0 3] [' || (size - g - 9) || ' 9]]' FROM (SELECT path, size, length(regexp_extract(h, '{_hx("warning :")}((?:..){{0,2}})$', 1)) // 2 AS g FROM files WHERE starts_with(t, '---') AND regexp_matches(h, '^(?:..)*{_hx("warning :")}(?:..){{0,2}}$'))
  UNION ALL SELECT path, 'd/2', 1, 1, 4, g + 4, g || ', 4' FROM (SELECT path, octet_length(encode(t[1:position('fmt/' IN t) - 1])) AS g FROM files WHERE contains(t, 'fmt/'))
  UNION ALL SELECT path, 'd/3', 1, 1, 1, g + 9, g || ', 9' FROM (SELECT path, length(regexp_extract(h, '^((?:..){{0,120}}?)(?:{_CASED})', 1)) // 2 AS g FROM files WHERE regexp_matches(h, '{_PREDICATE_SQL["ignore_case"]}'))
  UNION ALL SELECT path, 'd/4', 1, 1, 1, g + 5, '0, ' || g + 5 FROM (SELECT path, length(regexp_extract(h, '^(?:..){{4}}((?:..){{0,40}}?){_hx("e")}', 1)) // 2 AS g FROM files WHERE regexp_matches(h, '^(?:{_hx("Die ")}|{_hx("Das ")}){_H}{{0,40}}{_hx("e")}'))),
bytes AS (SELECT path, id, sig_no, sig_total, phase, CAST("offset" AS BIGINT) AS "offset", 'byte match at ' || place || CASE WHEN sig_total > 1 THEN ' (signature ' || sig_no || '/' || sig_total || ')' ELSE '' END AS basis FROM found)
"""
_CLASS = r"""CASE WHEN t = '' THEN 'data' WHEN starts_with(t, chr(65279)) THEN 'UTF-8 Unicode (with BOM)'
  WHEN regexp_matches(h[1:8192], '^(?:..)*?(?:0[0-6EF]|1[0-9ACDEF]|7F)') THEN 'data' WHEN regexp_matches(h[1:8192], '^(?:..)*?[89A-F].') THEN 'UTF-8 Unicode' ELSE 'ASCII' END"""
_HITS = rf"""
{_BYTES},
exts AS (SELECT * FROM (VALUES ('d/1', 'yaml'), ('d/1', 'yml'), ('d/2', 'md'), ('d/3', 'log'), ('d/4', 'txt'), ('d/5', 'txt'), ('d/5', 'text')) AS v(id, ext)),
mimes AS (SELECT * FROM (VALUES ('d/1', 'application/yaml'), ('d/2', 'text/x-note'), ('d/3', 'text/x-note'), ('d/4', 'text/plain'), ('d/5', 'text/plain')) AS v(id, mime)),
hits AS (
  SELECT path, id, 0 AS matcher, 0 AS sig_no, 0 AS phase, 0 AS "offset", 'extension match ' || ext AS basis FROM files JOIN exts USING (ext)
  UNION ALL SELECT path, m.id, 1, 0, CASE WHEN contains(f.mime, ';') THEN 1 ELSE 0 END, 0, 'mime match ' || m.mime FROM files f JOIN mimes m ON regexp_replace(f.mime, ';[^;]*$', '') = m.mime
  UNION ALL SELECT path, id, 5, sig_no, phase, "offset", basis FROM bytes
  UNION ALL SELECT path, 'd/5', 6, 0, 0, 0, 'text match ' || class FROM (SELECT path, {_CLASS} AS class FROM files) WHERE class != 'data'),
gated AS (SELECT * FROM hits WHERE matcher != 6 OR path NOT IN (SELECT path FROM hits WHERE matcher = 5) AND (path NOT IN (SELECT path FROM hits WHERE matcher < 2) OR path IN (SELECT path FROM hits WHERE matcher < 2 AND id = 'd/5')))
"""
_PRIO = "prio AS (SELECT * FROM (VALUES ('d/2', 'd/1'), ('d/3', 'd/2'), ('d/3', 'd/1')) AS v(sub, sup))"


def _kept(dominance: str | None, base: str) -> str:
    """The hits that dominance leaves: by set, by the order of the hits (a fold, hit by hit), or all."""
    if dominance == "set":
        return f"kept AS (SELECT h.* FROM {base} h WHERE NOT EXISTS (SELECT 1 FROM {base} o JOIN prio p ON o.id = p.sup WHERE o.path = h.path AND p.sub = h.id))"
    if dominance is None:
        return f"kept AS (SELECT * FROM {base})"
    return f"""ord AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY matcher, phase, "offset", sig_no, id) AS rn FROM {base} WHERE matcher = 5),
    weak_ids AS (SELECT path, list(DISTINCT id) AS weak FROM {base} WHERE matcher < 2 GROUP BY path), sups AS (SELECT sub AS id, list(sup) AS sups FROM prio GROUP BY sub),
    ready AS (SELECT o.path, o.rn, o.id, coalesce(sups, []::VARCHAR[]) AS sups, coalesce(weak, []::VARCHAR[]) AS weak FROM ord o LEFT JOIN sups USING (id) LEFT JOIN weak_ids w ON w.path = o.path),
    fold(path, n, wait, this, taken) AS (SELECT DISTINCT path, 0::BIGINT, NULL::VARCHAR[], '', false FROM ord
      UNION ALL SELECT path, rn, CASE WHEN k THEN sups ELSE wait END, CASE WHEN k THEN id ELSE this END, k FROM (SELECT f.path, r.rn, r.id, sups, wait, this, wait IS NULL OR list_contains(wait, r.id) OR (list_contains(weak, r.id) AND NOT list_contains(sups, this)) AS k
        FROM fold f JOIN ready r ON r.path = f.path AND r.rn = f.n + 1)),
    kept AS (SELECT * FROM {base} WHERE matcher != 5 UNION ALL SELECT o.* EXCLUDE (rn) FROM ord o JOIN fold f ON f.path = o.path AND f.n = o.rn WHERE taken)"""


def _scored(dominance: str | None, base: str = "hits") -> str:
    return f"""{_HITS}, {_PRIO}, {_kept(dominance, base)},
    each1 AS (SELECT *, CASE matcher WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 6 THEN 4 ELSE 8 * row_number() OVER (PARTITION BY path, matcher NOT IN (0, 1, 6) ORDER BY matcher, phase, "offset", sig_no, id) END AS score FROM kept),
    scored AS (SELECT path, id, CAST(sum(score) AS INTEGER) AS confidence, bool_or(matcher = 0) AS has_ext, bool_or(matcher = 1) AS has_mime, bool_or(matcher = 6) AS has_text, bool_or(matcher = 5) AS has_strong,
      array_to_string(list(basis ORDER BY matcher, phase, "offset", sig_no, id, basis), '; ') AS basis FROM each1 GROUP BY path, id)"""


def _mode(mode: str, dominance: str = "set") -> str:
    cut = {"single": "rn = 1", "conclusive": "confidence = top", "positive": "confidence >= 8 OR rn = 1", "comprehensive": "confidence >= 8 OR rn = 1", "exhaustive": "true", "droid": "confidence >= 8 OR rn = 1"}[mode]
    weak = "false" if mode == "exhaustive" else "top <= 4"
    words = lambda a, b, c: f"(SELECT CASE len(l) WHEN 0 THEN '' WHEN 1 THEN l[1] ELSE array_to_string(l[1:len(l) - 1], ', ') || ' and ' || l[-1] END FROM (SELECT list_filter([CASE WHEN {a} THEN 'extension' END, CASE WHEN {b} THEN 'MIME' END, CASE WHEN {c} THEN 'text' END], lambda x: x IS NOT NULL) AS l))"
    last = "cut1 c WHERE NOT EXISTS (SELECT 1 FROM cut1 o JOIN prio p ON o.id = p.sup WHERE o.path = c.path AND p.sub = c.id)" if mode == "droid" else "cut1"
    return f"""WITH RECURSIVE {_scored(dominance if mode in ("single", "conclusive", "positive") else None, "hits" if mode in ("comprehensive", "exhaustive") else "gated")},
    ranked AS (SELECT *, max(confidence) OVER w AS top, row_number() OVER (PARTITION BY path ORDER BY confidence DESC, id) AS rn, bool_or(has_ext) OVER w AS e, bool_or(has_mime) OVER w AS m, bool_or(has_text) OVER w AS x FROM scored WINDOW w AS (PARTITION BY path)),
    listed AS (SELECT path, array_to_string(list(id ORDER BY rn), ', ') AS ids, array_to_string(list(id ORDER BY rn) FILTER (WHERE confidence = top), ', ') AS tops, count(*) FILTER (WHERE confidence = top) AS n_top,
      count(*) FILTER (WHERE (top <= 2 OR confidence = top) AND NOT (id = 'd/5' AND top < 4) AND id = 'd/5') AS n_fit FROM ranked GROUP BY path),
    judged AS (SELECT r.*, l.ids, l.tops, {weak} AS weak, {weak} AND n_fit != 1 AS lost, {"NOT (" + weak + ") AND n_top > 1" if mode == "single" else "false"} AS tied,
      (top <= 2 OR confidence = top) AND NOT (id = 'd/5' AND top < 4) AND id = 'd/5' AS fits, {words("e", "m", "x")} AS kinds FROM ranked r JOIN listed l USING (path)),
    cut1 AS (SELECT * FROM judged WHERE CASE WHEN lost OR tied THEN rn = 1 WHEN weak THEN fits ELSE {cut} END),
    final AS (SELECT * FROM {last})
    SELECT f.path, CAST(coalesce(row_number() OVER (PARTITION BY f.path ORDER BY rn), 1) AS INTEGER) AS rank, CASE WHEN id IS NULL OR lost OR tied THEN 'UNKNOWN' ELSE id END AS id,
      CASE WHEN id IS NULL OR lost OR tied THEN 0 ELSE confidence END AS confidence, CASE WHEN id IS NULL OR lost OR tied THEN '' ELSE basis END AS basis,
      CASE WHEN id IS NULL THEN 'no match' WHEN lost THEN 'no match; possibilities based on ' || kinds || ' are ' || ids WHEN tied THEN 'multiple matches ' || tops
        ELSE concat_ws('; ', CASE WHEN confidence <= 4 THEN 'match on ' || {words("has_ext", "has_mime", "has_text")} || ' only' END, CASE WHEN NOT has_ext THEN 'extension mismatch' END, CASE WHEN NOT has_mime AND mime != '' THEN 'MIME mismatch' END) END AS warning
    FROM files f LEFT JOIN final c ON f.path = c.path"""


def oracle_sql():
    two_runs = f"regexp_matches(h, '^{_H}{{0,2}}{_hx('-')}{_H}{{0,8}}{_hx('filename')}') AND regexp_matches(h, '^{_H}*{_hx(':')}{_H}{{0,3}}$')"
    pred = ", ".join(f"regexp_matches(h, '{r}') AS {n}" if r else f"{two_runs} AS {n}" for n, r in _PREDICATE_SQL.items())
    return {
        "name_normalise": f"SELECT DISTINCT file_no, {_BASE} AS base, lower(regexp_extract({_BASE}, '\\.([^.]*)$', 1)) AS ext FROM scan_files",
        "name_ext_match": f"""WITH f AS (SELECT DISTINCT CAST(file_no AS VARCHAR) || '/' || coalesce(filename, '') AS path FROM scan_files),
            n AS (SELECT path, lower(regexp_extract({_BASE.replace("filename", "path")}, '\\.([^.]*)$', 1)) AS ext FROM f),
            e AS (SELECT DISTINCT ns, ident_id AS id, lower(trim(unnest(exts))) AS ext FROM format_registry WHERE ns IS NOT NULL AND ident_id IS NOT NULL)
            SELECT path, ns, id, 'extension match ' || ext AS basis FROM n JOIN e USING (ext) WHERE ext != ''""",
        "name_glob_first": f"""WITH n AS (SELECT file_no, max(filename) AS filename FROM scan_files GROUP BY 1), p AS (SELECT CASE file_no % 5 WHEN 0 THEN 'a/README-' || file_no WHEN 1 THEN 'b\\x' || file_no || '.note' ELSE coalesce(filename, '') END AS path FROM n),
            b AS (SELECT path, {_BASE.replace('filename', 'path')} AS base FROM p)
            SELECT path, CASE WHEN starts_with(base, 'README') THEN 'd/2' ELSE 'd/3' END AS id, CASE WHEN starts_with(base, 'README') THEN 'glob match README*' ELSE 'glob match *[13579].n?te' END AS basis
            FROM b WHERE starts_with(base, 'README') OR regexp_full_match(base, '.*[13579]\\.n.te')""",
        "mime_match": """WITH r AS (SELECT DISTINCT ns, ident_id AS id, trim(mime_type) AS mime FROM format_registry WHERE ns IS NOT NULL AND ident_id IS NOT NULL AND trim(mime_type) != ''),
            m AS (SELECT list_sort(list(DISTINCT mime)) AS all_mimes FROM r), named AS (SELECT DISTINCT file_no, CAST(file_no AS VARCHAR) || '/' || coalesce(filename, '') AS path FROM scan_files),
            f AS (SELECT path, all_mimes[CAST(file_no % len(all_mimes) + 1 AS INTEGER)] AS mime, (file_no // len(all_mimes)) % 2 AS phase FROM named, m)
            SELECT path, ns, id, CAST(phase AS INTEGER) AS phase FROM f JOIN r USING (mime)""",
        "byte_predicates": f"WITH x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents) SELECT doc_id, {pred} FROM x",
        "byte_hits": f"WITH {_BYTES} SELECT path, id, sig_no, sig_total, phase, \"offset\" FROM bytes",
        "byte_basis": f"WITH {_BYTES} SELECT path, id, sig_no, basis FROM bytes",
        "byte_basis_many": rf"""WITH {_BYTES}, k AS (SELECT unnest(range({N_MANY})) AS k), m AS (SELECT k, hex(encode(lpad(CAST(k AS VARCHAR), 4, '0'))) AS lit FROM k),
            c AS (SELECT path, size, k, lit, CASE k % 4 WHEN 2 THEN greatest(size - 64, 0) WHEN 3 THEN 50 ELSE 0 END AS low, h FROM files JOIN m ON contains(h, lit)),
            p AS (SELECT *, CASE WHEN regexp_matches(h[low * 2 + 1:], '^(?:..)*?' || lit) THEN low + length(regexp_extract(h[low * 2 + 1:], '^((?:..)*?)' || lit, 1)) // 2 END AS place FROM c)
            SELECT path, id, sig_no, "offset", basis FROM bytes
            UNION ALL SELECT path, 'n/' || lpad(CAST(k AS VARCHAR), 4, '0'), 1, CASE WHEN k % 4 = 2 THEN size - place ELSE place + 4 END, 'byte match at ' || place || ', 4' FROM p WHERE place IS NOT NULL AND (k % 4 != 1 OR place <= 200)""",
        "catalog_saved": _mode("conclusive"),
        "results_written": f"""WITH r AS ({_mode("conclusive")}), g AS (SELECT path, array_to_string(list_sort(list(id)), ';') AS ids, array_to_string(list_sort(list(CASE id WHEN 'd/1' THEN 'Results' WHEN 'd/2' THEN 'Registry note' WHEN 'd/3' THEN 'Signature note' WHEN 'd/4' THEN 'German text' WHEN 'd/5' THEN 'Plain text' ELSE '' END)), ';') AS format FROM r GROUP BY path),
            {_FILES.strip()} SELECT l.layout, path AS filename, CAST(size AS BIGINT) AS filesize, format, ids, ids != 'UNKNOWN' AS known, '' AS errors FROM g JOIN files USING (path), (VALUES ('csv'), ('yaml'), ('json')) AS l(layout)""",
        "byte_limits": rf"""WITH {_FILES}, k AS (SELECT unnest(range({N_MANY})) AS k), m AS (SELECT k, hex(encode(lpad(CAST(k AS VARCHAR), 4, '0'))) AS lit FROM k),
            c AS (SELECT path, size, k, lit, CASE k % 4 WHEN 2 THEN greatest(size - 54, 0) WHEN 3 THEN 50 ELSE 0 END AS low, h FROM files JOIN m ON contains(h, lit)),
            p AS (SELECT *, low + length(regexp_extract(h[low * 2 + 1:], '^((?:..)*?)' || lit, 1)) // 2 AS place FROM c WHERE regexp_matches(h[low * 2 + 1:], '^(?:..)*?' || lit))
            SELECT path, 'n/' || lpad(CAST(k AS VARCHAR), 4, '0') AS id, CAST(CASE WHEN k % 4 = 2 THEN size - place ELSE place + 4 END AS BIGINT) AS "offset", 'byte match at ' || place || ', 4' AS basis FROM p WHERE k % 4 = 2 OR place <= 100""",
        "files_scan": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS length, md5(coalesce(text, '') || chr(10)) AS md5, '' AS error FROM documents",
        "identify_gated": f'WITH {_HITS} SELECT path, id, matcher, sig_no, phase, CAST("offset" AS BIGINT) AS "offset", basis FROM gated',
        "identify_loc": """SELECT doc_id || '.riff' AS path, 1 AS rank, CASE WHEN doc_id % 2 = 1 THEN 'l/1' ELSE 'l/2' END AS id, CASE WHEN doc_id % 2 = 1 THEN 9 ELSE 1 END AS confidence,
            CASE WHEN doc_id % 2 = 1 THEN 'extension match riff; fourCC matches bext' ELSE 'extension match riff' END AS basis, CASE WHEN doc_id % 2 = 1 THEN '' ELSE 'match on extension only' END AS warning FROM documents""",
        "text_class": f"WITH x AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents) SELECT doc_id, {_CLASS} AS class FROM x",
        "xml_root": """WITH k AS (SELECT CAST(doc_id AS VARCHAR) AS path, doc_id % 4 AS k, 'urn:' || coalesce(lang, 'none') AS ns FROM documents)
            SELECT path, 'x/1' AS id, CASE WHEN k = 0 THEN 1 ELSE 0 END AS phase FROM k WHERE k IN (0, 1)
            UNION ALL SELECT path, 'x/2', 0 FROM k WHERE k = 0 AND ns = 'urn:en' UNION ALL SELECT path, 'x/3', 2 FROM k WHERE k IN (0, 2) AND ns = 'urn:de' UNION ALL SELECT path, 'x/4', 0 FROM k WHERE k = 2 AND ns = 'urn:en'""",
        "score_aggregate": f"WITH {_scored(None)} SELECT * FROM scored",
        "waitset_fold": f"WITH RECURSIVE {_HITS}, {_PRIO}, {_kept('ordered', 'hits')} SELECT path, id, matcher, sig_no, phase FROM kept",
        "identify_ordered": _mode("conclusive", "ordered"),
        **{f"identify_{m}": _mode(m) for m in ("single", "conclusive", "positive", "comprehensive", "exhaustive", "droid")},
        "mimeinfo_rank": f"""WITH {_HITS},
            named AS (SELECT path, CASE id WHEN 'd/1' THEN 'application/yaml' WHEN 'd/2' THEN 'text/x-note' WHEN 'd/3' THEN 'text/x-log' WHEN 'd/4' THEN 'text/x-german' ELSE 'text/plain' END AS id, matcher,
                CASE WHEN id = 'd/1' AND sig_no = 2 THEN 60 WHEN id IN ('d/2', 'd/3') THEN 40 ELSE 50 END AS weight FROM hits WHERE matcher != 1 AND NOT (matcher = 6 AND path IN (SELECT path FROM bytes))
              UNION ALL SELECT path, regexp_replace(mime, ';[^;]*$', ''), 1, 0 FROM files WHERE mime != ''),
            cand AS (SELECT path, id, bool_or(matcher = 1) AS m, bool_or(matcher = 6) AS x, coalesce(max(weight) FILTER (WHERE matcher = 5), 0) AS magic, CASE WHEN bool_or(matcher = 0) THEN 50 ELSE 0 END AS glob_w FROM named GROUP BY path, id),
            keyed AS (SELECT *, [CAST((m AND magic > 0) OR (magic > 0 AND glob_w > 0) OR (m AND x) OR (x AND glob_w > 0) AS INTEGER), magic, CAST(m AS INTEGER), glob_w, CAST(x AS INTEGER), CAST(x AND id = 'text/plain' AS INTEGER)] AS k FROM cand),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY k DESC, id) AS rn, max(k) OVER (PARTITION BY path) AS best FROM keyed),
            per AS (SELECT path, max(k) FILTER (WHERE rn = 2) AS second, array_to_string(list(id ORDER BY rn), ', ') AS ids FROM ranked GROUP BY path),
            judged AS (SELECT r.*, ids, best[2] = 0 AS weak, bool_or(rn = 1 AND best[2] = 0 AND (NOT (second IS NULL OR best > second) OR (id = 'text/plain' AND NOT x))) OVER (PARTITION BY r.path) AS lost FROM ranked r JOIN per USING (path)),
            kept AS (SELECT * FROM judged WHERE CASE WHEN lost OR weak THEN rn = 1 ELSE k = best END)
            SELECT f.path, CAST(coalesce(rn, 1) AS INTEGER) AS rank, CASE WHEN id IS NULL OR lost THEN 'UNKNOWN' ELSE id END AS id,
              CASE WHEN id IS NULL THEN 'no match' WHEN lost THEN 'no match; possibilities are ' || ids ELSE concat_ws('; ',
                CASE WHEN magic = 0 THEN 'match on ' || (SELECT CASE len(l) WHEN 0 THEN '' WHEN 1 THEN l[1] ELSE array_to_string(l[1:len(l) - 1], ', ') || ' and ' || l[-1] END
                  FROM (SELECT list_filter([CASE WHEN glob_w > 0 THEN 'filename' END, CASE WHEN m THEN 'MIME' END, CASE WHEN x THEN 'text' END], lambda y: y IS NOT NULL) AS l)) || ' only' || CASE WHEN id != 'text/plain' THEN '; byte/xml signatures for this format did not match' ELSE '' END END,
                CASE WHEN glob_w = 0 THEN 'filename mismatch' END, CASE WHEN NOT m AND mime != '' THEN 'MIME mismatch' END) END AS warning
            FROM files f LEFT JOIN kept k ON f.path = k.path""",
        "identify_summary": f"SELECT id, warning, count(*) AS n FROM ({_mode('conclusive')}) GROUP BY id, warning",
    }
