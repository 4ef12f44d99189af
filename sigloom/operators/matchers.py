"""The matchers: files with a catalogue give hits.

A file is a row (path, mime, content). ``name_hits`` and ``mime_hits`` are joins
for tables of names and types alone. Everything else looks at the content, so
``all_hits`` is one Arrow pass over the files for all matchers and namespaces:
each content is read and handed to Python once, and only hits come back. It
never crosses a shuffle. Byte signatures are candidates by their key (a dict
lookup on a slice at a fixed place, or a multi-pattern automaton over the part
that can hold it), and only candidates meet their regular expressions, within
the bytes these can reach.

The catalogue is broadcast: its rows are counted on the driver, where it is
built, and beyond ``MAX_SIGNATURES`` byte signatures it goes in several passes.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.scalars import base_name, extension, text_class_of
from sigloom.sources import archives
from sigloom.sources.catalog import RELATIONS, Catalog

#: Catalogue rows up to which a relation is broadcast.
MAX_SIGNATURES = 200_000
#: path, ns, id, matcher (rank of the matcher), sig_no, sig_total, phase, offset, basis
HITS = ("path", "ns", "id", "matcher", "sig_no", "sig_total", "phase", "offset", "basis")
#: Rank of each matcher, the order in which hits are counted. FILE marks the row that stands for the file itself.
NAME, MIME, CONTAINER, XML, RIFF, BYTE, TEXT = range(7)
FILE = -1
MATCHERS = (NAME, MIME, CONTAINER, XML, RIFF, BYTE, TEXT)


def relation(df: DataFrame, catalogs: list[Catalog], name: str) -> DataFrame:
    """A relation of all namespaces, broadcast when it is small enough."""
    rows = [tuple(r) for c in catalogs for r in c.rows(name)]
    out = df.sparkSession.createDataFrame(rows, f"ns string, id string, {RELATIONS[name]}")
    return F.broadcast(out) if len(rows) <= MAX_SIGNATURES else out


def _hits(df: DataFrame, matcher: int, basis: Column, sig_no=0, sig_total=1, phase=0, offset=0) -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select("path", "ns", "id", F.lit(matcher).alias("matcher"), as_col(sig_no).cast("int").alias("sig_no"), as_col(sig_total).cast("int").alias("sig_total"), as_col(phase).cast("int").alias("phase"), as_col(offset).cast("bigint").alias("offset"), basis.alias("basis"))


def glob_regex(pattern: str) -> str:
    """A file glob as an anchored regex: * and ? stay within a name, [..] and [^..] are classes, \\ escapes. Broken globs match nothing."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            i += 1
            if i == len(pattern):
                return "(?!)"
            out += re.escape(pattern[i])
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                return "(?!)"
            body = pattern[i + 1 : end]
            out += "[" + ("^" if body[0] == "^" else "") + re.sub(r"([\[&\\])", r"\\\1", body.lstrip("^")) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return rf"(?s)\A{out}\z"


def name_hits(files: DataFrame, catalogs: list[Catalog]) -> DataFrame:
    """Extension equi-join, and the first glob in catalogue order with all ids on it."""
    named = files.select("path", base_name(F.col("path")).alias("_base")).withColumn("_ext", extension(F.col("_base")))
    globs = relation(files, catalogs, "globs")
    ext = named.where("_ext != ''").join(globs.where("kind = 'ext'"), F.col("_ext") == F.col("pattern"))
    out = _hits(ext, NAME, F.concat(F.lit("extension match "), F.col("pattern")))
    patterns = list(dict.fromkeys((r[4], r[3]) for c in catalogs for r in c.globs if r[2] == "glob"))
    if not patterns:
        return out
    ladder = F.lit(None).cast("string")
    for _, p in sorted(patterns, reverse=True):
        ladder = F.when(F.col("_base").rlike(glob_regex(p)), p).otherwise(ladder)
    first = named.withColumn("_glob", ladder).where("_glob is not null").join(globs.where("kind = 'glob'"), F.col("_glob") == F.col("pattern"))
    return out.unionByName(_hits(first, NAME, F.concat(F.lit("glob match "), F.col("pattern")), phase=1))


def mime_hits(files: DataFrame, catalogs: list[Catalog]) -> DataFrame:
    """Two equi-joins: the whole declared type, then the type before its last parameter."""
    bare = F.regexp_replace("mime", ";[^;]*$", "")
    keys = F.when(F.contains("mime", F.lit(";")), F.array("mime", bare)).otherwise(F.array("mime"))
    x = files.where("mime is not null and mime != ''").select("path", F.posexplode(keys).alias("_p", "_mime"))
    y = x.join(relation(files, catalogs, "mimes").withColumnRenamed("mime", "_m"), F.col("_mime") == F.col("_m"))
    return _hits(y, MIME, F.concat(F.lit("mime match "), F.col("_m")), phase=F.col("_p"))


#: What may stand before the root of an XML text; possessive, so that it takes no stack however long it is. Brackets in quotes, comments and
#: instructions of a document type do not end it.
_QUOTED = r"\"[^\"]*+\"|'[^']*+'"
_PROLOG = rf"(?:\s++|<\?.*?\?>|<!--.*?-->|<!DOCTYPE(?:[^\[>\"']++|{_QUOTED}|\[(?:[^\]\"'<]++|{_QUOTED}|<!--.*?-->|<\?.*?\?>|<)*+\])*+>)*+"
_ROOT = re.compile(rf"(?sa){_PROLOG}<([A-Za-z_][^\s/>]*)((?:\s(?:[^>\"']++|{_QUOTED})*+)?)/?>")
#: How the first bytes of a text tell its encoding.
_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def xml_text(content: bytes) -> str | None:
    """The text of a content that may be XML: by its byte order mark, by the zeros beside its first bracket, else UTF-8."""
    for mark, name in _MARKS:
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace")
    if content[:2] in (b"<\0", b"\0<"):
        return content.decode("utf-16-le" if content[:1] == b"<" else "utf-16-be", "replace")
    return content.decode("utf-8", "replace") if content[:1024].lstrip()[:1] in (b"<", b"") else None


def xml_root(content: bytes) -> tuple[str, str] | None:
    """(root, xmlns) of the first element of an XML text."""
    text = xml_text(content)
    m = _ROOT.match(text) if text else None
    if m is None:
        return None
    prefix, _, root = m.group(1).rpartition(":")
    space = re.findall(rf"(?sa)\sxmlns{':' + re.escape(prefix) if prefix else ''}\s*=\s*[\"']([^\"']*)[\"']", m.group(2))
    return root, (space[-1] if prefix else space[0]) if space else ""


class Keys:
    """Which of many literals a text holds: a multi-pattern automaton where there are many, else one search each."""

    FEW = 24

    def __init__(self, literals):
        self.literals, self.automaton = list(literals), None
        if len(self.literals) > self.FEW:
            try:
                import ahocorasick
            except ImportError:
                return
            self.automaton = ahocorasick.Automaton()
            for x in self.literals:
                self.automaton.add_word(x, x)
            self.automaton.make_automaton()

    def held(self, text: str):
        if self.automaton is None:
            return [x for x in self.literals if x in text]
        found: set[str] = set()
        for _, x in self.automaton.iter(text):
            found.add(x)
            if len(found) == len(self.literals):
                break
        return found


class ByteMatcher:
    """Byte signatures compiled for one worker."""

    def __init__(self, sigs: list[tuple]):
        self.sigs = sigs
        self.fixed: dict = defaultdict(lambda: defaultdict(list))
        self.free: dict = {side: defaultdict(list) for side in ("head", "tail", "any")}
        self.reach = {"head": 0, "tail": 0}
        self.always: list[int] = []
        self.compiled: dict[str, re.Pattern] = {}
        for n, (_, _, _, _, _, _, side, off, lits, *_) in enumerate(sigs):
            for lit in (bytes(x).decode("latin-1") for x in lits):
                if side in ("bof", "eof"):
                    self.fixed[side, off, len(lit)][lit].append(n)
                else:
                    self.free[side][lit].append(n)
            if side in self.reach:
                self.reach[side] = max(self.reach[side], off)
            if not lits:
                self.always.append(n)
        self.keys = {side: Keys(by) for side, by in self.free.items() if by}

    def candidates(self, text: str) -> set[int]:
        out, size = set(self.always), len(text)
        for (side, off, n), by in self.fixed.items():
            if size >= off + n:
                at = off if side == "bof" else size - off - n
                out.update(by.get(text[at : at + n], ()))
        for side, keys in self.keys.items():
            part = text if side == "any" else text[: self.reach["head"]] if side == "head" else text[max(0, size - self.reach["tail"]) :]
            for lit in keys.held(part):
                out.update(self.free[side][lit])
        return out

    def find(self, text: str, regex: str, low: int, high: int | None, bound: int | None, from_end: bool) -> tuple[int, int] | None:
        """(begin, end) of the matched part of a run."""
        size = len(text)
        p = self.compiled.get(regex)
        if p is None:
            p = self.compiled[regex] = re.compile(regex)
        if from_end:
            m = p.search(text, max(0, size - bound) if bound is not None else 0)
            return m and m.span(1)
        end = size if bound is None else min(size, bound)
        m = p.match(text, low, end) if low == high else p.search(text, low, end)
        return m.span() if m and (high is None or m.start() <= high) else None

    def hits(self, content: bytes):
        """(ns, id, sig_no, sig_total, phase, offset, basis): the offset is how far a scan from each side had to go, at most."""
        text = content.decode("latin-1")
        size = len(text)
        for n in self.candidates(text):
            ns, ident, no, total, _, phase, *_, searches = self.sigs[n]
            parts, gone = [], 0
            for s in searches:
                span = self.find(text, *s)
                if span is None:
                    break
                parts.append((span[0], span[1] - span[0]))
                gone = max(gone, size - span[0] if s[4] else span[1])
            else:
                if len(parts) == 1:
                    basis = "byte match at %d, %d" % parts[0]
                else:
                    basis = "byte match at [" + " ".join("[%d %d]" % p for p in parts) + "]"
                yield ns, ident, no, total, phase, gone, basis + placed(no, total)


def placed(no: int, total: int) -> str:
    return f" (signature {no}/{total})" if total > 1 else ""


class ContainerMatcher:
    """Container signatures compiled for one worker; only entries whose names the catalogue asks for are read."""

    def __init__(self, parts: list[tuple], containers: list[tuple]):
        self.literal, self.globs = defaultdict(list), []
        for p in parts:
            if p[6]:
                self.globs.append((re.compile(python_regex(glob_regex(p[5]))), p))
            else:
                self.literal[p[2], p[5]].append(p)
        self.names = {name for _, name in self.literal}
        self.needed = {tuple(c[:4]): (c[5], c[4]) for c in containers}
        self.compiled: dict[str, re.Pattern] = {}

    def entries(self, content: bytes):
        """(type, name, read) of the entries of a container."""
        if content.startswith(archives.ZIP):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for info in z.infolist():
                    if not info.is_dir():
                        yield "ZIP", info.filename.split("\0")[0], lambda info=info: z.read(info)
        else:
            for name, data in archives.ole2_entries(content):
                yield "OLE2", name, lambda data=data: data

    def matches(self, regex: str, text: str) -> bool:
        p = self.compiled.get(regex)
        if p is None:
            p = self.compiled[regex] = re.compile(python_regex(regex))
        return p.search(text) is not None

    def hits(self, content: bytes):
        """(ns, id, sig_no, sig_total, basis) of the signatures all of whose parts are held."""
        held: dict = defaultdict(set)
        for ctype, name, read in self.entries(content):
            asked = self.literal.get((ctype, name), []) if name in self.names else [p for g, p in self.globs if p[2] == ctype and g.search(name)]
            text = None
            for p in asked:
                if p[7] and text is None:
                    text = read().decode("latin-1")
                if all(self.matches(r, text) for r in p[7]):
                    held[tuple(p[:4])].add((p[4], f"name {name} with {'byte match' if p[7] else 'name only'}"))
        for key, notes in held.items():
            n, total = self.needed.get(key, (None, 1))
            if len({i for i, _ in notes}) == n:
                yield key[0], key[1], key[3], total, "container " + "; ".join(t for _, t in sorted(notes)) + placed(key[3], total)


def python_regex(regex: str) -> str:
    """The end of the text in Python's spelling."""
    return regex[:-2] + "\\Z" if regex.endswith("\\z") else regex


class FileMatcher:
    """All matchers over one file."""

    def __init__(self, tables: dict, which: tuple):
        self.which, self.spaces = which, tables["spaces"]
        self.exts, self.mimes, self.xmls, self.codes = (defaultdict(list) for _ in range(4))
        self.globs: dict[str, list] = defaultdict(list)
        for r in tables["globs"]:
            (self.exts[r[3]] if r[2] == "ext" else self.globs[r[3]]).append(r)
        order = {r[3]: r[4] for r in reversed(tables["globs"]) if r[2] == "glob"}
        self.ladder = [(re.compile(python_regex(glob_regex(p))), p) for p in sorted(self.globs, key=lambda p: (order[p], p))]
        for r in tables["mimes"]:
            self.mimes[r[2]].append(r)
        for r in tables["xmls"]:
            self.xmls[r[2], r[3]].append(r)
        for r in tables["fourccs"]:
            self.codes[r[2]].append(r)
        self.texts, self.zip_default = tables["texts"], tables["zip_default"]
        self.bytes = ByteMatcher(tables["byte_sigs"]) if BYTE in which and tables["byte_sigs"] else None
        self.containers = ContainerMatcher(tables["parts"], tables["containers"]) if CONTAINER in which and tables["parts"] else None

    def hits(self, path: str, mime: str | None, base: str, content: bytes | None):
        """Rows of HITS without the path; the last of each namespace stands for the file and holds its error, if any."""
        error = ""
        if NAME in self.which:
            ext = base.rpartition(".")[2].lower() if "." in base else ""
            for r in self.exts.get(ext, ()) if ext else ():
                yield r[0], r[1], NAME, 0, 1, 0, 0, f"extension match {ext}"
            for g, p in self.ladder:
                if g.search(base):
                    for r in self.globs[p]:
                        yield r[0], r[1], NAME, 0, 1, 1, 0, f"glob match {p}"
                    break
        if MIME in self.which and mime:
            for k, m in enumerate([mime, mime.rpartition(";")[0]] if ";" in mime else [mime]):
                for r in self.mimes.get(m, ()):
                    yield r[0], r[1], MIME, 0, 1, k, 0, f"mime match {m}"
        if content is not None:
            if CONTAINER in self.which and len(content) >= 8 and content.startswith((archives.ZIP, archives.OLE2)):
                by = set()
                if self.containers:
                    try:
                        for ns, i, no, total, basis in self.containers.hits(content):
                            by.add(ns)
                            yield ns, i, CONTAINER, no, total, 0, 0, basis
                    except Exception as e:  # noqa: BLE001 - a broken container is an error of the file, not of the job
                        error = f"container error: {e}"
                for ns, i in self.zip_default if content.startswith(archives.ZIP) and path.endswith(".zip") else ():
                    if ns not in by:
                        yield ns, i, CONTAINER, 0, 1, 9, 0, "container match with trigger and default extension"
            if XML in self.which and self.xmls and (root := xml_root(content)):
                name, space = root
                keys = ((name, space), (name, ""), ("", space)) if space else ((name, ""),)
                for k, key in enumerate(keys):
                    note = " and ".join(f"{w} {v}" for w, v in zip(("root", "ns"), key) if v)
                    for r in self.xmls.get(key, ()):
                        yield r[0], r[1], XML, 0, 1, k, 0, f"xml match with {note}"
            if RIFF in self.which and self.codes and content.startswith(b"RIFF"):
                for k, code in enumerate(archives.riff_chunks(content)):
                    for r in self.codes.get(code, ()):
                        yield r[0], r[1], RIFF, 0, 1, k, 0, f"fourCC matches {code}"
            if self.bytes:
                for ns, i, no, total, phase, offset, basis in self.bytes.hits(content):
                    yield ns, i, BYTE, no, total, phase, offset, basis
            if TEXT in self.which and self.texts and (kind := text_class_of(content)) != "data":
                for ns, i in self.texts:
                    yield ns, i, TEXT, 0, 1, 0, 0, f"text match {kind}"
        for ns in self.spaces:
            yield ns, None, FILE, 0, 0, 0, 0, error


SCHEMA = "path string, mime string, ns string, id string, matcher int, sig_no int, sig_total int, phase int, offset bigint, basis string"
_ARROW = pa.schema([("path", pa.string()), ("mime", pa.string()), ("ns", pa.string()), ("id", pa.string()), ("matcher", pa.int32()), ("sig_no", pa.int32()), ("sig_total", pa.int32()), ("phase", pa.int32()), ("offset", pa.int64()), ("basis", pa.string())])
#: Hits per Arrow batch.
BATCH = 20_000


def one_pass(files: DataFrame, catalogs: list[Catalog], which: tuple, sigs: list[tuple]) -> DataFrame:
    """The hits of the chosen matchers, with one row per file and namespace that stands for the file; one scan of the files."""
    tables = {n: [tuple(r) for c in catalogs for r in c.rows(n)] for n in ("globs", "mimes", "xmls", "fourccs", "parts", "containers")}
    tables |= {"byte_sigs": sigs, "texts": [r[:2] for c in catalogs for r in c.texts], "zip_default": [(c.ns, c.zip_default) for c in catalogs if c.zip_default], "spaces": [c.ns for c in catalogs]}
    shared = files.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        m, rows = FileMatcher(shared.value, which), []
        batch_of = lambda part: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _ARROW)], schema=_ARROW)
        for batch in batches:
            for path, mime, base, content in zip(*batch.columns):
                path, mime = path.as_py(), mime.as_py()
                rows += [(path, mime, *h) for h in m.hits(path or "", mime, base.as_py(), content.as_py())]
                while len(rows) >= BATCH:
                    yield batch_of(rows[:BATCH])
                    rows = rows[BATCH:]
        if rows:
            yield batch_of(rows)

    have, reads = set(files.columns), set(which) & {CONTAINER, XML, RIFF, BYTE, TEXT}
    mime = F.col("mime") if "mime" in have else F.lit("")
    content = F.col("content") if reads else F.lit(None).cast("binary")
    return files.select("path", mime.alias("mime"), base_name(F.col("path")).alias("base"), content.alias("content")).mapInArrow(run, SCHEMA)


def all_hits(files: DataFrame, catalogs: list[Catalog], which: tuple = MATCHERS) -> DataFrame:
    """HITS and mime of all matchers, with a row of matcher FILE per file and namespace; files has path, mime, content."""
    sigs = [tuple(r) for c in catalogs for r in c.compiled()] if BYTE in which else []
    out = one_pass(files, catalogs, which, sigs[:MAX_SIGNATURES])
    for at in range(MAX_SIGNATURES, len(sigs), MAX_SIGNATURES):
        out = out.unionByName(one_pass(files, catalogs, (BYTE,), sigs[at : at + MAX_SIGNATURES]).where(F.col("matcher") != FILE))
    return out


def content_hits(files: DataFrame, catalogs: list[Catalog], *which: int) -> DataFrame:
    """HITS of some matchers alone."""
    return all_hits(files, catalogs, which).where(F.col("matcher") != FILE).select(*HITS)


def xml_hits(files: DataFrame, catalogs: list[Catalog]) -> DataFrame:
    """By root and namespace: both, the root alone, the namespace alone."""
    return content_hits(files, catalogs, XML)


def text_hits(files: DataFrame, catalogs: list[Catalog]) -> DataFrame:
    """One hit per namespace with a text format, unless the content is no text."""
    return content_hits(files, catalogs, TEXT)


def byte_hits(files: DataFrame, catalogs: list[Catalog]) -> DataFrame:
    """Keys, then the regular expressions of the candidates."""
    return content_hits(files, catalogs, BYTE)


def riff_hits(files: DataFrame, catalogs: list[Catalog]) -> DataFrame:
    """By the four-character codes of a RIFF file, in their order."""
    return content_hits(files, catalogs, RIFF)


def container_hits(files: DataFrame, catalogs: list[Catalog]) -> DataFrame:
    """Entries of zip and OLE2 files by name, then by bytes; a signature needs all its parts.

    An entry whose name is no literal of the catalogue is tried on the globs. A zip file named .zip without a hit gets the
    catalogue's default id.
    """
    return content_hits(files, catalogs, CONTAINER)
