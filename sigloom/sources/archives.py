"""Archives and containers: zip, tar, gzip, ARC, WARC, OLE2 and RIFF.

``expand`` is one Arrow stage from file rows to file rows: every archive is
opened where it is met, whatever the depth, so nothing is shuffled or written
between the levels. Of each level one entry is held at a time, and rows leave
in batches bounded by their bytes. A broken archive gives its error as a row
instead of failing.
"""

from __future__ import annotations

import io
import os
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Archive kinds that can be expanded.
KINDS = ("zip", "gzip", "tar", "arc", "warc")
# The ids of archive formats in the registry, MIME-info, library and linked-data namespaces.
ARCHIVE_IDS = {
    "zip": ("x-fmt/263", "application/zip", "fdd000354"),
    "gzip": ("x-fmt/266", "application/gzip", "Q27824060"),
    "tar": ("x-fmt/265", "application/x-tar", "Q283579"),
    "arc": ("x-fmt/219", "fmt/410", "application/x-arc", "fdd000235", "Q7978505", "Q27824065"),
    "warc": ("fmt/289", "application/x-warc", "fdd000236", "Q10287816"),
}


def chosen_kinds(text: str = "all") -> tuple[str, ...]:
    """The archive kinds named in a comma list, whatever the letter case; ``all`` stands for every kind."""
    named = [k.strip().lower() for k in text.split(",")]
    return KINDS if named == ["all"] else tuple(k for k in KINDS if k in named)


def archive_class(ident: Column, kinds: tuple = KINDS) -> Column:
    """The archive kind that a format id stands for, among the chosen kinds; null for other formats."""
    out = F.lit(None).cast("string")
    for k in kinds:
        out = F.when(ident.isin(*ARCHIVE_IDS[k]), k).otherwise(out)
    return out


def archive_kinds(results: DataFrame, kinds: tuple = KINDS) -> DataFrame:
    """path, kind of the files whose first archive id among their results is of a chosen kind."""
    return results.select("path", "rank", archive_class(F.col("id"), kinds).alias("kind")).where("kind is not null").groupBy("path").agg(F.min_by("kind", "rank").alias("kind"))


def identified_archives(files: DataFrame, results: DataFrame, kinds: tuple = KINDS) -> DataFrame:
    """The files that are archives of a chosen kind by their results, with that kind."""
    return files.join(archive_kinds(results, kinds), "path")


ENTRY = "path string, mime string, length bigint, modified string, content binary, error string, parent string, depth int"
#: Rows and bytes of one Arrow batch at most (a single larger entry is a batch of its own).
BATCH, BATCH_BYTES = 256, 1 << 25
FOLDER = object()


def kind_of(data: bytes) -> str | None:
    """Archive kind by its first bytes."""
    if data[:4] == b"PK\x03\x04":
        return "zip"
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if data[257:262] == b"ustar":
        return "tar"
    if data[:11] == b"filedesc://":
        return "arc"
    if data[:5] == b"WARC/":
        return "warc"
    return None


def _iso(seconds: float | None) -> str:
    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%SZ") if seconds else ""


def _stamp(digits: str) -> str:
    """14 digits as a time."""
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z" if len(digits) == 14 else ""


def zip_entries(data: bytes) -> Iterator[tuple]:
    """(name, mime, modified, content) in the order of the central directory; a NUL tail of a name is cut."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            when = "%04d-%02d-%02dT%02d:%02d:%02dZ" % info.date_time
            yield info.filename.split("\0")[0], "", when, FOLDER if info.is_dir() else z.read(info)


def tar_entries(data: bytes) -> Iterator[tuple]:
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as t:
        for m in t:
            if m.isfile() or m.isdir():
                yield m.name, "", _iso(m.mtime), FOLDER if m.isdir() else t.extractfile(m).read()


#: Extensions that the name of what a gzip holds loses.
GZIP_EXTENSIONS = (".gz", ".z", ".gzip", ".zip")


def gzip_entries(data: bytes, path: str = "") -> Iterator[tuple]:
    """The one child, of all members: named by the first header, else as the archive, without an extension of gzip files.

    What follows the last whole member and is none is an error after the child.
    """
    name = ""
    flags, at = data[3], 10
    if flags & 4:
        at += 2 + int.from_bytes(data[at : at + 2], "little")
    if flags & 8:
        name = data[at : data.index(b"\0", at)].decode("latin-1")
    if not name:
        base = re.split(r"[/\\#]", path)[-1]
        name = os.path.splitext(base)[0] if os.path.splitext(base)[1] in GZIP_EXTENSIONS else base
    out, rest, broken = [], data, None
    while rest and broken is None:
        member = zlib.decompressobj(31)
        try:
            got = member.decompress(rest)
            if not member.eof:
                raise ValueError("a gzip member ends early")
        except (ValueError, zlib.error) as e:
            broken = e
        else:
            out.append(got)
            rest = member.unused_data.lstrip(b"\0")
    if out:
        yield name, "", _iso(int.from_bytes(data[4:8], "little")), b"".join(out)
    if broken is not None:
        raise broken


def _body(block: bytes) -> tuple[str, bytes]:
    """MIME type and payload of an HTTP response, or the block itself."""
    if block[:5] != b"HTTP/":
        return "", block
    head, _, body = block.partition(b"\r\n\r\n")
    m = re.search(rb"(?im)^content-type:\s*([^\r\n]+)", head)
    return (m.group(1).decode("latin-1").strip() if m else ""), body


def warc_entries(data: bytes):
    """Payload records (response, resource, conversion, metadata left out): date/URL, declared type, time, payload."""
    at = 0
    while at < len(data):
        m = re.compile(rb"WARC/[0-9.]+\r\n").match(data, at)
        if not m:
            raise ValueError("no WARC record at byte %d" % at)
        end = data.index(b"\r\n\r\n", at)
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in data[m.end() : end].decode("utf-8", "replace").split("\r\n"))}
        size = int(fields.get("content-length", "0"))
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size
        while data[at : at + 2] == b"\r\n":
            at += 2
        if fields.get("warc-type") in ("response", "resource", "conversion"):
            mime, body = _body(block)
            stamp = re.sub(r"[^0-9]", "", fields.get("warc-date", ""))[:14]
            yield f"{stamp}/{fields.get('warc-target-uri', '').strip('<>')}", mime or ("" if fields.get("warc-type") == "response" else fields.get("content-type", "")), _stamp(stamp), body


def arc_entries(data: bytes):
    """URL records: date/URL, declared type, time, payload."""
    at, first = 0, True
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        parts = data[at:end].decode("latin-1").split(" ")
        size = int(parts[-1])
        block = data[end + 1 : end + 1 + size]
        at = end + 1 + size
        if not first:
            mime, body = _body(block)
            yield f"{parts[2]}/{parts[0]}", mime or parts[3], _stamp(parts[2]), body
        first = False


def open_archive(kind: str, data: bytes, path: str):
    return gzip_entries(data, path) if kind == "gzip" else {"zip": zip_entries, "tar": tar_entries, "arc": arc_entries, "warc": warc_entries}[kind](data)


def trim_web_path(path: str) -> str:
    """A path of a web archive without a last part that only repeats its folder's name without extension (an unpacked .warc.gz)."""
    folder, _, last = path.rpartition("/")
    return folder if folder and last == os.path.splitext(folder.rpartition("/")[2])[0] else path


_ENTRY = pa.schema([("path", pa.string()), ("mime", pa.string()), ("length", pa.int64()), ("modified", pa.string()), ("content", pa.binary()), ("error", pa.string()), ("parent", pa.string()), ("depth", pa.int32())])


def expand(files: DataFrame, kinds: tuple = KINDS, max_depth: int | None = None, separator: str = "#", folders: bool = False) -> DataFrame:
    """The files and everything inside their archives, at any depth: rows of ENTRY.

    An archive is told by its first bytes, or, for the files themselves, by their column ``kind`` if there is one (null:
    no archive). Archives of other kinds than ``kinds`` stay closed; those at ``max_depth``, if given, too, and say so in
    their error. ``folders`` adds the folders that archives name (no content, length -1).
    """
    have = set(files.columns)

    def below(path: str, content: bytes, depth: int, kind: str | None):
        """(row, whether it is an archive's error) of what an archive holds, level by level as it is met."""
        inner = trim_web_path(path) if separator == "/" and kind in ("arc", "warc") else path
        try:
            for name, mime, modified, data in open_archive(kind, content, path):
                if data is FOLDER:
                    if folders:
                        yield f"{inner}{separator}{name}", mime, -1, modified, None, None, path, depth + 1
                else:
                    yield from opened(f"{inner}{separator}{name}", mime, modified, data, path, depth + 1, kind_of(data))
        except Exception as e:  # noqa: BLE001 - a broken archive is a row, not a failure
            yield f"{inner}{separator}", "", 0, "", None, f"archive error: {e}", path, depth + 1

    def opened(path, mime, modified, content, parent, depth, kind):
        closed = kind in kinds and max_depth is not None and depth >= max_depth
        yield path, mime, None if content is None else len(content), modified, content, f"archive error: not opened, {max_depth} levels are the limit" if closed else None, parent, depth
        if kind in kinds and not closed:
            yield from below(path, content, depth, kind)

    def run(batches):
        rows, size = [], 0
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ENTRY)], schema=_ENTRY)
        for batch in batches:
            for path, mime, modified, content, kind in zip(*batch.columns):
                content = content.as_py()
                told = kind.as_py() if "kind" in have else kind_of(content or b"")
                for row in opened(path.as_py(), mime.as_py(), modified.as_py(), content, None, 0, told if content is not None else None):
                    rows.append(row)
                    size += len(row[4] or b"")
                    if len(rows) >= BATCH or size >= BATCH_BYTES:
                        yield batch_of()
                        rows, size = [], 0
        if rows:
            yield batch_of()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    kind = F.col("kind") if "kind" in have else F.lit(None).cast("string")
    return files.select("path", text("mime").alias("mime"), text("modified").alias("modified"), "content", kind.alias("kind")).mapInArrow(run, ENTRY)


# -- containers ------------------------------------------------------------------------------------------------------
ZIP = b"PK\x03\x04"
OLE2 = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"


def ole2_entries(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(path, content) of the streams of a compound file, storages joined by /."""
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    n_fat, first_dir = struct.unpack_from("<I", data, 44)[0], struct.unpack_from("<I", data, 48)[0]
    cutoff, first_mini, _, first_difat, n_difat = struct.unpack_from("<IIIII", data, 56)
    size = 1 << shift
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    difat = [*struct.unpack_from("<109I", data, 76)]
    at = first_difat
    for _ in range(n_difat):
        words = struct.unpack(f"<{size // 4}I", sector(at))
        difat += words[:-1]
        at = words[-1]
    fat: list[int] = []
    for i in difat[:n_fat]:
        if i < 0xFFFFFFFA:
            fat += struct.unpack(f"<{size // 4}I", sector(i))

    def chain(start: int, table: list[int], piece) -> bytes:
        out, seen = [], set()
        while start < 0xFFFFFFFA and start < len(table) and start not in seen:
            seen.add(start)
            out.append(piece(start))
            start = table[start]
        return b"".join(out)

    folder = chain(first_dir, fat, sector)
    mini_fat_bytes = chain(first_mini, fat, sector)
    mini_fat = list(struct.unpack(f"<{len(mini_fat_bytes) // 4}I", mini_fat_bytes))
    entries = []
    for off in range(0, len(folder) - 127, 128):
        n = struct.unpack_from("<H", folder, off + 64)[0]
        name = folder[off : off + max(n - 2, 0)].decode("utf-16-le", "replace")
        kind = folder[off + 66]
        left, right, child = struct.unpack_from("<III", folder, off + 68)
        start, length = struct.unpack_from("<I", folder, off + 116)[0], struct.unpack_from("<Q", folder, off + 120)[0] & 0xFFFFFFFF
        entries.append((name, kind, left, right, child, start, length))
    if not entries:
        return
    ministream = chain(entries[0][5], fat, sector)
    mini = 1 << mini_shift
    todo, seen = [(entries[0][4], "")], set()
    while todo:
        i, prefix = todo.pop()
        if i >= len(entries) or i in seen:
            continue
        seen.add(i)
        name, kind, left, right, child, start, length = entries[i]
        todo += [(left, prefix), (right, prefix)]
        if kind == 1:
            todo.append((child, f"{prefix}{name}/"))
        elif kind == 2:
            body = chain(start, mini_fat, lambda k: ministream[k * mini : (k + 1) * mini]) if length < cutoff else chain(start, fat, sector)
            yield prefix + name, body[:length]


def riff_chunks(data: bytes) -> list[str]:
    """Form type, chunk ids and LIST types of a RIFF file, in order, each once."""
    out: list[str] = []

    def add(code: bytes):
        c = code.decode("latin-1")
        if c not in out:
            out.append(c)

    def walk(at: int, end: int):
        while at + 8 <= end:
            code, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if code == b"LIST":
                add(data[at + 8 : at + 12])
                walk(at + 12, min(at + 8 + size, end))
            else:
                add(code)
            at += 8 + size + (size & 1)

    if data[:4] == b"RIFF" and len(data) >= 12:
        add(data[8:12])
        walk(12, min(len(data), 8 + int.from_bytes(data[4:8], "little")))
    return out
