"""Scalar functions on names, paths, hashes and times, as Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: URL schemes whose path names the object.
SCHEMES = ("http", "https", "ftp", "mailto", "file", "data", "irc")


def url_path(c: Column) -> Column:
    """The path of a URL of a known scheme, also behind an archive's path; other names as they are."""
    tail = F.regexp_extract(c, rf"(?i)(?:^|[/#])(?:{'|'.join(SCHEMES)})://?[^/?#]*([^?#]*)", 1)
    return F.when(c.rlike(rf"(?i)(?:^|[/#])(?:{'|'.join(SCHEMES)})://"), tail).otherwise(c)


def base(c: Column) -> Column:
    """Last component of a path with / or \\, without trailing separators."""
    return F.regexp_extract(F.regexp_replace(c, r"[/\\]+$", ""), r"[^/\\]*$", 0)


def base_name(c: Column) -> Column:
    """Last component of a path or URL."""
    return base(url_path(F.coalesce(c, F.lit(""))))


def extension(c: Column) -> Column:
    """Lower-case text after the last dot of a base name; empty without a dot."""
    return F.lower(F.regexp_extract(c, r"\.([^.]*)$", 1))


def checksum(content: Column, kind: str) -> Column:
    """Hex digest: md5, sha1, sha256, sha512 or crc (8 digits)."""
    return {
        "md5": lambda: F.md5(content),
        "sha1": lambda: F.sha1(content),
        "sha256": lambda: F.sha2(content, 256),
        "sha512": lambda: F.sha2(content, 512),
        "crc": lambda: F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0"),
    }[kind]()


def uri_escape(c: Column) -> Column:
    """Percent-encode all bytes but letters, digits and -_.~/: ."""
    out = F.url_encode(c)
    for form, plain in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%3A", ":"), ("%7E", "~")):
        out = F.replace(out, F.lit(form), F.lit(plain))
    return out


def file_uri(path: Column, folder: Column | None = None) -> Column:
    """file: URI of a path; folders end in a slash."""
    uri = F.concat(F.lit("file:/"), uri_escape(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^/+", "")))
    return uri if folder is None else F.when(folder, F.concat(uri, F.lit("/"))).otherwise(uri)


def archive_uri(kind: Column, parent: Column, inner: Column) -> Column:
    """URI of an entry inside an archive, nested as zip:file:/a.zip!/b."""
    return F.concat(kind, F.lit(":"), parent, F.lit("!/"), uri_escape(inner))


def parent_folder(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"[/\\]+$", ""), r"[/\\]?[^/\\]*$", "")


def evidence(basis: Column) -> Column:
    """The method an identification rests on."""
    return F.when(F.contains(basis, F.lit("container")), "Container").when(F.contains(basis, F.lit("byte")), "Signature").when(F.contains(basis, F.lit("extension")), "Extension").when(F.contains(basis, F.lit("text")), "Text").otherwise("")


def version_numbers(c: Column) -> Column:
    """a.b.c as three ints, 0.0.0 for the empty text; null unless there are exactly three numbers."""
    parts = F.transform(F.split(c, r"\."), lambda p: p.try_cast("int"))
    whole = (F.size(parts) == 3) & F.forall(parts, lambda p: p.isNotNull())
    return F.when(c == "", F.array(F.lit(0), F.lit(0), F.lit(0))).when(whole, parts)


def decoded_path(c: Column) -> Column:
    """A path that was given as URL-safe base64; null where it is none."""
    return F.try_to_binary(F.translate(c, "-_", "+/"), F.lit("base64")).cast("string")


def rfc3339(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")


def yaml_quoted(c: Column) -> Column:
    """Single-quoted scalar; double-quoted with escapes when the text holds characters that do not print."""
    double = F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit('"'))
    return F.when(c.rlike(r"[\x00-\x1F\x7F]"), double).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'")))


def label(name: Column, version: Column) -> Column:
    """name version, without a blank where one is missing."""
    return F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif(version, F.lit("")))


def path_folders(path: Column) -> Column:
    """All folders above a path, outermost first."""
    parts = F.split(F.regexp_replace(path, r"[/\\]+$", ""), r"[/\\]")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def text_class(content: Column) -> Column:
    """Text class of the first 4096 bytes: ASCII, UTF-8 Unicode, ..., or data.

    A multi-byte character cut at the end of the window does not make it invalid.
    """
    head = F.substring(content, 1, 4096)
    latin = F.decode(head, "ISO-8859-1")
    whole = F.regexp_replace(latin, r"[\xC2-\xF4][\x80-\xBF]{0,2}\z", "")
    utf8 = F.is_valid_utf8(head.cast("string")) | ((F.octet_length(content) > 4096) & F.is_valid_utf8(F.encode(whole, "ISO-8859-1").cast("string")))
    bom = lambda h: F.startswith(head, F.unhex(F.lit(h)))
    control = latin.rlike(r"[\x00-\x06\x0E-\x1A\x1C-\x1F\x7F]")
    return (
        F.when(F.octet_length(content) == 0, "data")
        .when(bom("EFBBBF"), "UTF-8 Unicode (with BOM)")
        .when(bom("FEFF"), "UTF-16 Big Endian")
        .when(bom("FFFE"), "UTF-16 Little Endian")
        .when(latin.rlike(r"\A\x2B\x2F\x76[\x38\x39\x2B\x2F]"), "UTF-7 Unicode")
        .when(control, "data")
        .when(~latin.rlike(r"[\x80-\xFF]"), "ASCII")
        .when(utf8, "UTF-8 Unicode")
        .when(~latin.rlike(r"[\x80-\x9F]"), "ISO-8859-1")
        .otherwise("extended")
    )


_CONTROL, _HIGH, _C1, _CUT = (re.compile(p) for p in (rb"[\x00-\x06\x0E-\x1A\x1C-\x1F\x7F]", rb"[\x80-\xFF]", rb"[\x80-\x9F]", rb"[\xC2-\xF4][\x80-\xBF]{0,2}\Z"))


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def text_class_of(content: bytes) -> str:
    """``text_class`` of bytes in a Python worker."""
    head = content[:4096]
    if not head:
        return "data"
    for mark, kind in ((b"\xef\xbb\xbf", "UTF-8 Unicode (with BOM)"), (b"\xfe\xff", "UTF-16 Big Endian"), (b"\xff\xfe", "UTF-16 Little Endian")):
        if head.startswith(mark):
            return kind
    if head.startswith((b"+/v8", b"+/v9", b"+/v+", b"+/v/")):
        return "UTF-7 Unicode"
    if _CONTROL.search(head):
        return "data"
    if not _HIGH.search(head):
        return "ASCII"
    if _is_utf8(head) or len(content) > 4096 and _is_utf8(_CUT.sub(b"", head)):
        return "UTF-8 Unicode"
    return "extended" if _C1.search(head) else "ISO-8859-1"
