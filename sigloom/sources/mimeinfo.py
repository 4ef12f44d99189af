"""MIME-info vocabularies (freedesktop.org shared MIME info and its relatives)."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from sigloom.functions.frames import BOF, Frame, Signature
from sigloom.functions.patterns import IgnoreCase, Masked, Pattern, Seq, big, host, int8, little
from sigloom.sources.catalog import Catalog

#: Weight of globs and magic without one of their own.
DEFAULT_WEIGHT = 50
#: The numeric magic types with their size in bytes.
NUMERIC = {"byte": 1, "big16": 2, "little16": 2, "host16": 2, "big32": 4, "little32": 4, "host32": 4}
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "v": "\v", "a": "\a", "\\": "\\", '"': '"', "'": "'"}


def unquote(text: str) -> bytes:
    """C escapes: \\n and the like, \\xHH, three octal digits, one or two decimal digits; other characters as UTF-8."""
    out, i = b"", 0
    while i < len(text):
        if text[i] != "\\" or i + 1 == len(text):
            out += text[i].encode()
            i += 1
            continue
        rest = text[i + 1 :]
        if m := re.match(r"x([0-9A-Fa-f]{1,2})", rest):
            out += bytes([int(m.group(1), 16)])
        elif m := re.match(r"([0-3][0-7]{2})", rest):
            out += bytes([int(m.group(1), 8)])
        elif m := re.match(r"([0-9]{1,2})", rest):
            out += bytes([int(m.group(1))])
        else:
            m = re.match(r"(?s).", rest)
            out += ESCAPES.get(m.group(), m.group()).encode("latin-1", "ignore") or m.group().encode()
        i += 1 + m.end()
    return out


def offsets(text: str) -> tuple[int, int]:
    """a, a:b and :b as a window of start offsets."""
    low, colon, high = (text or "0").partition(":")
    return int(low or 0), int(high or 0) if colon else int(low or 0)


def number(text: str) -> int:
    text = text.strip().lower()
    return int(text, 16) if text.startswith("0x") else int(text, 8) if text.startswith("0") and len(text) > 1 else int(text)


def magic_pattern(kind: str, value: str, mask: str | None) -> Pattern | None:
    """The pattern of a match element; None for kinds that are ignored. Unknown kinds are errors."""
    if kind == "regex":
        return None
    if kind in NUMERIC:
        v, size = number(value), NUMERIC[kind]
        if mask:
            order = "little" if kind.startswith("little") else "big"
            return Masked(v.to_bytes(size, order), number(mask).to_bytes(size, order))
        return int8(v) if size == 1 else {"big": big, "little": little, "host": host}[re.sub(r"\d", "", kind)](v, size)
    if kind == "stringignorecase":
        return IgnoreCase(unquote(value))
    if kind == "unicodeLE":
        return Seq(unquote(value).decode("latin-1").encode("utf-16-le"))
    if kind in ("string", ""):
        data = unquote(value)
        if mask:
            bits = bytes.fromhex(mask[2:]) if mask.startswith("0x") else unquote(mask)
            return Masked(data, bits.ljust(len(data), b"\xff")[: len(data)])
        return Seq(data)
    raise ValueError(f"unknown magic type {kind}")


def _local(e):
    return e.tag.rsplit("}", 1)[-1]


def leaf_paths(match: ET.Element) -> list[list[Frame]]:
    """Nested matches are AND-ed along a path, siblings are alternatives: one list of frames per leaf."""
    pattern = magic_pattern(match.get("type", ""), match.get("value", ""), match.get("mask"))
    low, high = offsets(match.get("offset", "0"))
    own = [] if pattern is None else [Frame(pattern, BOF, low, high)]
    inner = [k for k in match if _local(k) == "match"]
    if not inner:
        return [own]
    return [own + rest for k in inner for rest in leaf_paths(k)]


def from_mimeinfo(xml: str, ns: str = "mimeinfo", multi: str = "conclusive") -> Catalog:
    """A catalogue of a MIME-info file. A type with exactly one parent besides text/plain inherits XML roots and magic at one weight less."""
    c = Catalog(ns, "MIME-info", multi)
    types = [e for e in ET.fromstring(xml).iter() if _local(e) == "mime-type"]
    by: dict[str, dict] = {}
    for e in types:
        i = e.get("type")
        if i in by:
            raise ValueError(f"{i} is given twice")
        kids = lambda n: [k for k in e if _local(k) == n]
        magic = [(int(m.get("priority", DEFAULT_WEIGHT)), path) for m in kids("magic") for k in m if _local(k) == "match" for path in leaf_paths(k) if path]
        name = next((k.text or "" for k in kids("comment") if not any(a.endswith("lang") for a in k.keys())), "")
        by[i] = {
            "name": name,
            "aliases": [k.get("type") for k in kids("alias")],
            "parents": [k.get("type") for k in kids("sub-class-of")],
            "globs": [(k.get("pattern"), int(k.get("weight", DEFAULT_WEIGHT))) for k in kids("glob")],
            "xmls": [(k.get("localName") or "", k.get("namespaceURI") or "") for k in kids("root-XML")],
            "magic": magic,
        }
    order = 0
    for i, t in by.items():
        parents = [p for p in t["parents"] if p != "text/plain"]
        own = by.get(parents[0]) if len(parents) == 1 else None
        xmls = t["xmls"] + (own["xmls"] if own else [])
        magic = t["magic"] + ([(w - 1, path) for w, path in own["magic"]] if own else [])
        c.infos.append((ns, i, t["name"], "", i, ""))
        c.mimes += [(ns, i, m) for m in (i, *t["aliases"])]
        for pattern, weight in t["globs"]:
            order += 1
            ext = re.fullmatch(r"\*\.([^*?\[\]\\.]+)", pattern)
            c.globs.append((ns, i, "ext", ext.group(1).lower(), order, weight) if ext else (ns, i, "glob", pattern, order, weight))
        c.xmls += [(ns, i, *x) for x in xmls]
        c.signatures += [(ns, i, Signature(tuple(path)), w) for w, path in magic]
        if i == "text/plain" or "text/plain" in t["parents"]:
            c.texts.append((ns, i, i == "text/plain"))
    return c
