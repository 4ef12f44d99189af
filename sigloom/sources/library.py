"""Library format descriptions: one XML document per format, delivered in a zip file."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

from sigloom.functions.frames import BOF, PREV, Frame, Signature
from sigloom.functions.patterns import Masked, Pattern, Seq
from sigloom.sources.catalog import Catalog

#: Relations whose target is the more general format.
BELOW = ("Subtype of", "Modification of", "Version of", "Extension of", "Has earlier version")
HEX_DIGITS = set("0123456789ABCDEFabcdefxX")


def dehex(text: str) -> list[tuple[int, Pattern]]:
    """(gap before, pattern) of hex digits in which xx is any byte and a single x any half byte."""
    digits = re.sub(r"0x|\\x", "", re.sub(r"[\s,]", "", text.replace("0X", "0x")))
    pairs = [digits[i : i + 2].lower() for i in range(0, len(digits) - 1, 2)]
    out: list[tuple[int, Pattern]] = []
    gap, value, mask = 0, b"", b""

    def flush():
        nonlocal gap, value, mask
        if value:
            out.append((gap, Seq(value) if set(mask) == {255} else Masked(value, mask)))
            gap, value, mask = 0, b"", b""

    for p in pairs:
        if p == "xx":
            flush()
            gap += 1
            continue
        value += bytes([int(p.replace("x", "0"), 16)])
        mask += bytes([(0 if p[0] == "x" else 0xF0) | (0 if p[1] == "x" else 0x0F)])
    flush()
    return out


def magics(values: list[str]) -> list[Signature]:
    """Signatures of the magic number texts: hex ones, and ASCII ones only if there is no hex."""
    hexes, texts = [], []
    for v in values:
        for line in re.split(r"[\r\n]+", v):
            line = line.strip()
            if m := re.match(r"(?i)hex(?:adecimal)?\s*:?\s*(.+)", line):
                hexes.append(m.group(1))
            elif m := re.match(r"(?i)ascii\s*:?\s*(.+)", line):
                texts.append(m.group(1))
            elif set(re.sub(r"[\s,]|0x", "", line)) <= HEX_DIGITS and re.sub(r"[\s,]|0x", "", line):
                hexes.append(line)
    out = []
    for h in hexes:
        if not set(re.sub(r"[\s,]|0x|\\x", "", h)) <= HEX_DIGITS:
            continue
        frames = dehex(h)
        if frames:
            first = Frame(frames[0][1], BOF, frames[0][0], frames[0][0])
            out.append(Signature((first, *(Frame(p, PREV, g, g) for g, p in frames[1:]))))
    if not out:
        out = [Signature((Frame(Seq(t.encode("latin-1", "replace")), BOF),)) for t in texts]
    return out


def _local(e):
    return e.tag.rsplit("}", 1)[-1]


def puid_of(url: str) -> str | None:
    """The registry id a link ends in."""
    m = re.search(r"((?:x-)?fmt/\d+)\s*$", url or "")
    return m.group(1) if m else None


def read_documents(data: bytes) -> list[ET.Element]:
    """The descriptions of a zip file: fddXML/*.xml, without test files and empty ones."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [ET.fromstring(z.read(n)) for n in z.namelist() if re.fullmatch(r"fddXML/[^/]+\.xml", n) and "test" not in n and z.getinfo(n).file_size]


def from_library(documents: list[ET.Element], ns: str = "loc", multi: str = "conclusive", registry: Catalog | None = None) -> Catalog:
    """A catalogue of library descriptions; with a registry also its signatures of the formats they link to."""
    c = Catalog(ns, "library format descriptions", multi)
    updated = []
    for d in documents:
        i = d.get("id")
        c.infos.append((ns, i, d.get("shortName") or d.get("titleName") or "", "", "", d.get("titleName") or ""))
        updated += [k.text for k in d.iter() if _local(k) == "date" and k.text]
        found: dict[str, list[str]] = {}
        for k in d.iter():
            kind = _local(k)
            if kind in ("magicNumbers", "filenameExtension", "internetMediaType", "other"):
                values = [v.text if kind == "other" else v.text.strip() for v in k.iter() if _local(v) in ("sigValue", "value") and v.text]
                tag = next((t.text or "" for t in k.iter() if _local(t) == "tag"), "")
                found.setdefault(tag if kind == "other" else kind, []).extend(values)
        c.globs += [(ns, i, "ext", v.lower().lstrip("."), 0, 50) for v in found.get("filenameExtension", []) if v.lower() != "see note."]
        c.mimes += [(ns, i, v) for v in found.get("internetMediaType", []) if "/" in v]
        c.fourccs += [(ns, i, v) for v in found.get("Microsoft FOURCC", []) if len(v) == 4]
        c.signatures += [(ns, i, s, 0) for s in magics(found.get("magicNumbers", []))]
        links = [p for k in d.iter() if _local(k) in ("url", "urlReference") for u in k.itertext() if (p := puid_of(u))]
        if registry:
            c = c.join(borrowed(registry, {p: i for p in links}, ns))
        for r in d.iter():
            if _local(r) == "relationship":
                typ = next((k.text or "" for k in r if _local(k) == "typeOfRelationship"), "").strip()
                other = next((k.text or "" for k in r.iter() if _local(k) == "id"), "").strip()
                if typ in BELOW and other:
                    c.priorities.append((ns, other, i))
    c.details = f"library format descriptions, updated {max(updated, default='unknown')}"
    return c.closed_priorities()


def borrowed(registry: Catalog, links: dict[str, str], ns: str) -> Catalog:
    """Byte and container signatures of another catalogue under the ids that link to its ids."""
    return Catalog(
        ns,
        signatures=[(ns, links[i], s, w) for _, i, s, w in registry.signatures if i in links],
        containers=[(ns, links[r[1]], *r[2:]) for r in registry.containers if r[1] in links],
        parts=[(ns, links[r[1]], *r[2:]) for r in registry.parts if r[1] in links],
    )
