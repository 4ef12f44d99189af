"""Build options applied in one fixed order, ready-made catalogues, and the options of a log."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from sigloom.sources.catalog import Catalog, combined


@dataclass(frozen=True)
class BuildOptions:
    """How a catalogue is built from its vocabulary."""

    name: str | None = None
    details: str | None = None
    multi: str = "conclusive"
    zip_default: str | None = None
    limit: tuple = ()
    exclude: tuple = ()
    #: relations to leave out: name, mime, xml, byte, container, riff, text, priority
    without: tuple = ()
    #: keep byte signatures of formats that have container signatures
    doubles: bool = False
    mirror: bool = False
    bof: int | None = None
    eof: int | None = None
    no_eof: bool = False
    extensions: tuple[Catalog, ...] = field(default=())


def describe(c: Catalog, o: BuildOptions) -> str:
    """The text that says what a catalogue was built of."""
    notes = [o.details or c.details]
    notes += [f"multi set to {o.multi}"] if o.multi != "conclusive" else []
    notes += [f"limited to ids: {', '.join(o.limit)}"] if o.limit else []
    notes += [f"excluding ids: {', '.join(o.exclude)}"] if o.exclude else []
    notes += [f"no {w} matcher" for w in o.without]
    notes += [f"max BOF {o.bof}"] if o.bof is not None else []
    notes += [f"max EOF {o.eof}"] if o.eof is not None else []
    notes += ["no EOF signature parts"] if o.no_eof else []
    notes += [f"extensions: {', '.join(e.details or e.ns for e in o.extensions)}"] if o.extensions else []
    return "; ".join(n for n in notes if n)


def apply(c: Catalog, o: BuildOptions) -> Catalog:
    """The catalogue under the options: joined, filtered, blanked, without doubles, clipped, mirrored, closed - in this order."""
    details = describe(c, o)
    for e in o.extensions:
        c = c.join(_under(e, c.ns))
    if o.limit:
        c = c.limit(o.limit)
    if o.exclude:
        c = c.exclude(o.exclude)
    c = c.without(*o.without)
    if not o.doubles:
        c = c.no_doubles()
    if o.bof is not None or o.eof is not None or o.no_eof:
        c = c.scan_limits(o.bof, o.eof, o.no_eof)
    if o.mirror or o.bof is not None and o.eof is not None:
        c = c.with_mirrors()
    c = c.closed_priorities()
    if o.name:
        c = _under(c, o.name)
    return replace(c, multi=o.multi, zip_default=o.zip_default or c.zip_default, details=details)


def _under(c: Catalog, ns: str) -> Catalog:
    """The catalogue under another namespace."""
    rels = ("infos", "globs", "mimes", "xmls", "fourccs", "texts", "signatures", "containers", "parts", "priorities")
    return replace(c, ns=ns, **{n: [(ns, *r[1:]) for r in getattr(c, n)] for n in rels})


#: Names of the ready-made catalogues and the vocabularies they are built of.
PRESETS = {
    "default": ("registry",),
    "loc": ("library",),
    "tika": ("tika",),
    "freedesktop": ("freedesktop",),
    "wikidata": ("linked",),
    "archivematica": ("registry",),
    "deluxe": ("registry", "tika", "freedesktop", "library", "linked"),
}
# The vocabularies of further formats a preset adds to its first one.
EXTENSIONS = {"archivematica": ("archivematica-fmt2.xml", "archivematica-fmt3.xml", "archivematica-fmt4.xml", "archivematica-fmt5.xml")}


def preset(name: str, vocabularies: dict[str, Catalog], options: BuildOptions | None = None) -> list[Catalog]:
    """The catalogues of a preset from the vocabularies at hand, its extensions under their file names."""
    o = options or BuildOptions()
    more = tuple(vocabularies[e] for e in EXTENSIONS.get(name, ()))
    first, *rest = PRESETS[name]
    return combined(apply(vocabularies[first], replace(o, extensions=(*o.extensions, *more))), *(apply(vocabularies[v], o) for v in rest))


#: The letters and words of log options.
LOG_OPTIONS = {"e": "error", "error": "error", "err": "error", "w": "warning", "warn": "warning", "warning": "warning", "k": "known", "known": "known", "u": "unknown", "unknown": "unknown", "c": "chart", "chart": "chart", "t": "time", "time": "time", "p": "progress", "progress": "progress", "d": "debug", "debug": "debug", "s": "slow", "slow": "slow", "o": "stdout", "stdout": "stdout", "out": "stdout", "stderr": "stderr"}


def log_options(text: str) -> tuple[set[str], list[str]]:
    """(options, formats) of a comma list: what is no option is a format id or an @set."""
    parts = [p.strip() for p in text.split(",") if p.strip()]
    return {LOG_OPTIONS[p] for p in parts if p in LOG_OPTIONS}, [p for p in parts if p not in LOG_OPTIONS]
