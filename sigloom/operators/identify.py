"""Identification end to end: files and catalogues to results."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators.matchers import all_hits
from sigloom.operators.resolve import MODES, resolve, resolve_mime
from sigloom.session import cut, small, spread
from sigloom.sources import archives
from sigloom.sources.catalog import Catalog


#: Identified archives up to which their kinds are broadcast; beyond, files and kinds are joined by shuffle.
MAX_ARCHIVES = 1_000_000


@dataclass
class ScanOptions:
    """What a scan does besides matching."""

    mode: str = "conclusive"
    dominance: str = "set"
    #: archive kinds to expand, none by default
    expand: tuple = ()
    max_depth: int | None = None
    #: tell the archives among the files by their identified id instead of their first bytes
    by_id: bool = False
    #: checksum to add: md5, sha1, sha256, sha512 or crc
    checksum: str | None = None


#: Namespaces that follow the rules of MIME-info.
MIMEINFO = ("mimeinfo", "tika", "freedesktop")


def identify(files: DataFrame, catalogs: list[Catalog], mode: str = "conclusive", dominance: str = "set", mimeinfo: tuple = MIMEINFO) -> DataFrame:
    """path, ns, rank, id, confidence, basis, warning, errors of every file for every namespace; files has path, mime, content.

    The files are read in one pass, whatever the number of matchers and namespaces. Where namespaces of both kinds of
    rules are asked, the hits (small rows) are cut, so that the second kind does not read the files again.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    hits = all_hits(spread(files), catalogs)
    typed, plain = [c for c in catalogs if c.ns in mimeinfo], [c for c in catalogs if c.ns not in mimeinfo]
    if typed and plain and not files.isStreaming:
        hits = cut(hits)
    of = lambda cs: hits.where(F.col("ns").isin([c.ns for c in cs])) if typed and plain else hits
    columns = ("path", "ns", "rank", "id", "confidence", "basis", "warning", "errors")
    out = [resolve(of(plain), plain, mode, dominance)] if plain else []
    out += [resolve_mime(of(typed), typed, mode).withColumn("confidence", F.lit(0)).select(*columns)] if typed else []
    return reduce(DataFrame.unionByName, out)


def scan(files: DataFrame, catalogs: list[Catalog], options: ScanOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """(files with what their archives hold, results)."""
    from sigloom.functions.scalars import checksum

    o = options or ScanOptions()
    if o.expand:
        if o.by_id:
            found = archives.archive_kinds(identify(files, catalogs, o.mode, o.dominance), o.expand)
            files = files.join(small(cut(found), MAX_ARCHIVES), "path", "left")
        files = archives.expand(files, o.expand, o.max_depth)
    if o.checksum:
        files = files.withColumn("hash", checksum(F.col("content"), o.checksum))
    return files, identify(files, catalogs, o.mode, o.dominance)
