"""Archive-registry vocabularies: format reports, DROID signature files, container signatures, release notes."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.frames import BOF, EOF, PREV, SUCC, Frame, Signature
from sigloom.functions.patterns import Alt, Cat
from sigloom.sources.catalog import Catalog
from sigloom.sources.expressions import NotationError, from_end, from_start, number, parse_items, signature_of

#: Schema of a format report's FileFormat element; missing members read as null.
REPORT = (
    "FormatID string, FormatName string, FormatVersion string, FormatFamilies string, FormatTypes string, FormatDescription string, "
    "FormatIdentifier array<struct<Identifier: string, IdentifierType: string>>, "
    "ExternalSignature array<struct<Signature: string, SignatureType: string>>, "
    "InternalSignature array<struct<SignatureID: string, ByteSequence: array<struct<PositionType: string, Offset: string, MaxOffset: string, Endianness: string, ByteSequenceValue: string>>>>, "
    "RelatedFormat array<struct<RelationshipType: string, RelatedFormatID: string, RelatedFormatName: string>>"
)


#: Reports that are compiled on the driver at most.
MAX_REPORTS = 200_000


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per format report: puid and the report's members."""
    df = spark.read.format("xml").option("rowTag", "FileFormat").schema(REPORT).load(path)
    puid = F.get(F.filter("FormatIdentifier", lambda i: i["IdentifierType"] == "PUID"), F.lit(0))["Identifier"]
    return df.withColumn("puid", puid)


def report_mimes(reports: DataFrame) -> DataFrame:
    return reports.select("puid", F.explode("FormatIdentifier").alias("i")).where("i.IdentifierType = 'MIME'").select("puid", F.trim("i.Identifier").alias("mime"))


def report_relations(reports: DataFrame) -> DataFrame:
    """(sub, sup) puid edges of the reports' relations."""
    by_id = reports.select("FormatID", F.col("puid").alias("other"))
    r = reports.select("puid", F.explode("RelatedFormat").alias("r")).select("puid", F.trim("r.RelationshipType").alias("typ"), F.col("r.RelatedFormatID").alias("FormatID")).join(by_id, "FormatID")
    below = F.col("typ").isin("Has lower priority than", "Is supertype of")
    above = F.col("typ").isin("Has priority over", "Is subtype of")
    return r.where(below | above).select(F.when(below, F.col("puid")).otherwise(F.col("other")).alias("sub"), F.when(below, F.col("other")).otherwise(F.col("puid")).alias("sup")).distinct()


def from_reports(reports: DataFrame, ns: str = "pronom", multi: str = "conclusive") -> Catalog:
    """A catalogue of the reports. Catalogues are a few thousand formats, so they are compiled on the driver."""
    c = Catalog(ns, "format reports", multi)
    by_id = {}
    rows = reports.limit(MAX_REPORTS + 1).collect()
    if len(rows) > MAX_REPORTS:
        raise ValueError(f"more than {MAX_REPORTS} reports")
    for r in rows:
        by_id[r.FormatID] = r.puid
    for r in rows:
        mimes = [i.Identifier.strip() for i in r.FormatIdentifier or [] if i.IdentifierType == "MIME" and i.Identifier]
        c.infos.append((ns, r.puid, r.FormatName or "", r.FormatVersion or "", ", ".join(mimes), r.FormatTypes or ""))
        c.mimes += [(ns, r.puid, m) for m in mimes]
        for s in r.ExternalSignature or []:
            if s.SignatureType == "File extension" and s.Signature:
                c.globs.append((ns, r.puid, "ext", s.Signature.lower(), 0, 50))
        for s in r.InternalSignature or []:
            c.signatures.append((ns, r.puid, signature_of([(b.PositionType, b.Offset, b.MaxOffset, b.ByteSequenceValue) for b in s.ByteSequence or []]), 0))
        for rel in r.RelatedFormat or []:
            other = by_id.get(rel.RelatedFormatID)
            if other and (rel.RelationshipType or "").strip() in ("Has lower priority than", "Is supertype of"):
                c.priorities.append((ns, r.puid, other))
            elif other and (rel.RelationshipType or "").strip() in ("Has priority over", "Is subtype of"):
                c.priorities.append((ns, other, r.puid))
    return c.closed_priorities()


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _kids(e: ET.Element, name: str) -> list[ET.Element]:
    return [k for k in e.iter() if _local(k) == name]


def droid_frames(sequence: ET.Element) -> list[Frame]:
    """Frames of a DROID byte sequence: its subsequences with their left and right fragments, by position."""
    reference = sequence.get("Reference", "Variable")
    eof, variable = reference.lower().startswith("eof"), reference.lower() in ("variable", "")
    subs = [k for k in sequence if _local(k) == "SubSequence"]
    shift = 1 if any(number(s.get("Position")) == 0 for s in subs) else 0
    out: list[list[Frame]] = []
    for s in sorted(subs, key=lambda s: number(s.get("Position"))):
        position = number(s.get("Position")) + shift
        low, top = number(s.get("SubSeqMinOffset")), s.get("SubSeqMaxOffset")
        high: int | None = number(top) or low if top not in (None, "") else None if variable or position > 1 else low
        if high is not None and high < low:
            high = low
        core = next((k.text or "" for k in s if _local(k) == "Sequence"), "")
        items, _ = parse_items(core)
        parts = [(gap, p) for gap, p in items]

        def fragments(name):
            by: dict[int, list] = {}
            for k in s:
                if _local(k) == name:
                    by.setdefault(number(k.get("Position")), []).append(k)
            got = []
            for pos in sorted(by):
                options = [parse_items(k.text or "")[0] for k in by[pos]]
                k = by[pos][0]
                # a choice takes the patterns of a fragment in a row, without the gaps between them
                items = options[0] if len(options) == 1 else [((0, 0), Alt(tuple(o[0][1] if len(o) == 1 else Cat(tuple(p for _, p in o)) for o in options)))]
                got.append(((number(k.get("MinOffset")), number(k.get("MaxOffset")) if k.get("MaxOffset") not in (None, "") else None), items))
            return got

        left, right = fragments("LeftFragment"), fragments("RightFragment")
        # a left fragment's offset lies between it and its neighbour to the right
        chain = list(parts)
        for gap, items in left:
            chain = [((0, 0), items[0][1]), *items[1:], (gap, chain[0][1]), *chain[1:]]
        for gap, items in right:
            chain += [(gap, items[0][1]), *items[1:]]
        first_gap = (low, high)
        if eof:
            frames = [Frame(p, SUCC, *g) for (_, p), (g, _) in zip(chain, chain[1:])] + [Frame(chain[-1][1], EOF if position == 1 else SUCC, *first_gap)]
        else:
            frames = [Frame(chain[0][1], BOF if position == 1 else PREV, *first_gap)] + [Frame(p, PREV, *g) for g, p in chain[1:]]
        out.append(frames)
    return [f for frames in (reversed(out) if eof else out) for f in frames]


def _internal(e: ET.Element) -> Signature:
    front, back = [], []
    for seq in _kids(e, "ByteSequence"):
        frames = droid_frames(seq)
        (back if frames[-1].orient == EOF else front).extend(frames)
    return Signature(tuple(front + back))


def from_droid(xml: str, ns: str = "pronom", multi: str = "conclusive") -> Catalog:
    """A catalogue of a DROID signature file."""
    root = ET.fromstring(xml)
    c = Catalog(ns, "DROID signatures", multi)
    sigs = {e.get("ID"): _internal(e) for e in _kids(root, "InternalSignature")}
    formats = _kids(root, "FileFormat")
    puid = {e.get("ID"): e.get("PUID") for e in formats}
    for e in formats:
        i = e.get("PUID")
        mimes = [m.strip() for m in (e.get("MIMEType") or "").split(",") if m.strip()]
        c.infos.append((ns, i, e.get("Name") or "", e.get("Version") or "", ", ".join(mimes), ""))
        c.mimes += [(ns, i, m) for m in mimes]
        for k in e:
            if _local(k) == "Extension" and k.text:
                c.globs.append((ns, i, "ext", k.text.lower(), 0, 50))
            elif _local(k) == "InternalSignatureID" and k.text in sigs:
                c.signatures.append((ns, i, sigs[k.text], 0))
            elif _local(k) == "HasPriorityOverFileFormatID" and k.text in puid:
                c.priorities.append((ns, puid[k.text], i))
    return c.closed_priorities()


def add_containers(c: Catalog, xml: str) -> Catalog:
    """The catalogue with the container signatures of a file; of a path given twice in a signature the last holds."""
    root = ET.fromstring(xml)
    puid: dict[str, list[str]] = {}
    for m in _kids(root, "FileFormatMapping"):
        puid.setdefault(m.get("signatureId"), []).append(m.get("Puid"))
    containers, parts, numbered = list(c.containers), list(c.parts), {}
    for e in _kids(root, "ContainerSignature"):
        files: dict[str, list[str]] = {}
        for f in _kids(e, "File"):
            path = next((k.text for k in f if _local(k) == "Path"), "")
            sigs = [_internal(s) for s in _kids(f, "InternalSignature")]
            files[path] = [r for s in sigs for r in s.regexes()]
        for i in puid.get(e.get("Id"), []):
            n = numbered[i] = numbered.get(i, 0) + 1
            containers.append((c.ns, i, e.get("ContainerType"), n, 0, len(files)))
            for k, (path, regexes) in enumerate(files.items(), 1):
                is_glob = any(x in path for x in "*?") and "[Content_Types].xml" not in path
                parts.append((c.ns, i, e.get("ContainerType"), n, k, path, is_glob, tuple(regexes)))
    containers = [(*r[:4], numbered.get(r[1], r[4]), r[5]) for r in containers]
    from dataclasses import replace

    return replace(c, containers=containers, parts=parts)


RELEASE = "release_date string, version_name string, release_outline array<struct<_type: string, format: array<struct<puid: struct<_VALUE: string, _type: string>>>>>"


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    """release, kind (new, updated, signatures), puid of release notes."""
    df = spark.read.format("xml").option("rowTag", "release_note").schema(RELEASE).load(path)
    x = df.select("release_date", F.explode("release_outline").alias("o")).select("release_date", F.col("o._type").alias("kind"), F.explode("o.format").alias("f"))
    return x.select("release_date", "kind", F.concat_ws("/", "f.puid._type", "f.puid._VALUE").alias("puid"))


def release_stats(notes: DataFrame) -> DataFrame:
    """year, n_releases, n_new, n_updated, n_signatures."""
    year = F.regexp_extract("release_date", r"([0-9]{4})", 1)
    n = lambda k: F.sum((F.col("kind") == k).cast("bigint"))
    return notes.groupBy(year.alias("year")).agg(F.count_distinct("release_date").alias("n_releases"), n("new").alias("n_new"), n("updated").alias("n_updated"), n("signatures").alias("n_signatures"))


def release_sets(notes: DataFrame) -> DataFrame:
    """set, members: one set of ids per release and kind."""
    return notes.groupBy(F.concat_ws(" ", "release_date", "kind").alias("set")).agg(F.array_sort(F.collect_set("puid")).alias("members"))


def compile_notation(df: DataFrame, key: str, position: str, low: str, high: str, notation: str) -> DataFrame:
    """Compile pattern notations as data, where there are too many for the driver.

    key, regexes, n_frames, least (bytes a match has at least), literal_side, error: null regexes where the text is not
    in the notation. One Arrow pass, no shuffle.
    """
    import pyarrow as pa

    schema = pa.schema([(key, pa.string()), ("regexes", pa.list_(pa.string())), ("n_frames", pa.int32()), ("least", pa.int32()), ("literal_side", pa.string()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for k, pos, lo, hi, text in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    s = signature_of([(pos, lo, hi, text or "")])
                    rows.append((k, s.regexes(), len(s.frames), sum(f.pattern.lengths()[0] for f in s.frames), (s.literal() or ("none",))[0], None))
                except (NotationError, ValueError) as e:
                    rows.append((k, None, None, None, None, str(e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    cols = [F.col(key).cast("string").alias(key), *(F.col(x).cast("string") for x in (position, low, high, notation))]
    return df.select(*cols).mapInArrow(run, f"{key} string, regexes array<string>, n_frames int, least int, literal_side string, error string")


__all__ = ["read_reports", "report_mimes", "report_relations", "from_reports", "from_droid", "add_containers", "read_releases", "release_stats", "release_sets", "compile_notation", "from_start", "from_end"]
