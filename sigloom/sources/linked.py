"""Linked-data format records: SPARQL result bindings condensed to records, checked, and made a catalogue.

Reading, condensing, linting and the summary are DataFrame operations; only the
final compilation happens on the driver, of at most ``MAX_RECORDS`` records.
Which of the sequences of a record belong together is not said by the data, so a
record whose sequences cannot be told apart has no signatures (``sound``).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.frames import Signature
from sigloom.sources.catalog import Catalog
from sigloom.sources.expressions import NotationError, from_end, from_start

#: The variables of the query's result.
VARIABLES = ("uri", "uriLabel", "puid", "extension", "mimetype", "encoding", "referenceLabel", "date", "relativity", "offset", "sig")
# Items of the encodings and relativities.
ENCODINGS = {"Q82828": "hexadecimal", "Q98056596": "hexadecimal", "Q8815": "ascii", "Q5532625": "guid", "Q98056564": "perl", "Q35432091": "pronom"}
RELATIVITIES = {"Q35436009": "BOF", "Q1148480": "EOF"}
# The members of a file of an own endpoint's items.
PROPERTIES = ("PronomProp", "BofProp", "EofProp")
#: Records that are compiled on the driver at most.
MAX_RECORDS = 200_000


def own_properties(text: str) -> tuple[dict[str, str], dict[str, str]]:
    """(encodings, relativities) for an endpoint with items of its own, from its JSON file of addresses; other encodings stay."""
    said = json.loads(text)
    lost = [p for p in PROPERTIES if not said.get(p)]
    if lost:
        raise ValueError(f"missing: {', '.join(lost)}")
    pronom, bof, eof = (said[p].rsplit("/", 1)[-1] for p in PROPERTIES)
    return {k: v for k, v in ENCODINGS.items() if v != "pronom"} | {pronom: "pronom"}, {bof: "BOF", eof: "EOF"}


def read_bindings(spark: SparkSession, path: str) -> DataFrame:
    """One row per binding of a SPARQL JSON result, a text column per variable (unbound ones are null) and whether the offset is a blank node."""
    cell = "struct<value: string, type: string>"
    schema = f"results struct<bindings: array<struct<{', '.join(f'{v}: {cell}' for v in VARIABLES)}>>>"
    df = spark.read.option("multiLine", True).schema(schema).json(path)
    return df.select(F.explode("results.bindings").alias("b")).select(*(F.col(f"b.{v}.value").alias(v) for v in VARIABLES), F.coalesce(F.col("b.offset.type") == "bnode", F.lit(False)).alias("offsetBlank"))


def item(c: Column) -> Column:
    """Last part of an item's address."""
    return F.substring_index(c, "/", -1)


def named(c: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(item(c) == k, v).otherwise(out)
    return out


def hex_of(sig: Column, encoding: Column) -> Column:
    """A signature as registry notation: hex is kept, ASCII becomes hex, simple Perl gaps become {n}; GUIDs are rejected."""
    bare = F.regexp_replace(F.regexp_replace(sig, r"\s", ""), r"\\x|0x", "")
    is_hex = bare.rlike(r"^(?:[0-9A-Fa-f]{2})+$")
    perl = F.upper(F.regexp_replace(F.regexp_replace(F.regexp_replace(sig, r"\\x", ""), r"\.\{(\d+)\}", "{$1}"), r"\s", ""))
    return (
        F.when(encoding == "guid", None)
        .when(encoding == "pronom", sig)
        .when(encoding == "perl", perl)
        .when(encoding == "ascii", F.hex(F.encode(sig, "UTF-8")))
        .when(is_hex, F.upper(bare))
        .otherwise(F.when(encoding == "hexadecimal", None).otherwise(F.lit(None).cast("string")))
    )


def _told(bindings: DataFrame, encodings: dict, relativities: dict) -> DataFrame:
    """The bindings with id, enc, rel and notation."""
    blank = F.col("offsetBlank") if "offsetBlank" in bindings.columns else F.lit(False)
    b = bindings.withColumn("id", item(F.col("uri"))).withColumn("enc", F.coalesce(named(F.col("encoding"), encodings), F.lit("unknown"))).withColumn("blank", blank)
    return b.withColumn("rel", F.when(F.col("relativity").isNull(), "BOF").otherwise(named(F.col("relativity"), relativities))).withColumn("notation", hex_of(F.col("sig"), F.col("enc")))


def _soundness(told: DataFrame) -> DataFrame:
    """id, sound: whether the sequences of a record can be told apart.

    All are of a known place and can be read; two must differ in place or sequence, more must share one encoding and at most
    one stated place; places are stated for all or for none; no two end the file; both ends of one signature share their encoding.
    """
    given = F.struct(F.coalesce("sig", F.lit("")).alias("sig"), F.coalesce("offset", F.lit("")).alias("offset"), F.coalesce("encoding", F.lit("")).alias("encoding"), F.coalesce("relativity", F.lit("")).alias("relativity"))
    g = told.where("sig is not null").groupBy("id").agg(
        F.collect_set(given).alias("seqs"), F.bool_or(F.col("rel").isNull() | F.col("notation").isNull()).alias("broken"),
        F.count_distinct(F.when(F.col("rel") == "EOF", F.col("notation"))).alias("ends"), F.count_distinct("enc").alias("encs"), F.count_distinct("rel").alias("sides"),
    )
    of = lambda f: F.array_distinct(F.transform("seqs", lambda s: s[f]))
    places = F.size(F.filter(of("relativity"), lambda r: r != ""))
    stated = F.size(F.filter("seqs", lambda s: s["relativity"] != ""))
    n = F.size("seqs")
    two = (n == 2) & ((places == 2) | (F.size(of("sig")) == 2))
    many = (n <= 2) | ((F.size(of("encoding")) == 1) & (places <= 1))
    return g.select("id", (~F.col("broken") & (two | (many & ((stated == 0) | (stated == n)))) & (F.col("ends") <= 1) & ~((F.col("sides") == 2) & (F.col("encs") > 1))).alias("sound"))


def lint(bindings: DataFrame, encodings: dict = ENCODINGS, relativities: dict = RELATIVITIES) -> DataFrame:
    """uri, code, critical: what is wrong with each binding that has a signature, one row per finding; critical is what costs a record its signatures."""
    told = _told(bindings, encodings, relativities)
    b = told.where("sig is not null").join(_soundness(told), "id")
    note = lambda code, critical: F.struct(F.lit(code).alias("code"), F.lit(critical).alias("critical"))
    sound = F.array_compact(
        F.array(
            F.when(F.col("enc") == "unknown", note("no encoding", False)),
            F.when(F.col("relativity").isNull(), note("no relativity", False)),
            F.when(F.col("blank"), note("blank offset", False)).when(F.col("offset").isNotNull() & F.expr("try_cast(offset as int) is null"), note("bad offset", False)),
            F.when(F.col("offset").isNull(), note("no offset", False)),
            F.when(F.coalesce("referenceLabel", F.lit("")) == "", note("no provenance", False)),
            F.when(F.coalesce("date", F.lit("")) == "", note("no provenance date", False)),
        )
    )
    broken = F.array_compact(
        F.array(
            note("bad heuristic", True),
            F.when(F.col("rel").isNull(), note("unknown relativity", False)),
            F.when(F.col("notation").isNull(), note("bad sequence", False)),
        )
    )
    return b.select("id", F.explode(F.when(F.col("sound"), sound).otherwise(broken)).alias("n")).select(F.col("id").alias("uri"), "n.code", "n.critical").distinct()


def condense(bindings: DataFrame, encodings: dict = ENCODINGS, relativities: dict = RELATIVITIES) -> DataFrame:
    """One record per item: name, distinct puids, extensions, MIME types and, where sound, signatures (notation, relativity, offset, source, date)."""
    told = _told(bindings, encodings, relativities)
    sig = F.when(
        F.col("sig").isNotNull() & F.col("sound"),
        F.struct("notation", F.col("rel").alias("relativity"), F.when(F.col("blank"), 0).otherwise(F.coalesce(F.expr("try_cast(offset as int)"), F.lit(0))).alias("offset"), F.coalesce("referenceLabel", F.lit("")).alias("source"), F.coalesce("date", F.lit("")).alias("date")),
    )
    some = lambda c: F.array_sort(F.collect_set(c))
    x = told.join(_soundness(told), "id", "left")
    return x.groupBy(F.col("id").alias("uri")).agg(F.max("uriLabel").alias("name"), some("puid").alias("puids"), some(F.lower("extension")).alias("extensions"), some("mimetype").alias("mimes"), some(sig).alias("signatures"))


def summary(records: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts over all records, as one row."""
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    a = records.agg(F.count("*").alias("n_records"), n(F.size("puids") > 0).alias("with_puid"), n(F.size("extensions") > 0).alias("with_extension"), n(F.size("mimes") > 0).alias("with_mime"), n(F.size("signatures") > 0).alias("with_signature"), n(F.size("puids") > 1).alias("with_several_puids"))
    b = findings.agg(F.count("*").alias("n_findings"), n(F.col("critical")).alias("n_critical"))
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def signatures_of(sigs) -> list[tuple[Signature, str]]:
    """(signature, source) of a record: sequences of one source and date from both sides form one signature."""
    groups: dict[tuple, dict[str, list]] = {}
    for s in sigs:
        if s["notation"] and s["offset"] >= 0:
            groups.setdefault((s["source"], s["date"]), {"BOF": [], "EOF": []})[s["relativity"]].append(s)
    out = []
    for (source, date), by in groups.items():
        ends = [from_end(s["notation"], s["offset"], s["offset"]) for s in by["EOF"]]
        starts = [from_start(s["notation"], s["offset"], s["offset"]) for s in by["BOF"]]
        label = f"{source} (source date: {date})" if date else source
        if len(starts) == 1 and len(ends) == 1:
            out.append((Signature((*starts[0], *ends[0])), label))
        else:
            out += [(Signature(tuple(f)), label) for f in (*starts, *ends)]
    return out


def from_linked(records: DataFrame, ns: str = "wikidata", multi: str = "conclusive", registry: Catalog | None = None) -> Catalog:
    """A catalogue of condensed records; with a registry also its signatures of the formats they link to."""
    from sigloom.sources.library import borrowed

    c = Catalog(ns, "linked-data format records", multi)
    rows = records.limit(MAX_RECORDS + 1).collect()
    if len(rows) > MAX_RECORDS:
        raise ValueError(f"more than {MAX_RECORDS} records")
    for r in rows:
        c.infos.append((ns, r.uri, r.name or "", "", ", ".join(r.mimes), ""))
        c.globs += [(ns, r.uri, "ext", e, 0, 50) for e in r.extensions]
        c.mimes += [(ns, r.uri, m) for m in r.mimes]
        try:
            c.signatures += [(ns, r.uri, s, 0) for s, _ in signatures_of([x.asDict() for x in r.signatures])]
        except NotationError as e:
            c.notes.append((ns, r.uri, f"signatures left out: {e}"))
        if registry:
            c = c.join(borrowed(registry, {p: r.uri for p in r.puids}, ns))
    return c


__all__ = ["read_bindings", "condense", "lint", "summary", "from_linked", "signatures_of", "hex_of", "item"]
