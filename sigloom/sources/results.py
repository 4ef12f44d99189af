"""Results files: readers of six layouts, writers of four, replay.

The canonical table is RESULTS: one row per object with its matches as an
array. Readers parse one file per row of ``wholetext`` input, so a results file
is one task; ``read_csv`` reads own CSV files of any size line by line. The
writers make part files, bounded by the partitions, each of which is a whole
results file of its layout. What cannot be read is a row with
the reason in ``errors``: a file that is broken from some place on, or a CSV row
of too few columns.
"""

from __future__ import annotations

import csv
import io
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.scalars import base, evidence, extension, file_uri, parent_folder, yaml_quoted
from sigloom.session import small

MATCH = "struct<ns: string, id: string, format: string, version: string, mime: string, basis: string, warning: string>"
RESULTS = f"source string, seq bigint, filename string, filesize bigint, modified string, errors string, hash string, matches array<{MATCH}>"
_MATCH = pa.struct([(n, pa.string()) for n in ("ns", "id", "format", "version", "mime", "basis", "warning")])
_RESULTS = pa.schema([("source", pa.string()), ("seq", pa.int64()), ("filename", pa.string()), ("filesize", pa.int64()), ("modified", pa.string()), ("errors", pa.string()), ("hash", pa.string()), ("matches", pa.list_(_MATCH))])
# Field names that mean the same.
ALIAS = {"namespace": "ns", "ns": "ns", "id": "id", "identifier": "id", "ID": "id", "warn": "warning", "full": "format"}
#: Ids that stand for an unknown format.
UNKNOWNS = ("", "unknown", "UNKNOWN")
#: Parsed rows per Arrow batch.
BATCH = 10_000


def layout(text: str) -> str:
    """Which layout a results file has, by how it begins."""
    head = text.lstrip("﻿")[:1]
    if head == '"' or text.lstrip("﻿").startswith("ID,"):
        return "droid"
    return {"-": "yaml", "f": "csv", "{": "json", "O": "fido", "K": "fido", "D": "droid_list", "I": "droid"}.get(head, "unknown")


def _match(**k) -> dict:
    return {n: k.get(n) or "" for n in ("ns", "id", "format", "version", "mime", "basis", "warning")}


def _size(text) -> int | None:
    return int(text) if re.fullmatch(r"-?\d+", "" if text is None else str(text).strip()) else None


def parse_csv(text: str):
    """Field groups by the header; consecutive rows of one file name are one file."""
    rows = csv.reader(io.StringIO(text))
    head = next(rows, [])
    starts = [i for i, h in enumerate(head) if ALIAS.get(h, h) == "ns"]
    hashed = starts and starts[0] > 4
    groups = list(zip(starts, [*starts[1:], len(head)]))
    last = None
    for r in rows:
        if len(r) < len(head):
            if last:
                yield tuple(last)
            last = None
            if r:
                yield r[0], None, "", f"results row error: {len(r)} of {len(head)} columns", "", []
            continue
        found = [_match(**{ALIAS.get(head[i], head[i]): r[i] for i in range(a, b)}) for a, b in groups if r[a]]
        if last and last[0] == r[0]:
            last[5].extend(found)
            continue
        if last:
            yield tuple(last)
        last = [r[0], _size(r[1]), r[2], r[3], r[4] if hashed else "", found]
    if last:
        yield tuple(last)


def parse_json(text: str):
    doc = json.loads(text)
    for f in doc.get("files") or []:
        known = ("filename", "filesize", "modified", "errors", "matches")
        hashed = next((v for k, v in f.items() if k not in known), "")
        yield f.get("filename", ""), _size(f.get("filesize")), f.get("modified", ""), f.get("errors", ""), hashed, [_match(**{ALIAS.get(k, k): v for k, v in m.items()}) for m in f.get("matches") or []]


def _scalar(v: str) -> str:
    v = v.strip()
    if v[:1] == "'":
        return v[1:-1].replace("''", "'")
    return json.loads(v) if v[:1] == '"' else v


def parse_yaml(text: str):
    """The documents after the head; only the layout that the writer makes."""
    for doc in re.split(r"(?m)^---\s*$", text)[2:]:
        file, matches = {}, []
        for line in doc.splitlines():
            m = re.match(r"(\s*)(- )?\s*([A-Za-z_0-9]+)\s*:\s?(.*)$", line)
            if not m:
                continue
            indent, dash, key, value = m.groups()
            if not indent and not dash:
                file[key] = _scalar(value)
                continue
            if dash:
                matches.append({})
            matches[-1][ALIAS.get(key, key)] = _scalar(value)
        known = ("filename", "filesize", "modified", "errors", "matches")
        if "filename" in file:
            yield file["filename"], _size(file.get("filesize")), file.get("modified", ""), file.get("errors", ""), next((v for k, v in file.items() if k not in known), ""), [_match(**m) for m in matches]


def parse_droid(text: str):
    """DROID's profile export: folders are left out; several ids stand in one long row or in rows of one path."""
    rows = csv.DictReader(io.StringIO(text), restkey="_more")
    last = None
    for r in rows:
        if r.get("TYPE") == "Folder":
            continue
        warn = "extension mismatch" if (r.get("EXTENSION_MISMATCH") or "").lower() == "true" else ""
        make = lambda p, m, n, v: _match(ns="pronom", id=p or "UNKNOWN", format=n, version=v, mime=m, basis=(r.get("METHOD") or "").lower(), warning=warn)  # noqa: E731,B023
        found = [make(r.get("PUID"), r.get("MIME_TYPE"), r.get("FORMAT_NAME"), r.get("FORMAT_VERSION"))]
        more = r.get("_more") or []
        found += [make(*more[i : i + 4]) for i in range(0, len(more) - 3, 4) if more[i]]
        hashed = next((v for k, v in r.items() if k and k.endswith("_HASH")), "") or ""
        if last and last[0] == r["FILE_PATH"]:
            last[5].extend(found)
            continue
        if last:
            yield tuple(last)
        last = [r["FILE_PATH"], _size(r.get("SIZE")), r.get("LAST_MODIFIED") or "", "" if r.get("STATUS") == "Done" else r.get("STATUS") or "", hashed, found]
    if last:
        yield tuple(last)


def parse_droid_list(text: str):
    """DROID without profile: a preamble, then path,puid split at the last comma."""
    by: dict[str, list] = {}
    for line in text.splitlines():
        path, comma, puid = line.rpartition(",")
        if comma and re.fullmatch(r"(?:x-)?fmt/\d+|Unknown", puid.strip()):
            by.setdefault(path, []).append(_match(ns="pronom", id="UNKNOWN" if puid.strip() == "Unknown" else puid.strip()))
    for path, found in by.items():
        yield path, None, "", "", "", found


def parse_fido(text: str):
    """FIDO's nine columns: OK or KO, ms, puid, format, signature, size, path, mime, basis."""
    last = None
    for r in csv.reader(io.StringIO(text)):
        if len(r) != 9:
            continue
        none = lambda x: "" if x == "None" else x
        m = _match(ns="pronom", id=r[2] if r[0] == "OK" else "UNKNOWN", format=none(r[3]), mime=none(r[7]), basis=r[8])
        if last and last[0] == r[6]:
            last[5].append(m)
            continue
        if last:
            yield tuple(last)
        last = [r[6], _size(r[5]), "", "", "", [m]]
    if last:
        yield tuple(last)


PARSERS = {"csv": parse_csv, "json": parse_json, "yaml": parse_yaml, "droid": parse_droid, "droid_list": parse_droid_list, "fido": parse_fido}


def parsed(text: str | None):
    """The files a results file tells of, then its error, if any."""
    parser = PARSERS.get(layout(text or ""))
    if parser is None:
        yield "", None, "", "results file error: no known layout", "", []
        return
    try:
        yield from parser(text)
    except (ValueError, KeyError, IndexError, AttributeError, TypeError, csv.Error) as e:
        yield "", None, "", f"results file error: {e}", "", []


def parse(texts: DataFrame) -> DataFrame:
    """RESULTS of a table (source, text) of whole results files, whatever their layouts."""

    def arrow(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _RESULTS)], schema=_RESULTS)

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, r in enumerate(parsed(text)):
                    rows.append((source, i, *r))
                    if len(rows) >= BATCH:
                        yield arrow(rows)
                        rows = []
        if rows:
            yield arrow(rows)

    return texts.select("source", "text").mapInArrow(run, RESULTS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """RESULTS of the results files at a path."""
    df = spark.read.text(path, wholetext=True)
    return parse(df.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text")))


#: Files whose headers are broadcast when their lines are read apart.
MAX_FILES = 100_000


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """RESULTS of own CSV files of any size, read line by line over many tasks; no field may hold a line break (``read`` takes such files).

    The rows of one file name in a results file are one file, in the order of the lines; seq tells the order of the files.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for source, at, head, line in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(source, at, *r) for r in parse_csv(f"{head}\n{line}")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _RESULTS)], schema=_RESULTS)

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    is_head = F.col("value").rlike("^\ufeff?filename,")
    heads = lines.where(is_head).groupBy("source").agg(F.min_by("value", F.struct("block", "at")).alias("head"))
    each = lines.where(~is_head & (F.col("value") != "")).join(small(heads, MAX_FILES), "source").select("source", "at", F.ltrim("head", F.lit("\ufeff")).alias("head"), "value")
    x = each.mapInArrow(run, RESULTS)
    rest = ("filesize", "modified", "errors", "hash")
    g = x.groupBy("source", "filename").agg(F.min("seq").alias("seq"), *(F.min_by(c, "seq").alias(c) for c in rest), F.array_sort(F.collect_list(F.struct("seq", "matches"))).alias("ms"))
    return g.select("source", "seq", "filename", *rest, F.flatten(F.transform("ms", lambda m: m["matches"])).alias("matches"))


def is_known(matches: Column) -> Column:
    """Whether any match has a known id."""
    return F.exists(matches, lambda m: ~F.coalesce(m["id"], F.lit("")).isin(*UNKNOWNS))


def has_warning(matches: Column) -> Column:
    return F.exists(matches, lambda m: F.coalesce(m["warning"], F.lit("")) != "")


# -- writers -----------------------------------------------------------------------------------------------------------
FIELDS = ("ns", "id", "format", "version", "mime", "basis", "warning")


def csv_rows(results: DataFrame, namespaces: list[str]) -> DataFrame:
    """The rows of the CSV layout: file columns, then a group of fields per namespace; n-th matches share the n-th row."""
    file = ("seq", "filename", "filesize", "modified", "errors")
    of = lambda ns: F.filter("matches", lambda m: m["ns"] == F.lit(ns))
    per = [of(ns) for ns in namespaces]
    rows = F.greatest(F.lit(1), *(F.size(p) for p in per)) if len(per) > 1 else F.greatest(F.lit(1), F.size(per[0]))
    x = results.select(*file, *(p.alias(f"m{i}") for i, p in enumerate(per)), F.explode(F.sequence(F.lit(0), rows - 1)).alias("row"))
    cols = []
    for i, ns in enumerate(namespaces):
        m = F.get(f"m{i}", F.col("row"))
        cols += [F.coalesce(F.lit(ns) if f == "ns" else m[f], F.lit("")).alias(f if len(namespaces) == 1 else f"{f}_{ns}") for f in FIELDS]
    return x.select(*file, "row", *cols)


def _files_of(lines: DataFrame, path: str, first: str, last: str | None = None, joiner: str = "") -> None:
    """Text part files of the column ``value``: every part begins with ``first``, ends with ``last``, and has ``joiner`` before all values but its first."""
    schema = pa.schema([("value", pa.string())])

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([first])], schema=schema)
        begun = False
        for batch in batches:
            values = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([v if not (begun or i) else joiner + v for i, v in enumerate(values)], pa.string())], schema=schema)
            begun = begun or bool(values)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last])], schema=schema)

    lines.select("value").mapInArrow(run, "value string").write.mode("overwrite").text(path)


def json_lines(results: DataFrame) -> DataFrame:
    """seq, value: the JSON object of each file in the own layout; all strings are escaped."""
    m = F.transform("matches", lambda m: F.struct(*(m[f].alias(f) for f in FIELDS)))
    return results.select("seq", F.to_json(F.struct("filename", "filesize", "modified", "errors", m.alias("matches"))).alias("value"))


def write_json(results: DataFrame, head: dict, path: str) -> None:
    """The JSON layout as part files, each with ``head`` as the members before ``files``."""
    _files_of(json_lines(results), path, json.dumps(head, ensure_ascii=False)[:-1] + ',"files":[', "]}", ",")


def write_yaml(results: DataFrame, head: dict, identifiers: list[tuple[str, str]], path: str) -> None:
    """The YAML layout as part files."""
    docs = yaml_documents(results).select(F.regexp_replace("value", r"\n\z", "").alias("value"))
    _files_of(docs, path, yaml_head(head, identifiers).removesuffix("\n"))


def yaml_documents(results: DataFrame) -> DataFrame:
    """seq, value: the YAML document of each file; keys are padded to the longest."""
    width = max(map(len, FIELDS))
    line = lambda m, f, first: F.concat(F.lit(f"  {'-' if first else ' '} {f.ljust(width)} : "), yaml_quoted(F.coalesce(m[f], F.lit(""))), F.lit("\n"))
    match = lambda m: F.concat(*(line(m, f, i == 0) for i, f in enumerate(FIELDS)))
    value = F.concat(
        F.lit("---\nfilename : "), yaml_quoted(F.col("filename")), F.lit("\nfilesize : "), F.coalesce(F.col("filesize").cast("string"), F.lit("")), F.lit("\nmodified : "), F.coalesce("modified", F.lit("")),
        F.lit("\nerrors   : "), yaml_quoted(F.coalesce("errors", F.lit(""))), F.lit("\nmatches  :\n"), F.array_join(F.transform("matches", match), ""),
    )
    return results.select("seq", value.alias("value"))


def yaml_head(head: dict, identifiers: list[tuple[str, str]]) -> str:
    width = max(len("identifiers"), *map(len, head))
    quote = lambda s: "'" + str(s).replace("'", "''") + "'"
    return "---\n" + "".join(f"{k.ljust(width)} : {quote(v)}\n" for k, v in head.items()) + f"{'identifiers'.ljust(width)} : \n" + "".join(f"  - name    : {quote(n)}\n    details : {quote(d)}\n" for n, d in identifiers)


def droid_rows(results: DataFrame, hash_name: str = "md5") -> DataFrame:
    """The DROID layout: one row per match and one per folder, numbered by path, with the parent folder's number."""
    path = F.regexp_replace("filename", r"\\", "/")
    files = results.select(path.alias("FILE_PATH"), F.col("filesize").alias("SIZE"), F.col("modified").alias("LAST_MODIFIED"), "errors", "hash", "matches", F.lit("File").alias("kind"))
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(1))), lambda i: F.array_join(F.slice(F.split(path, "/"), F.lit(1), i), "/"))
    folders = results.select(F.explode(up).alias("FILE_PATH")).distinct().where("FILE_PATH != ''").join(files.select("FILE_PATH"), "FILE_PATH", "left_anti")
    none = lambda t: F.lit(None).cast(t)
    folders = folders.select("FILE_PATH", none("bigint").alias("SIZE"), none("string").alias("LAST_MODIFIED"), none("string").alias("errors"), none("string").alias("hash"), none(f"array<{MATCH}>").alias("matches"), F.lit("Folder").alias("kind"))
    both = files.unionByName(folders)
    # numbers follow the order of the paths; a distributed number would need zipWithIndex, so it is derived from the path
    both = both.withColumn("ID", F.xxhash64("FILE_PATH")).withColumn("PARENT_ID", F.when(parent_folder(F.col("FILE_PATH")) != "", F.xxhash64(parent_folder(F.col("FILE_PATH")))))
    known = F.filter("matches", lambda m: ~m["id"].isin(*UNKNOWNS))
    x = both.withColumn("FORMAT_COUNT", F.when(F.col("kind") == "File", F.size(known))).withColumn("m", F.explode_outer(known))
    is_file = F.col("kind") == "File"
    return x.select(
        "ID", "PARENT_ID", file_uri(F.col("FILE_PATH"), ~is_file).alias("URI"), "FILE_PATH", base(F.col("FILE_PATH")).alias("NAME"),
        F.when(is_file, evidence(F.coalesce("m.basis", F.lit("")))).otherwise("").alias("METHOD"),
        F.when(F.coalesce("errors", F.lit("")) != "", F.col("errors")).otherwise("Done").alias("STATUS"), "SIZE",
        F.when(is_file & F.exists(F.coalesce("matches", F.expr(f"cast(array() as array<{MATCH}>)")), lambda m: m["basis"].like("container%")), "Container").otherwise(F.col("kind")).alias("TYPE"),
        F.when(is_file, extension(base(F.col("FILE_PATH")))).otherwise("").alias("EXT"), "LAST_MODIFIED",
        F.when(is_file & F.coalesce(F.col("m.warning").like("%extension mismatch%"), F.lit(False)), "true").otherwise("false").alias("EXTENSION_MISMATCH"),
        F.col("hash").alias(f"{hash_name.upper()}_HASH"), "FORMAT_COUNT", F.col("m.id").alias("PUID"), F.col("m.mime").alias("MIME_TYPE"), F.col("m.format").alias("FORMAT_NAME"), F.col("m.version").alias("FORMAT_VERSION"),
    )


def from_identification(files: DataFrame, resolved: DataFrame, infos: DataFrame) -> DataFrame:
    """RESULTS of identification output: files (path; length, modified, error, hash if there), resolved rows and the catalogue's infos.

    seq is derived from the path, as a running number would need a global order.
    """
    have = set(files.columns)
    own = lambda c, t: F.col(c).cast(t) if c in have else F.lit(None).cast(t)
    r = resolved.join(infos.select("ns", "id", F.col("name").alias("format"), "version", F.col("mime").alias("type")), ["ns", "id"], "left")
    m = F.struct("ns", "rank", F.struct("ns", "id", F.coalesce("format", F.lit("")).alias("format"), F.coalesce("version", F.lit("")).alias("version"), F.coalesce("type", F.lit("")).alias("mime"), "basis", "warning").alias("m"))
    told = F.max("errors").alias("told") if "errors" in resolved.columns else F.lit("").alias("told")
    g = r.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(m)), lambda x: x["m"]).alias("matches"), told)
    slim = files.select("path", own("length", "bigint").alias("filesize"), F.coalesce(own("modified", "string"), F.lit("")).alias("modified"), own("error", "string").alias("error"), F.coalesce(own("hash", "string"), F.lit("")).alias("hash"))
    errors = F.concat_ws("; ", F.nullif("error", F.lit("")), F.nullif("told", F.lit("")))
    return slim.join(g, "path", "left").select(F.lit("scan").alias("source"), F.xxhash64("path").alias("seq"), F.col("path").alias("filename"), "filesize", "modified", errors.alias("errors"), "hash", "matches")


def write_csv(results: DataFrame, namespaces: list[str], path: str) -> None:
    """The CSV layout as part files: the file's columns, then a group of columns per namespace, under one header."""
    rows = csv_rows(results, namespaces)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    columns = [c for c in rows.columns if c not in ("seq", "row")]
    head = ["filename", "filesize", "modified", "errors", *(["namespace", *FIELDS[1:]] * len(namespaces))]
    _files_of(rows.select(F.concat_ws(",", *map(quoted, columns)).alias("value")), path, ",".join(head))


__all__ = ["read", "read_csv", "parse", "layout", "csv_rows", "json_lines", "write_json", "write_yaml", "yaml_documents", "yaml_head", "droid_rows", "from_identification", "write_csv", "is_known", "has_warning"]
