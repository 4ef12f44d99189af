"""Rows that fail to parse, apart from those that load.

For each schema (the number of columns its header names) one anchored regular
expression is generated that a whole sound row must match; only rows that fail
it go through incremental prefix patterns, which tell the first broken field.
Everything is a Catalyst expression; the one join attaches the header's width.
Possessive quantifiers keep every pattern linear, also on very long lines.

Defined results: a null line is the empty line; a line whose scan has no header
fails with ``column_count``; keys may be null; repeated deliveries of a key
count once (of several reasons, the first in the order below); an empty table
gives no rows; other columns of the input are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.session import cut, small

#: The reasons, first that holds.
REASONS = ("quoting", "column_count", "filename", "filesize", "modified")
#: More scans than this are joined by shuffle instead of broadcast (a row has 12 bytes).
MAX_SCANS = 500_000
#: Up to so many schemas get a compiled pattern each; beyond, the pattern is built per row.
MAX_SCHEMAS = 200

QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
FIELD = rf'(?:{QUOTED}|[^",]*+)'
RECORD = rf"\A{FIELD}(?:,{FIELD})*+\z"


def at_most(limit: int) -> str:
    """Pattern of the decimal numbers without sign up to ``limit``, leading zeros allowed, and of the empty text."""
    top = str(limit)
    exact = [top[:i] + f"[0-{int(d) - 1}]" + f"[0-9]{{{len(top) - i - 1}}}" for i, d in enumerate(top) if d != "0"]
    return rf"0*+(?:[0-9]{{0,{len(top) - 1}}}|{'|'.join([*exact, top])})"


def real_timestamp() -> str:
    """Pattern of the timestamps that exist in the calendar, with optional fraction and zone."""
    days = r"(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))"
    leap = r"(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)-02-29"
    clock = r"(?:[01][0-9]|2[0-3]):[0-5][0-9]"
    return rf"(?!0000)(?:[0-9]{{4}}-{days}|{leap})T{clock}:[0-5][0-9](?:\.[0-9]+)?(?:Z|[+-]{clock})?"


def either(pattern: str) -> str:
    """The pattern as a plain or a quoted field, up to its end."""
    return rf'(?:"(?:{pattern})"|(?:{pattern}))(?=,|\z)'


NAME = r'(?:"(?=[\s\p{Z}]*+(?:[^\s\p{Z}"]|""))[^"]*+(?:""[^"]*+)*+"|(?=[\s\p{Z}]*+[^\s\p{Z}",])[^",]*+)(?=,|\z)'
SIZE = either(rf"-1|{at_most(2**63 - 1)}")
TIME = either(rf"(?:{real_timestamp()})?")
#: The patterns of the leading fields, by position; all further fields are free.
LEADING = (NAME, SIZE, TIME)


def row_pattern(width: int) -> str:
    """The anchored pattern of a whole sound row of a schema with ``width`` columns."""
    lead = ",".join(LEADING[: min(width, 3)])
    return rf"\A{lead}(?:,{FIELD}){{{max(width - 3, 0)}}}\z"


def plain_lines(lines: DataFrame) -> DataFrame:
    """scan_no, line_no, line: the records without their line end."""
    line = F.regexp_replace(F.coalesce("raw_line", F.lit("")), r"\r\z", "")
    return lines.select("scan_no", "line_no", line.alias("line"))


def n_fields(line: Column) -> Column:
    """Number of fields of a sound record."""
    bare = F.regexp_replace(line, r'"[^"]*"', "")
    return F.length(bare) - F.length(F.translate(bare, ",", "")) + 1


def header_widths(lines: DataFrame) -> DataFrame:
    """scan_no, width: the number of columns each scan's header names. Read once and cut, as it is looked at several times."""
    return cut(plain_lines(lines).where("line_no = 1 and scan_no is not null").groupBy("scan_no").agg(F.max(n_fields(F.col("line"))).alias("width")))


def sound(widths: list[int] | None) -> Column:
    """Whether a line matches the pattern of its schema."""
    line, width = F.col("line"), F.col("width")
    if widths is None:
        lead = ",".join(LEADING)
        wide = F.concat(F.lit(rf"\A{lead}(?:,{FIELD}){{"), (width - 3).cast("string"), F.lit(r"}\z"))
        pattern = F.when(width == 1, row_pattern(1)).when(width == 2, row_pattern(2)).otherwise(wide)
        return F.coalesce(F.regexp_like(line, pattern), F.lit(False))
    ladder = F.lit(False)
    for w in widths:
        ladder = F.when(width == w, line.rlike(row_pattern(w))).otherwise(ladder)
    return ladder


def prefix_patterns(width: int) -> list[tuple[str, str]]:
    """(reason, pattern) of a schema, each taking in more than the one before: a record of any fields, of the schema's number, then its typed fields one by one."""
    lead = [(r, r"\A" + ",".join(LEADING[: k + 1])) for k, r in enumerate(REASONS[2:])]
    return [("quoting", RECORD), ("column_count", rf"\A{FIELD}(?:,{FIELD}){{{width - 1}}}\z"), *lead[: min(width, 3)]]


def reason(widths: list[int] | None) -> Column:
    """The first of the schema's prefix patterns that a line does not match."""
    line, width = F.col("line"), F.col("width")
    found = F.lit(None).cast("string")
    for at in reversed(range(2, len(REASONS))):
        typed = dict(prefix_patterns(3))[REASONS[at]]
        found = F.when((width > at - 2) & ~line.rlike(typed), REASONS[at]).otherwise(found)
    if widths is None:
        counted = F.regexp_like(line, F.concat(F.lit(rf"\A{FIELD}(?:,{FIELD}){{"), (width - 1).cast("string"), F.lit(r"}\z")))
    else:
        counted = F.lit(False)
        for w in widths:
            counted = F.when(width == w, line.rlike(dict(prefix_patterns(w))["column_count"])).otherwise(counted)
    return F.when(~line.rlike(RECORD), "quoting").when(width.isNull() | ~F.coalesce(counted, F.lit(False)), "column_count").otherwise(found)


def classified(lines: DataFrame, max_schemas: int = MAX_SCHEMAS) -> DataFrame:
    """The data lines with their header's ``width`` and the ``reason``, null where the line is sound.

    Up to ``max_schemas`` distinct widths get a compiled pattern each, else the pattern is built per row.
    """
    heads = header_widths(lines)
    found = [r.width for r in heads.select("width").distinct().limit(max_schemas + 1).collect()]
    x = plain_lines(lines).where("line_no is distinct from 1").join(small(heads, MAX_SCANS), "scan_no", "left")
    widths = sorted(found) if len(found) <= max_schemas else None
    return x.withColumn("reason", F.when(~sound(widths), reason(widths)))


def rejected(lines: DataFrame, max_schemas: int = MAX_SCHEMAS) -> DataFrame:
    """scan_no, line_no, reason of the lines that cannot be loaded."""
    rank = F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason"))
    bad = classified(lines, max_schemas).where("reason is not null").groupBy("scan_no", "line_no").agg(F.min(rank).alias("r"))
    return bad.select("scan_no", F.col("line_no").cast("int").alias("line_no"), F.element_at(F.array(*map(F.lit, REASONS)), F.col("r").cast("int")).alias("reason"))


def loaded(lines: DataFrame, max_schemas: int = MAX_SCHEMAS) -> DataFrame:
    """scan_no, line_no, path, size, mod (UTC wall time) of the sound lines."""

    def field(n: int) -> Column:
        got = F.regexp_extract("line", rf"\A({FIELD}),({FIELD}),({FIELD})", n)
        return F.when(got.startswith('"'), F.replace(F.regexp_replace(got, r'\A"|"\z', ""), F.lit('""'), F.lit('"'))).otherwise(got)

    good = classified(lines, max_schemas).where("reason is null")
    cols = good.select("scan_no", F.col("line_no").cast("int").alias("line_no"), field(1).alias("path"), field(2).alias("size"), field(3).alias("mod"))
    zone = F.regexp_extract("mod", r"([+-])([0-9]{2}):([0-9]{2})\z", 0)
    minutes = F.when(zone != "", F.expr("cast(substring(z, 2, 2) as int) * 60 + cast(substring(z, 5, 2) as int)") * F.when(zone.startswith("-"), -1).otherwise(1)).otherwise(0)
    wall = F.try_to_timestamp(F.regexp_extract("mod", r"\A([0-9-]{10}T[0-9:]{8})", 1), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")
    out = cols.withColumn("z", zone).withColumn("mod_utc", wall - F.make_dt_interval(F.lit(0), F.lit(0), minutes))
    return out.select("scan_no", "line_no", "path", F.expr("try_cast(nullif(size, '') as bigint)").alias("size"), F.date_format("mod_utc", "yyyy-MM-dd HH:mm:ss").alias("mod_utc")).dropDuplicates(["scan_no", "line_no"])
