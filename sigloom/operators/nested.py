"""Deeply nested semi-structured records to related flat tables.

Each record is parsed as a stream of tokens, never as a tree, into
path-value-ordinal triples. Every repeated ancestor (``Signatures[*]``, ...)
is a group of paths, and each group pivots into one table whose key is the
record's key and the ordinals; the record itself is the root table, so every
child row has its parent row. One parse feeds all tables. All triples of an
entity come from one record, so the map-side half of the aggregate folds them
before the shuffle, and a very large record spreads over many (record,
ordinals) groups and is never held as triples in memory.

Defined results: a lone object is a list of one; a JSON text in place of a
list stands for that list; null and non-object elements of a list of entities
are skipped and not counted; missing, null and empty members give nothing; of
a member named twice in one object the last holds; a record that is not a
valid JSON object (RFC 8259) gives nothing, nor does a null record; repeated
deliveries of a key fold into one; other columns are never read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.session import cut, spread

#: The repeated members of a format report; a member below another repeats within it.
REPORT = {"Signatures": {"ByteSequences": {}}, "Relations": {}, "Identifiers": {}}
#: Tables: the root, and one per repeated ancestor.
CHILDREN = {"signature": "$.Signatures[*]", "byte_sequence": "$.Signatures[*].ByteSequences[*]", "relation": "$.Relations[*]", "identifier": "$.Identifiers[*]"}
TABLES = {"report": "$"} | CHILDREN
#: Lists of plain values that are tables of their own; a lone value is a list of one.
VALUES = {"extension": "$.Extensions[*]"}
PARENTS = {"signature": "report", "byte_sequence": "signature", "relation": "report", "identifier": "report", "extension": "report"}
#: Members that are columns of their own; all others go into ``more``.
MEMBERS = {
    "report": ["Id", "Name", "Version", "Description"],
    "signature": ["Note"],
    "byte_sequence": ["Position", "Offset", "MaxOffset", "Endianness", "Hex", "IndirectLoc"],
    "relation": ["Typ", "Id"],
    "identifier": ["Typ", "Id"],
    "extension": ["value"],
}
#: Triples per Arrow batch.
BATCH = 50_000
#: Characters of a text whose triples are held at once; a longer one is walked twice (valid? then again for its triples).
HELD = 1 << 20

TOKEN = re.compile(
    r'[ \t\n\r]*(?:(?P<text>"[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*")'
    r"|(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(?P<word>true|false|null)|(?P<mark>[\[\]{},:]))"
)
SPACE = re.compile(r"[ \t\n\r]*")
KINDS = {"number": "number", "word": "bool"}


class _Frame:
    """An open object or list: its path, ordinals and the repeated members known below it."""

    __slots__ = ("is_list", "spec", "path", "ords", "entities", "count", "key", "seen", "mute")

    def __init__(self, is_list, spec, path, ords, entities=False, mute=False):
        self.is_list, self.spec, self.path, self.ords, self.entities, self.mute = is_list, spec, path, ords, entities, mute
        self.count, self.key, self.seen = 0, None, {}


class Invalid(ValueError):
    """The text is not valid JSON."""


def _text(tok: str) -> str:
    """The text of a string token."""
    return json.loads(tok) if "\\" in tok else tok[1:-1]


def _place(frame: _Frame | None, root: tuple, begin: int, muted) -> tuple:
    """Path, ordinals, spec and role of the value that begins here: root, member, element, plain or mute."""
    if frame is None:
        return root
    if frame.is_list:
        if frame.mute:
            return "", (), {}, "mute"
        if frame.entities:
            return frame.path, (*frame.ords, frame.count), frame.spec, "element"
        frame.count += 1
        return frame.path, (*frame.ords, frame.count - 1), {}, "plain"
    frame.seen[frame.key] = begin
    if frame.mute or begin in muted:
        return "", (), {}, "mute"
    below = frame.path + "." + frame.key
    if frame.key in frame.spec:
        return below + "[*]", frame.ords, frame.spec[frame.key], "member"
    return below, frame.ords, {}, "plain"


def walk(text: str, spec: dict, path: str = "$", ords: tuple = (), member: bool = False, muted=frozenset(), again: set | None = None) -> Iterator[tuple]:
    """(path, ordinals, kind, value) of a JSON text in document order, token by token; raises ``Invalid`` where it is none.

    ``member``: the text stands for a repeated member at ``path``, so only a list or an object gives triples. Values that
    begin at a place in ``muted`` give nothing. ``again`` gathers the places of values whose name comes again later in
    the same object. Memory is that of the open objects, not of the text's size.
    """
    stack: list[_Frame] = []
    end, last, done, scan = len(text), 0, False, TOKEN.scanner(text)
    root = (path, ords, spec, "member" if member else "root")
    want = "value"  # value, first (value or ]), key, key1 (key or }), colon, next
    while (m := scan.match()) is not None:
        kind = m.lastgroup
        tok, last = m.group(kind), m.end()
        top = stack[-1] if stack else None
        if done:
            raise Invalid
        if want in ("key", "key1") and kind == "text":
            key = _text(tok)
            if again is not None and key in top.seen:
                again.add(top.seen[key])
            top.key, want = key, "colon"
            continue
        if want == "colon":
            if tok != ":":
                raise Invalid
            want = "value"
            continue
        if tok == "}" and want in ("key1", "next") and top and not top.is_list or tok == "]" and want in ("first", "next") and top and top.is_list:
            stack.pop()
        elif tok == "," and want == "next":
            want = "value" if top.is_list else "key"
            continue
        elif want not in ("value", "first") or kind == "mark" and tok not in "{[":
            raise Invalid
        else:
            p, o, s, role = _place(top, root, m.start(kind), muted)
            if tok == "{":
                if role == "member":
                    o = (*o, 0)
                if role in ("member", "element", "root"):
                    yield p, o, "object", None
                    if role == "element":
                        top.count += 1
                stack.append(_Frame(False, s if role != "plain" else {}, p, o, mute=role == "mute"))
                want = "key1"
                continue
            if tok == "[":
                stack.append(_Frame(True, s, p, o, True) if role == "member" else _Frame(True, {}, p + "[*]", o, mute=role == "mute"))
                want = "first"
                continue
            if role == "member" and kind == "text":
                yield from streamed(_text(tok), s, p, o, True)
            elif role == "plain":
                if kind == "text":
                    yield p, o, "text", _text(tok)
                else:
                    yield (p, o, "null", None) if tok == "null" else (p, o, KINDS[kind], tok)
        # a value has ended
        done, want = not stack, "next"
    if not done or SPACE.match(text, last).end() != end:
        raise Invalid


def triples(text: str, spec: dict, path: str = "$", ords: tuple = (), member: bool = False) -> list[tuple] | None:
    """All triples of a JSON text at once; None if it is not valid."""
    again: set = set()
    try:
        out = list(walk(text, spec, path, ords, member, again=again))
        return list(walk(text, spec, path, ords, member, again)) if again else out
    except Invalid:
        return None


def streamed(text: str, spec: dict, path: str = "$", ords: tuple = (), member: bool = False, held: int | None = None) -> Iterator[tuple]:
    """The triples of a JSON text, none if it is not valid. A text beyond ``held`` characters is walked twice and never held as triples."""
    if len(text) <= (HELD if held is None else held):
        yield from triples(text, spec, path, ords, member) or ()
        return
    again: set = set()
    try:
        for _ in walk(text, {}, path, ords, False, again=again):
            pass
    except Invalid:
        return
    yield from walk(text, spec, path, ords, member, again)


SCHEMA = "rec_no bigint, path string, ords array<int>, kind string, value string"
ARROW = pa.schema([("rec_no", pa.int64()), ("path", pa.string()), ("ords", pa.list_(pa.int32())), ("kind", pa.string()), ("value", pa.string())])


def json_triples(df: DataFrame, key: str, payload: str, spec: dict) -> DataFrame:
    """rec_no, path, ords, kind, value of every record that is a valid JSON object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)
        rows: list[tuple] = []
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None or not text.lstrip(" \t\n\r").startswith("{"):
                    continue
                for t in streamed(text, spec):
                    rows.append((k, *t))
                    if len(rows) >= BATCH:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    return spread(df.select(F.col(key).cast("bigint").alias("rec_no"), F.col(payload).alias("payload"))).mapInArrow(run, SCHEMA)


def entities(found: DataFrame, ancestors: dict[str, str] = TABLES, values: dict[str, str] = VALUES) -> DataFrame:
    """rec_no, child_kind, ords, members: the pivot of every group of paths, all groups in one aggregate.

    A path belongs to its longest ancestor; what is left of it is the member's name, with the ordinals of plain lists
    behind @. The triples of an entity come from one task, so the aggregate's map side folds them to one row each. Of
    two deliveries of a member the greater value holds.
    """
    name, depth, rest = F.lit(None).cast("string"), F.lit(0), F.lit("")
    below = lambda a: (F.col("path") == a) | F.col("path").startswith(a + ".")
    for kind, a in sorted(ancestors.items(), key=lambda x: len(x[1])):
        name, depth = F.when(below(a), kind).otherwise(name), F.when(below(a), a.count("[*]")).otherwise(depth)
        rest = F.when(below(a), F.substring("path", len(a) + 2, 1_000_000)).otherwise(rest)
    for kind, a in values.items():
        one = F.col("path").isin(a, a.removesuffix("[*]"))
        name, depth, rest = F.when(one, kind).otherwise(name), F.when(one, 1).otherwise(depth), F.when(one, "value").otherwise(rest)
    x = found.select("rec_no", name.alias("child_kind"), "ords", "kind", "value", depth.alias("depth"), rest.alias("rest")).where("child_kind is not null")
    extra = F.size("ords") > F.col("depth")
    at = F.when(extra, F.concat("rest", F.lit("@"), F.array_join(F.slice("ords", F.col("depth") + 1, F.size("ords") - F.col("depth")).cast("array<string>"), ","))).otherwise(F.col("rest"))
    own = F.when((F.size("ords") == 0) & (F.col("depth") == 1), F.array(F.lit(0))).otherwise(F.slice("ords", F.lit(1), F.col("depth")))
    is_entity = (F.col("kind") == "object") | (F.col("child_kind").isin(*values) & F.col("value").isNotNull())
    pair = F.when((F.col("kind") != "object") & F.col("value").isNotNull(), F.struct(at.alias("name"), F.col("value").alias("value")))
    g = x.groupBy("rec_no", "child_kind", own.alias("ords")).agg(F.max(is_entity.cast("int")).alias("is_entity"), F.array_sort(F.collect_set(pair)).alias("pairs")).where("is_entity = 1")
    last = F.filter("pairs", lambda p, i: F.coalesce(F.get("pairs", i + 1)["name"] != p["name"], F.lit(True)))
    return g.select("rec_no", "child_kind", "ords", F.map_from_entries(last).alias("members"))


def table_of(rows: DataFrame, child: str) -> DataFrame:
    """One flat table out of ``entities``: the record's key, its ordinals, a column per declared member and ``more`` (JSON of the others)."""
    declared = MEMBERS[child]
    depth = (TABLES | VALUES)[child].count("[*]")
    places = [F.col("ords")[i].alias(n) for i, n in zip(range(depth), ("pos", "sub_pos", "sub_sub_pos"))]
    rest = F.map_filter("members", lambda k, _: ~k.isin(declared))
    return rows.where(F.col("child_kind") == child).select("rec_no", *places, *(F.try_element_at("members", F.lit(m)).alias(m.lower()) for m in declared), F.when(F.size(rest) > 0, F.to_json(rest)).alias("more"))


def flat_tables(df: DataFrame) -> dict[str, DataFrame]:
    """All flat tables of the reports from one parse of the payloads, which is cut (every table is a scan of it)."""
    rows = cut(entities(json_triples(df, "rec_no", "payload", REPORT)))
    return {child: table_of(rows, child) for child in MEMBERS}


def report_table(df: DataFrame, child: str) -> DataFrame:
    """One of the flat tables alone."""
    return table_of(entities(json_triples(df, "rec_no", "payload", REPORT)), child)


def report_children(df: DataFrame) -> DataFrame:
    """rec_no, child_kind, pos, sub_pos: the keys of the rows of the four child tables, every object once."""
    rows = entities(json_triples(df, "rec_no", "payload", REPORT)).where(F.col("child_kind").isin(list(CHILDREN)))
    return rows.select("rec_no", "child_kind", F.col("ords")[0].alias("pos"), F.when(F.size("ords") > 1, F.col("ords")[1]).otherwise(-1).alias("sub_pos"))


def table_links(df: DataFrame) -> DataFrame:
    """child_table, parent_table, n_rows, n_parents, n_lost: the links of all tables to their parents, from one parse."""
    t, out = flat_tables(df), None
    for child, parent in PARENTS.items():
        on = ["rec_no", "pos"] if parent == "signature" else ["rec_no"]
        x = t[child].groupBy(*on).agg(F.count("*").alias("n")).join(t[parent].select(*on, F.lit(1).alias("held")), on, "left")
        y = x.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("held").alias("n_parents"), F.count_if(F.col("held").isNull()).alias("n_lost"))
        y = y.select(F.lit(child).alias("child_table"), F.lit(parent).alias("parent_table"), "n_rows", "n_parents", "n_lost")
        out = y if out is None else out.unionByName(y)
    return out
