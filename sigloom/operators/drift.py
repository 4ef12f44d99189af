"""Schemas that drift between files.

The header of every results file is read where it lies, in parallel, into its
schema: the items it has, how each is spelled and its type in a lattice of
types (int < long < double < text, bool < text, list < text, object < text,
where text holds the JSON of what fits nowhere else). A fold over the lattice
gives the union schema of all items and members, the unified heads are
generated from it - one column per member, cast to the union type - and
consecutive schemas of a collection are compared item by item under the same
lattice, which gives the ordered differences.

The predecessor of a header is found without gathering a collection in one
task: the headers are ranged by collection and time, a window works inside each
range, and the last header of each range (one small row) is handed to the next.

Defined results: null members and headers that are no JSON object count as
missing members; a header without collection or time has no predecessor and is
none; of the deliveries of a scan the last arrival holds; equal times are ordered
by scan number; names are compared without outer blanks; whole numbers beyond a
long count as double; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.session import cut

#: Spellings of a field and the item they stand for; other fields stand for themselves.
ALIASES = {"ns": "namespace", "identifier": "id", "ID": "id", "warn": "warning"}
#: Names of the member that holds the program's version.
VERSION_MEMBERS = ("program", "version", "program_version")

ITEM = "struct<item string, name string, typ string>"


#: The numbers of the lattice, each promoting to the next.
NUMBERS = ("int", "long", "double")
#: Spark's types of the lattice's.
CASTS = {"bool": "boolean", "int": "int", "long": "bigint", "double": "double", "list": "array<string>"}
#: Members that are items of their own kind, so not listed as plain members.
OWN = (*VERSION_MEMBERS, "fields", "hash_header")
#: Columns of the unified heads; more members than this are refused (``member_values`` has them in long form).
MAX_MEMBERS = 1000


def lattice_type(v: Column) -> Column:
    """Type of a variant in the lattice; null where it is null or absent."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (s == "VOID"), None)
        .when(s.startswith("ARRAY"), "list")
        .when(s.startswith("OBJECT"), "object")
        .when(s == "STRING", "text")
        .when(s == "BOOLEAN", "bool")
        .when(s == "BIGINT", F.when(F.try_variant_get(v, "$", "int").isNotNull(), "int").otherwise("long"))
        .otherwise("double")
    )


def kind(typ: Column) -> Column:
    """The JSON type behind a type of the lattice: all numbers are one."""
    return F.when(typ.isin(*NUMBERS), "number").otherwise(typ)


def promote(a: Column, b: Column) -> Column:
    """The least type that holds both; null holds nothing."""
    rank = lambda t: F.array_position(F.array(*map(F.lit, NUMBERS)), t)
    number = F.element_at(F.array(*map(F.lit, NUMBERS)), F.greatest(rank(a), rank(b)).cast("int"))
    return F.when(a.isNull(), b).when(b.isNull() | (a == b), a).when(a.isin(*NUMBERS) & b.isin(*NUMBERS), number).otherwise("text")


def fold(types: Column) -> Column:
    """The least type that holds all of an array of types."""
    return F.aggregate(types, F.lit(None).cast("string"), promote)


def _items() -> Column:
    """The schema of one header, as an array of items."""
    found = [F.try_variant_get("v", f"$.{m}", "variant") for m in VERSION_MEMBERS]
    version = F.coalesce(*(F.when(lattice_type(v).isNotNull(), F.struct(F.lit("version").alias("item"), F.lit(m).alias("name"), lattice_type(v).alias("typ"))) for v, m in zip(found, VERSION_MEMBERS)))
    header = F.trim(F.try_variant_get("v", "$.hash_header", "string"))
    hashed = F.when(F.coalesce(header, F.lit("")) != "", F.struct(F.lit("hash").alias("item"), header.alias("name"), F.lit("text").alias("typ")))
    groups = F.try_variant_get("v", "$.fields", "array<variant>")
    spaces = F.try_variant_get("v", "$.identifiers", "array<array<string>>")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(groups, lambda g: kind(lattice_type(g))), lambda k: k.isNotNull()))), "|")
    member = F.when(F.size(groups) >= 0, F.struct(F.lit("fields").alias("item"), F.lit("fields").alias("name"), kinds.alias("typ")))

    def names(g: Column) -> Column:
        listed = F.try_variant_get(g, "$", "array<string>")
        return F.when(lattice_type(g) == "list", listed).otherwise(F.split(F.try_variant_get(g, "$", "string"), ","))

    def of_group(g: Column, i: Column) -> Column:
        space = F.trim(F.coalesce(F.get(F.get(spaces, i), F.lit(0)), F.lit("")))
        kept = F.filter(F.transform(names(g), lambda n: F.trim(n)), lambda n: n.isNotNull() & (n != ""))
        return F.transform(kept, lambda n: F.struct(F.concat(space, F.lit("."), alias(n)).alias("item"), n.alias("name"), F.lit("text").alias("typ")))

    def alias(n: Column) -> Column:
        out = n
        for a, b in ALIASES.items():
            out = F.when(n == a, b).otherwise(out)
        return out

    listed = F.flatten(F.filter(F.transform(groups, of_group), lambda x: x.isNotNull()))
    fixed = F.filter(F.array(version, hashed, member), lambda x: x.isNotNull())
    return F.concat(fixed, F.coalesce(listed, F.expr(f"cast(array() as array<{ITEM}>)")))


def head_schemas(heads: DataFrame) -> DataFrame:
    """scan_no, collection, scanned, v (the parsed header), items (item, name, typ): one row per scan."""
    last = F.max(F.struct("arrived_at", F.col("collection_code").alias("collection"), "scanned", "head_json")).alias("x")
    once = heads.where("scan_no is not null").groupBy("scan_no").agg(last).select("scan_no", "x.collection", "x.scanned", F.expr("try_parse_json(x.head_json)").alias("v"))
    return once.withColumn("items", _items())


def with_previous(df: DataFrame, key: str, order: list[str], value: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``previous``: value of the row before, in the order, of the same key; null for the first of a key.

    The ranges are sampled and cut, so that both uses below see the same ones. A range of a key is the largest group that
    one task sorts; a hot key takes several ranges.
    """
    ranged = df.repartitionByRange(*([ranges] if ranges else []), key, *order)
    x = cut(ranged.withColumn("_b", F.spark_partition_id()))
    last = x.groupBy(key, "_b").agg(F.max_by(F.struct(F.col(value).alias("value")), F.struct(*order)).alias("_last"))
    before = last.select(F.col(key).alias("_k"), F.col("_b").alias("_b2"), F.lag("_last").over(Window.partitionBy(key).orderBy("_b")).alias("_before")).where("_before is not null")
    x = x.withColumn("_p", F.lag(F.struct(F.col(value).alias("value"))).over(Window.partitionBy(key, "_b").orderBy(*order)))
    y = x.join(before, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_b2")) & F.col("_p").isNull(), "left")
    return y.withColumn("previous", F.coalesce("_p", "_before")["value"]).drop("_b", "_p", "_k", "_b2", "_before")


def head_changes(heads: DataFrame, ranges: int | None = None) -> DataFrame:
    """scan_no, item, change_kind, old_name, new_name, old_type, new_type, union_type between consecutive scans of a collection.

    union_type is the least type that holds both; an item is retyped where that is of another JSON type than one of them.
    """
    known = head_schemas(heads).where("collection is not null and scanned is not null").select("scan_no", "collection", "scanned", "items")
    pairs = with_previous(known, "collection", ["scanned", "scan_no"], "items", ranges).where("previous is not null")
    names = F.array_distinct(F.concat(F.transform("previous", lambda i: i["item"]), F.transform("items", lambda i: i["item"])))

    def at(c: str, item: Column) -> Column:
        return F.get(F.filter(c, lambda i: i["item"] == item), F.lit(0))

    both = F.transform(names, lambda n: F.struct(n.alias("item"), at("previous", n).alias("old"), at("items", n).alias("new")))
    x = pairs.select("scan_no", F.explode(both).alias("d")).select("scan_no", "d.item", F.col("d.old.name").alias("old_name"), F.col("d.new.name").alias("new_name"), F.col("d.old.typ").alias("old_type"), F.col("d.new.typ").alias("new_type"), F.col("d.old").isNull().alias("was_not"), F.col("d.new").isNull().alias("is_not")).withColumn("union_type", promote(F.col("old_type"), F.col("new_type")))
    there = ~F.col("was_not") & ~F.col("is_not")
    kinds = F.array(
        F.when(F.col("was_not"), "added"),
        F.when(F.col("is_not"), "removed"),
        F.when(there & (F.col("old_name") != F.col("new_name")), "renamed"),
        F.when(there & ~(kind(F.col("union_type")).eqNullSafe(kind(F.col("old_type"))) & kind(F.col("union_type")).eqNullSafe(kind(F.col("new_type")))), "retyped"),
    )
    return x.withColumn("change_kind", F.explode(kinds)).where("change_kind is not null").select("scan_no", "item", "change_kind", "old_name", "new_name", "old_type", "new_type", "union_type")


def member_values(schemas: DataFrame) -> DataFrame:
    """scan_no, scanned, member, v, typ: the plain members of every header in long form."""
    each = schemas.select("scan_no", "scanned", "v").lateralJoin(schemas.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return each.where(F.col("key").isNotNull() & ~F.col("key").isin(*OWN)).select("scan_no", "scanned", F.col("key").alias("member"), F.col("value").alias("v"), lattice_type(F.col("value")).alias("typ")).where("typ is not null")


def union_schema(heads: DataFrame) -> DataFrame:
    """item, union_type, n_scans, n_names, first_scanned, last_scanned: the fold of the items and members of all headers.

    Items are those of ``head_changes``; every other member of a header is an item ``head.<member>``.
    """
    x = head_schemas(heads)
    items = x.select("scan_no", "scanned", F.explode("items").alias("i")).select("scan_no", "scanned", "i.item", "i.name", "i.typ")
    members = member_values(x).select("scan_no", "scanned", F.concat(F.lit("head."), F.col("member")).alias("item"), F.col("member").alias("name"), "typ")
    g = items.unionByName(members).groupBy("item").agg(
        F.array_sort(F.collect_set("typ")).alias("types"), F.count_distinct("scan_no").alias("n_scans"), F.count_distinct("name").alias("n_names"), F.min("scanned").alias("first_scanned"), F.max("scanned").alias("last_scanned")
    )
    return g.select("item", fold(F.col("types")).alias("union_type"), "n_scans", "n_names", "first_scanned", "last_scanned")


def cast_to(v: Column, typ: str, joiner: str | None = None) -> Column:
    """A variant as the Spark type of a lattice type; in a text column, what is no text is its JSON, or a list joined by ``joiner``."""
    if typ in CASTS:
        return F.try_variant_get(v, "$", CASTS[typ])
    as_list = F.to_json(v) if joiner is None else F.array_join(F.try_variant_get(v, "$", "array<string>"), joiner)
    plain = F.when(lattice_type(v) == "list", as_list).when(lattice_type(v) == "text", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
    return F.when(lattice_type(v).isNotNull(), plain)


def unified_heads(heads: DataFrame, max_members: int = MAX_MEMBERS) -> DataFrame:
    """One row per scan with a column per member of the union schema, cast to its union type.

    scan_no, collection, scanned, version (of any of its names; a list as dotted text), hash_column, fields (the field
    items in the header's order), then the other members by name; a name that is taken gets ``head_`` before it.
    """
    schema = {r["item"]: r["union_type"] for r in union_schema(heads).where("item = 'version' or item like 'head.%'").orderBy("item").limit(max_members + 2).collect()}
    if len(schema) > max_members + 1:
        raise ValueError(f"more than {max_members} members; take them in long form with member_values")
    x = head_schemas(heads)
    get = lambda m: F.try_variant_get("v", f"$['{m}']", "variant")
    version = F.coalesce(*(F.when(lattice_type(get(m)).isNotNull(), cast_to(get(m), schema.get("version") or "text", ".")) for m in VERSION_MEMBERS))
    hashed = F.get(F.filter("items", lambda i: i["item"] == "hash"), F.lit(0))["name"]
    fields = F.filter(F.transform("items", lambda i: i["item"]), lambda n: F.contains(n, F.lit(".")))
    out = x.select("scan_no", "collection", "scanned", version.alias("version"), F.lower(hashed).alias("hash_column"), fields.alias("fields"), "v")
    named = [(n.removeprefix("head."), t) for n, t in schema.items() if n != "version"]
    free = lambda n: n if n not in out.columns else f"head_{n}"
    odd = [n for n, _ in named if "'" in n or "\\" in n]
    if odd:  # names that no path can hold come out of the long form
        long = member_values(x).where(F.col("member").isin(odd)).groupBy("scan_no").agg(*(F.first(F.when(F.col("member") == n, F.col("v")), True).alias(f"_odd{k}") for k, n in enumerate(odd)))
        out = out.join(long, "scan_no", "left")
    at = lambda n: F.col(f"_odd{odd.index(n)}") if n in odd else get(n)
    return reduce(lambda df, nt: df.withColumn(free(nt[0]), cast_to(at(nt[0]), nt[1])), named, out).drop("v", *(f"_odd{k}" for k in range(len(odd))))
