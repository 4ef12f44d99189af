"""Result algebra: compare, chart, filters, sets from results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.scalars import base
from sigloom.sources.results import has_warning, is_known

#: Ways to recognise a file in several results.
KEYS = {
    "path": lambda: F.col("filename"),
    "name": lambda: base(F.col("filename")),
    "name_size": lambda: F.concat(base(F.col("filename")), F.coalesce(F.col("filesize").cast("string"), F.lit(""))),
    "name_modified": lambda: F.concat(base(F.col("filename")), F.coalesce("modified", F.lit(""))),
    "name_hash": lambda: F.concat(base(F.col("filename")), F.coalesce("hash", F.lit(""))),
    "hash": lambda: F.coalesce("hash", F.lit("")),
}
MISSING = "MISSING"


def id_text(ids: Column) -> Column:
    """Sorted ids joined by ;"""
    return F.array_join(F.array_sort(ids), ";")


def compare(results: list[DataFrame], key: str = "path", differences: bool = True) -> DataFrame:
    """key, path, r1, r2, ...: the ids each result gives a file; ``MISSING`` where it lacks it.

    One aggregate over the union instead of n outer joins. Of a key that occurs twice in a result, the last row holds.
    """
    k = KEYS[key]()
    tagged = None
    for i, r in enumerate(results, 1):
        x = r.select(k.alias("key"), F.lit(i).alias("i"), F.struct("seq", "filename", id_text(F.transform("matches", lambda m: m["id"])).alias("ids")).alias("v"))
        tagged = x if tagged is None else tagged.unionByName(x)
    cols = [F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"v{i}") for i in range(1, len(results) + 1)]
    g = tagged.groupBy("key").agg(*cols)
    names = [F.coalesce(F.col(f"v{i}.ids"), F.lit(MISSING)).alias(f"r{i}") for i in range(1, len(results) + 1)]
    out = g.select("key", F.coalesce(*(F.col(f"v{i}.filename") for i in range(1, len(results) + 1))).alias("path"), *names)
    same = F.size(F.array_distinct(F.array(*(F.col(f"r{i}") for i in range(1, len(results) + 1))))) == 1
    return out.where(~same) if differences else out.where(same)


def chart(ids: DataFrame, width: int = 10) -> DataFrame:
    """ns, id, n, bar: how often each id occurs in each namespace, with a bar scaled to the most frequent one (at least one square)."""
    n = ids.groupBy("ns", "id").agg(F.count("*").alias("n"))
    most = n.groupBy("ns").agg(F.max("n").alias("most"))
    return n.join(most, "ns").select("ns", "id", "n", F.expr(f"repeat('■', greatest(1, cast(n * {width} div most as int)))").alias("bar"))


def keep(results: DataFrame, what: str, ids: list[str] | None = None) -> DataFrame:
    """Rows of a log option: known, unknown, warning, error, or those with any of some ids."""
    m = F.col("matches")
    return results.where(
        {"known": lambda: is_known(m), "unknown": lambda: ~is_known(m), "warning": lambda: has_warning(m), "error": lambda: F.coalesce("errors", F.lit("")) != "", "ids": lambda: F.exists(m, lambda x: x["id"].isin(*(ids or [""])))}[what]()
    )


def grouped_sets(rows: DataFrame, name: Column, member: Column) -> DataFrame:
    """set, members: one set per distinct name."""
    return rows.select(name.alias("set"), member.alias("member")).where("set is not null and set != '' and member is not null").groupBy("set").agg(F.array_sort(F.collect_set("member")).alias("members"))


def camel(c: Column) -> Column:
    """Words joined in camel case, other characters left out."""
    return F.regexp_replace(F.initcap(F.regexp_replace(c, "[^A-Za-z0-9]+", " ")), " ", "")


def family_sets(reports: DataFrame, family: str, member: str, sep: str = "[,;]") -> DataFrame:
    """Sets of ids by family or type name; a report may name several."""
    x = reports.select(F.explode(F.split(F.col(family), sep)).alias("f"), F.col(member).alias("member"))
    return grouped_sets(x, camel(F.trim("f")), F.col("member"))


def extension_sets(registry: DataFrame, exts: str = "exts", member: str = "ident_id") -> DataFrame:
    x = registry.select(F.explode(exts).alias("e"), F.col(member).alias("member"))
    return grouped_sets(x, F.lower(F.trim("e")), F.col("member"))


def fpr_reply(results: DataFrame, limit: int = 1024) -> DataFrame:
    """filename, reply: the short answer of the socket service, at most ``limit`` bytes long.

    The id of a file with one known id; else an error that tells the failed scan, the warning of an unknown format, the
    several ids, or that there are none. A character cut by the limit is left out.
    """
    ids, one = F.transform("matches", lambda m: m["id"]), F.get("matches", F.lit(0))
    text = lambda c: F.coalesce(c, F.lit(""))
    said = (
        F.when((text(F.col("errors")) != "") & (F.size("matches") <= 0), F.concat(F.lit("error: failed to scan "), "filename", F.lit("; got "), "errors"))
        .when(F.coalesce(F.size("matches"), F.lit(0)) <= 0, F.concat(F.lit("error: scanning "), "filename", F.lit(": no formats returned")))
        .when(F.size("matches") > 1, F.concat(F.lit("error: multiple formats returned; got "), F.array_join(ids, ", ")))
        .when(text(one["id"]).isin("", "unknown", "UNKNOWN"), F.concat(F.lit("error: format unknown; got "), text(one["warning"])))
        .otherwise(one["id"])
    )
    raw = F.encode(said, "UTF-8")
    whole = F.regexp_replace(F.decode(F.substring(raw, 1, limit), "ISO-8859-1"), r"(?:[\xC0-\xDF]|[\xE0-\xEF][\x80-\xBF]?|[\xF0-\xF7][\x80-\xBF]{0,2})\z", "")
    return results.select("filename", F.when(F.octet_length(raw) <= limit, said).otherwise(F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8")).alias("reply"))


__all__ = ["compare", "chart", "keep", "grouped_sets", "family_sets", "extension_sets", "fpr_reply", "id_text"]
