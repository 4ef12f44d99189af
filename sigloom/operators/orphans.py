"""References to records that do not exist.

Parent and child keys of all tables are united in long form with a tag, grouped
by parent table, key and period, and the groups that lack the parent tag are
the orphans; sums by table and period are the report. A group is one small row
however many references it holds, so the windows that compare a key's periods
see at most one row per period and child table. The rows of the references are
put back by joining with the orphan groups only; groups that hold very many
references (they are few, by their count) are broadcast, so no hot key is
shuffled to one task.

A parent that is delivered whole every period is held in the periods that name
it. A ``lasting`` parent is delivered once and held from its first period on, so
its references fail only as ``late`` or ``missing``.

Defined results: null references are no references; a null period equals no
period and is neither earlier nor later; repeated deliveries of a reference
count once; an empty parent table makes every reference ``missing``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.session import BLANKS, cut

#: An orphan group with at least this share of all references is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def references(df: DataFrame, child_table: str, parent_table: str, row: str, key: Column, period: Column) -> DataFrame:
    """child_table, parent_table, row, key, period of the references of one column."""
    return df.select(F.lit(child_table).alias("child_table"), F.lit(parent_table).alias("parent_table"), F.col(row).alias("row"), key.alias("key"), period.alias("period")).where("key is not null")


def parents(df: DataFrame, parent_table: str, key: Column, period: Column, lasting: bool = False) -> DataFrame:
    """parent_table, key, period, lasting of the records of one table."""
    return df.select(F.lit(parent_table).alias("parent_table"), key.alias("key"), period.alias("period"), F.lit(lasting).alias("lasting")).where("key is not null and period is not null")


def orphan_groups(refs: DataFrame, held: DataFrame) -> DataFrame:
    """(child_table, parent_table, key, period, n_refs, orphan_kind) of the groups without parent."""
    none = F.lit(None).cast("string").alias("child_table")
    long = refs.select("child_table", "parent_table", "key", "period", F.lit(1).alias("refs"), F.lit(0).alias("held"), F.lit(False).alias("lasting")).unionByName(
        held.select(none, "parent_table", "key", "period", F.lit(0).alias("refs"), F.lit(1).alias("held"), "lasting")
    )
    groups = long.groupBy("child_table", "parent_table", "key", "period").agg(F.sum("refs").alias("n_refs"), F.max("held").alias("held"), F.bool_or("lasting").alias("lasting"))
    of_key, of_period = Window.partitionBy("parent_table", "key"), Window.partitionBy("parent_table", "key", "period")
    at = F.when(F.col("held") == 1, F.col("period"))
    x = groups.withColumn("first_held", F.min(at).over(of_key)).withColumn("last_held", F.max(at).over(of_key)).withColumn("lasting", F.bool_or("lasting").over(of_key)).withColumn("there", F.max("held").over(of_period) == 1)
    earlier = F.coalesce(F.col("first_held") < F.col("period"), F.lit(False))
    x = x.where(F.col("child_table").isNotNull() & ~F.col("there") & ~(F.col("lasting") & earlier))
    kind = F.when(earlier, "deleted").when(F.col("last_held") > F.col("period"), "late").otherwise("missing")
    return x.select("child_table", "parent_table", "key", "period", "n_refs", kind.alias("orphan_kind"))


def orphan_rows(refs: DataFrame, held: DataFrame, hot_share: float = HOT_SHARE) -> DataFrame:
    """child_table, parent_table, row, period, orphan_kind of each reference whose target is not held."""
    groups = cut(orphan_groups(refs, held))  # used twice below, and far fewer than the references
    least = F.lit(hot_share) * F.lit(refs.count())
    hot, rest = groups.where(F.col("n_refs") >= least), groups.where(F.col("n_refs") < least)
    on = ("child_table", "parent_table", "key")
    same = lambda g: reduce(Column.__and__, (F.col(f"r.{c}") == F.col(f"{g}.{c}") for c in on), F.col("r.period").eqNullSafe(F.col(f"{g}.period")))
    split = refs.alias("r").join(F.broadcast(hot.alias("h")), same("h"), "left").select("r.*", F.col("h.orphan_kind").alias("hot_kind"))
    out = split.where("hot_kind is not null").select("child_table", "parent_table", "row", "period", F.col("hot_kind").alias("orphan_kind"))
    cold = split.where("hot_kind is null").alias("r").join(rest.alias("g"), same("g"))
    out = out.unionByName(cold.select("r.child_table", "r.parent_table", "r.row", "r.period", "g.orphan_kind"))
    return out.groupBy("child_table", "parent_table", "row").agg(F.min(F.struct("period", "orphan_kind")).alias("x")).select("child_table", "parent_table", "row", "x.period", "x.orphan_kind")


def counts(refs: DataFrame, held: DataFrame) -> DataFrame:
    """child_table, parent_table, period, orphan_kind, n_refs, n_keys: the report per table and period."""
    once = refs.groupBy("child_table", "parent_table", "row").agg(F.min(F.struct("period", "key")).alias("x")).select("child_table", "parent_table", "row", "x.key", "x.period")
    return orphan_groups(once, held).groupBy("child_table", "parent_table", "period", "orphan_kind").agg(F.sum("n_refs").alias("n_refs"), F.count("*").alias("n_keys"))


# -- the references of the domain -----------------------------------------------------------------------------------------
def _related(related: DataFrame) -> DataFrame:
    return references(related, "related_formats", "report_snapshots", "rel_no", F.col("related_id"), F.col("snap_no"))


def _reports(reports: DataFrame) -> DataFrame:
    return parents(reports, "report_snapshots", F.col("report_id"), F.col("snap_no"))


def orphan_references(related: DataFrame, reports: DataFrame, hot_share: float = HOT_SHARE) -> DataFrame:
    """rel_no, snap_no, orphan_kind of each reference whose target its own period does not hold."""
    return orphan_rows(_related(related), _reports(reports), hot_share).select(F.col("row").alias("rel_no"), F.col("period").cast("int").alias("snap_no"), "orphan_kind")


def orphan_counts(related: DataFrame, reports: DataFrame) -> DataFrame:
    """parent_table, snap_no, orphan_kind, n_refs, n_keys of the references between reports."""
    return counts(_related(related), _reports(reports)).select("parent_table", F.col("period").alias("snap_no"), "orphan_kind", "n_refs", "n_keys")


def domain_orphans(related: DataFrame, reports: DataFrame, files: DataFrame, heads: DataFrame, idents: DataFrame, registry: DataFrame) -> DataFrame:
    """The report over all references of the domain at once: formats to reports, files to scans, identifications to files and formats.

    The periods are snapshot numbers, or months (yyyymm) of delivery; the format registry has no period and holds always.
    """
    text = lambda c: F.col(c).cast("string")
    month = lambda c: (F.year(c) * 100 + F.month(c)).cast("int")
    spelled = F.lower(F.trim(F.col("ident_id"), F.lit(BLANKS)))
    refs = [
        references(related, "related_formats", "report_snapshots", "rel_no", text("related_id"), F.col("snap_no")),
        references(files, "scan_files", "scan_heads", "file_no", text("scan_no"), month("loaded_at")),
        references(idents, "identifications", "scan_files", "ident_no", text("file_no"), month("loaded_at")),
        references(idents, "identifications", "format_registry", "ident_no", F.when(spelled != "unknown", spelled), month("loaded_at")),
    ]
    held = [
        parents(reports, "report_snapshots", text("report_id"), F.col("snap_no")),
        parents(heads, "scan_heads", text("scan_no"), month("arrived_at"), True),
        parents(files, "scan_files", text("file_no"), month("loaded_at"), True),
        parents(registry, "format_registry", spelled, F.lit(0), True),
    ]
    return counts(reduce(DataFrame.unionByName, refs), reduce(DataFrame.unionByName, held))
