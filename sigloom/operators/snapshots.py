"""What changed between full snapshots.

Gaps and islands over key and row hash: every run of consecutive snapshots in
which a key keeps its hash is one validity interval; interval starts, ends and
adjacencies are the change events. A key has at most one state per snapshot
when the windows run, so a window partition is bounded by the number of
snapshots, however often a key was delivered; repeated deliveries are folded
by a partial (map-side) aggregate before anything is shuffled.

Defined results: null keys and null snapshot numbers give nothing (a snapshot
whose keys are all null still exists); ties of the load time are broken by the
hash; a null load time is the earliest; an empty table gives no rows; columns
besides those named are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.session import BLANKS, cut, small, trimmed

#: More snapshots than this are joined by shuffle instead of broadcast.
MAX_SNAPSHOTS = 100_000


def report_hash(version: str = "report_version", signatures: str = "signatures") -> Column:
    """128-bit hash of a report's version and signatures in their consistent rendering."""

    def sequence(b: Column) -> Column:
        code = F.upper(F.translate(F.coalesce(b["hex_value"], F.lit("")), BLANKS, ""))
        return F.array(*(trimmed(b[k]) for k in ("position_type", "min_offset", "max_offset", "endianness")), code)

    none = F.expr("cast(array() as array<array<string>>)")
    one = lambda s: F.to_json(F.coalesce(F.transform(s["byte_sequences"], sequence), none))
    all_of = F.coalesce(F.array_sort(F.transform(signatures, one)), F.expr("cast(array() as array<string>)"))
    return F.unhex(F.md5(F.to_json(F.struct(trimmed(version).alias("v"), all_of.alias("s")))))


def latest_states(df: DataFrame, snap: str, key: str, loaded: str, row_hash: Column) -> DataFrame:
    """(snap, key, row_hash): the state that counts for each key of each snapshot, the one loaded last."""
    slim = df.where(F.col(key).isNotNull() & F.col(snap).isNotNull()).select(
        F.col(snap).alias("snap"), F.col(key).alias("key"), F.struct(F.col(loaded).alias("at"), row_hash.alias("h")).alias("state")
    )
    return slim.groupBy("snap", "key").agg(F.max("state").alias("state")).select("snap", "key", F.col("state.h").alias("row_hash"))


def snapshot_order(df: DataFrame, snap: str) -> DataFrame:
    """(snap, pos, next_snap): the existing snapshots, numbered from 1 without gaps.

    Cut, as it is counted and then joined: the table is read once for it, one column wide.
    """
    w = Window.orderBy("snap")  # one row per snapshot, not per record
    order = df.where(F.col(snap).isNotNull()).select(F.col(snap).alias("snap")).distinct().select("snap", F.row_number().over(w).alias("pos"), F.lead("snap").over(w).alias("next_snap"))
    return cut(order)


def validity_intervals(states: DataFrame, order: DataFrame) -> DataFrame:
    """(key, island, start_pos, end_pos, start_snap, after_snap): runs of snapshots with one unchanged state."""
    w = Window.partitionBy("key").orderBy("pos")
    goes_on = (F.lag("pos").over(w) + 1 == F.col("pos")) & (F.lag("row_hash").over(w) == F.col("row_hash"))
    marked = states.join(small(order, MAX_SNAPSHOTS), "snap").withColumn("starts", F.when(goes_on, 0).otherwise(1))
    return (
        marked.withColumn("island", F.sum("starts").over(w))
        .groupBy("key", "island")
        .agg(
            F.min("pos").alias("start_pos"),
            F.max("pos").alias("end_pos"),
            F.min("snap").alias("start_snap"),
            F.max_by("next_snap", "pos").alias("after_snap"),
        )
    )


def change_events(intervals: DataFrame) -> DataFrame:
    """(snap, key, change_kind) from the intervals' starts, ends and adjacencies."""
    w = Window.partitionBy("key").orderBy("island")
    x = intervals.withColumn("prev_end", F.lag("end_pos").over(w)).withColumn("next_start", F.lead("start_pos").over(w))
    begun = F.when(F.col("start_pos") > 1, F.struct(F.col("start_snap").alias("snap"), F.when(F.col("prev_end") + 1 == F.col("start_pos"), "changed").otherwise("added").alias("change_kind")))
    over = F.col("after_snap").isNotNull() & (F.col("next_start").isNull() | (F.col("next_start") > F.col("end_pos") + 1))
    ended = F.when(over, F.struct(F.col("after_snap").alias("snap"), F.lit("removed").alias("change_kind")))
    return x.select("key", F.explode(F.array(begun, ended)).alias("e")).where("e is not null").select("e.snap", "key", "e.change_kind")


def report_changes(reports: DataFrame) -> DataFrame:
    """Change events of report_snapshots: snap_no, report_id, change_kind."""
    states = latest_states(reports, "snap_no", "report_id", "loaded_at", report_hash())
    events = change_events(validity_intervals(states, snapshot_order(reports, "snap_no")))
    return events.select(F.col("snap").alias("snap_no"), F.col("key").alias("report_id"), "change_kind")


def report_intervals(reports: DataFrame) -> DataFrame:
    """Validity intervals of every report: report_id, first_snap, open (still valid in the last snapshot), n_snaps."""
    states = latest_states(reports, "snap_no", "report_id", "loaded_at", report_hash())
    return validity_intervals(states, snapshot_order(reports, "snap_no")).select(
        F.col("key").alias("report_id"), F.col("start_snap").alias("first_snap"), F.col("after_snap").isNull().alias("still_valid"), (F.col("end_pos") - F.col("start_pos") + 1).cast("bigint").alias("n_snaps")
    )
