"""Per-key results where a few keys hold most rows.

Eager aggregation through the join: both inputs are aggregated by the join key
before they meet, the compact states (one row per key) are joined, and what the
full join would have held is computed from them - counts multiply, sums of one
side are multiplied by the count of the other - and rolled up. No row of a hot
key ever travels alone: duplicates are folded under their own, evenly spread
key, and everything keyed by the hot key is pre-aggregated map-side first.

Defined results: keys compare in lower case without outer blanks; null keys are
left out; a row number delivered more than once counts once (the smallest of
its values holds); null file numbers count as rows but not as files; empty
inputs give no rows; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.session import BLANKS, cut, small


def spelled(c: str) -> Column:
    """A key in lower case without outer blanks; null stays null."""
    return F.lower(F.trim(F.col(c), F.lit(BLANKS)))


def identification_states(idents: DataFrame) -> DataFrame:
    """ident_id, n_rows, n_files: compact state of each id in identifications."""
    once = idents.select("ident_no", "file_no", spelled("ident_id").alias("ident_id")).where("ident_id is not null").groupBy("ident_no").agg(F.min(F.struct("ident_id", "file_no")).alias("x"))
    per_file = once.select("x.ident_id", "x.file_no").groupBy("ident_id", "file_no").agg(F.count("*").alias("n"))
    return per_file.groupBy("ident_id").agg(F.sum("n").alias("n_rows"), F.count("file_no").alias("n_files"))


def listing_states(files: DataFrame) -> DataFrame:
    """ident_id, n_listed, listed_bytes: compact state of each id in the id lists of scan_files (folders hold no bytes)."""
    pairs = files.select("file_no", "filesize", F.explode("ids").alias("raw")).select("file_no", F.greatest("filesize", F.lit(0)).alias("filesize"), spelled("raw").alias("ident_id")).where("ident_id is not null")
    per_file = pairs.groupBy("ident_id", "file_no").agg(F.max("filesize").alias("filesize"))
    return per_file.groupBy("ident_id").agg(F.count("*").alias("n_listed"), F.coalesce(F.sum("filesize"), F.lit(0)).alias("listed_bytes"))


def id_results(idents: DataFrame, files: DataFrame) -> DataFrame:
    """Per id over both inputs, with the size and the byte sum of their join, which is never built.

    ident_id, n_rows, n_files, n_listed, listed_bytes, pair_rows (= n_rows x n_listed), pair_bytes (= n_rows x listed_bytes).
    """
    x = identification_states(idents).join(listing_states(files), "ident_id", "full_outer").na.fill(0)
    wide = lambda a, b: F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")
    return x.select("ident_id", "n_rows", "n_files", "n_listed", "listed_bytes", wide("n_rows", "n_listed").alias("pair_rows"), wide("n_rows", "listed_bytes").alias("pair_bytes"))


def heavy_ids(idents: DataFrame, files: DataFrame, percent: int = 3) -> DataFrame:
    """ident_id of each id with at least ``percent`` of all identifications.

    Out of the results of every id (joined states with their multiplied counts, cut: one row per id), whose row counts
    roll up to the total.
    """
    results = cut(id_results(idents, files))
    total = results.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("t"))
    return results.where((F.col("n_rows") > 0) & (F.col("n_rows") * 100 >= total.scalar() * percent)).select("ident_id")


def class_rollup(idents: DataFrame, files: DataFrame, registry: DataFrame) -> DataFrame:
    """The per-id results rolled up to the registry's format classes; ids it lacks are under '(none)'."""
    reg = registry.select(spelled("ident_id").alias("ident_id"), "format_class").groupBy("ident_id").agg(F.min("format_class").alias("format_class"))
    x = id_results(idents, files).join(small(reg, 100_000), "ident_id", "left")
    return x.groupBy(F.coalesce("format_class", F.lit("(none)")).alias("format_class")).agg(
        F.count("*").alias("n_ids"), F.sum("n_rows").alias("n_rows"), F.sum("n_listed").alias("n_listed"), F.sum("pair_rows").cast("decimal(38,0)").alias("pair_rows")
    )
