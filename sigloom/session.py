"""Session helpers: tables, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space characters that count as blanks at the ends of a text.
BLANKS = " \t\n\r\f\x0b\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(sc) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a master on this machine gets a folder of its own, removed at exit; any other master is
    refused, as its executors would each write to a disk the others cannot see.
    """
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="sigloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def shared_folder(spark: SparkSession) -> str:
    """This session's folder below ``checkpoint_folder``."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_folder(sc))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for a table that is written and read again."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in ``shared_folder``."""
    shared_folder(df.sparkSession)
    # new column identities, so that a cut table can be joined and united with itself
    return df.checkpoint(eager=True).select(*(F.col(f"`{c}`").alias(c) for c in df.columns))


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``max_rows`` rows, else unchanged.

    The size is counted, never assumed; beyond the bound the join that follows
    is an ordinary shuffle join, which adaptive execution splits where a key is hot.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def trimmed(c: Column | str) -> Column:
    """A text without outer blanks; null becomes the empty text."""
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(BLANKS))


def squeezed(c: Column | str) -> Column:
    """Lower case, outer blanks gone, inner runs of blanks as one space."""
    return F.lower(F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " ")))


#: Logical operators that keep the partitions of the scan below them.
NARROW = {"Project", "Filter", "LogicalRelation", "LogicalRDD", "LocalRelation", "Generate", "MapInArrow", "MapInPandas", "Union", "SubqueryAlias", "DataSourceV2ScanRelation", "OneRowRelation"}


def is_narrow(df: DataFrame) -> bool:
    """Whether a plan has no operator that shuffles, by the kinds of its logical operators."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() not in NARROW:
            return False
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return True


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as the cluster has cores, if the scan gives fewer (small or single files).

    A large input has more splits than cores and stays as it is, so nothing is shuffled there; neither is a plan that
    shuffles anyway.
    """
    if df.isStreaming or not is_narrow(df):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
