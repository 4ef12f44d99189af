"""File sources: (path, mime, modificationTime, length, content) rows, the input of identification."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, paths: str | list[str], recurse: bool = True, glob: str | None = None, go_on: bool = True, empty: bool = False) -> DataFrame:
    """Files below folders or of a list of paths: path, modificationTime, length, content, mime, error.

    With ``go_on`` missing files are passed over. The content is only read where a plan uses it: a plan on names alone
    prunes it. Spark's file sources pass over files without content; ``empty`` adds them from a listing on the driver,
    which costs a call per file. ``read_listed`` gives a row with the error for files that cannot be read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recurse).option("ignoreMissingFiles", go_on).option("ignoreCorruptFiles", go_on)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(paths)
    if empty:
        rows = [r for p in ([paths] if isinstance(paths, str) else paths) for r in _empty(spark, p, recurse)]
        df = df.unionByName(spark.createDataFrame(rows, "path string, length bigint, content binary").withColumn("modificationTime", F.lit(None).cast("timestamp")))
    return df.withColumn("mime", F.lit("")).withColumn("error", F.when(F.col("length") == 0, "empty source"))


def read_listed(paths: DataFrame) -> DataFrame:
    """path, length, modified, content, mime, error of the files that a column ``path`` names, each read where its row lies.

    What cannot be read, is missing or is no regular file is a row with the reason in ``error`` and no content.
    """
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.string()), ("content", pa.binary()), ("mime", pa.string()), ("error", pa.string())])

    def one(path: str) -> tuple:
        try:
            fs, at = (pa_fs.LocalFileSystem(), path) if path.startswith("/") else pa_fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
            info = fs.get_file_info(at)
            if info.type != pa_fs.FileType.File:
                return path, None, "", None, "", "no such file" if info.type == pa_fs.FileType.NotFound else "not a regular file"
            with fs.open_input_stream(at) as f:
                data = f.read()
            when = info.mtime.strftime("%Y-%m-%dT%H:%M:%SZ") if info.mtime else ""
            return path, len(data), when, data, "", None if data else "empty source"
        except Exception as e:  # noqa: BLE001 - a file that cannot be read is a row, not a failure
            return path, None, "", None, "", str(e)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(one(path), schema)], schema=schema)

    return paths.select("path").where("path is not null").mapInArrow(run, "path string, length bigint, modified string, content binary, mime string, error string")


def _empty(spark: SparkSession, path: str, recurse: bool):
    """The files without content below a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, recurse)
    while found.hasNext():
        f = found.next()
        if f.getLen() == 0:
            yield f.getPath().toString(), 0, bytearray()


def listed(spark: SparkSession, list_file: str, **options) -> DataFrame:
    """Files named in a text file, one path per line (the list is a driver-side argument, not data)."""
    paths = [r.value.strip() for r in spark.read.text(list_file).collect() if r.value.strip()]
    return scan(spark, paths, **options)


def single(spark: SparkSession, name: str, content: bytes, mime: str = "") -> DataFrame:
    """One object from a stream, with the name it is given."""
    return spark.createDataFrame([(name, mime, len(content), bytearray(content))], "path string, mime string, length bigint, content binary")


def from_columns(df: DataFrame, path: Column, content: Column, mime: Column | None = None) -> DataFrame:
    """Files held in a table: texts are taken as UTF-8."""
    c = content
    out = df.select(path.alias("path"), (F.lit("") if mime is None else mime).alias("mime"), c.alias("content"))
    if dict(out.dtypes)["content"] == "string":
        out = out.withColumn("content", F.encode("content", "UTF-8"))
    return out.withColumn("length", F.octet_length("content").cast("bigint"))
