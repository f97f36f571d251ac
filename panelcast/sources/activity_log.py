"""A-03, A-04: the activity log as JSON with an explicit schema.

A log is a file or a folder of files, each with its own layout: JSON lines, or an array
of entries (one line or indented), also with lines appended behind it. The layout is read
off each file's first character in one distributed pass. Files of lines are split among
tasks; a file that begins with an array is rewritten whole by whoever appends to it, so
it is one task's.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from panelcast.operators.activity import LOG_TIMESTAMP_FORMAT
from panelcast.sources.scratch import written

LOG_SCHEMA = StructType([StructField(n, StringType()) for n in
                         ("timestamp", "username", "name", "action", "role")])
_STRING = r'"(?:[^"\\]++|\\.)*+"'
#: An entry within an array: an object of plain values.
_ENTRY = r"(\{[^{}\"]*+(?:" + _STRING + r"[^{}\"]*+)*+\})"
#: Files that one job appends share the job's mark.
_JOB = r"part-\d+-([0-9a-f]{8}-[0-9a-f-]{27})"
POS = "struct<at: timestamp, job: string, file: string, block: bigint, line: bigint>"


def _files(lines: DataFrame) -> DataFrame:
    """One row per file: its first character and the time of the append it belongs to."""
    name = F.col("file")
    first = F.min_by(F.substring(F.ltrim("value"), 1, 1), F.struct("block", "line"))
    files = lines.where(F.trim("value") != "").groupBy("file").agg(first.alias("first"), F.min("time").alias("time"))
    job = F.coalesce(F.nullif(F.regexp_extract(name, _JOB, 1), F.lit("")), name)
    files = files.withColumn("job", job)
    # The parts of one append end in any order; the append counts from its first.
    return files.join(files.groupBy("job").agg(F.min("time").alias("at")), "job")


def _text(spark: SparkSession, path, whole: bool = False) -> DataFrame:
    return spark.read.text(path, wholetext=whole).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("time"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def _pos(block: Column, line: Column) -> Column:
    return F.struct("at", "job", "file", block.alias("block"), line.alias("line")).cast(POS).alias("pos")


def read_activity_log(spark: SparkSession, path: str) -> DataFrame:
    """Log entries with a parsed ``ts`` and their place ``pos``; a missing path gives an empty table.

    ``pos`` orders entries as they were appended: by the append's time (the modification time of
    its first file), then file name, then place in the file. It is a sortable struct, so no sort
    is needed to give it. Malformed entries are dropped; unknown fields are ignored.
    """
    try:
        lines = _text(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], StructType([*LOG_SCHEMA.fields])).withColumns(
            {"pos": F.lit(None).cast(POS), "ts": F.lit(None).cast("timestamp")})
    files = written(_files(lines))
    # The driver lists all files anyway; of these it gets the names of the arrays.
    arrays = [r[0] for r in files.where("first = '['").select("file").collect()]
    found = lines.join(files.where("first <> '['").select("file", "at", "job"), "file").select(
        F.col("value").alias("entry"), _pos(F.col("block"), F.col("line")))
    if arrays:
        whole = _text(spark, arrays, whole=True).join(files.select("file", "at", "job"), "file")
        entries = F.posexplode(F.regexp_extract_all("value", F.lit(_ENTRY), F.lit(1)))
        found = found.unionByName(whole.select("file", "at", "job", entries.alias("n", "entry")).select(
            "entry", _pos(F.lit(0), F.col("n"))))
    # A line that is no object gives no struct; a malformed one gives nulls and its text.
    read = F.from_json("entry", StructType([*LOG_SCHEMA.fields, StructField("_malformed", StringType())]),
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
    out = found.where(F.trim("entry") != "").select(read.alias("e"), "pos").where("e IS NOT NULL AND e._malformed IS NULL")
    return (out.select(*[F.col("e")[n].alias(n) for n in LOG_SCHEMA.names], "pos")
            .withColumn("ts", F.try_to_timestamp(F.col("timestamp"), F.lit(LOG_TIMESTAMP_FORMAT))))


def append_activity(entries: DataFrame, path: str) -> None:
    """Append entries (with ``ts`` or ``timestamp``) as files of JSON lines to the folder ``path``."""
    if "timestamp" not in entries.columns:
        entries = entries.withColumn("timestamp", F.date_format("ts", LOG_TIMESTAMP_FORMAT))
    entries.select(*[f.name for f in LOG_SCHEMA.fields]).write.mode("append").json(path)
