"""A prediction store that grows while it is read.

The reading rule is that of the batch store: whole lines with both keys count,
and the last one of each record wins, so lines delivered twice do no harm.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kiteloom.sources.readers import last_written


def read_lines(spark: SparkSession, folder: str | Path, files_per_trigger: int = 100) -> DataFrame:
    """Lines of a folder's new files as a stream, with their order: file time, file, line. Files are read whole, so they should be parts."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("wholetext", True).text(str(folder))
    meta = F.col("_metadata")
    named = files.select("value", meta["file_modification_time"].alias("written"), meta["file_path"].alias("file"))
    return named.select("written", "file", F.posexplode(F.split("value", "\n")).alias("line", "value"))


def latest(lines: DataFrame) -> DataFrame:
    """The last sound line of each record so far: one row of state a record."""
    return last_written(lines, "value", "written", "file", "line")


def follow(lines: DataFrame, name: str, checkpoint: str | Path) -> StreamingQuery:
    """Keeps the table ``name`` of latest predictions up to date, for what has arrived when the query starts or is triggered."""
    return latest(lines).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
