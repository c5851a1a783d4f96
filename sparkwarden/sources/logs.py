"""Raw log lines, as a batch or a stream."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.timestamps import instant

def _clean(lines: DataFrame) -> DataFrame:
    return (
        lines.select(
            strip(F.col("value")).alias("value"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_modification_time").alias("file_time"),
        )
        .filter(F.col("value") != "")
    )


def read_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files without blank ones: ``value``, ``file_path``, ``file_time``.

    Bad UTF-8 bytes are replaced by the decoder, not rejected.
    """
    return _clean(spark.read.text(path))


def stream_logs(
    spark: SparkSession,
    path: str,
    start_after: datetime | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """The same lines as a stream of the files arriving in ``path``.

    Files must land closed (rotated), because Spark reads each file once.
    With ``start_after`` older files are passed over, as a tail that starts at
    the end of its log would.
    """
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = _clean(reader.load(path))
    if start_after is not None:
        lines = lines.filter(F.col("file_time") > instant(start_after))
    return lines


def read_existing(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """Log lines per source name; a source whose path is missing is left out."""
    found = {}
    for source, path in paths.items():
        try:
            found[source] = read_logs(spark, path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


def route_sources(parsed: Mapping[str, DataFrame]) -> DataFrame:
    """One event table from the parsed lines of several sources."""
    frames = list(parsed.values())
    if not frames:
        raise ValueError("no log source given")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
