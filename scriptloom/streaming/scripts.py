"""Script files as they arrive. All block operators are stateless and apply unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptloom.sources.scripts import SCRIPT_GLOB, _as_scripts


def watch_scripts(
    spark: SparkSession,
    path: str,
    pattern: str = SCRIPT_GLOB,
    strict: bool = True,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """A streaming script table over the files that turn up below ``path``.

    ``max_files_per_trigger`` limits a batch, unset it takes all that is there.
    """
    reader = spark.readStream.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _as_scripts(reader.text(path, wholetext=True), strict)
