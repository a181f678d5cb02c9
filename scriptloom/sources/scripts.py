"""Script tables from files and from pasted text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Any case of the two extensions.
SCRIPT_GLOB = "*.{[sS][qQ][lL],[tT][xX][tT]}"


def _as_scripts(files: DataFrame, strict: bool) -> DataFrame:
    text = F.validate_utf8("value") if strict else F.try_validate_utf8("value")
    return files.select(F.col("_metadata.file_path").alias("script_id"), text.alias("text"))


def hidden_scripts(spark: SparkSession, path: str) -> list[str]:
    """Script files below ``path`` that Spark's readers skip: names that start with _ or a dot.

    One glob per level of folders, so that only hidden names reach Python.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, level = [], path.rstrip("/")
    while True:
        hidden = files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{level}/[_.]*")) or []
        names = [(s.getPath().toString(), s.isFile()) for s in hidden]
        found += [n for n, is_file in names if is_file and n.lower().endswith((".sql", ".txt"))]
        level += "/*"
        below = files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{level}/*"))
        if not below or not len(below):
            return found


def read_scripts(
    spark: SparkSession,
    path: str,
    pattern: str = SCRIPT_GLOB,
    strict: bool = True,
    refuse_hidden: bool = True,
) -> DataFrame:
    """One row per file below ``path``: its path and its whole text.

    A file that is not UTF-8 raises, or has a NULL text with ``strict=False``. Spark cannot read
    files whose names start with ``_`` or a dot; script files of such names raise, unless
    ``refuse_hidden`` is off and they are meant to be left out.
    """
    if refuse_hidden and (hidden := hidden_scripts(spark, path)):
        raise ValueError(f"{len(hidden)} script files with hidden names, such as {hidden[0]}")
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return _as_scripts(reader.text(path, wholetext=True), strict)


def pasted_script(spark: SparkSession, text: str, script_id: str = "pasted") -> DataFrame:
    return spark.createDataFrame([(script_id, text)], "script_id string, text string")


def spread(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """``df`` dealt by key over ``partitions`` partitions.

    For a few small files whose rows are costly to process, right after reading.
    """
    return df.repartition(partitions, key)
