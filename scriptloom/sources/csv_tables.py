"""CSV and text exports.

The CSV options keep multi-line text, quotes, blanks and '' apart from NULL, which is written
as ``\\N``; a text that is exactly ``\\N`` is the one value that does not come back. Files are
gzipped, which readers tell by their names; quoted texts over many lines cannot be divided anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.functions.chunking import block_type
from scriptloom.functions.text import line_count

_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    packed = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
    df.write.mode(mode).options(**_OPTIONS, **packed, quoteAll=True).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.options(**_OPTIONS, multiLine=True).schema(schema).csv(path)


# Fixed values below: the column names of the exports.


def write_stats_csv(stats: DataFrame, path: str) -> None:
    renamed = stats.select(
        F.col("block_no").cast("string").alias("Block #"),
        F.col("block_type").alias("Type"),
        F.col("num_lines").alias("Lines"),
        F.col("num_chars").alias("Chars"),
        F.col("first_line").alias("First Line Preview"),
    )
    write_csv(renamed, path)


def block_export(blocks: DataFrame) -> DataFrame:
    """The rows of a block export: a block table with type and sizes, renamed."""
    block = F.col("block")
    return blocks.select(
        "script_id",
        F.concat(F.lit("Block "), F.col("block_no")).alias("Block Number"),
        block_type(block).alias("Type"),
        line_count(block).alias("Lines"),
        F.length(block).alias("Chars"),
        block.alias("PL/SQL Block"),
    )


BLOCK_EXPORT_SCHEMA = (
    "script_id string, `Block Number` string, Type string, Lines int, Chars int,"
    " `PL/SQL Block` string"
)


def write_block_csv(blocks: DataFrame, path: str) -> None:
    write_csv(block_export(blocks), path)


def write_mapping_csv(mapping: DataFrame, path: str) -> None:
    renamed = mapping.select(
        "script_id",
        "block_no",
        F.col("block").alias("PL/SQL Block"),
        F.col("converted").alias("Converted PySpark"),
    )
    write_csv(renamed, path)


def write_audit_csv(audit: DataFrame, path: str) -> None:
    """The conversion audit, in the order it has."""
    write_csv(audit.drop("id_num"), path)


def write_chunk_csv(chunks: DataFrame, path: str) -> None:
    """The latest chunks; they replace those of the run before."""
    write_csv(chunks.select("id", "type", "code"), path, mode="overwrite")


ASSEMBLED_SCHEMA = "script_id string, code string"


def write_assembled(scripts: DataFrame, path: str) -> None:
    """Converted scripts as CSV rows of script_id and code: any id, and no folder or file of its
    own for each script."""
    write_csv(scripts.select(F.col("script_id").cast("string"), "code"), path)


def write_script_texts(scripts: DataFrame, path: str, buckets: int, separator: str = "\n\n") -> None:
    """Converted scripts as plain text in ``buckets`` folders by the hash of their id, each text
    behind a line with its id and followed by the separator."""
    text = F.concat(F.lit("# script: "), F.col("script_id").cast("string"), F.lit("\n"), F.col("code"))
    bucket = F.pmod(F.xxhash64("script_id"), F.lit(buckets)).alias("bucket")
    dealt = scripts.select(bucket, text.alias("value")).repartition(buckets, "bucket")
    dealt.write.partitionBy("bucket").text(path, lineSep=separator)
