"""SAS chunk tables (``id``, ``type``, ``code``) to block and statement rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.functions import sas


def read_chunks(df: DataFrame) -> DataFrame:
    """Any table with id, type and code as a chunk table; the type in upper case."""
    return df.select("id", F.upper("type").alias("type"), "code")


def _nodes(chunks: DataFrame) -> DataFrame:
    """Blocks of the chunks, numbered and nested as :func:`sas.nodes` says."""
    exploded = read_chunks(chunks).select("*", F.explode_outer(sas.nodes(F.col("code"))).alias("node"))
    return exploded.select(
        "id",
        "type",
        "code",
        F.coalesce("node.node_no", F.lit(1)).alias("node_no"),
        *[F.coalesce(f"node.{c}", F.lit(0)).alias(c) for c in ("inner_no", "depth")],
        F.col("node.parent_no").alias("parent_no"),
        F.col("node.block").alias("block"),
    )


def sas_kinds(chunks: DataFrame) -> DataFrame:
    """One row per block of a chunk; a chunk that does not fit keeps one row without a tree.

    The blocks of a macro follow it under its ``node_no``, with ``inner_no`` from 1. Macros nest:
    ``depth`` says how many are around a block and ``parent_no`` which one (its ``inner_no``).
    """
    block = F.col("block")
    tree = F.when(
        block.isNotNull(),
        F.struct(
            sas.kind(block).alias("kind"),
            sas.name(block).alias("name"),
            sas.path(block).alias("path"),
            sas.statements(block).alias("statements"),
        ),
    )
    return _nodes(chunks).select(
        "id", "type", "code", "node_no", "inner_no", "depth", "parent_no", tree.alias("ast")
    )


def sas_statements(chunks: DataFrame) -> DataFrame:
    """One row per statement of the data, proc, if and loop blocks, those in macros included."""
    exploded = _nodes(chunks).select(
        "id",
        "node_no",
        "inner_no",
        "depth",
        "parent_no",
        F.posexplode(sas.statements(F.col("block"))).alias("pos", "statement"),
    )
    return exploded.select(
        "id",
        "node_no",
        "inner_no",
        "depth",
        "parent_no",
        (F.col("pos") + 1).alias("statement_no"),
        "statement.*",
    )
