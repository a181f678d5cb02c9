"""Script tables to block tables.

A script table has one row per script: ``script_id`` and ``text``. A block table has one row
per block: ``script_id``, ``block_no`` (from 1, in script order) and ``block``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.functions import chunking, tokens
from scriptloom.functions.chunking import FLUSH_CHARS, MAX_CHARS, SMALL_CHARS
from scriptloom.functions.text import first_line, has_code, line_count


def explode_blocks(scripts: DataFrame, blocks: Column, key: str = "script_id") -> DataFrame:
    # The array goes straight into posexplode: as a named column of its own it would also be
    # computed for the "is not empty" filter the optimizer derives from an exploded column.
    exploded = scripts.select(key, F.posexplode(blocks).alias("pos", "block"))
    return exploded.select(key, (F.col("pos") + 1).alias("block_no"), "block")


def split_statements(scripts: DataFrame, text: str = "text") -> DataFrame:
    return explode_blocks(scripts, chunking.split_statements(F.col(text)))


def split_compound(scripts: DataFrame, text: str = "text") -> DataFrame:
    """Whole statements, compound ones in one piece, see :func:`chunking.split_compound`."""
    return explode_blocks(scripts, chunking.split_compound(F.col(text)))


def extract_blocks(scripts: DataFrame, text: str = "text") -> DataFrame:
    return explode_blocks(scripts, chunking.extract_blocks(F.col(text)))


def chunk_corpus(
    scripts: DataFrame,
    max_chars: int = MAX_CHARS,
    small: int = SMALL_CHARS,
    flush: int = FLUSH_CHARS,
    text: str = "text",
    statement_step: bool = False,
) -> DataFrame:
    """Cut every script into blocks of bounded size, see :func:`chunking.chunk`.

    With ``statement_step``, blocks are taken apart into whole statements before they are cut.
    """
    if not statement_step:
        return explode_blocks(scripts, chunking.chunk(F.col(text), max_chars, small, flush))
    # One column per stage: as one expression the lambdas nest too deep for the analyzer.
    staged = scripts.select("script_id", chunking.extract_blocks(F.col(text)).alias("blocks"))
    staged = staged.select("script_id", chunking.compound_statements(F.col("blocks"), max_chars).alias("parts"))
    staged = staged.select("script_id", chunking.cut_statements(F.col("parts"), max_chars).alias("fine"))
    return explode_blocks(staged, chunking.merge_and_resplit(F.col("fine"), max_chars, small, flush))


def merge_small(
    scripts: DataFrame, small: int = SMALL_CHARS, flush: int = FLUSH_CHARS, text: str = "text"
) -> DataFrame:
    """The extracted blocks of every script with small neighbours merged."""
    found = chunking.extract_blocks(F.col(text))
    return explode_blocks(scripts, chunking.merge_small(found, small, flush))


def resplit_large(scripts: DataFrame, max_chars: int = MAX_CHARS, text: str = "text") -> DataFrame:
    """The extracted blocks of every script, the ones above ``max_chars`` packed again."""
    found = chunking.extract_blocks(F.col(text))
    return explode_blocks(scripts, chunking.resplit_large(found, max_chars))


def _pieces(blocks: DataFrame, pieces: Column) -> DataFrame:
    exploded = blocks.select("script_id", "block_no", F.posexplode(pieces).alias("pos", "piece"))
    return exploded.select("script_id", "block_no", (F.col("pos") + 1).alias("piece_no"), "piece")


def split_at_begin(blocks: DataFrame) -> DataFrame:
    return _pieces(blocks, chunking.split_at_begin(F.col("block")))


def pack_by_size(blocks: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Pack every block, also one below the limit."""
    return _pieces(blocks, chunking.pack_by_size(F.col("block"), max_chars))


def drop_comment_only(blocks: DataFrame) -> DataFrame:
    return blocks.filter(has_code(F.col("block")))


def with_block_type(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("block_type", chunking.block_type(F.col("block")))


def block_stats(blocks: DataFrame) -> DataFrame:
    """Type, size and header preview of every block."""
    block = F.col("block")
    return blocks.select(
        "script_id",
        "block_no",
        chunking.block_type(block).alias("block_type"),
        line_count(block).alias("num_lines"),
        F.length(block).alias("num_chars"),
        first_line(block).alias("first_line"),
    )


def block_counts(scripts: DataFrame, text: str = "text", **limits) -> DataFrame:
    """Number of blocks per script, 0 for a script without any; no shuffle."""
    blocks = chunking.chunk(F.col(text), **limits)
    return scripts.select(
        "script_id", F.coalesce(F.size(blocks), F.lit(0)).alias("num_blocks")
    )


def block_tokens(blocks: DataFrame) -> DataFrame:
    """One row per lexical token: coarse type and value, blanks left out."""
    exploded = blocks.select(
        "script_id", "block_no", F.posexplode(tokens.tokens(F.col("block"))).alias("pos", "value")
    )
    return exploded.select(
        "script_id",
        "block_no",
        (F.col("pos") + 1).alias("token_no"),
        tokens.token_type(F.col("value")).alias("token_type"),
        "value",
    )
