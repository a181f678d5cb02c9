"""From scripts to audited, validated, reassembled code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from scriptloom.operators import blocks as blk
from scriptloom.operators import convert as cv
from scriptloom.operators.validate import validate_code
from scriptloom.session import materialize


@dataclass(frozen=True)
class ConversionRun:
    records: DataFrame
    audit: DataFrame
    successes: DataFrame
    failures: DataFrame
    meta: DataFrame


@dataclass(frozen=True)
class MigrationRun(ConversionRun):
    code: DataFrame


def run_conversion(
    chunks: DataFrame, open_converter=None, model: str = "unknown", **options
) -> ConversionRun:
    """Convert every chunk once and report on the run.

    The records carry their source (and ``seq`` if the chunks have it) and are stored:
    four outputs read them, and without that each would call the converter again. With the
    option ``store``, a run that failed goes on where its replies were last committed.
    """
    keys = [*options.pop("keys", ("id",))]
    keys += [c for c in ("seq",) if c in chunks.columns and c not in keys]
    carried = cv.convert(chunks, open_converter, keys=keys, model=model, source="input_sas_code", **options)
    records = materialize(carried)
    plain = records.drop("input_sas_code")
    return ConversionRun(
        records=plain,
        audit=cv.conversion_audit(records, unique_ids=not cv.has_repeated_ids(plain)),
        successes=cv.conversion_successes(plain),
        failures=cv.conversion_failures(plain),
        meta=cv.conversion_meta(plain, model),
    )


def migrate_scripts(
    scripts: DataFrame,
    open_converter=None,
    max_chars: int = blk.MAX_CHARS,
    model: str = "unknown",
    **options,
) -> MigrationRun:
    """Chunk, convert, reassemble and validate: the run, and ``code`` with one row and one
    verdict per script. The converter is called once per block however often these are read."""
    chunks = cv.as_chunks(blk.with_block_type(blk.chunk_corpus(scripts, max_chars)))
    options = {"keys": ("script_id", "block_no", "id"), **options}
    run = run_conversion(chunks, open_converter, model, **options)
    code = validate_code(cv.assemble_script(run.records), dry_run=options.get("dry_run", False))
    return MigrationRun(**vars(run), code=code)
