"""Rule-based acceptance of generated code, row by row without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.functions import validation
from scriptloom.functions.validation import FULL_SCORE, PASS_SCORE

# What a dry run and a failed decision are reported as.
DRY_RUN_TAG = "dry_run"
FAILED_STEP = "validation"


def validate_code(df: DataFrame, code: str = "code", dry_run: bool = False) -> DataFrame:
    """Add ``validation_passed``, ``validation_score``, ``validation_tags``, ``failed_chunks``.

    NULL code counts as empty. A row passes if its score is high enough and it has no tags.
    In a dry run every row passes with the full score and the tag ``dry_run``.
    """
    if dry_run:
        judged = df.withColumns(
            {
                "validation_score": F.lit(FULL_SCORE),
                "validation_tags": F.array(F.lit(DRY_RUN_TAG)),
            }
        )
        passed = F.lit(True)
    else:
        text = F.coalesce(F.col(code), F.lit(""))
        judged = df.withColumns(
            {
                "validation_score": validation.score(text),
                "validation_tags": validation.tags(text),
            }
        )
        passed = (F.col("validation_score") >= PASS_SCORE) & (F.size("validation_tags") == 0)
    failed = F.when(passed, F.array().cast("array<string>")).otherwise(
        F.array(F.lit(FAILED_STEP))
    )
    return judged.withColumns({"validation_passed": passed, "failed_chunks": failed})
