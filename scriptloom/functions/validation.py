"""Rule scores for generated PySpark code, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptloom.functions.text import strip

# Rule names, penalties and limits, and the substrings looked for. They are
# plain case-sensitive substrings, so NATION contains NA and password contains pass.
LENGTH_CHECK, LENGTH_PENALTY, MIN_CHARS = "length_check", 40, 20
SPARK_COVERAGE, COVERAGE_PENALTY, MIN_TERMS = "spark_coverage", 30, 2
ARTIFACT, ARTIFACT_PENALTY = "llm_artifact", 30
SPARK_TERMS = (
    "spark.read",
    ".select(",
    ".filter(",
    ".withColumn(",
    ".groupBy(",
    ".write",
    ".join(",
)
ARTIFACT_MARKERS = ("# LLM ERROR", 'spark.sql("""', "pass", "TODO", "NA")
FULL_SCORE = 100
PASS_SCORE = 60


def term_count(code: Column) -> Column:
    """How many different Spark terms occur."""
    return reduce(add, (F.contains(code, F.lit(t)).cast("int") for t in SPARK_TERMS))


def rules(code: Column) -> tuple[tuple[Column, str, int], ...]:
    """(violated, tag, penalty) per rule."""
    artifact = reduce(or_, (F.contains(code, F.lit(m)) for m in ARTIFACT_MARKERS))
    return (
        (F.length(strip(code)) < MIN_CHARS, LENGTH_CHECK, LENGTH_PENALTY),
        (term_count(code) < MIN_TERMS, SPARK_COVERAGE, COVERAGE_PENALTY),
        (artifact, ARTIFACT, ARTIFACT_PENALTY),
    )


def tags(code: Column) -> Column:
    return F.array_compact(F.array(*(F.when(bad, F.lit(tag)) for bad, tag, _ in rules(code))))


def score(code: Column) -> Column:
    penalties = (F.when(bad, penalty).otherwise(0) for bad, _, penalty in rules(code))
    return F.lit(FULL_SCORE) - reduce(add, penalties)
