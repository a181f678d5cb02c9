"""Checks for the keys and lengths that Spark does not enforce on tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_violations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that are NULL in some part or occur more than once, with their count."""
    has_null = F.lit(False)
    for column in key:
        has_null = has_null | F.col(column).isNull()
    return (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .filter((F.col("row_count") > 1) | has_null)
    )


def orphans(child: DataFrame, foreign_key: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose foreign key has no parent. A NULL foreign key is not an orphan."""
    parents = parent.select(F.col(key).alias(foreign_key))
    return child.filter(F.col(foreign_key).isNotNull()).join(parents, foreign_key, "left_anti")


def length_violations(
    df: DataFrame, limits: Mapping[str, int], key: Sequence[str]
) -> DataFrame:
    """Values longer than their declared CHAR(n)/VARCHAR(n), all columns in one scan."""
    checks = F.array(
        *(
            F.struct(
                F.lit(column).alias("column_name"),
                F.length(column).alias("actual_length"),
                F.lit(limit).alias("max_length"),
            )
            for column, limit in limits.items()
        )
    )
    checks = checks.cast("array<struct<column_name:string,actual_length:int,max_length:int>>")
    too_long = F.filter(checks, lambda c: c["actual_length"] > c["max_length"])
    return df.select(*key, F.inline(too_long))
