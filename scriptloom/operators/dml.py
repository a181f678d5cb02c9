"""Table changes and lookups that procedural scripts do row by row, as one plan each."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_where(df: DataFrame, predicate: Column, name: str = "n") -> DataFrame:
    """One row holding the number of matching rows (0 when there are none)."""
    return df.filter(predicate).agg(F.count(F.lit(1)).alias(name))


def update_where(df: DataFrame, predicate: Column, values: Mapping[str, Column]) -> DataFrame:
    """``df`` after setting ``values`` where ``predicate`` holds; NULL leaves the row as is.

    New values are cast to the column's type and see the row before the change. Names match as
    Spark's do; one that is no column raises. Write the result to a new path, never over the
    files it reads.
    """
    same = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    fold = (lambda name: name) if same else str.lower
    set_to = {fold(name): value for name, value in values.items()}
    unknown = set_to.keys() - {fold(f.name) for f in df.schema}
    if unknown:
        raise ValueError(f"no such column: {', '.join(sorted(unknown))}")

    def updated(f):
        old = F.col("`" + f.name.replace("`", "``") + "`")
        if fold(f.name) not in set_to:
            return old
        return F.when(predicate, set_to[fold(f.name)]).otherwise(old).cast(f.dataType).alias(f.name)

    return df.select(*map(updated, df.schema))


def guarded_update(
    df: DataFrame, guard: DataFrame, predicate: Column, values: Mapping[str, Column]
) -> DataFrame:
    """:func:`update_where`, carried out only if ``guard`` (one row, one count) is above 0.

    The guard is an uncorrelated scalar subquery: Spark runs it once, before the scan.
    """
    return update_where(df, predicate & (guard.scalar() > 0), values)


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, value: str) -> DataFrame:
    """Add ``dim.value`` found by key, NULL where there is none.

    ``dim_key`` must be unique, see :func:`scriptloom.operators.audits.key_violations`.
    Whether ``dim`` is broadcast is left to the optimizer, which knows its size.
    """
    found = dim.select(F.col(dim_key).alias(key), value)
    return df.join(found, key, "left")
