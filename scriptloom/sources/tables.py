"""The typed retail tables: declared schemas, readers, literal rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    columns: str
    key: str
    foreign_keys: tuple[tuple[str, str], ...] = ()  # (column, parent table)

    @property
    def declared(self) -> T.StructType:
        return T.StructType.fromDDL(self.columns)

    @property
    def schema(self) -> T.StructType:
        """The schema to read with: CHAR(n) and VARCHAR(n) become STRING."""
        return T.StructType(
            [T.StructField(f.name, _storage_type(f.dataType)) for f in self.declared]
        )

    @property
    def length_limits(self) -> dict[str, int]:
        return {
            f.name: f.dataType.length
            for f in self.declared
            if isinstance(f.dataType, (T.CharType, T.VarcharType))
        }


def _storage_type(data_type: T.DataType) -> T.DataType:
    if isinstance(data_type, (T.CharType, T.VarcharType)):
        return T.StringType()
    return data_type


# The declared retail schemas, primary keys and foreign keys.
TABLES = {
    "customers": Table(
        "customer_id INT, name VARCHAR(100), gender CHAR(1), age INT, signup_date DATE",
        key="customer_id",
    ),
    "orders": Table(
        "order_id INT, customer_id INT, order_date DATE, status VARCHAR(20)",
        key="order_id",
        foreign_keys=(("customer_id", "customers"),),
    ),
    "order_items": Table(
        "item_id INT, order_id INT, product_id INT, quantity INT, price DECIMAL(10,2)",
        key="item_id",
        foreign_keys=(("order_id", "orders"),),
    ),
    "products": Table(
        "product_id INT, name VARCHAR(100), category VARCHAR(50), price DECIMAL(10,2),"
        " brand VARCHAR(50)",
        key="product_id",
    ),
    "returns": Table(
        "return_id INT, order_id INT, return_date DATE, reason VARCHAR(255)",
        key="return_id",
        foreign_keys=(("order_id", "orders"),),
    ),
    "campaigns": Table(
        "campaign_id INT, campaign_name VARCHAR(100), start_date DATE, end_date DATE",
        key="campaign_id",
    ),
    "campaign_clicks": Table(
        "click_id INT, campaign_id INT, customer_id INT, click_date DATE",
        key="click_id",
        foreign_keys=(("campaign_id", "campaigns"), ("customer_id", "customers")),
    ),
}


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Read one retail table with its declared schema; nothing is inferred."""
    return spark.read.schema(TABLES[name].schema).format(fmt).load(path)


def buckets_for(tables: Iterable[DataFrame], least: int = 1, rows: int = 1_000_000) -> int:
    """A number of buckets for tables that are to be joined, by the number of rows of the largest:
    about ``rows`` in each, so that what a task holds does not grow with the tables."""
    return max([least, *(-(-df.count() // rows) for df in tables)])


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``df`` as a table of the warehouse, dealt into ``buckets`` by ``key`` and sorted by it.

    Tables that are joined or grouped by the key again and again pay the shuffle once, here: as
    long as their numbers of buckets are equal, a join of two of them and a grouping that includes
    the key move no row. Choose the number so that a bucket fits a task. Rows are dealt before they
    are written, so every bucket is one file.
    """
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).format("parquet").mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name].schema)


def insert_values(target: DataFrame, rows: Iterable[Sequence]) -> DataFrame:
    """``target`` plus literal rows, each value cast to the column's type.

    Quoted dates become DATE. A value that cannot be cast raises (ANSI mode).
    """
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in target.schema])
    literal = target.sparkSession.createDataFrame(
        [tuple(None if v is None else str(v) for v in row) for row in rows], as_text
    )
    typed = literal.select(*(F.col(f.name).cast(f.dataType) for f in target.schema))
    return target.unionByName(typed)
