"""Monthly revenue and returned orders per product category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_details(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Order lines with their order date, category and line total.

    Both joins are inner: a line whose product or order is unknown drops out. Products are
    joined first, so that the fact table is shuffled on ``order_id`` only once when products
    can be broadcast (the optimizer decides that by size), and last before the aggregation
    that reuses that partitioning when they cannot.
    """
    lines = (
        items.select("order_id", "product_id", "quantity", "price")
        .join(products.select("product_id", "category"), "product_id")
        .withColumn("total", F.col("quantity") * F.col("price"))
    )
    return orders.select("order_id", "order_date").join(lines, "order_id").select(
        "order_id", "order_date", "category", "quantity", "price", "total"
    )


def returned_orders(returns: DataFrame) -> DataFrame:
    """Distinct keys of returned orders; joining on it never multiplies revenue rows."""
    return returns.select("order_id").distinct()


def _month(date):
    return F.trunc(date, "MM").alias("month")


def _with_return_flag(per_order: DataFrame, returns: DataFrame) -> DataFrame:
    flagged = returned_orders(returns).withColumn("is_returned", F.lit(True))
    return per_order.join(flagged, "order_id", "left")


def returned_orders_by_month(details: DataFrame, returns: DataFrame) -> DataFrame:
    """Number of distinct orders per month with at least one return.

    Rows are reduced to one for each order and month inside the join's partitioning; what is
    shuffled after that is a plain count.
    """
    per_order = details.select("order_id", _month("order_date"))
    reduced = (
        _with_return_flag(per_order, returns)
        .groupBy("order_id", "month")
        .agg(F.max("is_returned").alias("is_returned"))
    )
    # An order without an id is in no count of orders.
    counted = F.col("is_returned") & F.col("order_id").isNotNull()
    return reduced.groupBy("month").agg(F.count_if(counted).alias("returned_orders"))


def monthly_revenue_returns(
    orders: DataFrame, items: DataFrame, products: DataFrame, returns: DataFrame
) -> DataFrame:
    """Revenue and returned orders per category and month, ordered by both.

    The lines are first reduced to one row per (order, category, month). That runs inside
    the join's own partitioning, and it makes the distinct count of orders a plain count, so
    nothing of fact-table size is shuffled again. A hot order collapses there too. Where orders,
    lines and returns are tables bucketed by the order (``sources.tables.write_bucketed``) and
    products small enough to broadcast, no row of them is shuffled at all.
    """
    per_order = (
        order_details(orders, items, products)
        .groupBy("order_id", "category", _month("order_date"))
        .agg(F.sum("total").alias("revenue"))
    )
    return (
        _with_return_flag(per_order, returns)
        .groupBy("category", "month")
        .agg(
            F.sum("revenue").alias("gross_revenue"),
            F.count(F.when(F.col("is_returned").isNotNull(), F.col("order_id"))).alias(
                "returned_orders"
            ),
        )
        .orderBy("category", "month")
    )
