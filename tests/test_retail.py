import datetime
import uuid
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scriptloom.operators import audits, dml
from scriptloom.plans import retail
from scriptloom.sources.tables import TABLES, empty_table, insert_values, read_table, write_bucketed

# The sample rows.
ROWS = {
    "customers": [
        (1, "Alice", "F", 29, "2023-01-10"),
        (2, "Bob", "M", 34, "2023-02-14"),
        (3, "Carol", "F", 25, "2023-03-20"),
    ],
    "products": [
        (101, "Laptop", "Electronics", "1200.00", "Dell"),
        (102, "Smartphone", "Electronics", "800.00", "Samsung"),
        (103, "Backpack", "Accessories", "60.00", "Nike"),
    ],
    "orders": [
        (1001, 1, "2023-02-01", "Shipped"),
        (1002, 2, "2023-02-15", "Returned"),
        (1003, 3, "2023-03-01", "Delivered"),
    ],
    "order_items": [
        (201, 1001, 101, 1, "1200.00"),
        (202, 1002, 102, 1, "800.00"),
        (203, 1003, 103, 2, "120.00"),
    ],
    "returns": [(301, 1002, "2023-02-20", "Damaged")],
    "campaigns": [(401, "Winter Sale", "2023-01-01", "2023-02-01")],
    "campaign_clicks": [(501, 401, 1, "2023-01-10"), (502, 401, 2, "2023-01-15")],
}


@pytest.fixture(scope="module")
def shop(spark):
    return {n: insert_values(empty_table(spark, n), rows).cache() for n, rows in ROWS.items()}


def report(shop, **changed):
    t = {**shop, **changed}
    df = retail.monthly_revenue_returns(
        t["orders"], t["order_items"], t["products"], t["returns"]
    )
    return [tuple(r) for r in df.collect()]


EXPECTED = [
    ("Accessories", datetime.date(2023, 3, 1), Decimal("240.00"), 0),
    ("Electronics", datetime.date(2023, 2, 1), Decimal("2000.00"), 1),
]


def test_report(shop):
    assert report(shop) == EXPECTED


def test_two_returns_of_an_order_count_once_and_keep_revenue(shop):
    returns = insert_values(shop["returns"], [(302, 1002, "2023-03-20", None)])
    assert report(shop, returns=returns) == EXPECTED


def test_order_with_two_categories_counts_in_both(shop):
    items = insert_values(shop["order_items"], [(204, 1002, 103, 1, "1.00"), (205, 1002, 102, 1, "1")])
    assert report(shop, order_items=items) == [
        ("Accessories", datetime.date(2023, 2, 1), Decimal("1.00"), 1),
        EXPECTED[0],
        ("Electronics", datetime.date(2023, 2, 1), Decimal("2001.00"), 1),
    ]


def test_unknown_product_or_order_drops_out(shop):
    items = insert_values(
        shop["order_items"], [(206, 1001, 999, 1, "5.00"), (207, 9999, 101, 1, "5.00")]
    )
    assert report(shop, order_items=items) == EXPECTED


def test_returned_orders_by_month(shop):
    details = retail.order_details(shop["orders"], shop["order_items"], shop["products"])
    rows = retail.returned_orders_by_month(details, shop["returns"]).orderBy("month").collect()
    assert [tuple(r) for r in rows] == [
        (datetime.date(2023, 2, 1), 1),
        (datetime.date(2023, 3, 1), 0),
    ]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_order_is_split_and_counted_right(spark):
    """A third of all lines belong to one order; the join must not leave them to one task."""
    n = 600_000
    lines = spark.range(0, n, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).cast("int").alias("order_id"),
        (F.col("id") % 10).cast("int").alias("product_id"),
        F.lit(1).alias("quantity"),
        (F.rand(1) * 100).cast("decimal(10,2)").alias("price"),
    )
    orders = spark.range(5000).selectExpr(
        "cast(id AS int) AS order_id", "date_add(DATE'2023-01-01', cast(id % 90 AS int)) AS order_date"
    )
    products = spark.range(10).selectExpr(
        "cast(id AS int) AS product_id", "concat('c', id % 3) AS category"
    )
    returns = spark.range(0, 5000, 7).selectExpr("cast(id AS int) AS order_id")
    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    before = {k: spark.conf.get(k, None) for k in options}
    try:
        for key, value in options.items():
            spark.conf.set(key, value)
        df = retail.monthly_revenue_returns(orders, lines, products, returns)
        rows = df.collect()
        assert "(skew=true)" in _plan(df)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    plain = (
        lines.join(orders, "order_id")
        .join(products, "product_id")
        .join(returns.withColumn("r", F.lit(1)), "order_id", "left")
        .groupBy("category", F.trunc("order_date", "MM").alias("month"))
        .agg(
            F.sum(F.col("quantity") * F.col("price")).alias("revenue"),
            F.countDistinct(F.when(F.col("r") == 1, F.col("order_id"))).alias("returned"),
        )
        .orderBy("category", "month")
    )
    assert [tuple(r) for r in rows] == [tuple(r) for r in plain.collect()]


def test_pushdown_and_pruning(spark, tmp_path, shop):
    for name in ("orders", "order_items", "products", "returns"):
        shop[name].write.parquet(f"{tmp_path}/{name}")
    t = {n: read_table(spark, n, f"{tmp_path}/{n}") for n in ("orders", "order_items", "products", "returns")}
    df = retail.monthly_revenue_returns(
        t["orders"], t["order_items"], t["products"], t["returns"]
    )
    plan = _plan(df)
    assert "ReadSchema: struct<order_id:int,order_date:date>" in plan
    assert "struct<order_id:int,product_id:int,quantity:int,price:decimal(10,2)>" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert [tuple(r) for r in df.collect()] == EXPECTED


def test_declared_tables(spark):
    assert TABLES["customers"].length_limits == {"name": 100, "gender": 1}
    assert TABLES["order_items"].schema["price"].dataType.simpleString() == "decimal(10,2)"
    assert sum(len(t.length_limits) for t in TABLES.values()) == 8
    assert sum(len(t.foreign_keys) for t in TABLES.values()) == 5


def test_insert_casts_or_raises(spark, shop):
    assert shop["customers"].first().signup_date == datetime.date(2023, 1, 10)
    with pytest.raises(PySparkException):
        insert_values(shop["returns"], [(1, 1, "not a date", "x")]).collect()


def test_sample_rows_keep_all_rules(shop):
    for name, table in TABLES.items():
        assert audits.key_violations(shop[name], [table.key]).count() == 0
        assert audits.length_violations(shop[name], table.length_limits, [table.key]).count() == 0
        for column, parent in table.foreign_keys:
            assert audits.orphans(shop[name], column, shop[parent], TABLES[parent].key).count() == 0


def test_audits_find_violations(shop):
    doubled = insert_values(shop["orders"], [(1001, 9, None, "x" * 21), (None, None, None, None)])
    found = audits.key_violations(doubled, ["order_id"]).collect()
    assert sorted((str(r.order_id), r.row_count) for r in found) == [("1001", 2), ("None", 1)]
    lost = audits.orphans(doubled, "customer_id", shop["customers"], "customer_id").collect()
    assert [r.customer_id for r in lost] == [9]
    [long] = audits.length_violations(doubled, TABLES["orders"].length_limits, ["order_id"]).collect()
    assert tuple(long) == (1001, "status", 21, 20)


@pytest.fixture(scope="module")
def staff(spark):
    return spark.createDataFrame(
        [(10, Decimal("100.00")), (20, Decimal("50.05")), (None, Decimal("1.00"))],
        "department_id int, salary decimal(10,2)",
    )


def test_updates(spark, staff):
    raised = {"salary": F.col("salary") * F.lit("1.1").cast("decimal(2,1)")}

    def salaries(df):
        return {r.department_id: str(r.salary) for r in df.collect()}

    for department, after in ((10, "110.00"), (20, "55.06")):
        chosen = F.col("department_id") == department
        updated = dml.guarded_update(staff, dml.count_where(staff, chosen), chosen, raised)
        assert salaries(updated)[department] == after
        assert updated.schema == staff.schema
    none = dml.count_where(staff, F.col("department_id") == 99)
    assert none.collect()[0].n == 0
    untouched = dml.guarded_update(staff, none, F.col("department_id") == 10, raised)
    assert salaries(untouched) == salaries(staff)
    assert "NestedLoop" not in _plan(untouched) and "Cartesian" not in _plan(untouched)
    set_null = dml.update_where(staff, F.col("department_id") != 10, {"salary": F.lit(None)})
    assert salaries(set_null) == {10: "100.00", 20: "None", None: "1.00"}


def test_lookup(spark, staff):
    names = spark.createDataFrame([(10, "Sales"), (30, "IT")], "id int, department_name string")
    found = dml.lookup(staff, names, "department_id", "id", "department_name").collect()
    assert {r.department_id: r.department_name for r in found} == {10: "Sales", 20: None, None: None}


def test_bucketed_facts_are_not_shuffled(spark):
    """Below the reduction to one row per order nothing moves but the products, which are broadcast."""
    n = 20_000
    orders = spark.range(n).selectExpr("id AS order_id", "date_add(DATE '2023-01-01', cast(id % 90 AS int)) AS order_date")
    items = spark.range(4 * n).selectExpr(
        "id % 20000 AS order_id", "id % 50 AS product_id", "1 AS quantity", "cast(id % 7 AS decimal(12,2)) AS price"
    )
    products = spark.range(50).selectExpr("id AS product_id", "concat('c', id % 3) AS category")
    returns = spark.range(0, n, 5).selectExpr("id AS order_id")
    names = [f"{name}_{uuid.uuid4().hex}" for name in ("orders", "items", "returns")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "5000")
    try:
        facts = [
            write_bucketed(df, name, "order_id", 8)
            for df, name in zip((orders, items, returns), names, strict=True)
        ]
        report = retail.monthly_revenue_returns(facts[0], facts[1], products, facts[2])
        rows = report.collect()
        final = report._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert sorted(rows) == sorted(retail.monthly_revenue_returns(orders, items, products, returns).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    exchanges = [line for line in final.splitlines() if "Exchange " in line and "Broadcast" not in line]
    assert len(exchanges) == 2  # per category and month, and the order of the result
    assert all("order_id" not in line for line in exchanges)
    assert final.count("SortMergeJoin") == 2


def test_number_of_buckets_follows_the_rows(spark):
    from scriptloom.sources.tables import buckets_for

    assert buckets_for([spark.range(10), spark.range(95)], least=4, rows=10) == 10
    assert buckets_for([spark.range(0), spark.range(5)], least=4, rows=10) == 4


def test_shuffles_start_from_many_partitions(spark):
    """With few, a task would sort and aggregate more the larger the tables are."""
    options = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b",
    }
    for key, value in options.items():
        spark.conf.set(key, value)
    try:
        grouped = spark.range(200_000).groupBy((F.col("id") * 7).alias("k")).count()
        assert grouped.rdd.getNumPartitions() > 100
    finally:
        for key in options:
            spark.conf.unset(key)
