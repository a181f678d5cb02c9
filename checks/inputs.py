"""Operator inputs derived from the driver tables.

The expressions are SQL text that Spark and DuckDB both understand, so that a query and its
comparison SQL start from the same rows. Every script, chunk and code text belongs to one
row of a table; nothing is filtered or cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptloom.session import configure
from scriptloom.sources.scripts import spread

NL, CR, _Q = "chr(10)", "chr(13)", "chr(39)"
_KEY = "cast(o_orderkey as string)"
_CUST = "cast(o_custkey as string)"


def _sql(*parts: str) -> str:
    """Concatenation; parts starting with a quote are literals and end with a newline."""
    return " || ".join(f"{p} || {NL}" if p.startswith("'") else p for p in parts)


_UPDATE = _sql(f"'  UPDATE accounts SET total = total * 1.1, status = ' || {_CUST} || ' WHERE id = 10;'")
_INSERT = _sql(f"'INSERT INTO log VALUES (' || {_KEY} || ', o_orderpriority);'")
_LONG = f"'SELECT ' || repeat('o_orderpriority, ', cast(o_custkey % 130 as int)) || {_KEY} || ' FROM dual;' || {NL}"

_SHAPES = (
    _sql(
        f"'CREATE OR REPLACE PROCEDURE proc_' || {_KEY} || ' IS'",
        "'  v_count NUMBER := 0;'",
        "'BEGIN'",
        f"repeat({_UPDATE}, cast(o_custkey % 27 as int))",
        "'  IF v_count > 0 THEN'",
        _UPDATE,
        "'  END IF;'",
        "'END;'",
        "'/'",
        "''",
        "'-- Standalone statement'",
        f"'DELETE FROM orders WHERE id = ' || {_KEY} || ';'",
    ),
    _sql(
        f"'declare' || {CR}",
        f"'  v_end date := o_orderdate;' || {CR}",
        f"'begin' || {CR}",
        f"repeat({_UPDATE}, cast(o_orderkey % 19 as int))",
        f"'end;' || {CR}",
        f"'/' || {CR}",
        f"'update t set a = 1 where b = ' || {_CUST} || ';' || {CR} || 'commit;'",
    ),
    _sql(
        f"repeat({_INSERT}, cast(o_custkey % 23 as int))",
        f"'-- a note; for order ' || {_KEY}",
        "'SELECT o_orderstatus FROM orders;'",
        "'  -- nothing but a comment;'",
        f"repeat({_INSERT}, cast(o_orderkey % 31 as int))",
        "'COMMIT'",
    ),
    _sql(
        f"'/* load; of ' || {_CUST}",
        "'   several lines */'",
        "'INSERT INTO t SELECT * FROM s; -- trailing'",
        "';;'",
        "' ;'",
        _LONG,
        "'-- only a comment'",
        "'-- and another one;'",
        "'MERGE INTO t USING s ON (t.id = s.id);'",
    ),
    _sql(
        "'BEGIN'",
        f"'  x := ' || {_KEY} || ';'",
        "'  BEGIN'",
        _LONG,
        f"repeat({_UPDATE}, cast(o_custkey % 40 as int))",
        "'  END inner_block;'",
        "'END;'",
        f"'DECLARE y NUMBER; BEGIN y := ' || {_CUST} || '; END;CREATE TRIGGER trg x; END ;'",
    ),
    _sql(
        f"'create  or replace function f_' || {_KEY} || '(a number) return number is'",
        "'begin'",
        "'  return a;'",
        "'end f;'",
        "'/'",
        f"'CREATE OR REPLACE PACKAGE BODY pkg_' || {_CUST} || ' AS'",
        f"repeat({_INSERT}, cast(o_orderkey % 13 as int))",
        "'END;'",
    ),
    _sql(
        f"'CREATE OR REPLACE PACKAGE BODY deep_' || {_KEY} || ' AS'",
        "'  PROCEDURE one IS n NUMBER; BEGIN'",
        f"repeat({_UPDATE}, cast(o_custkey % 17 as int))",
        "'    FOR i IN 1..3 LOOP IF n > 0 THEN n := CASE WHEN n = 1 THEN 2 ELSE 3 END; END IF; END LOOP;'",
        "'  END one;'",
        "'END /* of the package; */ deep; DROP TABLE IF EXISTS t;'",
        f"'INSERT INTO t VALUES (' || {_Q} || 'a;b' || {_Q} || ', \"c;d\"); -- BEGIN; ' || {_CUST}",
        "'END; CREATE TABLE u (a NUMBER); SELECT 1'",
    ),
)


def _by_remainder(key: str, values) -> str:
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {cases} END"


# Scripts: one per order, and every document with its full stops made statement ends.
ORDER_SCRIPT = _by_remainder("o_orderkey", _SHAPES)
DOCUMENT_SCRIPT = "replace(text, '.', ';')"

# Chunks of one statement or block with an id, a type and code.
CHUNK_ID = f"'chunk_' || {_KEY}"
CHUNK_TYPE = _by_remainder("o_orderkey", ("'proc'", "'datastep'", "'comment'", "'macro'"))
SAS_CODE = _by_remainder(
    "o_orderkey",
    (
        _sql(f"'data d_' || {_KEY} || ';'", f"'  x = ' || {_CUST} || ';'", "'  length y 8;'",
             "repeat('set b ; z=1; ', cast(o_custkey % 9 as int))", "'run;'"),
        _sql("'proc sort;'", f"'  by k_' || {_CUST} || ';'", "'run ;'"),
        f"'libname l_' || {_KEY} || ' \"/data/' || o_orderstatus || '\";'",
        f"'%include \"f_' || {_CUST} || '.sas\";'",
        f"'* order ' || {_KEY} || ' of ' || o_orderpriority || ' ;'",
        f"'DATA D_' || {_KEY} || '; RUN;'",
        f"'if x > ' || {_KEY} || '; y = x + 1; output;;'",
        f"'do while (i < ' || {_CUST} || '); i = i + 1; format d date9.; end;'",
        f"'%macro m_' || {_KEY} || '; data a; x = 1; run; %mend;'",
        f"'%macro b_' || {_KEY} || '; x = 1; %mend;'",
        _sql("'%macro two;'", f"'libname l \"/' || {_KEY} || '\"; if a; b = 1;;'", "'* inner; proc p; by k; run;'", "' %mend ;'", "'* after;'"),
        _sql("'data a; x = 1; run;'", "''", f"'proc print; var v_' || {_CUST} || '; run;'"),
        f"'data a; x = ' || {_KEY} || '; run; left over'",
        _sql(f"'%macro a_' || {_KEY} || '; %macro b; %macro c; data x; y = ' || {_CUST} || '; run; %mend; * deep;'",
             "'%mend; proc p; by k; run; %macro d;%mend; %mend;'", "'%macro e; * again; %mend; data z; q = 1; run;'"),
        f"'%macro a; %macro b; x_' || {_KEY} || ' = 1; %mend; %mend;'",
        f"'%macro a; data x; y = ' || {_KEY} || '; run; %mend; %mend;'",
        f"'%macro a; %macro b; * of ' || {_KEY} || '; %mend;'",
        f"'%macro a; * is no %macro b; libname l \"%mend; ' || {_KEY} || '\"; %macro c; if a; b = 1;; %mend; %mend;'",
    ),
)

# Generated code for the validator.
GENERATED_CODE = _by_remainder(
    "o_orderkey",
    (
        f"'df = spark.read.table(\"t' || {_KEY} || '\").select(\"a\")'",
        f"'df' || {_KEY} || ' = 1 # nothing of the kind here'",
        f"' .join(.write ' || {NL} || {NL}",
        f"'spark.read.parquet(p).filter(c) # ' || o_orderpriority || ' password ' || {_CUST}",
        f"'x = df.groupBy(\"NATION\").count() ' || {_KEY}",
        "cast(null as string)",
        f"repeat(' ', cast(o_custkey % 30 as int)) || 'pass' || repeat({NL}, cast(o_custkey % 30 as int))",
        f"'# LLM ERROR: ' || {_CUST}",
        f"'df.withColumn(\"x\", lit(' || {_KEY} || ')).write.parquet(\"o\") # ' || repeat('ok ', cast(o_custkey % 50 as int))",
    ),
)


# One statement per order with every kind of token.
STATEMENT = _by_remainder(
    "o_orderkey",
    (
        f"'UPDATE t SET a=' || {_Q} || 'it' || {_Q} || {_Q} || 's ' || o_orderpriority || {_Q}"
        f" || ', b := 1.5 WHERE \"c d\" <> ' || {_KEY} || '; -- note; ' || {_CUST}",
        f"'/* two' || {NL} || 'lines */ SELECT x.*, f(' || {_KEY} || ')||' || {_Q} || {_Q}"
        f" || ' FROM t$' || {_CUST} || ' WHERE a>=.5 AND b!=c'",
        f"'for i in 1..' || {_CUST} || ' loop' || {NL} || ' p(i => -i*2, ' || {_Q}"
        f" || o_orderstatus || {_Q} || ' ); end loop; /'",
        f"'--' || {NL} || '/* open ' || {_KEY} || ' \"x\" é_1 ß, % 3<4'",
    ),
)


# The driver tables are one small file each: scripts made from them are dealt over this many.
PARTITIONS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def retail_orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS order_id",
        "o_custkey AS customer_id",
        "cast(o_orderdate AS date) AS order_date",
        "o_orderstatus AS status",
    )


def retail_items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS order_id",
        "l_partkey AS product_id",
        "cast(l_quantity AS int) AS quantity",
        "cast(l_extendedprice AS decimal(12,2)) AS price",
    )


def retail_products(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS product_id", "p_type AS category")


def retail_returns(spark, sf_dir) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return returned.selectExpr("l_orderkey AS order_id")


def _orders(spark, sf_dir) -> DataFrame:
    columns = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return spread(table(spark, sf_dir, "orders").select(*columns), "o_orderkey", PARTITIONS)


def scripts(spark, sf_dir) -> DataFrame:
    orders = _orders(spark, sf_dir).selectExpr(
        "'order ' || cast(o_orderkey as string) AS script_id", f"{ORDER_SCRIPT} AS text"
    )
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    documents = spread(documents, "doc_id", PARTITIONS).selectExpr(
        "'document ' || cast(doc_id as string) AS script_id", f"{DOCUMENT_SCRIPT} AS text"
    )
    return orders.unionByName(documents)


def chunks(spark, sf_dir) -> DataFrame:
    return _orders(spark, sf_dir).selectExpr(
        f"{CHUNK_ID} AS id", f"{CHUNK_TYPE} AS type", f"{SAS_CODE} AS code"
    )


def generated_code(spark, sf_dir) -> DataFrame:
    return _orders(spark, sf_dir).selectExpr("o_orderkey", f"{GENERATED_CODE} AS code")


def statements(spark, sf_dir) -> DataFrame:
    return _orders(spark, sf_dir).selectExpr(
        f"{CHUNK_ID} AS script_id", "1 AS block_no", f"{STATEMENT} AS block"
    )


SCRIPTS_SQL = (
    f"SELECT 'order ' || cast(o_orderkey as string) AS script_id, {ORDER_SCRIPT} AS text FROM orders"
    f" UNION ALL SELECT 'document ' || cast(doc_id as string), {DOCUMENT_SCRIPT} FROM documents"
)
CHUNKS_SQL = f"SELECT {CHUNK_ID} AS id, {CHUNK_TYPE} AS type, {SAS_CODE} AS code FROM orders"
GENERATED_SQL = f"SELECT o_orderkey, {GENERATED_CODE} AS code FROM orders"
STATEMENTS_SQL = f"SELECT {CHUNK_ID} AS script_id, 1 AS block_no, {STATEMENT} AS block FROM orders"
