import pytest
from pyspark.sql import functions as F
from pyspark.errors import PySparkException

from scriptloom.operators import blocks as blk
from scriptloom.operators import convert as cv
from scriptloom.operators.validate import validate_code
from scriptloom.plans.conversion import migrate_scripts, run_conversion

CHUNKS = [
    ("c_2", "PROC", "proc sort; run;"),
    ("c_10", "DATASTEP", "data a; x = 1; run;"),
    ("c_1", "COMMENT", "* flaky;"),
    ("c_3", "LIBNAME", "broken"),
    ("c_4", "LIBNAME", "empty"),
    ("c_5", "PROC", "counted"),
]


def make_opener():
    # Local functions are pickled by value; workers cannot import this module.
    def opener():
        tried = set()

        def convert(request):
            first = request not in tried
            tried.add(request)
            if "flaky" in request and first:
                raise RuntimeError("busy")
            if "broken" in request:
                raise RuntimeError("no luck")
            if "empty" in request:
                return " \n"
            if "counted" in request:
                return "x y z", 100, 200
            return "  df.select('a').filter('b')\n"

        return convert

    return opener


opener = make_opener()


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "id string, type string, code string")


def by_id(df):
    return {r.id: tuple(r)[1:] for r in df.collect()}


def test_prompt(spark, chunks):
    row = cv.render_prompt(chunks).filter("id = 'c_2'").first()
    assert row.request == (
        "### SAS code (chunk c_2, type=PROC) ###\nproc sort; run;\n\n### PySpark equivalent ###"
    )
    assert row.request_tokens == 11 + 3 == len(row.request.split())


def test_outcomes(chunks):
    text = "df.select('a').filter('b')"
    assert by_id(cv.convert(chunks, opener)) == {
        "c_1": (True, text, "", 13, 1, 14),
        "c_2": (True, text, "", 14, 1, 15),
        "c_3": (False, "# LLM ERROR: no luck", "no luck", 0, 0, 0),
        "c_4": (
            False, "# LLM ERROR: LLM returned empty result", "LLM returned empty result", 0, 0, 0,
        ),
        "c_5": (True, "x y z", "", 100, 200, 300),
        "c_10": (True, text, "", 17, 1, 18),
    }


def test_no_retry_and_own_prefix(chunks):
    records = by_id(cv.convert(chunks, opener, retries=0, error_prefix="# Error: "))
    assert records["c_1"][:3] == (False, "# Error: busy", "busy")
    lenient = by_id(cv.convert(chunks, opener, allow_empty=True))
    assert lenient["c_4"][:3] == (True, "", "")


def test_null_code_is_sent_as_nothing(spark, chunks):
    null = spark.createDataFrame([("c_1", "PROC", None)], chunks.schema)
    [record] = cv.convert(null, opener).collect()
    assert record.ok and record.code == "df.select('a').filter('b')" and record.input_tokens == 11


def test_dry_run_and_skipped_types(chunks):
    dry = by_id(cv.convert(chunks, dry_run=True, skip_types=["comment"]))
    assert dry["c_1"] == (True, "# COMMENT skipped\n", "Skipped", 0, 0, 0)
    assert dry["c_3"] == (True, "# DRY RUN - SKIPPED", "Dry run mode", 0, 0, 0)
    sent = by_id(cv.convert(chunks, opener, skip_types=["LIBNAME"]))
    assert sent["c_4"] == (True, "# LIBNAME skipped\n", "Skipped", 0, 0, 0)
    assert sent["c_5"][1] == "x y z"
    with pytest.raises(ValueError):
        cv.convert(chunks)


def test_run_calls_the_converter_once_per_chunk(spark, chunks):
    calls = spark.sparkContext.accumulator(0)
    opener = make_opener()

    def counting():
        def convert(request):
            calls.add(1)
            return opener()(request.replace("flaky", ""))

        return convert

    run = run_conversion(chunks, counting, model="m", retries=0)
    audit = run.audit.collect()
    assert [r.id for r in audit] == ["c_1", "c_2", "c_3", "c_4", "c_5", "c_10"]
    assert audit[1].input_sas_code == "proc sort; run;"
    assert [r.id for r in run.failures.collect()] == ["c_3", "c_4"]
    meta = run.meta.first()
    assert (meta.model, meta.total_chunks, meta.successes, meta.failures) == ("m", 6, 4, 2)
    assert run.successes.count() == 4
    assert calls.value == len(CHUNKS)


def test_audit_of_missing_and_repeated_ids(spark, chunks):
    records = cv.convert(chunks, opener)
    sources = spark.createDataFrame(
        [("c_1", 1, "old"), ("c_1", 2, "new"), ("c_2", 1, "b")], "id string, seq int, code string"
    )
    for parts in (1, 2, 3, 5, 7):
        dealt = cv.conversion_audit(records, sources.repartition(parts))
        audit = {r.id: r.input_sas_code for r in dealt.collect()}
        assert audit["c_1"] == "new" and audit["c_2"] == "b" and audit["c_10"] == ""
    with pytest.raises(ValueError):
        cv.conversion_audit(records, sources.drop("seq"))
    carried = cv.with_source(sources.withColumn("type", F.lit("x")))
    carried = cv.convert(carried, dry_run=True, keys=["id", "seq", "input_sas_code"])
    own = [(r.id, r.input_sas_code) for r in cv.conversion_audit(carried).collect()]
    assert own == [("c_1", "new"), ("c_1", "new"), ("c_2", "b")]
    with pytest.raises(PySparkException):
        cv.conversion_audit(carried.drop("seq")).collect()
    unnumbered = spark.createDataFrame([("c_x", "PROC", "y")], chunks.schema)
    with pytest.raises(PySparkException):
        run_conversion(unnumbered, opener).audit.collect()


def test_assemble_in_block_order_and_parts(spark):
    rows = [("s", i, f"code {i}") for i in (10, 2, 1, 3, 11)] + [("t", 1, "only")]
    converted = spark.createDataFrame(rows, "script_id string, block_no int, code string")
    whole = {r.script_id: r.code for r in cv.assemble_script(converted).collect()}
    assert whole["s"] == "\n\n".join(f"code {i}" for i in (1, 2, 3, 10, 11))
    assert whole["t"] == "only"
    parts = cv.assemble_parts(converted, 2).orderBy("script_id", "part_no").collect()
    assert [(r.part_no, r.code) for r in parts if r.script_id == "s"] == [
        (0, "code 1\n\ncode 2"), (1, "code 3"), (4, "code 10"), (5, "code 11"),
    ]
    assert "\n\n".join(r.code for r in parts if r.script_id == "s") == whole["s"]


def test_mapping_pairs_by_number(spark):
    blocks = spark.createDataFrame(
        [("s", 1, "a"), ("s", 2, "b")], "script_id string, block_no int, block string"
    )
    converted = spark.createDataFrame(
        [("s", 2, "B"), ("s", 1, "A")], "script_id string, block_no int, code string"
    )
    rows = cv.conversion_mapping(blocks, converted).collect()
    assert sorted((r.block, r.converted) for r in rows) == [("a", "A"), ("b", "B")]


def test_migrate_scripts(spark, example_script):
    def open_converter():
        return lambda request: f"spark.read.table('t').select('{len(request)}')"

    scripts = spark.createDataFrame([("s", example_script)], "script_id string, text string")
    [row] = migrate_scripts(scripts, open_converter).code.collect()
    assert row.code.count("spark.read") == 3 == blk.chunk_corpus(scripts).count()
    assert row.validation_passed and row.validation_score == 100
    [dry] = migrate_scripts(scripts, dry_run=True).code.collect()
    assert dry.code == "\n\n".join(["# DRY RUN - SKIPPED"] * 3)
    assert dry.validation_tags == ["dry_run"] and dry.validation_passed


def test_migration_calls_once_per_block(spark, example_script):
    calls = spark.sparkContext.accumulator(0)

    def open_converter():
        def convert(request):
            calls.add(1)
            return "df"

        return convert

    scripts = spark.createDataFrame([("s", example_script)], "script_id string, text string")
    run = migrate_scripts(scripts, open_converter)
    for _ in range(2):
        assert run.code.count() == 1 and run.records.count() == 3
    assert len(run.audit.collect()) == 3 and run.failures.count() == 0 == run.failures.count()
    assert run.meta.first().successes == 3 and calls.value == 3


def test_long_script_has_one_row_and_the_verdict_of_its_text(spark):
    code = [f"x{i} = 1" for i in range(5000)]
    code[4500] = "spark.read.parquet(p).filter(c)"
    rows = [("s", i + 1, c) for i, c in enumerate(code)]
    blocks = spark.createDataFrame(rows, "script_id string, block_no int, code string")
    [row] = validate_code(cv.assemble_script(blocks)).collect()
    whole = spark.createDataFrame([("\n\n".join(code),)], "code string")
    assert row.code == whole.first().code
    assert row.validation_score == validate_code(whole).first().validation_score == 100


def test_mapping_moves_no_text(spark):
    chunks = spark.createDataFrame(
        [("s", 1, "s_1", "X", "a")], "script_id string, block_no int, id string, type string, code string"
    )
    mapped = cv.convert_mapping(chunks, opener)
    plan = mapped._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert mapped.first().block == "a"


def test_system_text_and_braces(spark, chunks):
    def open_converter(system):
        return lambda request: f"{system}: {request}"

    row = cv.convert(chunks.limit(1), open_converter, template="{{{id}}} {code}", system="S").first()
    assert row.code == "S: {c_2} proc sort; run;"


@pytest.mark.parametrize(
    "code, score, tags",
    [
        (None, 30, ["length_check", "spark_coverage"]),
        ("", 30, ["length_check", "spark_coverage"]),
        (".select(.join(", 60, ["length_check"]),
        ("spark.read.parquet(p).filter(c)", 100, []),
        ("spark.read.table(t) and nothing else", 70, ["spark_coverage"]),
        ("spark.read.table(t).select(a) NATION", 70, ["llm_artifact"]),
        ("   pass   ", 0, ["length_check", "spark_coverage", "llm_artifact"]),
        (".select(.join( 12345", 100, []),
        (".select(.join( 1234 \n", 60, ["length_check"]),
        ("spark.read spark.read spark.read", 70, ["spark_coverage"]),
        ("df.select(x).filter(y) # todo pas", 100, []),
        ("password .write .join( xxxxxx", 70, ["llm_artifact"]),
    ],
)
def test_validator(spark, code, score, tags):
    df = spark.createDataFrame([(code,)], "code string")
    row = validate_code(df).first()
    assert (row.validation_score, row.validation_tags) == (score, tags)
    assert row.validation_passed == (not tags)
    assert row.failed_chunks == ([] if not tags else ["validation"])
    dry = validate_code(df, dry_run=True).first()
    assert (dry.validation_passed, dry.validation_score) == (True, 100)
    assert dry.validation_tags == ["dry_run"] and dry.failed_chunks == []


def test_the_stand_in_keeps_no_requests():
    """It kept every request of a partition, and an executor's Python grew with the input."""
    import tracemalloc

    from checks.queries import open_stand_in

    convert = open_stand_in()()
    tracemalloc.start()
    for i in range(5000):
        convert(f"{i} " + "x" * 2000)
    kept, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 1_000_000
    for _ in range(2):
        with pytest.raises(RuntimeError):
            convert("proc sort;")
        assert convert("proc sort;").startswith(" df = ")


TEMPLATES = ("a {code} b", "{code}\n{type} c", "x({code})%s {{y}} 100%", "{code}{type}", "no field", cv.SAS_CHUNK_REQUEST)


@pytest.mark.parametrize("template", TEMPLATES)
def test_requests_of_the_call_are_the_rendered_ones(spark, template):
    """Also their words, and values with blanks at the ends, none or NULL."""
    def open_converter():
        return lambda request: request.replace(" ", "_ ")

    codes = [" a b ", "", None, "%s {x}", "\u2003x\u00a0y", "c"]
    rows = [(f"c_{i}", "T", c) for i, c in enumerate(codes)]
    chunks = spark.createDataFrame(rows, "id string, type string, code string")
    sent = cv.convert(chunks, open_converter, template=template, allow_empty=True, source="given")
    requests = {r.id: r.request for r in chunks.select("id", cv.render(template).alias("request")).collect()}
    for r in sent.collect():
        assert r.code == requests[r.id].replace(" ", "_ ").strip()
        assert r.input_tokens == len(requests[r.id].split()) and r.output_tokens == len(r.code.split())
        assert r.given == codes[int(r.id[2:])]


def test_only_what_a_request_needs_goes_through_the_call(spark):
    """No request text made beforehand, no type that nobody looks at, the block only once."""
    schema = "script_id string, block_no int, id string, type string, code string"
    chunks = spark.createDataFrame([("s", 1, "s_1", "X", "a")], schema)
    mapped = cv.convert_mapping(chunks, opener, template=cv.BLOCK_REQUEST)
    sent = mapped._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1].split("\n", 1)[1]
    assert "data engineer" not in sent and "type#" not in sent.splitlines()[0]
    assert sent.count(" AS ") == 1 and mapped.first().block == "a"


def test_records_are_read_by_column(spark, chunks):
    run = run_conversion(chunks, opener)
    plan = run.records.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string>" in plan
    assert run.records.count() == len(CHUNKS)


def test_mapping_is_dealt_by_script(spark):
    """Pairs as a plain join makes them, repeated and NULL keys among them."""
    keys = [("s", 1), ("s", 1), ("s", 2), ("t", 1), (None, 1), ("t", None), ("u", 1)]
    blocks = spark.createDataFrame([(*k, f"b{i}") for i, k in enumerate(keys)], "script_id string, block_no int, block string")
    converted = spark.createDataFrame([(*k, f"c{i}") for i, k in enumerate(keys[:6])], "script_id string, block_no int, code string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mapped = cv.conversion_mapping(blocks, converted)
        plan = mapped._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(script_id#") == 2 == plan.count("Exchange")
        assert plan.count(", block_no#") and "block_no#" not in plan.split("hashpartitioning(")[1].split(")")[0]
        rows = sorted(tuple(r) for r in mapped.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == sorted(
        (*k, f"b{i}", f"c{j}") for i, k in enumerate(keys) for j, m in enumerate(keys[:6]) if k == m and None not in k
    )
