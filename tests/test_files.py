import pytest
from pyspark.errors import PySparkException

from scriptloom.operators import blocks as blk
from scriptloom.operators import convert as cv
from scriptloom.sources import csv_tables
from scriptloom.sources.scripts import pasted_script, read_scripts, spread
from scriptloom.streaming.scripts import watch_scripts

NASTY = ['a "quoted" one', "two\nlines\n", "  blanks  ", "", None, "\\N\\", 'x","y', "é;\t--"]


def test_csv_keeps_every_text(spark, tmp_path):
    rows = list(enumerate(NASTY))
    df = spark.createDataFrame(rows, "i int, text string")
    csv_tables.write_csv(df, f"{tmp_path}/t")
    back = csv_tables.read_csv(spark, f"{tmp_path}/t", "i int, text string")
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_exports(spark, tmp_path, example_script):
    blocks = blk.chunk_corpus(pasted_script(spark, example_script))
    csv_tables.write_block_csv(blocks, f"{tmp_path}/blocks")
    back = csv_tables.read_csv(spark, f"{tmp_path}/blocks", csv_tables.BLOCK_EXPORT_SCHEMA)
    assert [r["Block Number"] for r in back.orderBy("Block Number").collect()] == [
        "Block 1", "Block 2", "Block 3",
    ]
    assert sorted(r["PL/SQL Block"] for r in back.collect()) == sorted(
        r.block for r in blocks.collect()
    )
    csv_tables.write_stats_csv(blk.block_stats(blocks), f"{tmp_path}/stats")
    header = spark.read.text(f"{tmp_path}/stats").first().value
    assert header == '"Block #","Type","Lines","Chars","First Line Preview"'
    chunks = cv.as_chunks(blk.with_block_type(blocks))
    for _ in range(2):  # the second run replaces the first
        csv_tables.write_chunk_csv(chunks, f"{tmp_path}/chunks")
    stored = csv_tables.read_csv(spark, f"{tmp_path}/chunks", "id string, type string, code string")
    assert stored.count() == 3
    records = cv.convert(cv.with_source(chunks), dry_run=True, keys=["id", "input_sas_code"])
    csv_tables.write_audit_csv(cv.conversion_audit(records), f"{tmp_path}/audit")
    header = spark.read.text(f"{tmp_path}/audit").first().value
    assert header.replace('"', "") == (
        "id,success,reason,input_sas_code,output_pyspark_code,input_tokens,output_tokens,total_tokens"
    )
    numbered = cv.convert(chunks, dry_run=True, keys=["script_id", "block_no"])
    csv_tables.write_mapping_csv(cv.conversion_mapping(blocks, numbered), f"{tmp_path}/mapping")
    assert spark.read.options(header=True, multiLine=True, escape='"').csv(
        f"{tmp_path}/mapping"
    ).columns == ["script_id", "block_no", "PL/SQL Block", "Converted PySpark"]


def test_assembled_rows_and_texts(spark, tmp_path):
    rows = [("folder/" * 50 + str(k), f"code {k}\nmore") for k in range(5)] + [("none", None)]
    scripts = spark.createDataFrame(rows, "script_id string, code string")
    csv_tables.write_assembled(scripts, f"{tmp_path}/rows")
    back = csv_tables.read_csv(spark, f"{tmp_path}/rows", csv_tables.ASSEMBLED_SCHEMA)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    csv_tables.write_script_texts(scripts.filter("code IS NOT NULL"), f"{tmp_path}/texts", 3)
    written = "".join(f.read_text() for f in (tmp_path / "texts").glob("bucket=*/*.txt"))
    assert all(f"# script: {i}\n{c}\n\n" in written for i, c in rows if c)


def _write_scripts(folder):
    (folder / "deep").mkdir(parents=True)
    (folder / "a.sql").write_bytes(b"select 1;\r\nselect 2;")
    (folder / "deep" / "b.txt").write_text("é;")
    (folder / "D.SQL").write_text("upper;")
    (folder / "c.md").write_text("no script")


def test_script_files(spark, tmp_path):
    _write_scripts(tmp_path / "in")
    scripts = read_scripts(spark, f"{tmp_path}/in")
    texts = {r.script_id.rsplit("/", 1)[-1]: r.text for r in scripts.collect()}
    assert texts == {"a.sql": "select 1;\r\nselect 2;", "b.txt": "é;", "D.SQL": "upper;"}
    (tmp_path / "in" / "_hidden.Sql").write_text("x;")
    with pytest.raises(ValueError):
        read_scripts(spark, f"{tmp_path}/in")
    assert read_scripts(spark, f"{tmp_path}/in", refuse_hidden=False).count() == 3
    (tmp_path / "in" / "_hidden.Sql").unlink()
    (tmp_path / "in" / "bad.sql").write_bytes(b"\xff\xfe;")
    with pytest.raises(PySparkException):
        read_scripts(spark, f"{tmp_path}/in").collect()
    lenient = read_scripts(spark, f"{tmp_path}/in", strict=False).collect()
    assert sum(r.text is None for r in lenient) == 1 and len(lenient) == 4


def test_arriving_files_give_the_same_blocks(spark, tmp_path, example_script):
    _write_scripts(tmp_path / "in")
    (tmp_path / "in" / "example.sql").write_text(example_script)
    query = (
        blk.with_block_type(blk.chunk_corpus(watch_scripts(spark, f"{tmp_path}/in")))
        .writeStream.format("parquet")
        .option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/state")
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(120)
    batch = blk.with_block_type(blk.chunk_corpus(read_scripts(spark, f"{tmp_path}/in")))
    stream = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_spread(spark):
    assert spread(spark.range(0, 100, 1, 1), "id", 5).rdd.getNumPartitions() == 5


def test_csv_files_are_smaller_than_their_texts(spark, tmp_path):
    df = spark.range(2000).selectExpr("id", "concat('UPDATE t SET a = ', id, '\n WHERE b = \"', id * 7, '\"') AS text")
    csv_tables.write_csv(df.coalesce(1), f"{tmp_path}/t")
    written = sum(f.stat().st_size for f in tmp_path.glob("t/part-*"))
    assert written < df.selectExpr("sum(length(text)) AS n").first().n / 2
    assert sorted(csv_tables.read_csv(spark, f"{tmp_path}/t", "id bigint, text string").collect()) == sorted(df.collect())
