"""Stored replies, calls in flight and token counters."""

import os

import pytest
from pyspark.sql import functions as F

from scriptloom.operators import convert as cv
from scriptloom.plans.conversion import run_conversion


def make_opener(folder, poison=""):
    """Converters that note every call in a file of its own process and thread."""

    def opener(system=None):
        import os
        import threading
        import time

        def convert(request):
            with open(f"{folder}/{os.getpid()}-{threading.get_ident()}", "a") as notes:
                notes.write(f"{time.time()} {request.split(',')[0].split()[-1]}\n")
            if poison and poison in request:
                # Once most others are done, this worker is lost.
                while sum(len(open(f"{folder}/{n}").readlines()) for n in os.listdir(folder)) < 15:
                    time.sleep(0.2)
                time.sleep(3)
                raise SystemExit("worker lost")
            if "no answer" in request:
                raise RuntimeError("busy")
            return f"# {system or ''}{len(request)}"

        return convert

    return opener


def calls(folder):
    return [line.split()[1] for name in os.listdir(folder) for line in open(f"{folder}/{name}")]


@pytest.fixture
def chunks(spark):
    rows = [(f"c_{i}", "proc", f"proc a{i}; run;") for i in range(40)]
    return spark.createDataFrame(rows, "id string, type string, code string")


def records(df):
    return sorted(tuple(r) for r in df.collect())


def folder_of(tmp_path, name):
    (tmp_path / name).mkdir()
    return str(tmp_path / name)


def test_second_run_makes_no_calls(chunks, tmp_path):
    notes, store = folder_of(tmp_path, "notes"), f"{tmp_path}/store"
    plain = records(cv.convert(chunks, make_opener(folder_of(tmp_path, "other"))))
    first = cv.convert(chunks, make_opener(notes), store=store, commit_every=7)
    assert records(first) == plain and records(first) == plain
    assert sorted(calls(notes)) == sorted(f"c_{i}" for i in range(40))
    assert records(cv.convert(chunks, make_opener(notes), store=store)) == plain
    assert len(calls(notes)) == 40
    # Another model or system text is another request.
    other = cv.convert(chunks, make_opener(notes), store=store, model="new")
    assert records(other) == plain and len(calls(notes)) == 80
    told = cv.convert(chunks, make_opener(notes), store=store, system="s")
    assert records(told) != plain and len(calls(notes)) == 120


def test_run_after_a_lost_task_makes_only_the_lost_calls(spark, chunks, tmp_path):
    notes, store = folder_of(tmp_path, "notes"), f"{tmp_path}/store"
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark makes of a lost worker
        cv.convert(chunks, make_opener(notes, poison="proc a17;"), store=store, commit_every=5)
    kept = spark.read.parquet(store).count()
    assert 0 < kept < 40
    again = folder_of(tmp_path, "again")
    assert cv.convert(chunks, make_opener(again), store=store, commit_every=5).filter("ok").count() == 40
    assert len(calls(again)) == 40 - kept
    assert cv.convert(chunks, make_opener(again), store=store).count() == 40 and len(calls(again)) == 40 - kept


def test_failures_are_tried_again_by_the_next_run(spark, tmp_path):
    notes, store = folder_of(tmp_path, "notes"), f"{tmp_path}/store"
    rows = [("c_1", "x", "no answer"), ("c_2", "x", "fine"), ("c_3", "x", None), ("c_3", "x", None)]
    df = spark.createDataFrame(rows, "id string, type string, code string")
    plain = records(cv.convert(df, make_opener(folder_of(tmp_path, "other")), retries=0))
    for run in (1, 2):
        assert records(cv.convert(df, make_opener(notes), retries=0, store=store)) == plain
        assert sorted(calls(notes)) == sorted(["c_1"] * run + ["c_2", "c_3"])  # equal requests are sent once
    none = df.limit(0)
    assert cv.convert(none, make_opener(notes), store=f"{tmp_path}/new").count() == 0
    skipped = cv.convert(df, make_opener(notes), store=f"{tmp_path}/new", skip_types=["x"])
    assert {r.code for r in skipped.collect()} == {"# X skipped\n"} and len(calls(notes)) == 4


def test_run_conversion_with_a_store(chunks, tmp_path):
    notes, store = folder_of(tmp_path, "notes"), f"{tmp_path}/store"
    run = run_conversion(chunks, make_opener(notes), model="m", store=store)
    assert run.audit.count() == run.successes.count() == 40 and run.meta.first().total_chunks == 40
    assert run_conversion(chunks, make_opener(notes), model="m", store=store).audit.count() == 40
    assert len(calls(notes)) == 40


def test_repeated_ids_still_raise(spark, tmp_path):
    df = spark.createDataFrame([("c_1", "x", "a"), ("c_1", "x", "b")], "id string, type string, code string")
    with pytest.raises(Exception, match="repeated id"):
        run_conversion(df, make_opener(folder_of(tmp_path, "notes"))).audit.collect()
    assert run_conversion(df.withColumn("seq", F.lit(1)), make_opener(str(tmp_path / "notes"))).audit.collect()[0].input_sas_code == "b"


def slow_opener(folder):
    def opener():
        import os
        import threading
        import time

        def convert(request):
            start = time.time()
            time.sleep(0.2)
            with open(f"{folder}/{os.getpid()}-{threading.get_ident()}", "a") as notes:
                notes.write(f"{start} {time.time()}\n")
            return request

        return convert

    return opener


@pytest.mark.parametrize("k", [1, 4])
def test_calls_in_flight(chunks, tmp_path, k):
    folder = folder_of(tmp_path, "notes")
    got = cv.convert(chunks.coalesce(1), slow_opener(folder), in_flight=k).collect()
    assert [r.id for r in got] == [f"c_{i}" for i in range(40)]
    assert all(f"chunk {r.id}," in r.code for r in got)
    times = [tuple(map(float, line.split())) for name in os.listdir(folder) for line in open(f"{folder}/{name}")]
    assert len(os.listdir(folder)) == k  # a converter for each
    assert max(sum(a <= start < b for a, b in times) for start, _ in times) == k
    with pytest.raises(ValueError):
        cv.convert(chunks, slow_opener(folder), in_flight=0)


def test_back_off(spark, tmp_path):
    folder = folder_of(tmp_path, "notes")
    df = spark.createDataFrame([("c_1", "x", "no answer")], "id string, type string, code string")
    row = cv.convert(df, make_opener(folder), retries=3, back_off=0.1).first()
    assert not row.ok and row.reason == "busy"
    [name] = os.listdir(folder)
    times = [float(line.split()[0]) for line in open(f"{folder}/{name}")]
    waits = [b - a for a, b in zip(times[:-1], times[1:], strict=True)]
    assert len(waits) == 3 and waits[0] >= 0.1 and waits[1] >= 0.2 and waits[2] >= 0.4


def counting(fails, folder=None):
    def open_counter():
        if folder:
            open(f"{folder}/opened", "a").write("x")
        if fails == "open":
            raise RuntimeError("no tokenizer")

        def count(texts):
            if any(fails and fails in t for t in texts):
                raise ValueError("cannot")
            return [1000 + len(t) for t in texts]

        return count

    return open_counter


def test_token_counter(chunks, tmp_path):
    opener = make_opener(folder_of(tmp_path, "notes"))
    plain = {r.id: r for r in cv.convert(chunks, opener).collect()}
    requests = {r.id: r.request for r in cv.render_prompt(chunks).collect()}
    folder = folder_of(tmp_path, "counters")
    counted = cv.convert(chunks.coalesce(1), opener, open_counter=counting("a7;", folder)).collect()
    assert open(f"{folder}/opened").read() == "x"
    for r in counted:
        if r.id == "c_7":
            assert r.input_tokens == plain[r.id].input_tokens and r.output_tokens == 1000 + len(r.code)
        else:
            assert (r.input_tokens, r.output_tokens) == (1000 + len(requests[r.id]), 1000 + len(r.code))
        assert r.total_tokens == r.input_tokens + r.output_tokens
    assert records(cv.convert(chunks, opener, open_counter=counting("open"))) == sorted(tuple(r) for r in plain.values())
    # What the service reports is not counted again.
    reported = cv.convert(chunks, lambda: lambda request: ("x", 3, 4), open_counter=counting(""))
    assert {(r.input_tokens, r.output_tokens) for r in reported.collect()} == {(3, 4)}
