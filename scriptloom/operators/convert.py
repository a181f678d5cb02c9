"""Passing blocks through an external text-to-text converter, and the records of a run.

A chunk table has ``id`` (ending in ``_<number>``), ``type`` and ``code``. A record table has
``id``, ``ok``, ``code``, ``reason``, ``input_tokens``, ``output_tokens``, ``total_tokens``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.functions.text import word_count

# What a converter may return: the converted text, or the text with the number of input and
# output tokens the service reported.
Converted = str | tuple[str, int, int]

# Request texts. {id}, {type}, {code} stand for the columns of the chunk.
SAS_CHUNK_REQUEST = (
    "### SAS code (chunk {id}, type={type}) ###\n{code}\n\n### PySpark equivalent ###"
)
BLOCK_REQUEST = (
    "\nYou are a data engineer. Convert the following PL/SQL code block into equivalent"
    " PySpark (Python) code. Maintain the logic and structure as closely as possible."
    " Comment important translations.\n\nPL/SQL Code:\n{code}\n\n# Begin PySpark Code:\n"
)
BLOCK_REQUEST_CODE_ONLY = (
    "You are a data engineer. Convert the following PL/SQL code block into PySpark DataFrame"
    " API code.\nOnly return valid, executable Python code. Do not include explanations,"
    " comments, or markdown.\nPL/SQL Block:\n{code}\n"
)
BLOCK_REQUEST_MIGRATION = (
    "You are a senior data engineer experienced in migrating legacy PL/SQL code to PySpark."
    "\n\nConvert the following PL/SQL block into PySpark using the DataFrame API.\nReturn only"
    " executable Python code.\n\nPL/SQL Block:\n{code}\n"
)
SCRIPT_REQUEST = (
    "You are a data engineer. Convert the following ENTIRE PL/SQL script into a single, clean,"
    " production-ready PySpark script using the DataFrame API.\nIntegrate all logic,"
    " deduplicate where possible, use idiomatic and maintainable PySpark, and output only the"
    " final, unified, executable Python code. Do not simply concatenate per-block code: merge"
    " and optimize for clarity and maintainability.\n\nFull PL/SQL Script:\n{code}\n"
)
SCRIPT_REQUEST_MIGRATION = (
    "You are a senior data engineer experienced in migrating legacy PL/SQL code to PySpark."
    "\n\nConvert the following ENTIRE PL/SQL script into a single, clean, production-ready"
    " PySpark script using the DataFrame API.\nIntegrate all logic, deduplicate where possible,"
    " use idiomatic PySpark, and output only the final, unified, executable Python code. Do"
    " not simply concatenate per-block code: merge and optimize for clarity and"
    " maintainability.\n\nFull PL/SQL Script:\n{code}\n"
)
# System texts that go with the requests, for converters that take one.
SAS_SYSTEM_TEXT = (
    "You are an expert migration engineer.\nConvert the given SAS code block to **equivalent"
    " PySpark** (DataFrame API or spark.sql). Keep the business logic and naming intact.\nIf"
    " conversion is not possible, wrap the SAS block inside a commented  spark.sql(''' ..."
    " ''') placeholder."
)
BLOCK_SYSTEM_TEXT = "You are a helpful assistant that converts PL/SQL code to PySpark code."
# Texts in the records of failed, skipped and dry-run chunks.
ERROR_PREFIX = "# LLM ERROR: "
EMPTY_RESULT = "LLM returned empty result"
DRY_RUN_CODE, DRY_RUN_REASON = "# DRY RUN - SKIPPED", "Dry run mode"
SKIPPED_REASON = "Skipped"

RECORD_COLUMNS = (
    "ok", "code", "reason", "input_tokens", "output_tokens", "total_tokens",
)


def as_chunks(blocks: DataFrame, type_column: str = "block_type") -> DataFrame:
    """A block table as a chunk table: ``id`` is ``<script_id>_<block_no>``."""
    return blocks.select(
        "script_id",
        "block_no",
        F.concat_ws("_", F.col("script_id"), F.col("block_no")).alias("id"),
        F.upper(type_column).alias("type"),
        F.col("block").alias("code"),
    )


def _template_parts(template: str) -> tuple[list[str], list[str]]:
    """The fixed texts of a template and the fields between them; one text more than fields."""
    texts, fields = [""], []
    for text, field in re.findall(r"((?:[^{}]|\{\{|\}\})*)(?:\{([^{}]+)\})?", template):
        texts[-1] += text.replace("{{", "{").replace("}}", "}")
        if field:
            fields.append(field)
            texts.append("")
    return texts, fields


def render(template: str) -> Column:
    """The template with its ``{column}`` fields filled in from the row (NULL as nothing).

    ``{{`` and ``}}`` stand for braces.
    """
    texts, fields = _template_parts(template)
    parts: list[Column] = [F.lit(texts[0])]
    for text, field in zip(texts[1:], fields):
        parts += [F.coalesce(F.col(field).cast("string"), F.lit("")), F.lit(text)]
    return F.concat(*parts)


def render_prompt(chunks: DataFrame, template: str = SAS_CHUNK_REQUEST) -> DataFrame:
    """Add the request text and the number of its words, the fallback token count."""
    rendered = chunks.withColumn("request", render(template))
    return rendered.withColumn("request_tokens", word_count(F.col("request")))


def render_prompts(chunks: DataFrame, templates: Mapping[str, str]) -> DataFrame:
    """The chunks once per template, with its name, the request and its words; one scan."""
    requests = [F.struct(F.lit(n).alias("template"), render(t).alias("request")) for n, t in templates.items()]
    exploded = chunks.select("*", F.explode(F.array(*requests)).alias("_rendered")).select(
        *chunks.columns, "_rendered.template", "_rendered.request"
    )
    return exploded.withColumn("request_tokens", word_count(F.col("request")))


def convert(
    chunks: DataFrame,
    open_converter: Callable[..., Callable[[str], Converted]] | None = None,
    template: str = SAS_CHUNK_REQUEST,
    keys: Sequence[str] = ("id",),
    retries: int = 1,
    error_prefix: str = ERROR_PREFIX,
    allow_empty: bool = False,
    dry_run: bool = False,
    skip_types: Iterable[str] = (),
    system: str | None = None,
    in_flight: int = 1,
    back_off: float = 0.0,
    open_counter: Callable[[], Callable[[list[str]], Sequence[int]]] | None = None,
    store: str | None = None,
    model: str = "unknown",
    commit_every: int = 1000,
    source: str | None = None,
) -> DataFrame:
    """One record per chunk: ``keys`` and :data:`RECORD_COLUMNS`, and before those the chunk's own
    code under the name ``source`` if one is given.

    ``open_converter`` makes the converter, once per partition, and is given the ``system``
    text if there is one; the converter gets the request text. An exception or an empty text (unless ``allow_empty``) is tried again
    ``retries`` times, after ``back_off`` seconds that double with every try, and then kept as a
    failed record. Chunks of a type in ``skip_types`` are not sent, and in a dry run none is.

    ``in_flight`` calls of a partition run at a time, each in a thread with a converter of its
    own; records keep their order. Where the service reports no token counts, ``open_counter``
    gives a counter of a list of texts, opened once per partition; what it fails on, or everything
    without one, is counted in words.

    Without a ``store`` a lost task repeats its calls. Write or checkpoint the result before
    sorting it (a sort samples its input first) or reading it more than once, as
    :func:`scriptloom.plans.conversion.run_conversion` does. Keep speculation off, and set
    the number of partitions times ``in_flight`` to the concurrency the service allows.

    With a ``store``, a folder on shared storage, the calls are made right away and their replies
    kept there, under the hash of request, system text and ``model``. Requests that it has a reply
    for are not sent, equal ones are sent once, and every ``commit_every`` replies or so are
    committed together: a run after a failed one makes only the calls whose replies were lost.
    Failed calls are made again by the next run. Reading the result calls nobody.
    """
    skipped_types = [t.lower() for t in skip_types]
    # The type goes along only where it is looked at.
    type_column = ["type"] if skipped_types else []
    skipped = F.lower("type").isin(skipped_types)
    kept = [*keys, *([F.col("code").alias(source)] if source else [])]
    if dry_run:
        sent = chunks.select(
            *kept, *type_column, *(F.lit(None).cast(t).alias(c) for c, t in _REPLY_TYPES.items())
        )
    else:
        if open_converter is None:
            raise ValueError("no converter given")
        texts, fields = _template_parts(template)

        def call(rows: DataFrame, texts: list[str], columns: list[str]) -> DataFrame:
            return _call(
                rows, texts, columns, open_converter, retries, error_prefix, allow_empty, system, in_flight, back_off,
                open_counter,
            )

        if store is None:
            # The requests are put together where they are sent. Fields that go along move once.
            strings = {f.name for f in chunks.schema if f.dataType.simpleString() == "string"}
            along = {name: name for name in keys if name in strings}
            if source and "code" in strings:
                along["code"] = source
            columns = [along.get(f, f"{_FIELD}{i}") for i, f in enumerate(fields)]
            moved = [F.col(f).cast("string").alias(c) for f, c in zip(fields, columns) if c.startswith(_FIELD)]
            is_sent = [(~skipped).alias(_SENT)] if skipped_types else []
            sent = call(chunks.select(*kept, *type_column, *moved, *is_sent), texts, columns)
        else:
            request = F.when(~skipped, render(template)) if skipped_types else render(template)
            requests = chunks.select(*kept, *type_column, request.alias("request"))

            def whole(rows: DataFrame) -> DataFrame:
                return call(rows.withColumnRenamed("request", f"{_FIELD}0"), ["", ""], [f"{_FIELD}0"])

            sent = _stored_replies(requests, whole, store, system, model, commit_every)
    not_sent = F.col("ok").isNull()
    code, reason = F.when(not_sent, DRY_RUN_CODE), F.when(not_sent, DRY_RUN_REASON)
    if skipped_types:
        code = F.when(skipped, F.concat(F.lit("# "), F.upper("type"), F.lit(" skipped\n"))).when(not_sent, DRY_RUN_CODE)
        reason = F.when(skipped, SKIPPED_REASON).when(not_sent, DRY_RUN_REASON)
    record = sent.select(
        *keys,
        *([source] if source else []),
        F.coalesce("ok", F.lit(True)).alias("ok"),
        code.otherwise(F.col("code")).alias("code"),
        reason.otherwise(F.col("reason")).alias("reason"),
        F.when(F.col("ok"), F.col("input_tokens")).otherwise(0).alias("input_tokens"),
        F.when(F.col("ok"), F.col("output_tokens")).otherwise(0).alias("output_tokens"),
    )
    return record.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


# Columns that only go to the call.
_FIELD, _SENT = "_request_field_", "_request_is_sent"

_REPLY_TYPES = {
    "ok": "boolean",
    "code": "string",
    "reason": "string",
    "input_tokens": "int",
    "output_tokens": "int",
}


def _call(
    rows: DataFrame,
    texts: list[str],
    columns: list[str],
    open_converter,
    retries: int,
    error_prefix: str,
    allow_empty: bool,
    system: str | None,
    in_flight: int,
    back_off: float,
    open_counter,
) -> DataFrame:
    """Send the request of every row: ``texts`` with the values of ``columns`` (NULL as nothing)
    between them. Rows whose column ``_SENT``, if there is one, is not true are not sent. All
    columns but those for the call alone are kept."""
    kept = [f for f in rows.schema if f.name != _SENT and not f.name.startswith(_FIELD)]
    names = [f.name for f in kept]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
        + [f"{c} {t}" for c, t in _REPLY_TYPES.items()]
    )
    empty_result = EMPTY_RESULT
    if in_flight < 1:
        raise ValueError("in_flight must be at least 1")
    is_sent = _SENT if _SENT in rows.columns else None
    form = "%s".join(t.replace("%", "%%") for t in texts)
    # Where blanks part the values from the texts, the words of a request are theirs together.
    apart = all(
        (t[:1].isspace() or i == 0 or t == "" and i == len(texts) - 1)
        and (t[-1:].isspace() or i == len(texts) - 1 or t == "" and i == 0)
        for i, t in enumerate(texts)
    )
    fixed_words = sum(len(t.split()) for t in texts)

    # Self-contained, so that workers can run it without this package on their path.
    def run(batches):
        import threading
        import time
        from concurrent.futures import ThreadPoolExecutor

        import pyarrow as pa

        reply_types = (pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.int32())
        of_thread = threading.local()

        def converter_of_thread():
            if not hasattr(of_thread, "converter"):
                of_thread.converter = open_converter() if system is None else open_converter(system)
            return of_thread.converter

        def ask(request, convert=None):
            convert = convert or converter_of_thread()
            for attempt in range(retries + 1):
                if attempt and back_off:
                    time.sleep(back_off * 2 ** (attempt - 1))
                try:
                    answer, counts = convert(request), None
                    if isinstance(answer, tuple):
                        answer, *counts = answer
                    text = answer.strip()
                    if not text and not allow_empty:
                        raise ValueError(empty_result)
                    return (True, text, "", *counts) if counts else (True, text, "", None, None)
                except Exception as error:  # noqa: BLE001 - kept in the record
                    failure = str(error)
            return False, f"{error_prefix}{failure}", failure, 0, 0

        counters = []

        def count(texts):
            """Tokens of every text, words of those that the counter fails on."""
            if not counters or counters[0] is None:
                return [len(t.split()) for t in texts]
            try:
                counts = [int(n) for n in counters[0](texts)]
                if len(counts) == len(texts):
                    return counts
            except Exception:  # noqa: BLE001
                pass
            if len(texts) == 1:
                return [len(texts[0].split())]
            half = len(texts) // 2
            return count(texts[:half]) + count(texts[half:])

        def counter_opened():
            try:
                if open_counter is not None and not counters:
                    counters.append(open_counter())
            except Exception:  # noqa: BLE001 - words are counted instead
                counters.append(None)
            return bool(counters) and counters[0] is not None

        def words_asked(values):
            if len(columns) == 1:
                return fixed_words + len(values.split())
            return fixed_words + sum([len(v.split()) for v in values])

        def replies_to(values, pool):
            """The replies as columns; ``values`` fill the request of every row, None for one not sent."""
            requests = [None if of is None else form % of for of in values]
            sent = [i for i, r in enumerate(requests) if r is not None]
            asked = [requests[i] for i in sent]
            if pool:
                answers = list(pool.map(ask, asked))
            else:
                convert = converter_of_thread() if asked else None
                answers = (ask(r, convert) for r in asked)
            # Straight into columns: a tuple kept for every row is work for the garbage collector.
            found = [[None] * len(requests) for _ in reply_types]
            oks, codes, reasons, inputs, outputs = found
            open_counts = []
            for i, answer in zip(sent, answers):
                oks[i], codes[i], reasons[i], inputs[i], outputs[i] = answer
                if inputs[i] is None:
                    open_counts.append(i)
            if open_counts and (counter_opened() or not apart):
                counts = count([t for i in open_counts for t in (requests[i], codes[i])])
                for k, i in enumerate(open_counts):
                    inputs[i], outputs[i] = counts[2 * k : 2 * k + 2]
            else:
                for i in open_counts:
                    inputs[i], outputs[i] = words_asked(values[i]), len(codes[i].split())
            return found

        def values_of(batch):
            """What fills the request of every row: a text, or a tuple of other than one."""
            # Much faster than to_pylist, which makes a scalar object of every value.
            found = [batch.column(c).fill_null("").to_numpy(zero_copy_only=False).tolist() for c in columns]
            values = found[0] if len(found) == 1 else list(zip(*found)) or [()] * batch.num_rows
            if is_sent is None:
                return values
            return [of if sent else None for of, sent in zip(values, batch.column(is_sent).to_pylist())]

        pool = ThreadPoolExecutor(in_flight) if in_flight > 1 else None
        try:
            for batch in batches:
                found = replies_to(values_of(batch), pool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n) for n in names]
                    + [pa.array(c, t) for c, t in zip(found, reply_types)],
                    names=names + ["ok", "code", "reason", "input_tokens", "output_tokens"],
                )
        finally:
            if pool:
                pool.shutdown(cancel_futures=True)

    return rows.mapInArrow(run, schema)


_STORED = ", ".join(["request_key string", "run string", *(f"{c} {t}" for c, t in _REPLY_TYPES.items())])


def _replies(spark, store: str) -> DataFrame:
    try:
        return spark.read.schema(_STORED).parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _STORED)


def _stored_replies(
    requests: DataFrame, call, store: str, system: str | None, model: str, commit_every: int
) -> DataFrame:
    """The requests with the replies of the store, after calling for those that it lacks."""
    spark, run = requests.sparkSession, uuid.uuid4().hex
    parts = [F.sha2("request", 256), *(F.sha2(F.lit(t), 256) for t in (system or "", model))]
    keyed = requests.withColumn("request_key", F.when(F.col("request").isNotNull(), F.sha2(F.concat(*parts), 256)))
    known = _replies(spark, store).filter("ok").select("request_key")
    asked = keyed.filter("request_key IS NOT NULL").groupBy("request_key").agg(F.min("request").alias("request"))
    missing = asked.join(known, "request_key", "left_anti")
    number = missing.select("request_key").count()
    if number:
        # The file committer that moves a task's files when the task ends, not when the job does.
        # Dealt by a hash of the key: by the key itself, the join's own partitions would be kept.
        commits = -(-number // commit_every)
        (
            call(missing.repartition(commits, F.xxhash64("request_key")))
            .withColumn("run", F.lit(run))
            .write.mode("append")
            .option("mapreduce.fileoutputcommitter.algorithm.version", "2")
            .parquet(store)
        )
    # A task that was lost after its commit has left its replies twice.
    reply = F.struct("ok", *[c for c in _REPLY_TYPES if c != "ok"])
    replies = _replies(spark, store).filter(F.col("ok") | (F.col("run") == run))
    replies = replies.groupBy("request_key").agg(F.max(reply).alias("reply"))
    return keyed.join(replies, "request_key", "left").select(
        *[c for c in requests.columns if c != "request"], "reply.*"
    )


def _id_number(id_column: str = "id") -> Column:
    """The number after the last ``_``; an id without one raises."""
    return F.substring_index(id_column, "_", -1).cast("bigint")


def with_source(chunks: DataFrame) -> DataFrame:
    """Chunks whose code also stands in ``input_sas_code``, to be named among the ``keys``."""
    return chunks.withColumn("input_sas_code", F.col("code"))


def has_repeated_ids(records: DataFrame) -> bool:
    return not records.groupBy("id").count().filter("count > 1").isEmpty()


def conversion_audit(
    records: DataFrame, chunks: DataFrame | None = None, unique_ids: bool = False
) -> DataFrame:
    """Every record with its source text, ordered by the number in its id.

    Records that carry ``input_sas_code`` need no ``chunks``. Of several sources with one id the
    last by ``seq`` counts for all of them, of those with one ``seq`` the larger text; repeated
    ids without a ``seq`` column raise. A record without a chunk gets ``''``. Where ids are known
    to be unique, ``unique_ids`` saves the search for repeated ones, and texts move once, for the
    sort.
    """
    source = "input_sas_code"
    if chunks is not None:
        if "seq" not in chunks.columns:
            raise ValueError("the chunk table needs a column seq: the last source of an id counts")
        last = chunks.groupBy("id").agg(F.max(F.struct("seq", "code"))["code"].alias(source))
        sourced = records.drop(source).join(last, "id", "left")
    elif unique_ids:
        sourced = records
    else:
        # Only ids that occur more than once are joined, as a rule none.
        ordered = "seq" in records.columns
        rank = F.max("seq") if ordered else F.lit(None).cast("int")
        repeated = records.groupBy("id").agg(F.count("*").alias("_n"), rank.alias("_seq")).filter("_n > 1")
        if ordered:
            texts = records.select("id", F.col("seq").alias("_seq"), F.col(source).alias("_last"))
            repeated = texts.join(repeated, ["id", "_seq"]).groupBy("id").agg(
                F.max("_last").alias("_last"), F.max("_n").alias("_n")
            )
        else:
            refused = F.raise_error(F.concat(F.lit("repeated id without a column seq: "), F.col("id")))
            repeated = repeated.select("id", refused.cast("string").alias("_last"), "_n")
        joined = records.join(repeated, "id", "left")
        sourced = joined.withColumn(
            source, F.when(F.col("_n").isNotNull(), F.col("_last")).otherwise(F.col(source))
        )
    return sourced.select(
        "id",
        _id_number().alias("id_num"),
        F.col("ok").alias("success"),
        F.coalesce("reason", F.lit("")).alias("reason"),
        F.coalesce(source, F.lit("")).alias(source),
        F.col("code").alias("output_pyspark_code"),
        "input_tokens",
        "output_tokens",
        "total_tokens",
    ).orderBy("id_num", "id")


def conversion_failures(records: DataFrame) -> DataFrame:
    """Ids of failed chunks in id order, one row each."""
    failed = records.filter(~F.col("ok"))
    return failed.select(_id_number().alias("id_num"), "id").orderBy("id_num", "id")


def conversion_successes(records: DataFrame) -> DataFrame:
    return records.filter("ok")


def conversion_meta(records: DataFrame, model: str = "unknown") -> DataFrame:
    """One row: time, model and the numbers of chunks, successes and failures."""
    return records.agg(
        F.current_timestamp().alias("timestamp"),
        F.lit(model).alias("model"),
        F.count(F.lit(1)).alias("total_chunks"),
        F.count_if("ok").alias("successes"),
        F.count_if(~F.col("ok")).alias("failures"),
    )


def convert_mapping(chunks: DataFrame, open_converter=None, **options) -> DataFrame:
    """Each block next to its converted text: the block goes through the call, nothing is joined."""
    records = convert(chunks, open_converter, keys=("script_id", "block_no"), source="block", **options)
    return records.select("script_id", "block_no", "block", F.col("code").alias("converted"))


def conversion_mapping(blocks: DataFrame, converted: DataFrame) -> DataFrame:
    """Each block next to its converted text, for tables that arrive apart: paired by script and
    block number. See :func:`convert_mapping` where the call is made here.

    Both are dealt by the script alone: neighbours in a script are much alike and stay together, so
    that shuffle files get smaller than with blocks dealt one by one.
    """
    texts = converted.select("script_id", "block_no", F.col("code").alias("converted"))
    of_scripts = [df.repartition("script_id") for df in (blocks.select("script_id", "block_no", "block"), texts)]
    return of_scripts[0].join(of_scripts[1], ["script_id", "block_no"])


def _joined(separator: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct("block_no", "code")))
    return F.array_join(ordered["code"], separator)


def assemble_script(converted: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Converted blocks joined by a blank line in block order, one row per script.

    A script is one text before and after, so it must fit one value (2 GB); see
    :func:`assemble_parts` for pieces of a set number of blocks.
    """
    return converted.groupBy("script_id").agg(_joined(separator).alias("code"))


def assemble_parts(converted: DataFrame, blocks_per_part: int, separator: str = "\n\n") -> DataFrame:
    """As :func:`assemble_script`, in numbered parts, which joined by the separator give the script."""
    part_no = F.floor((F.col("block_no") - 1) / blocks_per_part).cast("int")
    return converted.groupBy("script_id", part_no.alias("part_no")).agg(_joined(separator).alias("code"))
