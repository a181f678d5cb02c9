"""Best-fit packing planned on a histogram of lengths (operator 3).

Documents are tokenised and cut into pieces; the counts of the at most ``size`` different lengths
go to the driver, which runs best-fit decreasing on counts: all sequences with the same free room
and history form one run, so the plan has a few rows for each length whatever the corpus. Pieces
get a rank among those of their length and take the planned slot that covers the rank.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.bpe import Encoder, broadcast_automaton
from scriptloom.llm.store import id_text, named, stored, strings

# Pieces that one window partition ranks, about. Salts split a length that many pieces share.
RANKED_TOGETHER = 50_000

PLAN_SCHEMA = (
    "length bigint, first_rank bigint, end_rank bigint, first_sequence bigint, per_sequence bigint, first_offset bigint"
)


def token_pieces(
    documents: DataFrame,
    path: str,
    size: int = 2048,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pieces of at most ``size`` ids: id, piece, start, length, ids (little-endian 32-bit numbers).

    Every document ends with ``end_id``, so a NULL or empty text gives one piece of length 1.
    """
    tables = broadcast_automaton(documents.sparkSession, path)
    end = end_id.to_bytes(4, "little")

    def cut(batches):
        encoder = Encoder(tables.value)
        for batch in batches:
            row, piece, start, length, ids = [], [], [], [], []
            for i, whole in enumerate(encoder.ids(strings(batch))):
                whole += end
                for k, at in enumerate(range(0, len(whole), 4 * size)):
                    part = whole[at : at + 4 * size]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    ids.append(part)
                if len(ids) > 4096:
                    yield _rows(batch, row, piece, start, length, ids)
                    row, piece, start, length, ids = [], [], [], [], []
            if ids:
                yield _rows(batch, row, piece, start, length, ids)

    source = id_text(documents, id_column, text_column)
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(cut, f"id {kind}, piece int, start bigint, length bigint, ids binary")


def _rows(batch, row, piece, start, length, ids) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            batch.column("id").take(pa.array(row, pa.int64())),
            pa.array(piece, pa.int32()),
            pa.array(start, pa.int64()),
            pa.array(length, pa.int64()),
            pa.array(ids, pa.large_binary()).cast(pa.binary()),
        ],
        ["id", "piece", "start", "length", "ids"],
    )


def plan_best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts; rows of PLAN_SCHEMA.

    Sequences of equal room are kept as runs of consecutive numbers. An item goes where the least
    room is left over; as the tightest sequence gets tighter, it takes all it can of one length
    before the next one does, so a whole run is filled at once.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, sequences)
    opened = 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left, rank = counts[length], 0
        made: list[tuple[int, tuple[int, int]]] = []

        def fill(first: int, many: int, room: int) -> None:
            nonlocal left, rank
            per = min(room // length, left)
            whole = min(many, left // per)
            plan.append((length, rank, rank + whole * per, first, per, size - room))
            made.append((room - per * length, (first, whole)))
            rank, left = rank + whole * per, left - whole * per
            if left and whole < many:  # fewer than ``per`` are left: one more sequence takes them
                plan.append((length, rank, rank + left, first + whole, left, size - room))
                made.append((room - left * length, (first + whole, 1)))
                whole, rank, left = whole + 1, rank + left, 0
            if whole < many:
                made.append((room, (first + whole, many - whole)))

        rooms = [r for r in runs if r >= length]
        heapq.heapify(rooms)
        while left and rooms:
            room = heapq.heappop(rooms)
            for first, many in runs.pop(room):
                if left:
                    fill(first, many, room)
                else:
                    made.append((room, (first, many)))
        if left:
            many = -(-left // (size // length))
            fill(opened, many, size)
            opened += many
        for room, run in made:
            if room:
                runs.setdefault(room, []).append(run)
    return plan


def pack(pieces: DataFrame, size: int = 2048, key_columns: tuple[str, ...] = ("id", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces with a ``length`` (1 to ``size``).

    ``key_columns`` name a piece; equal rows are interchangeable and each gets a slot of its own.
    An empty table gives an empty one. Lengths outside the range raise an error. Columns may have
    any names; those called like the two that are added are replaced.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(n is None or not 1 <= n <= size for n in counts):
        raise ValueError(f"lengths must be 1 to {size}")
    # At most a few rows for each length: bounded by ``size``, not by the corpus.
    plan = spark.createDataFrame(plan_best_fit(counts, size), PLAN_SCHEMA)
    salts = -(-sum(counts.values()) // RANKED_TOGETHER) + 15
    carried = [named(c) for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    keys = F.struct(*[named(c) for c in key_columns])
    salted = pieces.select(
        F.struct(*carried).alias("piece"),
        named("length").alias("length"),
        keys.alias("keys"),
        F.pmod(F.xxhash64(keys), F.lit(salts)).alias("salt"),
    )
    local = Window.partitionBy("length", "salt").orderBy("keys")
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    offsets = offsets.select("length", "salt", before.alias("before"))
    ranked = salted.withColumn("local", F.row_number().over(local) - 1).join(offsets, ["length", "salt"])
    ranked = ranked.select("piece", "length", (F.col("before") + F.col("local")).alias("rank"))
    slots = F.broadcast(plan.withColumnRenamed("length", "of_length"))
    at = F.col("rank") - F.col("first_rank")
    met = (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))
    return ranked.join(slots, met).select(
        "piece.*",
        (F.col("first_sequence") + F.floor(at / F.col("per_sequence"))).alias("sequence_id"),
        (F.col("first_offset") + at % F.col("per_sequence") * F.col("length")).alias("offset"),
    )


def pack_documents(documents: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """All documents packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(documents, path, size, end_id)
    narrow = stored(pieces.select("id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    # Equal rows get different slots whatever their order, so a repeated id needs no tie-break.
    packed = pack(narrow, size, ("id", "piece", "start", "ids_crc32"))
    return packed.withColumnRenamed("id", "doc_id")
