"""Exact top-k inner products by descending length (operator 11).

Vectors of whole numbers are dealt into blocks by descending length. Every query first meets the
longest vectors of all, which gives it a score that its answers must reach; by Cauchy-Schwarz a
block whose longest vector times the query's length stays below that score need not be visited,
and neither do the shorter blocks behind it. Within a block, vectors and queries are rotated by the
right singular vectors of the whole table, which gather the mass in the first components: the
partial sum over those, plus the product of the lengths of what is left, bounds the score, and only
pairs whose bound reaches the query's score so far are multiplied out, in whole numbers.

Bounds only skip work: they are kept on the safe side of rounding, and nothing is approximate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.store import named, stored

BLOCK_ROWS = 1 << 15  # vectors of a block, about; what a task holds
QUERY_ROWS = 1 << 15  # queries that visit a block in one task, about
SEEDS = 2048  # longest vectors that every query meets first
STEP_VECTORS, STEP_QUERIES = 2048, 256  # multiplied at once
ROUNDING = 1e-9  # of the product of two lengths, far above the rounding of 64-bit sums
_EXACT = 2.0**53  # sums of whole numbers below this are exact in 64-bit floating point
_LONGEST = 2.0**62  # squared length: scores stay within 64-bit whole numbers

VECTOR = "place bigint, id bigint, square double, numbers binary"


def whole_vectors(vectors: DataFrame, scale: float, id_column: str, vector_column: str) -> DataFrame:
    """id, square (squared length), numbers (32-bit, floor(scale * x)) of the vectors that take part."""
    source = vectors.select(
        named(id_column).cast("bigint").alias("id"), named(vector_column).cast("array<double>").alias("vector")
    ).filter("vector IS NOT NULL")

    def convert(batches):
        for batch in batches:
            column = batch.column("vector")
            sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            with np.errstate(all="ignore"):
                x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float) * scale)
                good = np.isfinite(x) & (np.abs(x) < 2.0**31)
                x[~good] = 0
            bad = np.append(0, np.cumsum(~good))
            rows, squares, numbers = [], [], []
            whole = x.astype("<i4")
            for i, (start, end) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
                square = float(x[start:end] @ x[start:end])
                if bad[end] == bad[start] and square < _LONGEST:
                    rows.append(i)
                    squares.append(square)
                    numbers.append(whole[start:end].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(squares, pa.float64()), pa.array(numbers, pa.binary())],
                ["id", "square", "numbers"],
            )

    return source.mapInArrow(convert, "id bigint, square double, numbers binary")


def _matrix(numbers: list[bytes], width: int) -> np.ndarray:
    """Rows of whole numbers as 64-bit floating point, zeros behind shorter ones."""
    if all(len(n) == 4 * width for n in numbers):
        return np.frombuffer(b"".join(numbers), "<i4").reshape(len(numbers), width).astype(float)
    out = np.zeros((len(numbers), width))
    for i, n in enumerate(numbers):
        out[i, : len(n) // 4] = np.frombuffer(n, "<i4")
    return out


def _floor(scores: np.ndarray) -> np.ndarray:
    """Scores as floating point numbers that are not above them."""
    x = scores.astype(float)
    return np.where(np.abs(x) < _EXACT, x, np.nextafter(x, -np.inf))


def _products(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of all rows, as 64-bit whole numbers; ``largest`` bounds them."""
    if largest < _EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def right_singular_vectors(vectors: DataFrame, width: int) -> np.ndarray:
    """Columns in order of descending singular value, from the sum of outer products of all rows.

    What reaches the driver is one matrix of ``width`` x ``width``, summed by Spark.
    """

    def outer(batches):
        total = np.zeros((width, width))
        for batch in batches:
            numbers = batch.column("numbers").to_pylist()
            for begin in range(0, len(numbers), STEP_VECTORS):
                x = _matrix(numbers[begin : begin + STEP_VECTORS], width)
                total += x.T @ x
        row, column = np.nonzero(np.triu(total))
        yield pa.RecordBatch.from_arrays(
            [pa.array(row, pa.int32()), pa.array(column, pa.int32()), pa.array(total[row, column])], ["i", "j", "s"]
        )

    sums = vectors.select("numbers").mapInArrow(outer, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    total = np.zeros((width, width))
    for r in sums.collect():
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = r["s"]
    return np.linalg.eigh(total)[1][:, ::-1]


class Searched:
    """A set of vectors by descending length, with their rotated components."""

    def __init__(self, ids, places, squares, numbers, width: int, rotation: np.ndarray):
        order = np.argsort(-squares, kind="stable")
        self.ids = np.ma.MaskedArray(ids.data[order], mask=np.ma.getmaskarray(ids)[order])  # masked where NULL
        self.places = places[order]
        self.lengths = np.sqrt(squares[order])
        self.x = _matrix([numbers[i] for i in order.tolist()], width)
        self.first = max(1, width // 4)  # components of the partial sums
        self.rotation = rotation
        self.head, self.rest = self.rotated(self.x)

    def rotated(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first components after rotation, and the length of the others."""
        r = x @ self.rotation
        return r[:, : self.first], np.sqrt((r[:, self.first :] ** 2).sum(1))

    def nearest(self, x: np.ndarray, lengths: np.ndarray, places: np.ndarray, least: np.ndarray, k: int):
        """Arrays query (row of ``x``), vector, score: the k best at or above ``least``, or all if fewer.

        ``least`` is a score that each query's answers must reach, minus infinity if unknown. A
        vector whose place is the query's own is no answer.
        """
        head, rest = self.rotated(x)
        least = least.copy()
        query, vector, score = (np.zeros(0, np.int64) for _ in range(3))
        for begin in range(0, len(self.x), STEP_VECTORS):
            part = slice(begin, begin + STEP_VECTORS)
            slack = ROUNDING * lengths * self.lengths[begin]
            going = np.flatnonzero(~(lengths * self.lengths[begin] + slack < least))
            if not len(going):
                break
            bound = head[going] @ self.head[part].T + np.outer(rest[going], self.rest[part])
            q, v = np.nonzero(~(bound + slack[going, None] < least[going, None]))
            largest = float(lengths[going].max(initial=0) * self.lengths[begin])
            if len(q) * 8 > bound.size:
                found = _products(x[going], self.x[part], largest)[q, v]
            else:
                found = np.zeros(len(q), np.int64)
                for at in range(0, len(q), 1 << 15):
                    some = slice(at, at + (1 << 15))
                    found[some] = np.einsum(
                        "ij,ij->i", x[going[q[some]]].astype(np.int64), self.x[begin + v[some]].astype(np.int64)
                    )
            q, v = going[q], v + begin
            kept = ~(found < least[q]) & (self.places[v] != places[q])
            query = np.append(query, q[kept])
            vector = np.append(vector, v[kept])
            score = np.append(score, found[kept])
            order = np.lexsort((self.places[vector], self.ids.data[vector], self.ids.mask[vector], -score, query))
            query, vector, score = query[order], vector[order], score[order]
            starts = np.searchsorted(query, np.arange(len(x)))
            rank = np.arange(len(query)) - starts[query]
            full = query[rank == k - 1]
            least[full] = _floor(score[rank == k - 1])
            query, vector, score = (a[rank < k] for a in (query, vector, score))
        return query, vector, score


def _masked(column) -> np.ma.MaskedArray:
    return np.ma.MaskedArray(column.fill_null(0).to_numpy(), mask=column.is_null().to_numpy(zero_copy_only=False))


def _arrays(batch: pa.RecordBatch):
    return (
        _masked(batch.column("id")),
        batch.column("place").to_numpy(),
        batch.column("square").to_numpy(),
        batch.column("numbers").to_pylist(),
    )


def top_inner_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: float = 256.0,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
    seeds: int = SEEDS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every row where ``is_query`` (of column ``id``) holds.

    Components become floor(scale * x); the score is their inner product, candidates are all rows
    but the query's own, the k best are returned (all if there are fewer), ties by smaller id, a
    NULL id last. Rows take no part whose vector is NULL or holds a NULL or non-finite component,
    or whose scaled squared length is 2**62 and more, as scores would not fit a bigint. A shorter
    vector counts as filled with zeros. Each row of a repeated id is a query and a candidate of
    its own. Other columns are not read; a table without vectors or queries gives no rows.

    Broadcast are ``seeds`` vectors, the rotation, and one number per block (8 bytes for
    ``block_rows`` vectors). Every task holds one block and streams its queries.
    """
    spark = vectors.sparkSession
    made = whole_vectors(vectors, scale, id_column, vector_column)
    # Places tell repeated rows apart; stored, so that they stay.
    made = stored(made.withColumn("place", F.monotonically_increasing_id()), "topk-vectors")
    size = made.agg(F.count("*").alias("n"), F.max(F.octet_length("numbers")).alias("bytes")).first()
    width = max((size["bytes"] or 0) // 4, 1)
    rotation = right_singular_vectors(made, width)
    longest = made.orderBy(F.desc("square"), "place").limit(seeds).collect()
    blocks = made.repartitionByRange(-(-max(size["n"], 1) // block_rows), F.desc("square"), "place")
    blocks = stored(blocks.withColumn("block", F.spark_partition_id()), "topk-blocks")
    tops = sorted((r["block"], r["square"]) for r in blocks.groupBy("block").agg(F.max("square").alias("square")).collect())
    at, of = np.array([b for b, _ in tops], np.int64), np.sqrt(np.array([s for _, s in tops], float))
    shared = spark.sparkContext.broadcast((rotation, [tuple(r[c] for c in ("id", "place", "square", "numbers")) for r in longest], at, of))

    def seed(batches):
        rotation, longest, at, of = shared.value
        ids = np.ma.MaskedArray([r[0] or 0 for r in longest], mask=[r[0] is None for r in longest], dtype=np.int64)
        places, squares = np.array([r[1] for r in longest], np.int64), np.array([r[2] for r in longest], float)
        first = Searched(ids, places, squares, [r[3] for r in longest], width, rotation)
        for batch in batches:
            _, own, squares, numbers = _arrays(batch)
            lengths = np.sqrt(squares)
            least = np.full(len(own), -np.inf)
            for begin in range(0, len(own), STEP_QUERIES):
                some = slice(begin, begin + STEP_QUERIES)
                x = _matrix(numbers[some], width)
                query, _, score = first.nearest(x, lengths[some], own[some], least[some], k)
                starts = np.searchsorted(query, np.arange(len(x)))
                reached = np.bincount(query, minlength=len(x)) == k
                least[np.flatnonzero(reached) + begin] = _floor(score[starts[reached] + k - 1])
            # Blocks follow one another by descending length: those before the first one out of reach.
            last = np.array(
                [int(at[n - 1]) if (n := int((~(s * of * (1 + ROUNDING) < t)).sum())) else -1 for s, t in zip(lengths, least, strict=True)],
                np.int32,
            )
            known = np.isfinite(least)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("place", "id", "square", "numbers")],
                    pa.array(np.where(known, least, 0).astype(np.int64), mask=~known),
                    pa.array(last),
                ],
                ["place", "id", "square", "numbers", "least", "last"],
            )

    asking = made.filter(is_query).select("place", "id", "square", "numbers")
    asking = stored(asking.mapInArrow(seed, f"{VECTOR}, least bigint, last int").filter("last >= 0"), "topk-queries")
    slices = -(-asking.count() // query_rows) or 1
    columns = ["place", "id", "square", "numbers"]
    queries = asking.select(
        F.explode(F.sequence(F.lit(0), "last")).alias("block"),
        F.pmod(F.xxhash64("place"), F.lit(slices)).cast("int").alias("slice"),
        F.lit(1).alias("kind"),
        *columns,
        "least",
    )
    candidates = blocks.select(
        "block",
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
        F.lit(0).alias("kind"),
        *columns,
        F.lit(None).cast("bigint").alias("least"),
    )

    def visit(batches):
        rotation = shared.value[0]
        cell, held, searched = None, [], None
        for batch in batches:
            cells = np.stack([batch.column(c).to_numpy() for c in ("block", "slice", "kind")])
            edges = [0, *(np.flatnonzero((np.diff(cells, axis=1) != 0).any(0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                here = tuple(cells[:2, start].tolist())
                if here != cell:
                    cell, held, searched = here, [], None
                ids, places, squares, numbers = _arrays(part)
                if cells[2, start] == 0:
                    held.append((ids, places, squares, numbers))
                    continue
                if searched is None and held:
                    searched = Searched(
                        np.ma.concatenate([h[0] for h in held]),
                        np.concatenate([h[1] for h in held]),
                        np.concatenate([h[2] for h in held]),
                        [n for h in held for n in h[3]],
                        width,
                        rotation,
                    )
                    held = []
                if searched is None:
                    continue
                least = part.column("least")
                floor = np.where(least.is_null(), -np.inf, _floor(least.fill_null(0).to_numpy()))
                for begin in range(0, len(places), STEP_QUERIES):
                    some = slice(begin, begin + STEP_QUERIES)
                    x = _matrix(numbers[some], width)
                    query, vector, score = searched.nearest(x, np.sqrt(squares[some]), places[some], floor[some], k)
                    asked = query + begin
                    found = searched.ids[vector]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(places[asked]),
                            pa.array(ids.data[asked], mask=np.ma.getmaskarray(ids)[asked]),
                            pa.array(found.data, pa.int64(), mask=np.ma.getmaskarray(found)),
                            pa.array(searched.places[vector]),
                            pa.array(score, pa.int64()),
                        ],
                        ["asked", "query_id", "vec_id", "place", "score"],
                    )

    met = candidates.unionByName(queries).repartition("block", "slice")
    met = met.sortWithinPartitions("block", "slice", "kind")
    found = met.mapInArrow(visit, "asked bigint, query_id bigint, vec_id bigint, place bigint, score bigint")
    best = Window.partitionBy("asked").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "place")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
