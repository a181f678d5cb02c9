"""Audit of how filters interact (operator 12).

Texts go through one table-driven byte transducer: a class for every byte, and for every state and
class an output with the events *code point*, *capital*, *symbol*, *word opens* and *word closes*.
The state behind a byte (inside or outside a word) follows from its class alone, so the states
before all bytes of a block of texts are one look-up, and the outputs another. The spans of words
go into an open-addressing hash table for the block; a word counts as seen only if its bytes equal
those of the span that holds the slot.

Failed filters are one bit each, so a part of the table is described by the number of rows of each
combination of bits. All orders of the filters are derived from those few numbers.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Mapping
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.store import mix, named, stored, strings, text_groups

OTHER, CAPITAL, SYMBOL, SPACE, FOLLOWING = range(5)  # classes of bytes
OUTSIDE, INSIDE = range(2)  # states
POINT, UPPER, SIGN, OPENS, CLOSES = (1 << i for i in range(5))  # events

SYMBOLS = "#$%&*|"
CHUNKED = 256  # longer words are hashed and compared as a whole


def byte_classes(symbols: str = SYMBOLS) -> np.ndarray:
    """The class of every byte of UTF-8; ``symbols`` are ASCII characters."""
    classes = np.full(256, OTHER, np.uint8)
    classes[ord("A") : ord("Z") + 1] = CAPITAL
    classes[list(symbols.encode("ascii"))] = SYMBOL
    classes[[0x20, *range(0x09, 0x0E)]] = SPACE
    classes[0x80:0xC0] = FOLLOWING
    return classes


#: State behind a byte of each class.
NEXT = np.array([INSIDE, INSIDE, INSIDE, OUTSIDE, INSIDE], np.uint8)


def transducer_outputs() -> np.ndarray:
    """Events by state and class."""
    out = np.zeros((2, 5), np.uint8)
    for state in (OUTSIDE, INSIDE):
        for cls in range(5):
            out[state, cls] = (
                (cls != FOLLOWING) * POINT
                | (cls == CAPITAL) * UPPER
                | (cls == SYMBOL) * SIGN
                | (state == OUTSIDE and cls != SPACE) * OPENS
                | (state == INSIDE and cls == SPACE) * CLOSES
            )
    return out


class SpanTable:
    """Distinct spans of a block of texts, per text, in an open-addressing table with linear probing."""

    def __init__(self, block: bytes, starts: np.ndarray, ends: np.ndarray, texts: np.ndarray):
        self.block, self.starts, self.texts = block, starts, texts
        self.sizes = ends - starts
        padded = np.frombuffer(block + bytes(8), np.uint8)
        self.eights = np.ndarray((len(block),), "<u8", padded, strides=(1,))  # the 8 bytes from each place on
        self.masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def _eight(self, spans: np.ndarray, k: int) -> np.ndarray:
        """The ``k``-th 8 bytes of spans, zeros behind their ends."""
        return self.eights[self.starts[spans] + 8 * k] & self.masks[np.minimum(self.sizes[spans] - 8 * k, 8)]

    def _hashes(self) -> np.ndarray:
        spans = np.arange(len(self.starts))
        self.first = self._eight(spans, 0)
        hashes = mix(self.first + np.uint64(0x9E3779B97F4A7C15) * self.texts.astype(np.uint64))
        k, spans = 1, np.flatnonzero((self.sizes > 8) & (self.sizes <= CHUNKED))
        while len(spans):
            hashes[spans] = mix(hashes[spans] * np.uint64(3) + self._eight(spans, k))
            k += 1
            spans = spans[self.sizes[spans] > 8 * k]
        for i in np.flatnonzero(self.sizes > CHUNKED).tolist():
            start = int(self.starts[i])
            hashes[i] ^= np.uint64(zlib.crc32(self.block[start : start + int(self.sizes[i])]))
        return hashes

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans are the same bytes of the same text, pair by pair."""
        same = (self.texts[a] == self.texts[b]) & (self.sizes[a] == self.sizes[b]) & (self.first[a] == self.first[b])
        sizes, k = self.sizes[a], 1
        at = np.flatnonzero(same & (sizes > 8) & (sizes <= CHUNKED))
        while len(at):
            alike = self._eight(a[at], k) == self._eight(b[at], k)
            same[at[~alike]] = False
            k += 1
            at = at[alike]
            at = at[sizes[at] > 8 * k]
        for i in np.flatnonzero(same & (sizes > CHUNKED)).tolist():
            size, x, y = int(sizes[i]), int(self.starts[a[i]]), int(self.starts[b[i]])
            same[i] = self.block[x : x + size] == self.block[y : y + size]
        return same

    def distinct(self) -> np.ndarray:
        """Spans that hold a slot: one for every distinct span of a text."""
        n = len(self.starts)
        slots = 1 << max(2 * n, 2).bit_length()
        holder = np.full(slots, -1, np.int64)
        waiting = np.arange(n)
        slot = (self._hashes() & np.uint64(slots - 1)).astype(np.int64)
        while len(waiting):
            at = slot[waiting]
            free = holder[at] < 0
            holder[at[free]] = waiting[free]
            met = holder[at]
            other = np.flatnonzero(met != waiting)
            other = other[~self._equal(waiting[other], met[other])]
            waiting = waiting[other]
            slot[waiting] = (slot[waiting] + 1) & (slots - 1)
        return holder[holder >= 0]


def count_block(texts: list[bytes], classes: np.ndarray, outputs: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of every text of a block: code points, capitals, symbols, words, distinct words."""
    block = b"\n".join(texts) + b"\n"  # white space between texts: each begins outside a word
    ends = np.cumsum([len(t) + 1 for t in texts])
    begins = np.append(0, ends[:-1])
    cls = classes[np.frombuffer(block, np.uint8)]
    state = np.empty_like(cls)
    state[0] = OUTSIDE
    state[1:] = NEXT[cls[:-1]]
    events = outputs.ravel()[state * np.uint8(5) + cls]

    def per_text(places: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(places, np.append(begins, len(block))))

    opens, closes = np.flatnonzero(events & OPENS), np.flatnonzero(events & CLOSES)
    n_words = per_text(opens)
    owner = np.repeat(np.arange(len(texts)), n_words)
    held = SpanTable(block, opens, closes, owner).distinct()
    return {
        "n_chars": np.add.reduceat(events & POINT, begins, dtype=np.int64) - 1,  # less the one behind it
        "n_capitals": per_text(np.flatnonzero(events & UPPER)),
        "n_symbols": per_text(np.flatnonzero(events & SIGN)),
        "n_words": n_words,
        "n_distinct_words": np.bincount(owner[held], minlength=len(texts)),
    }


COUNTS = ("n_chars", "n_capitals", "n_symbols", "n_words", "n_distinct_words")


def text_counts(
    documents: DataFrame,
    part_column: str = "lang",
    symbols: str = SYMBOLS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """id, part, digest (SHA-256 of the text) and COUNTS of every whole text, in one narrow pass.

    A NULL text is an empty one, a NULL part the empty string; rows and ids that repeat, and NULL
    ids, are kept one for one. Only the three named columns are read, so others cannot clash.
    """
    part = F.coalesce(named(part_column).cast("string"), F.lit("")).alias("part")
    source = documents.select(
        named(id_column).alias("id"), part, F.coalesce(named(text_column), F.lit("")).alias("text")
    )
    kind = source.schema["id"].dataType.simpleString()

    def count(batches):
        classes, outputs = byte_classes(symbols), transducer_outputs()
        for batch in batches:
            for begin, group in text_groups(strings(batch)):
                found = count_block(group, classes, outputs)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(begin, len(group)),
                        batch.column("part").slice(begin, len(group)),
                        pa.array([hashlib.sha256(t).digest() for t in group], pa.binary()),
                        *[pa.array(found[c], pa.int64()) for c in COUNTS],
                    ],
                    ["id", "part", "digest", *COUNTS],
                )

    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    return source.mapInArrow(count, f"id {kind}, part string, digest binary, {counts}")


def with_copies(counted: DataFrame) -> DataFrame:
    """Add ``is_copy``: the text is also that of a row with a smaller id, whichever part that is in.

    A NULL id is neither smaller nor larger, so its row is no copy and makes none. ``counted`` is
    read twice. Copies meet in a minimum that is taken before the shuffle, and the rows are joined
    on text and id together, so a text that a third of all rows share is dealt over all tasks.
    """
    first = counted.filter("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"))
    known = counted.filter("id IS NOT NULL").join(first.withColumn("is_first", F.lit(True)), ["digest", "id"], "left")
    copies = known.withColumn("is_copy", F.col("is_first").isNull()).drop("is_first")
    return copies.unionByName(counted.filter("id IS NULL").withColumn("is_copy", F.lit(False)))


def with_labels(rows: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Add ``good`` and ``toxic`` (0 or 1) from labels quality and toxic; 0 where there is none.

    Of several labels of one id, any 1 counts. NULL ids have no label.
    """
    of_id = (
        labels.filter(named(id_column).isNotNull())
        .groupBy(named(id_column).alias("id"))
        .agg(
            F.max((F.col("quality") == 1).cast("int")).alias("good"),
            F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
        )
    )
    known = rows.filter("id IS NOT NULL").join(of_id, "id", "left").fillna(0, ["good", "toxic"])
    return known.unionByName(
        rows.filter("id IS NULL").withColumn("good", F.lit(0)).withColumn("toxic", F.lit(0))
    )


def failure_counts(rows: DataFrame, filters: Mapping[str, Column]) -> DataFrame:
    """part, failed (bit i: fails the i-th filter), n, good, toxic: rows of each combination.

    A filter whose condition is NULL does not fail. At most 2 ** filters rows per part leave a task.
    """
    failed = F.lit(0)
    for i, fails in enumerate(filters.values()):
        failed = failed + F.when(fails, F.lit(1 << i)).otherwise(F.lit(0))
    return (
        rows.groupBy("part", failed.alias("failed"))
        .agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    )


def filter_interactions(combined: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, from ``failure_counts``.

    part, filter_order, step (from 1), kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley: the filter's removals summed over all orders. One grouping by part; the
    orders come from an array of each part's counts. Grows with the factorial of the filters, of
    which there are at most six; an empty table gives an empty one.
    """
    if not 1 <= len(letters) <= 6 or len(set(letters)) < len(letters):
        raise ValueError("one to six filters with different letters")
    sets = 1 << len(letters)

    def left_by(value: str) -> Column:
        """What no filter of a set removes, for every set by its bits."""
        return F.array(
            *[F.sum(F.when(F.col("failed").bitwiseAND(s) == 0, F.col(value)).otherwise(0)) for s in range(sets)]
        ).cast("array<bigint>")

    parts = combined.groupBy("part").agg(*[left_by(v).alias(v) for v in ("n", "good", "toxic")])

    def of(value: str, applied: Column | int) -> Column:
        return F.element_at(value, (F.lit(applied) if isinstance(applied, int) else applied) + 1)

    def shapley(i: int) -> Column:
        others = [j for j in range(len(letters)) if j != i]
        total = F.lit(0)
        for size in range(len(letters)):
            orders = factorial(size) * factorial(len(letters) - 1 - size)
            for before in combinations(others, size):
                bits = sum(1 << j for j in before)
                total = total + (of("n", bits) - of("n", bits | 1 << i)) * F.lit(orders)
        return total

    every = sets - 1
    per_filter = F.array(
        *[
            F.struct(
                F.lit(1 << i).alias("bit"),
                (of("n", 0) - of("n", 1 << i)).alias("fails"),
                (of("n", every ^ 1 << i) - of("n", every)).alias("unique_fails"),
                shapley(i).cast("bigint").alias("shapley"),
            )
            for i in range(len(letters))
        ]
    )
    orders = F.array(*[F.lit("".join(o)) for o in permutations(letters)])
    steps = (
        parts.withColumn("filters", per_filter)
        .withColumn("filter_order", F.explode(orders))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    )
    before = F.lit(0)
    for i, letter in enumerate(letters):
        at = F.instr("filter_order", letter)
        before = before + F.when(at < F.col("step"), F.lit(1 << i)).otherwise(F.lit(0))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    own = F.element_at("filters", F.instr(F.lit(letters), letter))
    steps = steps.withColumn("before", before).withColumn("own", own)
    after = F.col("before") + F.col("own.bit")
    removed = of("n", F.col("before")) - of("n", after)
    return steps.select(
        "part",
        "filter_order",
        "step",
        of("n", after).alias("kept"),
        removed.alias("removed"),
        (F.col("own.fails") - removed).alias("redundant"),
        F.col("own.unique_fails").alias("unique_fails"),
        (of("good", F.col("before")) - of("good", after)).alias("good_lost"),
        (of("toxic", F.col("before")) - of("toxic", after)).alias("toxic_lost"),
        F.col("own.shapley").alias("shapley"),
    )


def standard_filters() -> dict[str, Column]:
    """Failure conditions over the columns of ``text_counts`` and ``with_copies``."""
    return {
        "A": F.col("n_words") < 100,
        "B": 100 * F.col("n_distinct_words") < 80 * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > 10 * F.col("n_chars"),
        "D": F.col("n_symbols") > 0,
        "E": F.col("is_copy"),
    }


def audit_filters(documents: DataFrame, labels: DataFrame, part_column: str = "lang") -> DataFrame:
    """``filter_interactions`` of the standard filters over documents (doc_id, text, a part) and labels."""
    counted = stored(text_counts(documents, part_column), "audit-counts")
    rows = with_labels(with_copies(counted), labels)
    filters = standard_filters()
    return filter_interactions(failure_counts(rows, filters), "".join(filters))
