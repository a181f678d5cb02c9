"""Tables on shared storage, plain columns, and hashes of words, shared by the operators here."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.session import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Spark's own option: the shuffle files of a query go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of the writes within go when each ends; for tables that are read from there on."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there, cutting its lineage.

    The folder is the one named by ``spark.checkpoint.dir``. Whatever is read twice, or must stay
    the same if an executor is lost, goes through here. Nobody reads the shuffles behind a written
    table again, so they are removed as soon as it is written.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove what ``stored`` wrote for these very tables; others are left alone.

    Only for tables that no later read needs: all that was computed from them is stored itself.
    """
    for df in tables:
        path = _WRITTEN.pop(df, None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def named(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_text(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only ``id`` and ``text`` (NULL becomes empty), so other columns' names cannot clash."""
    return df.select(
        named(id_column).alias("id"), F.coalesce(named(text_column), F.lit("")).alias("text")
    )


def strings(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


_M = np.uint64(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2**64
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        n = 1 << (n - 1).bit_length()
        for name, base in (("up", int(_M)), ("down", pow(int(_M), -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (finaliser of the public splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words (bytes other than space and \\t-\\r) of all texts, in order.

    Returns hashes, the number of words of each text, and the start and end of every word in the
    concatenation of the texts, each followed by one newline.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edges[0::2], edges[1::2]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    upto = np.searchsorted(starts, bounds, "left")
    return hashes, np.diff(upto, prepend=0), starts, ends


def text_groups(texts: list[str], limit: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as UTF-8 in groups of about ``limit`` bytes (memory bound only), with the first index."""
    begin, group, size = 0, [], 0
    for i, t in enumerate(texts):
        group.append(t.encode())
        size += len(group[-1])
        if size >= limit:
            yield begin, group
            begin, group, size = i + 1, [], 0
    if group:
        yield begin, group
