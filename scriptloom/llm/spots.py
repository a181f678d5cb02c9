"""Document fingerprints by spot signatures (operator 10), with DataFrame functions only.

A spot is an anchor (one of a few very common words) that a content word follows, with the chain
of the next content words; common words between are skipped. A document's fingerprint is the set of
its hashed spots. Patterns repeat characters only, never groups: Java's matcher would recurse, and
a text of one common word repeated would exhaust its stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.functions.text import bind
from scriptloom.llm.store import id_text, stored

# Anchors, and the other common words that chains skip.
ANCHORS = (
    "the a is was be to of and der die das ist und ein zu le la les est un une et de que el los es y en"
).split()
SKIPPED = (
    "an are as at by for from he in it on or that this with den des im mit sich nicht von dem auf "
    "du au dans pour pas par sur ou qui avec il se por con una las del para"
).split()
CHAIN = 2  # content words in a spot

_MARK = "\ue000"  # stands for the blank behind an anchor
_SKIP = rf"(?<= )(?:{'|'.join(SKIPPED)}) "
_ANCHOR = rf"(?<= )({'|'.join(ANCHORS)}) "
# Common words that follow a content word, up to the next one.
_BETWEEN = rf" [\p{{L}}{_MARK}]*{_MARK}"
_SPOT = rf"(?<=[ {_MARK}])(?=(\p{{L}}++{_MARK}\p{{L}}++" + rf"(?: |{_BETWEEN})\p{{L}}++" * (CHAIN - 1) + " ))"


def plain(text: Column) -> Column:
    """Lower-cased words of letters, with one blank before, between and after them."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"\P{L}+", " ")


def spots(text: Column) -> Column:
    """Sorted distinct hashes of a text's spots.

    A text without a spot has one signature, the hash of the whole text, so that equal texts
    always have equal, non-empty fingerprints.
    """
    marked = F.regexp_replace(F.regexp_replace(plain(text), _SKIP, ""), _ANCHOR, f"$1{_MARK}")
    found = F.regexp_extract_all(marked, F.lit(_SPOT), F.lit(1))
    hashed = F.transform(found, lambda s: F.hash(F.regexp_replace(s, _BETWEEN, " ")))
    distinct = F.array_sort(F.array_distinct(hashed))
    whole = F.array(F.hash(F.lit("text"), text))
    return bind(distinct, lambda found: F.when(F.size(found) > 0, found).otherwise(whole))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.hex(x.cast("bigint").bitwiseAND(0xFFFFFFFF)))), " ")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two fingerprints; 0 where the set sizes alone keep it below ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(small < F.lit(least) * large, F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def fingerprints(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, spots of every whole text; NULL texts are empty, repeated rows stay repeated."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    return documents.select(F.col(f"`{id_column}`").alias("id"), spots(text).alias("spots"))


def with_next(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, text, spots, next_text, next_spots: each document with the next one in descending id; after
    the last, the first.

    Ids are whole numbers, however sparse: rows are range-partitioned by id and text, so that equal
    and NULL ids are split too, and the first document of every partition is also sent to the one
    before it. Repeated ids follow one another by the digests of their texts. NULL ids come last;
    NULL texts are empty; an empty table gives an empty one; further columns are left out.
    """
    rows = id_text(documents, id_column, text_column).withColumn("id", F.col("id").cast("bigint"))
    # Ascending in what follows: NULL ids last, ids from the largest (the complement reverses them).
    order = ["is_null", "turned", "digest"]
    rows = rows.withColumns(
        {"is_null": F.col("id").isNull(), "turned": F.bitwise_not("id"), "digest": F.sha2("text", 256)}
    )
    rows = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "spots-sorted")
    heads = rows.groupBy("part").agg(F.min(F.struct(*order)).alias("head"))
    # One row per partition: where its first document is sent, to the one before or from the first to the last.
    every_head = Window.orderBy("part")
    heads = heads.withColumn(
        "sent_to",
        F.coalesce(F.lag("part").over(every_head), F.max("part").over(every_head.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))),
    )
    heads = stored(heads, "spots-heads")
    # Equal rows may both be the first of a partition; one is sent.
    firsts = (
        rows.join(F.broadcast(heads), "part")
        .filter(F.struct(*[F.col(c) for c in order]).eqNullSafe(F.col("head")))
        .groupBy("sent_to")
        .agg(F.first("text").alias("text"))
        .select(
            F.lit(None).cast("bigint").alias("id"),
            "text",
            F.lit(None).cast("boolean").alias("is_null"),
            F.lit(None).cast("bigint").alias("turned"),
            F.lit(None).cast("string").alias("digest"),
            F.col("sent_to").alias("part"),
            F.lit(True).alias("sent"),
        )
    )
    every = rows.withColumn("sent", F.lit(False)).unionByName(firsts).withColumn("spots", spots(F.col("text")))
    window = Window.partitionBy("part").orderBy("sent", *order)
    return (
        every.withColumns(
            {"next_text": F.lead("text").over(window), "next_spots": F.lead("spots").over(window)}
        )
        .filter("NOT sent")
        .select("id", "text", "spots", "next_text", "next_spots")
    )


def spot_join(prints: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Pairs of different fingerprints with Jaccard >= threshold, and which documents have which.

    ``members``: id, class; ``pairs``: class_a, class_b, likeness, class_a < class_b. Classes are
    split by set length: a set meets sets of its own length band and the next. Within a band the
    rarest spots come first, and only the prefix that a similar set must share is joined on.
    """
    keyed = prints.withColumn("class", F.sha2(F.array_join("spots", ","), 256))
    members = keyed.select("id", "class")
    classes = keyed.groupBy("class").agg(F.first("spots").alias("spots"))
    exploded = classes.select("class", F.size("spots").alias("n"), F.explode("spots").alias("spot"))
    counts = exploded.groupBy("spot").agg(F.count("*").alias("held"))
    ranked = exploded.join(counts, "spot").withColumn(
        "rank", F.row_number().over(Window.partitionBy("class").orderBy("held", "spot"))
    )
    prefix = ranked.filter(F.col("rank") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + F.lit(1e-9))
    prefix = prefix.filter("held > 1").select("class", "spot", "n", band.alias("band"))
    left = prefix.select(F.col("class").alias("class_a"), "spot", F.col("n").alias("n_a"), F.col("band"))
    right = prefix.select(
        F.col("class").alias("class_b"), "spot", F.col("n").alias("n_b"), F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band")
    )
    met = left.join(right, ["spot", "band"]).filter(
        (F.col("class_a") != F.col("class_b")) & (F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b"))
    )
    met = met.select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b")).distinct()
    a = classes.select(F.col("class").alias("class_a"), F.col("spots").alias("spots_a"))
    b = classes.select(F.col("class").alias("class_b"), F.col("spots").alias("spots_b"))
    pairs = met.join(a, "class_a").join(b, "class_b").withColumn("likeness", likeness(F.col("spots_a"), F.col("spots_b"), threshold))
    return pairs.filter(F.col("likeness") >= threshold).select("class_a", "class_b", "likeness"), members
