"""Chat formatting over a prefix tree (operator 1).

Conversations that share initial turns share those turns' text: equal conversations are one
path, paths are sorted by the hashes of their turns, and each path emits only the turns behind
the longest common prefix with its predecessor in that order. That is the depth-first order of
the tree, found with one range sort and no recursion. Lengths and positions count code points;
a tokenizer's counts can be put in the same place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.store import named, stored

# The template. A turn is OPEN role CLOSE text END; texts and roles are escaped so
# that neither < nor > occurs in them.
OPEN, CLOSE, END = "<turn ", ">", "</turn>\n"
ESCAPES = (("\\", "\\\\"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    """Undo ``escape``: pairs of backslashes are set aside first, as they are read from the left."""

    def restore(part: Column) -> Column:
        for plain, coded in ESCAPES[1:]:
            part = F.replace(part, F.lit(coded), F.lit(plain))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), restore), "\\")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(CLOSE), escape(text), F.lit(END))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""

    def turn(part: Column) -> Column:
        body = F.substring(part, F.lit(len(OPEN) + 1), F.length(part))
        return F.struct(
            unescape(F.substring_index(body, CLOSE, 1)).alias("role"),
            unescape(F.substring_index(body, CLOSE, -1)).alias("text"),
        )

    return F.transform(F.filter(F.split(formatted, END), lambda p: p != ""), turn)


def conversations_as_rows(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, turns array<struct<role, text>> in order of turn, role, text.

    A conversation becomes one text in the end, so it must fit one row. NULL roles and texts are
    empty; rows with a NULL id form one conversation; repeated turns are all kept.
    """
    item = F.struct(
        named(turn).alias("turn"),
        F.coalesce(named(role), F.lit("")).alias("role"),
        F.coalesce(named(text), F.lit("")).alias("text"),
    )
    rows = turns.select(named(conversation).alias("conv_id"), item.alias("item"))
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return gathered.select(
        "conv_id",
        F.transform("items", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"),
    )


def prefix_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments of the tree, and which path each conversation is.

    ``members``: conv_id, path. ``segments``, one per path and depth (from 1): path, depth, key
    (hash of the turns up to there), emitted (true for the one path that carries the segment's
    text), segment, n_chars, position (code points of the path before it: position ids run from
    here), stream_start (place in the depth-first stream of the whole forest, set on emitted ones).
    """
    hashed = conversations.select(
        "conv_id",
        F.transform("turns", lambda t: render(t["role"], t["text"])).alias("parts"),
    ).withColumn("path_key", F.transform("parts", lambda p: F.substring(F.sha2(p, 256), 1, 32)))
    hashed = stored(hashed.withColumn("path", F.sha2(F.concat_ws(",", "path_key"), 256)), "chat-paths")
    members = hashed.select("conv_id", "path")
    paths = hashed.groupBy("path").agg(F.first("parts").alias("parts"), F.first("path_key").alias("path_key"))
    # Range partitions of the sorted paths; the number is kept, so later reads agree with it.
    ranged = stored(
        paths.repartitionByRange("path_key", "path").withColumn("part", F.spark_partition_id()), "chat-sorted"
    )
    within = Window.partitionBy("part").orderBy("path_key", "path")
    # One row per range partition: the last path before it.
    last = ranged.groupBy("part").agg(F.max("path_key").alias("last_key"))
    before = last.select(
        "part", F.lag("last_key").over(Window.orderBy("part")).alias("key_before")
    )
    empty = F.array().cast("array<string>")
    compared = ranged.withColumn("_lag", F.lag("path_key").over(within)).join(F.broadcast(before), "part")
    compared = compared.withColumn("previous", F.coalesce("_lag", "key_before", empty))
    shared = F.aggregate(
        F.zip_with("path_key", "previous", lambda a, b: F.coalesce(a == b, F.lit(False))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, same: F.struct(
            (acc["n"] + F.when(acc["on"] & same, 1).otherwise(0)).alias("n"), (acc["on"] & same).alias("on")
        ),
        lambda acc: acc["n"],
    )
    lengths = F.transform("parts", lambda p: F.length(p).cast("bigint"))
    sized = compared.select("part", "path", "path_key", "parts", shared.alias("shared"), lengths.alias("lengths"))
    sized = sized.withColumn(
        "new_chars",
        F.aggregate(
            F.slice("lengths", F.col("shared") + 1, F.size("lengths")), F.lit(0).cast("bigint"), lambda a, x: a + x
        ),
    )
    sized = stored(sized, "chat-shared")
    totals = sized.groupBy("part").agg(F.sum("new_chars").alias("_chars"))
    before = totals.select(
        "part",
        F.coalesce(
            F.sum("_chars").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_base"),
    )
    running = F.sum("new_chars").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("new_chars")
    placed = sized.withColumn("_running", running).join(F.broadcast(before), "part")
    rows = placed.select(
        "path",
        "path_key",
        "shared",
        "lengths",
        (F.col("_base") + F.col("_running")).alias("stream_base"),
        F.posexplode("parts").alias("at", "segment"),
    )

    def chars(start, length):
        return F.aggregate(F.slice("lengths", start, length), F.lit(0).cast("bigint"), lambda a, x: a + x)

    emitted = F.col("at") >= F.col("shared")
    segments = rows.select(
        "path",
        (F.col("at") + 1).alias("depth"),
        F.sha2(F.concat_ws(",", F.slice("path_key", F.lit(1), F.col("at") + 1)), 256).alias("key"),
        emitted.alias("emitted"),
        F.when(emitted, F.col("segment")).alias("segment"),
        F.length("segment").cast("bigint").alias("n_chars"),
        chars(F.lit(1), F.col("at")).alias("position"),
        F.when(
            emitted,
            F.col("stream_base") + chars(F.col("shared") + 1, F.greatest(F.col("at") - F.col("shared"), F.lit(0))),
        ).alias("stream_start"),
    )
    return segments, members


def masked(formatted: Column, loss: Column) -> Column:
    """The texts under a loss mask, unescaped, in order, nothing between."""
    return F.array_join(
        F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), ""
    )


def format_conversations(conversations: DataFrame, learned: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """The depth-first stream and, read back from it, every path.

    ``stream``: key, stream_start, segment, n_chars, position, loss_start, loss_end (the code points
    of the stream that are learned, NULL for turns of other roles); every shared turn once.
    ``paths``: path, formatted, loss array<struct<start, end>> (the loss mask: code points of
    ``formatted`` that hold the texts of the role ``learned``, as escaped), intervals
    array<struct<start, end>> (the stretches of the stream that the path's last segment may attend
    to: its ancestors and itself, touching ones merged). An empty table gives empty ones.
    """
    head = OPEN + learned.replace("\\", "\\\\").replace("<", "\\l").replace(">", "\\g") + CLOSE

    def is_learned(segment: Column) -> Column:
        return F.startswith(segment, F.lit(head))

    def loss_of(start: Column, n_chars: Column) -> tuple[Column, Column]:
        """Where the text of a learned turn lies that begins at ``start``."""
        return (start + len(head)).cast("int"), (start + n_chars - len(END)).cast("int")

    segments, members = prefix_tree(conversations)
    segments = stored(segments, "chat-segments")
    stream = segments.filter("emitted").select("key", "stream_start", "segment", "n_chars", "position")
    learns = is_learned(F.col("segment"))
    stream = stream.select(
        "*",
        F.when(learns, F.col("stream_start") + len(head)).alias("loss_start"),
        F.when(learns, F.col("stream_start") + F.col("n_chars") - len(END)).alias("loss_end"),
    )
    own = segments.filter("emitted").select("path", "depth", "segment", "stream_start", "n_chars", "position")
    # A first turn that many paths share is one row here against many there: adaptive execution
    # splits the many, and the text of the one is read for each conversation that has it.
    inherited = (
        segments.filter("NOT emitted")
        .select("path", "depth", "key", "position")
        .join(stream.select("key", "segment", "stream_start", "n_chars"), "key")
        .select("path", "depth", "segment", "stream_start", "n_chars", "position")
    )
    gathered = own.unionByName(inherited).groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("depth", "segment", "stream_start", "n_chars", "position"))).alias("run")
    )

    def span(turn: Column) -> Column:
        start, end = loss_of(turn["position"], turn["n_chars"])
        return F.struct(start.alias("start"), end.alias("end"))

    loss = F.transform(F.filter("run", lambda x: is_learned(x["segment"])), span)
    kind = "array<struct<start:bigint,end:bigint>>"
    intervals = F.aggregate(
        "run",
        F.array().cast(kind),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, F.lit(-1))["end"] == x["stream_start"]),
            F.concat(
                F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.element_at(acc, F.lit(-1))["start"].alias("start"),
                        (x["stream_start"] + x["n_chars"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(
            F.concat(
                acc,
                F.array(F.struct(x["stream_start"].alias("start"), (x["stream_start"] + x["n_chars"]).alias("end"))),
            )
        ),
    )
    paths = gathered.select(
        "path",
        F.array_join(F.transform("run", lambda x: x["segment"]), "").alias("formatted"),
        loss.alias("loss"),
        intervals.alias("intervals"),
    )
    return stream, members.join(paths, "path")
