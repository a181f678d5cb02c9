"""Repeated byte strings across documents (operator 8).

A string of ``length`` bytes is repeated if it starts at two places. Every such window has an
anchor: the leftmost of its ``GRAM``-byte strings with the smallest hash, so equal windows have
equal anchors at equal places. Consecutive windows with one anchor form a run; a run that occurs
twice is repeated as a whole, which settles the inside of every repeat by a hash alone. The other
runs of a shared anchor go, as byte strings around it, through an enhanced suffix array of the
suffixes at the anchor: sorted right sides, common-prefix lengths, and a stack scan for the
common-prefix intervals; within an interval occurrences are told apart by their left extensions,
and those with a common one of enough length are a maximal repeat group.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.store import id_text, mix, named, powers, stored, strings, unused

LENGTH = 200
GRAM = 40
SLICE = 1 << 21  # window starts handled at once; a memory bound only
SEEN = 200_000  # texts a task remembers as sent, to send copies once; a memory bound only
# An anchor with more runs than this is compared window by window over all tasks instead of in one.
TOGETHER = 20_000
_INFO = "<?qq32s"


def anchored_runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Runs of windows of all texts: text, start, bytes, place of the anchor in it, anchor, run hash."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    grams = mix(data.astype(np.uint64) + np.uint64(1))
    done, pieces, left = 1, [], gram
    doubled = {1: grams}
    while done * 2 <= gram:
        g = doubled[done]
        doubled[done * 2] = g[:-done] * np.uint64(0x9E3779B97F4A7C15) + (g[done:] ^ (g[done:] >> np.uint64(29)))
        done *= 2
    while left:  # put the powers of two that make up ``gram`` side by side
        part = 1 << (left.bit_length() - 1)
        pieces.append((gram - left, doubled[part]))
        left -= part
    count = len(data) - gram + 1
    hashes = pieces[0][1][:count]
    for offset, p in pieces[1:]:
        hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + p[offset : offset + count]
    bits = np.uint64((1 << 23) - 1)
    assert len(data) <= int(bits)
    keys = (mix(hashes) & ~bits) | np.arange(count, dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    if have < width:
        keys = np.minimum(keys[: len(keys) - (width - have)], keys[width - have :])
    anchor = (keys & bits).astype(np.int64)  # of the window that starts here
    valid = np.zeros(len(anchor), bool)
    text_of = np.zeros(len(anchor), np.int32)
    for i, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
        if size >= length:
            valid[end - size : end - length + 1] = True
            text_of[end - size : end - length + 1] = i
    starts = np.flatnonzero(valid)
    a, t = anchor[starts], text_of[starts]
    new = np.append(True, (a[1:] != a[:-1]) | (t[1:] != t[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    begin, stop = starts[first], starts[last] + length
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    at = a[first]
    place = at - begin
    run = mix((sums[stop] - sums[begin]) * down[begin] + (stop - begin).astype(np.uint64) * np.uint64(512) + place.astype(np.uint64))
    text = t[first].astype(np.int64)
    return text, begin - (ends - sizes)[text], stop - begin, place, mix(hashes[at]), run


def pack_place(start, size, place):
    return (start << 18) | (size << 8) | place


def unpack_place(packed):
    return packed >> 18, (packed >> 8) & 1023, packed & 255


def _send(batches):
    """Runs of new texts, each (anchor, run) once a batch, and one row of information for each text."""
    seen: set[int] = set()
    for batch in batches:
        if len(seen) >= SEEN:
            seen = set()
        ids, owns = batch.column("id").to_pylist(), batch.column("own").to_pylist()
        texts = [t.encode() for t in strings(batch)]
        extra = [
            struct.pack(_INFO, i is not None, i or 0, len(t), hashlib.sha256(t).digest())
            for i, t in zip(ids, texts, strict=True)
        ]
        parts, of, base = [], [], []
        for text, own in zip(texts, owns, strict=True):
            if len(text) >= LENGTH and own not in seen:
                seen.add(own)
                for at in range(0, len(text) - LENGTH + 1, SLICE):
                    parts.append(text[at : at + SLICE + LENGTH - 1])
                    of.append(own)
                    base.append(at)
        rows, group, size, begin = [], [], 0, 0
        for i, part in enumerate(parts):
            group.append(part)
            size += len(part)
            if size >= SLICE or i == len(parts) - 1:
                text, start, many, place, anchor, run = anchored_runs(group)
                own = np.array(of[begin : i + 1], np.int64)[text]
                start = start + np.array(base[begin : i + 1], np.int64)[text]
                rows.append(np.stack([anchor.view(np.int64), run.view(np.int64), own, pack_place(start, many, place)]))
                group, size, begin = [], 0, i + 1
        found = np.concatenate([*rows, np.zeros((4, 0), np.int64)], 1)
        found = found[:, np.lexsort(found[1::-1])]
        new = np.append(True, (np.diff(found[:2], axis=1) != 0).any(0))[: found.shape[1]]
        first = np.flatnonzero(new)
        twice = np.diff(np.append(first, found.shape[1])) > 1
        # Runs that recur in this batch are settled here; one of them tells the other tasks.
        settled = np.repeat(twice, np.diff(np.append(first, found.shape[1])))
        inside = found[:, settled & ~new]
        sent = found[:, first]
        plain = [np.concatenate([sent[k], inside[2] if k < 2 else inside[k], owns]) for k in range(3)]
        place = np.concatenate([sent[3], inside[3], np.zeros(len(owns), np.int64)])
        kind = np.concatenate([twice.astype(np.int8), np.full(inside.shape[1], 2, np.int8), np.full(len(owns), 3, np.int8)])
        yield pa.RecordBatch.from_arrays(
            [
                *[pa.array(p.astype(np.int64)) for p in plain],
                pa.array(place),
                pa.array(kind),
                pa.array([None] * (len(place) - len(owns)) + extra, pa.binary()),
            ],
            ["anchor", "run", "own", "place", "kind", "extra"],
        )


def _classify(batches):
    """From rows sorted by anchor, run, own, place: repeated runs (kind 0), one row for each run of
    an anchor with several (kind 1 if the run is repeated, 2 if not), and information (kind 3)."""
    # Row whose run may go on in the next batch: anchor, run, own, place; whether it is known to be
    # repeated; whether its anchor had another run before; whether it was put out as repeated.
    held, known, before, told = np.zeros((4, 0), np.int64), False, False, False

    def out(repeated, several, kinds, info):
        unpacked = [struct.unpack(_INFO, x) for x in info[1]]
        n = repeated.shape[1] + several.shape[1]
        blank = [None] * n
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.zeros(repeated.shape[1], np.int8), kinds, np.full(len(unpacked), 3, np.int8)]).astype(np.int8)),
                pa.array(np.concatenate([repeated[0], several[0], np.zeros(len(unpacked), np.int64)])),
                pa.array(np.concatenate([repeated[2], several[2], info[0]]).astype(np.int64)),
                pa.array(np.concatenate([repeated[3], several[3], np.zeros(len(unpacked), np.int64)])),
                pa.array([*blank, *[u[1] if u[0] else None for u in unpacked]], pa.int64()),
                pa.array([*blank, *[u[2] for u in unpacked]], pa.int64()),
                pa.array([*blank, *[u[3] for u in unpacked]], pa.binary()),
            ],
            ["kind", "anchor", "own", "place", "id", "n_bytes", "digest"],
        )

    none = np.zeros((4, 0), np.int64)
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        rows = np.stack([batch.column(c).to_numpy() for c in ("anchor", "run", "own", "place")])
        is_info = kind == 3
        info = rows[2, is_info], batch.column("extra").filter(pa.array(is_info)).to_pylist()
        settled = rows[:, kind == 2]
        twice = np.append(np.full(held.shape[1], known), kind[kind < 2] == 1)
        rows = np.concatenate([held, rows[:, kind < 2]], 1)
        if not rows.shape[1]:
            yield out(settled, none, np.zeros(0, np.int8), info)
            continue
        carried = held.shape[1] > 0
        equal = np.append(False, (np.diff(rows, axis=1) == 0).all(0))  # the same row sent twice
        first = np.flatnonzero(np.append(True, (np.diff(rows[:2], axis=1) != 0).any(0)))
        bounds = np.append(first, rows.shape[1])
        several = np.add.reduceat((~equal).astype(np.int64), first) > 1
        repeated = several | np.logical_or.reduceat(twice, first)
        emit = np.repeat(repeated, np.diff(bounds)) & ~equal
        if carried and told:
            emit[0] = False
        anchors = rows[0, first]
        same = anchors[1:] == anchors[:-1]
        prior = np.append(before if carried else False, same)
        after = np.append(same, False)
        shown = (prior | after)[:-1]
        lead = first[:-1][shown]
        kinds = np.where(repeated[:-1][shown], 1, 2).astype(np.int8)
        yield out(np.concatenate([settled, rows[:, emit]], 1), rows[:, lead], kinds, info)
        at = first[-1]
        told = bool(repeated[-1])
        held, known, before = rows[:, at : at + 1], bool(repeated[-1]), bool(prior[-1])
    if held.shape[1] and before:
        yield out(none, held, np.array([1 if known else 2], np.int8), (np.zeros(0, np.int64), []))


def _contexts(batches):
    """Byte strings around anchors: what follows, and what precedes from right to left."""
    for batch in batches:
        columns = [[] for _ in range(6)]
        for text, own, runs in zip(strings(batch), batch.column("own").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            data = text.encode()
            for r in runs or []:
                start, size, place = unpack_place(r["place"])
                middle = start + place
                row = (r["anchor"], own, r["place"], r["kind"] == 1, data[middle : start + size], data[start:middle][::-1])
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "own", "place", "whole", "right", "left"]
        )


def _common(a: int, b: int, width: int, most: int) -> int:
    """Bytes that two strings, as numbers padded to ``width`` bytes, share at the front."""
    x = a ^ b
    return min(most, width - (x.bit_length() + 7) // 8) if x else most


def prefix_intervals(common: list[int], least: int):
    """Common-prefix intervals (length, first, last) of a sorted list, by a stack scan.

    ``common[i]`` is what entries i - 1 and i share (common[0] is unused). Inner ones come first.
    """
    stack: list[tuple[int, int]] = []
    for i in range(1, len(common) + 1):
        shared = common[i] if i < len(common) else -1
        begin = i - 1
        while stack and stack[-1][0] > shared:
            depth, begin = stack.pop()
            yield depth, begin, i - 1
        if shared >= least and (not stack or stack[-1][0] < shared):
            stack.append((shared, begin))


def maximal_repeats(rights: list[bytes], lefts: list[bytes], length: int = LENGTH):
    """Maximal repeat groups among strings around one anchor, ``rights`` sorted.

    Yields (bytes to the left, bytes to the right, members): each member has another with at least
    these in common; together they are ``length`` bytes or more. An interval whose occurrences have
    one and the same byte on the left is extended to where they differ.
    """
    if len(rights) < 2:
        return
    width = max(map(len, rights)) + 1
    numbers = [int.from_bytes(r + bytes(width - len(r)), "big") for r in rights]
    common = [0]
    for i in range(1, len(rights)):
        common.append(_common(numbers[i - 1], numbers[i], width, min(len(rights[i - 1]), len(rights[i]))))
    wide = max(map(len, lefts)) + 1
    back = [int.from_bytes(x + bytes(wide - len(x)), "big") for x in lefts]
    for depth, begin, end in prefix_intervals(common, length - wide + 1):
        need = max(0, length - depth)
        order = sorted((i for i in range(begin, end + 1) if len(lefts[i]) >= need), key=lefts.__getitem__)
        shared = [0]
        for a, b in zip(order[:-1], order[1:], strict=True):
            shared.append(_common(back[a], back[b], wide, min(len(lefts[a]), len(lefts[b]))))
        # Left extensions form intervals too: those that reach far enough are the repeat groups.
        for reach, low, high in prefix_intervals(shared, need) if need else [(0, 0, len(order) - 1)] * (len(order) > 1):
            yield reach, depth, order[low : high + 1]
        if not need:
            for reach, low, high in prefix_intervals(shared, 1):
                yield reach, depth, order[low : high + 1]


def _repeat_groups(batches):
    """Repeats of rows sorted by anchor and right side: own, begin, end of what a member repeats, and
    its longest maximal repeat group with the number of occurrences."""
    held: list[tuple] = []

    def groups(rows):
        begin = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i][0] != rows[begin][0]:
                yield rows[begin:i]
                begin = i

    def put(rows):
        columns = [[] for _ in range(5)]
        for group in groups(rows):
            # Every repeat around the anchor holds the anchor, so a member's repeats together are
            # one stretch; its row names the longest group.
            reach, best = {}, {}
            for number, (left, right, members) in enumerate(
                maximal_repeats([r[4] for r in group], [r[5] for r in group])
            ):
                for m in members:
                    low, high = reach.get(m, (0, 0))
                    reach[m] = max(low, left), max(high, right)
                    best[m] = max(best.get(m, (0, 0, 0)), (left + right, len(members), number))
            for m, (left, right) in reach.items():
                _, own, packed, whole, _, _ = group[m]
                if not whole:
                    start, _, place = unpack_place(packed)
                    middle, (_, many, number) = start + place, best[m]
                    row = (own, middle - left, middle + right, group[0][0] ^ (number << 8), many)
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["own", "begin", "end", "repeat_group", "occurrences"]
        )

    for batch in batches:
        rows = list(zip(*[batch.column(c).to_pylist() for c in ("anchor", "own", "place", "whole", "right", "left")], strict=True))
        rows = held + rows
        cut = len(rows)
        while cut and rows[cut - 1][0] == rows[-1][0]:
            cut -= 1
        held = rows[cut:]
        if cut:
            yield put(rows[:cut])
    if held:
        yield put(held)


def _windows(batches):
    """Every window of runs of a crowded anchor: its hash, own and begin; recurring ones once a batch."""
    for batch in batches:
        keys, owns, begins, wholes = [], [], [], []
        for own, packed, whole, right, left in zip(
            *[batch.column(c).to_pylist() for c in ("own", "place", "whole", "right", "left")], strict=True
        ):
            start, _, _ = unpack_place(packed)
            data = left[::-1] + right
            up, down = powers(len(data) + 1)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
            n = len(data) - LENGTH + 1
            keys.append(mix((sums[LENGTH:] - sums[:n]) * down[:n]))
            owns.append(np.full(n, own, np.int64))
            begins.append(start + np.arange(n, dtype=np.int64))
            wholes.append(np.full(n, whole))
        key = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
        own, begin = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (owns, begins))
        whole = np.concatenate([*wholes, np.zeros(0, bool)])
        order = np.argsort(key, kind="stable")
        key, own, begin, whole = key[order], own[order], begin[order], whole[order]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        first = np.flatnonzero(new)
        twice = np.diff(np.append(first, len(key))) > 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.where(new, key, own)),
                pa.array(own),
                pa.array(begin),
                pa.array(np.where(new, np.repeat(twice, np.diff(np.append(first, len(key)))) | whole, True)),
                pa.array(~new),
            ],
            ["window", "own", "begin", "twice", "settled"],
        )


def _cut(batches):
    """What is left of each text after its repeated stretches."""
    for batch in batches:
        columns = [[] for _ in range(3)]
        for text, runs, repeats in zip(
            strings(batch), batch.column("repeated").to_pylist(), batch.column("intervals").to_pylist(), strict=True
        ):
            data = text.encode()
            spans = [(s, s + n) for s, n, _ in map(unpack_place, runs or [])]
            spans += [(x["begin"], x["end"]) for x in repeats or []]
            kept, done, removed, many = [], 0, 0, 0
            end = -1
            for a, b in sorted(spans):
                if a > end:
                    kept.append(data[done:a])
                    many += 1
                    removed += b - a
                    end = b
                elif b > end:
                    removed += b - end
                    end = b
                done = end
            kept.append(data[done:])
            for c, v in zip(columns, (removed, many, b"".join(kept)), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("own"),
                pa.array(columns[0], pa.int64()),
                pa.array(columns[1], pa.int64()),
                pa.array(columns[2], pa.binary()),
                pa.array([k.decode("utf-8", "ignore") for k in columns[2]], pa.string()),
            ],
            ["own", "n_removed", "n_spans", "kept", "kept_text"],
        )


def find_repeats(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repeated strings of all texts, as ``info``, ``changed`` and ``groups``.

    ``info``: a row for each document with id, own (hash of its text), n_bytes, digest (SHA-256) and
    copies (documents of this text). ``changed``: own, n_removed, n_spans, kept (bytes left), kept_text of texts
    without copies that lose something; a text with copies loses all of it if it has 200 bytes.
    ``groups``: own, begin, end, repeat_group, occurrences: repeats beside whole runs, one row for
    each occurrence, with its longest maximal repeat group.
    NULL texts are empty. Ids are whole numbers; repeated and NULL ids keep their rows.
    """
    source = id_text(documents, id_column, text_column).withColumn("id", F.col("id").cast("bigint"))
    source = source.withColumn("own", F.xxhash64("text"))
    sent = source.mapInArrow(_send, "anchor bigint, run bigint, own bigint, place bigint, kind tinyint, extra binary")
    sorted_runs = sent.repartition("anchor").sortWithinPartitions("anchor", "run", "own", "place")
    kinds = "kind tinyint, anchor bigint, own bigint, place bigint, id bigint, n_bytes bigint, digest binary"
    found = stored(sorted_runs.mapInArrow(_classify, kinds), "repeats-runs")
    info = found.filter("kind = 3").select("id", "own", "n_bytes", "digest")
    classes = info.groupBy("own").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    runs = found.filter("kind < 3")
    per_text = runs.groupBy("own").agg(
        F.collect_set(F.when(F.col("kind") == 0, F.col("place"))).alias("repeated"),
        F.collect_set(F.when(F.col("kind") > 0, F.struct("anchor", "place", "kind"))).alias("runs"),
    )
    # One document stands for all of its text, so copies are not moved here.
    needed = per_text.join(classes, "own")
    texts = source.select("id", "text", F.col("own").alias("text_own"))
    held = stored(
        needed.join(texts, F.col("first_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("text_own")))
        .select("own", "text", "repeated", "runs", "copies")
        .dropDuplicates(["own"]),
        "repeats-texts",
    )
    around = "anchor bigint, own bigint, place bigint, whole boolean, right binary, left binary"
    contexts = held.filter(F.size("runs") > 0).select("own", "text", "runs").mapInArrow(_contexts, around)
    crowded = (
        runs.filter("kind > 0").groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > TOGETHER).select("anchor")
    )
    crowded = stored(crowded, "repeats-crowded")
    beside = contexts.join(crowded, "anchor", "left_anti")
    intervals = "own bigint, begin bigint, end bigint, repeat_group bigint, occurrences bigint"
    groups = stored(
        beside.repartition("anchor").sortWithinPartitions("anchor", "right").mapInArrow(_repeat_groups, intervals), "repeats-groups"
    )
    windows = contexts.join(crowded, "anchor", "left_semi").mapInArrow(
        _windows, "window bigint, own bigint, begin bigint, twice boolean, settled boolean"
    )
    windows = stored(windows, "repeats-windows")
    open_windows = windows.filter("NOT settled")
    counted = open_windows.groupBy("window").agg((F.max("twice") | (F.count("*") > 1)).alias("again")).filter("again")
    crowds = open_windows.join(counted, "window", "left_semi").unionByName(windows.filter("settled"))
    crowds = crowds.select("own", "begin", (F.col("begin") + LENGTH).alias("end"))
    spans = groups.select("own", "begin", "end").unionByName(crowds).distinct()
    per_own = spans.groupBy("own").agg(F.collect_list(F.struct("begin", "end")).alias("intervals"))
    alone = held.filter("copies = 1").select("own", "text", "repeated")
    joined = alone.join(per_own, "own", "left").filter((F.size("repeated") > 0) | F.col("intervals").isNotNull())
    changed = joined.mapInArrow(_cut, "own bigint, n_removed bigint, n_spans bigint, kept binary, kept_text string")
    return info.join(classes.select("own", "copies"), "own"), changed, groups


def remove_repeats(documents: DataFrame) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 for every document (see ``find_repeats``)."""
    info, changed, _ = find_repeats(documents)
    cut = changed.select("own", "n_removed", "n_spans", F.sha2("kept", 256).alias("cut_sha256"))
    rows = info.join(cut, "own", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return rows.select(
        "id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


def without_repeats(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str = "n_chars"
) -> DataFrame:
    """The same rows and columns without their repeated strings; ``length_column``, if it is there,
    follows the text. Bytes of a code point that lost others go too; NULL texts stay NULL. Rows of
    repeated ids are each cut by their own text, other columns may have any names, and an empty
    table gives an empty one."""
    own, gone_own, kept_text = (unused(documents, n) for n in ("own_hash", "gone_hash", "kept_text"))
    with_id = documents.withColumn(own, F.xxhash64(F.coalesce(named(text_column), F.lit(""))))
    info, changed, _ = find_repeats(documents, id_column, text_column)
    gone = info.filter((F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)).select("own").distinct()
    effects = changed.select("own", "kept_text").unionByName(gone.select("own", F.lit("").alias("kept_text")))
    effects = effects.select(F.col("own").alias(gone_own), F.col("kept_text").alias(kept_text))
    joined = with_id.join(effects, F.col(own) == F.col(gone_own), "left")
    text = F.when(named(text_column).isNotNull(), F.coalesce(F.col(kept_text), named(text_column)))
    out = joined.withColumn(text_column, text)
    if length_column in documents.columns:
        kind = documents.schema[length_column].dataType
        out = out.withColumn(length_column, F.length(named(text_column)).cast(kind))
    return out.select(*[named(c) for c in documents.columns])
