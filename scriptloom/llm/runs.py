"""Periodic runs of words (operator 13).

A run is a longest stretch of words with smallest period q that holds at least ``least_times``
periods and ``least_length`` words. Every word of it occurs at least ``least_times`` times in it,
so a word that is rarer within its segment cannot belong to one and splits the segment; the
pieces are counted anew until no word is rare. Only the larger part of a split inherits counts,
the smaller ones are counted, so every word is counted a logarithmic number of times.

Segments that survive are scanned by lag. Small lags compare the segment with itself. Lags from
2**k up to twice that look at blocks of 2**(k + 1) words from every 2**k-th word on: inside a run
the next place of such a block lies exactly one smallest period ahead. Blocks are numbered by
pairs of blocks of half their size, so equality is exact; blocks that occur once are left out of
all larger ones. What is found is extended word by word to its full length.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptloom.llm.store import id_text, strings, text_groups

SCANNED = 3  # lags up to this, one less than a power of two, are compared at every word


def split_segments(words: list[int], least_times: int = 4, least_length: int = 6) -> list[tuple[int, int]]:
    """Stretches [start, end) of at least ``least_length`` words in which no word is rare."""
    kept: list[tuple[int, int]] = []
    places: dict[int, list[int]] = {}
    counts = Counter(words)
    todo = [(0, len(words), counts, [w for w, n in counts.items() if n < least_times])]
    while todo:
        start, end, counts, rare = todo.pop()
        if not rare:
            if end - start >= least_length:
                kept.append((start, end))
            continue
        if end - start == len(words):
            cuts = [i for i, w in enumerate(words) if counts[w] < least_times]
        else:
            if not places:
                places = defaultdict(list)
                for i, w in enumerate(words):
                    places[w].append(i)
            cuts = sorted(
                i for w in rare for i in places[w][bisect_left(places[w], start) : bisect_left(places[w], end)]
            )
        pieces = [(a + 1, b) for a, b in pairwise([start - 1, *cuts, end]) if b - a > least_length]
        if not pieces:
            continue
        largest = max(pieces, key=lambda p: p[1] - p[0])
        inherits = 2 * (largest[1] - largest[0]) >= end - start
        for a, b in pieces:
            if not inherits or (a, b) != largest:
                own = Counter(words[a:b])
                todo.append((a, b, own, [w for w, n in own.items() if n < least_times]))
        if inherits:
            gone = Counter(words[start : largest[0]])
            gone.update(words[largest[1] : end])
            rare = []
            for w, n in gone.items():
                counts[w] -= n
                if not counts[w]:
                    del counts[w]
                elif counts[w] < least_times:
                    rare.append(w)
            todo.append((*largest, counts, rare))
    return sorted(kept)


def _first_difference(ids: np.ndarray, at: int, lag: int) -> int:
    """The first place from ``at`` on whose word differs from the one ``lag`` further, or has none there."""
    step = 64
    while at + lag < len(ids):
        part = min(step, len(ids) - lag - at)
        differs = ids[at : at + part] != ids[at + lag : at + lag + part]
        found = int(differs.argmax())
        if differs[found]:
            return at + found
        at, step = at + part, 2 * step
    return len(ids) - lag


def _last_difference(ids: np.ndarray, at: int, lag: int) -> int:
    """The last place before ``at`` whose word differs from the one ``lag`` further; -1 if none does."""
    step = 64
    while at > 0:
        part = min(step, at)
        differs = ids[at - part : at] != ids[at - part + lag : at + lag]
        found = int(differs[::-1].argmax())
        if differs[part - 1 - found]:
            return at - 1 - found
        at, step = at - part, 2 * step
    return -1


def lag_scan(ids: np.ndarray, least_times: int = 4, least_length: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs; equal numbers are equal words of one segment.

    ``least_times`` of 4 and more: the block of two to four periods that is looked for must lie in
    every run, whichever word it starts at.
    """
    if least_times < 4:
        raise ValueError("least_times must be at least 4")
    runs: list[tuple[int, int, int]] = []
    for lag in range(1, SCANNED + 1):
        if len(ids) < max(least_length, least_times * lag):
            return runs
        same = np.zeros(len(ids) - lag + 2, np.int8)
        same[1:-1] = ids[:-lag] == ids[lag:]
        edges = np.flatnonzero(np.diff(same))
        starts, lengths = edges[0::2], edges[1::2] - edges[0::2] + lag
        ok = lengths >= max(least_length, least_times * lag)
        if lag > 1:  # of 2 and 3 the only smaller period is 1
            ok[ok] = (ids[starts[ok, None] + np.arange(lag)] != ids[starts[ok], None]).any(1)
        runs += zip(starts[ok].tolist(), lengths[ok].tolist(), [lag] * int(ok.sum()), strict=True)
    rank = ids.astype(np.int64)  # number of the block from each place on, -1 if it occurs once
    block, lag = 1, 1
    while True:
        at = np.flatnonzero(rank[: max(len(ids) - block, 0)] >= 0)
        at = at[rank[at + block] >= 0]
        _, number, many = np.unique(rank[at] * np.int64(len(ids) + 1) + rank[at + block], return_inverse=True, return_counts=True)
        at, number = at[many[number] > 1], number[many[number] > 1]
        if not len(at):
            return runs
        rank = np.full(len(ids), -1, np.int64)
        rank[at] = number
        block *= 2
        if lag > SCANNED:
            order = np.argsort(number, kind="stable")
            ahead = np.zeros(len(at), np.int64)
            following = number[order[1:]] == number[order[:-1]]
            ahead[order[:-1][following]] = (at[order[1:]] - at[order[:-1]])[following]
            found = (at % lag == 0) & (ahead >= lag) & (ahead < 2 * lag)
            place, period = at[found], ahead[found]
            order = np.lexsort((place, period))
            place, period = place[order], period[order]
            # The block before, with the same period, lies in the same run.
            first = np.append(True, (np.diff(place) != lag) | (np.diff(period) != 0))[: len(place)]
            reach, reached = -1, 0
            for i, q in zip(place[first].tolist(), period[first].tolist(), strict=True):
                if q == reached and i < reach:
                    continue
                begin = _last_difference(ids, i, q) + 1
                reach, reached = _first_difference(ids, i + block, q), q
                if reach - begin + q >= max(least_length, least_times * q):
                    runs.append((begin, reach - begin + q, q))
        lag *= 2


def text_runs(texts: list[bytes], least_times: int = 4, least_length: int = 6):
    """For every text its words and its runs by start, then period."""
    words = [t.split() for t in texts]  # bytes are split at space and \t-\r only
    pieces, origin, owner, places = [], [0], [], []
    for i, own in enumerate(words):
        number: dict[bytes, int] = {}
        ids = [number.setdefault(w, len(number)) for w in own]
        for start, end in split_segments(ids, least_times, least_length):
            pieces.append(np.array(ids[start:end], np.int64) + (len(pieces) << 40))
            origin.append(origin[-1] + end - start)
            owner.append(i)
            places.append(start)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if pieces:
        # Numbers differ between segments, so no run crosses from one to the next.
        ids = np.unique(np.concatenate(pieces), return_inverse=True)[1]
        runs = lag_scan(ids, least_times, least_length)
        segment = (np.searchsorted(origin, [r[0] for r in runs], "right") - 1).tolist()
        for (start, length, period), s in zip(runs, segment, strict=True):
            found[owner[s]].append((start - origin[s] + places[s], length, period))
    for own, runs in zip(words, found, strict=True):
        yield own, sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()
    return [words[i] for i in kept]


def periodic_runs(
    documents: DataFrame,
    least_times: int = 4,
    least_length: int = 6,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """id, n_words, runs (array of start, length, period by start, then period), collapsed.

    ``collapsed`` holds the words, joined by one space, that no run holds behind its first period.
    Runs may overlap. One narrow pass over whole texts; NULL and empty texts have no words and no
    runs, repeated rows and ids stay repeated, a NULL id stays, other columns are dropped,
    whatever their names, and an empty table gives an empty one.
    """
    source = id_text(documents, id_column, text_column)
    kind = source.schema["id"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches):
        for batch in batches:
            for begin, group in text_groups(strings(batch)):
                counts, runs, texts = [], [], []
                for words, found in text_runs(group, least_times, least_length):
                    counts.append(len(words))
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    texts.append(b" ".join(collapsed(words, found)).decode())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(begin, len(group)),
                        pa.array(counts, pa.int64()),
                        pa.array(runs, pa.list_(run)),
                        pa.array(texts, pa.string()),
                    ],
                    ["id", "n_words", "runs", "collapsed"],
                )

    fields = "runs array<struct<start: bigint, length: bigint, period: bigint>>"
    return source.mapInArrow(find, f"id {kind}, n_words bigint, {fields}, collapsed string")
