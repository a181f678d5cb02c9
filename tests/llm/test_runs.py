"""Periodic runs against a word-by-word version of their definition."""

import hashlib
import random
import re
import zlib

import pytest

from scriptloom.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = (all(words[x] == words[x + d] for x in range(i, i + length - d)) for d in range(1, q))
            if j > i and length >= max(6, 4 * q) and not any(smaller):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, found):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]


def made_words(r):
    k, words = r.choice([1, 2, 3, 5, 20]), []
    size = r.choice([0, 5, 30, 80, 200])
    while len(words) < size:
        if r.random() < 0.5:
            words += [r.randrange(k) for _ in range(r.randint(1, 9))]
        else:
            base = [r.randrange(k) for _ in range(r.randint(1, r.choice([3, 9, 30])))]
            words += (base * 9)[: len(base) * r.randint(1, 8) + r.randint(0, 4)]
    return [b"w%d" % w for w in words]


@pytest.mark.parametrize("seed", range(10))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    lists = [made_words(r) for _ in range(80)]
    for words, (own, found) in zip(lists, runs.text_runs([b" ".join(w) for w in lists]), strict=True):
        assert own == words
        assert found == brute_runs(words)
        assert runs.collapsed(own, found) == brute_collapsed(words, found)


def brute_segments(words, times, least):
    todo, kept = [(0, len(words))], []
    while todo:
        a, b = todo.pop()
        rare = [i for i in range(a, b) if words[a:b].count(words[i]) < times]
        if rare:
            edges = [a - 1, *rare, b]
            todo += [(x + 1, y) for x, y in zip(edges[:-1], edges[1:], strict=True)]
        elif b - a >= least:
            kept.append((a, b))
    return sorted(kept)


@pytest.mark.parametrize("seed", range(60))
def test_segments_are_stable(seed):
    r = random.Random(seed)
    words = [r.randrange(r.choice([2, 6, 12])) for _ in range(r.choice([0, 5, 40, 150]))]
    assert runs.split_segments(words) == brute_segments(words, 4, 6)


def test_chain_of_rare_words_stays_fast():
    # Each split makes the next word rare: one word at a time comes off a large segment.
    n = 30_000
    words = [0] * 4
    for i in range(n):
        words += [i, i + 1, i + 1, i + 1]
    runs.split_segments(words)


def test_long_periods():
    r = random.Random(1)
    base = [b"x%d" % r.randrange(300) for _ in range(20_000)]
    ((_, found),) = runs.text_runs([b" ".join([b"a", b"b"] + base * 4 + base[:7] + [b"c"])])
    assert found == [(2, 80_007, 20_000)]
    ((_, found),) = runs.text_runs([b" ".join(base * 3)])  # three times is not enough
    assert found == []


def expected(rows):
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        ((own, found),) = runs.text_runs([" ".join(words).encode()])
        if n < 400:
            assert found == brute_runs(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        text = " ".join(brute_collapsed(words, found)) if found else " ".join(words)
        yield (
            doc_id,
            len(found),
            *(best if best else (None, None, None)),
            1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest(),
        )


def test_query(spark, docs, pairs):
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(expected(pairs(docs)))
    assert sum(r[1] > 0 for r in got) > 10


def test_hard_rows(spark, hard, none):
    found = {(r["id"], r["n_words"], len(r["runs"])) for r in runs.periodic_runs(hard).collect()}
    assert {(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 6, 0), (7, 12800, 1), (8, 1, 0)} <= found
    assert runs.periodic_runs(hard).count() == hard.count()
    assert runs.periodic_runs(none).count() == 0
    nulls = spark.createDataFrame([(None, "a a a a a a a"), (None, None)], "doc_id bigint, text string")
    rows = sorted((r["collapsed"], [tuple(x) for x in r["runs"]]) for r in runs.periodic_runs(nulls).collect())
    assert rows == [("", []), ("a", [(0, 7, 1)])]
