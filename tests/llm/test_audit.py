"""Counts of the transducer and the audit of filters against plain versions."""

import random
import re
from itertools import permutations

import pytest

from checks.compare import compare, connect
from scriptloom.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text)
    capitals = sum("A" <= c <= "Z" for c in text)
    return len(text), capitals, sum(c in audit.SYMBOLS for c in text), len(words), len(set(words))


@pytest.mark.parametrize("seed", range(5))
def test_counts(seed):
    r = random.Random(seed)
    letters = ["a", "b", "A", "Z", "é", "漢", "𝔘", " ", "\n", "\x0b", "\x1f", "　", "#", "|", "\x85", "\0"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 70))) for _ in range(1500)]
    long = "x" * 1000
    texts += ["", f"{long} {long} {long}y {long[:-1]}y {long}é", "abcdefgh abcdefghi abcdefghi abcdefghj abcdefgh"]
    found = audit.count_block([t.encode() for t in texts], audit.byte_classes(), audit.transducer_outputs())
    assert list(zip(*[found[c].tolist() for c in audit.COUNTS], strict=True)) == [plain_counts(t) for t in texts]


def test_spans_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(audit.SpanTable, "_hashes", lambda self: _same_hash(self))
    texts = [f"w{i} w{i % 3} " + "x" * 300 + f"{i % 2} " + "x" * 300 + "1" for i in range(20)]
    found = audit.count_block([t.encode() for t in texts], audit.byte_classes(), audit.transducer_outputs())
    assert found["n_distinct_words"].tolist() == [len(set(t.split())) for t in texts]


def _same_hash(table):
    import numpy as np

    table.first = table._eight(np.arange(len(table.starts)), 0)
    return np.zeros(len(table.starts), np.uint64)


def brute_audit(rows, labels):
    """``rows``: id, text, part; ``labels``: id to (good, toxic)."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    failing = []
    for i, text, part in rows:
        n, capitals, symbols, words, distinct = plain_counts(text or "")
        fails = {
            "A": words < 100,
            "B": 100 * distinct < 80 * words,
            "C": 100 * capitals > 10 * n,
            "D": symbols > 0,
            "E": i is not None and i > least[text or ""],
        }
        failing.append((part or "", {k for k, x in fails.items() if x}, *labels.get(i, (0, 0))))
    out = []
    for part in {p for p, *_ in failing}:
        own = [x for x in failing if x[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        walked = []
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [x for x in own if letter in x[1] and not x[1] & before]
                removed_by[letter] += len(here)
                walked.append(
                    (
                        part,
                        "".join(order),
                        step,
                        sum(not x[1] & (before | {letter}) for x in own),
                        len(here),
                        sum(letter in x[1] and bool(x[1] & before) for x in own),
                        sum(x[1] == {letter} for x in own),
                        sum(x[2] for x in here),
                        sum(x[3] for x in here),
                    )
                )
        out += [(*w, removed_by[w[1][w[2] - 1]]) for w in walked]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    r = random.Random(5)
    vocabulary = ["word", "Word", "CAPS", "a|b", "x", "yy", "漢字"] + [f"v{i}" for i in range(400)]
    texts = [" ".join(r.choice(vocabulary[: r.choice([5, 407])]) for _ in range(r.choice([3, 99, 100, 160]))) for _ in range(60)]
    rows = [(i, r.choice([*texts, None, ""]), r.choice(["aa", "bb", None, ""])) for i in range(300)]
    rows += rows[:40] + [(None, texts[0], "aa"), (None, None, None), (-5, texts[1], "cc"), (7, texts[2], "aa")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 0), (None, 1, 1), (999, 1, 1)]
    known = {}
    for i, good, toxic in labels:
        if i is not None:
            known[i] = tuple(max(a, b or 0) for a, b in zip(known.get(i, (0, 0)), (good, toxic), strict=True))
    documents = spark.createDataFrame([(*x, 1, "z") for x in rows], "doc_id bigint, text string, lang string, id int, failed string")
    labelled = spark.createDataFrame([(*x, 3) for x in labels], "doc_id bigint, quality int, toxic int, id int")
    got = [tuple(x) for x in audit.audit_filters(documents, labelled).collect()]
    assert sorted(got) == brute_audit(rows, known)
    assert audit.audit_filters(documents.limit(0), labelled).count() == 0
    assert audit.audit_filters(documents, labelled.limit(0)).count() == len(got)


def test_other_filters(spark):
    rows = spark.createDataFrame([("p", 1, 0, 0), ("p", 5, 1, 0), ("p", None, 0, 1)], "part string, x int, good int, toxic int")
    from pyspark.sql import functions as F

    counts = audit.failure_counts(rows, {"low": F.col("x") < 3, "odd": F.col("x") % 2 == 1})
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["shapley"]) for r in audit.filter_interactions(counts, "lo").collect()}
    assert got == {("lo", 1): (2, 1, 1), ("lo", 2): (1, 1, 3), ("ol", 1): (1, 2, 3), ("ol", 2): (1, 0, 1)}
    with pytest.raises(ValueError):
        audit.filter_interactions(counts, "ll")


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    equal, rows, _, _, difference = compare(spark, connect(sf), sf, "op12_filter_audit")
    assert equal and rows, difference


def test_hard_rows(hard, none):
    counts = {(r["id"], *(r[c] for c in audit.COUNTS)) for r in audit.text_counts(hard, "own").collect()}
    assert {(i, *plain_counts(t or "")) for i, t in [(r["doc_id"], r["text"]) for r in hard.collect()]} == counts
    assert audit.text_counts(none).count() == 0
