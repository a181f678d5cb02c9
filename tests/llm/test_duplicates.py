"""Near duplicates, repeated strings and the pipeline against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from scriptloom.llm import near, packing, repeats
from scriptloom.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(x), least[find(k)]) for k, (i, x) in enumerate(sets))


def near_rows(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 5, 6, 7, 9, 10, 12, 20, 60, 200, 600]))]
        for _ in range(10):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40) + 1)):
                at = r.randrange(len(words))
                words[at : at + r.randint(0, 1)] = [r.choice(vocabulary)] * r.randint(0, 1) or words[at : at + 1]
            rows.append((len(rows) * 7 - 50, " ".join(words)))
    common = " ".join(r.choice(vocabulary) for _ in range(60))
    rows += [(5000 + k, " ".join(r.choice(vocabulary) for _ in range(r.randint(20, 150))) + " " + common) for k in range(40)]
    return rows + [(9001, None), (9002, ""), (9003, " \n")]


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates(spark, seed):
    rows = near_rows(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = sorted(tuple(r) for r in near.near_duplicates(df).collect())
    assert found == components([(i, t or "") for i, t in rows])


def test_chains_of_drifting_texts(spark):
    """Links that join what is around different leaders."""
    r = random.Random(7)
    vocabulary, rows = [f"w{i}" for i in range(300)], []
    for _ in range(6):
        words = [r.choice(vocabulary) for _ in range(r.choice([40, 90, 150]))]
        for _ in range(30):
            rows.append((len(rows) * 3 + 1, " ".join(words)))
            for _ in range(r.randint(1, 2)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted(tuple(x) for x in near.near_duplicates(df).collect()) == components(rows)


def test_near_duplicates_of_hard_texts(hard, none, pairs):
    rows = near.near_duplicates(hard).collect()
    assert sorted(tuple(r) for r in rows) == components(pairs(hard))
    assert near.near_duplicates(none).count() == 0
    kept = near.one_of_each(hard)
    assert sorted(kept.columns) == sorted(hard.columns)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 8, 9]


def without(rows):
    data = [(i, t.encode()) for i, t in rows]
    seen = Counter(d[k : k + 200] for _, d in data for k in range(len(d) - 199))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(d)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeat_rows():
    r = random.Random(3)
    letters = "abcdefgh é\n"
    made = lambda n: "".join(r.choice(letters) for _ in range(n))
    passages = [made(r.randint(150, 900)) for _ in range(6)]
    rows = []
    for i in range(80):
        text = made(r.randint(0, 300))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            at = r.randrange(len(p))
            p = p[at : at + 500] if r.random() < 0.5 else p[:at] + "X" + p[at:]
            text += p + made(r.randint(0, 200))
        rows.append((i, text))
    rows += [(1001, ""), (1002, "a" * 700), (1003, "ab" * 300), (1004, "q" * 199), (1005, "q" * 200), (1006, "q" * 201)]
    rows += [(2000 + i, rows[i][1]) for i in range(10)]
    base = made(1500)
    for k in range(30):
        at = r.randrange(1500)
        rows.append((3000 + k, base[:at] + made(3) + base[at + 1 :]))
    return rows


@pytest.mark.parametrize("together", [20_000, 4])
def test_repeats(spark, monkeypatch, together):
    monkeypatch.setattr(repeats, "TOGETHER", together)
    rows = repeat_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted(tuple(r) for r in repeats.remove_repeats(df).collect()) == without(rows)


def test_repeats_of_hard_texts(hard, none, pairs):
    assert sorted(tuple(r) for r in repeats.remove_repeats(hard).collect()) == without(pairs(hard))
    assert repeats.remove_repeats(none).count() == 0
    cut = repeats.without_repeats(hard)
    assert cut.schema.names == hard.schema.names
    assert cut.filter("text IS NULL").count() == 1


def test_maximal_repeats_by_hand():
    rights = sorted([b"abcdef", b"abcdxy", b"abzz"])
    groups = list(repeats.maximal_repeats(rights, [b"321", b"32", b"9"], 5))
    assert (2, 4, [1, 0]) in groups or (2, 4, [0, 1]) in groups
    assert all(left + right >= 5 for left, right, _ in groups)


def test_intervals_of_a_suffix_array():
    found = sorted(repeats.prefix_intervals([0, 3, 1, 1, 0, 2], 1))
    assert found == [(1, 0, 3), (2, 4, 5), (3, 0, 1)]


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf).cache()
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= kept.count(), name
        kept = after
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert packed.select("doc_id").distinct().count() == kept.count()
    result = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, result.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(
        map(tuple, packed.select("doc_id", "piece", "length", "ids_crc32").collect())
    )


@pytest.mark.parametrize("name", ["op1_chat_format", "op4_ngram_jaccard"])
def test_sql(spark, name):
    from checks.compare import compare, connect

    sf = "/root/testdata/sf0.001"
    equal, rows, _, _, difference = compare(spark, connect(sf), sf, name)
    assert equal and rows, difference


def test_one_crowded_passage(spark, monkeypatch):
    """2,000 texts that share a passage and are no near copies: few of the two million pairs are verified."""
    r = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{r.randrange(5000)}" for _ in range(70)) + " " + passage) for i in range(2000)]
    rows += [(5000 + i, t + " x") for i, t in rows[:5]]
    verified = []
    plain = near._verified

    def watched(pairs, sets):
        verified.append(pairs.count())
        return plain(pairs, sets)

    monkeypatch.setattr(near, "_verified", watched)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {x["id"]: x["component_id"] for x in near.near_duplicates(df).collect()}
    assert found == {i: i - 5000 if i >= 5000 else i for i, _ in rows}
    assert sum(verified) < 20_000


CLASHING = (
    "kept_id copy kept_id_ own_hash gone_hash kept_text own id n key part salt rank length_ local before piece keys "
    "first_rank end_rank of_length _kept _copy _own"
).split()


def test_stages_with_clashing_columns(spark, docs):
    df = docs.select("doc_id", "text", "n_chars", *[(docs["doc_id"] + i).alias(c) for i, c in enumerate(CLASHING)])
    for stage in (near.one_of_each, repeats.without_repeats):
        out, plain = stage(df), stage(docs.select("doc_id", "text", "n_chars"))
        assert out.columns == df.columns
        rows = out.collect()
        assert sorted((x["doc_id"], x["text"] or "", x["n_chars"]) for x in rows) == sorted(
            (x["doc_id"], x["text"] or "", x["n_chars"]) for x in plain.collect()
        )
        assert all(x[c] == x["doc_id"] + i for x in rows for i, c in enumerate(CLASHING))
    pieces = df.selectExpr("*", "1 + doc_id % 7 AS length", "doc_id AS sequence_id")
    packed = packing.pack(pieces, 16, ("doc_id",)).collect()
    assert len({(x["sequence_id"], x["offset"]) for x in packed}) == pieces.count()
    assert all(x[c] == x["doc_id"] + i for x in packed for i, c in enumerate(CLASHING))


def test_components_take_few_jobs(spark):
    """A round's steps are stored each, and one aggregate tells whether anything changed."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a bigint, b bigint")
    tracker, group = spark.sparkContext.statusTracker(), "components-jobs"
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.sparkContext.setJobGroup(group, "components")
    spark.conf.set(threshold, "-1")
    try:
        found = connected_components(edges)
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set(threshold, before)
    stages = {s for j in jobs for s in j.stageIds}
    assert {(r["node"], r["component"]) for r in found.collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert len(stages) <= 220


def test_unwanted_texts_are_left_out_before_the_shuffle(spark):
    rows = spark.range(20_000).selectExpr("id", "'x' AS text").unionByName(spark.createDataFrame([(None, "n"), (-5, "m")], "id bigint, text string"))
    wanted = rows.filter("id % 50 = 3 OR id IS NULL OR id < 0").select("id")
    held = [r["id"] for r in near._may_hold(rows, wanted).select("id").collect()]
    assert set(held) >= {r["id"] for r in wanted.collect()}
    assert len(held) < 402 + 0.05 * 19_600
    assert near._may_hold(rows, wanted.limit(0)).count() == 0


def test_wide_parity_bits_keep_large_sets_apart(spark):
    """Sets of 3,000 that share 60 per cent are far apart: their own bits tell, 256 do not."""
    rng = np.random.default_rng(5)
    rows, sets = [], {}
    for k, (n, m, common) in enumerate([(3000, 3000, 2250), (3000, 3000, 2900), (2000, 2100, 1950), (40, 31, 30), (33, 32, 20), (5000, 900, 900)]):
        both = rng.integers(0, 1 << 63, common, np.uint64)
        for name, size in ((2 * k, n), (2 * k + 1, m)):
            sets[name] = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, size - common, np.uint64)]))
            rows.append((name, len(sets[name]), near.wide_parity(sets[name]).tolist()))
    table = spark.createDataFrame(rows, "own bigint, n bigint, flips array<bigint>")
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1, 0.01) for k in range(6)], "a bigint, b bigint, least double")
    found = {r["a"]: r["least"] for r in near._tightened(pairs, table).collect()}
    for a, least in found.items():
        distance = 1 - len(np.intersect1d(sets[a], sets[a + 1])) / len(np.union1d(sets[a], sets[a + 1]))
        assert 0.01 <= least <= distance + 1e-12
    assert len(found) == 6 and found[0] > 0.2 and found[4] > 0.01 and found[6] > 0.01
