"""Automaton BPE, packing and edit-aware counts against the tokenizers library."""

import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptloom.llm import bpe, edits, packing, queries


def encoded(tokenizer, texts):
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_automaton_equals_library_on_random_texts(path, tokenizer):
    encoder = bpe.Encoder(bpe.compile_automaton(path), lambda b: np.frombuffer(b, "<u4").tolist())
    r = random.Random(1)
    alphabets = ["ab", "aeinorst", "thein!?.12é '", "'Ssmtdrevl ", [chr(i) for i in range(28, 600)]]
    texts = ["".join(r.choice(a) for _ in range(r.randint(0, 50))) for a in alphabets for _ in range(400)]
    texts += ["a" * 3000, "=" * 500, "<|endoftext|>x<|startoftext|>y<|end"]
    mine = [[i for x in records for i in x] for records in encoder.records(texts)]
    assert mine == encoded(tokenizer, texts)


def test_encode_decode(docs, hard, none, path, tokenizer, pairs):
    for df in (docs, hard):
        rows = bpe.encode_decode(df, path).collect()
        texts = sorted(pairs(df))
        ids = encoded(tokenizer, [t for _, t in texts])
        expected = [
            (i, len(x), " ".join(map(str, x)), tokenizer.decode(x, skip_special_tokens=False))
            for (i, _), x in zip(texts, ids, strict=True)
        ]
        assert sorted(tuple(r) for r in rows) == sorted(expected)
    assert bpe.encode_decode(none, path).count() == 0


def check_sequences(rows, size):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return len(sequences)


def test_packing(docs, hard, path, tokenizer, pairs):
    for df, size in ((docs, 2048), (hard, 64)):
        rows = packing.pack_documents(df, path, size).collect()
        texts = pairs(df)
        expected = []
        for (i, _), ids in zip(texts, encoded(tokenizer, [t for _, t in texts]), strict=True):
            ids = [*ids, 0]
            for k, at in enumerate(range(0, len(ids), size)):
                part = ids[at : at + size]
                expected.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
        keys = ("doc_id", "piece", "start", "length", "ids_crc32")
        assert sorted(tuple(r[k] for k in keys) for r in rows) == sorted(expected)
        assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
        least = -(-sum(r["length"] for r in rows) // size)
        assert check_sequences(rows, size) <= least * 1.1 + 2


def test_packing_of_nothing(none, path):
    assert packing.pack_documents(none, path).count() == 0


def best_fit(lengths, size):
    """Best-fit decreasing, one item at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [i for i, room in enumerate(rooms) if room >= n]
        if fitting:
            rooms[min(fitting, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    size = r.choice([10, 37, 100])
    counts = {n: r.randint(0, 30) for n in r.sample(range(1, size + 1), r.randint(1, size))}
    plan = packing.plan_best_fit(counts, size)
    seen, rows = defaultdict(int), []
    for length, first, end, sequence, per, offset in plan:
        assert first == seen[length]
        seen[length] = end
        for k in range(end - first):
            rows.append({"sequence_id": sequence + k // per, "offset": offset + k % per * length, "length": length})
    assert {n: c for n, c in seen.items() if c} == {n: c for n, c in counts.items() if c}
    assert check_sequences(rows, size) == best_fit([n for n, c in counts.items() for _ in range(c)], size)


def test_edits_equal_counting_anew(docs, hard, none, path, tokenizer):
    n = F.length(F.coalesce("text", F.lit(""))).cast("bigint")
    made = F.array(
        F.struct((n / 4).cast("bigint").alias("start"), (n / 4 + 9).cast("bigint").alias("end"), F.lit("").alias("text")),
        F.struct((n / 2).cast("bigint").alias("start"), (n / 2).cast("bigint").alias("end"), F.lit("neẃ words'").alias("text")),
        F.struct(n.alias("start"), (n + 7).alias("end"), F.lit("s end").alias("text")),
        F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(1).cast("bigint").alias("end"), F.lit(None).cast("string").alias("text")),
    )
    for df in (docs, hard):
        trees = edits.build_trees(df, path).withColumn("edits", made)
        rows = edits.apply_edits(trees, path).collect()
        old = {}
        for r in df.collect():
            old.setdefault(r["doc_id"], []).append(r["text"] or "")
        for r in rows:
            assert r["n_tokens_edited"] == len(encoded(tokenizer, [r["edited"]])[0])
            assert r["n_chars_edited"] == len(r["edited"])
            texts = []
            for text in old[r["id"]]:
                size = len(text)
                for start, end, new in ((int(size / 4), int(size / 4 + 9), ""), (int(size / 2), int(size / 2), "neẃ words'"), (size, size + 7, "s end"), (0, 1, "")):
                    start = min(start, len(text))
                    end = max(start, min(end, len(text)))
                    text = text[:start] + new + text[end:]
                texts.append(text)
            assert r["edited"] in texts
            assert r["n_tokens"] in [len(x) for x in encoded(tokenizer, old[r["id"]])]
    long = edits.apply_edits(edits.build_trees(hard.filter("doc_id = 7"), path).withColumn("edits", made), path).first()
    assert long["n_chars_encoded"] < 120  # not the 50,000 code points of the text
    assert edits.apply_edits(edits.build_trees(none, path).withColumn("edits", made), path).count() == 0


def test_edits_encode_little_again(spark):
    counted = queries.op9_token_counts(spark, "/root/testdata/sf0.01").agg(
        F.sum("n_chars_encoded").alias("encoded"), F.sum("n_chars_edited").alias("edited")
    ).first()
    assert counted["encoded"] < 0.05 * counted["edited"]


def test_special_tokens_by_their_exact_string(path, tokenizer):
    auto = bpe.compile_automaton(path)
    texts = [
        "<|ENDOFTEXT|>", "<|EndOfText|> x <|endoftext|>", "a<|startoftext|>b<|STARTOFTEXT|>",
        "<|endoftext|><|ENDOFTEXT|> <|endoftext|>", "y" * 70 + " <|endoftext|> " + "y" * 70, "<|endoftext|", "<|endoftext|>",
    ]
    texts += ["".join(c.upper() if k >> i & 1 else c for i, c in enumerate("<|endoftext|>")) for k in range(1 << 13)][::97]
    got = bpe.Encoder(auto, lambda ids: np.frombuffer(ids, "<u4").tolist()).records(texts)
    assert [[i for r in records for i in r] for records in got] == encoded(tokenizer, texts)


def test_long_texts_without_white_space(path, tokenizer):
    r = random.Random(4)
    auto = bpe.compile_automaton(path)
    texts = ["x" * 5000, "".join(r.choice("abcdefghij") for _ in range(100_000)), "é漢" * 3000, "a1" * 3000]
    texts.append("".join(r.choice("theandof") for _ in range(1_000_000)))
    begin = time.time()
    got = [[i for x in records for i in x] for records in bpe.Encoder(auto, lambda ids: np.frombuffer(ids, "<u4").tolist()).records(texts)]
    assert time.time() - begin < 60
    assert got == encoded(tokenizer, texts)


def test_driver_keeps_the_automaton_compressed(spark, path):
    """Its tables are compiled by a task and opened by the workers; the driver holds a few MB."""
    sent = bpe.broadcast_automaton(spark, path)
    held = bpe._AUTOMATA[path]
    assert not isinstance(held, bpe.Automaton) and len(held.data) < 8_000_000

    def names(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"kind": [type(sent.value).__name__], "labels": [len(sent.value.labels)]})

    [row] = spark.range(1).coalesce(1).mapInArrow(names, "kind string, labels bigint").collect()
    assert row["kind"] == "Automaton" and row["labels"] > 40_000


def test_ids_look_up_distinct_stretches_once(path, tokenizer, monkeypatch):
    """The work in Python follows the distinct stretches of a group of texts, not all their words."""

    class Counted(dict):
        asked = 0

        def get(self, *args):
            Counted.asked += 1
            return super().get(*args)

    r = random.Random(7)
    words = ["".join(r.choice("aeinorst'é漢.,!?3") for _ in range(r.randint(1, 9))) for _ in range(300)]
    words += ["<|endoftext|>", "<|ENDOFTEXT|>", "İΣ", "x" * 200, "\x1c", "ÿ"]
    spaces = [" ", "\n", "\x85", "\u2003", "\u2000", "\u3000 ", "\t\r"]
    texts = ["".join(r.choice(words) + r.choice(spaces) for _ in range(700)) for _ in range(60)] + ["", " ", "\x85"]
    encoder = bpe.Encoder(bpe.compile_automaton(path))
    encoder.row_of = Counted(encoder.row_of)
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.ids(texts)]
    assert got == encoded(tokenizer, texts)
    assert Counted.asked < 1000  # of 42,000 words
    assert list(encoder.ids(["", " "])) == [b"", b""] and list(encoder.ids([])) == []
    # The same with hardly any room: groups of one text, everything forgotten before each.
    for name, value in (("GROUP_CHARS", 1), ("CACHED_WORDS", 1), ("DENSE_WORDS", 7), ("CACHED_CHARS", 3)):
        monkeypatch.setattr(bpe, name, value)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.ids(texts[-20:])] == got[-20:]
    assert [b"".join(x) for x in encoder.records(texts[-20:])] == list(encoder.ids(texts[-20:]))
