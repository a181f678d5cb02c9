"""PII, quality, language, chat and spot signatures against brute force."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from scriptloom.llm import chat, language, pii, quality, queries, spots

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_spans(text):
    digits = lambda s: [int(c) for c in s if c.isdigit()]

    def luhn(ds):
        return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(ds))) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_on_tricky_texts():
    texts = [
        "a@b a@b.c.d@e.f @x.y ..@..c.d a@@b.c.d x@y.z@w.v %+-@a-b.c-",
        "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256 001.2.3.0004 .1.2.3.4. 1..2.3.4 0000000255.1.1.1",
        "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111110 0 4111111111111111",
        "+1 (234) 567-8901 +12 +1234567 ++49 30 1234567 +1.2.3.4.5.6.7.8- +123456789012345678",
        "é+1 555 123 4567é x@é.com mail a.b+c@d.co.uk.",
        "@" * 50 + "a" * 50 + "@" * 5 + "a.b",
        "",
    ]
    for text in texts:
        assert list(pii.base_spans(text)) == plain_spans(text), text


def test_checksums_and_context():
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    kinds = {k for k, *_ in pii.find_spans("IBAN GB82 WEST 1234 5698 7654 32, call 555-123-4567")}
    assert kinds == {"iban", "phone"}
    assert not pii.find_spans("the numbers 555-123-4567 are no contact")
    assert pii.redacted("write a@b.com now") == "write [EMAIL] now"


def test_pii_query(spark, docs, hard, pairs):
    rows = {r["doc_id"]: r for r in queries.op5_pii(spark, "/root/testdata/sf0.001").collect()}
    for i, text in pairs(docs):
        base = plain_spans(text)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert rows[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        counts = Counter(k for k, *_ in base)
        assert [rows[i][f"n_{k}"] for k in pii.BASE] == [counts[k] for k in pii.BASE]
    assert pii.pii_spans(hard).count() == hard.count()
    redacted = pii.redact(hard)
    assert redacted.schema == hard.schema and redacted.count() == hard.count()


def plain_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_counts(docs, hard, none, pairs):
    for df in (docs, hard):
        rows = quality.quality(df).collect()
        found = sorted((r["id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
        assert found == sorted((i, *plain_counts(t)) for i, t in pairs(df))
    assert quality.quality(none).count() == 0


def test_label_model_learns_who_is_right():
    # Two rules agree with one another; the third votes good whatever comes.
    patterns = [((1, 1, 1), 500), ((-1, -1, 1), 350), ((1, 0, 1), 50), ((0, 0, 0), 5)]
    fitted = quality.fit_label_model(patterns)
    assert fitted[0] > 0.9 and fitted[1] < 0.3 and fitted[2] > 0.8


def test_quality_keeps_labelled_good(spark):
    rows = queries.op6_quality_rules(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    share = {r["quality"]: r["kept"] for r in rows.drop("quality").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.97 and share[0] < share[1]


def test_language_accuracy(spark, hard, none):
    sf = "/root/testdata/sf0.01"
    found = queries.op2_language_id(spark, sf).filter("held_out")
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    right = found.join(truth, "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert right[0] > 0.95 and right[1] < 0.02
    model = language.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = {(r["id"], r["lang_pred"] == "und") for r in language.identify(hard, model).collect()}
    assert {i for i, und in rows if und} == {1, 2, 3}
    assert all(0 <= r["score"] <= 1 for r in language.identify(hard, model).collect())
    assert language.identify(none, model).count() == 0
    untrained = language.fit(none)
    assert {r["lang_pred"] for r in language.identify(hard, untrained).collect()} == {"und"}


def chat_rows():
    system, first = "You <are> \\help\\\\ful", "the \\l same </turn>\n start"
    rows = []
    for c in range(30):
        turns = [("system", system), ("user", first), ("assistant", f"answer {c % 3} \\"), ("user", f"more {c % 7}"), ("assistant", f"<turn x>{c % 7}")]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(turns[: 2 + c % 4])]
    rows += [(50, 0, None, None), (50, 0, "user", "tie"), (50, 0, "user", "tie"), (51, None, "a>b", "x"), (None, 0, "user", "no id")]
    return rows


def chat_escaped(text):
    for plain, coded in chat.ESCAPES:
        text = text.replace(plain, coded)
    return text


def test_chat_round_trip_and_tree(spark):
    rows = chat_rows()
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("path", F.lit(1))
    stream, formatted = chat.format_conversations(chat.conversations_as_rows(df))
    stream, paths = stream.collect(), formatted.select("*", chat.parse(F.col("formatted")).alias("turns")).collect()
    expected = {}
    for c, t, r, x in sorted(rows, key=lambda v: (v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        expected.setdefault(c, []).append((r or "", x or ""))
    assert {p["conv_id"]: [tuple(t) for t in p["turns"]] for p in paths} == expected
    prefixes = {tuple(turns[:k]) for turns in expected.values() for k in range(1, len(turns) + 1)}
    assert len(stream) == len(prefixes)  # every shared turn once
    whole = "".join(s["segment"] for s in sorted(stream, key=lambda s: s["stream_start"]))
    assert [s["stream_start"] for s in sorted(stream, key=lambda s: s["stream_start"])][0] == 0
    assert len(whole) == max(s["stream_start"] + s["n_chars"] for s in stream)
    learned = formatted.select("conv_id", chat.masked(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    assert {p["conv_id"]: p["learned"] for p in learned} == {
        c: "".join(x for r, x in turns if r == "assistant") for c, turns in expected.items()
    }
    under = {whole[s["loss_start"] : s["loss_end"]] for s in stream if s["loss_start"] is not None}
    assert under == {chat_escaped(x) for turns in expected.values() for r, x in turns if r == "assistant"}
    for p in paths:  # what a path may attend to is exactly its own text
        assert "".join(whole[i["start"] : i["end"]] for i in p["intervals"]) == p["formatted"]
    assert chat.format_conversations(chat.conversations_as_rows(df.limit(0)))[1].count() == 0


def plain_spots(text):
    words = [w for w in re.findall(r"[^\W\d_]+", text.lower()) if w not in spots.SKIPPED]
    common = {*spots.ANCHORS}
    found = set()
    for i, w in enumerate(words[:-1]):
        if w in common and words[i + 1] not in common:
            chain = [x for x in words[i + 1 :] if x not in common][: spots.CHAIN]
            if len(chain) == spots.CHAIN:
                found.add((w, *chain))
    return found


def test_spots(spark, docs):
    rows = docs.select("doc_id", "text", F.size(spots.spots(F.col("text"))).alias("n")).collect()
    for r in rows:
        assert r["n"] == max(1, len(plain_spots(r["text"])))
    a, b = "The old man and the sea was a book of the year", "the old man and the sea was a film of the month"
    one = spark.createDataFrame([(a, b)], "a string, b string").select(spots.likeness(spots.spots(F.col("a")), spots.spots(F.col("b"))).alias("x")).first()
    p, q = plain_spots(a), plain_spots(b)
    assert abs(one["x"] - len(p & q) / len(p | q)) < 1e-9


def test_spots_of_one_word_repeated(spark):
    texts = ["the " * 30_000, "x the " * 20_000, "a b " * 20_000 + "c", "of " * 9_000 + "old man"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [len(r[0]) for r in df.select(spots.spots(F.col("t"))).collect()] == [1, 1, 2, 1]


def test_next_document_and_edits(spark, docs, pairs):
    rows = {r["doc_id"]: r for r in queries.op10_spot_signatures(spark, "/root/testdata/sf0.001").collect()}
    texts = sorted(pairs(docs), reverse=True)
    for k, (i, text) in enumerate(texts):
        following, half = texts[(k + 1) % len(texts)][1], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i]["n_chars"] == len(text)
        assert 0 <= rows[i]["near_next"] <= 1
    assert sum(r["near_edited"] > r["near_next"] for r in rows.values()) > 0.8 * len(rows)


def test_next_over_sparse_and_odd_ids(spark):
    ids = [5, -3, 4096 * 4096 * 3, 70_000, 70_001, 123_456_789_012, -9_000_000_000, 0]
    df = spark.createDataFrame([(i, f"t{i}", "x") for i in ids] + [(None, None, "x")], "doc_id bigint, text string, block string")
    rows = {r["id"]: r["next_text"] for r in spots.with_next(df).collect()}
    ordered = [*sorted(ids, reverse=True), None]
    for a, b in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        assert rows[a] == (f"t{b}" if b is not None else "")
    assert spots.with_next(df.limit(0)).count() == 0


def test_next_over_hashed_and_repeated_ids(spark):
    ids = [int.from_bytes(hashlib.sha256(b"%d" % i).digest()[:8], "big", signed=True) for i in range(600)] + [None] * 300 + [7] * 300
    texts = {i: f"text {i}" for i in range(len(ids))}
    df = spark.createDataFrame([(x, texts[i], "x") for i, x in enumerate(ids)], "n bigint, text string, part string")
    rows = spots.with_next(df.repartition(5), "n").collect()
    digest = lambda i: hashlib.sha256(texts[i].encode()).hexdigest()
    ordered = sorted(texts, key=lambda i: (ids[i] is None, -(ids[i] or 0), digest(i)))
    expected = {texts[a]: texts[b] for a, b in zip(ordered, [*ordered[1:], ordered[0]], strict=True)}
    assert len(rows) == len(ids) and {r["text"]: r["next_text"] for r in rows} == expected


def test_likeness_against_brute_force(spark, docs, pairs):
    rows = {r["doc_id"]: r for r in queries.op10_spot_signatures(spark, "/root/testdata/sf0.001").collect()}
    ordered = sorted(pairs(docs), reverse=True)
    prints, texts = {}, {}

    def jaccard(one, two):
        p, q = (plain_spots(t) or {("whole", t)} for t in (one, two))
        return len(p & q) / len(p | q)

    for k, (i, text) in enumerate(ordered):
        following, half = ordered[(k + 1) % len(ordered)][1], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert abs(rows[i]["near_edited"] - jaccard(text, edited)) < 1e-9
        assert abs(rows[i]["near_next"] - jaccard(text, following)) < 1e-9
        for shown, t in ((rows[i]["fingerprint"], text), (rows[i]["edited_fingerprint"], edited)):
            key = frozenset(plain_spots(t)) or t
            assert prints.setdefault(key, shown) == shown and texts.setdefault(shown, key) == key


def test_spot_join(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(f"the {w} {w}x" for w in words[k * 10 : k * 10 + 60]) for k in (0, 0, 1, 2, 20)]
    letters = str.maketrans("0123456789", "abcdefghij")
    df = spark.createDataFrame([(i, t.translate(letters)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    prints = spots.fingerprints(df)
    linked, members = spots.spot_join(prints, 0.6)
    classes = {r["id"]: r["class"] for r in members.collect()}
    assert classes[0] == classes[1] and len(set(classes.values())) == 4
    sets = {r["id"]: set(r["spots"]) for r in prints.collect()}
    expected = {
        frozenset((classes[a], classes[b]))
        for a in sets
        for b in sets
        if classes[a] != classes[b] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])
    }
    assert {frozenset((r["class_a"], r["class_b"])) for r in linked.collect()} == expected
