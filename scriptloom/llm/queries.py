"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from scriptloom.functions.text import bind
from scriptloom.llm import audit, bpe, chat, edits, language, near, packing, pii, quality, repeats, runs, spots, topk
from scriptloom.llm.store import table

#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file; the installed package names it, else TOKENIZERS holds it."""
    try:
        from public_tokenizers import path
    except ImportError:
        return os.path.join(TOKENIZERS, name)
    return path(name)


def op1_chat_format(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    rows = chat.conversations_as_rows(turns.unionByName(probe))
    _, formatted = chat.format_conversations(rows)
    back = formatted.select(
        "conv_id",
        "formatted",
        chat.parse(F.col("formatted")).alias("turns"),
        chat.masked(F.col("formatted"), F.col("loss")).alias("learned"),
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op2_language_id(spark, sf):
    documents = table(spark, sf, "documents")

    def held_out(id_column: str):
        return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))

    model = language.fit(documents.filter(~held_out("doc_id")))
    found = language.identify(documents, model)
    return found.select(
        F.col("id").alias("doc_id"),
        held_out("id").alias("held_out"),
        "lang_pred",
        "score",
        (~F.col("accepted")).alias("rejected"),
    )


def op3_best_fit_packing(spark, sf):
    packed = packing.pack_documents(table(spark, sf, "documents"), vocabulary(), 2048, 0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_ngram_jaccard(spark, sf):
    return near.near_duplicates(table(spark, sf, "documents"), 80).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id"
    )


def op5_pii(spark, sf):
    found = pii.pii_spans(table(spark, sf, "documents"))
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"),
        *[number(kind) for kind in pii.BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op6_quality_rules(spark, sf):
    judged = quality.quality(table(spark, sf, "documents"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("quality") >= 0.5)).alias("kept"),
        "quality",
    )


def op7_bpe(spark, sf):
    coded = bpe.encode_decode(table(spark, sf, "documents"), vocabulary())
    return coded.select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_repeats(spark, sf):
    return repeats.remove_repeats(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


def op9_token_counts(spark, sf):
    """Three edits of every document: a cut in the first quarter, words in the middle, more at the end."""
    trees = edits.build_trees(table(spark, sf, "documents"), vocabulary())
    n = F.length("text").cast("bigint")

    def edit(start, end, text):
        return F.struct(
            start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), F.lit(text).alias("text")
        )

    made = F.array(
        edit(F.floor(n / 4), F.floor(n / 4) + 10, ""),
        edit(F.floor(n / 2), F.floor(n / 2) + 5, " a few new Words, "),
        edit(n, n, "at the end"),
    )
    counted = edits.apply_edits(trees.withColumn("edits", made), vocabulary())
    return counted.select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        "n_tokens_edited",
        "n_chars_edited",
        "n_chars_encoded",
        F.sha2("edited", 256).alias("edited_sha256"),
    )


def op10_spot_signatures(spark, sf):
    chained = spots.with_next(table(spark, sf, "documents"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    printed = chained.select(
        F.col("id").alias("doc_id"),
        n.cast("bigint").alias("n_chars"),
        F.sha2(edited, 256).alias("edited_sha256"),
        F.col("spots").alias("own"),
        spots.spots(edited).alias("other"),
        F.col("next_spots").alias("next"),
    )
    return printed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        spots.as_text(F.col("own")).alias("fingerprint"),
        spots.as_text(F.col("other")).alias("edited_fingerprint"),
        spots.likeness(F.col("own"), F.col("other")).alias("near_edited"),
        spots.likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def op11_exact_topk(spark, sf):
    return topk.top_inner_products(table(spark, sf, "embeddings"), F.col("id") % 50 == 0, 5, 256.0)


def op12_filter_audit(spark, sf):
    return audit.audit_filters(table(spark, sf, "documents"), table(spark, sf, "labels"))


def looped(documents):
    """The texts of every tenth id by its CRC-32, with the words behind one place in a loop."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def loop(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.transform(places, lambda i: words[i]), " "))

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return documents.select("doc_id", F.when(h % 10 == 0, bind(words, loop)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf):
    found = runs.periodic_runs(looped(table(spark, sf, "documents")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    by_length = F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"]))
    longest = F.array_max(by_length)
    length, start, period = longest["length"], -longest["col2"], -longest["col3"]
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("bigint").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_language_id": op2_language_id,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_pii": op5_pii,
    "op6_quality_rules": op6_quality_rules,
    "op7_bpe": op7_bpe,
    "op8_repeats": op8_repeats,
    "op9_token_counts": op9_token_counts,
    "op10_spot_signatures": op10_spot_signatures,
    "op11_exact_topk": op11_exact_topk,
    "op12_filter_audit": op12_filter_audit,
    "op13_periodic_runs": op13_periodic_runs,
}

# Lengths and digests of the same turns, put together without the tree; 6 + 1 and 8 characters of
# template a turn.
OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS said,
    sum(15 + length(regexp_replace(role || text, '([\\<>])', '\1\1', 'g'))) AS chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(said) AS loss_chars,
  sha256(said) AS loss_sha256, chars::BIGINT AS formatted_chars
FROM c
"""

# All pairs that share a shingle, then components by reachability.
OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y
  WHERE 100 * common >= 80 * (nx.n + ny.n - common)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id, doc_id AS reached FROM documents
  UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reached = e.x
)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP11_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
)
SELECT q.vec_id AS query_id,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id)::INTEGER AS rank,
  c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
QUALIFY rank <= 5
"""

# Every order is walked step by step; removals are summed over the orders by a window.
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN w.doc_id > first_id THEN 16 ELSE 0 END AS failed
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id
), c AS (
  SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed
), x AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(letter, bit)
), o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM x AS a, x AS b, x AS c, x AS d, x AS e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT o.filter_order, instr(o.filter_order, x.letter)::INTEGER AS step, x.bit,
    (SELECT coalesce(sum(y.bit), 0)::INTEGER FROM x AS y
     WHERE instr(o.filter_order, y.letter) < instr(o.filter_order, x.letter)) AS before
  FROM o, x
), r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN failed & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN failed & before = 0 AND failed & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failed & before > 0 AND failed & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failed & before = 0 AND failed & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN failed & before = 0 AND failed & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""

ORACLE_SQL = {
    "op1_chat_format": OP1_SQL,
    "op4_ngram_jaccard": OP4_SQL,
    "op11_exact_topk": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}
