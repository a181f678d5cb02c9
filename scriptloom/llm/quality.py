"""Quality by weak supervision (operator 6): rules vote or abstain, expectation-maximisation
estimates how far each can be trusted, and the posterior decides."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.store import id_text, mix, stored, strings, text_groups, word_hashes

WINDOW = 5
SYMBOLS = b"#*$%&|<>"  # fixed value
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")
_COUNTED = np.zeros((3, 256), bool)
_COUNTED[0, list(SYMBOLS)] = True
_COUNTED[1, [*range(65, 91), *range(97, 123), *range(192, 256)]] = True
_COUNTED[2, list(range(65, 91))] = True


# What good and bad texts get from a rule to begin with: good, bad, abstain. Fixed values.
START = ((0.80, 0.02, 0.18), (0.40, 0.45, 0.15))
PRIOR_WEIGHT = 20


def _repeated(hashes: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """For every word, whether it lies in a window of WINDOW words that its text holds twice or more."""
    n = len(hashes)
    covered = np.zeros(n, bool)
    if n < WINDOW:
        return covered
    text = np.repeat(np.arange(len(per_text), dtype=np.uint64), per_text)
    keys = mix(text[: n - WINDOW + 1] + np.uint64(1))
    for k in range(WINDOW):
        keys = mix(keys ^ hashes[k : n - WINDOW + 1 + k])
    inside = np.flatnonzero(text[: n - WINDOW + 1] == text[WINDOW - 1 :])
    keys = keys[inside]
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = inside[twice]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return np.cumsum(edges[:-1]) > 0


def count_features(texts: list[str]) -> Iterator[np.ndarray]:
    """Blocks of counts (texts x COUNTS), in order."""
    for _, group in text_groups(texts):
        hashes, per_text, _, _ = word_hashes(group)
        data = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
        bounds = np.cumsum(np.array([len(t) + 1 for t in group], np.int64))

        def per(mask: np.ndarray, bounds=bounds) -> np.ndarray:
            sums = np.cumsum(mask, dtype=np.int64)
            return np.diff(sums[bounds - 1], prepend=0)

        space = (data == 32) | ((data >= 9) & (data <= 13))
        lines = [[x for x in t.split(b"\n") if x.strip()] for t in group]
        repeated = np.concatenate([[0], np.cumsum(_repeated(hashes, per_text))])
        ends = np.cumsum(per_text)
        yield np.column_stack(
            [
                per_text,
                per(~space & ((data & 0xC0) != 0x80)),
                per(_COUNTED[0][data]),
                [len(x) - len(set(x)) for x in lines],
                repeated[ends] - repeated[ends - per_text],
                [len(x) for x in lines],
                per(_COUNTED[1][data]),
                per(_COUNTED[2][data]),
            ]
        ).astype(np.int64)


def text_counts(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and COUNTS of every whole text, one narrow pass; NULL and empty texts count 0 everywhere.

    Windows are compared by 64-bit hashes. ``n_letters`` counts ASCII letters and code points
    beyond ASCII, ``n_lines`` lines with a word.
    """
    source = id_text(documents, id_column, text_column)
    kind = source.schema["id"].dataType.simpleString()

    def count(batches):
        for batch in batches:
            blocks = list(count_features(strings(batch))) or [np.zeros((0, len(COUNTS)), np.int64)]
            columns = np.ascontiguousarray(np.concatenate(blocks).T)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, columns)], ["id", *COUNTS])

    return source.mapInArrow(count, f"id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("tinyint")


def rule_votes() -> dict[str, Column]:
    """The rules over COUNTS: 1 good, -1 bad, 0 abstains. Thresholds are fixed values."""
    c = {n: F.col(n) for n in COUNTS}
    words = F.greatest(c["n_words"], F.lit(1))
    chars = F.greatest(c["word_chars"], F.lit(1))
    mean = c["word_chars"] / words
    return {
        "length": _vote(c["n_words"] >= 30, c["n_words"] < 10),
        "repeats": _vote(c["n_repeat_words"] * 20 <= c["n_words"], c["n_repeat_words"] * 5 > c["n_words"]),
        "symbols": _vote(c["n_symbols"] * 50 <= words, c["n_symbols"] * 10 > words),
        "symbol_share": _vote(c["n_symbols"] * 100 <= chars, c["n_symbols"] * 20 > chars),
        "lines": _vote(c["n_dup_lines"] == 0, c["n_dup_lines"] * 2 > c["n_lines"]),
        "word_length": _vote((mean >= 3) & (mean <= 10), (mean < 2) | (mean > 14)),
        "letters": _vote(c["n_letters"] * 10 >= chars * 8, c["n_letters"] * 10 < chars * 6),
        "capitals": _vote(c["n_upper"] * 10 <= chars, c["n_upper"] * 10 > chars * 4),
    }


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> list[float]:
    """Posterior probability of good quality for each vote pattern, given with its count.

    Each rule has its own probabilities of voting good, voting bad and abstaining for good and for
    bad texts, estimated by expectation-maximisation with START as prior observations of weight
    PRIOR_WEIGHT. A rule stays at least twice as likely to vote bad on bad texts as on good ones,
    and the share of good texts in [0.5, 0.99], so that the two classes cannot swap their names.
    """
    if not patterns:
        return []
    votes = np.array([p for p, _ in patterns])
    weight = np.array([n for _, n in patterns], float)
    cast = np.stack([votes == v for v in (1, -1, 0)], 1).astype(float)  # pattern, vote, rule
    start = np.array(START)[:, :, None].repeat(votes.shape[1], 2)  # class, vote, rule
    chance, share = start.copy(), 0.9
    posterior = np.zeros(len(votes))
    for _ in range(rounds):
        odds = math.log(share / (1 - share)) + np.einsum("pvr,vr->p", cast, np.log(chance[0] / chance[1]))
        posterior = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        seen = np.stack([np.einsum("p,pvr->vr", weight * q, cast) for q in (posterior, 1 - posterior)])
        chance = seen + PRIOR_WEIGHT * start
        chance /= chance.sum(1, keepdims=True)
        chance[0, 1] = np.minimum(chance[0, 1], chance[1, 1] / 2)
        chance[1, 0] = np.minimum(chance[1, 0], chance[0, 0])
        chance /= chance.sum(1, keepdims=True)
        share = float(np.clip((posterior * weight).sum() / weight.sum(), 0.5, 0.99))
    return [float(p) for p in posterior]


def quality(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, COUNTS, the votes (vote_*) and ``quality``, the posterior probability of good quality.

    Vote patterns are counted over all rows; there are at most 3 ** 8 of them, which bounds both
    what the driver fits on and the broadcast of the posteriors. An empty table gives an empty one.
    """
    rules = rule_votes()
    names = [f"vote_{r}" for r in rules]
    counts = stored(text_counts(documents, id_column, text_column), "text-counts")
    voted = counts.select("*", *[v.alias(f"vote_{r}") for r, v in rules.items()])
    seen = voted.groupBy(*names).agg(F.count("*").alias("n")).collect()
    fitted = fit_label_model([(tuple(r[n] for n in names), r["n"]) for r in seen])
    posteriors = documents.sparkSession.createDataFrame(
        [(*[r[n] for n in names], p) for r, p in zip(seen, fitted, strict=True)],
        ", ".join(f"{n} tinyint" for n in names) + ", quality double",
    )
    return voted.join(F.broadcast(posteriors), names)
