"""Language identification by nearest centroid (operator 2)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.store import id_text, named, strings

DIMENSIONS = 4096
SLICE = 1 << 21  # bytes counted at once; a memory bound only
BLOCK = 256  # rows weighed at once; a memory bound only
# Bytes that are no letters become one blank; bytes beyond ASCII stay.
_LETTERS = np.full(256, 32, np.int64)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letters(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def ngram_counts(text: str) -> np.ndarray:
    """Hashed counts of the 1- to 3-grams of the lower-cased letters of a whole text."""
    data = text.lower().encode()
    total = np.zeros(DIMENSIONS)
    for begin in range(0, len(data), SLICE):
        lead = min(begin, 2)
        b = _LETTERS[np.frombuffer(data[begin - lead : begin + SLICE], np.uint8)]
        two = b[:-1] * 257 + b[1:]
        three = two[:-1] * 263 + b[2:]
        keys = [b[lead:], (two[max(0, lead - 1) :] * 2654435761) >> 9, (three[: len(three)] * 2246822519) >> 11]
        total[:256] += np.bincount(keys[0], minlength=256)[:256]
        for k in keys[1:]:
            total[256:] += np.bincount(k % (DIMENSIONS - 256), minlength=DIMENSIONS - 256)
    total[32] = 0
    return total


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means with farthest-first seeds; fewer centroids if there are fewer vectors."""
    seeds = [_unit(vectors.mean(0))]
    while len(seeds) < min(k, len(vectors)):
        seeds.append(vectors[int(np.argmin((vectors @ np.array(seeds).T).max(1)))])
    centroids = np.array(seeds)
    for _ in range(rounds):
        nearest = np.argmax(vectors @ centroids.T, 1)
        centroids = np.array(
            [_unit(vectors[nearest == c].mean(0)) if (nearest == c).any() else centroids[c] for c in range(len(centroids))]
        )
    return centroids


class CentroidModel:
    """Inverse document frequencies, centroids with their languages, and rejection distances.

    A text is rejected if its cosine distance to the nearest centroid is beyond what texts of
    about its length showed in training: the distance of the 99th percentile, ``slack`` times the
    similarity left there. Short texts share few n-grams with any centroid, hence the length classes.
    """

    def __init__(self, languages: list[str], counts: np.ndarray, clusters: int = 4, slack: float = 0.5):
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1
        vectors = self.vectors(counts)
        self.names = sorted(set(languages))
        of = np.array([self.names.index(x) for x in languages], int)
        found = [_cluster(vectors[of == i], clusters) for i in range(len(self.names))]
        self.centroids = np.concatenate(found) if found else np.zeros((0, DIMENSIONS))
        self.owner = np.repeat(np.arange(len(found)), [len(f) for f in found]) if found else np.zeros(0, int)
        self.least = np.zeros(64)
        if len(vectors):
            own = np.where(self.owner == of[:, None], vectors @ self.centroids.T, 0).max(1)
            size = self.size_class(counts)
            for s in range(64):
                if (size == s).sum() >= 20:
                    self.least[s] = slack * np.quantile(own[size == s], 0.01)

    @staticmethod
    def size_class(counts: np.ndarray) -> np.ndarray:
        return np.log2(1 + counts[:, :256].sum(1, dtype=float)).astype(int)

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        made = np.empty(counts.shape)
        for begin in range(0, len(counts), BLOCK):
            made[begin : begin + BLOCK] = _unit(np.log1p(counts[begin : begin + BLOCK].astype(float)) * self.idf)
        return made

    def predict(self, counts: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Language number, similarity (0 to 1), accepted."""
        cosine = self.vectors(counts) @ self.centroids.T
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(counts)), best], 0, 1)
        return self.owner[best].tolist(), score, score >= self.least[self.size_class(counts)]


def fit(labelled: DataFrame, lang_column: str = "lang", text_column: str = "text", id_column: str = "doc_id", per_language: int = 300) -> CentroidModel:
    """Fit on at most ``per_language`` labelled rows of each language, chosen by a hash of their id.

    That bound is a parameter of the model; whole texts are counted. Rows without a language or
    without letters teach nothing.
    """
    rows = labelled.select(
        named(id_column).alias("id"), named(lang_column).alias("lang"), named(text_column).alias("text")
    ).filter("lang IS NOT NULL AND text IS NOT NULL")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = rows.select("id", "lang").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_language)
    chosen = chosen.select("id", F.col("lang").alias("_lang")).distinct()

    def count(batches):
        for batch in batches:
            texts = strings(batch)
            kept = [i for i, t in enumerate(texts) if has_letters(t)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang").take(pa.array(kept, pa.int64())),
                    pa.array([ngram_counts(texts[i]).astype("<f4").tobytes() for i in kept], pa.binary()),
                ],
                ["lang", "counts"],
            )

    # At most ``per_language`` rows for each language: sent to the texts, which stay where they are.
    chosen = F.broadcast(chosen)
    picked = rows.join(chosen, (rows["id"] == chosen["id"]) & (rows["lang"] == chosen["_lang"]), "left_semi")
    found = sorted(
        (r["lang"], bytes(r["counts"]))
        for r in picked.select("lang", "text").mapInArrow(count, "lang string, counts binary").collect()
    )
    languages = [x for x, _ in found]
    counts = np.frombuffer(b"".join(c for _, c in found), "<f4").reshape(-1, DIMENSIONS)
    del found  # the driver holds the counts once
    return CentroidModel(languages, counts)


def identify(documents: DataFrame, model: CentroidModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, lang_pred, score, accepted for every whole text, in one narrow pass.

    ``und`` with score 0 for a NULL text, one without letters, or an untrained model; never
    accepted then.
    """
    source = id_text(documents, id_column, text_column)
    kind = source.schema["id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a few centroids of fixed size

    def predict(batches):
        model = shared.value
        for batch in batches:
            texts = strings(batch)
            langs, scores, accepted = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            rows = [i for i, t in enumerate(texts) if model.names and has_letters(t)]
            for begin in range(0, len(rows), 256):
                part = rows[begin : begin + 256]
                owner, score, ok = model.predict(np.array([ngram_counts(texts[i]) for i in part]))
                scores[part], accepted[part] = score, ok
                for i, o in zip(part, owner, strict=True):
                    langs[i] = model.names[o]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(langs), pa.array(scores), pa.array(accepted)],
                ["id", "lang_pred", "score", "accepted"],
            )

    return source.mapInArrow(predict, f"id {kind}, lang_pred string, score double, accepted boolean")


def recognised(documents: DataFrame, model: CentroidModel, text_column: str = "text") -> DataFrame:
    """The rows whose text the model accepts, with all their columns, in one narrow pass."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        model = shared.value
        for batch in batches:
            texts = strings(batch, text_column)
            rows = [i for i, t in enumerate(texts) if model.names and has_letters(t)]
            kept = np.zeros(len(texts), bool)
            for begin in range(0, len(rows), 256):
                part = rows[begin : begin + 256]
                kept[part] = model.predict(np.array([ngram_counts(texts[i]) for i in part]))[2]
            yield batch.filter(pa.array(kept))

    return documents.mapInArrow(keep, documents.schema)
