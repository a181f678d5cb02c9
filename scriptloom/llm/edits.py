"""Token counts that follow edits (operator 9).

A leaf is a stretch without white space, with the white space before it; no pre-token crosses from
one to the next. A segment tree holds the code points and tokens below every node. An edit finds
its leaves by walking the code-point sums, takes the leaves it touches on either side as context,
and updates the sums above them. What the edits of one round touch in a batch of texts is encoded
in one call.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptloom.llm.bpe import SPACES, Encoder, broadcast_automaton
from scriptloom.llm.store import id_text, strings

_LEAF = re.compile(rf"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+\Z")


def cut_leaves(text: str) -> list[str]:
    """Stretches without white space, each with the white space before it; white space at the end is
    one more leaf."""
    return _LEAF.findall(text)


class CountTree:
    """Sums of code points and tokens over the leaves of one text."""

    def __init__(self, text: str, chars: list[int], tokens: list[int]):
        self.source, n = text, max(len(chars), 1)
        self.starts = np.append(0, np.cumsum(np.array(chars, np.int64))).tolist()
        self.changed: dict[int, str] = {}
        self.width = 1 << (n - 1).bit_length()
        sums = np.zeros((2 * self.width, 2), np.int64)
        sums[self.width : self.width + len(chars), 0] = chars
        sums[self.width : self.width + len(chars), 1] = tokens
        level = self.width
        while level > 1:
            sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2, 2).sum(1)
            level //= 2
        self.char_sums, self.token_sums = sums[:, 0].tolist(), sums[:, 1].tolist()

    @property
    def chars(self) -> int:
        return self.char_sums[1]

    @property
    def tokens(self) -> int:
        return self.token_sums[1]

    def leaf(self, i: int) -> str:
        if i in self.changed:
            return self.changed[i]
        return self.source[self.starts[i] : self.starts[i + 1]] if i + 1 < len(self.starts) else ""

    def text(self) -> str:
        pieces, done = [], 0
        for i in sorted(self.changed):
            pieces += [self.source[self.starts[done] : self.starts[min(i, len(self.starts) - 1)]], self.changed[i]]
            done = min(i + 1, len(self.starts) - 1)
        return "".join([*pieces, self.source[self.starts[done] :]])

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds this code point (the last one at the end) and where the leaf starts."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if char >= start + self.char_sums[node] and self.char_sums[node + 1]:
                start += self.char_sums[node]
                node += 1
        return node - self.width, start

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.changed[leaf] = text
        node = leaf + self.width
        chars, tokens = len(text) - self.char_sums[node], tokens - self.token_sums[node]
        while node:
            self.char_sums[node] += chars
            self.token_sums[node] += tokens
            node //= 2

    def touched(self, start: int, end: int, new: str) -> tuple[int, int, str]:
        """First and last leaf of an edit that puts ``new`` for code points [start, end), and their text
        behind it. Bounds are clipped to the text.

        The leaf before ``start`` and the one at ``end`` belong to it, as the edit may join their words.
        """
        start = max(0, min(start, self.chars))
        end = max(start, min(end, self.chars))
        first, at = self.find(max(start - 1, 0))
        last, _ = self.find(end)
        held = "".join([self.leaf(i) for i in range(first, last + 1)])
        return first, last, held[: start - at] + new + held[end - at :]

    def put(self, first: int, last: int, text: str, tokens: int) -> None:
        """The leaves become one with this text and its tokens; the others among them empty."""
        self._set(first, text, tokens)
        for leaf in range(first + 1, last + 1):
            if self.char_sums[leaf + self.width]:
                self._set(leaf, "", 0)


TEXTS = 256  # texts whose leaves are in memory at once; a memory bound only


def _parts(batches):
    for batch in batches:
        for begin in range(0, batch.num_rows, TEXTS):
            yield batch.slice(begin, TEXTS)


def _counter(auto):
    return Encoder(auto, lambda ids: len(ids) // 4)


def build_trees(documents: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, text, leaf_chars, leaf_tokens: what a document's tree is restored from. NULL texts are empty."""
    tables = broadcast_automaton(documents.sparkSession, path)
    source = id_text(documents, id_column, text_column)
    kind = source.schema["id"].dataType.simpleString()

    def build(batches):
        encoder = _counter(tables.value)
        for batch in _parts(batches):
            texts = strings(batch)
            cut = [cut_leaves(t) for t in texts]
            tokens = []
            for leaves, counts in zip(cut, encoder.records(texts), strict=True):
                if leaves and leaves[-1].isspace():
                    counts = [*counts, 0]
                if len(counts) != len(leaves):  # a special token within a stretch
                    counts = [sum(r) for r in encoder.records(leaves)]
                tokens.append(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("text"),
                    pa.array([[len(x) for x in leaves] for leaves in cut], pa.list_(pa.int32())),
                    pa.array(tokens, pa.list_(pa.int32())),
                ],
                ["id", "text", "leaf_chars", "leaf_tokens"],
            )

    return source.mapInArrow(build, f"id {kind}, text string, leaf_chars array<int>, leaf_tokens array<int>")


def apply_edits(trees: DataFrame, path: str) -> DataFrame:
    """Apply ``edits`` (array<struct<start, end, text>>, in order, each on the result of the one before).

    Result: id, n_tokens (before), n_tokens_edited, n_chars_edited, n_chars_encoded (code points
    encoded again), edited (the text). No edits, NULL edits and NULL fields change nothing: a NULL
    text counts as empty, a NULL bound as 0.
    """
    tables = broadcast_automaton(trees.sparkSession, path)
    kind = trees.schema["id"].dataType.simpleString()
    names = ["id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_chars_encoded", "edited"]

    def apply(batches):
        encoder = _counter(tables.value)
        for batch in _parts(batches):
            rows = zip(strings(batch), *[batch.column(c).to_pylist() for c in ("leaf_chars", "leaf_tokens")], strict=True)
            trees = [CountTree(text, chars or [], tokens or []) for text, chars, tokens in rows]
            wanted = [e or [] for e in batch.column("edits").to_pylist()]
            before, encoded = [t.tokens for t in trees], [0] * len(trees)
            for turn in range(max(map(len, wanted), default=0)):
                those = [i for i, e in enumerate(wanted) if len(e) > turn and e[turn] is not None]
                edits = [wanted[i][turn] for i in those]
                found = [
                    trees[i].touched(e["start"] or 0, e["end"] or 0, e["text"] or "")
                    for i, e in zip(those, edits, strict=True)
                ]
                counts = encoder.records([text for _, _, text in found])
                for i, (first, last, text), count in zip(those, found, counts, strict=True):
                    trees[i].put(first, last, text, sum(count))
                    encoded[i] += len(text)
            columns = [before, [t.tokens for t in trees], [t.chars for t in trees], encoded, [t.text() for t in trees]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string())], names
            )

    chosen = trees.select("id", "text", "leaf_chars", "leaf_tokens", "edits")
    return chosen.mapInArrow(apply, f"id {kind}, " + ", ".join(f"{n} bigint" for n in names[1:5]) + ", edited string")
