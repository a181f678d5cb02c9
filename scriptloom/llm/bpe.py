"""BPE encoding and decoding with a deterministic automaton (operator 7).

``compile_automaton`` starts from one state that loops on every base symbol and applies one
merge gadget per merge rule, in rank order: for ``(u, v) -> w`` the state behind ``u`` is split
into a copy without the ``v`` arc, every state with a ``u`` arc gets a ``w`` arc, and ``w`` leads
where ``v`` led. Whatever label sequence the finished automaton accepts is the BPE encoding of
the string it spells, so a pre-split word is encoded by the one accepted path over its symbols,
found by table look-ups; decoding emits the labels of the arcs.

The tables depend on the vocabulary alone (a few MB when sent, whatever the corpus), are compiled once by
a task and sent to the workers as a Spark broadcast variable; the driver holds them compressed only.
"""

from __future__ import annotations

import json
import pickle
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DENSE_SYMBOLS = 64  # longer words are encoded one by one, to keep the dense tables small
DENSE_WORDS = 20_000  # words encoded together
GROUP_CHARS = 1 << 21  # of the texts whose stretches are looked up together
CACHED_WORDS = 250_000  # stretches a worker remembers; a memory bound, no effect on results
CACHED_CHARS = 64  # longest of them, in bytes
CACHED_IDS = 4_000_000  # ids a worker remembers, likewise


@dataclass
class Automaton:
    """Tables of the compiled automaton; label numbers are token ids."""

    labels: list[str]
    arcs: np.ndarray  # uint8 [class of labels, state / 8]: bit set if the state has an arc with these labels
    class_of: np.ndarray  # int32 [label]: labels that leave the same states are one class
    target: np.ndarray  # int32 [label]: state behind the arc
    start: int
    trie: np.ndarray  # uint16 [row, byte]: node, 0 if none; spells labels over bytes
    row_of: np.ndarray  # int32 [node]: its row in ``trie``, row 0 has no way on
    label_at: np.ndarray  # int32 [2, node]: label spelled, inside and at the end of a word; -1 if none
    special: dict[str, int] = field(default_factory=dict)
    letters: str = ""  # ranges of code points, for the pre-tokenizer's pattern
    numbers: str = ""

    def __getstate__(self) -> dict:
        """Tables are sent compressed: the two large ones shrink to a tenth and less."""
        state = dict(self.__dict__)
        for name in ("arcs", "trie"):
            x = state[name]
            state[name] = (zlib.compress(x.tobytes(), 6), x.dtype.str, x.shape)
        return state

    def __setstate__(self, state: dict) -> None:
        for name in ("arcs", "trie"):
            data, kind, shape = state[name]
            state[name] = np.frombuffer(zlib.decompress(data), kind).reshape(shape)
        self.__dict__.update(state)


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte (public byte-level convention)."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    stand_in = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [stand_in[b] for b in range(256)]


def merge_gadgets(merges: list[tuple[int, int, int]], final: np.ndarray, base: list[int], size: int):
    """Arc bits, targets and start state after one gadget per merge (u, v, w)."""
    width = (size + 7) // 8
    arcs = np.zeros((1024, width), np.uint8)
    for b in base:
        arcs[0, b >> 3] |= 1 << (b & 7)
    arcs[1] = arcs[0]  # state 0: start, kept apart; state 1: behind every base symbol
    target = np.zeros(size, np.int32)
    target[base] = 1
    used = np.zeros(size + 2, np.int64)  # labels that lead to a state
    used[0], used[1] = 1, int((~final[base]).sum())
    states, free = 2, []
    for u, v, w in merges:
        byte, bit = v >> 3, np.uint8(1 << (v & 7))
        q = int(target[u])
        if not arcs[q, byte] & bit:
            continue  # v never follows u any more: the rule cannot fire
        after = int(target[v])
        if used[q] > 1 or u == v:
            if free:
                copy = free.pop()
            else:
                copy, states = states, states + 1
                if copy == len(arcs):
                    arcs = np.concatenate([arcs, np.zeros_like(arcs)])
            arcs[copy] = arcs[q]
            target[u] = copy
            used[q] -= 1
            used[copy] = 1
            q = copy
        arcs[q, byte] &= ~bit
        has = (arcs[:states, u >> 3] >> np.uint8(u & 7)) & 1
        arcs[:states, w >> 3] |= has << np.uint8(w & 7)
        if not final[w]:
            target[w] = after
            used[after] += 1
        if u == v and not used[after]:
            free.append(after)
    return arcs[:states], target, 0


def label_classes(arcs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Turn [state, label] bits into [class, state] bits and the class of each label."""
    number: dict[bytes, int] = {}
    class_of = np.zeros(size, np.int32)
    for begin in range(0, arcs.shape[1], 32):
        bits = np.unpackbits(arcs[:, begin : begin + 32], axis=1, bitorder="little")
        columns = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
        for label, column in enumerate(columns[: max(0, size - 8 * begin)], 8 * begin):
            class_of[label] = number.setdefault(column.tobytes(), len(number))
    kept = sorted(number)  # like beside like: compresses much better
    place = np.empty(len(kept), np.int32)
    place[[number[k] for k in kept]] = np.arange(len(kept))
    return np.frombuffer(b"".join(kept), np.uint8).reshape(len(kept), -1), place[class_of]


def compile_automaton(path: str) -> Automaton:
    """Compile a tokenizers BPE file (byte-level, with an end-of-word suffix)."""
    with open(path, encoding="utf-8") as file:
        return compile_spec(file.read())


def compile_spec(text: str) -> Automaton:
    """The automaton of such a file's content."""
    spec = json.loads(text)
    model = spec["model"]
    suffix = model["end_of_word_suffix"] or ""
    vocab = model["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = max([*vocab.values(), *special.values()]) + 1
    labels = [""] * size
    for label, i in [*vocab.items(), *special.items()]:
        labels[i] = label
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    merges = [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs]
    letters = byte_symbols()
    symbols = letters + [x + suffix for x in letters]
    base = [vocab[s] for s in symbols]
    spelled: dict[int, tuple[int, ...]] = {i: (s,) for s, i in enumerate(base)}
    for u, v, w in merges:
        spelled.setdefault(w, spelled[u] + spelled[v])
    final = np.zeros(size, bool)
    for i, s in spelled.items():
        final[i] = s[-1] >= 256
    arcs, target, start = merge_gadgets(merges, final, base, size)
    arcs, class_of = label_classes(arcs, size)
    node_of: dict[bytes, int] = {b"": 1}
    steps: list[tuple[int, int, int]] = []
    named: list[tuple[int, int, int]] = []
    for i, spell in spelled.items():
        spell_bytes = bytes(s & 255 for s in spell)
        for k in range(1, len(spell) + 1):
            if spell_bytes[:k] not in node_of:
                node_of[spell_bytes[:k]] = len(node_of) + 1
                steps.append((node_of[spell_bytes[: k - 1]], spell_bytes[k - 1], len(node_of)))
        named.append((int(final[i]), node_of[spell_bytes], i))
    nodes = len(node_of) + 1
    parents = sorted({p for p, _, _ in steps})
    row_of = np.zeros(nodes, np.int32)
    row_of[parents] = np.arange(1, len(parents) + 1)
    trie = np.zeros((len(parents) + 1, 256), np.uint16 if nodes < 1 << 16 else np.uint32)
    label_at = np.full((2, nodes), -1, np.int32)
    for p, b, n in steps:
        trie[row_of[p], b] = n
    for end, n, i in named:
        label_at[end, n] = i
    return Automaton(labels, arcs, class_of, target, start, trie, row_of, label_at, special, *_classes())


def _dense(auto: Automaton, symbols: np.ndarray, lengths: np.ndarray):
    """Encode words given as rows of ``symbols``, longest first: flat ids, ids per word."""
    n, most = symbols.shape
    last = np.zeros((most + 1, n), np.int32)
    prev = np.zeros((most + 1, n), np.int16 if most < 30_000 else np.int32)
    state = np.full(n, auto.start, np.int32)
    for j in range(most):
        live = int(np.searchsorted(-lengths, -j, "left"))  # words longer than j
        if j:
            state = auto.target[last[j, :live]]
        word = np.arange(live)
        node = np.ones(live, np.int32)
        for d in range(j, most):
            node = auto.trie[auto.row_of[node], symbols[word, d]]
            going = np.flatnonzero(node)
            if not len(going):
                break
            word, node = word[going], node[going]
            label = auto.label_at[(lengths[word] == d + 1).astype(np.int8), node]
            ok = np.flatnonzero(label >= 0)
            w, lab = word[ok], label[ok]
            s = state[w]
            ok = (auto.arcs[auto.class_of[lab], s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
            w = w[ok]
            last[d + 1, w] = lab[ok]
            prev[d + 1, w] = j
            keep = lengths[word] > d + 1
            word, node = word[keep], node[keep]
            if not len(word):
                break
    at, word, steps = lengths.copy(), np.arange(n), []
    while len(word):
        steps.append((word, last[at, word]))
        at = prev[at, word].astype(np.int64)
        word, at = word[at > 0], at[at > 0]
    counts = np.bincount(np.concatenate([w for w, _ in steps]), minlength=n) if steps else np.zeros(n, int)
    ends = np.cumsum(counts)
    flat = np.empty(int(ends[-1]) if n else 0, np.uint32)
    for k, (w, ids) in enumerate(steps):
        flat[ends[w] - 1 - k] = ids
    return flat, counts


def _walk(auto: Automaton, word: bytes) -> bytes:
    """Encode one long word, a table look-up at a time: every prefix is accepted by one path."""
    n, width, states = len(word), auto.trie.shape[1], auto.arcs.shape[1]
    trie, rows, target = (memoryview(x.reshape(-1)) for x in (auto.trie, auto.row_of, auto.target))
    arcs, classes = memoryview(auto.arcs.reshape(-1)), memoryview(auto.class_of)
    inside, at_end = memoryview(auto.label_at[0]), memoryview(auto.label_at[1])
    last, prev = [0] * (n + 1), [0] * (n + 1)
    for begin in range(n):
        state = target[last[begin]] if begin else auto.start
        node = 1
        for end in range(begin, n):
            node = trie[rows[node] * width + word[end]]
            if not node:
                break
            label = (inside if end + 1 < n else at_end)[node]
            if label >= 0 and arcs[classes[label] * states + (state >> 3)] >> (state & 7) & 1:
                last[end + 1], prev[end + 1] = label, begin
    ids, at = [], n
    while at:
        ids.append(last[at])
        at = prev[at]
    return np.array(ids[::-1], "<u4").tobytes()


def encode_words(auto: Automaton, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids of non-empty words (large strings): all ids, and where each word's begin and how many they are."""
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    many, parts, begin = np.zeros(n, np.int64), [], 0
    while begin < n:
        most = int(sizes[order[begin]])
        if most > DENSE_SYMBOLS:
            i = order[begin]
            parts.append(np.frombuffer(_walk(auto, data[offsets[i] : offsets[i + 1]].tobytes()), "<u4"))
            many[i] = len(parts[-1])
            begin += 1
            continue
        block = order[begin : begin + DENSE_WORDS]
        begin += len(block)
        lengths = sizes[block]
        symbols = np.zeros((len(block), most), np.uint8)
        symbols[np.arange(most) < lengths[:, None]] = data[_places(offsets[block], lengths)]
        flat, many[block] = _dense(auto, symbols, lengths)
        parts.append(flat.astype("<u4", copy=False))
    first = np.empty(n, np.int64)
    first[order] = np.cumsum(many[order]) - many[order]
    return np.concatenate([np.zeros(0, "<u4"), *parts]), first, many


def _places(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1 and so on, many[0] of them, then those of first[1], and so on."""
    ends = np.cumsum(many)
    return np.repeat(first - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)


def _classes() -> tuple[str, str]:
    """Ranges of all code points whose general category starts with L and with N."""
    ranges: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c, category in enumerate(map(unicodedata.category, map(chr, range(sys.maxunicode + 1)))):
        if (own := ranges.get(category[0])) is not None:
            if own and own[-1][1] == c - 1:
                own[-1][1] = c
            else:
                own.append([c, c])
    letters, numbers = ("".join(rf"\U{a:08x}-\U{b:08x}" for a, b in own) for own in ranges.values())
    return letters, numbers


# Fixed value: the contractions that the pre-tokenizer keeps whole.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
# Fixed value: white space of the pre-tokenizer's pattern.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Those of them beyond ASCII.
_WIDE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE = np.isin(np.arange(256), [*range(9, 14), 32])
# Before a special token's string, found as such; no UTF-8 holds this byte, so equal text elsewhere is ordinary.
_MARK = b"\xff"


def _with(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``array`` with ``more`` behind its first ``used`` elements; its room doubles when it is full."""
    if used + len(more) > len(array):
        array = np.concatenate([array[:used], np.empty(max(used, 2 * len(more)), array.dtype)])
    array[used : used + len(more)] = more
    return array


class Encoder:
    """Texts to ids, or to token records, by a compiled automaton.

    Pre-split words never cross white space. The stretches between white space of many texts are one
    Arrow array, of which each distinct one is looked up once; a bounded store holds the ids of those
    seen before, and only new ones go through the pattern and the automaton. ``ids`` puts the ids of
    every text together; ``records`` lists, for every stretch, what ``record`` turns its ids
    (little-endian bytes) into. Stretches of more than ``CACHED_CHARS`` bytes are not found again.
    """

    def __init__(self, auto: Automaton, record=bytes):
        self.auto, self.record = auto, record
        letters, numbers = auto.letters, auto.numbers
        self.pattern = re.compile(f"[{letters}]+|[{numbers}]|{CONTRACTIONS}|[^{SPACES}{letters}{numbers}]+")
        self.special = re.compile("(" + "|".join(map(re.escape, auto.special)) + ")") if auto.special else None
        self._forget()

    def _forget(self) -> None:
        """Only the special tokens are known."""
        special = self.auto.special
        self.row_of = {_MARK + s.encode(): i for i, s in enumerate(special)}
        self.rows = self.used = len(special)  # rows known, ids of all of them
        self.held = np.array([*special.values()], "<u4")
        self.first, self.many = np.arange(self.rows), np.ones(self.rows, np.int64)
        self.made: list = []  # records of the first rows

    def fold(self, text: str) -> bytes:
        """The normalised text, all white space in ASCII; strings of special tokens are marked stretches."""
        if self.special is not None and "<|" in text:
            parts = self.special.split(text)
            if len(parts) > 1:
                return b" ".join([_MARK + x.encode() if i % 2 else self.fold(x) for i, x in enumerate(parts)])
        if not text.isascii():
            text = _WIDE.sub(" ", unicodedata.normalize("NFC", text).replace("Σ", "σ"))
        return text.lower().encode()

    def _encode(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stretches one after another, and how many each has."""
        words = pa.array(self.pattern.findall(b"\n".join(stretches).decode()), pa.large_string())
        ends = np.frombuffer(words.buffers()[1], np.int64)[1 : len(words) + 1]
        # Words cover a stretch without gaps, so the end of a stretch is the end of a word.
        upto = np.searchsorted(ends, np.cumsum([len(s) for s in stretches])) + 1
        coded = words.dictionary_encode()
        held, first, many = encode_words(self.auto, coded.dictionary)
        code = coded.indices.to_numpy()
        sums = np.append(0, np.cumsum(many[code]))
        return held[_places(first[code], many[code])], np.diff(sums[upto], prepend=0)

    def _learn(self, stretches: list[bytes]) -> np.ndarray:
        """New rows of the stretches; short ones are found again."""
        ids, many = self._encode(stretches)
        rows = np.arange(self.rows, self.rows + len(stretches))
        self.held = _with(self.held, self.used, ids)
        self.first = _with(self.first, self.rows, self.used + np.cumsum(many) - many)
        self.many = _with(self.many, self.rows, many)
        self.rows, self.used = self.rows + len(stretches), self.used + len(ids)
        if max(map(len, stretches)) <= CACHED_CHARS:
            self.row_of.update(zip(stretches, rows.tolist(), strict=True))
        else:
            self.row_of.update((s, row) for s, row in zip(stretches, rows.tolist(), strict=True) if len(s) <= CACHED_CHARS)
        return rows

    def _look_up(self, folded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The row of every stretch in order, and how many stretches there are up to the end of each text."""
        data = np.frombuffer(b"\n".join(folded) + b"\n", np.uint8)
        space = _SPACE[data]
        edges = np.flatnonzero(np.diff(space, prepend=True))
        starts, sizes = edges[0::2], edges[1::2] - edges[0::2]
        buffers = [None, pa.py_buffer(np.append(0, np.cumsum(sizes))), pa.py_buffer(data[~space])]
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        row = np.fromiter(map(self.row_of.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(row < 0)
        if len(new):
            row[new] = self._learn([distinct[i] for i in new.tolist()])
        ends = np.cumsum([len(t) + 1 for t in folded])
        return row[coded.indices.to_numpy()], np.searchsorted(starts, ends)

    def _found(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``_look_up`` for groups of texts, which bound the memory only."""
        begin = 0
        while begin < len(texts):
            folded, chars = [], 0
            while begin < len(texts) and (chars < GROUP_CHARS or not folded):
                folded.append(self.fold(texts[begin]))
                chars += len(texts[begin])
                begin += 1
            if self.rows > CACHED_WORDS or self.used > CACHED_IDS:
                self._forget()
            yield self._look_up(folded)

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """For every text, its ids as little-endian 32-bit numbers."""
        for rows, upto in self._found(texts):
            many = self.many[rows]
            whole = self.held[_places(self.first[rows], many)].tobytes()
            begin = 0
            for end in (4 * np.append(0, np.cumsum(many))[upto]).tolist():
                yield whole[begin:end]
                begin = end

    def records(self, texts: list[str]) -> Iterator[list]:
        """For every text, the records of its stretches in order."""
        for rows, upto in self._found(texts):
            at = len(self.made)
            if at < self.rows:
                held, begin = self.held[: self.used].tobytes(), 4 * int(self.first[at])
                for end in (4 * np.cumsum(self.many[at : self.rows]) + begin).tolist():
                    self.made.append(self.record(held[begin:end]))
                    begin = end
            made = list(map(self.made.__getitem__, rows.tolist()))
            begin = 0
            for end in upto.tolist():
                yield made[begin:end]
                begin = end


class _Packed:
    """A pickled automaton, which whoever unpickles it gets open."""

    def __init__(self, data: bytes):
        self.data = data

    def __reduce__(self):
        return pickle.loads, (self.data,)


_AUTOMATA: dict[str, _Packed] = {}


def _packed(text: str) -> bytes:
    return pickle.dumps(compile_spec(text))


def broadcast_automaton(spark, path: str):
    """The compiled tables as a broadcast variable; their size is set by the vocabulary alone.

    A task compiles them, as that takes some hundred MB for a while, which the driver would keep in part.
    """
    if path not in _AUTOMATA:
        with open(path, encoding="utf-8") as file:
            _AUTOMATA[path] = _Packed(spark.sparkContext.parallelize([file.read()], 1).map(_packed).first())
    return spark.sparkContext.broadcast(_AUTOMATA[path])


def text_batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches with their texts as strings; a NULL text is an empty one."""
    for batch in batches:
        yield batch, [t or "" for t in batch.column(column).to_pylist()]


def encode_decode(documents: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids and labels of every whole text: id, n_tokens, ids (decimal, one space between), decoded.

    NULL and empty texts have no ids and decode to an empty text. Rows are kept one for one, so
    repeated ids stay repeated; other columns are dropped, whatever their names.
    """
    tables = broadcast_automaton(documents.sparkSession, path)

    def encode(batches):
        auto = tables.value
        decimal = [str(i) for i in range(len(auto.labels))]

        def record(ids: bytes):
            numbers = memoryview(ids).cast("I").tolist() if sys.byteorder == "little" else np.frombuffer(ids, "<u4").tolist()
            return " ".join([decimal[i] for i in numbers]), " ".join([auto.labels[i] for i in numbers])

        encoder = Encoder(auto, record)
        for batch, texts in text_batches(batches, "text"):
            ids, decoded = [], []
            for records in encoder.records(texts):
                ids.append(" ".join([r[0] for r in records]))
                decoded.append(" ".join([r[1] for r in records]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64()),
                    pa.array(ids, pa.large_string()),
                    pa.array(decoded, pa.large_string()),
                ],
                ["id", "n_tokens", "ids", "decoded"],
            )

    source = documents.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(encode, f"id {kind}, n_tokens bigint, ids string, decoded string")

