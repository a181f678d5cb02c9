"""N-gram Jaccard join by parity sketches (operator 4).

A text's set holds its distinct 5-word shingles, as 64-bit hashes. Sets of about the same size
share a level; a level has ``m`` segments, each shingle belongs to one of them, and a segment's
sketch is the XOR of its shingles' hashes. A shingle in one set only changes one segment, so sets
with a symmetric difference of at most D differ in at most D segments and agree in at least m - D.
Both sets therefore hold a common segment among their first D + 1 in any order that depends on the
segments alone. The order is by how many sets have a segment: a set whose own segments, which
nobody shares, are more than D needs no join, and what many share (a common passage) comes last.

Segments that the same sets share say the same, so one of them stays. Candidates meet the leader
of their segment first: what is within the threshold of a leader needs no comparison among
itself, and as Jaccard distance is a metric, what is far from the leader cannot be near those
close around it. Rounds go on as long as they leave much less to compare; what is left then, sets
of different components, is compared pair by pair, once each, at the first segment a pair
shares, behind the bounds that sizes and parity bits give: 256 bits at first, then bits that grow
with the set, so that whole sets are moved for pairs that are near or almost so.
Nothing is capped; candidates are verified on the whole sets.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.components import connected_components
from scriptloom.llm.store import dropped, id_text, mix, named, shuffles_removed, stored, strings, text_groups, unused, word_hashes

WORDS = 5
SEEN = 200_000  # sets a task remembers as sent, to send copies once; a memory bound only
# Another round of leaders is worth its cost if the last one left at most this share of the rows.
WORTH = 0.5
CARRIED = 16  # keys that a row carries to meet a partner once; no effect on results
MOST_SLOTS = 1 << 26  # bits of the bitmap that tells most unwanted texts apart (8 MB); no effect on results
_INFO = "<?qqqq4q"


def _lower(text: bytes) -> bytes:
    return text.lower()  # of bytes: A-Z only


def shingle_sets(texts: list[str]):
    """For every text in order, its sorted distinct shingle hashes (uint64)."""
    for _, group in text_groups(texts):
        hashes, per_text, _, _ = word_hashes([_lower(t) for t in group])
        n = len(hashes)
        rolled = np.zeros(max(n - WORDS + 1, 0), np.uint64)
        for k in range(WORDS):
            rolled = mix(rolled * np.uint64(3) + hashes[k : n - WORDS + 1 + k]) if len(rolled) else rolled
        start = 0
        for words in per_text.tolist():
            if words >= WORDS:
                yield np.unique(rolled[start : start + words - WORDS + 1])
            elif words:
                short = np.uint64(words)
                for h in hashes[start : start + words]:
                    short = mix(np.array([short]) * np.uint64(5) + h)[0]
                yield np.array([short], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
            start += words


def set_hash(shingles: np.ndarray) -> int:
    """A 64-bit name of the set, 0 for the empty one."""
    if not len(shingles):
        return 0
    return int(mix(np.add.reduce(mix(shingles), keepdims=True) + np.uint64(len(shingles)))[0].view(np.int64))


def next_band(bands: list[int], percent: int) -> int:
    """The largest size of the band after ``bands`` (their largest sizes, from 0).

    Two sets within the threshold lie in one band or in neighbouring ones.
    """
    return max((bands[-1] + 1) * 100 // percent, bands[-1] + 1)


def segments_of(size: int, high: int, percent: int) -> tuple[int, int]:
    """Number of segments of a level whose largest sets have ``high`` shingles, and the largest
    symmetric difference that a set of ``size`` can have with a partner there; (0, 0) if only equal
    sets are near enough."""
    widest = 2 * high * (100 - percent) // (100 + percent)
    most = (size + min(high, size * 100 // percent)) * (100 - percent) // (100 + percent)
    return (widest + widest // 8 + 2, most) if most else (0, 0)


def segment_keys(shingles: np.ndarray, level: int, m: int) -> np.ndarray:
    """Join keys of a set at a level, one for each of its ``m`` segments."""
    folded = np.zeros(m, np.uint64)
    if m:
        segment = ((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # ascending, as shingles are
        begins = np.flatnonzero(np.diff(segment, prepend=segment[0] + np.uint64(1)) != 0)
        folded[segment[begins]] = np.bitwise_xor.reduceat(mix(shingles), begins)
    place = np.uint64(level) * np.uint64(1 << 40) + np.arange(m, dtype=np.uint64)
    return mix(folded ^ mix(place))


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """256 parity bits as four words: each shingle flips one, so their Hamming distance is at most
    the symmetric difference."""
    flipped = np.bincount((shingles & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(flipped.astype(np.uint8)).view("<i8")


def _sketch(percent: int):
    def sketch(batches):
        bands = [0]
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("id").to_pylist()
            keys, owners, sides, extra_at, extra, waiting = [], [], [], [], [], 0
            for i, shingles in enumerate(shingle_sets(strings(batch))):
                n = len(shingles)
                own = set_hash(shingles)
                key = int(mix(np.array([ids[i] or 0], np.int64).view(np.uint64))[0].view(np.int64))
                bits = parity_bits(shingles).tolist() if n else [0] * 4
                while len(bands) < 3 or bands[-2] < n:
                    bands.append(next_band(bands, percent))
                level = int(np.searchsorted(bands, n))
                # At the level of its own band, and of the next one if a partner can be there.
                places = [(level, *segments_of(n, bands[level], percent)), (level + 1, 0, 0)]
                if n * 100 // percent > bands[level]:
                    places[1] = (level + 1, *segments_of(n, bands[level + 1], percent))
                # Segments to join on, less those that are shared by anyone.
                quotas = [most + 1 - m for _, m, most in places]
                extra.append(struct.pack(_INFO, ids[i] is not None, ids[i] or 0, n, *quotas, *bits))
                extra_at.append((key, own))
                if n and own not in seen:
                    if len(seen) >= SEEN:
                        seen = set()
                    seen.add(own)
                    for side, (at, m, _) in enumerate(places):
                        keys.append(segment_keys(shingles, at, m))
                        owners.append(np.full(m, own, np.int64))
                        sides.append(np.full(m, side, np.int8))
                        waiting += m
                if waiting > 200_000:
                    yield _sent(keys, owners, sides, extra_at, extra)
                    keys, owners, sides, extra_at, extra, waiting = [], [], [], [], [], 0
            if extra:
                yield _sent(keys, owners, sides, extra_at, extra)

    return sketch


def _sent(keys, owners, sides, extra_at, extra) -> pa.RecordBatch:
    plain = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
    own = np.concatenate([*owners, np.zeros(0, np.int64)])
    side = np.concatenate([*sides, np.zeros(len(extra), np.int8)])
    at = np.array(extra_at, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([plain, at[:, 0]])),
            pa.array(np.concatenate([own, at[:, 1]])),
            pa.array(side),
            pa.array([None] * len(plain) + extra, pa.binary()),
        ],
        ["key", "own", "side", "extra"],
    )


def _shared(batches):
    """From rows sorted by key: those whose key two or more sets have, and all information.

    Rows of one key may come in several batches: as long as all are of one set, the last stands for
    them. A set may be given more than once for a key that goes over the end of a batch.
    """
    held, linked = None, False  # the last row, and whether its key is known to be shared
    fields = ["key", "own", "side", "known", "id", "n", "quota0", "quota1", "b0", "b1", "b2", "b3"]

    def out(keys, own, side, info) -> pa.RecordBatch:
        rows = [struct.unpack(_INFO, x) for x in info[1]]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(9)]
        blank = [None] * len(keys)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*keys.tolist(), *[None] * len(rows)], pa.int64()),
                pa.array([*own.tolist(), *info[0]], pa.int64()),
                pa.array([*side.tolist(), *[None] * len(rows)], pa.int64()),
                pa.array([*blank, *columns[0]], pa.bool_()),
                *[pa.array([*blank, *c], pa.int64()) for c in columns[1:]],
            ],
            fields,
        )

    for batch in batches:
        extra = batch.column("extra")
        is_info = extra.is_valid().to_numpy(zero_copy_only=False)
        rows = np.stack([batch.column(c).to_numpy()[~is_info].astype(np.int64) for c in ("key", "own", "side")])
        info = batch.column("own").to_numpy()[is_info].tolist(), extra.filter(pa.array(is_info)).to_pylist()
        if rows.shape[1]:
            begins = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
            least, most = np.minimum.reduceat(rows[1], begins), np.maximum.reduceat(rows[1], begins)
            shared = least != most
            before = rows[:, :0]
            if held is not None and held[0, 0] == rows[0, 0]:
                shared[0] |= linked or held[1, 0] != least[0]
                if shared[0] and not linked:
                    before = held
            held, linked = rows[:, -1:], bool(shared[-1])
            kept = np.concatenate([before, rows[:, np.repeat(shared, np.diff(np.append(begins, rows.shape[1])))]], 1)
            yield out(*np.unique(kept, axis=1), info) if kept.shape[1] else out(*kept, info)
        else:
            yield out(*rows, info)


def wide_parity(shingles: np.ndarray) -> np.ndarray:
    """Parity bits as words, 2 to 4 bits for each shingle; a power of two, so that halves fold onto
    each other to the bits of a smaller set."""
    width = 64 << (max(len(shingles) - 1, 0) >> 5).bit_length()
    flipped = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(flipped.astype(np.uint8), bitorder="little").view("<i8")


def _arrays(flat: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, flat)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*flat, np.zeros(0, np.int64)])))


def _sets(batches):
    """The shingles and parity bits of sets; rows whose text is another one under the same id are left out."""
    for batch in batches:
        made, owns = list(shingle_sets(strings(batch))), batch.column("own").to_pylist()
        right = [i for i, x in enumerate(made) if set_hash(x) == owns[i]]
        kept = [made[i] for i in right]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("own").take(pa.array(right, pa.int64())),
                pa.array([len(x) for x in kept], pa.int64()),
                _arrays([wide_parity(x) for x in kept]),
                _arrays([x.view(np.int64) for x in kept]),
            ],
            ["own", "n", "flips", "shingles"],
        )


def _prefixes(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """The shared segments among the first of each set, in order of how many sets have them.

    Segments that a set shares with nobody come first, so they leave less, often nothing, to join on.
    """
    counts = shared.groupBy("key").agg(F.count("*").alias("sets"))
    counted = shared.join(counts, "key")
    of_set = Window.partitionBy("own", "side")
    ranked = counted.select(
        "key",
        "own",
        "side",
        F.count("*").over(of_set).alias("many"),
        F.row_number().over(of_set.orderBy("sets", "key")).alias("rank"),
    )
    quota = F.when(F.col("side") == 0, F.col("quota0")).otherwise(F.col("quota1"))
    kept = ranked.join(classes.select("own", "quota0", "quota1"), "own").filter(F.col("rank") <= quota + F.col("many"))
    return stored(kept.select("key", "own").distinct(), "near-prefixes")


def _one_key_each(shared: DataFrame) -> DataFrame:
    """Of the keys that the same sets have, the smallest; keys of a single set go.

    Sets of sets are told apart by their size and two 64-bit sums of hashes.
    """
    held = shared.groupBy("key").agg(
        F.count("*").alias("sets"),
        *[F.bit_xor(F.xxhash64("own", F.lit(i))).alias(f"sum{i}") for i in range(2)],
    )
    kept = held.filter("sets > 1").groupBy("sets", "sum0", "sum1").agg(F.min("key").alias("key"))
    return stored(shared.join(kept.select("key"), "key", "left_semi"), "near-keys")


def _may_hold(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows with an ``id`` of ``wanted``, and few others: what is not wanted need not be shuffled.

    By a bitmap of hashed ids, 64 bits for each up to MOST_SLOTS, which lets the more pass
    the fuller it is; the join behind it decides.
    """
    slots = min(MOST_SLOTS, 64 * wanted.count() + 1)
    slot = F.pmod(F.xxhash64("id"), F.lit(slots))
    bits = wanted.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")
    )
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(bits), F.bitmap_bucket_number(slot) == F.col("bucket"))
    return met.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def _bucketed(sets: DataFrame) -> str:
    """Name of a table of the sets, each once, bucketed by name, so that no verification shuffles them again."""
    spark = sets.sparkSession
    name = f"near_sets_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_removed(spark):
        sets.dropDuplicates(["own"]).write.bucketBy(parts, "own").sortBy("own").format("parquet").saveAsTable(name)
    return name


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b with the sizes of what both sets share and of both together."""
    a = sets.select(F.col("own").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("own").alias("b"), F.col("shingles").alias("set_b"))
    met = pairs.join(b, "b").join(a, "a")
    both = F.size(F.array_intersect("set_a", "set_b")).cast("bigint")
    return met.select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b") - both).alias("either"))


def _tightened(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, least with the lower bound of their distance raised by the wide parity bits.

    The 256 bits of ``_least_apart`` tell little of large sets. These grow with the set, and are a
    sixteenth of its shingles or less, so that pairs that are far apart meet by them alone.
    """

    def folded(one: str, two: str):
        half = (F.size(one) / 2).cast("int")
        halves = F.slice(one, F.lit(1), half), F.slice(one, half + 1, half)
        return F.when(F.size(one) == 2 * F.size(two), F.zip_with(*halves, lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(one))

    a, b = (
        sets.select(F.col("own").alias(x), F.col("n").alias(f"n_{x}"), F.col("flips").alias(f"flips_{x}")) for x in "ab"
    )
    met = pairs.join(b, "b", "left").join(a, "a", "left")
    differ = F.zip_with(folded("flips_a", "flips_b"), folded("flips_b", "flips_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    # Of other lengths, which sizes far apart have, nothing is known: 0.
    flipped = F.coalesce(F.aggregate(differ, F.lit(0), lambda total, x: total + x), F.lit(0))
    bound = 2 * flipped / (F.col("n_a") + F.col("n_b") + flipped)
    return met.select("a", "b", F.greatest("least", bound).alias("least"))


_TRAITS = ("n", "b0", "b1", "b2", "b3")


def _least_apart(one: str, two: str):
    """A lower bound of the Jaccard distance of two sets, from their sizes and parity bits."""
    flipped = F.bit_count(F.col(f"b0{one}").bitwiseXOR(F.col(f"b0{two}")))
    for i in range(1, 4):
        flipped = flipped + F.bit_count(F.col(f"b{i}{one}").bitwiseXOR(F.col(f"b{i}{two}")))
    n, m = F.col(f"n{one}"), F.col(f"n{two}")
    return F.greatest(1 - F.least(n, m) / F.greatest(n, m), 2 * flipped / (n + m + flipped))


def _near(percent: int):
    return F.col("both") * 100 >= F.col("either") * percent


def near_duplicates(
    documents: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """id, n_shingles, component_id for every row: the smallest id reachable by links of at least
    ``percent`` per cent Jaccard similarity.

    Ids are whole numbers. Texts without words have no shingles and are linked with nothing; a NULL
    id keeps its row, counts for no component's smallest id, and shows its component's. Repeated
    rows are kept and linked like copies.
    """
    source = id_text(documents, id_column, text_column).withColumn("id", F.col("id").cast("bigint"))
    sent = source.mapInArrow(_sketch(percent), "key bigint, own bigint, side tinyint, extra binary")
    longs = "id bigint, n bigint, quota0 bigint, quota1 bigint, b0 bigint, b1 bigint, b2 bigint, b3 bigint"
    table = f"key bigint, own bigint, side bigint, known boolean, {longs}"
    met = stored(sent.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, table), "near-shared")
    info = met.filter("key IS NULL").withColumn("id", F.when(F.col("known"), F.col("id"))).drop("key", "side", "known")
    info = stored(info, "near-rows")
    classes = info.filter("n > 0").groupBy("own").agg(
        F.min("id").alias("first_id"), *[F.first(c).alias(c) for c in (*_TRAITS, "quota0", "quota1")]
    )
    classes = stored(classes, "near-sets")
    prefixes = _prefixes(met.filter("key IS NOT NULL").select("key", "own", "side"), classes)
    dropped(met)
    active = _one_key_each(prefixes)
    dropped(prefixes)
    wanted = active.select("own").distinct().join(classes, "own").select("own", F.col("first_id").alias("id"), *_TRAITS)
    wanted = stored(wanted, "near-wanted")
    held = _may_hold(source, wanted.select("id"))
    texts = held.join(wanted.select("own", F.col("id").alias("first_id")), F.col("id").eqNullSafe(F.col("first_id")))
    shape = "own bigint, n bigint, flips array<bigint>, shingles array<bigint>"
    table_of_sets = _bucketed(texts.select("own", "text").mapInArrow(_sets, shape))
    sets = documents.sparkSession.table(table_of_sets)
    groups = _linked(active, wanted.select("own", *_TRAITS), sets, percent)
    grouped = classes.join(groups, classes["own"] == groups["node"], "left").select(
        "own", "first_id", F.coalesce("component", "own").alias("component")
    )
    grouped = stored(grouped, "near-classes")
    dropped(groups, wanted, classes)
    documents.sparkSession.sql(f"DROP TABLE {table_of_sets}")
    smallest = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labelled = grouped.join(smallest, "component").select("own", "component_id")
    alone = info.filter("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    rows = info.filter("n > 0").join(labelled, "own").select("id", F.col("n").alias("n_shingles"), "component_id")
    return rows.unionByName(alone)


def _linked(active: DataFrame, traits: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, component for every set that is linked with another.

    ``active``, a stored table that is dropped here, has the keys (key, own) that sets are compared at: whatever it lacks of a set has been
    compared there, or cannot be near, or lies in the set's component.
    """
    limit = 1 - percent / 100
    least = _least_apart("_a", "_b")

    def with_traits(df: DataFrame, name: str) -> DataFrame:
        return df.join(traits.select(F.col("own").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in _TRAITS]), name)

    linked, before, table = None, None, active
    active = active.withColumn("part", F.col("own"))
    while True:
        rows = active.count()
        if before is not None and (not rows or rows > WORTH * before):
            break
        before = rows
        stays, found = _led(active, with_traits, sets, least, limit, percent)
        dropped(table)
        edges = found.filter(_near(percent)).select("a", "b")
        if linked is not None:
            edges = edges.unionByName(linked.select(F.col("node").alias("a"), F.col("component").alias("b")))
        past, linked = linked, stored(connected_components(edges), "near-groups")
        dropped(found, *([past] if past is not None else []))
        known = stays.select("own").distinct().join(linked.withColumnRenamed("node", "own"), "own", "left")
        active = stays.select("key", "own").join(
            known.select("own", F.coalesce("component", "own").alias("part")), "own"
        )
        # What is in one component needs no more comparison among itself.
        several = active.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).filter("least < most")
        active = table = stored(active.join(several.select("key"), "key", "left_semi"), "near-left")
        dropped(stays)
    # The rest. Sets carry their smallest keys: a pair that has one of them in common meets at the
    # first of those only, others, which share few keys, at each.
    smallest = F.slice(F.array_sort(F.collect_list("key")), F.lit(1), F.lit(CARRIED))
    placed = active.join(active.groupBy("own").agg(smallest.alias("keys")), "own")
    one = with_traits(placed.select("key", F.col("own").alias("a"), F.col("part").alias("part_a"), F.col("keys").alias("keys_a")), "a")
    two = with_traits(placed.select("key", F.col("own").alias("b"), F.col("part").alias("part_b"), F.col("keys").alias("keys_b")), "b")
    apart = (F.col("a") < F.col("b")) & (F.col("part_a") != F.col("part_b")) & (least <= limit + 1e-9)
    first = F.coalesce(F.array_min(F.array_intersect("keys_a", "keys_b")) == one["key"], F.lit(True))
    rest = one.join(two, (one["key"] == two["key"]) & apart & first).select("a", "b").distinct()
    rest = stored(_tightened(rest.withColumn("least", F.lit(0.0)), sets).filter(F.col("least") <= limit + 1e-9), "near-rest")
    edges = _verified(rest.select("a", "b"), sets).filter(_near(percent)).select("a", "b")
    edges = edges.unionByName(linked.select(F.col("node").alias("a"), F.col("component").alias("b")))
    groups = stored(connected_components(edges), "near-groups")
    dropped(table, linked, rest)
    return groups


def _led(active: DataFrame, with_traits, sets: DataFrame, least, limit: float, percent: int):
    """A round: every set meets the leader of each of its keys. What stays active, and what was found
    of pairs (a, b, both, either); both stored.

    A leader is a set of a component of its own if there is one. It has met everyone, so it leaves
    its key. So does a set that is near the leader, if even the nearest of those that are not is
    too far from the leader to be near the set.
    """
    led = active.groupBy("key").agg(F.min(F.struct(F.col("part") != F.col("own"), "own", "part")).alias("led"))
    led = led.select("key", F.col("led.own").alias("leader"), F.col("led.part").alias("leader_part"))
    led = stored(led, "near-leaders")
    met = active.join(led, "key").filter("part != leader_part")
    a, b = F.least("own", "leader").alias("a"), F.greatest("own", "leader").alias("b")
    met = stored(met.select("key", "own", "leader", a, b), "near-met")
    pairs = with_traits(with_traits(met.select("a", "b").distinct(), "a"), "b").select("a", "b", least.alias("least"))
    bounded = stored(pairs, "near-bounded")
    close = F.col("least") <= limit + 1e-9
    pairs = stored(bounded.filter(~close).unionByName(_tightened(bounded.filter(close), sets)), "near-pairs")
    found = stored(_verified(pairs.filter(close).select("a", "b"), sets), "near-star")
    # Pairs whose sizes and parity bits keep them apart have a lower bound of their distance,
    # which is on the safe side wherever it is used below.
    distance = F.coalesce(1 - F.col("both") / F.col("either"), F.col("least"))
    near = F.coalesce(_near(percent), F.lit(False))
    judged = met.join(
        pairs.join(found, ["a", "b"], "left").select("a", "b", distance.alias("apart"), near.alias("near")), ["a", "b"]
    )
    border = judged.filter(~F.col("near")).groupBy("key", "leader").agg(F.min("apart").alias("border"))
    inside = judged.filter("near").join(border, ["key", "leader"], "left").filter(
        F.col("border").isNull() | (F.col("apart") < F.col("border") - limit - 1e-9)
    )
    gone = inside.select("key", "own").unionByName(led.select("key", F.col("leader").alias("own")))
    stays = active.join(gone, ["key", "own"], "left_anti")
    stays = stored(stays, "near-stay")
    dropped(led, met, bounded, pairs)
    return stays, found


def one_of_each(documents: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows whose id is the smallest of their component, all columns kept.

    Rows that repeat an id with the same text are reduced to one; rows of one id with different
    texts stay together. Rows with a NULL id cannot be told apart by it: they all stay. Columns
    may have any names; an empty table gives an empty one.
    """
    kept_id, copy = unused(documents, "kept_id"), unused(documents, "copy")
    found = near_duplicates(documents, percent, id_column, text_column)
    kept = found.filter(F.col("id") == F.col("component_id")).select(F.col("id").alias(kept_id)).distinct()
    key = named(id_column).cast("bigint")
    rows = documents.join(kept, key == F.col(kept_id), "left_semi")
    same = Window.partitionBy(key, F.xxhash64(named(text_column))).orderBy(F.lit(0))
    first = rows.withColumn(copy, F.row_number().over(same)).filter(F.col(copy) == 1).drop(copy)
    return first.unionByName(documents.filter(key.isNull()))
