"""Near-duplicate groups by MinHash bands, verified by odd sketches and then on full sets.

A document's set is its distinct shingles of `WORDS` words. Documents with equal sets form a class, a
node of its own whatever the ids, and from then on only classes are compared. A class has
`BANDS * ROWS` MinHash samples: ROWS in a row make a band's key, and classes that share a key are
candidates. Up to SAMPLES further samples are folded into an odd sketch: each flips one bit, chosen by
a hash of its range and value, so two sketches differ in two bits for each sample that differs, and the
population count of their XOR estimates the similarity. A second sketch takes all items as samples, which
is more precise for small sets. Candidates whose sketches differ in more bits than similar pairs' do are
dropped, and the rest are compared on full sets.

A bucket's members aren't all paired. First each is compared with the bucket's smallest member, and
components are formed. Then only pairs in different components are compared, and the bucket's largest
component isn't paired with itself. Pairs in one component can't change the result, so a large group of
copies costs one comparison for each member. A bucket where that would still take more than `PAIRED`
pairs for each member, such as many unlike documents of one template, isn't paired at all. Its members
go into an exact join instead: with the items of every set in one order, rarest first, two similar sets
share an item among the first few, fewer for the smaller set. Nodes of items that are crowded in turn,
since documents consist of common passages alone, meet by those items or by the bands they share,
whichever takes fewer comparisons. Those comparisons, of sketches, can be as many as the square of a group.

A pair of similarity 0.8 shares no band with probability (1 - 0.8**ROWS)**BANDS, below 1e-4, and a more
similar one far more rarely. Defined cases: null text and text without words have an empty set, linked
with nothing; a text with fewer words than WORDS is one shingle. In `groups`, an id is one document:
rows that share it are linked through it, whatever their texts, and rows with a null id are linked with
nothing. In `deduplicated`, texts alone link: a repeated id with another text stays, rows that repeat
both are one, rows without words or without an id stay. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, arrow_map, columns, discard, text_bytes, written
from .components import components

WORDS = 5
#: What the registered query states its links by.
QUERY_WORDS = 2
SIMILAR = (80, 100)
BANDS, ROWS = 24, 5
SAMPLES = 512
SKETCH_LONGS = 16
SKETCH_BITS = 64 * SKETCH_LONGS
DEVIATIONS = 5.0
WHOLE_TABLE = 1 << 13
#: Rows are chosen by a broadcast of up to this many ids of 24 bytes, else by a shuffled join.
BROADCAST_IDS = 200_000
#: Pairs for each member of a bucket, up to which its components are paired directly.
PAIRED = 16
#: Counters that rank items by frequency; a shared counter costs speed, not results.
SLOTS = 1 << 20
SET = ("n", "h1", "h2")
CACHE_WORDS = 200_000
CHUNK = 1 << 12
_RNG = np.random.default_rng(8)
_A = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_BAND = _RNG.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SAMPLED, WHOLE = [f"s{i}" for i in range(SKETCH_LONGS)], [f"t{i}" for i in range(SKETCH_LONGS)]
SKETCHES = SAMPLED + WHOLE
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    tokens = text.translate(LOWER).split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    if len(_words) > CACHE_WORDS:
        _words.clear()
    known = _words
    numbers = []
    for t in tokens:
        h = known.get(t)
        if h is None:
            h = known[t] = xxhash.xxh3_64_intdigest(t)
        numbers.append(h)
    h = np.array(numbers, dtype=np.uint64)
    n = min(words, len(h))
    total = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        total = _mix(total * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - n + 1 + i])
    return np.unique(total)


def samples(items: np.ndarray) -> np.ndarray:
    """The MinHash samples of a non-empty set."""
    out = np.full(len(_A), np.iinfo(np.uint64).max, dtype=np.uint64)
    for first in range(0, len(items), CHUNK):
        some = items[first : first + CHUNK]
        out = np.minimum(out, (some[:, None] * _A + _B).min(axis=0))
    return out >> np.uint64(16)


def band_keys(values: np.ndarray) -> np.ndarray:
    mixed = _mix(values.reshape(BANDS, ROWS) * _BAND + _BAND)
    return _mix(mixed.sum(axis=1, dtype=np.uint64) + _BAND[:, 0]).view(np.int64)


def _folded(values: np.ndarray) -> np.ndarray:
    at = (_mix(values) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def whole_sketch(items: np.ndarray) -> np.ndarray:
    """The odd sketch with every item a sample: precise for sets of up to a few thousand items."""
    return _folded(items + _A[1])


def odd_sketch(items: np.ndarray) -> tuple[int, np.ndarray]:
    """(number of samples, sketch as longs). Samples are the least hash in each of SAMPLES ranges of hashes
    (one-permutation MinHash), so a set that is much smaller is sampled nearly whole."""
    ordered = np.sort(_mix(items * _A[0] + _B[0]))
    ranges = ordered >> np.uint64(64 - SAMPLES.bit_length() + 1)
    least = ordered[np.concatenate([[True], ranges[1:] != ranges[:-1]])]
    return len(least), _folded(least)


def estimate(differing_bits: int, samples_of_both: int) -> float:
    """The similarity that sketches suggest which differ in so many bits. A range that differs flips two
    bits, or one if it is empty in one of the sets, as most are in small sets."""
    flips = -SKETCH_BITS / 2 * float(np.log1p(-min(2 * differing_bits / SKETCH_BITS, 1 - 1e-9)))
    same = max(0.0, (samples_of_both - flips) / 2)
    full = min(1.0, samples_of_both / (2 * SAMPLES))
    return same / max(1e-9, same + flips * (1 - full / 2))


def _bits_after(flips: float) -> int:
    """Differing bits that so many flips exceed less than once in a million times: some bits flip twice."""
    spread = min(flips * np.sqrt(2 / SKETCH_BITS), np.sqrt(SKETCH_BITS) / 2)
    return int(min(flips, SKETCH_BITS / 2 * (1 - np.exp(-2 * flips / SKETCH_BITS)) + DEVIATIONS * spread))


def most_bits(samples_of_both: int) -> int:
    """What a pair of similarity 0.8 or more differs by, at most, in its sampled sketches.

    Of e ranges in use about e / 5 differ, with the deviation of a binomial; e is at least half the
    samples of both.
    """
    e, apart = samples_of_both / 2, 1 - SIMILAR[0] / SIMILAR[1]
    return _bits_after(2 * (apart * e + DEVIATIONS * np.sqrt(apart * (1 - apart) * e)))


def most_bits_whole(items_of_both: int) -> int:
    """The same for whole sketches: the items that only one set has flip a bit each."""
    return _bits_after(items_of_both * (SIMILAR[1] - SIMILAR[0]) // (SIMILAR[1] + SIMILAR[0]))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b) or SIMILAR[1] * min(len(a), len(b)) < SIMILAR[0] * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def place() -> Column:
    """A hash of the text: with the id, it names a row up to its repetitions."""
    return F.xxhash64(text_bytes())


def features(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, place, n (size of the set), h1 and h2 (a hash of the set), bands, samples, s0 to s15 and t0 to t15 (sketches)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hashes, bands, counts, sketches = [], [], [], [], []
            for text in batch["text"]:
                items = shingles(text.as_buffer().to_pybytes(), words)
                n.append(len(items))
                hashes.append(np.frombuffer(hashlib.blake2b(items.tobytes(), digest_size=16).digest(), dtype=np.int64))
                bands.append(band_keys(samples(items)) if len(items) else np.zeros(0, dtype=np.int64))
                count, sketch = odd_sketch(items) if len(items) else (0, np.zeros(SKETCH_LONGS, dtype=np.int64))
                counts.append(count)
                sketches.append(np.concatenate([sketch, whole_sketch(items)]))
            longs = np.concatenate([np.array(hashes).reshape(-1, 2), np.array(sketches).reshape(-1, 2 * SKETCH_LONGS)], axis=1)
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands) if bands else np.zeros(0, dtype=np.int64)))
            h1, h2, *sketch = [pa.array(c) for c in longs.T]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["place"], pa.array(n, pa.int64()), h1, h2, lists, pa.array(counts, pa.int32()), *sketch], names=names)

    names = ["doc_id", "place", "n", "h1", "h2", "bands", "samples", *SKETCHES]
    texts = docs.select(F.col("doc_id").cast("bigint"), place().alias("place"), text_bytes().alias("text"))
    schema = "doc_id bigint, place bigint, n bigint, h1 bigint, h2 bigint, bands array<bigint>, samples int, " + ", ".join(f"{s} bigint" for s in SKETCHES)
    return arrow_map(texts, run, schema)


def _differing(a: str, b: str, sketch: list[str]) -> Column:
    counts = [F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in sketch]
    return sum(counts[1:], counts[0])


def _sizes_allow(n: Column, m: Column) -> Column:
    return SIMILAR[1] * F.least(n, m) >= SIMILAR[0] * F.greatest(n, m)


def _table(values: list[int]) -> Column:
    """A constant array, as one literal: thousands of literals would take seconds to make."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _close(a: str, b: str) -> Column:
    """What set sizes and sketches leave possible."""
    both = lambda c: F.col(f"{a}.{c}") + F.col(f"{b}.{c}")
    # Beyond the table's end a whole sketch is full and tells nothing.
    whole = F.coalesce(F.get(_table([most_bits_whole(k) for k in range(WHOLE_TABLE)]), both("n").cast("int")), F.lit(SKETCH_BITS))
    sampled = F.get(_table([most_bits(k) for k in range(2 * SAMPLES + 1)]), both("samples"))
    return _sizes_allow(F.col(f"{a}.n"), F.col(f"{b}.n")) & (_differing(a, b, WHOLE) <= whole) & (_differing(a, b, SAMPLED) <= sampled)


def _chosen(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is in a written table of ids (one column), where ids may repeat."""
    ids = ids.toDF("__id")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    else:
        ids = written(ids.distinct(), "near-ids")
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return df.join(ids, F.col(column) == F.col("__id"), "left_semi")


def _ends(pairs: DataFrame) -> DataFrame:
    """The nodes of pairs, each as often as it occurs."""
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))


class Sets:
    """The documents' sets: their features by row, and their classes.

    A class's node is the row number of its document with the smallest id; `least` and `place` find that
    document's text again.
    """

    def __init__(self, docs: DataFrame, words: int):
        self.words = words
        self.texts = docs.select(F.col("doc_id").cast("bigint"), place().alias("place"), text_bytes().alias("text"))
        self.rows = written(features(docs, words).withColumn("rid", F.monotonically_increasing_id()), "near-features")
        first = F.min(F.struct("doc_id", "rid", "place")).alias("first")
        classes = self.real_rows().groupBy(*SET).agg(first, F.first("bands").alias("bands"))
        self.classes = written(
            classes.select(*SET, F.col("first.rid").alias("node"), F.col("first.doc_id").alias("least"), F.col("first.place").alias("place"), "bands"),
            "near-classes",
        )

    def real_rows(self) -> DataFrame:
        return self.rows.where("n > 0 AND doc_id IS NOT NULL")

    def linked_by_id(self) -> DataFrame | None:
        """Links (a, b) of classes that hold rows of one id; None if every id has one set."""
        which = F.xxhash64(*SET)
        ids = self.real_rows().groupBy("doc_id").agg(F.min(which).alias("low"), F.max(which).alias("high")).where("low <> high").select("doc_id")
        ids = written(ids, "near-ids")
        if ids.isEmpty():
            return None
        nodes = _chosen(self.real_rows().select("doc_id", *SET), "doc_id", ids).join(self.classes.select(*SET, "node"), list(SET)).select("doc_id", "node")
        nodes = written(nodes.distinct(), "near-id-nodes")
        hubs = nodes.groupBy("doc_id").agg(F.min("node").alias("b"))
        return nodes.join(hubs, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")

    def close(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes that their sketches leave possible."""
        some = self.rows.select(F.col("rid").alias("node"), "n", "samples", *SKETCHES)
        sketches = written(_chosen(some, "node", _ends(pairs)), "near-sketches")
        joined = pairs.alias("p").join(sketches.alias("x"), F.col("p.a") == F.col("x.node"))
        joined = joined.join(sketches.alias("y"), (F.col("p.b") == F.col("y.node")) & _close("x", "y"))
        out = written(joined.select("p.a", "p.b"), "near-close")
        discard(sketches)
        return out

    def with_sketches(self, members: DataFrame) -> DataFrame:
        """Members of keys with the sketches of their nodes."""
        some = self.rows.select(F.col("rid").alias("node"), "samples", *SKETCHES)
        return members.join(_chosen(some, "node", members.select("node")), "node")

    def texts_of(self, nodes: DataFrame) -> DataFrame:
        """(node, text) of the nodes in a written table, where nodes may repeat; written, each node once."""
        wanted = written(_chosen(self.classes.select("node", "least", F.col("place").alias("at")), "node", nodes), "near-wanted")
        n = wanted.count()
        small = F.broadcast(wanted) if n <= BROADCAST_IDS else wanted
        found = self.texts.join(small, (F.col("doc_id") == F.col("least")) & (F.col("place") == F.col("at"))).select("node", "text")
        found = written(found, "near-texts")
        if found.count() == n:
            return found
        # Rows that repeat both id and text.
        once = written(found.groupBy("node").agg(F.first("text").alias("text")), "near-texts")
        discard(found)
        return once

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes whose full sets are similar."""
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, items = None, None
            for batch in batches:
                keep = []
                for b, one, other in zip(batch["b"].to_pylist(), batch["text_a"], batch["text_b"]):
                    if b != last:
                        last, items = b, shingles(other.as_buffer().to_pybytes(), words)
                    keep.append(similar(shingles(one.as_buffer().to_pybytes(), words), items))
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        texts = self.texts_of(_ends(pairs))
        # The text of b is joined last, and the rows of a b arrive together; a crowded b is split by AQE.
        one, other = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        joined = pairs.join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b")
        out = written(arrow_map(joined, run, "a bigint, b bigint"), "near-links")
        discard(texts)
        return out


def _components_apart(members: DataFrame) -> DataFrame:
    """(key, main, work, few) of keys whose members are in several components: the largest of them, the
    pairs that pairing the components takes, and whether those are at most PAIRED for each member. Only
    counts meet by key."""
    counts = members.groupBy("key", "component").agg(F.count(F.lit(1)).cast("double").alias("all"), F.count_if("early").cast("double").alias("early"))
    main = F.max(F.struct("all", "early", "component")).alias("main")
    keys = counts.groupBy("key").agg(main, F.sum("all").alias("all"), F.sum("early").alias("early"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    work = (F.col("all") - F.col("main.all")) * F.col("early") + F.col("main.all") * (F.col("early") - F.col("main.early"))
    few = work <= PAIRED * (F.col("all") + F.col("early"))
    return written(keys.select("key", F.col("main.component").alias("main"), work.alias("work"), few.alias("few")), "near-keys")


def _pairs_apart(members: DataFrame, keys: DataFrame, sets: Sets) -> DataFrame:
    """Pairs (a, b) of members of a key in different components, b the smaller set and `early`, whose sketches
    leave possible that they are similar; the main component's members meet the others' only. Sketches are
    compared where members meet, so pairs that they drop are never put out."""
    placed = members.join(keys.select("key", "main"), "key").withColumn("stray", F.col("component") != F.col("main"))
    placed = sets.with_sketches(written(placed.select("key", "node", "n", "component", "early", "stray"), "near-meeting"))
    meets = F.explode(F.when(F.col("stray"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("meets")
    sketch = ["samples", *SKETCHES]
    x, y = placed.select("key", "node", "n", "component", *sketch, meets).alias("x"), placed.where("early").alias("y")
    larger = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    apart = (F.col("x.component") != F.col("y.component")) & larger & _close("x", "y")
    found = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.meets") == F.col("y.stray")) & apart)
    return found.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def prefix_lengths(n: int) -> tuple[int, int]:
    """Of the first so many items of a set of n, one is shared by any similar set that is no larger, and
    of the first so many by any that is no smaller."""
    larger = n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1
    smaller = n - -(-2 * SIMILAR[0] * n // (SIMILAR[0] + SIMILAR[1])) + 1
    return larger, smaller


def _rare_items(nodes: DataFrame, sets: Sets) -> DataFrame:
    """(key, node, n, component, early) of the first items of each node's set, rarest first; `early` marks
    those that the smaller set of a similar pair shares. Frequencies cover all of the nodes' sets."""
    words = sets.words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                np.add.at(seen, (shingles(text.as_buffer().to_pybytes(), words) % np.uint64(SLOTS)).astype(np.int64), 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["slot", "c"])

    texts = sets.texts_of(nodes.select("node"))
    # A table of SLOTS counts at most, whatever the number of sets.
    table = arrow_map(texts.select("text"), count, "slot bigint, c bigint").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    frequency = np.zeros(SLOTS, dtype=np.int64)
    frequency[table["slot"].to_numpy()] = table["c"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(frequency)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch["text"]):
                items = shingles(text.as_buffer().to_pybytes(), words)
                order = np.lexsort((items, shared.value[(items % np.uint64(SLOTS)).astype(np.int64)]))
                probe, early = prefix_lengths(len(items))
                some = items[order[:probe]].view(np.int64)
                same = [pa.array([batch[c][k].as_py()] * len(some), pa.int64()) for c in ("node", "n", "component")]
                yield pa.RecordBatch.from_arrays([pa.array(some), *same, pa.array(np.arange(len(some)) < early)], names=["key", "node", "n", "component", "early"])

    items = arrow_map(nodes.join(texts, "node").select("node", "n", "component", "text"), first, "key bigint, node bigint, n bigint, component bigint, early boolean")
    out = written(items, "near-items")
    discard(texts)
    return out


def _total_work(keys: DataFrame) -> float:
    return keys.agg(F.sum("work")).first()[0] or 0.0


def _item_pairs(bands: DataFrame, sets: Sets) -> DataFrame:
    """Pairs (a, b) of the members (key, node, n, component) of crowded bands, through items of their sets.

    Nodes of crowded items meet by item or by band, whichever takes fewer comparisons of all of them: a pair
    that shares one of these items and a crowded band meets either way."""
    one = [F.first(c).alias(c) for c in ("n", "component")]
    nodes = written(bands.groupBy("node").agg(*one, F.collect_list("key").alias("bands")), "near-nodes")
    items = _rare_items(nodes, sets)
    keys = _components_apart(items)
    common = keys.where("NOT few")
    if common.isEmpty():
        return _pairs_apart(items, keys, sets)
    again = nodes.join(items.join(common.select("key"), "key", "left_semi").select("node").distinct(), "node", "left_semi")
    again = written(again.select(F.explode("bands").alias("key"), "node", "n", "component", F.lit(True).alias("early")), "near-common")
    by_band = _components_apart(again)
    if _total_work(common) <= _total_work(by_band):
        return _pairs_apart(items, keys, sets)
    return _pairs_apart(items, keys.where("few"), sets).unionByName(_pairs_apart(again, by_band, sets))


def _late_pairs(members: DataFrame, found: DataFrame, sets: Sets) -> DataFrame:
    """Pairs (a, b) of nodes that share a band and that no link connects yet, however indirectly, as far as
    their sketches leave them possible."""
    placed = members.join(found, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"), F.lit(True).alias("early"))
    placed = written(placed, "near-placed")
    keys = _components_apart(placed)
    pairs = _pairs_apart(placed, keys.where("few"), sets)
    crowded = keys.where("NOT few")
    if not crowded.isEmpty():
        pairs = pairs.unionByName(_item_pairs(placed.join(crowded.select("key"), "key"), sets))
    return written(pairs.distinct(), "near-late")


def components_of(sets: Sets, by_id: bool) -> DataFrame:
    """n, h1, h2, least, place, node, component of every class; linked through shared ids too if `by_id`."""
    classes = sets.classes
    members = classes.select("node", "n", F.explode("bands").alias("key"))
    centre = F.min(F.struct("node", "n")).alias("centre")
    buckets = written(members.groupBy("key").agg(centre, F.count(F.lit(1)).alias("size")).where("size > 1"), "near-buckets")
    crowded = written(members.join(buckets, "key"), "near-members")
    stars = crowded.where((F.col("node") != F.col("centre.node")) & _sizes_allow(F.col("n"), F.col("centre.n")))
    stars = written(stars.select(F.col("node").alias("a"), F.col("centre.node").alias("b")).distinct(), "near-stars")
    links = sets.verified(sets.close(stars))
    if by_id and (more := sets.linked_by_id()) is not None:
        links = links.unionByName(more)
    found = written(components(links, "a", "b"), "near-components")
    late = _late_pairs(crowded.where("size > 2"), found, sets)
    if not late.isEmpty():
        more = sets.verified(late)
        if not more.isEmpty():
            stars_so_far = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
            found = written(components(stars_so_far.unionByName(more), "a", "b"), "near-components")
    discard(buckets, crowded, stars, late)
    out = classes.drop("bands").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return written(out, "near-labels")


def groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    sets = Sets(docs.select("doc_id", "text"), words)
    labels = components_of(sets, by_id=True)
    least = labels.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    several = least.where("classes > 1").drop("classes")
    labels = labels.join(several, "component", "left").select(*SET, F.coalesce("component_id", "least").alias("component_id"))
    own = sets.rows.select("doc_id", *SET)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = own.join(labels, list(SET), "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One document of each group of similar texts, unchanged: that with the smallest id."""
    sets = Sets(docs.select("doc_id", "text"), words)
    kept = components_of(sets, by_id=False).groupBy("component").agg(F.min(F.struct("least", "place")).alias("first"))
    kept = kept.select(F.col("first.least").alias("__id"), F.col("first.place").alias("__place"))
    kept = kept.unionByName(sets.rows.where("n = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id"), F.col("place").alias("__place")).distinct())
    # Repeated rows are limited to one before they are dealt by id, and the join keeps that dealing.
    turn = F.row_number().over(Window.partitionBy("__id", "__place").orderBy("__place"))
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("bigint"), "__place": place()}).where("__id IS NOT NULL")
    once = keyed.withColumn("__turn", turn).where("__turn = 1")
    return once.join(kept, ["__id", "__place"], "left_semi").select(*columns(docs)).unionByName(docs.where("doc_id IS NULL"))


_TEXT = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, regexp_extract_all({_TEXT}, '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < {QUERY_WORDS} THEN [array_to_string(t, ' ')]
    ELSE list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) END AS s FROM w),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {SIMILAR[1]} * COUNT(*) >= {SIMILAR[0]} * (a.n + b.n - COUNT(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
roots AS (SELECT a AS doc_id, MIN(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d JOIN sets USING (doc_id) JOIN roots r USING (doc_id)"""
