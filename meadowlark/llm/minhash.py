"""Near-duplicate classes from DartMinHash signatures, banded joins and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, WordHasher, batches_of, forget, mix, rolling, shingle_units, signed, small_batches, stored
from .graph import connected_components

_U = np.uint64
#: Poisson(1) distribution as thresholds on 64-bit integers.
_POISSON = np.array([min(int(sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) * 2.0**64), 2**64 - 1) for n in range(16)], np.uint64)
_EMPTY = _U(2**64 - 1)


def dart_signature(units: np.ndarray, k: int = 160) -> np.ndarray:
    """DartMinHash: the rank of the earliest dart at each of ``k`` coordinates.

    ``units`` are unit-weight regions (see shingle_units). A hash of region and rank cell says how many darts, Poisson
    with mean one, fall into that unit square, and where. Equal regions get equal darts in every text, so two texts
    agree at a coordinate with the probability of their weighted Jaccard similarity. Rank cells are added until every
    coordinate has a dart; about k (ln k + 4) darts suffice, whatever the number of regions.
    """
    out = np.full(k, _EMPTY, np.uint64)
    first, cells = 0, max(1, math.ceil(k * (math.log(k) + 4) / len(units)))
    while True:
        cell = np.arange(first, first + cells, dtype=np.uint64)
        for at in range(0, len(units), 1 << 17):
            square = mix(units[at : at + (1 << 17), None] ^ mix((cell + _U(1)) * GOLDEN)).ravel()
            n = np.searchsorted(_POISSON, square, side="right")
            ends = np.cumsum(n)
            dart = mix(np.repeat(square, n) + (np.arange(ends[-1]) - np.repeat(ends - n, n) + 1).astype(np.uint64) * GOLDEN)
            at_cell = np.repeat(np.tile(cell, len(square) // len(cell)), n)
            np.minimum.at(out, ((dart >> _U(32)) * _U(k) >> _U(32)).astype(np.intp), (at_cell << _U(44)) | (mix(dart) >> _U(20)))
        if not (out == _EMPTY).any():
            return out
        first, cells = first + cells, cells * 2


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` coordinates; the band's number is part of it."""
    bands = len(signature) // rows
    mixed = mix(signature[: bands * rows].reshape(bands, rows) + np.arange(rows, dtype=np.uint64) * GOLDEN)
    key = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        key = mix(key * GOLDEN + mixed[:, i])
    return signed(key)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of unit copies; 1 if both are empty."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _signatures(size: int, k: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hasher = WordHasher()
        for batch in batches_of(batches):
            ids, sizes, keys = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                units = shingle_units((text or "").encode().split(), hasher, size)
                if len(units):
                    ids.append(doc_id)
                    sizes.append(len(units))
                    keys.append(band_keys(dart_signature(units, k), rows))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * (k // rows))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], ["node", "size", "keys"])

    return run


def _verified(size: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hasher, held, memo = WordHasher(), 0, {}

        def units(text: str) -> np.ndarray:
            nonlocal held
            if (found := memo.get(text)) is None:
                if held > 1 << 20:
                    memo.clear()
                    held = 0
                memo[text] = found = shingle_units(text.encode().split(), hasher, size)
                held += len(found) + len(text) // 8
            return found

        for batch in batches_of(batches, 256):
            texts = zip(batch.column("text_a"), batch.column("text_b"), strict=True)
            keep = pa.array([weighted_jaccard(units(a.as_py()), units(b.as_py())) >= threshold for a, b in texts], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return run


def _bitmaps(size: int, longs: int = 32):
    """The number of units of a text, and a bitmap with the bit of each unit's hash set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hasher = WordHasher()
        for batch in batches_of(batches):
            sizes, maps = [], np.zeros((batch.num_rows, longs), np.uint64)
            for row, text in zip(maps, batch.column("text"), strict=True):
                units = shingle_units(text.as_py().encode().split(), hasher, size)
                np.bitwise_or.at(row, (units >> _U(32)) % _U(longs), _U(1) << (units >> _U(58)))
                sizes.append(len(units))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * longs)
            bits = pa.ListArray.from_arrays(offsets, pa.array(signed(maps.ravel())))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes, pa.int64()), bits], ["node", "size", "bits"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, k: int = 160, rows: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id and class_id, the smallest doc_id of its class.

    Two texts are linked if the weighted Jaccard similarity of their ``shingle``-word shingles (with their numbers of
    repeats) is at least ``threshold``; classes are the connected components. Exact copies share a class without
    comparing. 32 bands of five coordinates miss a pair at the threshold with a probability of 3 in a million, and
    every link is verified on the texts.

    Inside a band's bucket not all pairs are compared. First each member meets the one with the most neighbours over
    all its buckets: of a text and its altered copies that is mostly the text. Where a bucket still holds several
    components, pairs of different ones are tried by bitmaps of their shingles: the bits that one text has alone are at
    most as many as its shingles that the other lacks. Pairs with too many of them can't reach the threshold, so leaving
    them out loses no link. The others are compared.

    Texts without words are linked only to exact copies. A null text is in a class of its own: its doc_id (null if
    that is null too). doc_id is the key: rows that repeat an id with another text count as one document.
    Rows of null doc_id take class_id from an equal text, else null. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    narrow = docs.select("doc_id", F.when(F.col("text").isNotNull(), F.sha2("text", 256)).alias("sha"))
    groups = narrow.where("sha is not null").groupBy("sha").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Null texts don't meet in the join.
    without = narrow.where("sha is null").select("doc_id", F.col("doc_id").alias("node"))
    member = stored(narrow.where("sha is not null").join(groups, "sha", "left").select("doc_id", F.coalesce("node", "doc_id").alias("node")).union(without))
    copies = member.where("doc_id <> node").select(F.col("doc_id").alias("node")).distinct()
    keys = docs.where("doc_id is not null").mapInArrow(_signatures(shingle, k, rows), "node long, size long, keys array<long>")
    banded = stored(keys.join(copies, "node", "left_anti")).select("node", "size", F.explode("keys").alias("key"))

    sizes = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", "n")
    buckets = stored(banded.join(sizes, "key"))
    nodes = stored(buckets.groupBy("node").agg(F.sum("n").alias("degree")))
    texts = stored(docs.join(nodes.select("node"), docs.doc_id == F.col("node"), "left_semi").select(F.col("doc_id").alias("node"), "text"))

    def can_link(both: Column, a: str, b: str) -> Column:
        """Whether texts of ``a`` and ``b`` units that share at most ``both`` can reach the threshold."""
        return both * (1 + threshold) + 1e-6 >= (F.col(a) + F.col(b)) * threshold

    def links(pairs: DataFrame) -> DataFrame:
        # A text with many partners is copied, one copy for so many of them, so that no task has them all.
        shares = F.ceil(F.col("n") / 1024).cast("int")
        often = stored(pairs.groupBy("a").agg(F.count("*").alias("n")).where("n > 1024").select("a", shares.alias("shares")))
        share = F.pmod(F.xxhash64("b"), F.coalesce("shares", F.lit(1))).cast("int")
        pairs = pairs.join(often, "a", "left").select("a", "b", share.alias("share"))
        sides = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).join(often, "a", "left")
        sides = sides.select("a", "text_a", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share"))
        with_a = pairs.join(sides, ["a", "share"])
        with_both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return with_both.select("a", "b", "text_a", "text_b").mapInArrow(_verified(shingle, threshold), "a long, b long")

    leaders = buckets.join(nodes, "node").groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("order"), "node", "size")).alias("leader"))
    leaders = leaders.select("key", F.col("leader.node").alias("leader"), F.col("leader.size").alias("leader_size"))
    star = buckets.join(leaders, "key").where((F.col("leader") != F.col("node")) & can_link(F.least("size", "leader_size"), "size", "leader_size"))
    tested = stored(star.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct())
    edges = stored(links(tested))
    components = connected_components(edges)

    placed = buckets.join(components, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    members = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"))
    # Of buckets with the same members one is enough.
    mixed = members.where("least < most").groupBy("n", "sum").agg(F.min("key").alias("key"))
    open_ = stored(placed.join(mixed.select("key"), "key", "left_semi"))
    longs = 32
    bitmaps = texts.join(open_.select("node").distinct(), "node", "left_semi").mapInArrow(_bitmaps(shingle, longs), "node long, size long, bits array<long>")
    one = open_.join(stored(bitmaps), "node")
    one = stored(one.select("key", "node", "component", "size", sum((F.bit_count(F.col("bits")[i]) for i in range(longs)), F.lit(0)).alias("filled"), *(F.col("bits")[i].alias(f"bits_{i}") for i in range(longs))))
    other = one.select("key", *(F.col(c).alias(f"other_{c}") for c in one.columns if c != "key"))

    # Bits that one text has alone, half of filled - other_filled + apart, are at most as many as its shingles that the other lacks.
    apart = sum((F.bit_count(F.col(f"bits_{i}").bitwiseXOR(F.col(f"other_bits_{i}"))) for i in range(longs)), F.lit(0))
    pairs = one.join(other, "key").where(
        (F.col("node") < F.col("other_node")) & (F.col("component") != F.col("other_component"))
        & can_link(F.least("size", "other_size"), "size", "other_size")
        & can_link(F.least(F.col("size") - F.col("filled") / 2 + F.col("other_filled") / 2, F.col("other_size") - F.col("other_filled") / 2 + F.col("filled") / 2) - apart / 2, "size", "other_size"))
    fresh = pairs.select(F.col("node").alias("a"), F.col("other_node").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    found = stored(links(stored(fresh)))
    if not found.isEmpty():
        components = connected_components(stored(edges.union(found)))
    return member.join(components, "node", "left").select("doc_id", F.coalesce("component", "node").alias("class_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class of near duplicates, that of the smallest doc_id; rows that repeat it go.

    Rows of null doc_id can't be named as members: one of each text stays.
    """
    classes = near_duplicates(docs, **options).where("doc_id is not null")
    # Ids that go (0) and ids of several rows; most documents are in neither.
    counts = stored(classes.groupBy("doc_id").agg(F.count_if(F.col("doc_id") == F.col("class_id")).alias("n")).where("n <> 1"))
    # The list has no bound but the number of documents, so it is never broadcast; a merge join spills.
    gone = counts.where("n = 0").select("doc_id").hint("merge")
    kept = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti")
    repeated = counts.where("n > 1").select("doc_id")
    if not repeated.isEmpty():
        kept = kept.join(repeated, "doc_id", "left_anti").union(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(docs.columns).union(docs.where("doc_id is null").dropDuplicates(["text"]))
