"""Removal of repeated word sequences: suffixes in prefix groups, and the deep nodes of each group's suffix tree."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, WordHasher, mix, rolling, signed, stored, worker_memo

#: Words of a window, of the prefixes at which suffixes start, and how many words a suffix may start inside a window.
WINDOW, SEED = 35, 8
OFFSETS = WINDOW - SEED + 1
#: Words of a suffix and of what stands before it, and the bytes of a word's hash that spell them.
AFTER, BEFORE, BYTES = WINDOW, OFFSETS - 1, 6
_U = np.uint64


def _hasher() -> WordHasher:
    """One a worker process, so that its groups share the memo."""
    return worker_memo("words", WordHasher)


def _split(docs: pa.Table) -> tuple[np.ndarray, list[list[bytes]]]:
    """The rows' order by doc_id and text, and the words of each in this order: the same on every reading of a bucket."""
    ids, texts = docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))
    return np.array(order, np.int64), [(texts[i] or "").encode().split() for i in order]


class _Words:
    """The hashes of all words of some texts in one array."""

    def __init__(self, texts: list[list[bytes]], hasher: WordHasher):
        sizes = np.array([len(words) for words in texts], np.int64)
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *map(hasher.of, texts)])
        self.sizes, self.ends = sizes, np.cumsum(sizes)
        n = max(0, len(self.hashes) - WINDOW + 1)
        #: Windows that lie inside one text.
        self.inside = np.arange(n) + WINDOW <= np.repeat(self.ends, sizes)[:n]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The least hash of the SEED-word runs of each window, and the place of the first such run."""
        if not len(self.inside):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        runs = mix(rolling(self.hashes, SEED)[0])
        least = {1: (runs, np.arange(len(runs)))}

        def join(a: tuple, b: tuple, shift: int) -> tuple:
            n = len(b[0]) - shift
            later = b[0][shift:] < a[0][:n]
            return np.where(later, b[0][shift:], a[0][:n]), np.where(later, b[1][shift:], a[1][:n])

        for k in (1, 2, 4, 8):
            least[2 * k] = join(least[k], least[k], k)
        return join(join(least[16], least[8], 16), least[4], 24)  # OFFSETS = 28 runs


def _is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    known = np.sort(known)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _longs(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64, copy=False).view(np.uint64)


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, bucket): each place at which some window has its least run."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            words = _Words([(text or "").encode().split() for text in batch.column("text").to_pylist()], _hasher())
            value, place = words.anchors()
            place, first = np.unique(place[words.inside], return_index=True)
            value = value[words.inside][first]
            bucket = np.repeat(batch.column("bucket").to_numpy(zero_copy_only=False), words.sizes)[place]
            yield pa.RecordBatch.from_arrays([pa.array(signed(value)), pa.array(bucket.astype(np.int32))], ["value", "bucket"])
    pa.default_memory_pool().release_unused()


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    """``values`` as one list for each of ``n`` owners."""
    ends = np.cumsum(np.bincount(owner, minlength=n))
    return pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(values[np.argsort(owner, kind="stable")].astype(np.int32)))


def _bucket_of(docs: pa.Table) -> int:
    return docs.column("bucket")[0].as_py() if docs.num_rows else 0


_COLUMNS = ["value", "bucket", "low", "high", "spelled", "places", "other", "n"]
_SUFFIX = "value long, bucket int, low int, high int, spelled binary, places array<int>, other long, n long"


def _windows(words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each window, and one of both by which windows of one bucket are compared."""
    a, b = rolling(words.hashes, WINDOW)[0], rolling(mix(words.hashes), WINDOW)[0]
    return a, b, mix(mix(a) + b * GOLDEN)


def _emit(docs: pa.Table, prefixes: pa.Table) -> pa.Table:
    """The suffixes that start with a prefix that isn't heavy, and the whole windows whose least run is a heavy one."""
    words = _Words(_split(docs)[1], _hasher())
    value, place = words.anchors()
    known, heavy = _longs(prefixes.column("value")), prefixes.column("heavy").to_numpy().astype(bool)
    suffixes = _suffixes(words, value, place, known[~heavy], _bucket_of(docs))
    return pa.concat_tables([suffixes, _heavy_windows(words, value, known[heavy], _bucket_of(docs))]) if heavy.any() else suffixes


def _heavy_windows(words: _Words, value: np.ndarray, prefixes: np.ndarray, bucket: int) -> pa.Table:
    """How often each window (``value`` and ``other``) whose least run is one of ``prefixes`` stands in the bucket."""
    at = np.flatnonzero(words.inside & _is_in(value, prefixes)) if len(value) else np.zeros(0, np.int64)
    a, b, both = (x[at] for x in _windows(words)) if len(at) else [np.zeros(0, np.uint64)] * 3
    _, first, n = np.unique(both, return_index=True, return_counts=True)
    none = [pa.nulls(len(first), k) for k in (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()))]
    return pa.table([pa.array(signed(a[first])), pa.array(np.full(len(first), bucket, np.int32)), *none, pa.array(signed(b[first])), pa.array(n.astype(np.int64))], _COLUMNS)


def _suffixes(words: _Words, value: np.ndarray, place: np.ndarray, prefixes: np.ndarray, bucket: int) -> pa.Table:
    """The suffixes that start with one of ``prefixes``, equal ones in one row with all their places in the bucket.

    ``low`` to ``high`` are the offsets of the windows whose least run starts the suffix: how many words before it they
    begin. ``spelled`` has the hashes of the BEFORE words before the suffix and of its first AFTER words; those that no
    such window covers are zero.
    """
    at = np.flatnonzero(words.inside & _is_in(value, prefixes)) if len(value) else np.zeros(0, np.int64)
    place, first, n = np.unique(place[at], return_index=True, return_counts=True)
    value = value[at[first]] if len(at) else np.zeros(0, np.uint64)
    high = place - at[first] if len(at) else place
    low = high - n + 1  # the windows of a place follow each other
    out: list[list] = [[] for _ in range(6)]
    padded = np.concatenate([np.zeros(BEFORE, np.uint64), words.hashes, np.zeros(AFTER, np.uint64)])
    step = np.arange(BEFORE + AFTER)
    # All suffixes of a prefix come in one part, so that equal ones meet.
    order = np.argsort(value, kind="stable")
    value, place, low, high = value[order], place[order], low[order], high[order]
    start = 0
    while start < len(value):
        end = min(start + (1 << 15), len(value))
        end = int(np.searchsorted(value, value[end - 1], side="right"))
        part = slice(start, end)
        spelled = padded[place[part, None] + step]
        spelled[(step < BEFORE - high[part, None]) | (step >= BEFORE + AFTER - low[part, None])] = 0
        digest = mix(value[part] + _U(32) * low[part].astype(np.uint64) + high[part].astype(np.uint64))
        other = digest.copy()
        for column in spelled.T:
            digest, other = mix(digest * GOLDEN + column), other * GOLDEN + (column ^ (column >> _U(29)))
        _, first, owner = np.unique(digest ^ mix(other), return_index=True, return_inverse=True)
        raw = np.ascontiguousarray(spelled[first].view(np.uint8).reshape(len(first), -1, 8)[:, :, :BYTES]).reshape(len(first), -1)
        size = raw.shape[1]
        out[0].append(pa.array(signed(value[part][first])))
        out[1].append(pa.array(np.full(len(first), bucket, np.int32)))
        out[2].append(pa.array(low[part][first].astype(np.int32)))
        out[3].append(pa.array(high[part][first].astype(np.int32)))
        out[4].append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((np.arange(len(first) + 1) * size).astype(np.int32)), pa.py_buffer(raw.tobytes())]))
        out[5].append(_lists(place[part], owner, len(first)))
        start = end
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
    columns = [pa.chunked_array(c, k) for c, k in zip(out, kinds, strict=True)]
    return pa.table([*columns, *[pa.nulls(len(columns[0]), pa.int64())] * 2], _COLUMNS)


class SuffixTree:
    """The suffixes of a prefix group in order, and how many words each shares with the one before.

    Neighbours that share ``depth`` words or more hang below one inner node of that depth: ``node(depth)`` numbers them.
    """

    def __init__(self, after: np.ndarray):
        spelled = np.ascontiguousarray(after.astype(">u8")).view(f"S{after.shape[1] * 8}").ravel() if len(after) else np.zeros(0, "S8")
        self.order = np.argsort(spelled, kind="stable")
        inner = after[self.order]
        same = inner[1:] == inner[:-1]
        self.shared = np.concatenate([np.zeros(min(1, len(after)), np.int64), np.where(same.all(axis=1), after.shape[1], np.argmin(same, axis=1))]) if len(after) else np.zeros(0, np.int64)

    def node(self, depth: int) -> np.ndarray:
        """For each suffix, in the tree's order, the number of the node of this depth above it."""
        return np.cumsum(self.shared < depth)


def repeated_offsets(before: np.ndarray, after: np.ndarray, low: np.ndarray, high: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """A bit for each offset at which a suffix's window occurs elsewhere too.

    A window that begins ``o`` words before its suffix is repeated if the suffix hangs, with another, below a node of
    depth WINDOW - o at least, and both have the same ``o`` words before them. Neighbouring offsets of a suffix join to
    its maximal repeat.
    """
    tree = SuffixTree(after)
    order = tree.order
    before, low, high, copies = before[order], low[order], high[order], copies[order]
    left = np.zeros(len(order), np.uint64)
    bits = np.zeros(len(order), np.int32)
    for o in range(OFFSETS):
        if o:
            left = mix(left * GOLDEN + before[:, BEFORE - o] + _U(1))
        own = np.flatnonzero((low <= o) & (o <= high))
        if not len(own):
            continue
        key = mix(left[own]) + mix(tree.node(WINDOW - o)[own].astype(np.uint64) * GOLDEN)
        _, which = np.unique(key, return_inverse=True)
        leaves = np.bincount(which, weights=copies[own])
        bits[own[leaves[which] > 1]] |= np.int32(1 << o)
    out = np.empty(len(order), np.int32)
    out[order] = bits
    return out


_REPEATS = "bucket int, place int, offsets int, window long"


def _repeats(group: pa.Table) -> pa.Table:
    """Places of a group's suffixes with their repeated offsets; of its whole windows those that are repeated, for each
    bucket that has them."""
    whole = pc.is_valid(group.column("n"))
    if group.column("n").null_count == group.num_rows:
        return _repeated_suffixes(group)
    return pa.concat_tables([_repeated_suffixes(group.filter(pc.invert(whole))), _repeated_windows(group.filter(whole))])


def _repeated_windows(group: pa.Table) -> pa.Table:
    a, b, n, bucket = _longs(group.column("value")), _longs(group.column("other")), group.column("n").to_numpy(), group.column("bucket").to_numpy()
    order = np.lexsort((b, a))
    a, b, n, bucket = a[order], b[order], n[order], bucket[order]
    which = np.cumsum(np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) - 1
    keep = np.bincount(which, weights=n)[which] > 1 if len(a) else np.zeros(0, bool)
    none = pa.nulls(int(keep.sum()), pa.int32())
    return pa.table([pa.array(bucket[keep].astype(np.int32)), none, none, pa.array(signed(mix(mix(a[keep]) + b[keep] * GOLDEN)))], ["bucket", "place", "offsets", "window"])


def _repeated_suffixes(group: pa.Table) -> pa.Table:
    group = group.combine_chunks()
    n = group.num_rows
    places = group.column("places")
    copies = places.combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if n else np.zeros(0, np.int32)
    spelled = np.frombuffer(b"".join(group.column("spelled").to_pylist()), np.uint8).reshape(n, BEFORE + AFTER, BYTES)
    whole = np.zeros((n, BEFORE + AFTER, 8), np.uint8)
    whole[:, :, :BYTES] = spelled
    whole = whole.view(np.uint64).reshape(n, BEFORE + AFTER)
    low, high = (group.column(c).to_numpy() for c in ("low", "high"))
    # The prefix is spelled in full, so suffixes of different prefixes share fewer than SEED words.
    bits = repeated_offsets(whole[:, :BEFORE], whole[:, BEFORE:], low, high, copies)
    found = np.repeat(bits, copies)
    flat = places.combine_chunks().flatten().to_numpy(zero_copy_only=False) if n else np.zeros(0, np.int32)
    bucket = np.repeat(group.column("bucket").to_numpy(), copies)
    keep = found != 0
    return pa.table([pa.array(bucket[keep].astype(np.int32)), pa.array(flat[keep].astype(np.int32)), pa.array(found[keep]), pa.nulls(int(keep.sum()), pa.int64())], ["bucket", "place", "offsets", "window"])


def _remove(docs: pa.Table, repeats: pa.Table) -> pa.Table:
    order, texts = _split(docs)
    sizes = [len(words) for words in texts]
    covered = np.zeros(sum(sizes) + 1, np.int64)
    suffixes = repeats.filter(pc.is_null(repeats.column("window")))
    place, offsets = suffixes.column("place").to_numpy().astype(np.int64), suffixes.column("offsets").to_numpy()
    starts = [place[(offsets >> o) & 1 == 1] - o for o in range(OFFSETS)]
    if suffixes.num_rows < repeats.num_rows:
        words = _Words(texts, _hasher())
        starts.append(np.flatnonzero(words.inside & _is_in(_windows(words)[2], _longs(repeats.column("window").drop_null()))))
    for at in starts:
        np.add.at(covered, at, 1)
        np.add.at(covered, at + WINDOW, -1)
    keep = np.cumsum(covered)[:-1] == 0
    kept_texts, removed = [], []
    start = 0
    for own, size in zip(texts, sizes, strict=True):
        flags = keep[start : start + size]
        n = int(flags.sum())
        kept_texts.append(b" ".join(own if n == size else compress(own, flags)).decode())
        removed.append(size - n)
        start += size
    pa.default_memory_pool().release_unused()
    return pa.table([docs.column("doc_id").take(pa.array(order)), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept_texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, bucket_bytes: int = 2 << 20, group_rows: int = 1 << 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, and ``kept``, the words that stay, joined by one space.

    A word goes if a window of 35 words over it, of one text, has a word sequence that also starts anywhere else, in
    the same text or another. Windows are judged on the input. Null and empty texts have no words; texts of fewer than
    35 words lose none; a repeated row is a second text. Columns other than doc_id and text are ignored.

    Texts are dealt into buckets of about ``bucket_bytes``. Every window contains a prefix, the least by hash of its
    runs of 8 words; equal windows have the same one, at the same offset. Prefixes that occur at one place only clear
    their windows. Suffixes that start at the others are grouped by prefix into groups of about ``group_rows``, each
    small enough for memory; a group's suffix tree, with the words before each suffix, gives the repeats that are 35
    words deep at least, and these go back to the buckets as places. Equal suffixes of a bucket are one row.

    A prefix with more than ``group_rows`` places doesn't fit: there the prefix is lengthened to the whole window, which
    needs no tree. Windows go through the same shuffle as suffixes, as a count for each bucket without places, so texts
    aren't shuffled for them; those that are repeated are found again in the buckets. Neither way gathers a hot passage in one task.
    Hashes of prefixes have 64 bits, those of single words in a suffix 48, whole windows 128 (64 inside a bucket): equality rests on them.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket"))
    anchors = dealt.select("text", "bucket").mapInArrow(_emit_anchors, "value long, bucket int")
    per_bucket = stored(anchors.groupBy("value", "bucket").agg(F.count("*").alias("n")))
    totals = per_bucket.groupBy("value").agg(F.sum("n").alias("total")).where("total > 1")
    prefixes = stored(per_bucket.join(totals, "value").select("value", "bucket", "n", (F.col("total") > group_rows).alias("heavy")))
    # A heavy place has some 14 windows, whose rows are about as much smaller than that of a suffix.
    places = prefixes.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-2 * places // group_rows))
    emitted = dealt.groupBy("bucket").cogroup(prefixes.groupBy("bucket")).applyInArrow(_emit, _SUFFIX)
    repeats = emitted.groupBy(F.pmod(F.xxhash64("value"), F.lit(groups)).alias("part")).applyInArrow(_repeats, _REPEATS)
    return dealt.groupBy("bucket").cogroup(repeats.groupBy("bucket")).applyInArrow(_remove, "doc_id long, n_words long, n_removed long, kept string")
