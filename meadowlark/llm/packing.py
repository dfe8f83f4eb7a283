"""Best-fit packing of tokenized documents: exact complements by length, then best fit for what is left."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, forget, small_batches, stored, worker_memo

CAPACITY, END = 2048, 0


#: A run of letters with ASCII punctuation, but no apostrophe or underscore, around it: the tokenizer splits there anyhow.
_PARTS = re.compile(r"([!-&(-/:-@\[-^`{-~]*)([^\W\d_]+)([!-&(-/:-@\[-^`{-~]*)")
#: White space to Python, but not to the tokenizer.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


#: Letters whose lower case is one letter, as the tokenizer has it.
_PLAIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: Byte-level vocabularies write printable Latin-1 characters as themselves and the other bytes, in turn, from U+0100 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARACTERS = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}


class _Memo(dict):
    """A memo of two generations: a full one becomes the old one and pushes out the one before, so what is asked for often
    stays. It holds 2 x ``bound`` entries at most. ``find`` gives the value of an unknown key."""

    def __init__(self, find: Callable[[str], bytes], bound: int):
        self.find, self.bound, self.old = find, bound, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.find(key)
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class _Encoder:
    """Token ids of white-space-separated chunks. No pattern of the tokenizer's matches across white space, and its
    normalisers don't either, so a text's ids are those of its chunks in turn.

    A chunk of letters between punctuation is encoded by parts, of which far fewer differ.
    """

    def __init__(self, path: str, bound: int = 1 << 18):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts, self.chunks = _Memo(self.encode, 2 * bound), _Memo(self.by_parts, bound)

    def encode(self, part: str) -> bytes:
        if _PLAIN.fullmatch(part):  # nothing to compose or split: the model alone gives the ids
            found = [t.id for t in self.model.tokenize(part.lower().encode().decode("latin-1").translate(_BYTE_CHARACTERS))]
        else:
            found = self.tokenizer.encode(part, add_special_tokens=False).ids
        return np.array(found, "<u4").tobytes()

    def by_parts(self, chunk: str) -> bytes:
        m = None if "<|" in chunk else _PARTS.fullmatch(chunk)
        return b"".join(self.parts[x.lower() if x.isascii() else x] for x in m.groups() if x) if m else self.encode(chunk)

    def ids(self, text: str) -> bytes:
        chunks = filter(None, _SPACE.split(text)) if _NOT_SPACE.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))


def _encoder(path: str) -> _Encoder:
    """One a worker process, so that its tasks share the memo."""
    return worker_memo(("encoder", path), lambda: _Encoder(path))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        end = np.array([END], "<u4").tobytes()
        for batch in batches_of(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encoder.ids(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32: ids of the tokenizer, then id 0, cut after each ``capacity`` ids.

    A null text counts as empty, which gives the end id alone.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_pieces(path or tokenizer_path(), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """A plan for pieces of which only the number of each length is known: (how often, lengths of one sequence).

    Longest lengths first: the gap that a length leaves is looked up in the sums of single, pair and triple lengths, and
    a combination that fills it exactly is consumed as often as its counts allow. What has no exact complement is packed
    by best fit: the longest length that fits, until none does. The plan has some thousand entries at most, since each
    entry uses up a length; it doesn't grow with the pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[int, list[int]]] = []

    def use(lengths: list[int]) -> None:
        need = np.bincount(lengths, minlength=capacity + 1)
        some = need > 0
        times = int((left[some] // need[some]).min())
        if times:
            left[some] -= times * need[some]
            plan.append((times, lengths))

    def pair(total: int, taken: dict[int, int]) -> list[int] | None:
        """Two lengths of this sum, besides those taken; the most unlike first, so that medium lengths stay."""
        if total < 2:
            return None
        free = left[: total + 1].copy()
        for length, n in taken.items():
            if length <= total:
                free[length] -= n
        low = np.arange(1, total // 2 + 1)
        ok = (free[low] > 0) & (free[total - low] > 0) & ((low * 2 != total) | (free[low] > 1))
        return [int(total - low[ok][0]), int(low[ok][0])] if ok.any() else None

    def complement(length: int) -> list[int] | None:
        gap = capacity - length
        if not gap:
            return []
        if left[gap] > (gap == length):
            return [gap]
        if found := pair(gap, {length: 1}):
            return found
        sums = np.convolve(left[: gap + 1] > 0, left[: gap + 1] > 0)[: gap + 1]
        for third in np.flatnonzero(left[1:gap])[::-1] + 1:
            if sums[gap - third] and left[third] > (third == length):
                taken = {length: 1}
                taken[int(third)] = taken.get(int(third), 0) + 1
                if found := pair(int(gap - third), taken):
                    return [int(third), *found]
        return None

    for length in range(capacity, 0, -1):
        while left[length] and (rest := complement(length)) is not None:
            use([length, *rest])
        while left[length]:  # best fit
            lengths, room = [length], capacity - length
            left[length] -= 1
            taken = [length]
            while room and len(fits := np.flatnonzero(left[: room + 1])):
                lengths.append(int(fits[-1]))
                taken.append(int(fits[-1]))
                left[fits[-1]] -= 1
                room -= int(fits[-1])
            for x in taken:
                left[x] += 1
            use(lengths)
    return plan


def _slots(plan: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: the pieces of a length, by rank, fill the slots for it in turn."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for times, lengths in plan:
        offset = 0
        for length in lengths:
            rows.append((length, rank.get(length, 0), sequence, offset))
            rank[length] = rank.get(length, 0) + times
            offset += length
        sequence += times
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of 1 to ``capacity``.

    Only the number of pieces of each length (``capacity`` numbers) reaches the driver. Pieces get a rank among those of
    their length: they are dealt into chunks, the chunks' counts give each chunk its first rank, and rows are numbered
    inside chunks; so a common length is numbered in many tasks. A plan's slots are then looked up by length and rank.
    Equal pieces may trade places between runs; every piece is placed once. No rows give no rows. Pieces keep their
    columns; a null doc_id is a document like others, and repeated rows are packed as often as they come.
    """
    tallied = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(1 << 10)))
    tallied = stored(tallied)
    sizes = tallied.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    by_length = Window.partitionBy("length").orderBy("chunk")
    first = stored(sizes.select("length", "chunk", "n", (F.sum("n").over(by_length) - F.col("n")).alias("first")))
    counts = {r["length"]: r["n"] for r in first.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = tallied.sparkSession.sparkContext.broadcast(_slots(pack_lengths(counts, capacity)))
    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece")
    ranked = tallied.withColumn("rank", F.row_number().over(within) - 1).join(first.drop("n"), ["length", "chunk"])
    names = pieces.columns
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("first")).select(*names, "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        table = slots.value
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches_of(batches, 1 << 14):
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, batch.column("length").to_numpy(zero_copy_only=False) << 44 | rank, side="right") - 1
            sequence = table[at, 2] + rank - table[at, 1]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(sequence), pa.array(table[at, 3])], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")
