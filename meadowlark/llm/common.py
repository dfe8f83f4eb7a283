"""Helpers shared by the training-data operators: stored intermediates, word hashing, held-out rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word characters of every contract: anything but ASCII white space. ``bytes.split()`` splits at exactly these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_U = np.uint64
_MIX_1, _MIX_2, GOLDEN = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> _U(30))) * _MIX_1
    x = (x ^ (x >> _U(27))) * _MIX_2
    return x ^ (x >> _U(31))


class WordHasher(dict):
    """Memo of word -> 64-bit hash; emptied when it reaches ``bound`` words, so memory stays bounded."""

    def __init__(self, bound: int = 1 << 18):
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones((2, 1), np.uint64)


def _power_table(n: int) -> np.ndarray:
    """Powers of the rolling hash's base and of its inverse, up to n."""
    global _powers
    if _powers.shape[1] < n:
        n = max(n, 1 << 14)
        table = np.empty((2, n), np.uint64)
        for row, base in enumerate((_BASE, _BASE_INVERSE)):
            table[row, 0] = 1
            table[row, 1:] = base
            np.multiply.accumulate(table[row], out=table[row])
        _powers = table
    return _powers


def rolling(hashes: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """For each length, the hash of every run of so many consecutive words (by its start)."""
    n = len(hashes)
    powers = _power_table(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers[0, :n], out=prefix[1:])
    return [(prefix[k:] - prefix[: n + 1 - k]) * powers[1, : n + 1 - k] if n >= k else np.zeros(0, np.uint64) for k in lengths]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def shingle_units(words: list[bytes], hasher: WordHasher, size: int) -> np.ndarray:
    """The weighted shingle set of a text as unit copies: the c-th repeat of a shingle is an element of its own.

    A text of fewer words than ``size`` has one shingle, all its words; a text without words has none.
    """
    if not words:
        return np.zeros(0, np.uint64)
    hashes = hasher.of(words)
    units = np.sort(mix(rolling(hashes, min(size, len(words)))[0]))
    if len(units) > 1:
        fresh = np.concatenate(([True], units[1:] != units[:-1]))
        starts = np.flatnonzero(fresh)
        copy = np.arange(len(units)) - np.repeat(starts, np.diff(np.append(starts, len(units))))
        units = np.where(copy > 0, mix(units + copy.astype(np.uint64) * GOLDEN), units)
    return units


def storage_folder(spark: SparkSession) -> str:
    """A new folder below the shared folder that the session names.

    Where none is named, a local session gets a temporary one; on a cluster that is an error, as executors wouldn't share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="meadowlark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/meadowlark-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Sets Arrow batches of 1,024 rows where the session still has Spark's default of 10,000: texts are long, and a
    batch is held by the executor and by the Python worker at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1024")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = storage_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


_memos: dict[object, object] = {}


def worker_memo(name: object, make: Callable[[], object]) -> object:
    """A memo that the tasks of one operator share in a worker process. Workers go from operator to operator, so those of
    others are dropped."""
    if name not in _memos:
        forget()
        _memos[name] = make()
    return _memos[name]


def forget() -> None:
    """Drops the memos that earlier operators left in this worker process."""
    _memos.clear()
    pa.default_memory_pool().release_unused()


def batches_of(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that long texts don't pile up as Python objects.

    At the end of the task, Arrow's free memory goes back to the machine: workers outlive their tasks.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
