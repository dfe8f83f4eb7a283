"""Mixing sources to target weights by nested hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, stored

#: Of a document's 60-bit hash, the histograms look at so many bits in turn. The first one holds every document, so it
#: has few buckets; the others hold the boundary bucket's documents alone, so their buckets are bounded by those.
BITS = (12, 24, 24)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size) -> the same rows with ``target``: words that each source gives to a mix of the same total size.

    Sources by code point, null last, take the weights in turn. A target is weight x level, at most ``cap`` x size,
    where the level makes the targets add up to the total: what capped sources can't give goes to the others by weight.
    The sources are grouped already; this works on one row a source, in one task (thousands of sources, not millions).
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", turn).withColumn("limit", F.col("source_size") * cap)
    # Sources that reach their limit at a lower level come first; the first k of them are capped.
    rise = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    rest = weighed.select(
        "*",
        F.sum("source_size").over(Window.partitionBy()).alias("total"),
        F.coalesce(F.sum("limit").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("capped"),
        F.sum("weight").over(rise.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
    )
    level = (F.col("total") - F.col("capped")).cast("double") / F.col("open")
    lowest = F.min(F.when(level * F.col("weight") <= F.col("limit"), F.struct("capped", level.alias("level")))).over(Window.partitionBy())
    return rest.withColumn("level", lowest["level"]).select("source", "source_size", F.least(F.col("weight") * F.col("level"), F.col("limit").cast("double")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target and ``taken``, the words that the mix takes.

    A source whose target is a multiple of its size is taken so often whole; of the rest, documents whose hash lies below
    a threshold are taken once more. The threshold is found without sorting: words are summed by source and hash bucket,
    the bucket in which the budget runs out is looked at again by the next bits, and so on; only rows of boundary
    buckets are read again. The document at the boundary is taken if that brings the sum nearer to the target, so a mix
    is never more than half a document away. The hash depends on doc_id and text: reruns agree, and a larger budget
    takes a superset. Of rows that repeat both, at the boundary, as many are taken as come nearest to the target.

    Null texts have size 0 and take nothing; a source without words has target 0; no rows give no rows.
    Columns other than doc_id, source and text are ignored.
    """
    rows, found = _thresholds(docs, weights, cap)
    return _with_times(rows, found, rows.columns).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("_mix_times")).alias("taken"))


def repeat(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix_sources`` takes it; rows without words by their hash as the others."""
    found = _thresholds(docs, weights, cap)[1]
    rows = _with_times(docs.withColumns({"_mix_size": _size(), "_mix_hash": _hash()}), found, docs.columns, "_mix_size", "_mix_hash").where("_mix_times > 0")
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), "_mix_times")).alias("_mix_time")).drop("_mix_time")


def _with_times(rows: DataFrame, found: DataFrame, names: list[str], size: str = "size", hash_: str = "hash") -> DataFrame:
    """``names`` of rows, and of their sources source_size, target and ``_mix_times``, how often the mix takes the row."""
    more = [c for c in ("source_size", "target") if c not in names]
    own = found.select(F.col("s").alias("_mix_source"), F.col("whole").alias("_mix_whole"), F.col("low").alias("_mix_low"), F.col("edge").alias("_mix_edge"), F.col("room").alias("_mix_room"), *more)
    joined = rows.join(own, F.col("source").eqNullSafe(F.col("_mix_source")))
    kept = [*names, *more]
    times = (F.col("_mix_whole") + (F.col(hash_) < F.col("_mix_low")).cast("long")).cast("int").alias("_mix_times")
    if found.where("edge is not null").isEmpty():
        return joined.select(*kept, times)
    # Some source's budget runs out among rows of one hash: only those are numbered.
    others = joined.where(f"_mix_edge is null or `{hash_}` <> _mix_edge").select(*kept, times)
    order = Window.partitionBy("_mix_source").orderBy(size)
    upto = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = joined.where(f"`{hash_}` = _mix_edge").select(*kept, (F.col("_mix_whole") + (upto * 2 - F.col(size) <= F.col("_mix_room") * 2).cast("long")).cast("int").alias("_mix_times"))
    return others.union(last)


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _hash() -> Column:
    """60 bits of doc_id and text."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def _thresholds(docs: DataFrame, weights: tuple[int, ...], cap: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, source, size and hash of each row; and for each source ``s`` its source_size and target, and how often it is
    taken: ``whole`` times, and once more where the hash is less than ``low``. Of the rows whose hash is ``edge``, where
    that isn't null, so many are taken once more as fit best in ``room`` words."""
    rows = stored(docs.select("doc_id", "source", _size().alias("size"), _hash().alias("hash")))
    targets = stored(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap).select(
        "*",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("whole"),
    ).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))

    # Of each source: hashes below ``low`` are taken; ``left`` of the budget goes to the bucket that starts there.
    state = targets.select("source", F.lit(0).cast("long").alias("low"), F.col("budget").alias("left"), F.lit(None).cast("long").alias("edge"))
    boundary = rows.select("source", "size", "hash")
    shift = 60
    for level, bits in enumerate(BITS, 1):
        above, shift = 1 << shift, shift - bits
        width = 1 << shift
        own = F.col("source").eqNullSafe(F.col("s"))
        at = state.select(F.col("source").alias("s"), "low", "left")
        if level > 1:
            boundary = boundary.join(at.select("s", F.col("low").alias("from")), own).where((F.col("hash") >= F.col("from")) & (F.col("hash") < F.col("from") + above)).select("source", "size", "hash")
        sums = boundary.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        running = sums.select("source", F.shiftleft("bucket", shift).alias("start"), "words", "rows", (upto - F.col("words")).alias("before"))
        cut = running.join(at, own).where(F.col("before") + F.col("words") > F.col("left")).groupBy("s").agg(F.min(F.struct("start", "before", "words", "rows")).alias("cut"))
        # Without a bucket in which the budget runs out, all that is left is taken.
        after = at.join(cut.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left")
        start, room = F.col("cut.start"), F.col("left") - F.col("cut.before")
        single = F.lit(level == len(BITS)) & (F.col("cut.rows") == 1)
        low = F.when(F.col("cut").isNull(), F.col("low") + above).otherwise(F.when(single & (room * 2 >= F.col("cut.words")), start + width).otherwise(start))
        edge = F.when(F.lit(level == len(BITS)) & (F.col("cut.rows") > 1), start)
        state = stored(after.select(F.col("s").alias("source"), low.alias("low"), F.coalesce(room, F.lit(0.0)).alias("left"), edge.alias("edge")))
    ends = state.select(F.col("source").alias("s"), "low", "edge", F.col("left").alias("room"))
    return rows, stored(targets.join(ends, F.col("source").eqNullSafe(F.col("s"))).select("s", "low", "edge", "room", "source_size", "target", "whole"))
