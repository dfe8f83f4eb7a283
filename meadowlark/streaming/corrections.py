"""Streams of cell observations that correct themselves: of each cell, variable, source and UTC day one row is in force."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

#: What a row of a key is ranked by, besides its day.
RANK = ("product_status", "processing_version", "mapping_version", "valid_fraction", "available_at", "source_item_id")
CHANGES = "source_id string, variable string, cell long, day date, action string, revision long, rows long, value double, product_status string, source_item_id string"


def corrections(rows: DataFrame, late_days: int) -> DataFrame:
    """What a stream of observations changes: rows of ``CHANGES``, to be written in update mode.

    ``rows`` has source_id, variable, cell, time_start, value and the columns of ``RANK``. A row takes the place of the one in
    force if it is final and that is preliminary; else if it is of later processing, then mapping, of larger valid
    fraction, later availability or larger item id (null is least). So the row in force doesn't depend on the order of
    arrival. Actions, a row each:

    * ``new``, ``replaced``: the day's row now in force, with its ``revision`` (1, 2, …); one for each day and micro-batch.
    * ``unchanged``: how many ``rows`` of a micro-batch changed nothing: repeats, or rows that rank lower.
    * ``late``: how many came for a day more than ``late_days`` before the key's newest day as it stood before the
      micro-batch. They are counted and have no effect; days that far back are forgotten.

    The state of a key (source, variable, cell) is so at most ``late_days`` + 1 days and those ahead of the newest of a
    micro-batch. Rows without a time are late. A restart goes on from the checkpoint.
    """
    # Rank and value travel as one JSON text, so that state and batches have plain columns.
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    number = lambda c: F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(-1.0)), F.lit(-1.0))
    rank = F.array(F.when(F.col("product_status") == "final", "1").otherwise("0"), whole("processing_version"), whole("mapping_version"))
    narrow = rows.select(
        "source_id", "variable", F.col("cell").cast("long").alias("cell"), F.unix_date(F.to_date("time_start")).alias("day"), rank.alias("rank"), number("valid_fraction").alias("valid_fraction"),
        F.coalesce(F.unix_micros(F.col("available_at").cast("timestamp")), F.lit(-(1 << 62))).alias("available_at"), whole("source_item_id").alias("source_item_id"), "product_status", F.col("value").cast("double").alias("value"))

    def change(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # day -> [rank, value, status, revision]
        known = {int(d): x for d, x in json.loads(state.get[0]).items()} if state.exists else {}
        newest = max(known, default=None)
        first = None if newest is None else newest - late_days
        touched, fresh, late, unchanged = set(), set(), 0, 0
        for part in parts:
            for row in part.itertuples(index=False):
                if pd.isna(row.day) or (first is not None and row.day < first):
                    late += 1
                    continue
                day = int(row.day)
                mine = [*row.rank, row.valid_fraction, int(row.available_at), row.source_item_id]
                held = known.get(day)
                if held is not None and mine <= held[0]:
                    unchanged += 1
                    continue
                value = None if pd.isna(row.value) else float(row.value)
                revision = held[3] if held is not None else 0
                if held is None:
                    fresh.add(day)
                elif day in touched:
                    unchanged += 1  # ranks below one of its own micro-batch
                touched.add(day)
                known[day] = [mine, value, None if pd.isna(row.product_status) else row.product_status, revision]
        for day in touched:
            known[day][3] += 1
        out = [(*key, day, "new" if day in fresh else "replaced", known[day][3], 1, known[day][1], known[day][2], known[day][0][5]) for day in sorted(touched)]
        out += [(*key, None, action, None, n, None, None, None) for action, n in (("unchanged", unchanged), ("late", late)) if n]
        if known:
            horizon = max(known) - late_days
            state.update((json.dumps({d: x for d, x in known.items() if d >= horizon}),))
        yield pd.DataFrame(out, columns=["source_id", "variable", "cell", "_day", "action", "revision", "rows", "value", "product_status", "source_item_id"]).astype({"_day": "Int64", "revision": "Int64", "rows": "Int64", "cell": "Int64"})

    made = narrow.groupBy("source_id", "variable", "cell").applyInPandasWithState(change, CHANGES.replace("day date", "_day long"), "known string", "update", "NoTimeout")
    return made.withColumn("day", F.date_from_unix_date(F.col("_day").cast("int"))).select("source_id", "variable", "cell", "day", "action", "revision", "rows", "value", "product_status", "source_item_id")


def send(rows: DataFrame, path: str, *order: str, file_rows: int = 1 << 20) -> int:
    """Adds ``rows`` to a stream's source as files of some ``file_rows`` rows, six at least, in ranges of ``order``; their number."""
    parts = max(6, -(-rows.count() // file_rows))
    rows.repartitionByRange(parts, *order).write.mode("append").parquet(path)
    return parts


def in_force(changes: DataFrame) -> DataFrame:
    """The rows in force of written changes: each day's of the largest revision. A change that a sink wrote twice counts once."""
    key = ["source_id", "variable", "cell", "day"]
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("revision")))
    return changes.where("action in ('new', 'replaced')").withColumn("_place", newest).where("_place = 1").drop("_place")


def write_corrections(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there of a stream of ``corrections``, a folder a micro-batch; one that is run again after a failure
    replaces its own folder. One stream a path."""
    def write(part: DataFrame, number: int) -> None:
        part.write.mode("overwrite").parquet(f"{path}/micro_batch={number}")

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
