"""Reports: sentences of a group over values that were computed before, with their evidence and limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import formatted


def sentence(*parts: str | Column | tuple[Column, int]) -> Column:
    """Texts as they are, numbers as ``formatted`` shows them (with a number of decimals, if given): never null."""
    shown = []
    for p in parts:
        if isinstance(p, str):
            shown.append(F.lit(p))
        else:
            shown.append(formatted(*p) if isinstance(p, tuple) else formatted(p))
    return F.concat(*shown)


def render(findings: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, dataset: str | None = None, limitation: str | None = None, attribution: str = "") -> DataFrame:
    """(keys, report): a paragraph a finding by ``order``, ties by text; then the datasets, the attribution and the limits.

    Null findings, datasets and limits are left out, the last two are named once and sorted; a part without any is left
    out whole. A report holds its group's findings, which are sentences on aggregates and not on rows: it grows with them.
    """
    place = F.struct(*(F.col(o) for o in order), F.col(text).alias("_text"))
    paragraphs = F.transform(F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), place))), lambda p: p["_text"])
    distinct = lambda c: F.array_sort(F.collect_set(c)) if c else F.array().cast("array<string>")
    grouped = findings.groupBy(*keys).agg(paragraphs.alias("_found"), distinct(dataset).alias("_datasets"), distinct(limitation).alias("_limits"))
    evidence = F.when(F.size("_datasets") > 0, F.concat(F.lit("Evidence: datasets "), F.array_join("_datasets", ", "), F.lit(".")))
    limits = F.when(F.size("_limits") > 0, F.concat(F.lit("Limitations: "), F.array_join("_limits", " ")))
    said = F.lit(f"Attribution: {attribution}.") if attribution else F.lit(None).cast("string")
    return grouped.select(*keys, F.concat_ws("\n\n", "_found", evidence, said, limits).alias("report"))
