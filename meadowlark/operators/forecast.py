"""Next-day and next-cell forecasts, judged against simple baselines on held-out days."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import quantiles

# Least evidence, ridge strength, and the margin by which a model must beat its baseline.
MIN_TRAIN_ROWS, MIN_HOLDOUT_ROWS, MIN_OWN_HOLDOUT = 10, 30, 5
ALPHA, MIN_SD, MARGIN = 1.0, 1e-8, 1e-9


def next_day_examples(df: DataFrame, cutoff: str, features: Sequence[str] = ("displacement_km",)) -> DataFrame:
    """(entity_id, day, features, target_day, target, held_out): pairs of days in turn with both displacements.

    Days of which the next row isn't the next day give no example. held_out: target_day is not before ``cutoff``.
    """
    track = Window.partitionBy("entity_id").orderBy("day")
    pairs = df.select("entity_id", "day", *features, F.lead("day").over(track).alias("target_day"), F.lead("displacement_km").over(track).alias("target"))
    whole = pairs.where("datediff(target_day, day) = 1 and target is not null and displacement_km is not null")
    return whole.withColumn("held_out", F.col("target_day") >= F.lit(cutoff).cast("date"))


def skipped_gaps(df: DataFrame) -> DataFrame:
    """How many rows have a next row that isn't of the next day."""
    following = F.lead("day").over(Window.partitionBy("entity_id").orderBy("day"))
    return df.select("day", following.alias("next")).agg(F.count_if(F.datediff("next", "day") != 1).alias("skipped"))


def rolling_mean(df: DataFrame, column: str, days: int, output: str) -> DataFrame:
    """Mean of the last ``days`` calendar days of an entity, the row's own included."""
    window = Window.partitionBy("entity_id").orderBy(F.unix_date("day")).rangeBetween(1 - days, 0)
    return df.withColumn(output, F.avg(column).over(window))


def with_baseline(examples: DataFrame) -> DataFrame:
    return rolling_mean(examples, "displacement_km", 7, "baseline")


class Ridge(NamedTuple):
    """A line per feature: prediction = intercept + sum of slope x feature; unused features have slope 0."""

    features: tuple[str, ...]
    slopes: tuple[float, ...]
    intercept: float

    def predict(self, values: dict[str, Column]) -> Column:
        out = F.lit(self.intercept)
        for name, slope in zip(self.features, self.slopes, strict=True):
            out = out + values[name] * slope
        return out


def _solve(n: float, sums: np.ndarray, products: np.ndarray, features: Sequence[str]) -> Ridge:
    """From sums and products of (features, target): z-scores by population sd, ridge without a penalty on the intercept."""
    k = len(features)
    mean = sums / n
    cov = products / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
    used = sd > MIN_SD
    slopes = np.zeros(k)
    if used.any():
        scale = sd[used]
        gram = n * cov[:k, :k][np.ix_(used, used)] / np.outer(scale, scale)
        slopes[used] = np.linalg.solve(gram + ALPHA * np.eye(used.sum()), n * cov[:k, k][used] / scale) / scale
    return Ridge(tuple(features), tuple(map(float, slopes)), float(mean[k] - slopes @ mean[:k]))


def ridge(train: DataFrame, features: Sequence[str], target: str = "target") -> Ridge | None:
    """A pooled model from one aggregate over the rows without nulls; None below ten rows."""
    columns = [*features, target]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    r = train.dropna(subset=columns).agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)), *(F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"p{i}_{j}") for i, j in pairs)).first()
    if r["n"] < MIN_TRAIN_ROWS:
        return None
    products = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        products[i, j] = products[j, i] = r[f"p{i}_{j}"]
    return _solve(r["n"], np.array([r[f"s{i}"] for i in range(len(columns))]), products, features)


def mean_errors(test: DataFrame, model: Ridge | None) -> DataFrame:
    """n, baseline_mae, model_mae and ``presented``: the model only if it beats the baseline."""
    predicted = model.predict({f: F.col(f) for f in model.features}) if model else F.lit(None).cast("double")
    out = test.agg(F.count("*").alias("n"), F.avg(F.abs(F.col("target") - F.col("baseline"))).alias("baseline_mae"), F.avg(F.abs(F.col("target") - predicted)).alias("model_mae"))
    return out.withColumn("presented", choose(F.col("baseline_mae"), F.col("model_mae")))


def choose(baseline_mae: Column, model_mae: Column) -> Column:
    return F.when(model_mae < baseline_mae - MARGIN, "model").otherwise("baseline")


def residual_band(test: DataFrame, predicted: str = "baseline") -> DataFrame:
    residual = F.col("target") - F.col(predicted)
    return quantiles(test, {"p10": (residual, 0.1), "p90": (residual, 0.9)})


def forward(df: DataFrame, band: DataFrame, horizon: int, model: Ridge | None = None, rain: float | None = None) -> DataFrame:
    """(entity_id, day, step, predicted, low, high) for ``horizon`` days after each animal's last day with a displacement.

    Without a model the mean of its last seven days stays; with one each prediction is the next day's displacement, and
    a missing rainfall or vegetation value at the origin counts as 0. Predictions aren't negative; the band widens with
    the root of the step.
    """
    if not 1 <= horizon <= 30:
        raise ValueError("a horizon is 1 to 30 days")
    known = df.where("displacement_km is not null")
    last = Window.partitionBy("entity_id")
    recent = known.withColumn("last", F.max("day").over(last)).where("day > date_sub(last, 7)")
    others = [f for f in (model.features if model else ()) if f != "displacement_km"]
    origin = recent.groupBy("entity_id").agg(F.max("last").alias("last"), F.avg("displacement_km").alias("mean"), *(F.max_by(f, "day").alias(f) for f in ("displacement_km", *others)))
    if model:
        values = {f: F.lit(rain) if f == "rainfall" and rain is not None else F.coalesce(f, F.lit(0.0)) for f in others}
        follow = lambda path, _: F.concat(path, F.array(F.greatest(F.lit(0.0), model.predict(values | {"displacement_km": F.element_at(path, -1)}))))
        path = F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.array("displacement_km"), follow), 2, horizon)
    else:
        path = F.array_repeat("mean", horizon)
    steps = origin.select("entity_id", "last", F.posexplode(path).alias("at", "predicted")).crossJoin(F.broadcast(band)).withColumn("step", F.col("at") + 1)
    root = F.sqrt("step")
    low = F.greatest(F.lit(0.0), F.col("predicted") + F.col("p10") * root)
    return steps.select("entity_id", F.date_add("last", F.col("step")).alias("day"), "step", "predicted", low.alias("low"), F.greatest(low, F.col("predicted") + F.col("p90") * root).alias("high"))


def recursive_mae(examples: DataFrame, cutoff: str) -> DataFrame:
    """Held-out error if each animal's mean of the seven days before its last training day stays. Steps are held-out
    rows, gaps or not. Animals without training or held-out rows are left out."""
    before = examples.where(F.col("day") < F.lit(cutoff).cast("date"))
    recent = before.withColumn("last", F.max("day").over(Window.partitionBy("entity_id"))).where("day > date_sub(last, 7)")
    anchors = recent.groupBy("entity_id").agg(F.avg("displacement_km").alias("anchor"))
    return examples.where("held_out").join(anchors, "entity_id").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("target") - F.col("anchor"))).alias("recursive_mae"))


def recursive_model_mae(examples: DataFrame, cutoff: str, model: Ridge) -> DataFrame:
    """The same with a model whose predictions are fed back."""
    before = examples.where(F.col("day") < F.lit(cutoff).cast("date")).groupBy("entity_id").agg(F.max_by(F.struct(*model.features), "day").alias("origin"))
    targets = examples.where("held_out").groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "target"))), lambda x: x["target"]).alias("targets"))
    others = {f: F.col(f"origin.{f}") for f in model.features}
    state = F.struct(F.col("origin.displacement_km").alias("km"), F.lit(0.0).alias("error"))

    def step(acc: Column, target: Column) -> Column:
        km = model.predict(others | {"displacement_km": acc["km"]})
        return F.struct(km.alias("km"), (acc["error"] + F.abs(target - km)).alias("error"))

    scored = targets.join(before, "entity_id").select(F.size("targets").alias("n"), F.aggregate("targets", state, step, lambda acc: acc["error"]).alias("error")).where("error is not null")
    return scored.agg(F.sum("n").alias("n"), (F.sum("error") / F.sum("n")).alias("recursive_mae"))


def per_animal(test: DataFrame, predicted: Column) -> DataFrame:
    return test.groupBy("entity_id").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("target") - predicted)).alias("one_step_mae"), F.avg(F.abs(F.col("target") - F.col("baseline"))).alias("baseline_mae"))


def own_models(examples: DataFrame, features: Sequence[str]) -> DataFrame:
    """An own ridge for each animal of ten training and five held-out rows or more, with its error and the baseline's.

    The sums for each animal are aggregated by Spark; only the small solves are Python.
    """
    columns = [*features, "target"]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    whole = examples.dropna(subset=columns)
    train = F.when(~F.col("held_out"), 1.0)
    sums = whole.groupBy("entity_id").agg(F.count(train).alias("n"), F.count_if("held_out").alias("n_holdout"), F.array(*(F.sum(train * F.col(c)) for c in columns)).alias("s"), F.array(*(F.sum(train * F.col(columns[i]) * F.col(columns[j])) for i, j in pairs)).alias("p"))
    able = sums.where((F.col("n") >= MIN_TRAIN_ROWS) & (F.col("n_holdout") >= MIN_OWN_HOLDOUT))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for entity, n, s, p in zip(batch.entity_id, batch.n, batch.s, batch.p, strict=True):
                products = np.zeros((len(columns), len(columns)))
                for (i, j), value in zip(pairs, p, strict=True):
                    products[i, j] = products[j, i] = value
                model = _solve(n, np.array(s), products, features)
                rows.append((entity, list(model.slopes), model.intercept))
            yield pd.DataFrame(rows, columns=["entity_id", "slopes", "intercept"])

    fitted = able.select("entity_id", "n", "s", "p").mapInPandas(solve, "entity_id string, slopes array<double>, intercept double")
    predicted = F.col("intercept") + F.aggregate(F.zip_with("slopes", F.array(*features), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = whole.where("held_out").join(fitted, "entity_id").groupBy("entity_id").agg(F.count("*").alias("n_holdout"), F.avg(F.abs(F.col("target") - predicted)).alias("model_mae"), F.avg(F.abs(F.col("target") - F.col("baseline"))).alias("baseline_mae"))
    return scored.withColumn("presented", choose(F.col("baseline_mae"), F.col("model_mae")))


def forecast_timeline(observed: DataFrame, ahead: DataFrame) -> DataFrame:
    """Observed medians a day, then medians of predictions and bands a day."""
    past = observed.groupBy("day").agg(F.median("displacement_km").alias("median")).select("day", "median", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("predicted"))
    future = ahead.groupBy("day").agg(F.median("predicted").alias("median"), F.median("low").alias("low"), F.median("high").alias("high")).withColumn("predicted", F.lit(True))
    return past.unionByName(future)


def cell_examples(df: DataFrame, cutoff: str) -> DataFrame:
    """(entity_id, day, cell, target_cell, held_out) of days in turn; rows without a cell on either day are left out."""
    track = Window.partitionBy("entity_id").orderBy("day")
    pairs = df.select("entity_id", "day", "cell", F.lead("day").over(track).alias("target_day"), F.lead("cell").over(track).alias("target_cell"))
    whole = pairs.where("datediff(target_day, day) = 1 and cell is not null and target_cell is not null")
    return whole.withColumn("held_out", F.col("target_day") >= F.lit(cutoff).cast("date"))


def cell_transitions(train: DataFrame) -> DataFrame:
    """(cell, next_cell): the most common next cell; of equal counts the one seen first in (entity, day) order."""
    counts = train.groupBy("cell", "target_cell").agg(F.count("*").alias("n"), F.min(F.struct("entity_id", "day")).alias("first"))
    order = Window.partitionBy("cell").orderBy(F.desc("n"), "first")
    return counts.withColumn("place", F.row_number().over(order)).where("place = 1").select("cell", F.col("target_cell").alias("next_cell"))


def next_cell_accuracy(examples: DataFrame) -> DataFrame:
    """(entity_id, n, model_accuracy, baseline_accuracy) on held-out rows; a cell not seen in training stays."""
    scored = examples.where("held_out").join(cell_transitions(examples.where("not held_out")), "cell", "left")
    return scored.groupBy("entity_id").agg(F.count("*").alias("n"), F.avg((F.coalesce("next_cell", "cell") == F.col("target_cell")).cast("double")).alias("model_accuracy"), F.avg((F.col("cell") == F.col("target_cell")).cast("double")).alias("baseline_accuracy"))


def next_cell_forward(df: DataFrame, examples: DataFrame, horizon: int) -> DataFrame:
    """(entity_id, step, day, cell): each animal's walk from its last cell along the transitions; a join a step."""
    moves = cell_transitions(examples.where("not held_out"))
    at = df.where("cell is not null").groupBy("entity_id").agg(F.max("day").alias("last"), F.max_by("cell", "day").alias("cell"))
    steps = None
    for step in range(1, horizon + 1):
        at = at.join(moves, "cell", "left").select("entity_id", "last", F.coalesce("next_cell", "cell").alias("cell"))
        rows = at.select("entity_id", F.lit(step).alias("step"), F.date_add("last", step).alias("day"), "cell")
        steps = rows if steps is None else steps.union(rows)
    return steps
