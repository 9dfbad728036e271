"""Evaluation: losses, metrics, calibration and the robustness matrix."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta import constants as K
from terradelta.functions import physics as P


def explode_subsets(df: DataFrame, subsets=K.SENSOR_SUBSETS) -> DataFrame:
    """One copy of every row per sensor subset, with the subset's name and sensors."""
    rows = F.array(*[F.struct(F.lit(n).alias("subset"), F.array(*[F.lit(s) for s in ss]).alias("sensors")) for n, ss in subsets.items()])
    return df.withColumn("__s", F.explode(rows)).select("*", "__s.*").drop("__s")


def _unit_hash(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) fixed by the keys: the same tile draws the same value on every run and retry (and anywhere, as
    it is the first 32 bits of an MD5)."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def sensor_dropout(tiles: DataFrame, key: Column, probs: dict[str, float], seed: int = 0) -> DataFrame:
    """Drop whole sensors per tile at random, never all that were observed.

    ``tiles`` has ``has_s1``/``has_s2``; adds ``keep_s1``/``keep_s2`` for both periods together.
    """
    drop = {s: (_unit_hash(seed + i, key) < probs.get(s, 0.0)) & F.col(f"has_{s}") for i, s in enumerate(K.SENSORS)}
    left = F.lit(False)
    for s in K.SENSORS:
        left = left | (F.col(f"has_{s}") & ~drop[s])
    return tiles.withColumns({f"keep_{s}": ~(drop[s] & left) for s in K.SENSORS})


def augment(r: Column, c: Column, size: Column | int, turns: Column, flip: Column) -> tuple[Column, Column]:
    """New (row, col) of a pixel after ``turns`` quarter turns counter-clockwise and an optional left-right flip."""
    last = (F.lit(size) if isinstance(size, int) else size) - 1
    nr = F.when(turns == 0, r).when(turns == 1, last - c).when(turns == 2, last - r).otherwise(c)
    nc = F.when(turns == 0, c).when(turns == 1, r).when(turns == 2, last - c).otherwise(last - r)
    return nr, F.when(flip, last - nc).otherwise(nc)


def bce_with_logits(z: Column, y: Column) -> Column:
    """Binary cross-entropy in the form that does not overflow."""
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def masked_loss(df: DataFrame, channels, change: str, keys=(), change_weight: float = 0.5, dice_weight: float = 1.0) -> DataFrame:
    """Sum over task channels of BCE + Dice, plus weighted change BCE, over labelled pixels only.

    ``df`` has ``z_<channel>`` logits and ``y_<channel>`` labels (NULL = ignore). One aggregate; an empty channel adds 0.
    """
    aggs = []
    for ch in [*channels, change]:
        z, y = F.col(f"z_{ch}"), F.col(f"y_{ch}").cast("double")
        p, known = P.sigmoid(z), y.isNotNull()
        aggs += [F.avg(F.when(known, bce_with_logits(z, y))).alias(f"bce_{ch}"), F.sum(F.when(known, p * y)).alias(f"py_{ch}"),
                 F.sum(F.when(known, p)).alias(f"p_{ch}"), F.sum(y).alias(f"s_{ch}")]
    sums = df.groupBy(*keys).agg(*aggs)
    total = F.lit(0.0)
    for ch in channels:
        dice = 1 - (2 * F.col(f"py_{ch}") + 1) / (F.col(f"p_{ch}") + F.col(f"s_{ch}") + 1)
        total = total + F.coalesce(F.col(f"bce_{ch}") + dice_weight * dice, F.lit(0.0))
    total = total + F.coalesce(change_weight * F.col(f"bce_{change}"), F.lit(0.0))
    return sums.select(*keys, total.alias("loss"))


def _ratio(a: Column, b: Column, empty=0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty).cast("double"))


def _finish(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    df = df.withColumns({"iou": _ratio(tp, tp + fp + fn, None), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn)})
    pr, rc = F.col("precision"), F.col("recall")
    return df.withColumn("f1", _ratio(2 * pr * rc, pr + rc))


def _binned(df: DataFrame, keys, threshold: float, bins: int) -> DataFrame:
    """Counts per key and confidence bin: everything the metrics need, small whatever the number of pixels."""
    p, y = F.col("p"), F.col("y").cast("int")
    pred = p >= threshold
    return df.withColumn("bin", F.least(F.floor(p * bins), F.lit(bins - 1))).groupBy(*keys, "bin").agg(
        F.sum((pred & (y == 1)).cast("bigint")).alias("tp"), F.sum((pred & (y == 0)).cast("bigint")).alias("fp"),
        F.sum((~pred & (y == 1)).cast("bigint")).alias("fn"), F.sum((p - y) * (p - y)).alias("sq"),
        F.sum(p).alias("sp"), F.sum(y.cast("bigint")).alias("sy"), F.count("*").alias("k"))



def _fold(binned: DataFrame) -> list[Column]:
    gap = F.sum(F.abs(F.col("sp") - F.col("sy")))
    return [*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], (F.sum("sq") / F.sum("k")).alias("brier"),
            (gap / F.sum("k")).alias("ece"), F.sum("k").alias("pixels"), (F.sum("sy") / F.sum("k")).alias("positive_fraction")]


METRICS = ("iou", "f1", "precision", "recall", "brier", "ece", "pixels", "positive_fraction")


def segmentation_metrics(df: DataFrame, keys=(), threshold: float = K.THRESHOLD, bins: int = K.ECE_BINS) -> DataFrame:
    """IoU, F1, precision, recall, Brier, ECE, pixels and positive share of ``(p, y)`` rows per key.

    Pixels are folded once into 15 confidence bins per key; the bins give every number, the calibration error included
    (|sum p - sum y| of a bin over all pixels is |mean p - mean y| times the bin's share).
    """
    return _finish(_binned(df, keys, threshold, bins).groupBy(*keys).agg(*_fold(df))).select(*keys, *METRICS)


def ece_bins(df: DataFrame, bins: int = K.ECE_BINS) -> DataFrame:
    """Reliability table: mean confidence, share of positives and weight of every bin."""
    b = _binned(df, (), K.THRESHOLD, bins)
    return b.select("bin", (F.col("sp") / F.col("k")).alias("mean_p"), (F.col("sy") / F.col("k")).alias("mean_y"), F.col("k").alias("pixels"))


def robustness_matrix(df: DataFrame, subset: str = "subset", event: str = "event") -> DataFrame:
    """Metrics per sensor subset: pooled (event NULL) and per event, plus the mean of the events' IoUs on pooled rows.

    The pixels are read and folded into bins once; the pooled rows come from a grouping set over those bins.
    """
    binned = _binned(df, (subset, event), K.THRESHOLD, K.ECE_BINS)
    # Bins must be pooled before |sum p - sum y| is taken, so both grouping sets keep the bin first.
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "sq", "sp", "sy", "k")]
    sets = binned.groupingSets([[subset, event, "bin"], [subset, "bin"]], subset, event, "bin").agg(
        *sums, F.grouping(event).alias("pooled"))
    rows = _finish(sets.groupBy(subset, event, "pooled").agg(*_fold(sets)))
    means = rows.where("pooled = 0").groupBy(subset).agg(F.avg("iou").alias("event_mean_iou"))
    return rows.join(means, subset).select(
        subset, event, *METRICS, F.when(F.col("pooled") == 1, F.col("event_mean_iou")).alias("event_mean_iou"))


def eval_report(matrix: DataFrame, subset: str = "subset", event: str = "event") -> DataFrame:
    """The report's pooled rows, rounded to four places."""
    cols = ("iou", "f1", "precision", "recall", "ece", "brier", "event_mean_iou")
    return matrix.where(F.col(event).isNull()).select(subset, *[F.round(c, 4).alias(c) for c in cols])


def temperatures() -> list[float]:
    lo, hi = math.log(K.TEMPERATURE_MIN), math.log(K.TEMPERATURE_MAX)
    return [math.exp(lo + (hi - lo) * i / (K.TEMPERATURE_STEPS - 1)) for i in range(K.TEMPERATURE_STEPS)]


def fit_temperature(df: DataFrame, z: str = "z", y: str = "y") -> DataFrame:
    """Temperature with the smallest mean NLL on a log grid (the first one on ties): (temperature, nll).

    All grid points are averages of one aggregate, so the logits are read once and not multiplied.
    """
    grid = temperatures()
    label = F.col(y).cast("double")
    sums = df.where(F.col(z).isNotNull() & F.col(y).isNotNull()).agg(
        F.array(*[F.avg(bce_with_logits(F.col(z) / t, label)) for t in grid]).alias("nlls"))
    best = F.array_position(F.col("nlls"), F.array_min("nlls")).cast("int")
    found = F.array_min("nlls")
    return sums.select(F.coalesce(F.get(F.array(*[F.lit(t) for t in grid]), best - 1), F.lit(1.0)).alias("temperature"), found.alias("nll"))


def collect_labelled(predictions: DataFrame, labels: DataFrame, keys) -> DataFrame:
    """Predictions joined to known labels."""
    return predictions.join(labels.where(F.col("y").isNotNull()), keys)


def model_leaderboard(cards: DataFrame) -> DataFrame:
    """Validation IoU with both sensors per card and task, from ``metrics MAP<task, MAP<subset, iou>>``."""
    return cards.select("model_id", "version", F.explode("metrics").alias("task", "by_subset")).select(
        "model_id", "version", "task", F.try_element_at("by_subset", F.lit("s1+s2")).alias("iou")).where("iou IS NOT NULL")
