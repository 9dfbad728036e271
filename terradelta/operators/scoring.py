"""Model inputs, tile scoring, registry."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terradelta import constants as K
from terradelta.functions import physics as P
from terradelta.operators import grids
from terradelta.operators import maps as M
from terradelta.operators.ordinals import ordinals


def _all_valid(names) -> Column:
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n).isNotNull()
    return ok


def normalize_inputs(df: DataFrame, sensors=K.SENSORS) -> DataFrame:
    """Add ``{stack}_valid`` and replace bands by (x - mean) / std, 0 where the stack is not valid or not wanted."""
    out = {}
    for s, bands in K.BANDS.items():
        for t in K.PERIODS:
            names = [f"{s}_{t}_{b}" for b in bands]
            have = s in sensors and all(n in df.columns for n in names)
            ok = _all_valid(names) if have else F.lit(False)
            for n, mean, std in zip(names, K.NORM_MEAN[s], K.NORM_STD[s]):
                out[n] = F.when(ok, (F.col(n) - mean) / std).otherwise(0.0) if have else F.lit(0.0)
            out[f"{s}_{t}_valid"] = ok
    return df.withColumns(out)


def denormalize(df: DataFrame) -> DataFrame:
    """Undo :func:`normalize_inputs`; invalid pixels become NULL."""
    out = {}
    for s, bands in K.BANDS.items():
        for t in K.PERIODS:
            for b, mean, std in zip(bands, K.NORM_MEAN[s], K.NORM_STD[s]):
                n = f"{s}_{t}_{b}"
                out[n] = F.when(F.col(f"{s}_{t}_valid"), F.col(n) * std + mean)
    return df.withColumns(out)


def exact_median(df: DataFrame, keys, value: str, widths=(1.0, 1.0 / 1024)) -> DataFrame:
    """Exact median per key without gathering a key's values: (keys, median).

    The middle ranks are located in buckets of shrinking width. Each level counts rows per bucket with map-side combine
    and keeps only the rows of the bucket that holds a middle rank; the last level counts equal values.
    """
    c = F.col
    rows = df.where(c(value).isNotNull()).select(*keys, c(value).alias("__v"))
    n = c("__n")
    mids = F.array(F.struct(F.lit(0).alias("mid"), F.floor((n + 1) / 2).alias("rank")),
                   F.struct(F.lit(1).alias("mid"), (F.floor(n / 2) + 1).alias("rank")))
    want = rows.groupBy(*keys).agg(F.count("*").alias("__n")).select(*keys, F.explode(mids).alias("__m"))
    want = want.select(*keys, c("__m.mid").alias("__mid"), c("__m.rank").alias("__rank"))
    path = []
    for i, width in enumerate([*widths, None]):
        name = f"__b{i}"
        rows = rows.withColumn(name, c("__v") if width is None else F.floor(c("__v") / width))
        if path:
            rows = rows.join(want.select(*keys, *path).distinct(), [*keys, *path], "left_semi")
        counts = rows.groupBy(*keys, *path, name).agg(F.count("*").alias("__k"))
        upto = Window.partitionBy(*keys, *path).orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("__upto", F.sum("__k").over(upto))
        start = c("__upto") - c("__k")
        want = want.join(counts, [*keys, *path]).where((c("__rank") <= c("__upto")) & (c("__rank") > start))
        path = [*path, name]
        want = want.select(*keys, "__mid", *path, (c("__rank") - start).alias("__rank"))
    return want.groupBy(*keys).agg(F.avg(path[-1]).alias("median"))


def terrain_inputs(df: DataFrame, keys, elev: str = "elev", slope: str = "slope") -> DataFrame:
    """Height above the request's median elevation and slope, scaled; unknown becomes 0."""
    joined = df.join(exact_median(df, keys, elev), keys, "left")
    return joined.withColumns(
        {
            "rel_elev": F.coalesce((F.col(elev) - F.col("median")) / K.ELEV_SCALE, F.lit(0.0)),
            "rel_slope": F.coalesce(F.col(slope) / K.SLOPE_SCALE, F.lit(0.0)),
        }
    ).drop("median")


def sensor_gate(logits: dict[str, Column], valid: dict[str, Column]) -> dict[str, Column]:
    """Softmax weights over the sensors seen at a pixel; a missing sensor weighs exactly 0, none seen means uniform."""
    top = F.greatest(*[F.when(valid[s], logits[s]) for s in logits])
    e = {s: F.when(valid[s], F.exp(logits[s] - top)).otherwise(F.lit(0.0)) for s in logits}
    total = sum(list(e.values())[1:], list(e.values())[0])
    return {s: F.when(total > 0, e[s] / total).otherwise(F.lit(1.0 / len(logits))) for s in logits}


Scorer = Callable[[pd.DataFrame, int], pd.DataFrame]
"""(pixels of one window, pass number) -> DataFrame with p_target, p_change and w_s1, w_s2, aligned with its rows."""


def score_tiles(pixels: DataFrame, grid_size: DataFrame, key: str, scorer: Scorer, columns,
                tile: int = K.WINDOW_SIZE, stride: int = K.WINDOW_STRIDE, passes: int = 1, each_pass: bool = False) -> DataFrame:
    """Score overlapping windows: one row per (key, window, pixel), whatever the passes; with ``each_pass`` one per ``pass``,
    as the scorer gives it.

    Probabilities are means over the passes, added up pass by pass; the fusion weights are those of the first pass, as they do
    not depend on what a pass drops.

    Every pixel is copied to the windows it lies in (at most four when stride >= tile / 2), by arithmetic on its
    position. A window is one group of at most tile x tile rows: that bound, not the size of a request, limits a task.
    """
    stride = min(stride, tile)
    placed = (
        pixels.select(key, "r", "c", *columns).join(grid_size.select(key, "width", "height"), key)
        .withColumn("win_r", F.explode(grids.windows_of(F.col("r"), F.col("height"), tile, stride)))
        .withColumn("win_c", F.explode(grids.windows_of(F.col("c"), F.col("width"), tile, stride)))
        .drop("width", "height")
    )
    schema = T.StructType([
        placed.schema[key], T.StructField("win_r", T.IntegerType()), T.StructField("win_c", T.IntegerType()),
        *[T.StructField("pass", T.IntegerType())] * each_pass, T.StructField("r", T.IntegerType()), T.StructField("c", T.IntegerType()),
        *[T.StructField(n, T.DoubleType()) for n in ("p_target", "p_change", "w_s1", "w_s2")],
    ])

    def run(window: pd.DataFrame) -> pd.DataFrame:
        window = window.sort_values(["r", "c"], ignore_index=True)
        if each_pass:
            ids = window[[key, "win_r", "win_c", "r", "c"]]
            parts = [ids.assign(**{"pass": k}).join(scorer(window, k).reset_index(drop=True)) for k in range(max(passes, 1))]
            return pd.concat(parts)[[f.name for f in schema.fields]]
        sums = None
        for k in range(max(passes, 1)):
            scored = scorer(window, k).reset_index(drop=True)
            if sums is None:
                out, sums = scored, scored[["p_target", "p_change"]]
            else:
                sums = sums + scored[["p_target", "p_change"]]
        out = window[[key, "win_r", "win_c", "r", "c"]].join(out[["w_s1", "w_s2"]]).join(sums / max(passes, 1))
        return out[[f.name for f in schema.fields]]

    return placed.groupBy(key, "win_r", "win_c").applyInPandas(run, schema)


def blend_windows(scored: DataFrame, key: str) -> DataFrame:
    """Average of all windows that saw a pixel."""
    avg = {"p_target": "target", "p_change": "change", "w_s1": "w_s1", "w_s2": "w_s2"}
    return scored.groupBy(key, "r", "c").agg(*[F.avg(a).alias(b) for a, b in avg.items()])


def finish_scores(blended: DataFrame, pixels: DataFrame, key: str) -> DataFrame:
    """Limit to pixels some sensor observed after the event; uncertainty is the entropy of the mean probability."""
    seen = _all_valid([f"s1_post_{b}" for b in K.S1_BANDS]) | _all_valid([f"s2_post_{b}" for b in K.S2_BANDS])
    out = blended.join(pixels.select(key, "r", "c", seen.alias("observed")), [key, "r", "c"])
    out = out.withColumns({m: F.when(F.col("observed"), F.col(m)) for m in ("target", "change")})
    return out.withColumn("uncertainty", P.binary_entropy(F.col("target")))


def modality_weights(scores: DataFrame, keys) -> DataFrame:
    """Mean fusion weight per sensor over observed pixels."""
    return scores.groupBy(*keys).agg(*[F.avg(F.when(F.col("observed"), F.col(f"w_{s}"))).alias(s) for s in K.SENSORS])


def score_dispatch(pixels: DataFrame, model_id: Column, baseline_scores: Callable[[DataFrame], DataFrame],
                   model_scores: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Physics for baseline requests, the model for the others, in one table with the same columns."""
    is_base = model_id == K.BASELINE_ID
    a, b = baseline_scores(pixels.where(is_base)), model_scores(pixels.where(~is_base))
    return a.unionByName(b, allowMissingColumns=True)


def baseline_card(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(
        F.lit(K.BASELINE_ID).alias("model_id"), F.lit(K.BASELINE_VERSION).alias("version"),
        F.array(*[F.lit(t) for t in K.TASKS]).alias("tasks"), F.lit(None).cast("timestamp").alias("created"))


def registered(trained: DataFrame) -> DataFrame:
    """The baseline's card and the trained ones."""
    return baseline_card(trained.sparkSession).withColumn("is_baseline", F.lit(True)).unionByName(
        trained.select("model_id", "version", "tasks", "created").withColumn("is_baseline", F.lit(False)))


def model_registry(trained: DataFrame) -> DataFrame:
    """Baseline first, then trained cards, newest first; ``position`` numbers the list."""
    listed = [F.col("is_baseline").desc(), F.col("created").desc_nulls_last(), F.col("model_id"), F.col("version")]
    return ordinals(registered(trained), listed, name="position")


def resolve_model(requests: DataFrame, trained: DataFrame) -> DataFrame:
    """The card of every request (request_id, task, model): 'auto' takes the newest trained card for the task, else the
    baseline; otherwise id or id-vVersion must match a card that supports the task. NULL card = unknown model.

    The best card per task and per name is found on the small card table first, so each request meets at most one row
    per join.
    """
    per_task = registered(trained).withColumn("task", F.explode("tasks"))
    newest = [F.col("is_baseline").asc(), F.col("created").desc_nulls_last(), F.col("model_id"), F.col("version")]
    listed = [F.col("is_baseline").desc(), F.col("created").desc_nulls_last(), F.col("model_id"), F.col("version")]
    first = lambda df, keys, order: df.withColumn(
        "__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
    auto = first(per_task, ["task"], newest).select("task", F.lit("auto").alias("model"), "model_id", "version")
    names = per_task.withColumn("model", F.explode(F.array("model_id", F.concat(F.col("model_id"), F.lit("-v"), F.col("version")))))
    named = first(names, ["task", "model"], listed).select("task", "model", "model_id", "version")
    table = auto.unionByName(named.where("model <> 'auto'"))
    return requests.join(table, ["task", "model"], "left")


def baseline_tile_scores(tiles: DataFrame, task: str, sensors=K.SENSORS) -> DataFrame:
    """Physics on normalised tiles: bands back to physical units, unobserved pixels count as 'no change' (p = 0)."""
    return M.predict(denormalize(tiles), task, sensors).withColumn("p", F.coalesce("target", F.lit(0.0)))


def fit_pixel_classifier(train: DataFrame, features, label: str, max_iter: int = 20):
    """Logistic regression on normalised bands, fitted by Spark ML; returns the fitted model over ``features``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    known = train.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double"))
    stages = [VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip"),
              LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter, regParam=1e-4)]
    return Pipeline(stages=stages).fit(known)
