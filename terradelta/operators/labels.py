"""Benchmark labels, tile statistics and duplicate ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta import constants as K
from terradelta.operators import grids


def mtbs_labels(severity: Column) -> Column:
    """Mapped burn severity -> 1 burned (2-4), 0 outside fires or greener (NULL, 5), NULL for the rest."""
    return F.when(severity.isNull() | (severity == 5), 0).when(severity.isin(2, 3, 4), 1)


def hansen_labels(loss: Column, cover: Column, year: Column) -> Column:
    """Forest loss in ``year`` -> 1 whatever the cover; no loss on >= 30 % cover -> 0; NULL otherwise."""
    return F.when(loss == year - 2000, 1).when((loss == 0) & (cover >= K.GFC_FOREST), 0)


def raster_labels(value: Column) -> Column:
    """A label raster as it is; 255 and no data are ignored."""
    return F.when(value.isNotNull() & (value != K.IGNORE), value.cast("int"))


def gfc_tile_names(w: Column, s: Column, e: Column, n: Column) -> Column:
    """Sorted names of all 10-degree tiles under a box (a tile is named after its upper left corner)."""
    steps = lambda lo, hi: F.sequence(lo.cast("int"), hi.cast("int"), F.lit(10))
    tops = steps(F.ceil(s / 10) * 10, F.ceil(n / 10) * 10)
    lefts = steps(F.floor(w / 10) * 10, F.floor(e / 10) * 10)
    name = lambda t, l: F.concat(  # noqa: E731, E741
        F.lpad(F.abs(t).cast("string"), 2, "0"), F.when(t >= 0, "N").otherwise("S"), F.lit("_"),
        F.lpad(F.abs(l).cast("string"), 3, "0"), F.when(l >= 0, "E").otherwise("W"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(tops, lambda t: F.transform(lefts, lambda l: name(t, l))))))


def gfc_mosaic(df: DataFrame, keys, value: str, tile: str = "tile") -> DataFrame:
    """First known value per pixel over tiles in name order; of several values of one tile the smallest."""
    known = F.when(F.col(value).isNotNull(), F.struct(tile, value))
    return df.groupBy(*keys).agg(F.min(known).alias("__first")).select(*keys, F.col(f"__first.{value}").alias(value))


def task_labels(df: DataFrame, source: Column, task: Column, weak: Column, severity: Column, loss: Column,
                cover: Column, raster: Column, year: Column, raster_path: Column) -> DataFrame:
    """Target label and label source of every pixel of an event, by the event's label ``source``.

    ``raster_path`` is where an event's label raster comes from. Without a source floods take the consensus label; other
    tasks get the error column filled.
    """
    return df.withColumns(
        {
            "label": F.when(source == "mtbs", mtbs_labels(severity)).when(source == "hansen", hansen_labels(loss, cover, year))
            .when(source == "raster", raster_labels(raster)).when(source.isNull() & (task == "flood"), weak),
            "label_source": F.when(source.isin("mtbs", "hansen"), F.concat_ws(":", source, year.cast("string")))
            .when(source == "raster", F.concat(F.lit("raster:"), raster_path)).when(source.isNull() & (task == "flood"), F.lit("weak:s1+s2-consensus")),
            "label_error": F.when(source.isNull() & (task != "flood"), F.concat(task, F.lit(" events need a `label:` source (mtbs, hansen or a raster)")))
            .when(~source.isin("mtbs", "hansen", "raster"), F.concat(F.lit("unknown label source '"), source, F.lit("'"))),
        }
    )


def expand_labels(task: Column, label: Column, change: Column, tasks=tuple(K.TASKS)) -> Column:
    """Label channels [one per task ..., change]; the channels of other tasks are NULL."""
    return F.array(*[F.when(task == t, label) for t in tasks], change)


def load_tiles(tiles: DataFrame, splits, task: Column, tasks=tuple(K.TASKS)) -> DataFrame:
    """Pixels of the wanted splits with labels expanded. On a dataset partitioned by split this prunes partitions.
    ``error`` is filled where the dataset's task is not among ``tasks``."""
    known = task.isin(*tasks)
    return tiles.where(F.col("split").isin(*splits)).withColumns(
        {"y": F.when(known, expand_labels(task, F.col("label"), F.col("change_label"), tasks)),
         "error": F.when(~known, F.concat(F.lit("not a task of this model: "), task))})


def tile_label_stats(px: DataFrame, key: str, size: int, min_labeled: float = K.MIN_LABELED) -> DataFrame:
    """Per tile: share of labelled pixels and of positives among them; tiles under ``min_labeled`` are dropped.

    ``px(key, r, c, width, height, label)``. A pixel near the far edge also belongs to the shifted last tile, so its
    windows are exploded by arithmetic, then folded by one aggregate.
    """
    placed = px.withColumn("win_r", F.explode(grids.windows_of(F.col("r"), F.col("height"), size, size)))
    placed = placed.withColumn("win_c", F.explode(grids.windows_of(F.col("c"), F.col("width"), size, size)))
    stats = placed.groupBy(key, "win_r", "win_c").agg(
        F.avg(F.col("label").isNotNull().cast("int")).alias("labeled_fraction"),
        F.avg("label").alias("positive_fraction"), F.count("*").alias("pixels"))
    return stats.where(F.col("labeled_fraction") >= min_labeled)


def event_label_stats(px: DataFrame, tiles: DataFrame, key: str) -> DataFrame:
    """Per event: tiles kept and label shares over all its pixels."""
    kept = tiles.groupBy(key).agg(F.count("*").alias("tiles"))
    share = px.groupBy(key).agg(F.avg(F.col("label").isNotNull().cast("int")).alias("labeled_fraction"),
                                F.avg("label").alias("positive_fraction"))
    return share.join(kept, key, "left").withColumn("tiles", F.coalesce("tiles", F.lit(0).cast("bigint")))


def dataset_index(events: DataFrame, stats: DataFrame, dataset: str, version: str, task: str, tile: int, key: str) -> DataFrame:
    """One index row per event: dataset, its settings, split, bounds and label statistics (tile rows stay a table)."""
    return events.join(stats, key).select(
        F.lit(dataset).alias("dataset"), F.lit(version).alias("version"), F.lit(task).alias("task"),
        F.lit(K.PIPELINE_VERSION).alias("pipeline"), F.lit(tile).alias("tile"), key, "split", "w", "s", "e", "n",
        "tiles", F.round("labeled_fraction", 4).alias("labeled_fraction"), F.round("positive_fraction", 4).alias("positive_fraction"))


def audit_duplicates(events: DataFrame, key: str) -> DataFrame:
    """Event ids that appear more than once."""
    return events.groupBy(key).agg(F.count("*").alias("times")).where("times > 1")
