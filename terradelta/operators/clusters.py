"""Order-free clusters of event reports: everything linked by chains of reports within 50 km and 10 days of one hazard.

No pair of reports is listed. A cell of the cover is so small that all its reports link (a latitude band of 0.3 degrees,
a width of 35 km at most, 11 days), so cells are the nodes, however many reports they hold. Two neighbouring cells need one
linked pair, or none:

* a pair of representatives within reach, or boxes (of the reports' own coordinates) that lie within reach as a whole, link;
* boxes out of reach do not;
* undecided pairs are cut into quarters of space and time, level by level, and only pairs of undecided parts go on; a pair
  of cells leaves as soon as any links, its own or a chain over other cells, put both into one set. What is left at the last
  level is compared report by report, between sub-cells of some ten metres whose distance is fifty kilometres.

A level's links go through the star contraction of :mod:`terradelta.operators.extents`, between the sets there are. Work before it
grows with the reports once (a partial aggregate into cells) and then with the occupied cells. Reports get their cluster back by their cell;
cells that hold a thousandth of all reports or more (so a thousand at most) are broadcast, so no task gets all of one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta import constants as K
from terradelta.operators.extents import join_labels
from terradelta.session import persist_table

BAND_DEG = 0.3
WIDTH_KM = 35.0  # with the band's 33.4 km a cell's diagonal stays below 50 km
DAYS = K.MERGE_DAYS + 1
SPLIT = 4
LEVELS = 6
HOT_SHARE = 1000
_ROUND = 2 * math.pi * K.EARTH_KM
_REACH = math.degrees(K.MERGE_KM / K.EARTH_KM) * 1.000001
_LIMIT = math.sin(K.MERGE_KM / (2 * K.EARTH_KM)) ** 2
_TURNS = (" - 360", "", " + 360")
_POINT = ("hazard", "lon", "lat", "day")
_CELL = ("hazard", "y", "x", "b")
_PART = ("sx", "sy", "sd")
_BOX = ("lon0", "lon1", "lat0", "lat1", "day0", "day1", "at")


def _around(y: str) -> str:
    """Cells around the globe in band y."""
    nearest = f"(CASE WHEN {y} >= 0 THEN {y} ELSE -({y} + 1) END * {BAND_DEG}D)"
    return f"greatest(1L, ceil({_ROUND!r}D * cos(radians({nearest})) / {WIDTH_KM}D))"


def _cells(reports: DataFrame) -> DataFrame:
    """Reports with their cell; longitudes in [-180, 180)."""
    df = reports.selectExpr("seq", "hazard", "lon - 360 * floor((lon + 180) / 360) AS lon", "cast(lat AS double) AS lat",
                            "datediff(start_date, DATE'1970-01-01') AS day")
    df = df.selectExpr("*", f"least(floor(lat / {BAND_DEG}D), {round(90 / BAND_DEG) - 1}L) AS y", f"floor(day / {DAYS}) AS b")
    return df.selectExpr("*", f"floor((lon + 180) / 360 * {_around('y')}) AS x")


def _boxes(points: DataFrame, keys: list[str], *also: Column) -> DataFrame:
    """Box and representative (the smallest number's place) of every group of points."""
    ends = [F.expr(f"{f}({c}) AS {c}{i}") for c in ("lon", "lat", "day") for i, f in enumerate(("min", "max"))]
    return points.groupBy(*keys).agg(*ends, F.min_by(F.struct("lon", "lat", "day"), "seq").alias("at"), *also)


def _near(a: str, b: str) -> str:
    h = (f"pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + "
         f"cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)")
    return f"(2 * {K.EARTH_KM}D * asin(sqrt({h})) <= {K.MERGE_KM}D AND abs({a}.day - {b}.day) <= {K.MERGE_DAYS})"


def _half(lat: str, lon: str, cos_a: str, cos_b: str) -> str:
    return f"(pow(sin(radians({lat}) / 2), 2) + {cos_a} * {cos_b} * pow(sin(radians({lon}) / 2), 2))"


def _apart(a: str, b: str) -> str:
    """Two groups are surely out of reach by their boxes."""
    gap = lambda c, s="": f"greatest(0D, {a}.{c}0 - ({b}.{c}1{s}), {b}.{c}0{s} - {a}.{c}1)"
    low = lambda t: f"cos(radians(greatest(abs({t}.lat0), abs({t}.lat1))))"
    lon = f"least({', '.join(gap('lon', s) for s in _TURNS)})"
    return f"({gap('day')} > {K.MERGE_DAYS} OR {_half(gap('lat'), lon, low(a), low(b))} * (1 - 1e-9D) > {_LIMIT!r}D)"


def _linked(a: str, b: str) -> str:
    """Two groups surely link: their representatives do, or their boxes lie within reach as a whole."""
    span = lambda c, s="": f"(greatest({a}.{c}1, {b}.{c}1{s}) - least({a}.{c}0, {b}.{c}0{s}))"
    high = lambda t: f"(CASE WHEN {t}.lat0 <= 0 AND {t}.lat1 >= 0 THEN 1D ELSE cos(radians(least(abs({t}.lat0), abs({t}.lat1)))) END)"
    lon = f"least(180D, {', '.join(span('lon', s) for s in _TURNS)})"
    within = f"({span('day')} <= {K.MERGE_DAYS} AND {_half(span('lat'), lon, high(a), high(b))} * (1 + 1e-9D) <= {_LIMIT!r}D)"
    return f"({_near(f'{a}.at', f'{b}.at')} OR {within})"


def _neighbours(cells: DataFrame) -> DataFrame:
    """Every pair of cells that may hold linked reports, each once, whether it surely does, and the boxes of those undecided.
    A cell looks ahead only: to later days, to the bands above on its own days, and along its own band."""
    df = cells.selectExpr("*", f"explode(sequence(b, floor((day1 + {K.MERGE_DAYS}) / {DAYS}))) AS nb")
    df = df.selectExpr("*", f"explode(sequence(CASE WHEN nb > b THEN floor((lat0 - {_REACH!r}D) / {BAND_DEG}D) ELSE y END, floor((lat1 + {_REACH!r}D) / {BAND_DEG}D))) AS ny")
    wide = f"({_REACH!r}D / cos(radians(least(89D, greatest(abs(lat0), abs(lat1)) + {_REACH!r}D))) * 1.001D)"
    df = df.selectExpr("*", f"{_around('ny')} AS n")
    polar = f"greatest(abs(lat0), abs(lat1)) + {_REACH!r}D >= 89"
    df = df.selectExpr("*", f"""explode(CASE WHEN {polar} OR lon1 - lon0 + 2 * {wide} >= 360 THEN sequence(0L, n - 1) ELSE array_distinct(transform(sequence(
        floor((lon0 - {wide} + 180) / 360 * n), floor((lon1 + {wide} + 180) / 360 * n)), v -> pmod(v, n))) END) AS nx""")
    meet = "a.hazard = b.hazard AND a.ny = b.y AND a.nx = b.x AND a.nb = b.b AND (a.nb > a.b OR a.ny > a.y OR a.cell < b.cell)"
    pairs = df.alias("a").join(cells.alias("b"), F.expr(f"{meet} AND NOT {_apart('a', 'b')}"))
    return _judged(pairs, "a", "b", "a.hazard", "a.cell AS a", "b.cell AS b")


def _judged(pairs: DataFrame, a: str, b: str, *columns: str) -> DataFrame:
    """``linked``: two groups that may be in reach surely link; the boxes of those that are undecided go on."""
    linked = _linked(a, b)
    return pairs.selectExpr(*columns, f"{linked} AS linked", *[f"CASE WHEN NOT {linked} THEN {_box(t)} END AS {n}" for t, n in ((a, "abox"), (b, "bbox"))])


def _box(t: str) -> str:
    return f"struct({', '.join(f'{t}.{c} AS {c}' for c in _BOX)})"


def _renamed(df: DataFrame, side: str, stars: DataFrame) -> DataFrame:
    """``df`` with the set that ``stars(hazard, node, label)`` put the set ``side`` into."""
    named = stars.select("hazard", F.col("node").alias(side), F.col("label").alias("__label"))
    return df.join(named, ["hazard", side], "left").withColumn(side, F.coalesce("__label", side)).drop("__label")


def _parted(pairs: DataFrame, stars: DataFrame) -> DataFrame:
    """``pairs(hazard, la, lb, ...)`` whose sides are not in one set yet, by the sets' new names."""
    return _renamed(_renamed(pairs, "la", stars), "lb", stars).where("la <> lb")


def _hooks(pairs: DataFrame) -> DataFrame:
    """Up to four linked pairs of every cell: they join up most of what all linked pairs do."""
    sides = [pairs.groupBy("hazard", s).agg(F.min(t).alias("lo"), F.max(t).alias("hi")).selectExpr("hazard", f"{s} AS a", "explode(array(lo, hi)) AS b") for s, t in ("ab", "ba")]
    return sides[0].union(sides[1])


def cell_sets(points: DataFrame, cells: DataFrame, levels: int = LEVELS) -> DataFrame:
    """hazard, cell, label: the smallest of all cells whose reports chains of links join to the cell's.

    Links are wanted for the sets they make. So every level's links join up sets, and a pair of cells is looked into only
    as long as nothing found before, in whatever place, has put its sides into one set.
    """
    sets = cells.select("hazard", "cell", F.col("cell").alias("label")).distinct()  # numbers may repeat
    pairs = persist_table(_neighbours(cells), "cell-pairs")
    stars = join_labels(_hooks(pairs.where("linked")), "hazard")
    sets = _renamed(sets, "label", stars)
    zero = [F.lit(0).cast("long").alias(f"{side}{s}") for side in "ab" for s in _PART]
    tried = persist_table(_parted(pairs.select("*", F.col("a").alias("la"), F.col("b").alias("lb"), *zero), stars), "cell-open")
    for level in range(1, levels + 1):
        sets, open_ = _joined_up(sets, tried)
        if open_.isEmpty():
            return sets
        pieces = [f"least(floor(({f}) * {SPLIT ** level}), {SPLIT ** level - 1}L) AS {s}" for f, s in zip(("(lon + 180) / 360 * around - x", f"lat / {BAND_DEG}D - y", f"day / {DAYS}D - b"), _PART)]
        wanted = open_.selectExpr("a AS cell").union(open_.selectExpr("b")).distinct()
        inner = points.join(wanted, "cell", "left_semi").selectExpr("*", f"{_around('y')} AS around").selectExpr("cell", "seq", "lon", "lat", "day", *pieces)
        parts = persist_table(_boxes(inner, ["cell", *_PART]), "cell-parts")
        up = lambda t, side: " AND ".join([f"{t}.cell = o.{side}", *[f"floor({t}.{s} / {SPLIT}) = o.{side}{s}" for s in _PART]])
        # A quarter out of reach of the whole other side meets none of its quarters.
        met = open_.alias("o").join(parts.alias("p"), F.expr(f"{up('p', 'a')} AND NOT {_apart('p', 'o.bbox')}"))
        met = met.join(parts.alias("q"), F.expr(f"{up('q', 'b')} AND NOT {_apart('q', 'o.abox')} AND NOT {_apart('p', 'q')}"))
        keep = [f"p.{s} AS a{s}" for s in _PART] + [f"q.{s} AS b{s}" for s in _PART]
        tried = persist_table(_judged(met, "p", "q", "o.hazard", "o.a", "o.b", "o.la", "o.lb", *keep), "cell-pairs")
    sets, open_ = _joined_up(sets, tried)
    if open_.isEmpty():
        return sets
    pieces = [f"least(floor(({f}) * {SPLIT ** levels}), {SPLIT ** levels - 1}L) AS {s}" for f, s in zip((f"(lon + 180) / 360 * {_around('y')} - x", f"lat / {BAND_DEG}D - y", f"day / {DAYS}D - b"), _PART)]
    inner = points.selectExpr("cell", "lon", "lat", "day", *pieces)
    same = lambda t, side: " AND ".join([f"{t}.cell = o.{side}", *[f"{t}.{s} = o.{side}{s}" for s in _PART]])
    rest = open_.alias("o").join(inner.alias("p"), F.expr(same("p", "a"))).join(inner.alias("q"), F.expr(f"{same('q', 'b')} AND {_near('p', 'q')}"))
    return _renamed(sets, "label", join_labels(rest.selectExpr("o.hazard", "o.la AS a", "o.lb AS b").distinct(), "hazard"))


def _joined_up(sets: DataFrame, tried: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets after the linked pairs of ``tried``, and its undecided pairs that are still in two of them."""
    found, open_ = tried.where("linked").selectExpr("hazard", "la AS a", "lb AS b").distinct(), tried.where("NOT linked").drop("linked")
    if found.isEmpty():
        return sets, open_
    stars = join_labels(found, "hazard")
    return _renamed(sets, "label", stars), persist_table(_parted(open_, stars), "cell-open")


def cluster_events(reports: DataFrame, levels: int = LEVELS) -> DataFrame:
    """seq, hazard, cluster of every report: the smallest number among all reports it is linked with by chains of reports
    of its hazard that lie within 50 km and start within 10 days of each other.

    ``reports(seq, hazard, lon, lat, start_date)`` with unique numbers. A report without hazard, place or date is a cluster
    of its own; reports at the same place and day are one point.
    """
    known = reports.where("hazard IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL AND start_date IS NOT NULL")
    placed = persist_table(_cells(known), "report-cells")
    points = placed.groupBy(*_POINT, "y", "x", "b").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
    cells = persist_table(_boxes(points, list(_CELL), F.min("seq").alias("cell"), F.sum("n").alias("reports")), "cells")
    points = persist_table(points.drop("n").join(cells.select(*_CELL, "cell"), list(_CELL)), "cell-points")
    named = cells.select(*_CELL, "cell", "reports").join(cell_sets(points, cells, levels), ["hazard", "cell"])
    named = persist_table(named.select(*_CELL, "reports", F.col("label").alias("cluster")), "cell-clusters")
    total = placed.count()
    hot = named.where(F.col("reports") * HOT_SHARE >= total)  # a thousand cells at most
    rest = named.where(F.col("reports") * HOT_SHARE < total)
    many = placed.join(F.broadcast(hot), list(_CELL)).select("seq", "hazard", "cluster")
    few = placed.join(F.broadcast(hot), list(_CELL), "left_anti").join(rest, list(_CELL)).select("seq", "hazard", "cluster")
    alone = reports.where("hazard IS NULL OR lon IS NULL OR lat IS NULL OR start_date IS NULL").select("seq", "hazard", F.col("seq").alias("cluster"))
    return many.unionByName(few).unionByName(alone)
