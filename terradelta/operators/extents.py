"""Connected regions of pixel masks: labelling, sieve, extents and their outlines.

Pixels are labelled tile by tile (a bounded group of tile x tile pixels), then only the labels that touch a tile seam are
joined up, so the iterative part works on a graph far smaller than the image. A region's label is its first pixel in
reading order, written as r * 2^31 + c.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terradelta import constants as K
from terradelta.functions import geo
from terradelta.session import persist_table

TILE = 256
SHIFT = 31


def _label_array(value: np.ndarray) -> np.ndarray:
    """4-connected regions of equal value; each cell gets the smallest flat index of its region, -1 where value < 0."""
    h, w = value.shape
    lab = np.arange(h * w, dtype=np.int64).reshape(h, w)
    same_c = (value[:, 1:] == value[:, :-1]) & (value[:, 1:] >= 0)
    same_r = (value[1:, :] == value[:-1, :]) & (value[1:, :] >= 0)
    while True:
        old = lab.copy()
        m = np.where(same_c, np.minimum(lab[:, 1:], lab[:, :-1]), h * w)
        lab[:, 1:] = np.where(same_c, m, lab[:, 1:])
        lab[:, :-1] = np.where(same_c, np.minimum(lab[:, :-1], m), lab[:, :-1])
        m = np.where(same_r, np.minimum(lab[1:, :], lab[:-1, :]), h * w)
        lab[1:, :] = np.where(same_r, m, lab[1:, :])
        lab[:-1, :] = np.where(same_r, np.minimum(lab[:-1, :], m), lab[:-1, :])
        flat = lab.ravel()
        flat = flat[flat]  # jump to the label of the label: long paths shrink by halves
        lab = flat.reshape(h, w)
        if np.array_equal(lab, old):
            return np.where(value >= 0, lab, -1)


def _label_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    r0, c0 = int(pdf["r"].min()), int(pdf["c"].min())
    r, c = pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0
    value = np.full((r.max() + 1, c.max() + 1), -1, np.int8)
    value[r, c] = pdf["value"].to_numpy()
    lab = _label_array(value)[r, c]
    width = value.shape[1]
    return pdf.assign(local=((lab // width + r0) << SHIFT) + lab % width + c0)


def label_tiles(mask: DataFrame, key: str, tile: int = TILE) -> DataFrame:
    """``mask(key, r, c, value)`` with ``local``: the first pixel of the region within its tile."""
    placed = mask.withColumns({"tile_r": F.floor(F.col("r") / tile).cast("int"), "tile_c": F.floor(F.col("c") / tile).cast("int")})
    schema = T.StructType([*placed.schema.fields, T.StructField("local", T.LongType())])
    return placed.groupBy(key, "tile_r", "tile_c").applyInPandas(_label_tile, schema).drop("tile_r", "tile_c")


def seam_edges(labelled: DataFrame, key: str, tile: int = TILE) -> DataFrame:
    """Pairs of tile labels that touch across a seam with the same value: only pixels on tile borders are joined."""
    c = F.col
    right = labelled.where(c("c") % tile == tile - 1).select(key, "r", (c("c") + 1).alias("c"), "value", c("local").alias("a"))
    below = labelled.where(c("r") % tile == tile - 1).select(key, (c("r") + 1).alias("r"), "c", "value", c("local").alias("a"))
    first = labelled.where((c("c") % tile == 0) | (c("r") % tile == 0)).select(key, "r", "c", "value", c("local").alias("b"))
    return right.unionByName(below).join(first, [key, "r", "c", "value"]).select(key, "a", "b").distinct()


def _join_low(edges: DataFrame, key: str, low: DataFrame, salts: int) -> DataFrame:
    """Edges with the value ``low`` has for their node u; the edges of a node with very many are spread over salts."""
    many = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
    few = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.join(few.hint("merge"), [key, "u", "salt"]).drop("salt")  # copies, which the planner does not count


def join_labels(edges: DataFrame, key: str, salts: int = 8) -> DataFrame:
    """(key, node, label): smallest node of every connected set of ``edges(key, a, b)``.

    Alternates two steps on the edge list until it is a set of stars: every node hands its larger neighbours to its
    smallest neighbour, then its smaller ones. Both are a partial min aggregate and an equi-join; rounds grow with the
    logarithm of the longest chain. Each round is written to the shared folder, so a lost executor costs one round.
    """
    c = F.col
    edges = edges.where("a <> b").select(key, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, seen = persist_table(edges, "seams"), None
    while True:
        both = edges.unionByName(edges.select(key, c("v").alias("u"), c("u").alias("v")))
        low = both.groupBy(key, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = _join_low(both, key, low, salts).where("v > u").select(key, c("v").alias("u"), c("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy(key, "u").agg(F.min("v").alias("m"))
        small = _join_low(large, key, low, salts).select(key, F.explode(F.array(
            F.struct(c("u").alias("u"), c("m").alias("v")), F.struct(c("v").alias("u"), c("m").alias("v")))).alias("e"))
        edges = persist_table(small.select(key, "e.u", "e.v").where("u <> v").distinct(), "seams")
        h = F.xxhash64("u", "v")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())
        if now == seen:
            return edges.select(key, c("u").alias("node"), c("v").alias("label"))
        seen = now


def connected_components(mask: DataFrame, key: str, tile: int = TILE) -> DataFrame:
    """``mask(key, r, c, value)`` -> plus ``label``: 4-connected regions of equal value per key."""
    labelled = persist_table(label_tiles(mask, key, tile), "tile-labels")
    stars = join_labels(seam_edges(labelled, key, tile), key)
    merged = labelled.join(stars.withColumnRenamed("node", "local"), [key, "local"], "left")
    return merged.withColumn("label", F.coalesce("label", "local")).drop("local")


def sieve(mask: DataFrame, key: str, min_pixels: int = K.SIEVE_PIXELS, tile: int = TILE) -> DataFrame:
    """Replace regions smaller than ``min_pixels`` (either value) by the value of their largest neighbour.

    A small neighbour points on to its own largest neighbour, until a region that is large enough; a chain that never
    reaches one leaves its regions as they are. ``mask(key, r, c, value)`` must hold every pixel of the grid.
    """
    c = F.col
    px = persist_table(connected_components(mask, key, tile), "regions")
    size = px.groupBy(key, "label").agg(F.count("*").alias("pixels"), F.max("value").alias("value"))
    small = size.where(c("pixels") < min_pixels)
    around = F.array(*[F.struct((c("r") + dr).alias("r"), (c("c") + dc).alias("c")) for dr, dc in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    rim = px.join(small.select(key, "label"), [key, "label"], "left_semi").select(key, c("label").alias("me"), F.explode(around).alias("p"))
    rim = rim.select(key, "me", c("p.r").alias("r"), c("p.c").alias("c"))
    touch = rim.join(px.select(key, "r", "c", "label"), [key, "r", "c"]).where("label <> me").select(key, "me", "label").distinct()
    touch = touch.join(size, [key, "label"])
    biggest = touch.groupBy(key, "me").agg(F.min_by(F.struct("label", "pixels", "value"), F.struct((-c("pixels")).alias("p"), c("label"))).alias("n"))
    ptr = persist_table(biggest.select(key, "me", c("n.label").alias("to"), (c("n.pixels") >= min_pixels).alias("done"), c("n.value").alias("value")), "sieve")
    while ptr.where(~c("done") & (c("to") != c("me"))).limit(1).count():
        step = ptr.select(key, c("me").alias("to"), c("to").alias("to2"), c("done").alias("done2"), c("value").alias("value2"))
        nxt = ptr.join(step, [key, "to"], "left").select(
            key, "me", F.when(c("done"), c("to")).otherwise(F.coalesce("to2", "to")).alias("to"),
            F.when(c("done"), True).otherwise(F.coalesce("done2", F.lit(False))).alias("done"),
            F.when(c("done"), c("value")).otherwise(F.coalesce("value2", "value")).alias("value"))
        # A region that points back at itself sits in a cycle of small regions and stays.
        nxt = persist_table(nxt, "sieve")
        if nxt.exceptAll(ptr).limit(1).count() == 0:
            break
        ptr = nxt
    new = ptr.where("done").select(key, c("me").alias("label"), c("value").alias("new_value"))
    return px.join(new, [key, "label"], "left").select(key, "r", "c", F.coalesce("new_value", "value").alias("value"))


def extent_features(regions: DataFrame, grids: DataFrame, key: str) -> DataFrame:
    """Area, box and centroid (lon/lat) per labelled region: one aggregate; the area equals that of the outline."""
    px = regions.join(grids.select(key, "epsg", "res", "x0", "y0"), key)
    x = F.col("x0") + (F.col("c") + 0.5) * F.col("res")
    y = F.col("y0") - (F.col("r") + 0.5) * F.col("res")
    agg = px.groupBy(key, "label").agg(
        F.round(F.count("*") * F.max("res") * F.max("res") / 1e6, 5).alias("area_km2"), F.count("*").alias("pixels"),
        F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"),
        F.avg(x).alias("x"), F.avg(y).alias("y"), F.max("epsg").alias("epsg"))
    out = geo.with_lonlat(agg, "x", "y", "epsg", "lon", "lat")
    return out.withColumns({"lon": F.round("lon", 6), "lat": F.round("lat", 6)}).drop("x", "y", "epsg")


def top_extents(features: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Extents with their rank by area within the key; with a ``limit`` only the largest."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.col("area_km2").desc(), "label")
    ranked = features.withColumn("rank", F.row_number().over(w))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


# Directions: 0 east, 1 south, 2 west, 3 north; the region lies to the right of a directed edge.
_STEP = {0: (0, 1), 1: (1, 0), 2: (0, -1), 3: (-1, 0)}


def outline_edges(regions: DataFrame, key: str) -> DataFrame:
    """Directed unit edges (key, label, vr, vc, dir) around each region, found by looking up the four neighbours.

    Every pixel announces itself to its neighbours; a side nobody of the same region answers is an edge.
    """
    c = F.col
    sides = F.array(*[F.struct(F.lit(d).alias("dir"), (c("r") + dr).alias("nr"), (c("c") + dc).alias("nc"), (c("r") + vr).alias("vr"), (c("c") + vc).alias("vc"))
                      for d, (dr, dc), (vr, vc) in ((0, (-1, 0), (0, 0)), (1, (0, 1), (0, 1)), (2, (1, 0), (1, 1)), (3, (0, -1), (1, 0)))])
    asked = regions.select(key, "label", F.explode(sides).alias("s")).select(key, "label", "s.*")
    have = regions.select(key, "label", c("r").alias("nr"), c("c").alias("nc"))
    return asked.join(have, [key, "label", "nr", "nc"], "left_anti").select(key, "label", "vr", "vc", "dir")


def outline_rings(regions: DataFrame, key: str) -> DataFrame:
    """Closed outlines of labelled regions, corner by corner: (key, label, ring, pos, vr, vc).

    Each edge's successor starts where it ends; where two start, the right turn keeps 4-connected regions apart. Rings
    are ordered by pointer doubling: an edge learns the smallest edge of its ring and its distance to it in as many
    rounds as the ring's length has binary digits. No outline is gathered in one task.
    """
    c = F.col
    edges = outline_edges(regions, key)
    code = ((c("vr") * F.lit(1 << 28).cast("bigint") + c("vc")) * 4 + c("dir")).cast("bigint")
    edges = edges.withColumn("edge", code)
    er = c("vr") + F.element_at(F.array(*[F.lit(_STEP[d][0]) for d in range(4)]), c("dir") + 1)
    ec = c("vc") + F.element_at(F.array(*[F.lit(_STEP[d][1]) for d in range(4)]), c("dir") + 1)
    ends = edges.select(key, "label", "edge", er.alias("vr"), ec.alias("vc"), c("dir").alias("from_dir"))
    nxt = edges.select(key, "label", "vr", "vc", c("dir").alias("to_dir"), c("edge").alias("succ"))
    # Right turn first, then straight on, then left.
    turn = F.pmod(c("to_dir") - c("from_dir"), F.lit(4))
    pref = F.when(turn == 1, 0).when(turn == 0, 1).otherwise(2)
    links = ends.join(nxt, [key, "label", "vr", "vc"]).groupBy(key, "label", "edge").agg(F.min_by("succ", pref).alias("succ"))
    # best = smallest edge met going forward, dist = steps to it, hop = edge after all steps taken so far.
    state = persist_table(links.select(key, "label", "edge", c("succ").alias("hop"), c("edge").alias("best"), F.lit(0).cast("bigint").alias("dist"),
                                       F.lit(1).cast("bigint").alias("span")), "rings")
    while True:
        far = state.select(key, "label", c("edge").alias("hop"), c("hop").alias("hop2"), c("best").alias("best2"), c("dist").alias("dist2"))
        step = state.join(far, [key, "label", "hop"])
        better = c("best2") < c("best")
        new = persist_table(step.select(key, "label", "edge", c("hop2").alias("hop"), F.least("best", "best2").alias("best"),
                                        F.when(better, c("span") + c("dist2")).otherwise(c("dist")).alias("dist"), (c("span") * 2).alias("span")), "rings")
        moved = new.select(key, "label", "edge", "best").join(state.select(key, "label", "edge", c("best").alias("old")), [key, "label", "edge"]).where("best <> old")
        longest = new.agg(F.max("dist").alias("d"), F.max("span").alias("s")).first()
        state = new
        # Every edge has gone round once its span exceeds the longest distance and no smaller edge appears.
        if moved.limit(1).count() == 0 and longest["d"] is not None and longest["s"] > 2 * longest["d"] + 2:
            break
        if longest["d"] is None:
            break
    length = state.groupBy(key, "label", c("best").alias("ring")).agg((F.max("dist") + 1).alias("n"))
    ranked = state.select(key, "label", "edge", c("best").alias("ring"), "dist").join(length, [key, "label", "ring"])
    pos = F.pmod(c("n") - c("dist"), c("n"))
    walk = ranked.select(key, "label", "ring", "n", "edge", pos.alias("pos"))
    at = walk.withColumns({"dir": (c("edge") % 4).cast("int"), "vc": (F.floor(c("edge") / 4) % F.lit(1 << 28)).cast("int"),
                           "vr": F.floor(F.floor(c("edge") / 4) / F.lit(1 << 28)).cast("int")})
    before = at.select(key, "label", "ring", F.pmod(c("pos") + 1, c("n")).alias("pos"), c("dir").alias("prev_dir"))
    return at.join(before, [key, "label", "ring", "pos"]).where("dir <> prev_dir").select(key, "label", "ring", "pos", "vr", "vc")


def extent_polygons(rings: DataFrame, grids: DataFrame, key: str) -> DataFrame:
    """(key, label, outline_pixels, coordinates): each region's outlines as the coordinates of one polygon.

    The outline that runs round the region comes first, counter-clockwise in lon/lat, then its holes, clockwise; every
    ring ends where it starts. ``outline_pixels`` is the area the rings enclose, which equals the region's pixel count.
    A polygon is one record, so the corners of one region meet in one row.
    """
    g = rings.join(grids.select(key, "epsg", "res", "x0", "y0"), key).withColumns(
        {"x": F.col("x0") + F.col("vc") * F.col("res"), "y": F.col("y0") - F.col("vr") * F.col("res")})
    g = geo.with_lonlat(g, "x", "y", "epsg", "lon", "lat")
    corner = F.struct("pos", F.col("vr").cast("double").alias("vr"), F.col("vc").cast("double").alias("vc"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))
    one = g.groupBy(key, "label", "ring").agg(F.sort_array(F.collect_list(corner)).alias("p"))
    last = F.element_at("p", F.size("p"))
    before = F.concat(F.array(last), F.slice(F.col("p"), F.lit(1), F.size("p") - 1))
    twice = F.aggregate(F.zip_with("p", before, lambda b, a: a["vc"] * b["vr"] - b["vc"] * a["vr"]), F.lit(0.0), lambda x, y: x + y)
    point = F.transform("p", lambda q: F.array(q["lon"], q["lat"]))
    closed = F.reverse(F.concat(point, F.array(F.element_at(point, 1))))
    one = one.select(key, "label", (twice / 2).alias("area"), F.struct((F.col("ring")).alias("ring"), closed.alias("line")).alias("r"))
    out = one.groupBy(key, "label").agg(
        F.sum("area").cast("bigint").alias("outline_pixels"), F.collect_list(F.when(F.col("area") > 0, F.col("r"))).alias("around"),
        F.sort_array(F.collect_list(F.when(F.col("area") < 0, F.col("r")))).alias("holes"))
    return out.select(key, "label", "outline_pixels", F.transform(F.concat("around", "holes"), lambda r: r["line"]).alias("coordinates"))


def outline_lonlat(rings: DataFrame, grids: DataFrame, key: str) -> DataFrame:
    """Outline corners in lon/lat, six decimals."""
    g = rings.join(grids.select(key, "epsg", "res", "x0", "y0"), key).withColumns(
        {"x": F.col("x0") + F.col("vc") * F.col("res"), "y": F.col("y0") - F.col("vr") * F.col("res")})
    out = geo.with_lonlat(g, "x", "y", "epsg", "lon", "lat")
    return out.select(key, "label", "ring", "pos", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))
