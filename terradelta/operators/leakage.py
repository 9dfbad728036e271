"""Boxes of different splits that overlap, each with the smallest id it conflicts with.

A box belongs to the cells of its own size: on the level whose cells are as wide as the box or wider (at most twice), so it
touches four cells at most. Boxes of two levels meet in the coarser one's cells: the finer box is known there by its
ancestors, four at most on every level that has boxes of its own.

Boxes that share a cell are not compared with each other. A cell has one representative per split, its smallest id:

* a box that overlaps it has found the smallest conflict this cell can give;
* a box whose smallest conflict so far is lower drops the cell;
* otherwise the box and the cell's boxes are passed on to the cell's quarters they touch, where the representative is another.

So a crowded place, where boxes overlap, is settled at its first representative however many boxes it holds, and quarters
are only made of cells with open boxes. What is open on the last level meets box by box inside cells of a sixty-fourth of the
boxes' size. Touching boxes do not overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.session import persist_table

FINEST = 14  # cells of 360 / 2^14 degrees; smaller boxes belong there
ROUNDS = 6
_BOX = ("w", "s", "e", "n")
_CELL = ("kind", "home", "level", "cx", "cy")


def _level() -> Column:
    size = F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s"), F.lit(360.0 / (1 << FINEST)))
    return F.greatest(F.lit(0), F.floor(F.log2(360.0 / size))).cast("int")


def _touched(level: str) -> str:
    """The cells of ``level`` a box touches (four, unless it is larger than they are)."""
    side = f"(360D / shiftleft(1L, {level}))"
    span = lambda a, b: f"sequence(floor({a} / {side}), greatest(floor({a} / {side}), ceil({b} / {side}) - 1))"
    return f"flatten(transform({span('w', 'e')}, x -> transform({span('s', 'n')}, y -> named_struct('cx', x, 'cy', y))))"


def _quarters(df: DataFrame) -> DataFrame:
    """The quarters of its cell that a box touches."""
    inside = "filter(" + _touched("level + 1") + ", q -> shiftright(q.cx, 1) = cx AND shiftright(q.cy, 1) = cy)"
    df = df.selectExpr("*", f"explode({inside}) AS q")
    return df.withColumns({"level": F.col("level") + 1, "cx": F.col("q.cx"), "cy": F.col("q.cy")}).drop("q")


def _overlap(a: str, b: str) -> str:
    return f"({a}.w < {b}.e AND {b}.w < {a}.e AND {a}.s < {b}.n AND {b}.s < {a}.n)"


def audit_leakage(events: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """key, split and ``conflict_id`` of the events whose box overlaps a box of another split: the smallest such event id.

    ``events(key, split, w, s, e, n)``; a row without split or box conflicts with nothing. Rows of one key are one event per
    split.
    """
    boxes = events.where("split IS NOT NULL AND w IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL AND n IS NOT NULL")
    boxes = persist_table(boxes.select(F.col(key).alias("id"), "split", *_BOX, _level().alias("home")).distinct(), "leak-boxes")
    levels = sorted(r[0] for r in boxes.select("home").distinct().collect())  # FINEST + 1 at most
    if not levels:
        return events.select(key, "split", F.col(key).alias("conflict_id")).limit(0)
    used = F.array(*[F.lit(x) for x in levels])
    # kind 0: boxes in cells of their own level, met by boxes of that level or finer ones; kind 1: the reverse
    own = boxes.withColumn("level", F.col("home"))
    coarser = boxes.withColumn("level", F.explode(F.filter(used, lambda x: x < F.col("home"))))
    split_up = lambda df, kind: df.withColumn("kind", F.lit(kind)).selectExpr("*", f"explode({_touched('level')}) AS c").withColumns(
        {"home": F.col("level"), "cx": F.col("c.cx"), "cy": F.col("c.cy")}).drop("c")
    cells = persist_table(split_up(own, 0).unionByName(split_up(coarser, 1)), "leak-cells")
    open_ = persist_table(split_up(own, 0).unionByName(split_up(coarser, 0)).unionByName(split_up(own, 1)), "leak-open")
    found = None
    for k in range(rounds + 1):
        first = cells.groupBy(*_CELL, "split").agg(F.min("id").alias("rep"), F.min_by(F.struct(*_BOX), "id").alias("box"))
        first = first.select(*_CELL, F.col("split").alias("other"), "rep", "box")
        sides = open_.select("id", "split", *_BOX, *_CELL, *(["other"] if k else []))
        on = [F.col(f"a.{c}") == F.col(f"r.{c}") for c in _CELL] + [F.col("a.other") == F.col("r.other") if k else F.col("a.split") != F.col("r.other")]
        tried = sides.alias("a").join(first.alias("r"), on).selectExpr("a.id", "a.split", *[f"a.{c}" for c in (*_BOX, *_CELL)], "r.other", "r.rep", f"{_overlap('a', 'r.box')} AS hit")
        tried = persist_table(tried, "leak-tried")
        hits = tried.where("hit").select("id", "split", "rep")
        found = hits if found is None else found.union(hits)
        found = persist_table(found.groupBy("id", "split").agg(F.min("rep").alias("rep")), "leak-found")
        left = tried.where("NOT hit").alias("t").join(found.alias("f"), F.expr("t.id = f.id AND t.split = f.split"), "left").where("f.rep IS NULL OR t.rep < f.rep")
        left = persist_table(left.select(*[F.col(f"t.{c}").alias(c) for c in ("id", "split", *_BOX, *_CELL, "other")]), "leak-left")
        if left.isEmpty():
            break
        wanted = left.select(*_CELL, F.col("other").alias("split")).distinct()
        cells = cells.join(wanted, [*_CELL, "split"], "left_semi")
        if k == rounds:
            rest = left.alias("a").join(cells.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in _CELL] + [F.col("a.other") == F.col("b.split"), F.expr(_overlap("a", "b"))])
            found = found.union(rest.select("a.id", "a.split", F.col("b.id").alias("rep"))).groupBy("id", "split").agg(F.min("rep").alias("rep"))
        else:
            cells = persist_table(_quarters(cells), "leak-cells")
            open_ = persist_table(_quarters(left), "leak-open")
    return found.select(F.col("id").alias(key), "split", F.col("rep").alias("conflict_id"))
