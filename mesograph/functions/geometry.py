"""Shape measures as column expressions over ARRAY<STRUCT<x, y>> outlines, so they stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def polygon(*xy: tuple[Column, Column]) -> Column:
    return F.array(*[point(x, y) for x, y in xy])


def box_polygon(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The four corners of a box, clockwise on screen from the top left."""
    return polygon((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def regular_polygon(x: Column, y: Column, r: Column, sides: int = 32) -> Column:
    def corner(i: Column) -> Column:
        angle = i * F.lit(2.0 * math.pi / sides)
        return point(x + r * F.cos(angle), y + r * F.sin(angle))

    return F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), corner)


def next_vertices(v: Column) -> Column:
    """The outline rotated by one, so that zip_with pairs every vertex with its successor."""
    return F.concat(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, 1))


def edges(v: Column) -> Column:
    return F.zip_with(v, next_vertices(v), lambda a, b: F.struct(
        a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - b["x"] * a["y"]


def signed_area(v: Column) -> Column:
    return total(F.zip_with(v, next_vertices(v), _cross)) / F.lit(2.0)


def shoelace(v: Column) -> Column:
    """Area in squared pixels; zero under three vertices."""
    return F.when(F.size(v) >= 3, F.abs(signed_area(v))).otherwise(F.lit(0.0))


def perimeter(v: Column) -> Column:
    return total(F.zip_with(v, next_vertices(v), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])))


def extent(v: Column, axis: str) -> Column:
    side = F.transform(v, lambda p: p[axis])
    return F.array_max(side) - F.array_min(side)


def feret_pairs(v: Column) -> Column:
    """Largest vertex distance by trying all vertices of one outline; for outlines of up to some hundred vertices."""
    def farthest(best: Column, p: Column) -> Column:
        return F.greatest(best, F.aggregate(v, F.lit(0.0), lambda b, q: F.greatest(
            b, (q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))))

    return F.sqrt(F.aggregate(v, F.lit(0.0), farthest))


def vertex_mean(v: Column, axis: str) -> Column:
    return total(F.transform(v, lambda p: p[axis])) / F.size(v)


def area_centroid(v: Column, axis: str) -> Column:
    """Area-weighted centroid; the vertex mean when the outline has no area."""
    twice = 2.0 * signed_area(v)
    moment = total(F.zip_with(v, next_vertices(v), lambda a, b: (a[axis] + b[axis]) * _cross(a, b)))
    flat = (F.size(v) < 3) | (F.abs(twice / 2.0) < 1e-9)
    return F.when(flat, vertex_mean(v, axis)).otherwise(moment / F.nullif(3.0 * twice, F.lit(0.0)))


def ecd(area: Column) -> Column:
    return 2.0 * F.sqrt(F.greatest(area, F.lit(0.0)) / F.lit(math.pi))


def circularity(area: Column, perim: Column) -> Column:
    return F.when(perim > 0, F.least(4.0 * math.pi * area / F.nullif(perim * perim, F.lit(0.0)), F.lit(1.0))
                  ).otherwise(F.lit(0.0))


def aspect(a: Column, b: Column) -> Column:
    short = F.least(a, b)
    return F.when(short > 0, F.greatest(a, b) / F.nullif(short, F.lit(0.0))).otherwise(F.lit(1.0))


def offset_vertices(v: Column, ox: Column, oy: Column) -> Column:
    return F.transform(v, lambda p: point(p["x"] + ox, p["y"] + oy))


def densify(v: Column) -> Column:
    """Outline points about one pixel apart: every edge is cut into ceil(length) equal steps."""
    def along(e: Column) -> Column:
        length = F.hypot(e["x1"] - e["x0"], e["y1"] - e["y0"])
        steps = F.greatest(F.ceil(length), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), steps - 1), lambda k: point(
            e["x0"] + (e["x1"] - e["x0"]) * k / steps, e["y0"] + (e["y1"] - e["y0"]) * k / steps))

    return F.flatten(F.transform(edges(v), along))


def angle_deg(p1: Column, vertex: Column, p2: Column) -> Column:
    ax, ay = p1["x"] - vertex["x"], p1["y"] - vertex["y"]
    bx, by = p2["x"] - vertex["x"], p2["y"] - vertex["y"]
    size = F.hypot(ax, ay) * F.hypot(bx, by)
    cosine = (ax * bx + ay * by) / F.nullif(size, F.lit(0.0))
    return F.when(size == 0, F.lit(0.0)).otherwise(
        F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def thin_path(path: Column, spacing: Column) -> Column:
    """Keep the first point, then each point once the walked length reaches `spacing`, and always the last."""
    start = F.struct(F.slice(path, 1, 1).alias("kept"), F.get(path, F.lit(0)).alias("at"), F.lit(0.0).alias("run"))

    def step(acc: Column, p: Column) -> Column:
        run = acc["run"] + F.hypot(p["x"] - acc["at"]["x"], p["y"] - acc["at"]["y"])
        take = run >= spacing
        return F.struct(F.when(take, F.concat(acc["kept"], F.array(p))).otherwise(acc["kept"]).alias("kept"),
                        p.alias("at"), F.when(take, F.lit(0.0)).otherwise(run).alias("run"))

    def finish(acc: Column) -> Column:
        last = F.get(path, F.size(path) - 1)
        return F.when(F.get(acc["kept"], F.size(acc["kept"]) - 1) == last, acc["kept"]).otherwise(
            F.concat(acc["kept"], F.array(last)))

    body = F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0)))
    return F.when(F.size(path) < 2, path).otherwise(F.aggregate(body, start, step, finish))
