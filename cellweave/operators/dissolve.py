"""Many polygons dissolved into one region: the edges of their union, and the rings these form.

1. Edges are cut where others touch or cross them. Candidates meet in the leaves of a quadtree whose
   tiles are split while they hold more than ``LOAD`` edges (``quadtree``), so a coast of very many
   short edges does not meet in one task. A touching end is used as it is, and a crossing is computed
   once for both edges, so the pieces of either have the same ends, bit for bit.
2. Pieces that lie on each other are one piece with all its polygons; a polygon that has a piece twice
   does not have it.
3. A piece stays if the union covers just one of its sides: the polygons on its left are those with an odd
   number of pieces between it and the far left, those on its right the same, but for the polygons whose
   border it is. So shared borders, and borders inside another polygon, go; holes stay.
4. Pieces that share an end are one ring; rings that touch in a point count as one.

The result has the columns of a boundary and can be used like one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cellweave.session import dealt, stage

#: Edges that a tile of the quadtree may hold, and halvings of a tile at most.
LOAD = 256
DEPTH = 16
ENDS = ["ax", "ay", "bx", "by"]


def _tiles(low: str, high: str, size: Column) -> Column:
    return F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))


def quadtree(boxes: DataFrame, load: int = LOAD) -> DataFrame:
    """``boxes`` (x0, y0, x1, y1 and more) once for each leaf it reaches: ``level, tile_x, tile_y``.

    Tiles start at four times the mean size of a box; a tile with more than ``load`` boxes becomes four,
    as long as boxes are smaller than it. What is crowded is measured, round by round.
    """
    size = boxes.agg((4 * F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).alias("s")).first()["s"] or 1.0
    tile = ["tile_x", "tile_y"]

    def reached(df: DataFrame, side: float, within: tuple[Column, Column] | None) -> DataFrame:
        s = F.lit(side)
        xs, ys = _tiles("x0", "x1", s), _tiles("y0", "y1", s)
        if within is not None:  # of the tile that was split
            px, py = within
            xs, ys = F.filter(xs, lambda k: F.floor(k / 2) == px), F.filter(ys, lambda k: F.floor(k / 2) == py)
        return df.withColumn("tile_x", F.explode(xs)).withColumn("tile_y", F.explode(ys))

    done, level = None, 0
    now = stage(reached(boxes, size, None), "tiles")
    while True:
        counts = now.groupBy(*tile).agg(F.count("*").alias("n"), F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("mean"))
        side = size / 2**level
        crowded = stage(counts.where((F.col("n") > load) & (F.col("mean") < side)).select(*tile), "crowded-tiles")
        none = level == DEPTH or not crowded.head(1)
        leaves = (now if none else now.join(crowded, tile, "left_anti")).withColumn("level", F.lit(level))
        done = leaves if done is None else done.unionByName(leaves)
        if none:
            return done
        split = now.join(crowded, tile).withColumnsRenamed({"tile_x": "px", "tile_y": "py"})
        now = stage(reached(split, side / 2, (F.col("px"), F.col("py"))).drop("px", "py"), "tiles")
        level += 1


def _directed(edges: DataFrame) -> DataFrame:
    """Edges from the lesser end to the greater one, with their polygon."""
    polygon = F.struct(*[F.col(c) for c in ("region_id", "polygon_id", "part_id") if c in edges.columns])
    x1, y1, x2, y2 = (F.col(c) + 0.0 for c in ("x1", "y1", "x2", "y2"))  # no -0.0
    forth = (x1 < x2) | ((x1 == x2) & (y1 < y2))
    ends = [F.when(forth, a).otherwise(b).alias(n) for n, a, b in zip(ENDS, (x1, y1, x2, y2), (x2, y2, x1, y1))]
    return edges.where((x1 != x2) | (y1 != y2)).select(F.xxhash64(polygon).alias("polygon"), *ends)


def _turn(p: str, q: str, r: tuple[str, str]) -> Column:
    """On which side of the line of edge p (q: its prefix) the point r lies."""
    ax, ay, bx, by = (F.col(f"{p}{n}") for n in ENDS)
    return (bx - ax) * (F.col(q + r[1]) - ay) - (by - ay) * (F.col(q + r[0]) - ax)


def cut_points(segments: DataFrame, load: int = LOAD) -> DataFrame:
    """(ax, ay, bx, by, x, y): where other segments touch or cross a segment between its ends."""
    boxes = segments.select(
        *ENDS, F.col("ax").alias("x0"), F.col("bx").alias("x1"), F.least("ay", "by").alias("y0"), F.greatest("ay", "by").alias("y1")
    )
    leaf = ["level", "tile_x", "tile_y"]
    placed = quadtree(boxes, load)
    g = placed.select(*leaf, *[F.col(c).alias(f"g_{c}") for c in (*ENDS, "x0", "y0", "x1", "y1")])
    h = placed.select(*leaf, *[F.col(c).alias(f"h_{c}") for c in (*ENDS, "x0", "y0", "x1", "y1")])
    overlap = (F.col("g_x0") <= F.col("h_x1")) & (F.col("h_x0") <= F.col("g_x1")) & (F.col("g_y0") <= F.col("h_y1")) & (F.col("h_y0") <= F.col("g_y1"))
    gs, hs = (F.struct(*[F.col(f"{s}_{c}") for c in ENDS]) for s in "gh")
    pairs = g.join(h, leaf).where(overlap & (gs != hs))
    a, b = ("ax", "ay"), ("bx", "by")
    pairs = pairs.withColumns(
        {"oa": _turn("g_", "h_", a), "ob": _turn("g_", "h_", b), "ga": _turn("h_", "g_", a), "gb": _turn("h_", "g_", b)}
    )

    def on(side: str, end: tuple[str, str]) -> Column:
        x, y = F.col(f"h_{end[0]}"), F.col(f"h_{end[1]}")
        return (F.col(side) == 0) & x.between(F.col("g_x0"), F.col("g_x1")) & y.between(F.col("g_y0"), F.col("g_y1"))

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    def along(p: str, near: Column, far: Column) -> Column:
        t = near / (near - far)
        ax, ay, bx, by = (F.col(f"{p}{n}") for n in ENDS)
        return point(ax + (bx - ax) * t, ay + (by - ay) * t)

    crosses = (F.sign("oa") * F.sign("ob") < 0) & (F.sign("ga") * F.sign("gb") < 0)
    # The lesser segment gives the crossing for both.
    crossing = F.when(gs < hs, along("g_", F.col("ga"), F.col("gb"))).otherwise(along("h_", F.col("oa"), F.col("ob")))
    touches = [F.when(on(o, e), point(F.col(f"h_{e[0]}"), F.col(f"h_{e[1]}"))) for o, e in (("oa", a), ("ob", b))]
    found = pairs.select(*[F.col(f"g_{c}").alias(c) for c in ENDS], F.explode(F.array_compact(F.array(*touches, F.when(crosses, crossing)))).alias("p"))
    return found.select(*ENDS, F.col("p.x").alias("x"), F.col("p.y").alias("y")).distinct()


def pieces(edges: DataFrame, load: int = LOAD) -> DataFrame:
    """(polygon, ax, ay, bx, by): borders cut at each other; a piece that a polygon has an even number of times is left out."""
    directed = stage(_directed(edges), "directed-edges")
    segments = stage(directed.select(*ENDS).distinct(), "segments")
    ends = segments.select(*ENDS, F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p"))
    points = cut_points(segments, load).unionByName(ends.select(*ENDS, "p.x", "p.y")).distinct()
    # From the lesser end to the greater one, the points of a segment are in order by x, then y.
    after = Window.partitionBy(*ENDS).orderBy("x", "y")
    parts = points.select(*ENDS, F.col("x").alias("px"), F.col("y").alias("py"), F.lead("x").over(after).alias("qx"), F.lead("y").over(after).alias("qy"))
    joined = directed.join(parts.where("qx IS NOT NULL"), ENDS).select("polygon", *[F.col(c).alias(n) for c, n in zip(("px", "py", "qx", "qy"), ENDS)])
    odd = joined.groupBy("polygon", *ENDS).agg(F.count("*").alias("n")).where("n % 2 = 1")
    return stage(odd.select("polygon", *ENDS), "border-pieces")


def _sides(borders: DataFrame, asked: DataFrame, along: str, across: str) -> DataFrame:
    """Pieces asked for, not parallel to the ray, and whether the union covers their near and far side.

    The ray runs towards lesser ``along`` at the middle of the piece's ``across`` range. Pieces meet in bands
    of ``across`` that are as high as pieces are on average, twice. All that a polygon has in a band is in one
    ``part``; pieces that measure small are broadcast, so what they pass is counted where it is found.
    """
    a0, a1, c0, c1 = f"a{along}", f"b{along}", f"a{across}", f"b{across}"
    lesser, greater = F.least(c0, c1), F.greatest(c0, c1)
    slanted = borders.where(F.col(c0) != F.col(c1))
    height = slanted.agg((2 * F.avg(greater - lesser)).alias("h")).first()["h"] or 1.0
    spans = slanted.select("polygon", *[F.col(c).alias(f"f_{c}") for c in ENDS], lesser.alias("low"), greater.alias("high"))
    spans = spans.withColumn("band", F.explode(F.sequence(F.floor(F.col("low") / height), F.floor(F.col("high") / height))))
    middle = (F.col(c0) + F.col(c1)) / 2
    spans = dealt(spans.withColumn("part", F.xxhash64("polygon", "band")), "part")
    pieces_ = asked.withColumns({"at": middle, "place": (F.col(a0) + F.col(a1)) / 2})
    met = spans.join(pieces_.withColumn("band", F.floor(F.col("at") / height)), "band")
    met = met.where((F.col("low") <= F.col("at")) & (F.col("at") < F.col("high")))
    x = F.col(f"f_{a0}") + (F.col("at") - F.col(f"f_{c0}")) * (F.col(f"f_{a1}") - F.col(f"f_{a0}")) / (F.col(f"f_{c1}") - F.col(f"f_{c0}"))
    same = F.struct(*[F.col(f"f_{c}") for c in ENDS]) == F.struct(*ENDS)
    passed = met.where(same | (x < F.col("place"))).groupBy("part", *ENDS, "polygon").agg(
        F.count_if(~same).alias("before"), F.max(same.cast("int")).alias("own")
    )
    odd = F.col("before") % 2 == 1
    return passed.groupBy(*ENDS).agg(F.bool_or(odd).alias("near"), F.bool_or(odd != (F.col("own") == 1)).alias("far"))


def dissolved_edges(edges: DataFrame, load: int = LOAD) -> DataFrame:
    """The edges of the union of all polygons: ax, ay, bx, by, from the lesser end to the greater one."""
    borders = pieces(edges, load)
    distinct = stage(borders.select(*ENDS).distinct(), "distinct-pieces")
    upright = _sides(borders, distinct.where("ay <> by"), "x", "y")
    level = _sides(borders, distinct.where("ay = by"), "y", "x")
    return upright.unionByName(level).where("near <> far").select(*ENDS)


def dissolve(edges: DataFrame, region_id: str = "dissolved", load: int = LOAD) -> DataFrame:
    """The union as a boundary: region_id, polygon_id, ring_id, seg, x1, y1, x2, y2.

    ``ring_id`` tells apart what does not touch; ``seg`` numbers the edges of a ring by their ends.
    """
    kept = stage(dissolved_edges(edges, load), "dissolved-edges")
    ends = stage(
        kept.select(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")).alias("u"), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")).alias("v")),
        "edge-ends",
    )
    label = _labels(ends)
    named = kept.join(label, (F.col("ax") == F.col("node.x")) & (F.col("ay") == F.col("node.y")))
    seg = F.row_number().over(Window.partitionBy("root").orderBy(*ENDS)) - 1
    ring = F.xxhash64("root")
    return named.select(
        F.lit(region_id).alias("region_id"), F.lit(0).cast("long").alias("polygon_id"), ring.alias("ring_id"), seg.alias("seg"),
        *[F.col(c).alias(n) for c, n in zip(ENDS, ("x1", "y1", "x2", "y2"))],
    )


def _labels(ends: DataFrame) -> DataFrame:
    """(node, root): the least end that each end is connected with.

    Each round, a node takes the least root among its neighbours, then the root of its root; the rounds grow
    with the logarithm of a ring's length.
    """
    both = stage(ends.union(ends.select("v", "u")), "neighbours")
    now = stage(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = both.join(now.select(F.col("node").alias("v"), "root"), "v").select(F.col("u").alias("node"), "root")
        # A root hears what its nodes hear, so whole groups join at once.
        heard = near.join(now.select("node", F.col("root").alias("group")), "node").select(F.col("group").alias("node"), "root")
        least = now.unionByName(near).unionByName(heard).groupBy("node").agg(F.min("root").alias("root"))
        up = least.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = stage(least.join(up, "root").select("node", F.least("root", "above").alias("root")), "labels")
        changed = new.join(now.withColumnRenamed("root", "old"), "node").where("root <> old")
        if not changed.head(1):
            return new
        now = new
