"""Spatial joins as equi-joins on grid cells, and lines as tables of segments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import METERS_PER_DEGREE, fraction_on_segment, haversine, mercator_x, mercator_y
from .components import connected_components


def _row_width(row, dy: float):
    """How wide the cells of a row of the grid are, in degrees: no narrower than they are high, in metres, anywhere in the row."""
    edge = F.greatest(F.abs(row * dy), F.abs((row + 1) * dy))
    return dy / F.cos(F.radians(F.least(F.lit(89.0), edge)))


def with_cell(df: DataFrame, lat: str, lng: str, radius: float) -> DataFrame:
    """Adds the grid cell of a point, for a search radius in metres: no side of a cell is shorter than the radius, up to 89 degrees of latitude."""
    dy = radius * 1.02 / METERS_PER_DEGREE
    row = F.floor(F.col(lat) / dy)
    return df.withColumn("_cy", row).withColumn("_cx", F.floor(F.col(lng) / _row_width(F.col("_cy"), dy)))


def near_cells(df: DataFrame, lat: str, lng: str, radius: float) -> DataFrame:
    """Nine rows a point (more beside the 180th meridian): the cells of ``with_cell`` that may hold points within the radius.

    Spark doesn't count what an explode adds, so what is exploded here has a hint against broadcasting it.
    """
    dy = radius * 1.02 / METERS_PER_DEGREE
    x = F.col(lng)
    turns = F.when(x > 179.0, F.array(x, x - 360)).when(x < -179.0, F.array(x, x + 360)).otherwise(F.array(x))
    rows = df.withColumn("_cy", F.explode(F.sequence(F.floor(F.col(lat) / dy) - 1, F.floor(F.col(lat) / dy) + 1))).withColumn("_x", F.explode(turns))
    at = F.floor(F.col("_x") / _row_width(F.col("_cy"), dy))
    return rows.withColumn("_cx", F.explode(F.sequence(at - 1, at + 1))).drop("_x").hint("merge")


def around(df: DataFrame) -> DataFrame:
    """Nine rows a point: its cell and the neighbours, instead of its own cell alone."""
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("y"), F.lit(j).alias("x")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    return df.withColumn("_n", near).withColumns({"_cy": F.col("_cy") + F.col("_n.y"), "_cx": F.col("_cx") + F.col("_n.x")}).drop("_n").hint("merge")


def radius_join(left: DataFrame, right: DataFrame, radius: float, lat: str = "lat", lng: str = "lng", r_lat: str = "r_lat", r_lng: str = "r_lng", distance: str = "dist") -> DataFrame:
    """Pairs of points within ``radius`` metres, with their distance. Column names of the sides must differ.

    The left side, the smaller, is repeated for the nine cells around it; a crowded cell makes a skewed key that Spark splits at run time.
    Latitudes up to 89 degrees, and both sides of the 180th meridian, are covered.
    """
    a = near_cells(left, lat, lng, radius)
    b = with_cell(right, r_lat, r_lng, radius)
    d = haversine(lat, lng, r_lat, r_lng)
    return a.join(b, ["_cy", "_cx"]).withColumn(distance, d).filter(F.col(distance) <= radius).drop("_cy", "_cx")


def circle_join(points: DataFrame, circles: DataFrame, radius: str, lat: str = "lat", lng: str = "lng", r_lat: str = "r_lat", r_lng: str = "r_lng", cell_m: float = 500.0, distance: str = "dist") -> DataFrame:
    """Pairs of a point and a circle (``radius``: a column of metres) that holds it. Circles are repeated for the cells they cover, so each may have any radius."""
    dy = cell_m / METERS_PER_DEGREE
    high = F.col(radius) * 1.02 / METERS_PER_DEGREE
    edge = F.least(F.lit(89.0), F.abs(F.col(r_lat)) + high)
    wide = high / F.cos(F.radians(edge))
    cells = lambda mid, reach: F.sequence(F.floor((F.col(mid) - reach) / dy), F.floor((F.col(mid) + reach) / dy))
    covered = circles.withColumn("_cy", F.explode(cells(r_lat, high))).withColumn("_cx", F.explode(cells(r_lng, wide)))
    placed = points.withColumns({"_cy": F.floor(F.col(lat) / dy), "_cx": F.floor(F.col(lng) / dy)})
    return placed.join(covered.hint("merge"), ["_cy", "_cx"]).withColumn(distance, haversine(lat, lng, r_lat, r_lng)).filter(F.col(distance) <= F.col(radius)).drop("_cy", "_cx")


def segments(points: DataFrame, line: str, order: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Consecutive points of a line as segments: line, seg_no, x1, y1, x2, y2, len_deg, cum_deg, total_deg, len_m, cum_m (sums before the segment).

    Repeated neighbours make no segment.
    """
    w = W.partitionBy(line).orderBy(order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    pairs = points.select(line, order, F.col(lng).alias("x2"), F.col(lat).alias("y2"), F.lag(lng).over(w).alias("x1"), F.lag(lat).over(w).alias("y1"))
    pairs = pairs.filter(F.col("x1").isNotNull() & ((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2"))))
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    out = pairs.withColumns({"len_deg": length, "len_m": haversine("y1", "x1", "y2", "x2"), "seg_no": F.row_number().over(w)})
    return out.withColumns({
        "cum_deg": F.coalesce(F.sum("len_deg").over(before), F.lit(0.0)), "cum_m": F.coalesce(F.sum("len_m").over(before), F.lit(0.0)),
        "total_deg": F.sum("len_deg").over(W.partitionBy(line)),
    }).drop(order)


def located(pairs: DataFrame, keys: list[str], lat: str = "lat", lng: str = "lng", keep: tuple[str, ...] = (), each=None) -> DataFrame:
    """For rows of points with segments: per key the place on the line nearest in degrees, as fraction, metres away, and the snapped point; ``keep``: columns of the nearest row to keep.

    ``each``: a function that adds columns to the rows once they have sx, sy and fraction.
    """
    t = fraction_on_segment(F.col(lng), F.col(lat), "x1", "y1", "x2", "y2")
    placed = pairs.withColumn("t", t).withColumns({"sx": F.col("x1") + F.col("t") * (F.col("x2") - F.col("x1")), "sy": F.col("y1") + F.col("t") * (F.col("y2") - F.col("y1"))})
    square = F.pow(F.col(lng) - F.col("sx"), 2) + F.pow(F.col(lat) - F.col("sy"), 2)
    fraction = (F.col("cum_deg") + F.col("t") * F.col("len_deg")) / F.col("total_deg")
    placed = placed.withColumn("fraction", fraction)
    placed = each(placed) if each else placed
    best = placed.select(*keys, "seg_no", "sx", "sy", *keep, square.alias("_sq"), "fraction", haversine(lat, lng, "sy", "sx").alias("away_m")).groupBy(*keys).agg(
        F.min_by(F.struct("fraction", "away_m", "sy", "sx", *keep), F.struct("_sq", "seg_no")).alias("b")
    )
    return best.select(*keys, "b.fraction", "b.away_m", F.col("b.sy").alias("snap_lat"), F.col("b.sx").alias("snap_lng"), *[F.col("b")[x].alias(x) for x in keep])


#: Radii to a side of ``line_join``'s cells: larger ones repeat a segment less often and compare more points with it. Cells to a side of its regions, and tasks for each of a session's
#: shuffle partitions that regions are dealt to, since pairs are many times the rows that are moved.
LINE_CELL, REGION, SPREAD = 16, 8, 8


def _followed(segs: DataFrame, reach_x: float, reach_y: float) -> DataFrame:
    """Segments with what ``_row`` asks for: _flat (the longer axis is x), the reach _along it and _across, both ends _a and _z as (u, v) in its order, _slope."""
    c = F.col
    flat = F.abs(c("x2") - c("x1")) >= F.abs(c("y2") - c("y1"))
    ends = [F.when(flat, F.struct(c(f"x{i}").alias("u"), c(f"y{i}").alias("v"))).otherwise(F.struct(c(f"y{i}").alias("u"), c(f"x{i}").alias("v"))) for i in (1, 2)]
    at = segs.withColumns({"_flat": flat, "_along": F.when(flat, reach_x).otherwise(reach_y), "_across": F.when(flat, reach_y).otherwise(reach_x), "_a": F.least(*ends), "_z": F.greatest(*ends)})
    return at.withColumn("_slope", F.when(c("_z.u") > c("_a.u"), (c("_z.v") - c("_a.v")) / (c("_z.u") - c("_a.u"))).otherwise(0.0))


def _columns(cell: float) -> tuple[Column, Column]:
    """The first and the last column of cells that a segment of ``_followed`` reaches."""
    return F.floor((F.col("_a.u") - F.col("_along")) / cell), F.floor((F.col("_z.u") + F.col("_along")) / cell)


def _row(first: Column, end: Column, cell: float) -> tuple[Column, Column]:
    """The first and the last row of cells that it reaches from column ``first`` to before column ``end``."""
    c = F.col
    place = lambda u: c("_a.v") + c("_slope") * (F.least(c("_z.u"), F.greatest(c("_a.u"), u)) - c("_a.u"))
    low, high = place(first * cell - c("_along")), place(end * cell + c("_along"))
    return F.floor((F.least(low, high) - c("_across")) / cell), F.floor((F.greatest(low, high) + c("_across")) / cell)


def covered_cells(segs: DataFrame, cell: float, reach_x: float, reach_y: float, size: int = 1) -> DataFrame:
    """A row a segment and cell that may hold a point at most the reach from it: _cx, _cy. ``size``: squares of so many cells a side instead of cells, numbered by themselves.

    The segment is followed along its longer axis, column by column of the grid (or row by row), and takes the cells between the lowest and the highest place it has there: along its
    length, not the area of its box, and no cell twice.
    """
    span = lambda a, z: F.explode(F.sequence(F.floor(a / size), F.floor(z / size)))
    at = _followed(segs, reach_x, reach_y)
    at = at.withColumn("_i", span(*_columns(cell)))
    at = at.withColumn("_j", span(*_row(F.col("_i") * size, (F.col("_i") + 1) * size, cell)))
    return at.withColumns({"_cx": F.when(F.col("_flat"), F.col("_i")).otherwise(F.col("_j")), "_cy": F.when(F.col("_flat"), F.col("_j")).otherwise(F.col("_i"))}).drop("_flat", "_along", "_across", "_a", "_z", "_slope", "_i", "_j")


def _cells_within(squares: DataFrame, x: str, y: str, cell: float, reach_x: float, reach_y: float, size: int) -> DataFrame:
    """Rows of ``covered_cells`` (``size``; the square's number as x, y), a row for every column that the segment takes in its square, with _cells: its cells there, numbered from 0 along x and then y."""
    c, at = F.col, _followed(squares, reach_x, reach_y)
    u, v = (F.when(c("_flat"), c(a)).otherwise(c(b)) * size for a, b in ((x, y), (y, x)))
    first, last = _columns(cell)
    at = at.withColumns({"_u": u, "_v": v}).withColumns({"_first": F.greatest(first, c("_u")), "_last": F.least(last, c("_u") + size - 1)}).filter("_first <= _last").withColumn("_i", F.explode(F.sequence("_first", "_last")))
    low, high = _row(c("_i"), c("_i") + 1, cell)
    i, flat = c("_i") - c("_u"), c("_flat")
    held = {"_low": F.greatest(low, c("_v")) - c("_v"), "_high": F.least(high, c("_v") + size - 1) - c("_v"), "_from": F.when(flat, i).otherwise(i * size).cast("int"), "_by": F.when(flat, size).otherwise(1)}
    # as rows of their own these are worked out once, and in compiled code; within the array's function they would be worked out for each cell
    at = at.select(*squares.columns, F.inline(F.array(F.struct(*[e.alias(k) for k, e in held.items()])))).filter("_low <= _high")
    cells = F.transform(F.sequence(c("_low").cast("int"), c("_high").cast("int")), lambda j: c("_from") + j * c("_by"))
    return at.withColumn("_cells", cells).drop(*held)


def line_join(points: DataFrame, segs: DataFrame, line: str, key: str, radius: float, lat: str = "lat", lng: str = "lng", max_lat: float = 60.0, keep: tuple[str, ...] = (), carry: tuple[str, ...] = (), each=None) -> DataFrame:
    """Pairs (point, line) at most ``radius`` metres apart, located on the line: fraction, away_m, snap_lat, snap_lng, the point's columns in ``keep`` and the line's in ``carry``, and its region (_rx, _ry).

    Segments are repeated for the regions along them only, ``REGION`` cells a side; the points of a region are one row, an array by cell, and a segment looks up the cells along it there. So neither
    the cells of segments nor pairs are moved: pairs come dealt out by the region of their point, all pairs of a point (at one place) together. A pair is kept
    if it is near in degrees, by the point's latitude; what is nearer in degrees than a pair within the radius is kept too, so the nearest place stays the nearest.
    ``each``: a function that adds columns to pairs of a point and a segment (with ``t``, sx, sy, fraction, and columns of ``segs``); names them in ``carry`` too. Right up to ``max_lat`` degrees of latitude.
    """
    c = F.col
    cell = LINE_CELL * radius / METERS_PER_DEGREE
    reach_y = radius * 1.05 / METERS_PER_DEGREE
    reach_x = reach_y / math.cos(math.radians(max_lat))
    tasks = SPREAD * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = covered_cells(segs, cell, reach_x, reach_y, REGION).withColumnsRenamed({"_cx": "_rx", "_cy": "_ry"}).withColumn("_len", F.sqrt(F.pow(c("x2") - c("x1"), 2) + F.pow(c("y2") - c("y1"), 2))).repartition(tasks, "_rx", "_ry")
    own = _cells_within(own, "_rx", "_ry", cell, reach_x, reach_y, REGION)
    most = reach_y / F.cos(F.radians(F.least(F.lit(max_lat), F.abs(c(lat)) + reach_y)))
    placed = points.select(F.struct(key, lat, lng, *[x for x in keep if x not in (key, lat, lng)], most.alias("_most")).alias("_p"), F.floor(c(lng) / cell).alias("_x"), F.floor(c(lat) / cell).alias("_y"))
    placed = placed.withColumns({"_rx": F.floor(c("_x") / REGION), "_ry": F.floor(c("_y") / REGION)})
    at = ((c("_y") - c("_ry") * REGION) * REGION + c("_x") - c("_rx") * REGION).cast("int")
    cells = placed.repartition(tasks, "_rx", "_ry").groupBy("_rx", "_ry", at.alias("_at")).agg(F.collect_list("_p").alias("_ps")).groupBy("_rx", "_ry").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_ps"))).alias("_m"))
    grid = cells.select("_rx", "_ry", F.transform(F.sequence(F.lit(0), F.lit(REGION * REGION - 1)), lambda i: c("_m")[i]).alias("_grid"))
    met = own.join(grid.hint("shuffle_hash"), ["_rx", "_ry"]).withColumn("_at", F.explode("_cells")).drop("_cells")
    pairs = met.withColumn("_p", F.explode(F.get("_grid", F.col("_at")))).drop("_grid", "_at").select("*", "_p.*").drop("_p")
    # the box around the segment; what it holds beside the round ends is further away than the radius, or not the nearest
    dx, dy, out = c("x2") - c("x1"), c("y2") - c("y1"), c("_most") * c("_len")
    beside, along = dx * (c(lat) - c("y1")) - dy * (c(lng) - c("x1")), dx * (c(lng) - c("x1")) + dy * (c(lat) - c("y1"))
    pairs = pairs.filter((F.abs(beside) <= out) & (along >= -out) & (along <= c("_len") * c("_len") + out)).drop("_len", "_most")
    return located(pairs, ["_rx", "_ry", key, line], lat, lng, (*keep, *carry), each).filter(c("away_m") <= radius)


def dbscan(points: DataFrame, key: str, eps: float, min_points: int, lat: str = "lat", lng: str = "lng", within: str | None = None) -> DataFrame:
    """key, cluster: the smallest core point's key of the cluster a point belongs to; null for noise.

    Distances are Web-Mercator metres. A border point goes to the cluster with the smallest key (the order-dependent case of the textbook).
    ``within``: clusters stay inside equal values of this column.
    """
    own = points.select(key, *([within] if within else []), F.col(lat).alias("_la"), F.col(lng).alias("_ln")).withColumns({"_x": mercator_x("_ln"), "_y": mercator_y("_la")})
    grid = own.withColumns({"_cx": F.floor(F.col("_x") / eps), "_cy": F.floor(F.col("_y") / eps)})
    near = around(grid).select(F.col(key).alias("a"), F.col("_x").alias("ax"), F.col("_y").alias("ay"), "_cx", "_cy", *([F.col(within).alias("wa")] if within else []))
    pairs = near.join(grid, ["_cx", "_cy"]).filter(F.sqrt(F.pow(F.col("ax") - F.col("_x"), 2) + F.pow(F.col("ay") - F.col("_y"), 2)) <= eps)
    if within:
        pairs = pairs.filter(F.col("wa").eqNullSafe(F.col(within)))
    pairs = pairs.select("a", F.col(key).alias("b"))
    core = pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= min_points).select(F.col("a").alias("core")).hint("merge")
    links = pairs.join(core, F.col("a") == F.col("core"), "left_semi").join(core, F.col("b") == F.col("core"), "left_semi")
    label = core.join(connected_components(links), F.col("core") == F.col("node"), "left").select("core", F.coalesce("component", "core").alias("cluster")).hint("merge")
    member = pairs.join(label, F.col("b") == F.col("core")).groupBy("a").agg(
        F.max(F.when(F.col("a") == F.col("b"), F.col("cluster"))).alias("own"), F.min("cluster").alias("near")
    )
    out = member.select(F.col("a").alias(key), F.coalesce("own", "near").alias("cluster"))
    return points.select(key).join(out.hint("merge"), key, "left")


def split_at_jumps(points: DataFrame, line: str, order: str, lat: str = "lat", lng: str = "lng", jump: float = 0.05) -> DataFrame:
    """Cuts a line where latitude or longitude jumps; parts of one point go. Adds ``part``."""
    w = W.partitionBy(line).orderBy(order)
    cut = (F.abs(F.col(lat) - F.lag(lat).over(w)) > jump) | (F.abs(F.col(lng) - F.lag(lng).over(w)) > jump)
    parts = points.withColumn("_cut", F.coalesce(cut, F.lit(True)).cast("int")).withColumn("part", F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_cut")
    return parts.withColumn("_n", F.count("*").over(W.partitionBy(line, "part"))).filter("_n >= 2").drop("_n")


def densified(segs: DataFrame, steps: int) -> DataFrame:
    """``steps`` evenly spaced points from the start of every segment, its end left out."""
    t = F.col("_i") / F.lit(float(steps))
    return segs.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumns({"lng": F.col("x1") + t * (F.col("x2") - F.col("x1")), "lat": F.col("y1") + t * (F.col("y2") - F.col("y1"))}).withColumnRenamed("_i", "step")
