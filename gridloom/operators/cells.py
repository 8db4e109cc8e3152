"""Lookup cells with a certified ring: a regular net over the domain, each cell listing every model point that can win inside it.

The side of a cell follows from the number of points, so the net has fewer cells than the model has points, and a probe finds its cell by arithmetic. A cell takes its candidates from the 3 x 3 block around
it. They are complete if the ``k``-th of them is nearer to every corner of the cell than the block's border; such a cell is certified. The others look again in blocks of twice the size. No step
refines cells or regroups the model, so a model on a regular axis is done in one or two rounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridloom.session import materialise

#: Points of a cell on average, for each neighbour that is looked for.
OCCUPANCY = 8
#: Points of a block, and of a finished list, beyond which a layout is too uneven for a net of equal cells.
BLOCK_POINTS, LIST_POINTS = 4096, 512
SLACK = 1e-9


@dataclass
class Net:
    """Origin, side and extent of the cells."""

    lat0: float
    lon0: float
    side: float
    rows: int
    columns: int

    def cell_sql(self, lat: str, lon: str) -> str:
        """Cell number of a position inside the domain; the far edges belong to the last cells."""
        place = lambda v, low, most: f"least(greatest(CAST(floor(({v} - ({low}D)) / {self.side}D) AS BIGINT), 0L), {most - 1}L)"
        return f"{place(lat, self.lat0, self.rows)} * {self.columns}L + {place(lon, self.lon0, self.columns)}"


def net_over(domain: tuple[float, float, float, float], points: int, k: int) -> Net:
    low, high, west, east = domain
    height, width = max(high - low, 1e-6), max(east - west, 1e-6)
    cells = max(1.0, points / (OCCUPANCY * max(1.0, k / 2)))
    side = max(math.sqrt(height * width / cells), height / 1e6, width / 1e6)
    return Net(low, west, side, max(1, math.ceil(height / side)), max(1, math.ceil(width / side)))


def _open_cells(spark: SparkSession, net: Net) -> DataFrame:
    """All cells with their boxes, widened a little against rounding."""
    return spark.range(net.rows * net.columns).selectExpr("id AS cell", f"id DIV {net.columns} AS x", f"id % {net.columns} AS y").selectExpr(
        "*", f"{net.lat0}D + x * {net.side}D - {SLACK}D AS a0", f"{net.lat0}D + (x + 1) * {net.side}D + {SLACK}D AS a1",
        f"{net.lon0}D + y * {net.side}D - {SLACK}D AS b0", f"{net.lon0}D + (y + 1) * {net.side}D + {SLACK}D AS b1",
    )


def _blocks(points: DataFrame, net: Net, level: int) -> DataFrame:
    """``bx, by, near``: the points of the 3 x 3 block around each cell of a level that has any."""
    side = net.side * 2**level
    around = "explode(array(-1L, 0L, 1L))"
    placed = points.selectExpr(
        "*", f"CAST(floor((lat - ({net.lat0}D)) / {side}D) AS BIGINT) AS px", f"CAST(floor((lon_at - ({net.lon0}D)) / {side}D) AS BIGINT) AS py"
    ).selectExpr("*", f"{around} AS dx").selectExpr("*", f"{around} AS dy").selectExpr("*", "px + dx AS bx", "py + dy AS by")
    rows, columns = (math.ceil(n / 2**level) for n in (net.rows, net.columns))
    inside = placed.where(f"bx >= 0 AND by >= 0 AND bx < {rows} AND by < {columns}")
    return inside.groupBy("bx", "by").agg(F.expr("count(*) AS n"), F.expr("collect_list(struct(grid_id, lat, lon, lon_at, value)) AS near"))


def _crowd(points: DataFrame, net: Net, level: int) -> int:
    """Points of the fullest cell of a level; counts combine before they are shuffled."""
    side = net.side * 2**level
    counts = points.groupBy(F.expr(f"floor((lat - ({net.lat0}D)) / {side}D)"), F.expr(f"floor((lon_at - ({net.lon0}D)) / {side}D)")).count()
    return counts.agg(F.max("count")).first()[0] or 0


CORNERS = [("a0", "b0"), ("a0", "b1"), ("a1", "b0"), ("a1", "b1")]


def _d2(p: str, lat: str, lon: str) -> str:
    return f"(({p}.lat - ({lat})) * ({p}.lat - ({lat})) + ({p}.lon_at - ({lon})) * ({p}.lon_at - ({lon})))"


def _judge(cells: DataFrame, blocks: DataFrame, net: Net, level: int, k: int, total: int) -> DataFrame:
    """Cells with ``candidates``, and whether they are certified at this level."""
    side = net.side * 2**level
    placed = cells.selectExpr("*", f"shiftright(x, {level}) AS bx", f"shiftright(y, {level}) AS by")
    met = placed.join(blocks, ["bx", "by"], "left").selectExpr(
        "*",
        f"least(a0 - ({net.lat0}D + (bx - 1) * {side}D), {net.lat0}D + (bx + 2) * {side}D - a1, b0 - ({net.lon0}D + (by - 1) * {side}D), {net.lon0}D + (by + 2) * {side}D - b1) AS ring",
    )
    farthest = f"greatest({', '.join(_d2('p', *c) for c in CORNERS)})"
    bounded = met.selectExpr("*", f"IF(n >= {k}, get(array_sort(transform(near, p -> {farthest})), {k - 1}), DOUBLE('Infinity')) AS worst")
    # the k nearest to the middle; whoever loses to all of them at every corner cannot win inside
    first = f"slice(array_sort(transform(near, p -> struct({_d2('p', '(a0 + a1) / 2', '(b0 + b1) / 2')} AS d, p.grid_id, p.lat, p.lon_at))), 1, {k})"
    limits = [f"array_max(transform(first, p -> {_d2('p', *c)})) AS limit{i}" for i, c in enumerate(CORNERS)]
    beaten = " AND ".join(f"{_d2('p', *c)} > limit{i} * {1 + SLACK}D + {SLACK}D" for i, c in enumerate(CORNERS))
    return bounded.selectExpr("*", f"{first} AS first").selectExpr("*", *limits).selectExpr(
        "cell", "x", "y", "a0", "a1", "b0", "b1",
        f"coalesce(n = {total} OR (n >= {k} AND worst < ring * ring * {1 - SLACK}D), false) AS certified",
        f"IF(n <= {k}, near, filter(near, p -> NOT ({beaten}))) AS candidates",
    )


def build_cells(points: DataFrame, total: int, k: int, domain: tuple[float, float, float, float]) -> tuple[DataFrame, Net] | None:
    """``cell, candidates`` for every cell of the net over ``domain``, or None where the layout is too uneven for equal cells.

    ``points``: ``grid_id, lat, lon, lon_at, value``, ``total`` of them. The lists hold all points that can be among the ``k`` nearest of any position of the cell.
    """
    if total == 0:
        return None
    net = net_over(domain, total, k)
    cells, done, level = _open_cells(points.sparkSession, net), None, 0
    while True:
        if _crowd(points, net, level) > max(BLOCK_POINTS // 9, 4 * k):
            return None
        seen = Observation()
        judged = materialise(
            _judge(cells, _blocks(points, net, level), net, level, k, total).observe(
                seen, F.expr("count_if(NOT certified) AS open"), F.expr("max(IF(certified, size(candidates), 0)) AS longest")
            ), f"cells{level}",
        )
        if (seen.get["longest"] or 0) > max(LIST_POINTS, 8 * k):
            return None
        ready = judged.where("certified").select("cell", "candidates")
        done = ready if done is None else done.unionAll(ready)
        if not seen.get["open"]:
            return done, net
        cells, level = judged.where("NOT certified").drop("certified", "candidates"), level + 1
