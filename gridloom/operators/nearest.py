"""Exact nearest-point and k-nearest lookups as an equi-join.

A lookup table is built from the model points once: the plane is cut into squares, and each of them
lists every model point that can be among the ``k`` nearest of any position inside it. A probe
finds its square by arithmetic, joins one row and picks from a short list. No probe meets the
whole model, and the probes are shuffled at most once.

Models that are spread about evenly, as forecast grids are, use one net of equal cells (``cells.py``). Others, with dense knots or wide empty spaces, use leaves of many sizes:
cells and point groups are refined together, coarse to fine. A point group leaves the list of a cell
once ``k`` known points beat it at all four corners: the difference of two squared distances is
linear in the position, so a corner-wise win is a win everywhere inside. The lists are therefore complete, whatever
the layout of the points. Points that share a position are one place: a known place counts for as many points as it holds, and a list
names it once, so stacked steps make neither more cells nor longer lists.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from gridloom.functions.coords import finite
from gridloom.operators.cells import Net, build_cells
from gridloom.session import materialise

LEAST_HALF = 512.0    # the plane is at least [-512, 512) in both directions; positions beyond double it
FIRST_LEVEL = 5       # 32 x 32 cells over the plane: a fixed number, whatever the data
STRIDE = 2            # each round cuts a cell into 4 x 4
LAST_LEVEL = 27       # 8e-6 degrees, about the spacing of single-precision coordinates
LIST_SIZE = 64        # a leaf stops refining at this many places, or at PLACES_PER_HIT places or LISTS_PER_HIT points for each hit wanted
PLACES_PER_HIT = 2
LISTS_PER_HIT = 4
SLACK = 1e-9          # guards the pruning against rounding
WORLD = (-90.0, 90.0, -180.0, 180.0)


Q = "PARTITION BY qlevel, qx, qy"


def plane_half(*edges: float) -> float:
    """Half the side of the plane: the least power of two from ``LEAST_HALF`` on that lies beyond all edges."""
    half = LEAST_HALF
    while half <= max(map(abs, edges), default=0.0):
        half *= 2
    return half


def cell_sql(coord: str, level: int | str, half: float) -> str:
    """Cell number at a level. Scaling by powers of two is exact, so cells nest exactly."""
    return f"floor(({coord} + {half}D) / {2 * half}D * pow(2D, {level}))"


def leaf_sql(level: int | str, x: str, y: str) -> str:
    return f"shiftleft(cast({level} AS BIGINT), 56) | shiftleft({x}, 28) | {y}"


def _box_distance(lat: str, lon: str) -> str:
    """Squared distance from a position to the bounding box of a point group."""
    return (
        f"pow(greatest(lat_lo - {lat}, {lat} - lat_hi, 0D), 2) + "
        f"pow(greatest(lon_lo - {lon}, {lon} - lon_hi, 0D), 2)"
    )


def _far_distance(lat: str, lon: str) -> str:
    """Squared distance from a position to the far end of the bounding box: no point of the group is farther."""
    return (
        f"pow(greatest(abs(lat_lo - ({lat})), abs(lat_hi - ({lat}))), 2) + "
        f"pow(greatest(abs(lon_lo - ({lon})), abs(lon_hi - ({lon}))), 2)"
    )


def _known_distance(lat: str, lon: str) -> str:
    return f"pow(rep_lat - ({lat}), 2) + pow(rep_lon - ({lon}), 2)"


CORNERS = [("a0", "b0"), ("a0", "b1"), ("a1", "b0"), ("a1", "b1")]


def _prune(pairs: DataFrame, k: int, half: float) -> DataFrame:
    """Drop point groups that ``k`` known points beat at every corner of the cell.

    The cell edges a0..a1, b0..b1 are widened a little against rounding. ``reach`` is what the
    coarser cell found out already: within it lie ``k`` points of every position. It removes most
    pairs before they are ranked. A known place beats with all of its points (``rep_n``), so the nearest
    places count until they hold ``k``; so do the nearest groups, each as far as the far end of its box.
    """
    slack = SLACK * half / LEAST_HALF
    boxed = pairs.selectExpr("*", f"{2 * half}D / pow(2D, qlevel) AS side").selectExpr(
        "*",
        f"qx * side - {half + slack}D AS a0", f"(qx + 1) * side - {half - slack}D AS a1",
        f"qy * side - {half + slack}D AS b0", f"(qy + 1) * side - {half - slack}D AS b1",
    ).where(
        "pow(greatest(lat_lo - a1, a0 - lat_hi, 0D), 2) + pow(greatest(lon_lo - b1, b0 - lon_hi, 0D), 2) "
        f"<= reach * {1 + SLACK}D + {SLACK}D"
    )
    center = _known_distance("(a0 + a1) / 2", "(b0 + b1) / 2")
    ranked = boxed.selectExpr("*", f"{center} AS to_center").selectExpr(
        "*", *[f"sum({n}) OVER ({Q} ORDER BY to_center, rep_id, nx, ny ROWS UNBOUNDED PRECEDING) - {n} AS {name}" for n, name in (("rep_n", "nearer"), ("n", "nearer_all"))]
    )
    limits = ranked.drop("reach").selectExpr(
        "*", f"sum(rep_n) OVER ({Q}) AS known", f"sum(n) OVER ({Q}) AS known_all",
        *[
            f"max(IF({nearer} < {k}, {distance(*c)}, NULL)) OVER ({Q}) AS {limit}{i}"
            for nearer, distance, limit in (("nearer", _known_distance, "limit"), ("nearer_all", _far_distance, "far")) for i, c in enumerate(CORNERS)
        ],
    )
    kept, reach = [], []
    for known, limit in (("known", "limit"), ("known_all", "far")):
        beaten = " AND ".join(f"{_box_distance(*c)} > {limit}{i} * {1 + SLACK}D + {SLACK}D" for i, c in enumerate(CORNERS))
        kept.append(f"({known} < {k} OR NOT ({beaten}))")
        reach.append(f"IF({known} < {k}, DOUBLE('Infinity'), greatest({limit}0, {limit}1, {limit}2, {limit}3))")
    return limits.where(" AND ".join(kept)).selectExpr("*", f"least({', '.join(reach)}) AS reach")


@dataclass
class NearestIndex:
    """Lookup table of one model: cells of a ``net`` (cell, candidates), or ``leaves`` (leaf_id, candidates by place), the ``levels`` in use and the
    rare ``crowded`` leaves whose lists are kept as rows."""

    leaves: DataFrame
    crowded: DataFrame | None
    levels: list[int]
    k: int
    domain: tuple[float, float, float, float]
    points: DataFrame
    half: float
    wrap: bool
    net: Net | None = None


def model_points(grid: DataFrame, k: int, wrap: bool = False) -> DataFrame:
    """Single-precision coordinates; per position only the ``k`` lowest ids can ever be picked.

    The rank filter is applied before the shuffle too, so a position that repeats in a third of
    the rows does not travel.
    """
    at = Window.partitionBy("lat", "lon").orderBy("grid_id")
    points = grid.select(
        "grid_id",
        F.col("lat").cast("float").cast("double").alias("lat"),
        F.col("lon").cast("float").cast("double").alias("lon"),
        F.col("value").cast("double").alias("value"),
    ).where(finite(F.col("lat")) & finite(F.col("lon")))
    points = points.withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= k).drop("_n")
    points = points.withColumn("lon_at", F.col("lon"))
    if wrap:
        turns = F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0))
        points = points.withColumn("_turn", F.explode(turns)).withColumn(
            "lon_at", F.col("lon") + F.col("_turn")
        ).drop("_turn")
    return points


def _places(points: DataFrame) -> DataFrame:
    """Each position once, with its points (``k`` at most) by id."""
    return points.groupBy("lat", "lon", "lon_at").agg(F.expr("sort_array(collect_list(struct(grid_id, value))) AS at"))


def _groups(places: DataFrame, level: int, half: float) -> DataFrame:
    """Point groups of a level: bounding box, numbers of places and points, and one known place."""
    return (
        places.selectExpr("*", f"{cell_sql('lat', level, half)} AS nx", f"{cell_sql('lon_at', level, half)} AS ny")
        .groupBy("nx", "ny")
        .agg(
            F.expr("count(*) AS places"), F.expr("sum(size(at)) AS n"), F.expr("min(lat) AS lat_lo"), F.expr("max(lat) AS lat_hi"),
            F.expr("min(lon_at) AS lon_lo"), F.expr("max(lon_at) AS lon_hi"),
            F.expr("min(struct(at[0].grid_id AS grid_id, lat, lon_at, size(at) AS n)) AS known"),
        )
        .selectExpr(
            "nx", "ny", "places", "n", "lat_lo", "lat_hi", "lon_lo", "lon_hi", "known.grid_id AS rep_id",
            "known.lat AS rep_lat", "known.lon_at AS rep_lon", "known.n AS rep_n",
        )
    )


def _first_cells(domain, half: float) -> str:
    """First-level cells that touch the domain, as one array (a few tens for the world)."""
    side = 2 * half / (1 << FIRST_LEVEL)
    lat0, lat1, lon0, lon1 = [int((v + half) // side) for v in domain]
    cells = [f"(BIGINT({x}), BIGINT({y}))" for x in range(lat0, lat1 + 1) for y in range(lon0, lon1 + 1)]
    return f"array({', '.join(cells)})"


GROUP = ["nx", "ny", "places", "n", "lat_lo", "lat_hi", "lon_lo", "lon_hi", "rep_id", "rep_lat", "rep_lon", "rep_n"]


def _refine(active: DataFrame, places: DataFrame, level: int, k: int, domain, half: float) -> DataFrame:
    """Cut each cell that needs it into 4 x 4, prune, then replace each point group by its parts.

    Pruning between the two steps keeps the number of pairs small, and it gives every new cell its
    own reach.
    """
    lat0, lat1, lon0, lon1 = domain
    touches = (
        f"qx * side - {half}D <= {lat1}D AND (qx + 1) * side - {half}D >= {lat0}D AND "
        f"qy * side - {half}D <= {lon1}D AND (qy + 1) * side - {half}D >= {lon0}D"
    )
    cut = (
        active.selectExpr("*", f"IF(split, {STRIDE}, 0) AS cut")
        .selectExpr("*", "explode(sequence(0L, shiftleft(1L, cut) - 1)) AS dx")
        .selectExpr("*", "explode(sequence(0L, shiftleft(1L, cut) - 1)) AS dy")
        .selectExpr(
            "qlevel + cut AS qlevel", "shiftleft(qx, cut) + dx AS qx", "shiftleft(qy, cut) + dy AS qy",
            *GROUP, "reach", f"{2 * half}D / pow(2D, qlevel + cut) AS side",
        )
        .where(touches).drop("side")
    )
    parts = _groups(places, level, half).selectExpr(
        "*", f"shiftright(nx, {STRIDE}) AS px", f"shiftright(ny, {STRIDE}) AS py"
    )
    kept = _prune(cut, k, half).selectExpr("qlevel", "qx", "qy", "reach", "nx AS px", "ny AS py")
    return kept.join(parts, ["px", "py"]).drop("px", "py")


def _decide(pairs: DataFrame, k: int, half: float) -> DataFrame:
    """Prune, then mark each cell: a leaf, or one to refine with or without cutting the cell.

    A cell that is far from the points keeps its size while the groups get finer. It is cut once
    the groups are single positions and there are still too many.
    """
    gap = "greatest(lat_lo - a1, a0 - lat_hi, lon_lo - b1, b0 - lon_hi, 0D)"
    return _prune(pairs, k, half).selectExpr(
        "qlevel", "qx", "qy", *GROUP, "reach",
        f"sum(places) OVER ({Q}) <= {max(LIST_SIZE, PLACES_PER_HIT * k)} OR sum(n) OVER ({Q}) <= {LISTS_PER_HIT * k} AS leaf",
        f"min({gap}) OVER ({Q}) <= 2 * min(side) OVER ({Q}) "
        f"OR min(lat_lo = lat_hi AND lon_lo = lon_hi) OVER ({Q}) AS split",
    )


def _listed(found: list[tuple[int, DataFrame]], places: DataFrame, k: int, half: float) -> DataFrame:
    """Places of each cell, pruned once more as single positions."""
    located = [
        cells.select("qlevel", "qx", "qy", "nx", "ny", "reach").join(
            places.selectExpr("*", f"{cell_sql('lat', lv, half)} AS nx", f"{cell_sql('lon_at', lv, half)} AS ny"),
            ["nx", "ny"],
        )
        for lv, cells in found
    ]
    as_groups = reduce(lambda a, b: a.unionByName(b), located).selectExpr(
        "*", "lat AS lat_lo", "lat AS lat_hi", "lon_at AS lon_lo", "lon_at AS lon_hi",
        "lat AS rep_lat", "lon_at AS rep_lon", "at[0].grid_id AS rep_id", "size(at) AS rep_n", "size(at) AS n",
    )
    return _prune(as_groups, k, half).select("qlevel", "qx", "qy", "lat", "lon", "lon_at", "at")


def build_index(
    grid: DataFrame, k: int = 1, domain: tuple[float, float, float, float] | None = None, wrap: bool = False
) -> NearestIndex:
    """Lookup table for a model table (grid_id, lat, lon, value) over a domain of positions.

    The default domain is the world, widened to hold the model.
    """
    if wrap and k > 1:
        raise ValueError("longitude wrap is offered for the single nearest point only")
    seen = Observation()
    edges = [f"{f}({c}) AS {f}_{c}" for c in ("lat", "lon", "lon_at") for f in ("min", "max")] + ["count(*) AS total"]
    points = materialise(model_points(grid, k, wrap).observe(seen, *[F.expr(e) for e in edges]), "points")
    box = dict(seen.get)
    total = box.pop("total") or 0
    if domain is None:
        domain = (
            min(WORLD[0], box["min_lat"] or 0.0), max(WORLD[1], box["max_lat"] or 0.0),
            min(WORLD[2], box["min_lon"] or 0.0), max(WORLD[3], box["max_lon"] or 0.0),
        )
    half = plane_half(*domain, *[v for v in box.values() if v is not None])
    if even := build_cells(points, total, k, domain):
        return NearestIndex(even[0], None, [], k, domain, grid, half, wrap, even[1])
    level, places = FIRST_LEVEL, materialise(_places(points), "places")
    pairs = _groups(places, level, half).selectExpr("*", f"inline({_first_cells(domain, half)}) AS (qx, qy)").selectExpr(
        f"{level} AS qlevel", "*", "DOUBLE('Infinity') AS reach"
    )
    found, crowded = [], None
    while True:
        seen = Observation()
        decided = materialise(
            _decide(pairs, k, half).observe(seen, F.expr("count_if(leaf) AS leaf"), F.expr("count_if(NOT leaf) AS open")),
            f"level{level}",
        )
        if seen.get["leaf"]:
            found.append((level, decided.where("leaf")))
        if not seen.get["open"]:
            break
        if level + STRIDE > LAST_LEVEL:
            crowded = materialise(
                _listed([(level, decided.where("NOT leaf"))], places, k, half).selectExpr("*", "inline(at)").selectExpr(
                    f"{leaf_sql('qlevel', 'qx', 'qy')} AS leaf_id", "qlevel",
                    "struct(grid_id, lat, lon, lon_at, value) AS candidate",
                ),
                "crowded",
            )
            break
        level += STRIDE
        pairs = _refine(decided.where("NOT leaf"), places, level, k, domain, half)

    seen = Observation()
    rows = _listed(found or [(level, decided.limit(0))], places, k, half)
    leaves = materialise(
        rows.groupBy("qlevel", "qx", "qy")
        .agg(F.expr("collect_list(struct(lat, lon, lon_at, at)) AS candidates"))
        .selectExpr(f"{leaf_sql('qlevel', 'qx', 'qy')} AS leaf_id", "candidates", "qlevel")
        .observe(seen, F.expr("collect_set(qlevel) AS levels")),
        "leaves",
    )
    levels = set(seen.get["levels"] or [])
    if crowded is not None:
        levels |= {r[0] for r in crowded.select("qlevel").distinct().collect()}  # one row per level
    return NearestIndex(leaves.drop("qlevel"), crowded, sorted(levels), k, domain, grid, half, wrap)


def _hit(c: str, lat: str, lon: str) -> str:
    """Sort key first: distance, then the lowest id."""
    return (
        f"named_struct('d2', ({lat} - {c}.lat) * ({lat} - {c}.lat) + ({lon} - {c}.lon_at) * ({lon} - {c}.lon_at), "
        f"'grid_id', {c}.grid_id, 'value', {c}.value, 'lat_grid', {c}.lat, 'lon_grid', {c}.lon)"
    )


def _once(sql: str) -> str:
    """An expression that the optimizer neither repeats in filters above it nor moves into a lambda."""
    return f"IF(spark_partition_id() < 0, NULL, {sql})"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with a name for a value that is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _best(k: int) -> str:
    hits = f"transform(candidates, c -> {_hit('c', '_lat', '_lon')})"
    return f"array(array_min({hits}))" if k == 1 else _once(f"slice(sort_array({hits}), 1, {k})")


def _best_places(k: int) -> str:
    """Hits from a list of places: those no farther than where the nearest places hold ``k`` points give all of their points."""
    d2 = "(_lat - c.lat) * (_lat - c.lat) + (_lon - c.lon_at) * (_lon - c.lon_at)"
    if k == 1:
        hit = f"named_struct('d2', {d2}, 'grid_id', c.at[0].grid_id, 'value', c.at[0].value, 'lat_grid', c.lat, 'lon_grid', c.lon)"
        return f"array(array_min(transform(candidates, c -> {hit})))"
    near = f"sort_array(transform(candidates, c -> named_struct('d2', {d2}, 'n', size(c.at), 'place', c)))"
    reach = f"aggregate(near, named_struct('n', 0, 'd2', 0D), (s, p) -> IF(s.n >= {k}, s, named_struct('n', s.n + p.n, 'd2', p.d2))).d2"
    points = "transform(p.place.at, a -> named_struct('d2', p.d2, 'grid_id', a.grid_id, 'value', a.value, 'lat_grid', p.place.lat, 'lon_grid', p.place.lon))"
    hits = f"slice(sort_array(flatten(transform(filter(near, p -> p.d2 <= reach), p -> {points}))), 1, {k})"
    return _once(_let("near", near, _let("reach", reach, hits)))


def _usable(lat: Column, lon: Column) -> Column:
    return F.coalesce(finite(lat) & finite(lon), F.lit(False))


def _in_domain(lat: Column, lon: Column, domain) -> Column:
    return lat.between(domain[0], domain[1]) & lon.between(domain[2], domain[3])


def position(index: NearestIndex, lat: str, lon: str) -> tuple[Column, Column]:
    """Where a probe is looked up: an index that wraps sees every longitude within one turn."""
    lon_at = F.col(lon).cast("double")
    if index.wrap:
        inside = lon_at.between(-180.0, 180.0)
        lon_at = F.when(inside, lon_at).otherwise(F.pmod(lon_at + 180.0, F.lit(360.0)) - 180.0)
    return F.col(lat).cast("double"), lon_at


def nearest_hits(probes: DataFrame, index: NearestIndex, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Every probe with ``hits``, its ``k`` nearest model points ordered by (distance, id).

    A probe without a usable position, or outside the index domain, keeps null hits.
    """
    names = probes.columns
    at = position(index, lat, lon)
    placed = probes.withColumns({"_lat": at[0], "_lon": at[1]})
    inside = _usable(F.col("_lat"), F.col("_lon")) & _in_domain(F.col("_lat"), F.col("_lon"), index.domain)
    if index.net:
        located = placed.withColumn("_in", inside).selectExpr("*", f"IF(_in, {index.net.cell_sql('_lat', '_lon')}, NULL) AS _cell")
        found = located.join(index.leaves.withColumnRenamed("cell", "_cell"), "_cell", "left")
        return found.selectExpr(*[f"`{n}`" for n in names], f"{_best(index.k)} AS hits")
    keys = [leaf_sql(lv, cell_sql("_lat", lv, index.half), cell_sql("_lon", lv, index.half)) for lv in index.levels]
    placed = placed.withColumn("_in", inside)
    leaves = index.leaves.withColumnRenamed("leaf_id", "_leaf")
    if len(keys) == 1:
        located = placed.selectExpr("*", f"IF(_in, {keys[0]}, NULL) AS _leaf")
    else:
        # cells nest, so exactly one of the level keys of a probe is a leaf
        ids = leaves.select("_leaf")
        if index.crowded is not None:
            ids = ids.unionByName(index.crowded.selectExpr("leaf_id AS _leaf").distinct())
        tagged = placed.selectExpr(
            "*", f"explode(IF(_in, array({', '.join(keys)}), array(CAST(NULL AS BIGINT)))) AS _leaf"
        )
        located = tagged.join(ids.withColumn("_known", F.lit(True)), "_leaf", "left").where("_known OR _leaf IS NULL")
    if index.crowded is not None:
        return _with_crowded(located, leaves, index, names)
    return located.join(leaves, "_leaf", "left").selectExpr(*[f"`{n}`" for n in names], f"{_best_places(index.k)} AS hits")


def _with_crowded(located: DataFrame, leaves: DataFrame, index: NearestIndex, names: list[str]) -> DataFrame:
    """Leaves too crowded for an array: their points stay rows, ranked per probe.

    The rank filter drops all but ``k`` rows of a probe before the shuffle.
    """
    kept = [f"`{n}`" for n in names]
    rows = index.crowded.selectExpr("leaf_id AS _leaf", "candidate AS _c")
    ids = rows.select("_leaf").distinct()
    plain = located.join(ids, "_leaf", "left_anti").join(leaves, "_leaf", "left").selectExpr(
        *kept, f"{_best_places(index.k)} AS hits"
    )
    heavy = materialise(
        located.join(ids, "_leaf", "left_semi").withColumn("_probe", F.expr("uuid()")), "crowded"
    )
    pairs = heavy.join(rows, "_leaf").selectExpr("_probe", f"{_hit('_c', '_lat', '_lon')} AS hit")
    top = pairs.selectExpr("*", "row_number() OVER (PARTITION BY _probe ORDER BY hit) AS place").where(
        f"place <= {index.k}"
    )
    hits = top.groupBy("_probe").agg(F.expr("array_sort(collect_list(hit)) AS hits"))
    return plain.unionByName(heavy.join(hits, "_probe").selectExpr(*kept, "hits"))


def lookup(probes: DataFrame, index: NearestIndex, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``nearest_hits`` for any finite position, also outside the domain of the index."""
    at = position(index, lat, lon)
    away = _usable(*at) & ~_in_domain(*at, index.domain)
    edge = probes.where(away).agg(
        F.min(at[0]).alias("a"), F.max(at[0]).alias("b"), F.min(at[1]).alias("c"), F.max(at[1]).alias("d")
    ).first()
    if edge["a"] is None:
        return nearest_hits(probes, index, lat, lon)
    wider = build_index(index.points, index.k, (edge["a"], edge["b"], edge["c"], edge["d"]), index.wrap)
    near = nearest_hits(probes.where(~away), index, lat, lon)
    return near.unionByName(nearest_hits(probes.where(away), wider, lat, lon))


def nearest_point(probes: DataFrame, index: NearestIndex, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Value and position of the nearest model point."""
    rest = [f"`{c}`" for c in probes.columns]
    return lookup(probes, index, lat, lon).selectExpr(
        *rest, "hits[0].grid_id AS grid_id", "hits[0].value AS predicted_value",
        "hits[0].lat_grid AS lat_grid", "hits[0].lon_grid AS lon_grid",
    )


# Exact matches, if any, count alone; else every hit weighs 1/distance.
DISTANCE_WEIGHTED = """
CASE WHEN hits[0].d2 = 0D THEN
    aggregate(filter(hits, h -> h.d2 = 0D), 0D, (a, h) -> a + h.value) / size(filter(hits, h -> h.d2 = 0D))
ELSE
    aggregate(hits, 0D, (a, h) -> a + h.value / sqrt(h.d2)) / aggregate(hits, 0D, (a, h) -> a + 1D / sqrt(h.d2))
END"""


def knn_regression(probes: DataFrame, index: NearestIndex, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """k-nearest regression with inverse-distance weights."""
    rest = [f"`{c}`" for c in probes.columns]
    return lookup(probes, index, lat, lon).selectExpr(*rest, f"{DISTANCE_WEIGHTED} AS predicted_value")
