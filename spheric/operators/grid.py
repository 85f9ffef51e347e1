"""Cells, rings, discs, boxes and neighbours of the grid, as queries over spark.range or over points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spheric.functions import geometry as g
from spheric.plans.sql import SPARK, each, numbers
from spheric.sources.geometry_store import kept


#: Cells that touch have centres no further apart than so many times the side of a square of a cell's size.
TOUCH = 2.2


def rings(nside: int) -> str:
    """ring_id, n_r, start, z, theta, phi0 of the 4 nside - 1 rings."""
    r = "ring_id"
    return f"(select {r}, {g.ring_size(r, nside)} as n_r, {g.ring_start(r, nside)} as start, {g.ring_z(r, nside)} as z, acos({g.ring_z(r, nside)}) as theta, {g.ring_phi0(r, nside)} as phi0 from {numbers(1, 4 * nside - 1, r)} _n)"


def cells(nside: int, ids: str = "", column: str = "cell_id") -> str:
    """cell_id, ring_id, z, phi of RING cells: all, or those of a table."""
    source = ids or numbers(0, 12 * nside * nside - 1, column)
    r = "ring_id"
    return (
        f"(select cell_id, ring_id, {g.ring_z(r, nside)} as z, {g.ring_phi0(r, nside)} + 2 * {g.PI} * (cell_id - {g.ring_start(r, nside)}) / {g.ring_size(r, nside)} as phi"
        f" from (select {column} as cell_id, {g.ring_of(column, nside)} as ring_id from {source} _s) _c)"
    )


def last_ring(z: str, nside: int) -> str:
    """The last ring whose cells lie at z or further north; 0 if there is none."""
    n = nside
    return (
        f"cast(floor(case when {z} > 2 / 3.0e0 then {n} * sqrt(3 * greatest(0.0e0, 1 - {z})) when {z} >= -2 / 3.0e0 then {n} * (2 - 1.5e0 * {z})"
        f" else {4 * n} - {n} * sqrt(3 * greatest(0.0e0, 1 + {z})) end) as bigint)"
    )


def disc(centres: str, nside: int, radius: str, dialect: str = SPARK) -> str:
    """Rows (id, cell_id, angle) of the RING cells within radius of each centre (id, theta, phi), radians: only rings between two latitudes, and of each only the cells between two longitudes, are made."""
    top, bottom = f"cos(greatest(theta - {radius}, 0.0e0))", f"cos(least(theta + {radius}, {g.PI}))"
    edges = f"select id, theta, phi, cos(theta) as z0, {last_ring(top, nside)} as above, {last_ring(bottom, nside)} as below from {centres} _t"
    met = f"select id, theta, phi, z0, ring_id from ({edges}) _e {each('greatest(1, above - 1)', f'least({4 * nside - 1}, below + 1)', 'ring_id', dialect)}"
    ringed = g.staged(f"({met})", {"z": g.ring_z("ring_id", nside), "n_r": g.ring_size("ring_id", nside), "phi0": g.ring_phi0("ring_id", nside), "start": g.ring_start("ring_id", nside)})
    reach = f"(case when (1 - z * z) * (1 - z0 * z0) < 1e-24 then -2.0e0 else (cos({radius}) - z * z0) / sqrt((1 - z * z) * (1 - z0 * z0)) end)"
    width = f"(2 * {g.PI} / n_r)"
    bounds = (
        f"select *, case when c <= -1 then 0 else cast(ceil((phi - acos(least(1.0e0, c)) - phi0) / {width} - 1e-9) as bigint) end as lo,"
        f" case when c <= -1 then n_r - 1 else cast(floor((phi + acos(least(1.0e0, c)) - phi0) / {width} + 1e-9) as bigint) end as hi from (select *, {reach} as c from {ringed} _m) _r where c <= 1 + 1e-12"
    )
    made = f"select id, theta, phi, z, phi0 + j * {width} as cell_phi, start + {g.mod('j', 'n_r')} as cell_id from ({bounds}) _b {each('lo', 'least(hi, lo + n_r - 1)', 'j', dialect)}"
    angle = g.haversine("phi", f"({g.PI} / 2 - theta)", "cell_phi", "asin(z)")
    return f"(select id, cell_id, angle from (select id, cell_id, {angle} as angle from ({made}) _m) _a where angle <= {radius} + 1e-12)"


def box(nside: int, west: float, south: float, east: float, north: float, dialect: str = SPARK, ellipsoid: str = "sphere") -> str:
    """RING cells whose centre lies in a box of degrees; east below west wraps. Only rings and cells about the box are made. On WGS84 latitudes are geodetic."""

    def last(lat: float) -> int:
        z = math.sin(math.radians(max(-90.0, min(90.0, lat))))
        return math.floor(nside * math.sqrt(3 * (1 - z)) if z > 2 / 3 else nside * (2 - 1.5 * z) if z >= -2 / 3 else 4 * nside - nside * math.sqrt(3 * (1 + z)))

    slack = 0.2 if ellipsoid == "WGS84" else 0.0  # authalic and geodetic latitudes differ by 0.13 degrees at most
    rings_ = numbers(max(1, last(north + slack) - 1), min(4 * nside - 1, last(south - slack) + 1), "ring_id")
    lon = f"degrees({g.fmod('phi', f'(2 * {g.PI})')})"
    lat = f"degrees({g.geodetic('asin(z)')})" if ellipsoid == "WGS84" else "degrees(asin(z))"
    inside = f"{lon} between {west} and {east}" if west <= east else f"({lon} >= {west} or {lon} <= {east})"
    low, high = (max(west, 0.0), min(east, 360.0)) if west <= east else (west, east + 360.0)
    made = g.staged(rings_, {"z": g.ring_z("ring_id", nside), "n_r": g.ring_size("ring_id", nside), "phi0": g.ring_phi0("ring_id", nside), "start": g.ring_start("ring_id", nside)})
    step = f"(2 * {g.PI} / n_r)"
    bounds = f"(select *, cast(floor(({math.radians(low)!r}e0 - phi0) / {step} - 1e-9) as bigint) as lo, cast(ceil(({math.radians(high)!r}e0 - phi0) / {step} + 1e-9) as bigint) as hi from {made} _m)".replace("e-", "e-")
    cells_ = f"(select ring_id, z, phi0 + {g.mod('j', 'n_r')} * {step} as phi, start + {g.mod('j', 'n_r')} as cell_id from {bounds} _b {each('lo', 'least(hi, lo + n_r - 1)', 'j', dialect)})"
    return f"(select cell_id, ring_id, {lon} as lon, {lat} as lat from {cells_} _c where {lat} between {south} and {north} and {inside})"


def corners(nside: int, ids: str = "") -> str:
    """Rows (cell_id, jr, jp) of NESTED cells' four corners, of all or of those of a table; equal points have equal whole-number keys."""
    n, level = g.check_nside(nside), nside.bit_length() - 1
    source = g.staged(
        ids or numbers(0, 12 * n * n - 1, "cell_id"), {"f": g.div("cell_id", n * n), "low": g.mod("cell_id", n * n)}, {"x": g.even_bits("low", level), "y": g.even_bits("low >> 1", level)},
        {"far": f"{g.face_ring('f')} * {n} - x - y", "phi": g.face_phi("f")},
    )
    parts = []
    for dx in (0, 1):
        for dy in (0, 1):
            keyed = g.staged(source, {"jr": f"far - {dx + dy}"}, {"nr": f"least({n}, jr, {4 * n} - jr)"})
            parts.append(f"select cell_id, jr, case when nr = 0 then 0 else {g.mod(f'phi * nr + x - y + {dx - dy}', 'greatest(1, 8 * nr)')} end as jp from {keyed} _k")
    return "(" + " union all ".join(parts) + ")"


def neighbours(nside: int) -> str:
    """Rows (cell_id, other) of NESTED cells that share a corner: eight for most, seven for 24 of them."""
    return f"(select distinct a.cell_id, b.cell_id as other from {corners(nside)} a join {corners(nside)} b on a.jr = b.jr and a.jp = b.jp where a.cell_id <> b.cell_id)"


def at_centres(source: str, columns: str, column: str, nside: int) -> str:
    """columns of source, and z and phi of the RING cell in a column of it."""
    made = g.staged(source, {"_ring": g.ring_of(column, nside)}, {"z": g.ring_z("_ring", nside), "phi": f"{g.ring_phi0('_ring', nside)} + 2 * {g.PI} * ({column} - {g.ring_start('_ring', nside)}) / {g.ring_size('_ring', nside)}"})
    return f"(select {columns}, z, phi from {made} _p)"


def placed(ids: DataFrame, nside: int) -> DataFrame:
    """cell_id, ring_cell, z, phi of the distinct NESTED cells (cell_id) of a table, kept: plans that go on from here start anew."""
    spark, own = ids.sparkSession, kept(ids.select("cell_id").distinct(), "cells")
    ringed = kept(spark.sql(f"select * from {g.with_ring_cell('{own}', 'cell_id', nside)} _r", own=own), "ring-cells")
    return kept(spark.sql(f"select * from {at_centres('{t}', 'cell_id, ring_cell', 'ring_cell', nside)} _p", t=ringed), "centres")


def neighbours_of(ids: DataFrame, nside: int) -> DataFrame:
    """As neighbours, of the NESTED cells (cell_id) of a table alone: what is made grows with these, not with the sphere. Candidates lie within a disc that holds all that touch a cell."""
    spark, n = ids.sparkSession, g.check_nside(nside)
    own = placed(ids, n)
    near = kept(spark.sql(f"select id, cell_id as ring_cell from {disc('{c}', n, repr(TOUCH * math.sqrt(4 * math.pi / (12 * n * n))))} _d", c=own.selectExpr("cell_id as id", "acos(z) as theta", "phi")), "near")
    met = kept(spark.sql(f"select * from {at_centres('{m}', 'ring_cell', 'ring_cell', n)} _p", m=near.select("ring_cell").distinct()), "met")
    nested = kept(spark.sql(f"select c as ring_cell, nest_cell as cell_id from {g.located('{m}', 'c', 'z', 'phi', n)} _l", m=met.withColumnRenamed("ring_cell", "c")), "nested")
    ours, theirs = (spark.sql(f"select * from {corners(n, '{t}')} _k", t=t.select("cell_id")) for t in (own, nested))
    pairs = near.join(nested, "ring_cell").select(F.col("id").alias("cell_id"), F.col("cell_id").alias("other")).where("cell_id <> other")
    touching = pairs.join(ours, "cell_id").join(theirs.withColumnRenamed("cell_id", "other"), ["other", "jr", "jp"])
    return kept(touching.select("cell_id", "other").distinct(), "touching")
