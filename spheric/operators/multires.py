"""Down- and up-sampling as sparse operators: a stencil (out_id, in_id, w) joined with a map, and its transpose.

Cells are NESTED, the parent of p is p div 4. On the sphere distances are those of the grid's own latitudes; on WGS84 of
the geodetic ones, while candidates come from a slightly wider disc of the grid's.
"""

from __future__ import annotations

import math

from spheric.functions import geometry as g
from spheric.operators.grid import cells, disc
from spheric.plans.sql import SPARK, numbers

NORMS, UP_NORMS = ("l1", "l2", "none"), ("adjoint", "col_l1", "diag_l2")


def nest_cells(nside: int, ids: str = "") -> str:
    """cell_id (NESTED), ring_cell, z, phi."""
    source = ids or numbers(0, 12 * nside * nside - 1, "cell_id")
    return f"(select n.cell_id, n.ring_cell, c.z, c.phi from {g.with_ring_cell(source, 'cell_id', nside)} n join {cells(nside)} c on n.ring_cell = c.cell_id)"


def scale(nside_in: int, radius: float | None = None, sigma: float | None = None) -> tuple[float, float]:
    """Radius and sigma in radians: three pixels and half of that unless given."""
    radius = radius or 3 * math.sqrt(4 * math.pi / (12 * nside_in * nside_in))
    return radius, sigma or radius / 2


def smooth_stencil(nside_in: int, *, norm: str = "l1", ids: str = "", radius: float | None = None, sigma: float | None = None, ellipsoid: str = "WGS84", dialect: str = SPARK) -> str:
    """Gaussian weights of the fine cells within radius of each coarse centre, and of the four children where none is.

    A coarse cell whose fine cells all lie beyond the radius gets equal weights on those there are.
    """
    if norm not in NORMS:
        raise ValueError(f"norm must be one of {NORMS}")
    if nside_in < 2:
        raise ValueError("nside_in must be 2 or more")
    if ellipsoid not in ("sphere", "WGS84"):
        raise ValueError("ellipsoid must be 'sphere' or 'WGS84'")
    r, s = scale(nside_in, radius, sigma)
    fine = nest_cells(nside_in, ids)
    out = f"(select distinct {g.div('cell_id', 4)} as cell_id from {ids} _i)" if ids else ""
    coarse = nest_cells(nside_in // 2, out)
    lat = (lambda z: g.geodetic(f"asin({z})")) if ellipsoid == "WGS84" else (lambda z: f"asin({z})")
    centres = f"(select cell_id as id, acos(z) as theta, phi from {coarse} _c)"
    wide = r * 1.02 if ellipsoid == "WGS84" else r
    near = f"select d.id as out_id, f.cell_id as in_id from {disc(centres, nside_in, repr(wide), dialect)} d join {fine} f on d.cell_id = f.ring_cell"
    children = f"select {g.div('cell_id', 4)} as out_id, cell_id as in_id from {fine} _f"
    both = f"select distinct out_id, in_id from ({near} union all {children}) _b"
    geo = lambda cells_: f"(select cell_id, phi, {lat('z')} as lat from {cells_} _g)"
    angle = g.haversine("c.phi", "c.lat", "f.phi", "f.lat")
    placed = f"select b.out_id, b.in_id, {angle} as angle, case when {g.div('b.in_id', 4)} = b.out_id then 1 else 0 end as child from ({both}) b join {geo(coarse)} c on b.out_id = c.cell_id join {geo(fine)} f on b.in_id = f.cell_id"
    flagged = f"select *, sum(case when angle <= {r!r} then 1 else 0 end) over (partition by out_id) as inside from ({placed}) _p"
    raw = f"select out_id, in_id, case when inside = 0 then 1.0e0 else exp(-angle * angle / {2 * s * s!r}) end as w from ({flagged}) _q where angle <= {r!r} or (inside = 0 and child = 1)"
    by = {"l1": "w / sum(w) over (partition by out_id)", "l2": "w / sqrt(sum(w * w) over (partition by out_id))", "none": "w"}[norm]
    return f"(select out_id, in_id, {by} as w from ({raw}) _w)"


def apply(stencil: str, sky: str) -> str:
    """map_id, cell_id, value: the operator times each map."""
    return f"(select s.map_id, m.out_id as cell_id, sum(m.w * s.value) as value from {stencil} m join {sky} s on m.in_id = s.cell_id group by s.map_id, m.out_id)"


def maxpool(sky: str, fallback: str = "available") -> str:
    """The largest of the children there are. fallback="first_cell" takes for each that is absent the value of the map's first cell."""
    if fallback not in ("available", "first_cell"):
        raise ValueError("fallback must be 'available' or 'first_cell'")
    if fallback == "first_cell":
        first = f"select map_id, value from (select map_id, value, row_number() over (partition by map_id order by cell_id) as k from {sky} _s) _k where k = 1"
        pooled = f"select map_id, {g.div('cell_id', 4)} as cell_id, max(value) as value, count(*) as n from {sky} _s group by map_id, {g.div('cell_id', 4)}"
        return f"(select p.map_id, p.cell_id, case when p.n < 4 then greatest(p.value, f.value) else p.value end as value from ({pooled}) p join ({first}) f on p.map_id = f.map_id)"
    return f"(select map_id, {g.div('cell_id', 4)} as cell_id, max(value) as value from {sky} _s group by map_id, {g.div('cell_id', 4)})"


def transposed(stencil: str, norm: str = "col_l1", eps: float = 1e-12) -> str:
    """The up-sampling stencil: the transpose, its rows divided by the column's sum, or sum of squares, of the down-sampling."""
    if norm not in UP_NORMS:
        raise ValueError(f"norm must be one of {UP_NORMS}")
    by = {"adjoint": "w", "col_l1": f"w / greatest(sum(w) over (partition by in_id), {eps!r})", "diag_l2": f"w / greatest(sum(w * w) over (partition by in_id), {eps!r})"}[norm]
    return f"(select in_id as out_id, out_id as in_id, {by} as w from {stencil} _m)"


