"""Bilinear interpolation between cells, patches of cells as rectangles, and resampling."""

from __future__ import annotations

from spheric.functions import geometry as g
from spheric.operators.grid import box, neighbours
from spheric.operators.multires import nest_cells
from spheric.plans.sql import SPARK, each


def holders(points: str, nside: int, ellipsoid: str = "sphere") -> str:
    """pt, lon, lat (radians) and centre, the NESTED cell that holds a point (pt, lon, lat) in degrees."""
    z = f"sin({g.authalic('radians(lat)')})" if ellipsoid == "WGS84" else "sin(radians(lat))"
    return f"(select pt, lon, lat, nest_cell as centre from {g.located(f'(select pt, radians(lon) as lon, radians(lat) as lat, {z} as z from {points} _p)', 'pt, lon, lat', 'z', 'lon', nside)} _l)"


def weights(points: str, nside: int, ellipsoid: str = "sphere", *, touching: str = "", centres: str = "") -> str:
    """Rows (pt, cell_id, w) for points (pt, lon, lat) in degrees: of the NESTED cell that holds a point and its neighbours, the four nearest in the tangent plane, of equal ones those of smaller ids.

    Each direction's share goes by how far the four reach to either side; where they reach nowhere it is a half. On WGS84
    latitudes are geodetic. touching names a table of neighbours (cell_id, other) instead of that of the whole sphere, such as neighbours_of makes for the cells that holders gives, and centres one (cell_id, z, phi) of their centres.
    """
    if ellipsoid not in ("sphere", "WGS84"):
        raise ValueError("ellipsoid must be 'sphere' or 'WGS84'")
    held = holders(points, nside, ellipsoid)
    own = f"select pt, lon, lat, centre as cell_id from {held} _h union all select h.pt, h.lon, h.lat, n.other as cell_id from {held} h join {touching or neighbours(nside)} n on h.centre = n.cell_id"
    x, y = g.gnomonic("c.phi", g.geodetic("asin(c.z)") if ellipsoid == "WGS84" else "asin(c.z)", "o.lon", "o.lat")
    plane = f"select o.pt, o.cell_id, {x} as x, {y} as y from ({own}) o join {centres or nest_cells(nside)} c on o.cell_id = c.cell_id"
    # distances that differ by rounding alone are ties
    ranked = f"select *, row_number() over (partition by pt order by round(x * x + y * y, 12), cell_id) as k from ({plane}) _q"
    reach = "greatest(-min(x) over p, 0.0e0) as lo_x, greatest(max(x) over p, 0.0e0) as hi_x, greatest(-min(y) over p, 0.0e0) as lo_y, greatest(max(y) over p, 0.0e0) as hi_y"
    four = f"select pt, cell_id, x, y, {reach} from ({ranked}) _r where k <= 4 window p as (partition by pt)"
    u, v = "(case when lo_x + hi_x > 1e-15 then lo_x / (lo_x + hi_x) else 0.5e0 end)", "(case when lo_y + hi_y > 1e-15 then lo_y / (lo_y + hi_y) else 0.5e0 end)"
    raw = f"select pt, cell_id, (case when x >= 0 then {u} else 1 - {u} end) * (case when y >= 0 then {v} else 1 - {v} end) as w from ({four}) _f"
    return f"(select pt, cell_id, case when sum(w) over p > 1e-15 then w / sum(w) over p else 0.25e0 end as w from ({raw}) _w window p as (partition by pt))"


def values(points: str, sky: str, nside: int, ellipsoid: str = "sphere", **options) -> str:
    """map_id, pt, value."""
    return f"(select s.map_id, w.pt, sum(w.w * s.value) as value from {weights(points, nside, ellipsoid, **options)} w join {sky} s on w.cell_id = s.cell_id group by s.map_id, w.pt)"


def rectangle(nside: int, west: float, south: float, east: float, north: float, dialect: str = SPARK, ellipsoid: str = "sphere", compat_padding: bool = False) -> str:
    """Rows (row, col, cell_id, is_pad): the RING cells of a box by ring from the south, each row padded to the longest with the ring's next cells, half to either side, around the circle. compat_padding puts the western half in falling order and lets ids run on beyond the ring."""
    rows = f"select ring_id, min(cell_id) as first, max(cell_id) as last, count(*) as n, dense_rank() over (order by ring_id desc) - 1 as row from {box(nside, west, south, east, north, dialect, ellipsoid)} _b group by ring_id"
    wide = f"select *, max(n) over () as width, max(n) over () - n as pad from ({rows}) _r"
    start, size = g.ring_start("ring_id", nside), g.ring_size("ring_id", nside)
    cols = f"select w.row, w.ring_id, w.first, w.n, w.pad, c.col from ({wide}) w join (select col from range(0, {4 * nside}) as _c(col)) c on c.col < w.width"
    at = f"first - {g.div('pad', 2)} + col"
    if compat_padding:
        before = g.div("pad", 2)
        return f"(select row, col, case when col < {before} then first - 1 - col else first + col - {before} end as cell_id, col < {before} or col >= {before} + n as is_pad from ({cols}) _k)"
    return f"(select row, col, {start} + {g.mod(f'{at} - {start}', size)} as cell_id, col < {g.div('pad', 2)} or col >= {g.div('pad', 2)} + n as is_pad from ({cols}) _k)"


def on_rectangle(rect: str, sky: str, nside: int) -> str:
    """row, col, cell_id, value: a NESTED map on a rectangle, in its rows' order; cells without a value are absent."""
    ringed = g.with_ring_cell(sky, "map_id, value", nside)
    return f"(select s.map_id, r.row, r.col, r.cell_id, s.value from {rect} r join {ringed} s on r.cell_id = s.ring_cell)"


def resample_nearest(samples: str, n_rows: int, n_cols: int, dialect: str = SPARK) -> str:
    """row, col, value: a grid between the samples' extremes, each node the nearest sample (id, lat, lon, value), of equal ones the one of smaller id. Samples with a null place are left out.

    Squares of 2^k grid steps are counted for each k. Where the nine around a node hold a sample at k, its nearest is within those nine at k + 2, and it is held against these alone. The twin holds every node against every sample.
    """
    placed = f"(select * from {samples} _s where lat is not null and lon is not null)"
    bounds = f"select min(lat) as a0, max(lat) as a1, min(lon) as o0, max(lon) as o1 from {placed} _b"
    node = f"select r.i as row, c.i as col, a0, o0, a1, o1, a0 + (a1 - a0) * r.i / {max(1, n_rows - 1)} as lat, o0 + (o1 - o0) * c.i / {max(1, n_cols - 1)} as lon from ({bounds}) b cross join range(0, {n_rows}) as r(i) cross join range(0, {n_cols}) as c(i) where a0 is not null"
    apart = "round((n.lat - s.lat) * (n.lat - s.lat) + (n.lon - s.lon) * (n.lon - s.lon), 9)"
    if dialect != SPARK:
        ranked = f"select n.row, n.col, s.value, row_number() over (partition by n.row, n.col order by {apart}, s.id) as k from ({node}) n cross join {placed} s"
        return f"(select row, col, value from ({ranked}) _k where k = 1)"
    # the last k has squares as wide as the whole, so that nine of them hold everything
    top = max(n_rows, n_cols).bit_length()
    step = f"greatest((a1 - a0) / {max(1, n_rows - 1)}, (o1 - o0) / {max(1, n_cols - 1)}, 1e-12)"
    square = lambda x, low: f"cast(floor(({x} - {low}) / ({step} * power(2.0e0, k))) as bigint)"
    square_of = f"{square('lat', 'a0')} as y, {square('lon', 'o0')} as x"
    levels, around = each(0, top, "k"), f"{each(-1, 1, 'dy')} {each(-1, 1, 'dx')}"
    held = f"select k, {square_of} from (select s.lat, s.lon, b.* from {placed} s cross join ({bounds}) b) _h {levels} group by 1, 2, 3"
    near = f"select row, col, k, y + dy as y, x + dx as x from (select row, col, k, {square_of} from ({node}) _n {levels}) _l {around}"
    chosen = f"select row, col, least(min(n.k) + 2, {top}) as k from ({near}) n join ({held}) h on n.k = h.k and n.y = h.y and n.x = h.x group by row, col"
    asked = f"select row, col, k, lat, lon, y + dy as y, x + dx as x from (select n.row, n.col, c.k, lat, lon, {square_of} from ({node}) n join ({chosen}) c on n.row = c.row and n.col = c.col) _c {around}"
    told = f"select k, id, value, lat, lon, {square_of} from (select s.id, s.value, s.lat, s.lon, b.* from {placed} s cross join ({bounds}) b) _t {levels}"
    best = f"select n.row, n.col, min(struct({apart} as d, s.id as id, s.value as value)) as b from ({asked}) n join ({told}) s on n.k = s.k and n.y = s.y and n.x = s.x group by n.row, n.col"
    return f"(select row, col, b.value as value from ({best}) _v)"
