"""Gauge-aware convolution: around each cell a small grid of points, turned by the cell's place and gauge, read by interpolation.

A stencil has rows (g, out_id, p, in_id, w): applying it is a join with the map, a sum over in_id, a join with the kernel
(g, c, o, p, w) and a sum over c and p.
"""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spheric.functions import geometry as g
from spheric.operators.interpolate import weights
from spheric.operators.multires import nest_cells
from spheric.sources.geometry_store import cached

GAUGES = ("phi", "cosmo", "projected_ref", "two_ref")


def gauge_angle(gauge: str, refs: tuple[tuple[float, float, float], ...] = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0))) -> tuple[str, str]:
    """The base angle and the sense in which gauges turn, from columns z and phi. Reference directions are projected on the cell's tangent plane."""
    if gauge not in GAUGES:
        raise ValueError(f"gauge must be one of {GAUGES}")
    if gauge == "phi":
        return "0.0e0", "1"
    if gauge == "cosmo":
        return "(case when z < 0 then phi else -phi end)", "(case when z < 0 then -1 else 1 end)"

    def projected(r: tuple[float, float, float]) -> tuple[str, str]:
        x, y, z = (f"({v!r}e0)" for v in r)
        east = f"(-{x} * sin(phi) + {y} * cos(phi))"
        south = f"({x} * z * cos(phi) + {y} * z * sin(phi) - {z} * sqrt(1 - z * z))"
        return south, east

    s, e = projected(refs[0])
    if gauge == "projected_ref":
        return f"atan2({e}, {s})", "1"
    s2, e2 = projected(refs[1])
    return f"atan2({s} * {e2} + {e} * {s2}, {s} * {s2} - {e} * {e2})", "1"


def stencil_points(nside: int, kernel: int, n_gauges: int, gauge: str, ids: str = "") -> str:
    """Rows (pt, g, out_id, p, lon, lat): the kernel's points around each NESTED cell in degrees. pt is ((g * cells + id) * points + p)."""
    base, sign = gauge_angle(gauge)
    step, half, size = math.sqrt(4 * math.pi / (12 * nside * nside)), kernel // 2, kernel * kernel
    grid = ", ".join(f"({j * kernel + i}, {math.hypot(i - half, j - half) * step!r}e0, {math.atan2(j - half, i - half)!r}e0)" for j in range(kernel) for i in range(kernel))
    grid = grid.replace("-0.0e0", "0.0e0")
    a = f"(k.b + {base} + ({sign}) * q.g * {g.PI} / {n_gauges})"
    joined = (
        f"select q.g, c.cell_id as out_id, k.p, c.z, c.phi, sin(k.r) * cos{a} as vx, sin(k.r) * sin{a} as vy, cos(k.r) as vz"
        f" from {nest_cells(nside, ids)} c cross join (values {grid}) as k(p, r, b) cross join range(0, {n_gauges}) as q(g)"
    )
    tilted = "select g, out_id, p, phi, z * vx + sqrt(1 - z * z) * vz as tx, vy as ty, -sqrt(1 - z * z) * vx + z * vz as tz from (" + joined + ") _j"
    lon = f"{g.fmod('phi + atan2(ty, tx)', f'(2 * {g.PI})')}"
    return f"(select cast((g * {12 * nside * nside} + out_id) * {size} + p as bigint) as pt, g, out_id, p, degrees({lon}) as lon, degrees(asin(least(1.0e0, greatest(-1.0e0, tz)))) as lat from ({tilted}) _t)"


def stencil(nside: int, kernel: int = 3, n_gauges: int = 1, gauge: str = "phi", ids: str = "") -> str:
    n, size = 12 * nside * nside, kernel * kernel
    w = weights(stencil_points(nside, kernel, n_gauges, gauge, ids), nside)
    return f"(select {g.div('pt', n * size)} as g, {g.mod(g.div('pt', size), n)} as out_id, {g.mod('pt', size)} as p, cell_id as in_id, w from {w} _w)"


def bound(stencil_: str, present: str, kernel: int) -> str:
    """The stencil on the cells (cell_id) there are: absent ones drop out and the rest is scaled to 1; a point that has none left takes its centre point's."""
    centre = (kernel // 2) * (kernel + 1)
    own = f"select s.g, s.out_id, s.p, s.in_id, s.w from {stencil_} s join {present} c on s.in_id = c.cell_id"
    lost = f"select a.g, a.out_id, a.p from (select distinct g, out_id, p from {stencil_} _s) a left join (select distinct g, out_id, p from ({own}) _o) b on a.g = b.g and a.out_id = b.out_id and a.p = b.p where b.p is null"
    put = f"select l.g, l.out_id, l.p, o.in_id, o.w from ({lost}) l join ({own}) o on l.g = o.g and l.out_id = o.out_id and o.p = {centre}"
    total = "sum(w) over (partition by g, out_id, p)"
    slot = "row_number() over (partition by g, out_id, p order by in_id)"
    return f"(select g, out_id, p, in_id, case when {total} = 0 then (case when {slot} = 1 then 1.0e0 else 0.0e0 end) else w / {total} end as w from ({own} union all {put}) _b)"


def initial_kernel(n_gauges: int, n_in: int, n_out: int, points: int, seed: int = 0) -> str:
    """g, c, o, p, w: weights even within sqrt(6 / (n_out * points)) of 0, the same for a seed in every engine."""
    bound_ = math.sqrt(6 / (n_out * points))
    k = f"(((g * {n_in} + c) * {n_out} + o) * {points} + p + 1)"
    spread = lambda x: g.mod(f"{x} * 48271 + 11", 2147483647)
    return f"(select g, c, o, p, {bound_!r} * (2 * {spread(spread(spread(f'({k} + {seed} * 7919)')))} / 2147483647.0e0 - 1) as w from range(0, {n_gauges}) as _g(g) cross join range(0, {n_in}) as _c(c) cross join range(0, {n_out}) as _o(o) cross join range(0, {points}) as _p(p))"


def for_gauges(kernel: str, n_gauges: int) -> str:
    """A kernel (c, o, p, w) for every gauge."""
    return f"(select q.g, k.c, k.o, k.p, k.w from {kernel} k cross join range(0, {n_gauges}) as q(g))"


def check_kernel(kernel: DataFrame, n_gauges: int, n_in: int, n_out: int, points: int) -> DataFrame:
    """The kernel (g, c, o, p, w), or ValueError unless it has each weight of that shape once."""
    inside = F.col("g").between(0, n_gauges - 1) & F.col("c").between(0, n_in - 1) & F.col("o").between(0, n_out - 1) & F.col("p").between(0, points - 1) & F.col("w").isNotNull()
    row = kernel.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(inside, 1)).alias("own"), F.countDistinct("g", "c", "o", "p").alias("names")).first()
    if not row.n == row.own == row.names == n_gauges * n_in * n_out * points:
        raise ValueError(f"a kernel of shape ({n_gauges}, {n_in}, {n_out}, {points}) has each weight once; this has {row.n} rows, {row.own} of them within the shape")
    return kernel


def check_refs(gauge: str, refs: tuple[tuple[float, float, float], ...]) -> None:
    """ValueError unless the reference directions are as many as the gauge needs, of some length, and two not along one line."""
    need = {"projected_ref": 1, "two_ref": 2}.get(gauge, 0)
    if len(refs) < need or any(math.hypot(*r) < 1e-12 for r in refs[:need]):
        raise ValueError(f"{gauge} needs {need} reference directions of some length")


def direction(lon: float, lat: float) -> tuple[float, float, float]:
    """The reference direction of a place in degrees, where the gauge is singular."""
    a, b = math.radians(lon), math.radians(lat)
    return math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b)


def stored_stencil(spark, folder: str | None, nside: int, kernel: int = 3, n_gauges: int = 1, gauge: str = "phi", ids: DataFrame | None = None) -> DataFrame:
    """The stencil as a table kept in folder under its cache_key; None keeps nothing. ids (cell_id) are the cells it is made for."""
    key = "stencil-" + cache_key(nside, kernel, n_gauges, gauge, ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0)), ids)
    given = {} if ids is None else {"ids": ids}
    return cached(lambda: spark.sql(f"select * from {stencil(nside, kernel, n_gauges, gauge, '{ids}' if given else '')} _s", **given), spark, folder, key)


def forward(stencil_: str, sky: str, kernel: str, bias: str, n_out: int) -> str:
    """map_id, channel, cell_id, value from maps (map_id, channel, cell_id, value): channel is g * n_out + o."""
    read = f"select s.map_id, s.channel as c, m.g, m.out_id, m.p, sum(m.w * s.value) as v from {stencil_} m join {sky} s on m.in_id = s.cell_id group by s.map_id, s.channel, m.g, m.out_id, m.p"
    mixed = f"select r.map_id, r.g, k.o, r.out_id, sum(k.w * r.v) as y from ({read}) r join {kernel} k on r.g = k.g and r.c = k.c and r.p = k.p group by r.map_id, r.g, k.o, r.out_id"
    return f"(select m.map_id, m.g * {n_out} + m.o as channel, m.out_id as cell_id, m.y + b.b as value from ({mixed}) m join {bias} b on m.g = b.g and m.o = b.o)"


def group_norm_relu(sky: str, channels: int, eps: float = 1e-5) -> str:
    """Each map's groups of channels to mean 0 and variance 1, then no less than 0; as many groups, eight at most, as divide the channels."""
    groups = max(n for n in range(1, min(8, channels) + 1) if channels % n == 0)
    of = g.div("channel", channels // groups)
    stats = f"select map_id, {of} as grp, avg(value) as mean, var_pop(value) as var from {sky} _s group by map_id, {of}"
    return f"(select s.map_id, s.channel, s.cell_id, greatest((s.value - t.mean) / sqrt(t.var + {eps!r}), 0.0e0) as value from {sky} s join ({stats}) t on s.map_id = t.map_id and {g.div('s.channel', channels // groups)} = t.grp)"


def singularities(gauge: str, refs: tuple[tuple[float, float, float], ...] = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0))) -> list[tuple[float, float]]:
    """Longitude and latitude in degrees of the points where the gauge is not defined: the reference directions and what lies across, else the poles."""
    if gauge in ("phi", "cosmo"):
        return [(0.0, 90.0), (0.0, -90.0)]
    used = refs[:1] if gauge == "projected_ref" else refs[:2]
    points = [v for r in used for v in (r, tuple(-x for x in r))]
    return [(math.degrees(math.atan2(y, x)) % 360, math.degrees(math.asin(z / math.sqrt(x * x + y * y + z * z)))) for x, y, z in points]


def cache_key(nside: int, kernel: int, n_gauges: int, gauge: str, refs: tuple, ids: DataFrame | None = None) -> str:
    """A digest of what a stencil depends on; of the cells a digest that no order changes and that is summed where they are."""
    cells = "all"
    if ids is not None:
        row = ids.select(F.xxhash64("cell_id").alias("h"), F.xxhash64("cell_id", F.lit(1)).alias("k")).agg(F.count(F.lit(1)), F.bit_xor("h"), F.bit_xor("k")).first()
        cells = [*row]
    text = json.dumps([nside, kernel, n_gauges, gauge, [[round(x, 9) for x in r] for r in refs], cells], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()
