"""Rings from scattered samples, and their weights. Samples are (sample_id, lat, lon) in one of four conventions."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame

from spheric.functions import geometry as g

QUADRATURES = ("equal_area", "uniform", "trapeze", "gauss_legendre")
#: Slices of colatitude in which rings are looked for.
SLICES = 4096


def build_rings(samples: str, convention: str = "geographic_deg", atol: float = 1e-10) -> str:
    """sample_id, theta, phi, ring_id (from 1), ring_theta (its first member's), place in its ring.

    A ring begins where theta is more than atol beyond the last one. Distinct thetas are looked at in SLICES slices of the
    circle, and only the slices' edges, one row for each, in one window over all.
    """
    theta, phi = g.to_theta_phi("lat", "lon", convention)
    points = f"select sample_id, {theta} as theta, {phi} as phi from {samples} _s"
    thetas = f"select theta, cast(floor(theta * {SLICES} / {g.PI}) as bigint) as slice from (select distinct theta from ({points}) _p) _t"
    turns = f"select theta, slice, case when theta - lag(theta) over (partition by slice order by theta) > {atol} then 1 else 0 end as turn from ({thetas}) _h"
    inner = f"select theta, slice, sum(turn) over (partition by slice order by theta rows between unbounded preceding and current row) as up from ({turns}) _u"
    edges = f"select slice, case when lo - lag(hi) over (order by slice) > {atol} then 1 else 0 end as fresh, ups from (select slice, min(theta) as lo, max(theta) as hi, max(up) as ups from ({inner}) _i group by slice) _g"
    begun = f"select slice, 1 + sum(fresh + ups) over (order by slice rows between unbounded preceding and current row) - ups as base from ({edges}) _e"
    named = f"select n.theta, b.base + n.up as ring_id from ({inner}) n join ({begun}) b on n.slice = b.slice"
    first = f"select theta, ring_id, min(theta) over (partition by ring_id) as ring_theta from ({named}) _n"
    return f"(select sample_id, p.theta, phi, cast(ring_id as bigint) as ring_id, ring_theta, row_number() over (partition by ring_id order by p.theta, phi, sample_id) as place from ({points}) p join ({first}) f on p.theta = f.theta)"


def uniformity(ringed: str, tol: float = 1e-10, full_circle: bool = False) -> str:
    """ring_id, ring_theta, n_r, uniform: whether the steps in longitude differ by less than tol steps. full_circle asks too that they are 2 pi / n."""
    steps = f"select ring_id, ring_theta, phi, lead(phi) over (partition by ring_id order by phi) - phi as step from {ringed} _r"
    whole = f" and abs(max(step) - 2 * {g.PI} / count(*)) < {tol} * 2 * {g.PI} / count(*)" if full_circle else ""
    return f"(select ring_id, min(ring_theta) as ring_theta, count(*) as n_r, case when count(*) <= 1 then true else max(step) - min(step) < {tol} * 2 * {g.PI} / count(*){whole} end as uniform from ({steps}) _s group by ring_id)"


def ring_weights(ringed: str, quadrature: str, n_rings: int = 0) -> str:
    """ring_id, w_theta: the colatitude part of the weight. gauss_legendre needs the number of rings, whose nodes go by rank."""
    rings = f"select ring_id, min(ring_theta) as t from {ringed} _r group by ring_id"
    if quadrature == "trapeze":
        before, after = "lag(t) over (order by t)", "lead(t) over (order by t)"
        step = f"case when {before} is null and {after} is null then {g.PI} when {before} is null then ({after} - t) / 2 when {after} is null then (t - {before}) / 2 else ({after} - {before}) / 2 end"
        return f"(select ring_id, abs(sin(t) * ({step})) as w_theta from ({rings}) _t)"
    if quadrature == "gauss_legendre":
        nodes, weights = np.polynomial.legendre.leggauss(n_rings)
        rows = ", ".join(f"({i + 1}, {w!r}e0)" for i, w in enumerate(weights[::-1].tolist()))
        return f"(select ring_id, w as w_theta from (select ring_id, row_number() over (order by t) as k from ({rings}) _t) _k join (values {rows}) as _v(k2, w) on k = k2)"
    raise ValueError(f"quadrature must be one of {QUADRATURES}")


def sample_weights(ringed: str, quadrature: str = "trapeze", n_rings: int = 0) -> str:
    """sample_id, ring_id, w. equal_area weighs every sample 4 pi / N and uniform 1 / N. Else longitudes weigh 2 pi / n on a uniform ring, else half the gaps on either side around the circle."""
    if quadrature in ("equal_area", "uniform"):
        whole = f"4 * {g.PI}" if quadrature == "equal_area" else "1.0e0"
        return f"(select sample_id, ring_id, {whole} / (select count(*) from {ringed} _n) as w from {ringed} _r)"
    run, ring = "over (partition by ring_id order by phi, sample_id)", "over (partition by ring_id)"
    gaps = (
        f"select sample_id, ring_id, coalesce(lead(phi) {run} - phi, min(phi) {ring} + 2 * {g.PI} - phi) as up, coalesce(phi - lag(phi) {run}, phi - max(phi) {ring} + 2 * {g.PI}) as down from {ringed} _r"
    )
    w = f"case when u.uniform then 2 * {g.PI} / u.n_r else (p.up + p.down) / 2 end * t.w_theta"
    return f"(select sample_id, p.ring_id, {w} as w from ({gaps}) p join {uniformity(ringed)} u on p.ring_id = u.ring_id join {ring_weights(ringed, quadrature, n_rings)} t on p.ring_id = t.ring_id)"


def check_nodes(rings: DataFrame, n_rings: int, tolerance: float = 1e-6) -> None:
    """Raises ValueError unless the rings (ring_id, ring_theta) are n_rings, as gauss_legendre needs; warns where they are off its nodes by more than tolerance in cos theta."""
    found = np.sort([r[0] for r in rings.select("ring_id", "ring_theta").distinct().select("ring_theta").limit(n_rings + 1).collect()])
    if len(found) != n_rings:
        raise ValueError(f"the grid has not {n_rings} rings")
    off = np.abs(np.sort(np.cos(found)) - np.polynomial.legendre.leggauss(n_rings)[0]).max()
    if off > tolerance:
        warnings.warn(f"rings are off the Gauss-Legendre nodes by up to {off:.1e} in cos(theta)", UserWarning, stacklevel=2)


def grid_summary(ringed: str, lmax: int = 24) -> str:
    cost = f"case when uniform then n_r * log2(greatest(2, n_r)) else n_r * {lmax + 1} end"
    return (
        f"(select cast(sum(n_r) as bigint) as n_total, count(*) as n_rings, count(case when uniform then 1 end) as n_uniform, cast({(lmax + 1) * (lmax + 2) // 2} as bigint) as n_alm,"
        f" degrees(min(ring_theta)) as theta_min_deg, degrees(max(ring_theta)) as theta_max_deg, sum({cost}) as cost, min(n_r) as n_r_min, max(n_r) as n_r_max, avg(n_r) as n_r_mean from {uniformity(ringed)} _u)"
    )
