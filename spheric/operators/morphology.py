"""Soft Minkowski functionals of images and of maps on the sphere."""

from __future__ import annotations

from spheric.operators.grid import neighbours


def soft(value: str, threshold: str, temperature: float) -> str:
    return f"(1 / (1 + exp(-{float(temperature)}e0 * ({value} - {threshold}))))"


def functionals(image: str, thresholds: str, size: int, temperature: float = 20.0) -> str:
    """img_id, threshold, w0, w1, w2 of square images of side size: area, edges and Euler number of the soft mask, whose products over cells, pairs and squares alternate."""
    mask = f"select i.img_id, t.threshold, i.row, i.col, {soft('i.value', 't.threshold', temperature)} as m from {image} i cross join {thresholds} t"
    w = "lead(m) over (partition by img_id, threshold, row order by col) as e, lead(m) over (partition by img_id, threshold, col order by row) as s"
    near = f"select *, lead(e) over (partition by img_id, threshold, col order by row) as d from (select *, {w} from ({mask}) _m) _n"
    n2 = size * size
    return (
        f"(select img_id, threshold, avg(m) as w0, sum(coalesce(abs(e - m), 0.0e0) + coalesce(abs(s - m), 0.0e0)) / {n2}.0e0 as w1,"
        f" (sum(m) - sum(coalesce(m * e, 0.0e0)) - sum(coalesce(m * s, 0.0e0)) + sum(coalesce(m * e * s * d, 0.0e0))) / {n2}.0e0 as w2 from ({near}) _f group by img_id, threshold)"
    )


def edges(nside: int) -> str:
    """Rows (i, j), i < j, of cells that touch."""
    return f"(select cell_id as i, other as j from {neighbours(nside)} _n where cell_id < other)"


def triangles(nside: int) -> str:
    e = edges(nside)
    return f"(select x.i, x.j, y.j as k from {e} x join {e} y on x.j = y.i join {e} z on x.i = z.i and y.j = z.j)"


def quads(nside: int) -> str:
    """Fours of cells that all touch each other."""
    e = edges(nside)
    return f"(select t.i, t.j, t.k, x.j as l from {triangles(nside)} t join {e} x on t.k = x.i join {e} y on t.i = y.i and x.j = y.j join {e} z on t.j = z.i and x.j = z.j)"


def sphere_functionals(sky: str, thresholds: str, nside: int, temperature: float = 20.0, euler: str = "triangles") -> str:
    """map_id, threshold, w0, w1, w2 over NESTED cells, their pairs that touch and the triangles of these.

    Where four cells meet in a point all their pairs touch; euler="cliques" takes such fours off too, which makes the
    Euler number of the whole sphere 2, where triangles alone leave one more for each such point.
    """
    if euler not in ("triangles", "cliques"):
        raise ValueError("euler must be 'triangles' or 'cliques'")
    npix = 12 * nside * nside
    mask = f"(select s.map_id, t.threshold, s.cell_id, {soft('s.value', 't.threshold', temperature)} as m from {sky} s cross join {thresholds} t)"
    on = "a.map_id = {0}.map_id and a.threshold = {0}.threshold"
    one = f"select map_id, threshold, sum(m) as q1 from {mask} _m group by map_id, threshold"
    two = f"select a.map_id, a.threshold, sum(a.m * b.m) as qe, sum(abs(a.m - b.m)) as de from {mask} a join {edges(nside)} e on a.cell_id = e.i join {mask} b on {on.format('b')} and b.cell_id = e.j group by a.map_id, a.threshold"
    three = f"select a.map_id, a.threshold, sum(a.m * b.m * c.m) as qf from {mask} a join {triangles(nside)} t on a.cell_id = t.i join {mask} b on {on.format('b')} and b.cell_id = t.j join {mask} c on {on.format('c')} and c.cell_id = t.k group by a.map_id, a.threshold"
    joined, fours = f"({one}) a join ({two}) e on {on.format('e')} join ({three}) f on {on.format('f')}", ""
    if euler == "cliques":
        four = f"select a.map_id, a.threshold, sum(a.m * b.m * c.m * d.m) as qq from {mask} a join {quads(nside)} q on a.cell_id = q.i join {mask} b on {on.format('b')} and b.cell_id = q.j join {mask} c on {on.format('c')} and c.cell_id = q.k join {mask} d on {on.format('d')} and d.cell_id = q.l group by a.map_id, a.threshold"
        joined, fours = f"{joined} join ({four}) g on {on.format('g')}", " - g.qq"
    return f"(select a.map_id, a.threshold, a.q1 / {npix}.0e0 as w0, e.de / {npix}.0e0 as w1, (a.q1 - e.qe + f.qf{fours}) / {npix}.0e0 as w2 from {joined})"
