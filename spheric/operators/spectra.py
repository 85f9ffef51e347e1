"""Spectra of images (img_id, row, col, value): two one-dimensional transforms, rows then columns, and radial bins."""

from __future__ import annotations

from spheric.functions import geometry as g
from spheric.plans.sql import SPARK, each

NORMS = {"n": 1, "n2": 2}


def fft2(image: str, n_rows: int, n_cols: int, dialect: str = SPARK) -> str:
    """img_id, ky, kx, re, im by two grouped sums, each of one more index, instead of one over both."""
    x, y = f"(2 * {g.PI} * kx * col / {n_cols})", f"(2 * {g.PI} * ky * row / {n_rows})"
    rows = f"select img_id, row, kx, sum(value * cos{x}) as re, -sum(value * sin{x}) as im from {image} _i {each(0, n_cols - 1, 'kx', dialect)} group by img_id, row, kx"
    return f"(select img_id, ky, kx, sum(re * cos{y} + im * sin{y}) as re, sum(im * cos{y} - re * sin{y}) as im from ({rows}) _r {each(0, n_rows - 1, 'ky', dialect)} group by img_id, ky, kx)"


def ifft2(spectrum: str, n_rows: int, n_cols: int, dialect: str = SPARK) -> str:
    """img_id, row, col, value: the image whose transform is (img_id, ky, kx, re, im), as fft2 makes it; its real part."""
    x, y = f"(2 * {g.PI} * kx * col / {n_cols})", f"(2 * {g.PI} * ky * row / {n_rows})"
    cols = f"select img_id, row, kx, sum(re * cos{y} - im * sin{y}) as re, sum(im * cos{y} + re * sin{y}) as im from {spectrum} _s {each(0, n_rows - 1, 'row', dialect)} group by img_id, row, kx"
    return f"(select img_id, row, col, sum(re * cos{x} - im * sin{x}) / {n_rows * n_cols}.0e0 as value from ({cols}) _c {each(0, n_cols - 1, 'col', dialect)} group by img_id, row, col)"


def unwrapped(samples: str) -> str:
    """The samples (img_id, sample_id, lat, lon, value) with lon in degrees and without jumps along each parallel, in the order of ids. Longitudes of a map of 2 pi at most in size are radians."""
    degrees = f"select s.img_id, s.sample_id, s.lat, case when m.top > 2 * {g.PI} then s.lon else degrees(s.lon) end as lon, s.value from {samples} s join (select img_id, max(abs(lon)) as top from {samples} _m group by img_id) m on s.img_id = m.img_id"
    steps = f"select *, lon - lag(lon) over (partition by img_id, lat order by sample_id) as step from ({degrees}) _d"
    turns = f"select *, case when abs(step) > 180 then -360 * floor((step + 180) / 360.0e0) else 0.0e0 end as turn from ({steps}) _t"
    return f"(select img_id, sample_id, lat, lon + sum(turn) over (partition by img_id, lat order by sample_id rows between unbounded preceding and current row) as lon, value from ({turns}) _u)"


def lonlat_image(samples: str) -> str:
    """img_id, row, col, value of samples on parallels: rows by latitude, columns by longitude without jumps."""
    rows = f"select img_id, lat, row_number() over (partition by img_id order by lat) - 1 as row from (select distinct img_id, lat from {samples} _l) _r"
    cols = f"select img_id, lat, value, row_number() over (partition by img_id, lat order by lon, sample_id) - 1 as col from {unwrapped(samples)} _c"
    return f"(select c.img_id, r.row, c.col, c.value from ({cols}) c join ({rows}) r on c.img_id = r.img_id and c.lat = r.lat)"


def edge_shifts(points: str, n_cols: int) -> str:
    """row, s: how far each row (row, col, lon) begins east of the westmost one, in columns of row 0."""
    west = f"select row, min(lon) as west from {points} _p group by row"
    return f"(select w.row, {n_cols} * (w.west - m.least) / r.width as s from ({west}) w cross join (select min(west) as least from ({west}) _w) m cross join (select max(lon) - min(lon) as width from {points} _q where row = 0) r)"


def row_shift(image: str, shifts: str) -> str:
    """Each row moved by its shift s (row, s), between 0 and 1: (1 - s) d + s times the value before, the first of a row before itself."""
    before = "coalesce(lag(value) over (partition by img_id, i.row order by col), value)"
    return f"(select img_id, i.row, col, (1 - s) * value + s * {before} as value from {image} i join {shifts} s on i.row = s.row)"


def phase_shift(x0: str, frequency: str) -> tuple[str, str]:
    """The real and imaginary part of exp(2 pi i f x0), by which a shift of x0 turns the mode of that frequency."""
    return f"cos(2 * {g.PI} * {frequency} * {x0})", f"sin(2 * {g.PI} * {frequency} * {x0})"


def radial_bins(n_rows: int, n_cols: int, dx: float = 1.0) -> str:
    """ky, kx, bin, f_center: bins from 0 of equal width up to the largest frequency, whose own corner falls beyond the last and is left out."""
    bins = min(n_rows, n_cols) // 2
    freq = lambda k, n: f"((case when {k} < {(n + 1) // 2} then {k} else {k} - {n} end) / {n * dx}e0)"
    fr = f"select ky, kx, sqrt({freq('kx', n_cols)} * {freq('kx', n_cols)} + {freq('ky', n_rows)} * {freq('ky', n_rows)}) as fr from (select y.k as ky, x.k as kx from range(0, {n_rows}) as y(k) cross join range(0, {n_cols}) as x(k)) _k"
    top = ((n_rows // 2 / (n_rows * dx)) ** 2 + (n_cols // 2 / (n_cols * dx)) ** 2) ** 0.5
    # the step up keeps values that stand on an edge, but for rounding, with the bin above it
    at = f"cast(floor(fr / {top!r}e0 * {bins} + 1e-9) as bigint)".replace("e0e0", "e0")
    return f"(select ky, kx, bin, (bin + 0.5e0) * {top / bins!r} as f_center from (select ky, kx, {at} as bin from ({fr}) _f) _b where bin < {bins})"


def power(image: str, n_rows: int, n_cols: int, *, other: str = "", cross: str = "abs", norm: str = "n", dx: float = 1.0, dialect: str = SPARK) -> str:
    """img_id, bin, f_center, pk: mean power by bin; a bin without frequencies has no row. cross takes the product's size or its real part."""
    a = fft2(image, n_rows, n_cols, dialect)
    if other:
        b = fft2(other, n_rows, n_cols, dialect)
        re, im = "a.re * b.re + a.im * b.im", "a.im * b.re - a.re * b.im"
        p = f"sqrt(({re}) * ({re}) + ({im}) * ({im}))" if cross == "abs" else f"({re})"
        joined = f"select a.img_id, a.ky, a.kx, {p} as p from {a} a join {b} b on a.img_id = b.img_id and a.ky = b.ky and a.kx = b.kx"
    else:
        joined = f"select img_id, ky, kx, re * re + im * im as p from {a} _a"
    return f"(select j.img_id, r.bin, r.f_center, avg(j.p) / {(n_rows * n_cols) ** NORMS[norm]}.0e0 as pk from ({joined}) j join {radial_bins(n_rows, n_cols, dx)} r on j.ky = r.ky and j.kx = r.kx group by j.img_id, r.bin, r.f_center)"


def tukey(image: str, n_rows: int, n_cols: int, alpha: float = 0.5) -> str:
    """The image under the outer product of two tapered-cosine windows."""

    def window(i: str, n: int) -> str:
        edge = alpha * (n - 1) / 2
        if edge <= 0:
            return "1.0e0"
        return f"(case when {i} < {edge} then 0.5e0 * (1 + cos({g.PI} * ({i} / {edge}e0 - 1))) when {i} > {n - 1 - edge} then 0.5e0 * (1 + cos({g.PI} * (({n - 1} - {i}) / {edge}e0 - 1))) else 1.0e0 end)"

    return f"(select img_id, row, col, value * {window('row', n_rows)} * {window('col', n_cols)} as value from {image} _i)"


def flat_sky(samples: str, nside: int, lmax: int, dialect: str = SPARK) -> str:
    """map_id, l, cl of a patch taken as flat: transforms along rings, then across the rings there are, by their rank; l is the rounded length of (m, ly), and its power their mean."""
    from spheric.operators.harmonics import ring_dft

    f = ring_dft(samples, lmax, dialect)
    # ranks come from the rings there are, a row for each, not from all their modes
    rings = f"select map_id, ring_id, row_number() over (partition by map_id order by ring_id) - 1 as j, count(*) over (partition by map_id) as ny from (select distinct map_id, ring_id from {samples} _d) _k"
    sized = f"select f.map_id, f.ring_id, f.m, f.re, f.im, r.j, r.ny from {f} f join ({rings}) r on f.map_id = r.map_id and f.ring_id = r.ring_id"
    angle = f"(2 * {g.PI} * k * j / ny)"
    across = f"select map_id, m, k, ny, sum(re * cos{angle} + im * sin{angle}) as re, sum(im * cos{angle} - re * sin{angle}) as im from ({sized}) _s {each(0, 'ny - 1', 'k', dialect)} group by map_id, m, k, ny"
    scale = f"{4 * 3.141592653589793 / (12 * nside * nside)!r}"
    ly = f"((case when k < (ny + 1) / 2 - 0.25e0 then k else k - ny end) * {4.0 * nside}e0 / ny)"
    p = f"(case when m = 0 then 1 else 2 end) * (re * re + im * im) * {scale} * {scale}"
    half_even = "round_even" if dialect != SPARK else "bround"
    powers = f"select map_id, cast({half_even}(sqrt(m * m + {ly} * {ly}), 0) as bigint) as l, {p} as p from ({across}) _x"
    return f"(select map_id, l, avg(p) as cl from ({powers}) _p where l <= {lmax} group by map_id, l)"
