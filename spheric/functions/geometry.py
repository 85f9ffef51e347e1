"""Pixel geometry of the equal-area iso-latitude grid (Gorski et al. 2005), as SQL expressions over columns.

Each function takes SQL texts and returns one, made of functions that Spark and other engines share, so that a plan stays
within generated code and its twin can be run elsewhere. Integers are divided by floor, and numbers written as doubles.
"""

from __future__ import annotations

PI = "3.141592653589793e0"


def check_nside(nside: int) -> int:
    if nside < 1 or nside & (nside - 1):
        raise ValueError("nside must be a power of two")
    return nside


def div(a: str, b: object) -> str:
    return f"cast(floor(({a}) / ({b})) as bigint)"


def mod(a: str, b: object) -> str:
    """The remainder that has b's sign."""
    return f"(({a}) - ({b}) * cast(floor(({a}) / ({b})) as bigint))"


def fmod(a: str, b: str) -> str:
    return f"(({a}) - ({b}) * floor(({a}) / ({b})))"


def ring_of(p: str, nside: int) -> str:
    """The ring of a RING pixel, from 1 at the north."""
    n, npix, cap = check_nside(nside), 12 * nside * nside, 2 * nside * (nside - 1)
    polar = lambda q: f"cast(floor((1 + sqrt(1 + 2 * cast({q} as double))) / 2) as bigint)"
    return f"(case when {p} < {cap} then {polar(p)} when {p} < {npix - cap} then {div(f'{p} - {cap}', 4 * n)} + {n} else {4 * n} - {polar(f'({npix - 1} - {p})')} end)"


def ring_size(ring: str, nside: int) -> str:
    return f"(case when {ring} < {nside} then 4 * {ring} when {ring} > {3 * nside} then 4 * ({4 * nside} - {ring}) else {4 * nside} end)"


def ring_start(ring: str, nside: int) -> str:
    """The first pixel of a ring."""
    n, npix = nside, 12 * nside * nside
    return f"(case when {ring} < {n} then 2 * {ring} * ({ring} - 1) when {ring} > {3 * n} then {npix} - 2 * ({4 * n} - {ring}) * ({4 * n} - {ring} + 1) else {2 * n * (n - 1)} + 4 * {n} * ({ring} - {n}) end)"


def ring_z(ring: str, nside: int) -> str:
    n = nside
    return f"(case when {ring} < {n} then 1 - {ring} * {ring} / {3 * n * n}.0e0 when {ring} > {3 * n} then -1 + ({4 * n} - {ring}) * ({4 * n} - {ring}) / {3 * n * n}.0e0 else 2 * ({2 * n} - {ring}) / {3 * n}.0e0 end)"


def ring_phi0(ring: str, nside: int) -> str:
    """The longitude of a ring's first pixel."""
    n = nside
    return f"({PI} / {ring_size(ring, n)} * (case when {ring} < {n} or {ring} > {3 * n} or {mod(f'{ring} + {n}', 2)} = 0 then 1.0e0 else 0.0e0 end))"


def even_bits(v: str, level: int) -> str:
    """The even bits of v drawn together, for values of up to 2 * level bits."""
    return "(" + " + ".join(f"((({v}) >> {2 * i}) & 1) * {1 << i}" for i in range(max(1, level))) + ")"


def interleave(x: str, y: str, level: int) -> str:
    terms = [f"((({x}) >> {i}) & 1) * {1 << (2 * i)} + ((({y}) >> {i}) & 1) * {1 << (2 * i + 1)}" for i in range(max(1, level))]
    return "(" + " + ".join(terms) + ")"


def face_ring(f: str) -> str:
    """The ring of a face's southern corner, in units of the face: 2 for the four in the north, 3, then 4."""
    return f"(2 + {div(f, 4)})"


def face_phi(f: str) -> str:
    """The longitude of a face's centre in units of half a face: odd in the north and south, even on the equator."""
    return f"(2 * {mod(f, 4)} + case when {f} between 4 and 7 then 0 else 1 end)"


def staged(source: str, *steps: dict[str, str]) -> str:
    """A select for each step on top of the one before, so that an expression used often is worked out once."""
    for step in steps:
        source = f"(select *, {', '.join(f'{x} as {name}' for name, x in step.items())} from {source} _s)"
    return source


def with_ring_cell(source: str, columns: str, nside: int) -> str:
    """columns of source and ring_cell, the RING id of its NESTED cell_id."""
    n, level = check_nside(nside), nside.bit_length() - 1
    jp = div(f"{face_phi('_f')} * _nr + _x - _y + 1 + _shift", 2)
    steps = staged(
        source,
        {"_f": div("cell_id", n * n), "_low": mod("cell_id", n * n)},
        {"_x": even_bits("_low", level), "_y": even_bits("_low >> 1", level)},
        {"_ring": f"{face_ring('_f')} * {n} - _x - _y - 1"},
        {"_nr": f"case when _ring < {n} then _ring when _ring > {3 * n} then {4 * n} - _ring else {n} end", "_shift": f"case when _ring < {n} or _ring > {3 * n} then 0 else {mod(f'_ring - {n}', 2)} end"},
        {"_jp": jp},
    )
    return f"(select {columns}, {ring_start('_ring', n)} + {mod('_jp - 1', '4 * _nr')} as ring_cell from {steps} _t)"


def located(points: str, columns: str, z: str, phi: str, nside: int) -> str:
    """columns of points, ring_cell and nest_cell: the cells that hold the points with columns z and phi."""
    n, level, npix, cap = check_nside(nside), nside.bit_length() - 1, 12 * nside * nside, 2 * nside * (nside - 1)
    ring_belt = f"{cap} + (_ir - 1) * {4 * n} + {mod(div(f'_jp + _jm - {n} + 2 - {mod("_ir", 2)}', 2), 4 * n)}"
    polar = mod("cast(floor(_tt * _pr) as bigint)", "4 * _pr")
    ring = f"case when abs({z}) <= 2 / 3.0e0 then {ring_belt} when {z} > 0 then 2 * _pr * (_pr - 1) + {polar} else {npix} - 2 * _pr * (_pr + 1) + {polar} end"
    belt_face = f"(case when _fp = _fm then 4 + {mod('_fp', 4)} when _fp < _fm then {mod('_fp', 4)} else 8 + {mod('_fm', 4)} end)"
    face = f"case when abs({z}) <= 2 / 3.0e0 then {belt_face} when {z} > 0 then _q else _q + 8 end"
    x = f"case when abs({z}) <= 2 / 3.0e0 then {mod('_jm', n)} when {z} > 0 then {n - 1} - _b else _a end"
    y = f"case when abs({z}) <= 2 / 3.0e0 then {n - 1} - {mod('_jp', n)} when {z} > 0 then {n - 1} - _a else _b end"
    steps = staged(
        points,
        {"_tt": f"{fmod(phi, f'(2 * {PI})')} / ({PI} / 2)", "_t": f"{n} * sqrt(3 * (1 - abs({z})))"},
        {"_jp": f"cast(floor({n} * (0.5e0 + _tt) - {0.75 * n}e0 * {z}) as bigint)", "_jm": f"cast(floor({n} * (0.5e0 + _tt) + {0.75 * n}e0 * {z}) as bigint)", "_q": "least(3, cast(floor(_tt) as bigint))"},
        {"_ir": f"{n} + 1 + _jp - _jm", "_fp": div("_jp", n), "_fm": div("_jm", n), "_pr": "1 + cast(floor((_tt - floor(_tt)) * _t) as bigint) + cast(floor((1 - (_tt - floor(_tt))) * _t) as bigint)", "_a": f"least({n - 1}, cast(floor((_tt - _q) * _t) as bigint))", "_b": f"least({n - 1}, cast(floor((1 - (_tt - _q)) * _t) as bigint))"},
        {"ring_cell": ring, "_face": face, "_x": x, "_y": y},
    )
    return f"(select {columns}, ring_cell, _face * {n * n} + {interleave('_x', '_y', level)} as nest_cell from {steps} _t)"


def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """The angle between two points, all in radians."""
    h = f"(power(sin(({lat2} - {lat1}) / 2), 2) + cos({lat1}) * cos({lat2}) * power(sin(({lon2} - {lon1}) / 2), 2))"
    return f"(2 * asin(sqrt(least(1.0e0, greatest(0.0e0, {h})))))"


def to_vector(lon: str, lat: str) -> tuple[str, str, str]:
    """The unit vector of a point in degrees."""
    return f"(cos(radians({lat})) * cos(radians({lon})))", f"(cos(radians({lat})) * sin(radians({lon})))", f"sin(radians({lat}))"


def from_vector(x: str, y: str, z: str) -> tuple[str, str]:
    """Longitude, from 0 to 360, and latitude of a vector of any length, in degrees."""
    size = f"sqrt({x} * {x} + {y} * {y} + {z} * {z})"
    return fmod(f"degrees(atan2({y}, {x}))", "360.0e0"), f"degrees(asin(least(1.0e0, greatest(-1.0e0, {z} / {size}))))"


def gnomonic(lon: str, lat: str, lon0: str, lat0: str) -> tuple[str, str]:
    """Tangent-plane coordinates around (lon0, lat0). Points beyond 90 degrees mirror, as no hemisphere is asked for."""
    c = f"(sin({lat0}) * sin({lat}) + cos({lat0}) * cos({lat}) * cos({lon} - {lon0}))"
    safe = f"(case when abs({c}) < 1e-15 then 1e-15 else {c} end)"
    return f"(cos({lat}) * sin({lon} - {lon0}) / {safe})", f"((cos({lat0}) * sin({lat}) - sin({lat0}) * cos({lat}) * cos({lon} - {lon0})) / {safe})"


#: The WGS84 ellipsoid's squared eccentricity.
E2 = 0.0066943799901413165


def authalic(lat: str) -> str:
    """Geodetic to authalic latitude on WGS84, in radians."""
    e = E2**0.5
    q = lambda s: f"({1 - E2}e0 * ({s} / (1 - {E2}e0 * {s} * {s}) - ln((1 - {e}e0 * {s}) / (1 + {e}e0 * {s})) / {2 * e}e0))"
    return f"asin(least(1.0e0, greatest(-1.0e0, {q(f'sin({lat})')} / {q('1.0e0')})))"


def geodetic(beta: str) -> str:
    """Authalic to geodetic latitude on WGS84 by the series in the squared eccentricity (Snyder 1987, 3-18)."""
    e2, e4, e6 = E2, E2**2, E2**3
    a, b, c = e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040, 23 * e4 / 360 + 251 * e6 / 3780, 761 * e6 / 45360
    return f"({beta} + {a!r}e0 * sin(2 * {beta}) + {b!r} * sin(4 * {beta}) + {c!r} * sin(6 * {beta}))"


CONVENTIONS = ("colatitude_rad", "colatitude_deg", "geographic_rad", "geographic_deg")


def to_theta_phi(lat: str, lon: str, convention: str) -> tuple[str, str]:
    """Colatitude and longitude in radians; only the geographic conventions wrap the longitude."""
    if convention not in CONVENTIONS:
        raise ValueError(f"convention must be one of {CONVENTIONS}")
    if convention.endswith("deg"):
        lat, lon = f"radians({lat})", f"radians({lon})"
    return (lat, lon) if convention.startswith("co") else (f"({PI} / 2 - {lat})", fmod(lon, f"(2 * {PI})"))
