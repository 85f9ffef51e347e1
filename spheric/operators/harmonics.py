"""Spherical-harmonic transforms as joins and two grouped sums: over a ring's samples to (ring, m), then over rings to (l, m).

Maps are rows (map_id, ring_id, phi, value) with optional weight; coefficients (map_id, l, m, re, im), m >= 0 only;
Y_lm = sqrt((2l+1)/4pi) P_lm exp(i m phi) with the Condon-Shortley sign. Absent cells count as zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spheric import ship
from spheric.functions import geometry as g
from spheric.plans.sql import SPARK, each


def legendre(z: np.ndarray, m: int, lmax: int) -> np.ndarray:
    """Y_lm(theta, 0) for l = m..lmax, by the orthonormal recurrence with its seed in logarithms; values that underflow stay 0 until they grow."""
    x, s = np.asarray(z, float), np.sqrt(np.maximum(0.0, 1 - np.asarray(z, float) ** 2))
    with np.errstate(divide="ignore"):
        seed = 0.5 * np.log((2 * m + 1) / (4 * np.pi)) + 0.5 * np.sum(np.log1p(-1 / (2 * np.arange(1, m + 1)))) + (m * np.log(s) if m else 0.0)
    sign = -1.0 if m % 2 else 1.0
    scale = np.minimum(0.0, np.broadcast_to(seed, x.shape) + 300.0)  # how far below the smallest number worked with
    a, b = np.zeros_like(x), sign * np.exp(np.broadcast_to(seed, x.shape) - scale)
    out = np.empty((lmax - m + 1, len(x)))
    for l in range(m, lmax + 1):
        out[l - m] = b * np.exp(scale)
        k = l + 1
        up = np.sqrt((4 * k * k - 1) / (k * k - m * m))
        down = np.sqrt(((k - 1) ** 2 - m * m) / (4 * (k - 1) ** 2 - 1)) if k - 1 > m else 0.0
        a, b = b, up * (x * b - down * a)
        big = np.abs(b) > 1e200
        if big.any():
            a, b, scale = np.where(big, a * 1e-200, a), np.where(big, b * 1e-200, b), np.where(big, scale + 200 * np.log(10), scale)
    return out


def legendre_table(rings: DataFrame, lmax: int) -> DataFrame:
    """Rows (ring_id, l, m, y) of the rings' (ring_id, z), dealt by m; each batch of rings is worked through at once."""

    def table(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, z, ms = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for m in np.unique(ms):
                own = ms == m
                y = legendre(z[own], int(m), lmax)
                l = np.arange(m, lmax + 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids[own], len(l))), pa.array(np.repeat(l, own.sum())), pa.array(np.full(y.size, m)), pa.array(y.ravel())], ["ring_id", "l", "m", "y"])

    spark = ship(rings.sparkSession)
    keyed = rings.select("ring_id", "z").crossJoin(spark.range(lmax + 1).withColumnRenamed("id", "m"))  # lmax + 1 rows by rings of one grid
    return keyed.repartition(max(1, min(lmax + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))), "m").mapInArrow(table, "ring_id long, l long, m long, y double")


def legendre_closed(rings: str, lmax: int, dialect: str = SPARK) -> str:
    """The same table by the finite sum, for lmax up to 10."""
    terms = f"select ring_id, z, l, m, k from {rings} _r {each(0, lmax, 'l', dialect)} {each(0, 'l', 'm', dialect)} {each(0, 'cast(floor((l - m) / 2) as bigint)', 'k', dialect)}"
    f = lambda x: f"cast(factorial(cast({x} as int)) as double)"
    term = f"(case when {g.mod('k', 2)} = 0 then 1 else -1 end) * {f('2 * l - 2 * k')} / (power(2.0e0, l) * {f('k')} * {f('l - k')} * {f('l - 2 * k - m')}) * power(z, l - 2 * k - m)"
    norm = f"(case when {g.mod('m', 2)} = 0 then 1 else -1 end) * sqrt((2 * l + 1) / (4 * {g.PI}) * {f('l - m')} / {f('l + m')}) * power(1 - z * z, m / 2.0e0)"
    return f"(select ring_id, l, m, {norm} * sum({term}) as y from ({terms}) _t group by ring_id, z, l, m)"


def ring_dft(samples: str, mmax: int, dialect: str = SPARK, value: str = "value", weight: str = "1.0e0") -> str:
    """map_id, ring_id, m, re, im: sums of value * weight * exp(-i m phi)."""
    return f"(select map_id, ring_id, m, sum({value} * {weight} * cos(m * phi)) as re, -sum({value} * {weight} * sin(m * phi)) as im from {samples} _s {each(0, mmax, 'm', dialect)} group by map_id, ring_id, m)"


def map2alm(samples: str, plm: str, lmax: int, dialect: str = SPARK, weight: str = "1.0e0") -> str:
    return f"(select f.map_id, p.l, p.m, sum(f.re * p.y) as re, sum(f.im * p.y) as im from {ring_dft(samples, lmax, dialect, weight=weight)} f join {plm} p on f.ring_id = p.ring_id and f.m = p.m group by f.map_id, p.l, p.m)"


def alm2map(alm: str, plm: str, points: str, real_factor: int = 2) -> str:
    """map_id, cell_id, value on the points (cell_id, ring_id, phi). real_factor 2 is the synthesis of a real map, 1 leaves out the conjugate half."""
    rings = f"select a.map_id, p.ring_id, a.m, sum(a.re * p.y) as re, sum(a.im * p.y) as im from {alm} a join {plm} p on a.l = p.l and a.m = p.m group by a.map_id, p.ring_id, a.m"
    factor = f"case when r.m = 0 then 1 else {real_factor} end"
    return f"(select r.map_id, s.cell_id, sum(({factor}) * (r.re * cos(r.m * s.phi) - r.im * sin(r.m * s.phi))) as value from ({rings}) r join {points} s on r.ring_id = s.ring_id group by r.map_id, s.cell_id)"


def spectrum(alm: str, other: str = "") -> str:
    """map_id, l, cl: auto, or cross with the same map_id of other."""
    if not other:
        return f"(select map_id, l, sum((case when m = 0 then 1 else 2 end) * (re * re + im * im)) / (2 * l + 1) as cl from {alm} _a group by map_id, l)"
    return f"(select a.map_id, a.l, sum((case when a.m = 0 then 1 else 2 end) * (a.re * b.re + a.im * b.im)) / (2 * a.l + 1) as cl from {alm} a join {other} b on a.map_id = b.map_id and a.l = b.l and a.m = b.m group by a.map_id, a.l)"


def filtered(alm: str, lcut: int) -> str:
    """Low pass: modes below lcut."""
    return f"(select map_id, l, m, re, im from {alm} _a where l < {lcut})"


def weighted(alm: str, weights: str) -> str:
    """Each mode times the weight (l, w) of its l; modes without one drop out."""
    return f"(select a.map_id, a.l, a.m, a.re * f.w as re, a.im * f.w as im from {alm} a join {weights} f on a.l = f.l)"


def flat_index(l: str, m: str, lmax: int) -> str:
    """The place of (l, m) in a flat list of modes, by m and then l."""
    return f"({g.div(f'{m} * ({2 * lmax + 3} - {m})', 2)} + {l} - {m})"


def flat_modes(lmax: int, dialect: str = SPARK) -> str:
    """i, l, m of a flat list of modes."""
    lm = f"select l, m from (select m from range(0, {lmax + 1}) as _m(m)) _r {each('m', lmax, 'l', dialect)}"
    return f"(select {flat_index('l', 'm', lmax)} as i, l, m from ({lm}) _x)"


def bandpowers(cl: str, bins: str) -> str:
    """map_id, band, power: sums of cl by the binning (band, l, w)."""
    return f"(select c.map_id, b.band, sum(b.w * c.cl) as power from {cl} c join {bins} b on c.l = b.l group by c.map_id, b.band)"


# Spin


def spin_legendre(s: int, m: int, lmax: int, theta: np.ndarray) -> np.ndarray:
    """sY_lm(theta, 0) = (-1)^s sqrt((2l+1)/4pi) d^l_{m,-s}(theta) for l = |m|..lmax, by the three-term recurrence in l with its seed in logarithms, as in legendre(); zeros for l < |s|."""
    from math import lgamma

    theta, n, low = np.asarray(theta, float), -s, max(abs(m), abs(s))
    out = np.zeros((max(0, lmax - abs(m) + 1), len(theta)))
    if lmax < low:
        return out
    f = lambda x: lgamma(x + 1)
    k = max(0, n - m)  # at l = max(|m|, |s|) the finite sum has this term alone
    pc, ps = 2 * low - 2 * k + n - m, 2 * k - n + m
    seed = np.full(len(theta), 0.5 * (f(low + m) + f(low - m) + f(low + n) + f(low - n)) - f(low + n - k) - f(k) - f(low - k - m) - f(k - n + m))
    for power, x in ((pc, np.cos(theta / 2)), (ps, np.sin(theta / 2))):
        if power:
            seed += power * np.log(np.maximum(x, 1e-300))
    x, scale = np.cos(theta), np.minimum(0.0, seed + 300.0)
    a, b = np.zeros_like(x), (-1.0) ** (k + m - n + s) * np.exp(seed - scale)
    for l in range(low, lmax + 1):
        out[l - abs(m)] = np.sqrt((2 * l + 1) / (4 * np.pi)) * b * np.exp(scale)
        up = np.sqrt(float((l + 1) ** 2 - m * m) * float((l + 1) ** 2 - n * n))
        down = np.sqrt(float(l * l - m * m) * float(l * l - n * n)) * (l + 1) / l if l > low else 0.0
        a, b = b, ((2 * l + 1) * ((l + 1) * x - (m * n / l if l else 0.0)) * b - down * a) / up
        big = np.abs(b) > 1e200
        if big.any():
            a, b, scale = np.where(big, a * 1e-200, a), np.where(big, b * 1e-200, b), np.where(big, scale + 200 * np.log(10), scale)
    return out


def wigner_y(s: int, l: int, m: int, theta: np.ndarray) -> np.ndarray:
    """sY_lm(theta, 0), zero for l below |m| or |s|."""
    return spin_legendre(s, m, l, theta)[-1] if l >= abs(m) else np.zeros_like(theta)


def spin_closed(rings: str, lmax: int, spin: int, dialect: str = SPARK) -> str:
    """The table of spin_table by the finite sum, for lmax up to 10."""
    f = lambda x: f"cast(factorial(cast({x} as int)) as double)"

    def values(s: int) -> str:
        n = -s
        terms = f"select ring_id, z, l, m, k from {rings} _r {each(0, lmax, 'l', dialect)} {each(0, 'l', 'm', dialect)} {each(0, '2 * l', 'k', dialect)}"
        own = f"select * from ({terms}) _t where l >= {abs(s)} and l + {n} - k >= 0 and l - k - m >= 0 and k - {n} + m >= 0"
        half = lambda p, x: f"power(sqrt((1 {x} z) / 2), {p})"
        term = f"(case when {g.mod(f'k + m - {n}', 2)} = 0 then 1 else -1 end) * {half(f'2 * l - 2 * k + {n} - m', '+')} * {half(f'2 * k - {n} + m', '-')} / ({f(f'l + {n} - k')} * {f('k')} * {f('l - k - m')} * {f(f'k - {n} + m')})"
        norm = f"{(-1) ** s} * sqrt((2 * l + 1) / (4 * {g.PI}) * {f('l + m')} * {f('l - m')} * {f(f'l + {n}')} * {f(f'l - {n}')})".replace("- -", "+ ").replace("+ -", "- ")
        text = f"(select ring_id, l, m, {norm} * sum({term}) as y from ({own}) _o group by ring_id, z, l, m)"
        return text.replace("- -", "+ ").replace("+ -", "- ")

    zeros = f"select ring_id, l, m, 0.0e0 as yp, 0.0e0 as ym from {rings} _r {each(0, spin - 1, 'l', dialect)} {each(0, 'l', 'm', dialect)} union all" if spin else ""
    return f"({zeros} select a.ring_id, a.l, a.m, a.y as yp, b.y as ym from {values(spin)} a join {values(-spin)} b on a.ring_id = b.ring_id and a.l = b.l and a.m = b.m)"


def spin_table(rings: DataFrame, lmax: int, spin: int) -> DataFrame:
    """Rows (ring_id, l, m, yp, ym) for +spin and -spin. Spins 0, 1 and 2."""
    if spin not in (0, 1, 2):
        raise ValueError("spin must be 0, 1 or 2")

    def table(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, z, ms = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for m in np.unique(ms):
                own = ms == m
                theta = np.arccos(z[own])
                yp, ym = (spin_legendre(x, int(m), lmax, theta) for x in (spin, -spin))
                l = np.repeat(np.arange(m, lmax + 1), own.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids[own], len(yp))), pa.array(l), pa.array(np.full(yp.size, m)), pa.array(yp.ravel()), pa.array(ym.ravel())], ["ring_id", "l", "m", "yp", "ym"])

    spark = ship(rings.sparkSession)
    keyed = rings.select("ring_id", "z").crossJoin(spark.range(lmax + 1).withColumnRenamed("id", "m"))
    return keyed.repartition(max(1, lmax + 1), "m").mapInArrow(table, "ring_id long, l long, m long, yp double, ym double")


def map2alm_spin(samples: str, table: str, lmax: int, spin: int, weight: str = "1.0e0", dialect: str = SPARK) -> str:
    """map_id, l, m, e_re, e_im, b_re, b_im from samples (map_id, ring_id, phi, q, u): E = -(a+ + (-1)^s a-)/2, B = -(a+ - (-1)^s a-)/2i."""
    fq, fu = ring_dft(samples, lmax, dialect, value="q", weight=weight), ring_dft(samples, lmax, dialect, value="u", weight=weight)
    joined = f"select q.map_id, q.ring_id, q.m, q.re - u.im as pr, q.im + u.re as pi, q.re + u.im as mr, q.im - u.re as mi from {fq} q join {fu} u on q.map_id = u.map_id and q.ring_id = u.ring_id and q.m = u.m"
    sign = -1 if spin % 2 else 1
    sums = f"select f.map_id, y.l, y.m, sum(f.pr * y.yp) as pr, sum(f.pi * y.yp) as pi, {sign} * sum(f.mr * y.ym) as mr, {sign} * sum(f.mi * y.ym) as mi from ({joined}) f join {table} y on f.ring_id = y.ring_id and f.m = y.m group by f.map_id, y.l, y.m"
    return f"(select map_id, l, m, -(pr + mr) / 2 as e_re, -(pi + mi) / 2 as e_im, -(pi - mi) / 2 as b_re, (pr - mr) / 2 as b_im from ({sums}) _a)"


def alm2map_spin(alm: str, table: str, points: str, spin: int) -> str:
    """map_id, cell_id, q, u: the inverse algebra, a+ = -(E + iB), a- = -(-1)^s (E - iB); both real maps take the conjugate half."""
    sign = -1 if spin % 2 else 1
    rings = (
        "select a.map_id, y.ring_id, a.m, sum(-(a.e_re - a.b_im) * y.yp) as pr, sum(-(a.e_im + a.b_re) * y.yp) as pi,"
        f" sum(-({sign}) * (a.e_re + a.b_im) * y.ym) as mr, sum(-({sign}) * (a.e_im - a.b_re) * y.ym) as mi from {alm} a join {table} y on a.l = y.l and a.m = y.m group by a.map_id, y.ring_id, a.m"
    )
    factor, c, s = "(case when r.m = 0 then 1 else 2 end)", "cos(r.m * p.phi)", "sin(r.m * p.phi)"
    q = f"{factor} * ((r.pr + r.mr) / 2 * {c} - (r.pi + r.mi) / 2 * {s})"
    u = f"{factor} * ((r.pi - r.mi) / 2 * {c} + (r.pr - r.mr) / 2 * {s})"
    return f"(select r.map_id, p.cell_id, sum({q}) as q, sum({u}) as u from ({rings}) r join {points} p on r.ring_id = p.ring_id group by r.map_id, p.cell_id)"


def spin_spectra(alm: str) -> str:
    """map_id, spectrum (EE, BB, EB), l, cl."""
    kinds = (("EE", "e_re * e_re + e_im * e_im"), ("BB", "b_re * b_re + b_im * b_im"), ("EB", "e_re * b_re + e_im * b_im"))
    return "(" + " union all ".join(f"select map_id, '{k}' as spectrum, l, sum((case when m = 0 then 1 else 2 end) * ({x})) / (2 * l + 1) as cl from {alm} _a group by map_id, l" for k, x in kinds) + ")"


def ring_fft(samples: DataFrame, mmax: int) -> DataFrame:
    """map_id, ring_id, m, re, im as of ring_dft, one group for each ring: a fast transform where the ring's longitudes are even around the circle, the direct sum elsewhere."""

    def transform(table: pa.Table) -> pa.Table:
        phi, value = (table.column(c).to_numpy() for c in ("phi", "value"))
        order = np.argsort(phi, kind="stable")
        phi, value, n, m = phi[order], value[order], len(phi), np.arange(mmax + 1)
        if n > 1 and np.ptp(np.diff(phi)) < 1e-10 and abs(phi[1] - phi[0] - 2 * np.pi / n) < 1e-10:
            f = np.fft.fft(value)[m % n] * np.exp(-1j * m * phi[0])
        else:
            f = np.exp(-1j * np.outer(m, phi)) @ value
        same = lambda c: pa.array(np.full(mmax + 1, table.column(c)[0].as_py()))
        return pa.table({"map_id": same("map_id"), "ring_id": same("ring_id"), "m": pa.array(m), "re": pa.array(f.real), "im": pa.array(f.imag)})

    ship(samples.sparkSession)
    return samples.select("map_id", "ring_id", "phi", "value").groupBy("map_id", "ring_id").applyInArrow(transform, "map_id long, ring_id long, m long, re double, im double")


def ring_synthesis(modes: DataFrame, rings: DataFrame) -> DataFrame:
    """map_id, cell_id, value of RING cells from their rings' modes (map_id, ring_id, m, re, im), m >= 0, of a real map, one inverse transform for each ring (ring_id, n_r, phi0, start); modes beyond the ring's cells fold onto those they can't be told from."""

    def transform(table: pa.Table) -> pa.Table:
        m, n = table.column("m").to_numpy(), table.column("n_r")[0].as_py()
        c = (table.column("re").to_numpy() + 1j * table.column("im").to_numpy()) * np.exp(1j * m * table.column("phi0")[0].as_py())
        folded = np.zeros(n, complex)
        np.add.at(folded, m % n, c)
        np.add.at(folded, -m[m > 0] % n, c[m > 0].conj())
        value = np.fft.ifft(folded).real * n
        return pa.table({"map_id": pa.array(np.full(n, table.column("map_id")[0].as_py())), "cell_id": pa.array(table.column("start")[0].as_py() + np.arange(n)), "value": pa.array(value)})

    ship(modes.sparkSession)
    return modes.join(rings, "ring_id").groupBy("map_id", "ring_id").applyInArrow(transform, "map_id long, cell_id long, value double")
