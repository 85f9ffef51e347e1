"""The engine's texts against brute force and known values; most run in DuckDB, whose text differs from Spark's in a few words only."""

import duckdb
import numpy as np
import pytest

from spheric.functions import geometry as g
from spheric.operators import convolve as cv
from spheric.operators import grid, multires, quadrature
from spheric.operators import harmonics as h
from spheric.operators import interpolate as ip
from spheric.operators import morphology as mo
from spheric.operators import spectra as sp
from spheric.plans.sql import DUCK

db = duckdb.connect()


def rows(text):
    return db.sql(f"select * from {text} _q").df()


def complete(nside):
    return rows(grid.cells(nside)).sort_values("cell_id")


@pytest.mark.parametrize("nside", [1, 2, 4, 8])
def test_ids_round_trip(nside):
    n = 12 * nside * nside
    nest = rows(g.with_ring_cell(grid.numbers(0, n - 1, "cell_id"), "cell_id", nside))
    assert sorted(nest.ring_cell) == list(range(n))
    at = rows(g.located(grid.cells(nside), "cell_id", "z", "phi", nside))
    assert (at.cell_id == at.ring_cell).all()
    ring = dict(zip(nest.cell_id, nest.ring_cell, strict=True))
    assert all(ring[a] == b for a, b in zip(at.nest_cell, at.cell_id, strict=True))


@pytest.mark.parametrize("nside", [2, 4])
def test_twenty_four_cells_have_seven_neighbours(nside):
    counts = rows(grid.neighbours(nside)).groupby("cell_id").size()
    assert (counts == 7).sum() == 24 and (counts == 8).sum() == 12 * nside**2 - 24


def test_disc_is_brute_force():
    c = complete(8)
    rng = np.random.default_rng(0)
    theta, phi = np.append(np.arccos(rng.uniform(-1, 1, 20)), [0.0, np.pi]), np.append(rng.uniform(0, 2 * np.pi, 20), [0, 0])
    values = ", ".join(f"({i}, {t!r}, {p!r})" for i, (t, p) in enumerate(zip(theta.tolist(), phi.tolist(), strict=True)))
    found = rows(grid.disc(f"(select * from (values {values}) v(id, theta, phi))", 8, "0.3e0", DUCK))
    for i, (t, p) in enumerate(zip(theta, phi, strict=True)):
        dot = np.cos(t) * c.z + np.sin(t) * np.sqrt(1 - c.z**2) * np.cos(c.phi - p)
        assert set(found[found.id == i].cell_id) == set(c.cell_id[np.arccos(np.clip(dot, -1, 1)) <= 0.3])


def test_ellipsoid_round_trip():
    a = db.sql(f"select max(abs(x - {g.geodetic(g.authalic('x'))})) from (select radians(range) x from range(-89, 90))").fetchall()[0][0]
    assert a < 1e-9
    assert db.sql(f"select degrees({g.authalic('radians(45)')}) - 45").fetchall()[0][0] == pytest.approx(-0.1283, abs=1e-4)
    with pytest.raises(ValueError):
        g.to_theta_phi("a", "b", "degrees")
    with pytest.raises(ValueError):
        g.check_nside(3)


def test_weights_sum_to_the_sphere():
    pts = f"(select cell_id as sample_id, degrees(asin(z)) as lat, degrees(phi) as lon from {grid.cells(8)} _c)"
    ringed = quadrature.build_rings(pts)
    assert rows(quadrature.sample_weights(ringed, "equal_area")).w.sum() == pytest.approx(4 * np.pi)
    assert rows(quadrature.sample_weights(ringed, "gauss_legendre", 31)).w.sum() == pytest.approx(4 * np.pi)
    assert rows(quadrature.sample_weights(ringed, "trapeze")).w.sum() == pytest.approx(4 * np.pi, rel=0.01)
    with pytest.raises(ValueError):
        quadrature.sample_weights(ringed, "simpson")


def test_irregular_longitudes_sum_to_a_circle():
    pts = "(select i as sample_id, 10.0e0 as lat, lon from (values (0, 0.0e0), (1, 5.0e0), (2, 100.0e0), (3, 359.0e0)) v(i, lon))"
    w = rows(quadrature.sample_weights(quadrature.build_rings(pts), "trapeze")).w.sum()
    assert w == pytest.approx(2 * np.pi * np.pi * np.cos(np.radians(10)))


def test_legendre_recurrence_is_the_closed_sum_and_holds_far_up():
    z = np.cos(rows(grid.rings(4)).theta.to_numpy())
    closed = rows(h.legendre_closed(grid.rings(4), 8, DUCK))
    theta = rows(grid.rings(4)).sort_values("ring_id").theta.to_numpy()
    for m in range(9):
        y = h.legendre(np.cos(theta), m, 8)
        for l in range(m, 9):
            want = closed[(closed.l == l) & (closed.m == m)].sort_values("ring_id").y.to_numpy()
            assert np.allclose(y[l - m], want, atol=1e-12)
    x, w = np.polynomial.legendre.leggauss(600)
    for m in (0, 1, 250, 500):
        y = h.legendre(x, m, 512)
        assert np.allclose(2 * np.pi * (y * w) @ y.T, np.eye(len(y)), atol=1e-9)
    assert len(z)


def test_one_harmonic_comes_back_alone():
    x, _ = np.polynomial.legendre.leggauss(8)
    values = ", ".join(f"({r + 1}, {z!r})" for r, z in enumerate(x.tolist()))
    ringed = f"(select ring_id, z from (values {values}) v(ring_id, z))"
    plm = h.legendre_closed(ringed, 5, DUCK)
    y = h.legendre(x, 2, 3)[1]
    _, w = np.polynomial.legendre.leggauss(8)
    smp = ", ".join(f"(0, {r + 1}, {2 * np.pi * k / 16!r}, {2 * y[r] * np.cos(2 * 2 * np.pi * k / 16)!r}, {w[r] * 2 * np.pi / 16!r})" for r in range(8) for k in range(16))
    smp = smp.replace("np.float64(", "(")
    alm = rows(h.map2alm(f"(select * from (values {smp}) v(map_id, ring_id, phi, value, wt))", plm, 5, DUCK, "wt")).round(9)
    own = alm[(alm.l == 3) & (alm.m == 2)]
    assert own.re.item() == pytest.approx(1) and alm.drop(own.index)[["re", "im"]].abs().to_numpy().max() < 1e-9


@pytest.mark.parametrize("spin", [0, 1, 2])
def test_spin_harmonics_are_orthonormal(spin):
    x, w = np.polynomial.legendre.leggauss(16)
    for m in range(4):
        y = np.array([h.wigner_y(spin, l, m, np.arccos(x)) for l in range(max(m, spin), 7)])
        assert np.allclose(2 * np.pi * (y * w) @ y.T, np.eye(len(y)), atol=1e-12)
    assert not h.wigner_y(2, 1, 0, np.arccos(x)).any()


@pytest.mark.parametrize("spin", [0, 1, 2, -1, -2])
def test_spin_harmonics_are_orthonormal_up_to_191(spin):
    x, w = np.polynomial.legendre.leggauss(192)
    for m in (0, 1, 2, 3, 60, 130, 191):
        y = h.spin_legendre(spin, m, 191, np.arccos(x))[max(0, abs(spin) - m) :]
        assert np.allclose(2 * np.pi * (y * w) @ y.T, np.eye(len(y)), atol=1e-10)
        if spin == 0:
            assert np.allclose(y, h.legendre(x, m, 191), atol=1e-10)


def test_smoothing_keeps_constants():
    for norm, want in (("l1", 1.0), ("none", None)):
        s = rows(multires.smooth_stencil(4, norm=norm, dialect=DUCK))
        if want:
            assert np.allclose(s.groupby("out_id").w.sum(), want)
    up = rows(multires.transposed(multires.smooth_stencil(4, dialect=DUCK), "col_l1"))
    assert np.allclose(up.groupby("out_id").w.sum(), 1)
    with pytest.raises(ValueError):
        multires.smooth_stencil(4, norm="l3")


def test_interpolation_weights():
    pts = "(select range as pt, (range * 37 % 360)::double as lon, (range * 7 % 178 - 89)::double as lat from range(200))"
    w = rows(ip.weights(pts, 4))
    assert (w.w >= 0).all() and np.allclose(w.groupby("pt").w.sum(), 1) and (w.groupby("pt").size() == 4).all()


def test_fft_and_bins_are_numpy():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(7, 9)), rng.normal(size=(7, 9))
    text = lambda x: "(select 0 as img_id, * from (values " + ", ".join(f"({i}, {j}, {float(v)!r})" for (i, j), v in np.ndenumerate(x)) + ") v(row, col, value))"
    f = rows(sp.fft2(text(a), 7, 9, DUCK)).sort_values(["ky", "kx"])
    assert np.allclose((f.re + 1j * f.im).to_numpy().reshape(7, 9), np.fft.fft2(a))
    kept = rows(sp.radial_bins(7, 9))
    assert len(kept) == 63 - 4 and len(rows(sp.radial_bins(8, 8))) == 63
    fr = np.hypot(np.fft.fftfreq(7)[:, None], np.fft.fftfreq(9)[None, :])
    bins = np.digitize(fr, np.linspace(0, fr.max(), 4)) - 1
    p = np.abs(np.fft.fft2(a) * np.conj(np.fft.fft2(b)))
    got = rows(sp.power(text(a), 7, 9, other=text(b), dialect=DUCK)).sort_values("bin").pk.to_numpy()
    assert np.allclose(got, [p[bins == i].mean() / 63 for i in range(3)])


def test_minkowski_of_plain_images():
    img = lambda v: f"(select 0 as img_id, i as row, j as col, {v} as value from range(8) a(i), range(8) b(j))"
    t = "(select 0.5e0 as threshold)"
    ones = rows(mo.functionals(img("1e6"), t, 8)).iloc[0]
    assert (ones.w0, ones.w1) == (1, 0) and ones.w2 == pytest.approx(1 / 64)
    zeros = rows(mo.functionals(img("-10.0e0"), t, 8)).iloc[0]
    assert abs(zeros[["w0", "w1", "w2"]]).max() < 1e-12


def test_gauges():
    assert cv.singularities("projected_ref", ((0.0, 0.0, 1.0),))[0][1] == pytest.approx(90)
    with pytest.raises(ValueError):
        cv.gauge_angle("other")
    s = rows(cv.stencil(2, 3, 1, "phi"))
    assert np.allclose(s.groupby(["out_id", "p"]).w.sum(), 1)


def test_rectangle_rows_are_full():
    r = rows(ip.rectangle(8, 20, -10, 60, 50, DUCK))
    assert r.groupby("row").size().nunique() == 1 and not r[["row", "col"]].duplicated().any()


def test_triangulation_is_exact_on_planes():
    from spheric.operators.resample import linear, triangulate

    rng = np.random.default_rng(5)
    p = rng.uniform(size=(80, 2))
    t = triangulate(p)
    area = sum(abs(np.linalg.det(np.column_stack([p[b] - p[a], p[c] - p[a]]))) / 2 for a, b, c in t)
    assert 0.8 < area <= 1
    inside = rng.uniform(0.3, 0.7, (50, 2))
    assert np.allclose(linear(p, 3 * p[:, 0] - 2 * p[:, 1] + 1, inside), 3 * inside[:, 0] - 2 * inside[:, 1] + 1)
    far = linear(p, p[:, 0], np.array([[9.0, 9.0]]))
    assert far[0] == pytest.approx(p[:, 0].mean())


def test_cubic_resampling_is_smooth_and_follows_curves():
    from spheric.operators.resample import CORNERS, cubic, linear, slopes, triangulate

    rng = np.random.default_rng(5)
    p = rng.uniform(size=(300, 2))
    f = lambda x: np.sin(4 * x[:, 0]) * np.cos(3 * x[:, 1])
    q = rng.uniform(0.2, 0.8, (500, 2))
    plane = lambda x: 3 * x[:, 0] - 2 * x[:, 1] + 1
    assert np.allclose(cubic(p, plane(p), q), plane(q)) and np.allclose(cubic(p, f(p), p), f(p))
    assert abs(cubic(p, f(p), q) - f(q)).max() < abs(linear(p, f(p), q) - f(q)).max() / 3
    # no kinks across edges: the steps of the slope along a line shrink with the steps of the line
    kink = []
    for n in (20001, 80001):
        x = np.linspace(0.3, 0.7, n)
        kink.append(abs(np.diff(np.diff(cubic(p, f(p), np.column_stack([x, 0.4 + 0.3 * x]))) / np.diff(x))).max())
    assert kink[1] < kink[0] / 3
    t = triangulate(p)
    i, j = np.unique(np.sort(t[:, CORNERS].reshape(-1, 2), 1), axis=0).T
    d, rise = p[j] - p[i], f(p)[j] - f(p)[i]

    def bend(g):
        a, b = (g[i] * d).sum(1), (g[j] * d).sum(1)
        return ((a * a + a * b + b * b - 3 * rise * (a + b)) * (d * d).sum(1) ** -1.5).sum()

    g = slopes(p, f(p), t)
    assert all(bend(g + 1e-3 * rng.normal(size=g.shape)) > bend(g) for _ in range(10))


@pytest.mark.parametrize("method", ["linear", "cubic"])
def test_resampling_of_few_or_lined_up_points_gives_the_mean(method):
    from spheric.operators.resample import interpolated

    for p in ([[0.0, 0.0]], [[0.0, 0.0], [1.0, 1.0]], [[0.0, 0.0], [0.0, 0.0], [1.0, 1.0], [2.0, 2.0]]):
        p = np.array(p)
        v = np.arange(len(p), dtype=float)
        assert np.allclose(interpolated(p, v, np.array([[0.2, 0.9], [0.5, 0.5]]), method), v.mean())


@pytest.mark.parametrize("euler,want", [("triangles", (192 - 4) / 192), ("cliques", 2 / 192)])
def test_euler_number_of_the_sphere(euler, want):
    sky = "(select 0 as map_id, range as cell_id, 1e6 as value from range(192))"
    assert rows(mo.sphere_functionals(sky, "(select 0.5e0 as threshold)", 4, euler=euler)).w2.item() == pytest.approx(want)


def test_phase_shift():
    assert db.sql("select " + ", ".join(sp.phase_shift("0.25e0", "1.0e0"))).fetchall()[0] == pytest.approx((0, 1))


def test_boxes_are_brute_force():
    c = complete(8)
    lon, lat = np.degrees(c.phi % (2 * np.pi)), np.degrees(np.arcsin(c.z))
    for w, s, e, n in ((20, -10, 50, 35), (300, -90, 40, -50), (0, 60, 360, 90), (-20, 0, 400, 5), (359.9, -5, 0.1, 5)):
        want = set(c.cell_id[(lat >= s) & (lat <= n) & (((lon >= w) & (lon <= e)) if w <= e else ((lon >= w) | (lon <= e)))])
        assert set(rows(grid.box(8, w, s, e, n, DUCK)).cell_id) == want
    assert len(rows(grid.box(8, 0, -90, 360, 90, DUCK, "WGS84"))) == 768


def test_rings_of_scattered_samples():
    rng = np.random.default_rng(3)
    lat = np.concatenate([np.repeat(rng.uniform(-80, 80, 40), 5), [89.0, -89.0], 12 + 1e-9 * np.arange(4)])
    values = ", ".join(f"({i}, {x!r}, {float(i)!r})" for i, x in enumerate(lat.tolist()))
    got = rows(quadrature.build_rings(f"(select * from (values {values}) v(sample_id, lat, lon))", atol=1e-8)).sort_values("sample_id")
    theta = np.pi / 2 - np.radians(lat)
    order = np.argsort(theta, kind="stable")
    want = np.empty(len(lat), int)
    want[order] = 1 + np.cumsum(np.concatenate([[0], np.diff(theta[order]) > 1e-8]))
    assert (got.ring_id.to_numpy() == want).all()


def test_inverse_transform_and_unwrapping():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(5, 6))
    text = "(select 0 as img_id, * from (values " + ", ".join(f"({i}, {j}, {float(v)!r})" for (i, j), v in np.ndenumerate(a)) + ") v(row, col, value))"
    back = rows(sp.ifft2(sp.fft2(text, 5, 6, DUCK), 5, 6, DUCK)).sort_values(["row", "col"])
    assert np.allclose(back.value.to_numpy().reshape(5, 6), a)
    lon = [350.0, 355, 0, 5, 10, 352, 357, 2, 7, 12]
    smp = ", ".join(f"(0, {i}, {i // 5}.0, {x!r}, {float(i)!r})" for i, x in enumerate(lon))
    smp = f"(select * from (values {smp}) v(img_id, sample_id, lat, lon, value))"
    un = rows(sp.unwrapped(smp)).sort_values("sample_id").lon.to_numpy().reshape(2, 5)
    assert np.allclose(np.diff(un, axis=1), 5)
    img = rows(sp.lonlat_image(smp)).sort_values(["row", "col"]).value.to_numpy()
    assert (img == np.arange(10)).all()


def test_flat_index_counts_modes():
    m = rows(h.flat_modes(7, DUCK)).sort_values("i")
    assert list(m.i) == list(range(36)) and list(zip(m.m, m.l, strict=True)) == [(a, b) for a in range(8) for b in range(a, 8)]


def test_spin_sums_are_the_recurrence():
    theta = rows(grid.rings(2)).sort_values("ring_id").theta.to_numpy()
    for s in (0, 1, 2):
        t = rows(h.spin_closed(grid.rings(2), 4, s, DUCK)).sort_values("ring_id")
        for (l, m), own in t.groupby(["l", "m"]):
            assert np.allclose(own.yp, h.wigner_y(s, l, m, theta), atol=1e-12) and np.allclose(own.ym, h.wigner_y(-s, l, m, theta), atol=1e-12)


def test_vectors_and_fallbacks():
    x, y, z = g.to_vector("200.0e0", "-35.0e0")
    assert db.sql("select " + ", ".join(g.from_vector(x, y, z))).fetchall()[0] == pytest.approx((200, -35))
    sky = "(select * from (values (0, 4, 9.0), (0, 5, 1.0), (0, 8, 2.0), (0, 9, 3.0), (0, 10, 4.0), (0, 11, 5.0)) v(map_id, cell_id, value))"
    assert dict(rows(multires.maxpool(sky, "first_cell"))[["cell_id", "value"]].values.tolist()) == {1: 9, 2: 5}
    k = rows(cv.initial_kernel(2, 3, 4, 9, 1))
    assert len(k) == 216 and k.w.nunique() > 200 and k.w.abs().max() <= (6 / 36) ** 0.5 and abs(k.w.mean()) < 0.05
    with pytest.raises(ValueError):
        cv.check_refs("two_ref", ((1.0, 0.0, 0.0),))
    assert cv.singularities("projected_ref", (cv.direction(30, 40),))[0] == pytest.approx((30, 40))
