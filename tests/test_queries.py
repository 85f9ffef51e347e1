"""Every registered query with a twin against it through Spark; transforms, tables and streams."""

import os

import duckdb
import numpy as np
import pytest

from spheric import queries
from spheric.operators import convolve, grid, interpolate, quadrature
from spheric.operators import harmonics as h
from spheric.operators.transform import Transform
from spheric.sources import adapters as ad

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    held = duckdb.connect()
    for f in os.listdir(SF):
        held.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return held


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_twin(spark, db, name):
    df, want = queries.QUERIES[name](spark, SF), db.sql(queries.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    got, twin = (sorted(map(str, rows)) for rows in (map(tuple, df.select(*columns).collect()), want.select(*columns).fetchall()))
    assert got == twin


def test_a_turned_field_swaps_e_and_b(spark):
    spectra = {(r.spectrum, r.l): r.cl for r in queries.QUERIES["spin_spectra"](spark, SF).collect()}
    assert all(v >= 0 for (k, _), v in spectra.items() if k != "EB") and spectra["EE", 0] == spectra["BB", 1] == 0


def test_spin_spectra_are_finite_at_nside_32(spark):
    spectra = {(r.spectrum, r.l): r.cl for r in queries.QUERIES["spin_spectra_32"](spark, SF).collect()}
    assert len(spectra) == 3 * 96 and all(0 <= v < 1e3 for (k, _), v in spectra.items() if k != "EB")


def test_fast_transforms_are_the_direct_sums(spark):
    t = Transform(spark, 8)
    sky = queries.frames(spark, SF, f"select * from {ad.sky('@lineitem@', 8)} _s")
    alm = t.map2alm(sky)
    table = spark.sql(f"select * from {ad.samples('{sky}', 8)} _s", sky=sky)
    direct = spark.sql(f"select * from {h.map2alm('{smp}', '{plm}', 23, weight=f'(4 * pi() / 768)')} _a", smp=table, plm=t.plm)
    key = lambda df: {(r.l, r.m): complex(r.re, r.im) for r in df.collect()}
    fast, slow = key(alm), key(direct)
    assert fast.keys() == slow.keys() and max(abs(fast[k] - slow[k]) for k in slow) < 1e-9
    back = {r.cell_id: r.value for r in t.alm2map(alm).collect()}
    want = {r.cell_id: r.value for r in spark.sql(f"select * from {h.alm2map('{a}', '{plm}', grid.cells(8))} _m", a=alm, plm=t.plm).collect()}
    assert back.keys() == want.keys() and max(abs(back[k] - want[k]) for k in want) < 1e-9
    assert "nside=8" in repr(t) and "lmax=23" in repr(t)
    with pytest.raises(ValueError):
        t.map2alm(sky.union(sky))


def test_a_patch_has_the_spectrum_of_the_masked_sky(spark):
    rng, n = np.random.default_rng(42), 12 * 16 * 16
    value = rng.normal(size=n)
    cells = spark.sql(f"select * from {grid.cells(16)} _c").toPandas().sort_values("cell_id")
    dot = np.cos(np.pi / 2.5) * cells.z + np.sin(np.pi / 2.5) * np.sqrt(1 - cells.z**2) * np.cos(cells.phi - np.pi / 3)
    inside = np.arccos(np.clip(dot, -1, 1)).to_numpy() < np.radians(20)
    rows = lambda keep, v: spark.createDataFrame([(0, int(i), float(v[i])) for i in np.flatnonzero(keep)], "map_id long, cell_id long, value double")
    t = Transform(spark, 16)
    patch = {r.l: r.cl for r in t.anafast(rows(inside, value)).collect()}
    whole = {r.l: r.cl for r in t.anafast(rows(np.ones(n, bool), value * inside)).collect()}
    assert max(abs(patch[l] / whole[l] - 1) for l in range(2, 48)) < 1e-4


@pytest.mark.parametrize("nside", [1, 2, 8])
def test_neighbours_of_some_cells(spark, nside):
    ids = spark.range(12 * nside * nside).withColumnRenamed("id", "cell_id")
    some = {(r.cell_id, r.other) for r in grid.neighbours_of(ids.where("cell_id % 3 = 0"), nside).collect()}
    assert some == {(r.cell_id, r.other) for r in spark.sql(f"select * from {grid.neighbours(nside)} _n where cell_id % 3 = 0").collect()}


@pytest.mark.parametrize("spread", [1.0, 0.01])
def test_nearest_samples_are_brute_force(spark, spread):
    """Samples all over, and in two small heaps with wide empty space between; some repeat a place, some have none."""
    rng = np.random.default_rng(11)
    at = np.vstack([rng.normal([-20, 10], 20 * spread, (150, 2)), rng.normal([40, 70], 20 * spread, (150, 2))])
    at[7] = at[150] = at[3]
    rows = [(i, float(a), float(o), float(i)) for i, (a, o) in enumerate(at)]
    samples = spark.createDataFrame([*rows, (900, None, 1.0, 1.0)], "id long, lat double, lon double, value double")
    got = {(r.row, r.col): r.value for r in spark.sql(f"select * from {interpolate.resample_nearest('{s}', 9, 14)} _r", s=samples).collect()}
    grid_lat, grid_lon = np.linspace(at[:, 0].min(), at[:, 0].max(), 9), np.linspace(at[:, 1].min(), at[:, 1].max(), 14)
    d = lambda i, j: np.round((at[:, 0] - grid_lat[i]) ** 2 + (at[:, 1] - grid_lon[j]) ** 2, 9)
    assert got == {(i, j): float(d(i, j).argmin()) for i in range(9) for j in range(14)}
    assert not spark.sql(f"select * from {interpolate.resample_nearest('{s}', 9, 14)} _r", s=samples.limit(0)).collect()


@pytest.mark.parametrize("method", ["linear", "cubic"])
def test_resampling_takes_maps_apart(spark, method):
    from spheric.operators.resample import resample

    samples = spark.sql("select m.id as map_id, p.id % 9 * 1.0D as lat, (p.id * 7) % 11 * 1.0D as lon, m.id + p.id % 9 * 2.0D as value from range(2) m cross join range(99) p union all select 0, null, 1.0D, 1.0D")
    got = resample(samples, 9, 5, method).collect()
    assert len(got) == 90 and all(abs(r.value - (r.map_id + 2 * r.row)) < 1e-6 for r in got)
    with pytest.raises(ValueError):
        resample(samples, 9, 5, "quintic")


def test_kernels_stencils_and_nodes_are_checked(spark, tmp_path):
    kernel = spark.sql(f"select * from {convolve.initial_kernel(1, 2, 2, 9)} _k")
    assert convolve.check_kernel(kernel, 1, 2, 2, 9) is kernel
    for wrong in (kernel.where("p < 8"), kernel.union(kernel), kernel.selectExpr("g", "c", "o", "p + 1 as p", "w")):
        with pytest.raises(ValueError):
            convolve.check_kernel(wrong, 1, 2, 2, 9)
    folder = f"file://{tmp_path}/kept"
    first = convolve.stored_stencil(spark, folder, 2)
    assert len(os.listdir(tmp_path / "kept")) == 1 and convolve.stored_stencil(spark, folder, 2).count() == first.count() == convolve.stored_stencil(spark, None, 2).count()
    theta = np.arccos(np.polynomial.legendre.leggauss(4)[0]).tolist()
    rings = lambda t: spark.createDataFrame(list(enumerate(t)), "ring_id long, ring_theta double")
    quadrature.check_nodes(rings(theta), 4)
    with pytest.warns(UserWarning):
        quadrature.check_nodes(rings([x + 0.01 for x in theta]), 4)
    with pytest.raises(ValueError):
        quadrature.check_nodes(rings(theta), 5)


def test_windowed_sky_streams(spark, tmp_path):
    from spheric.streaming.sky import windowed_sky

    spark.sql("select timestamp'2024-01-01 01:00:00' as ts, 3L as cell_id, 2.0D as value union all select timestamp'2024-01-01 02:00:00', 3L, 4.0D").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, cell_id long, value double").parquet(str(tmp_path / "in"))
    q = windowed_sky(stream).writeStream.outputMode("complete").format("memory").queryName("sky_out").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.cell_id, r.n, r.value) for r in spark.table("sky_out").collect()] == [(3, 2, 3.0)]
