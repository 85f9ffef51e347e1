"""The registered queries: each operator on maps, samples or images made from the driver's tables, and its twin.

A query's text is a function of the dialect and of the names that stand for its tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spheric.functions import geometry as g
from spheric.operators import convolve as cv
from spheric.operators import grid
from spheric.operators import harmonics as h
from spheric.operators import interpolate as ip
from spheric.operators import morphology as mo
from spheric.operators import multires as mr
from spheric.operators import quadrature as qd
from spheric.operators import resample as rs
from spheric.operators import spectra as sp
from spheric.operators.transform import Transform
from spheric.plans.sql import DUCK, SPARK, rounded
from spheric.sources import adapters as ad
from spheric.sources.geometry_store import geometry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLE = re.compile(r"@(\w+?)@")
#: Geometry by name: tables that plans read from the store, instead of working them out in place.
GEOMETRY: dict[str, str] = {}
for _n in (2, 4, 8):
    GEOMETRY[f"neighbours_{_n}"] = grid.neighbours(_n)
    GEOMETRY[f"cells_{_n}"] = mr.nest_cells(_n)
PLM = re.compile(r"plm_(\d+)_(\d+)")


def geometry_table(spark: SparkSession, name: str) -> DataFrame:
    """plm_<nside>_<lmax>: Legendre values by recurrence. Else the text of that name, which may name others."""
    if found := PLM.fullmatch(name):
        rings = grid.rings(int(found[1]))
        return geometry(spark, f"{name} {rings}", lambda: h.legendre_table(spark.sql(f"select ring_id, z from {rings} _r"), int(found[2])))
    text = named(GEOMETRY[name], but=name)
    return geometry(spark, text, lambda: with_tables(spark, f"select * from {text} _g", ""))


def named(text: str, but: str = "") -> str:
    """Text with what stands in GEOMETRY under its name."""
    for name, made in sorted(GEOMETRY.items(), key=lambda x: -len(x[1])):
        if name != but:
            text = text.replace(made, f"@{name}@")
    return text


def with_tables(spark: SparkSession, text: str, sf_dir: str) -> DataFrame:
    tables = {}
    for name in set(TABLE.findall(text)):
        known = name in GEOMETRY or PLM.fullmatch(name)
        tables[name] = geometry_table(spark, name) if known else spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(TABLE.sub(r"{\1}", text), **tables)


def frames(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs text whose tables stand as @name@."""
    return with_tables(spark, named(text), sf_dir)


def twin(text: str) -> str:
    text = re.sub(r"@plm_(\d+)_(\d+)@", lambda x: h.legendre_closed(grid.rings(int(x[1])), int(x[2]), DUCK), text)
    return TABLE.sub(r"\1", text)


def register(name: str, text: Callable[[str], str]) -> None:
    QUERIES[name] = lambda spark, sf_dir: frames(spark, sf_dir, text(SPARK))
    ORACLES[name] = twin(text(DUCK))


def select(columns: str, source: str) -> str:
    return f"select {columns} from {source} _q"


R = lambda *names: ", ".join(f"{rounded(n)} as {n}" for n in names)
LI, EV, EM, PA, OR = "@lineitem@", "@events@", "@embeddings@", "@part@", "@orders@"
N, L = 4, 4
SKY, SMP = ad.sky(LI, N), ad.samples(ad.sky(LI, N), N)
ALM = lambda d, sky=SMP, n=N, l=L: h.map2alm(sky, f"@plm_{n}_{l}@", l, d, f"(4 * {g.PI} / {12 * n * n})")
CELLS = grid.cells(N)
PTS = f"(select cell_id as sample_id, degrees(asin(z)) as lat, degrees(phi) as lon from {CELLS} _c)"
USERS = f"(select pt as sample_id, round(lat / 10) * 10 as lat, lon, value from {ad.event_points(EV)} _e)"
RINGED, RAGGED = qd.build_rings(PTS), qd.build_rings(USERS)
PARTIAL = f"(select map_id, cell_id, value from {SKY} _s where cell_id < 100)"

# Sources and geometry
register("sky_from_lineitem", lambda d: select(f"map_id, cell_id, {R('value')}", SKY))
register("ring_table", lambda d: select(f"ring_id, n_r, start, {R('z', 'theta', 'phi0')}", grid.rings(16)))
register("ring_pix2ang", lambda d: select(f"cell_id, ring_id, {R('z', 'phi')}", grid.cells(16)))
register("ring2nest", lambda d: select("cell_id, ring_cell", g.with_ring_cell(grid.numbers(0, 3071, "cell_id"), "cell_id", 16)))
register("ang2pix", lambda d: select("pt, ring_cell, nest_cell", g.located(f"(select pt, sin(radians(lat)) as z, radians(lon) as phi from {ad.event_points(EV)} _e)", "pt", "z", "phi", 64)))
register("authalic_lat", lambda d: f"select pt, {rounded('degrees(' + g.authalic('radians(lat)') + ')')} as authalic, {rounded('degrees(' + g.geodetic(g.authalic('radians(lat)')) + ')')} as back from {ad.event_points(EV)} _e")
register("haversine_pairs", lambda d: f"select a.pt as a, b.pt as b, {rounded(g.haversine('radians(a.lon)', 'radians(a.lat)', 'radians(b.lon)', 'radians(b.lat)'))} as angle from {ad.event_points(EV)} a join {ad.event_points(EV)} b on b.pt = a.pt + 1")
register("gnomonic", lambda d: f"select pt, {rounded(g.gnomonic('radians(lon)', 'radians(lat)', '0.5e0', '0.25e0')[0], 3)} as x, {rounded(g.gnomonic('radians(lon)', 'radians(lat)', '0.5e0', '0.25e0')[1], 3)} as y from {ad.event_points(EV)} _e where cos(radians(lat)) * cos(radians(lon) - 0.5e0) > 0.3e0")
VEC = f"(select pt, {', '.join(f'{v} as {n}' for n, v in zip('xyz', g.to_vector('lon', 'lat'), strict=True))} from {ad.event_points(EV)} _e)"
register("lonlat_vectors", lambda d: f"select pt, {R('x', 'y', 'z')}, {rounded(g.from_vector('x', 'y', 'z')[0])} as lon, {rounded(g.from_vector('x', 'y', 'z')[1])} as lat from {VEC} _v")
register("convention_convert", lambda d: " union all ".join(f"select pt, '{c}' as convention, {rounded(g.to_theta_phi('lat', 'lon', c)[0])} as theta, {rounded(g.to_theta_phi('lat', 'lon', c)[1])} as phi from {ad.event_points(EV)} _e" for c in g.CONVENTIONS))
DISCS = f"(select pt as id, {g.PI} / 2 - radians(lat) as theta, radians(lon) as phi from {ad.event_points(EV)} _e)"
register("query_disc", lambda d: select(f"id, cell_id, {R('angle')}", grid.disc(DISCS, 16, "0.2e0", d)))
register("bbox_cover", lambda d: select(f"cell_id, ring_id, {R('lon', 'lat')}", grid.box(16, 20, -10, 50, 35, d)))
register("neighbours8", lambda d: select("cell_id, other", grid.neighbours(8)))

# Rings and quadrature
register("build_rings", lambda d: select(f"sample_id, {R('theta', 'phi', 'ring_theta')}, ring_id, place", RAGGED))
register("ring_uniformity", lambda d: select(f"ring_id, n_r, uniform, {R('ring_theta')}", qd.uniformity(RAGGED)))
register("weights_equal_area", lambda d: select(f"sample_id, ring_id, {R('w')}", qd.sample_weights(RINGED, "equal_area")))
register("weights_uniform", lambda d: select(f"sample_id, ring_id, {rounded('w', 9)} as w", qd.sample_weights(RINGED, "uniform")))
register("weights_trapeze", lambda d: select(f"sample_id, ring_id, {R('w')}", qd.sample_weights(RINGED, "trapeze")))
register("weights_gauss_legendre", lambda d: select(f"sample_id, ring_id, {R('w')}", qd.sample_weights(RINGED, "gauss_legendre", 15)))
register("weights_irregular", lambda d: select(f"sample_id, ring_id, {R('w')}", qd.sample_weights(RAGGED, "trapeze")))
register("grid_summary", lambda d: select(f"n_total, n_rings, n_uniform, n_alm, {R('theta_min_deg', 'theta_max_deg', 'cost', 'n_r_mean')}, n_r_min, n_r_max", qd.grid_summary(RINGED)))

# Harmonics
register("legendre_table", lambda d: select(f"ring_id, l, m, {R('y')}", "@plm_8_8@"))
register("ring_dft", lambda d: select(f"ring_id, m, {R('re', 'im')}", h.ring_dft(SMP, 8, d)))
register("map2alm", lambda d: select(f"l, m, {R('re', 'im')}", ALM(d)))
register("alm2map", lambda d: select(f"cell_id, {R('value')}", h.alm2map(ALM(d), "@plm_4_4@", CELLS)))
register("anafast_auto", lambda d: select(f"l, {R('cl')}", h.spectrum(ALM(d))))
SKY2 = ad.samples(ad.sky(LI, N, value="avg(l_quantity)"), N)
register("anafast_cross", lambda d: select(f"l, {R('cl')}", h.spectrum(ALM(d), ALM(d, SKY2))))
BATCH = ad.samples(ad.sky(LI, N, key="cast(l_linenumber as bigint)"), N)
register("anafast_batch", lambda d: select(f"map_id, l, {R('cl')}", h.spectrum(ALM(d, BATCH))))
register("alm_filter_lowpass", lambda d: select(f"cell_id, {R('value')}", h.alm2map(h.filtered(ALM(d), 3), "@plm_4_4@", CELLS)))
register("regrid_latlon_to_grid", lambda d: select(f"cell_id, {R('value')}", h.alm2map(ALM(d), "@plm_8_4@", grid.cells(8))))
register("patch_pseudo_cl", lambda d: select(f"l, {R('cl')}", h.spectrum(ALM(d, ad.samples(PARTIAL, N)))))
register("alm_filter_weights", lambda d: select(f"l, m, {R('re', 'im')}", h.weighted(ALM(d), "(select l, 1.0e0 / (1 + l) as w from range(0, 4) as _f(l))")))
register("alm_index", lambda d: select("i, l, m", h.flat_modes(24, d)))
BINS = "(select l, cast(floor(l / 2) as bigint) as band, 0.5e0 as w from range(0, 5) as _r(l))"
register("bandpowers", lambda d: select(f"band, {R('power')}", h.bandpowers(h.spectrum(ALM(d)), BINS)))
register("flat_sky_cl", lambda d: select(f"l, {R('cl')}", sp.flat_sky(ad.samples(PARTIAL, N), N, 8, d)))

# Images
IMG = lambda d: ad.images(EM, d)
OTHER = lambda d: f"(select img_id - 1 as img_id, row, col, value from {IMG(d)} _o)"
register("row_shift", lambda d: select(f"img_id, row, col, {R('value')}", sp.row_shift(IMG(d), "(select row, row / 8.0e0 as s from range(0, 8) as _r(row))")))
register("radial_bins", lambda d: select(f"ky, kx, bin, {R('f_center')}", sp.radial_bins(7, 9)))
register("ps_auto", lambda d: select(f"img_id, bin, {R('f_center', 'pk')}", sp.power(IMG(d), 8, 8, dialect=d)))
register("ps_cross_abs", lambda d: select(f"img_id, bin, {R('f_center', 'pk')}", sp.power(IMG(d), 8, 8, other=OTHER(d), dialect=d)))
register("ps_cross_real", lambda d: select(f"img_id, bin, {R('f_center', 'pk')}", sp.power(IMG(d), 8, 8, other=OTHER(d), cross="real", dialect=d)))
# images as samples on parallels that cross the date line
LONLAT = lambda d: f"(select img_id, row * 8 + col as sample_id, 10.0e0 + 0.5e0 * row as lat, {g.fmod('358.0e0 + 0.5e0 * col', '360.0e0')} as lon, value from {IMG(d)} _l)"
register("ps_lonlat", lambda d: select(f"img_id, bin, {R('f_center', 'pk')}", sp.power(sp.lonlat_image(LONLAT(d)), 8, 8, norm="n2", dx=0.5, dialect=d)))
register("unwrap_lon", lambda d: select(f"img_id, sample_id, {R('lat', 'lon')}", sp.unwrapped(LONLAT(d))))
register("edge_shifts", lambda d: select(f"row, {R('s')}", sp.edge_shifts(f"(select row, col, 3.0e0 * col + 0.25e0 * row as lon from (select distinct row, col from {IMG(d)} _i) _p)", 8)))
register("ifft2", lambda d: select(f"img_id, row, col, {R('value')}", sp.ifft2(sp.fft2(IMG(d), 8, 8, d), 8, 8, d)))
register("tukey_window", lambda d: select(f"img_id, row, col, {R('value')}", sp.tukey(IMG(d), 8, 8)))

# Multi-resolution
GEOMETRY |= {f"smooth_{n}": mr.smooth_stencil(N, norm=n) for n in mr.NORMS}
for _norm in mr.NORMS:
    register(f"down_smooth_{_norm}", lambda d, n=_norm: select(f"cell_id, {R('value')}", mr.apply(mr.smooth_stencil(N, norm=n, dialect=d), SKY)))
register("down_smooth_partial", lambda d: select(f"cell_id, {R('value')}", mr.apply(mr.smooth_stencil(N, ids=f"(select cell_id from {PARTIAL} _p)", ellipsoid="sphere", dialect=d), PARTIAL)))
register("down_maxpool", lambda d: select(f"cell_id, {R('value')}", mr.maxpool(SKY)))
register("down_maxpool_partial", lambda d: select(f"cell_id, {R('value')}", mr.maxpool(PARTIAL)))
register("down_maxpool_first_cell", lambda d: select(f"cell_id, {R('value')}", mr.maxpool(PARTIAL, "first_cell")))
COARSE = ad.sky(LI, N // 2)
for _norm in mr.UP_NORMS:
    register(f"up_{_norm}", lambda d, n=_norm: select(f"cell_id, {R('value')}", mr.apply(mr.transposed(mr.smooth_stencil(N, dialect=d), n), COARSE)))

# Interpolation and patches
def _interpolated(name: str, ellipsoid: str, text: Callable[..., str]) -> None:
    """Neighbours of the cells that hold points are made for these alone; the twin takes them from the whole sphere's."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = frames(spark, sf_dir, f"select pt, lon, lat from {ad.event_points(EV)} _p")
        held = spark.sql(f"select centre as cell_id from {ip.holders('{points}', 8, ellipsoid)} _h", points=points)
        touching = grid.neighbours_of(held, 8)
        centres = grid.placed(held.union(touching.select("other")), 8)
        tables = {"points": points, "touching": touching, "centres": centres, "lineitem": spark.read.parquet(f"{sf_dir}/lineitem.parquet")}
        made = text("{points}", touching="{touching}", centres="{centres}").replace(LI, "{lineitem}")
        return spark.sql(made, **{k: v for k, v in tables.items() if f"{{{k}}}" in made})

    QUERIES[name], ORACLES[name] = run, twin(text(ad.event_points(EV)))


_interpolated("interp_weights", "sphere", lambda points, **o: select(f"pt, cell_id, {R('w')}", ip.weights(points, 8, **o)))
_interpolated("interp_values", "sphere", lambda points, **o: select(f"pt, {R('value')}", ip.values(points, ad.sky(LI, 8), 8, **o)))
_interpolated("interp_values_wgs84", "WGS84", lambda points, **o: select(f"pt, {R('value')}", ip.values(points, ad.sky(LI, 8), 8, "WGS84", **o)))
register("rectangle", lambda d: select("row, col, cell_id, is_pad", ip.rectangle(16, 20, -10, 60, 50, d)))
register("rect_intersect", lambda d: select(f"row, col, cell_id, {R('value')}", ip.on_rectangle(ip.rectangle(N, 20, -30, 160, 50, d), SKY, N)))
QUERIES["neighbours_of"] = lambda spark, sf_dir: grid.neighbours_of(spark.sql("select id * 5 as cell_id from range(0, 400)"), 16)
ORACLES["neighbours_of"] = f"select cell_id, other from {grid.neighbours(16)} _n where cell_id % 5 = 0 and cell_id < 2000"
register("rectangle_wgs84", lambda d: select("row, col, cell_id, is_pad", ip.rectangle(16, 20, -10, 60, 50, d, "WGS84", compat_padding=True)))
SCATTER = f"(select pt as id, lat, lon, value from {ad.event_points(EV)} _e)"
register("resample_nearest", lambda d: select(f"row, col, {R('value')}", ip.resample_nearest(SCATTER, 12, 16, d)))

# Convolution
GEOMETRY |= {"stencil_cosmo": cv.stencil(2, 3, 2, "cosmo"), "stencil_projected": cv.stencil(2, 3, 1, "projected_ref"), "stencil_two": cv.stencil(2, 3, 2, "two_ref")}
register("conv_stencil", lambda d: select(f"g, out_id, p, in_id, {R('w')}", cv.stencil(2, 3, 2, "cosmo")))
register("conv_partial_bind", lambda d: select(f"g, out_id, p, in_id, {R('w')}", cv.bound(cv.stencil(2, 3, 1, "projected_ref"), "(select cell_id from range(0, 30) as _c(cell_id))", 3)))
CHANNELS = f"(select map_id, cast(0 as bigint) as channel, cell_id, value from {ad.sky(LI, 2)} _s)"
KERNEL = "(select g, cast(0 as bigint) as c, o, p, case when p = 4 then 0.5e0 else 0.0625e0 end * (1 + o) as w from range(0, 2) as _g(g) cross join range(0, 2) as _o(o) cross join range(0, 9) as _p(p))"
BIAS = "(select g, o, 0.25e0 * o as b from range(0, 2) as _g(g) cross join range(0, 2) as _o(o))"
CONV = cv.forward(cv.stencil(2, 3, 2, "two_ref"), CHANNELS, KERNEL, BIAS, 2)
register("conv_forward", lambda d: select(f"channel, cell_id, {R('value')}", CONV))
register("conv_initial_kernel", lambda d: select(f"g, c, o, p, {R('w')}", cv.initial_kernel(2, 3, 4, 9, 7)))
register("conv_groupnorm_relu", lambda d: select(f"channel, cell_id, {R('value')}", cv.group_norm_relu(f"(select map_id, cell_id % 4 as channel, {g.div('cell_id', 4)} as cell_id, value from {SKY} _s)", 4)))
register("singularities", lambda d: " union all ".join(f"select '{k}' as gauge, {lon!r}e0 as lon, {lat!r}e0 as lat" for k in cv.GAUGES for lon, lat in cv.singularities(k)))

# Morphology
for _n in (2, 4):
    GEOMETRY |= {f"edges_{_n}": mo.edges(_n), f"triangles_{_n}": mo.triangles(_n)}
GEOMETRY["quads_2"] = mo.quads(2)
TH = "(select t / 2.0e0 - 0.5e0 as threshold from range(0, 4) as _t(t))"
register("minkowski_2d", lambda d: select(f"img_id, {R('w0', 'w1', 'w2')}", mo.functionals(IMG(d), "(select 0.0e0 as threshold)", 8)))
register("minkowski_curves", lambda d: select(f"img_id, threshold, {R('w0', 'w1', 'w2')}", mo.functionals(IMG(d), TH, 8)))
register("minkowski_sphere", lambda d: select(f"threshold, {R('w0', 'w1', 'w2')}", mo.sphere_functionals(f"(select map_id, cell_id, (value - 38) / 4 as value from {SKY} _s)", TH, N)))
register("minkowski_sphere_cliques", lambda d: select(f"threshold, {R('w0', 'w1', 'w2')}", mo.sphere_functionals(f"(select map_id, cell_id, (value - 38) / 4 as value from {ad.sky(LI, 2)} _s)", TH, 2, euler="cliques")))

# Series
MONTHLY = f"(select {g.mod('o_custkey', 48)} as cell_id, cast(extract(year from o_orderdate) as bigint) as y, cast(extract(month from o_orderdate) as bigint) as mon, avg(o_totalprice) / 1000 as value from {OR} _o group by 1, 2, 3)"
STANDARD = f"(select cell_id, y, mon, (value - avg(value) over p) / nullif(stddev_pop(value) over p, 0) as value from {MONTHLY} _m window p as (partition by cell_id, mon))"
register("monthly_standardise", lambda d: select(f"cell_id, y, mon, {R('value')}", STANDARD))
LAGGED = f"(select cell_id, y, mon, value, lead(value) over (partition by cell_id order by y, mon) - value as delta from {MONTHLY} _m)"
register("lag_delta", lambda d: select(f"cell_id, y, mon, {rounded('delta', 9)} as delta", LAGGED))
register("masked_rmse_corr", lambda d: select("cell_id, " + rounded("sqrt(avg(delta * delta))") + " as rmse, " + rounded("corr(value, delta)") + " as r", f"(select * from {LAGGED} _l where delta is not null)") + " group by cell_id")


# Spin
def _spin(spark: SparkSession, sf_dir: str, spin: int, text: str, nside: int = N, lmax: int = L) -> DataFrame:
    rings = grid.rings(nside)
    table = geometry(spark, f"spin{spin}_{nside}_{lmax} {rings}", lambda: h.spin_table(spark.sql(f"select ring_id, z from {rings} _r"), lmax, spin))
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(text, lineitem=lineitem, table=table)


def _vectors(nside: int) -> tuple[str, str]:
    """The vector samples and the weight of a cell."""
    vec = f"(select v.map_id, c.ring_id, c.phi, v.q, v.u from {ad.vector_sky('{lineitem}', nside)} v join {grid.cells(nside)} c on v.cell_id = c.cell_id)"
    return vec, f"(4 * {g.PI} / {12 * nside * nside})"


def _curl_div(nside: int, lmax: int, dialect: str) -> tuple[str, str]:
    """The coefficients, and from these as {eb} the divergence and curl maps of (u, v) = (q, u): the E and B of (-v, u) at spin 1, each back as a scalar map."""
    (vec, w), cells = _vectors(nside), grid.cells(nside)
    turned = f"(select map_id, ring_id, phi, -u as q, q as u from {vec} _v)"
    e, b = ("(select map_id, l, m, {0}_re as re, {0}_im as im from {{eb}} _e)".format(k) for k in "eb")
    text = f"select d.cell_id, {rounded('d.value')} as div, {rounded('c.value')} as curl from {h.alm2map(e, '{plm}', cells)} d join {h.alm2map(b, '{plm}', cells)} c on d.map_id = c.map_id and d.cell_id = c.cell_id"
    return h.map2alm_spin(turned, "{table}", lmax, 1, w, dialect), text


def curl_div(spark: SparkSession, sf_dir: str, nside: int = N, lmax: int = L) -> DataFrame:
    eb, text = _curl_div(nside, lmax, SPARK)
    return spark.sql(text, eb=_spin(spark, sf_dir, 1, select("*", eb), nside, lmax), plm=geometry_table(spark, f"plm_{nside}_{lmax}"))


def _register_spin(suffix: str, nside: int, lmax: int) -> None:
    vec, w = _vectors(nside)

    def texts(d: str) -> dict[str, str]:
        eb = h.map2alm_spin(vec, "{table}", lmax, 2, w, d)
        return {
            "spin2_eb": select(f"l, m, {R('e_re', 'e_im', 'b_re', 'b_im')}", eb),
            "spin2_qu": select(f"cell_id, {R('q', 'u')}", h.alm2map_spin(eb, "{table}", grid.cells(nside), 2)),
            "spin_spectra": select(f"spectrum, l, {R('cl')}", h.spin_spectra(eb)),
        }

    for name, text in texts(SPARK).items():
        QUERIES[f"{name}{suffix}"] = lambda spark, sf_dir, text=text: _spin(spark, sf_dir, 2, text, nside, lmax)
    QUERIES[f"curl_div{suffix}"] = lambda spark, sf_dir: curl_div(spark, sf_dir, nside, lmax)
    if lmax > 10:  # beyond the twin's finite sums
        return
    closed = lambda spin: h.spin_closed(grid.rings(nside), lmax, spin, DUCK)
    for name, text in texts(DUCK).items():
        ORACLES[f"{name}{suffix}"] = text.replace("{table}", closed(2)).replace("{lineitem}", "lineitem")
    eb, text = _curl_div(nside, lmax, DUCK)
    ORACLES[f"curl_div{suffix}"] = text.replace("{eb}", eb).replace("{table}", closed(1)).replace("{lineitem}", "lineitem").replace("{plm}", h.legendre_closed(grid.rings(nside), lmax, DUCK))


_register_spin("", N, L)
_register_spin("_32", 32, 95)


# Through the rings' fast transforms
def _transformed(nside: int, lmax: int, what: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t, sky = Transform(spark, nside, lmax), frames(spark, sf_dir, f"select * from {ad.sky(LI, nside)} _s")
        if what == "anafast":
            return spark.sql(select(f"l, {R('cl')}", "{c}"), c=t.anafast(sky))
        alm = t.map2alm(sky)
        return spark.sql(select(f"l, m, {R('re', 'im')}", "{a}"), a=alm) if what == "map2alm" else spark.sql(select(f"cell_id, {R('value')}", "{s}"), s=t.alm2map(alm))

    return run


for _what, _same in (("anafast", "anafast_auto"), ("map2alm", "map2alm"), ("alm2map", "alm2map")):
    QUERIES[f"{_what}_fft"], ORACLES[f"{_what}_fft"] = _transformed(N, L, _what), ORACLES[_same]
    QUERIES[f"{_what}_64"] = _transformed(64, 191, _what)

register("ring_fft", lambda d: select(f"ring_id, m, {R('re', 'im')}", h.ring_dft(SMP, 8, d)))


def ring_fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transforms of ring_dft by the fast path; its twin is the direct sum."""
    return spark.sql(select(f"ring_id, m, {R('re', 'im')}", "{f}"), f=h.ring_fft(frames(spark, sf_dir, f"select * from {SMP} _s"), 8))


QUERIES["ring_fft"] = ring_fft


def resampled(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """Users' values on a grid through a triangulation."""
    points = frames(spark, sf_dir, f"select cast(0 as bigint) as map_id, lat, lon, value from {SCATTER} _s")
    return rs.resample(points, 12, 16, method)


for _method in ("linear", "cubic"):
    QUERIES[f"resample_{_method}"] = lambda spark, sf_dir, method=_method: resampled(spark, sf_dir, method)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The power spectrum of the line items' map at nside 8, up to l = 8."""
    smp = ad.samples(ad.sky(LI, 8), 8)
    return frames(spark, sf_dir, select(f"l, {R('cl')}", h.spectrum(ALM(SPARK, smp, 8, 8))))
