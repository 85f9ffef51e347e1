"""The harmonic transform of a grid as an object: its rings and Legendre values are made once and kept, maps go through the rings' fast transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spheric.functions import geometry as g
from spheric.operators import grid
from spheric.operators import harmonics as h
from spheric.sources.adapters import check_sky
from spheric.sources.geometry_store import geometry


class Transform:
    """Transforms of RING maps (map_id, cell_id, value), absent cells counting as zeros. lmax is 3 nside - 1 unless given. check looks for ids that repeat or are out of range first."""

    def __init__(self, spark: SparkSession, nside: int, lmax: int | None = None, *, check: bool = True) -> None:
        self.spark, self.nside, self.lmax, self.check = spark, g.check_nside(nside), 3 * nside - 1 if lmax is None else lmax, check
        if self.lmax < 0:
            raise ValueError("lmax must be 0 or more")
        rings = f"(select ring_id, z from {grid.rings(nside)} _r)"
        self.rings = geometry(spark, grid.rings(nside))
        self.plm = geometry(spark, f"plm_{nside}_{self.lmax} {grid.rings(nside)}", lambda: h.legendre_table(spark.sql(f"select * from {rings} _z"), self.lmax))

    def __repr__(self) -> str:
        return f"Transform(nside={self.nside}, lmax={self.lmax}, cells={12 * self.nside**2}, modes={(self.lmax + 1) * (self.lmax + 2) // 2})"

    def map2alm(self, sky: DataFrame) -> DataFrame:
        if self.check:
            check_sky(sky, self.nside)
        placed = f"select s.map_id, c.ring_id, c.phi, s.value from {{sky}} s join {grid.cells(self.nside, '{sky}')} c on s.cell_id = c.cell_id"
        f = h.ring_fft(self.spark.sql(placed, sky=sky.select("map_id", "cell_id", "value")), self.lmax)
        weight = f"(4 * {g.PI} / {12 * self.nside**2})"
        text = f"select f.map_id, p.l, p.m, {weight} * sum(f.re * p.y) as re, {weight} * sum(f.im * p.y) as im from {{f}} f join {{plm}} p on f.ring_id = p.ring_id and f.m = p.m group by f.map_id, p.l, p.m"
        return self.spark.sql(text, f=f, plm=self.plm)

    def alm2map(self, alm: DataFrame) -> DataFrame:
        """A whole map for each map_id."""
        if missing := {"map_id", "l", "m", "re", "im"} - set(alm.columns):
            raise ValueError(f"coefficients have no {sorted(missing)}")
        text = "select a.map_id, p.ring_id, a.m, sum(a.re * p.y) as re, sum(a.im * p.y) as im from {alm} a join {plm} p on a.l = p.l and a.m = p.m group by a.map_id, p.ring_id, a.m"
        return h.ring_synthesis(self.spark.sql(text, alm=alm, plm=self.plm), self.rings.select("ring_id", "n_r", "phi0", "start"))

    def anafast(self, sky: DataFrame, other: DataFrame | None = None) -> DataFrame:
        """map_id, l, cl: auto, or cross with the same map_id of other."""
        if other is None:
            return self.spark.sql(f"select * from {h.spectrum('{a}')} _c", a=self.map2alm(sky))
        return self.spark.sql(f"select * from {h.spectrum('{a}', '{b}')} _c", a=self.map2alm(sky), b=self.map2alm(other))
