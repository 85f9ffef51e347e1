"""Relational tables as maps, samples and images; each function gives SQL over table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spheric.functions import geometry as g


def sky(lineitem: str, nside: int, key: str = "cast(0 as bigint)", where: str = "true", value: str = "avg(l_extendedprice) / 1000") -> str:
    """map_id, cell_id, value: line items dealt over the cells."""
    cell = g.mod("l_orderkey * 7 + l_partkey", 12 * nside * nside)
    return f"(select map_id, cell_id, {value} as value from (select *, {key} as map_id, {cell} as cell_id from {lineitem} _l) _c where {where} group by map_id, cell_id)"


def vector_sky(lineitem: str, nside: int) -> str:
    """map_id, cell_id, q, u."""
    cell = g.mod("l_orderkey * 7 + l_partkey", 12 * nside * nside)
    return f"(select cast(0 as bigint) as map_id, cell_id, avg(l_quantity) / 10 as q, avg(l_extendedprice) / 10000 as u from (select *, {cell} as cell_id from {lineitem} _l) _c group by cell_id)"


def samples(sky_: str, nside: int) -> str:
    """A RING map with each cell's ring and longitude."""
    from spheric.operators.grid import cells

    return f"(select s.map_id, c.cell_id, c.ring_id, c.phi, c.z, s.value from {sky_} s join {cells(nside)} c on s.cell_id = c.cell_id)"


def event_points(events: str) -> str:
    """pt, lon, lat, value: users at places made from their ids, in degrees."""
    return f"(select user_id as pt, {g.mod('user_id * 7919', 36000)} / 100.0e0 as lon, {g.mod('user_id * 104729', 17800)} / 100.0e0 - 89 as lat, avg(value) as value from {events} _e group by user_id)"


def images(embeddings: str, dialect: str = "spark") -> str:
    """img_id, row, col, value: 64 numbers as a square of eight."""
    if dialect == "spark":
        return f"(select vec_id as img_id, {g.div('i', 8)} as row, {g.mod('i', 8)} as col, cast(v as double) as value from {embeddings} _e lateral view posexplode(embedding) _p as i, v)"
    return f"(select vec_id as img_id, {g.div('i - 1', 8)} as row, {g.mod('i - 1', 8)} as col, cast(embedding[i] as double) as value from {embeddings} _e cross join lateral unnest(range(1, len(embedding) + 1)) as _p(i))"


def check_sky(df: DataFrame, nside: int, complete: bool = False) -> None:
    """Raises ValueError unless ids are unique for each map, in range and, if asked, all there."""
    npix = 12 * g.check_nside(nside) ** 2
    row = df.groupBy("map_id", "cell_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.min("cell_id").alias("lo"), F.max("cell_id").alias("hi")).first()
    if row.n is not None and (row.n > 1 or row.lo < 0 or row.hi >= npix):
        raise ValueError(f"cell ids must be unique and within 0..{npix - 1}; for nside {nside}")
    if complete and df.groupBy("map_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != npix).limit(1).count():
        raise ValueError(f"a whole map of nside {nside} has {npix} cells")
