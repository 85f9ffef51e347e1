"""What the text operators share: the shared folder, stored tables and byte views of string columns."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spheric import ship

#: Text is scanned in runs of rows of about this many bytes, which bounds a Python worker's memory. A longer text makes a run of its own.
SLICE_BYTES = 1 << 18
#: Rows of a few numbers each, some fifty bytes, that are broadcast at most.
BROADCAST_ROWS = 1 << 21


def shipped(spark: SparkSession | None = None) -> SparkSession:
    """The session, with this package's modules on its executors."""
    return ship(spark or SparkSession.active())


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the cluster's spark.checkpoint.dir. Only a local session without one gets a folder under /tmp, which goes at exit."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = f"/tmp/checkpoints/spheric-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    atexit.register(shutil.rmtree, made, True)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again, which cuts its lineage and survives lost executors."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row as the small side of a join: counted, and broadcast up to BROADCAST_ROWS, else shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("shuffle_hash")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def let(value: Column, use) -> Column:
    """use(value), with value worked out once for each row: a lambda's variable is not, in contrast to a column, worked out again where it stands inside another lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pieces_of(text: Column, block: int = 4096):
    """A function of two places that gives the text between them, in time for what it takes and one block: the text is cut into blocks once."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))

    def with_blocks(use) -> Column:
        def cut(held: Column, a: Column, b: Column) -> Column:
            first, last = F.floor(a / block).cast("int"), F.floor((F.greatest(b, a + 1) - 1) / block).cast("int")
            joined = F.array_join(F.slice(held, first + 1, last - first + 1), "")
            return F.when(b > a, F.substring(joined, a - first * block + 1, b - a)).otherwise("")

        return let(blocks, lambda held: use(lambda a, b: cut(held, a, b)))

    return with_blocks


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Hadoop knows."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n + 1 offsets of its rows. A null counts as an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def text_runs(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about limit bytes: first row, row after the last, their bytes, and offsets into these."""
    data, at = text_bytes(column)
    first = 0
    while first < len(at) - 1:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def powers(base: int, n: int, held: dict = {}) -> np.ndarray:  # noqa: B006
    """base ** 0 .. base ** n modulo 2 ** 64; kept for the next call if they are few."""
    have = held.get(base)
    if have is None or len(have) <= n:
        have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), base, np.uint64)]), dtype=np.uint64)
        if n <= 1 << 18 and len(held) < 8:
            held[base] = have
    return have


def span_hashes(values: np.ndarray, first: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A polynomial hash modulo 2 ** 64 of values[first:end] for each pair; equal runs have equal hashes wherever they stand."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n)[:n], dtype=np.uint64, out=total[1:])
    return mixed((total[end] - total[first]) * powers(pow(base, -1, 1 << 64), n)[first])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))
