"""Sharding by size-tiered compaction: arrivals become small immutable shards, runs of similar size are merged into shards of a target size, and each state is one version of a manifest, committed atomically.

Built-in functions only on the rows' way. A shard is a Parquet file; its size is that of the file. Shards of one tier
(sizes within a factor of fanout) are merged once there are fanout of them; a merge takes shards together up to the target size and
makes one shard of each such bin, in a task of its own, so no task holds more than a bin. A bin's size counts compressed bytes.

A version is a small file that names its manifest. It is made whole under another name and then linked (on a local file
system) or renamed (elsewhere) to the version's, which fails if another writer has made that version meanwhile: then the
later one gets an error, and nothing of it shows. This asks of a store that a file's rename refuses a name in use, as HDFS
does. Readers see the files of one version; files of older versions stay until vacuum.

Rows, nulls, repeated rows, texts of any length and columns of any name pass unchanged; all arrivals have the columns of the
first. An arrival without rows commits a version that adds none, and a store of such reads as an empty table. The list of
shards, one row for each, passes the driver; rows do not.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spheric.llm.common import fresh, new_folder, remove_folder

TARGET_BYTES, FANOUT, LEAST_BYTES = 128 << 20, 4, 4 << 20
MANIFEST = "file string, bytes long, rows long, tier int, merged boolean"
#: Parts in which the query's documents arrive.
ARRIVALS = 4


class ShardStore:
    def __init__(self, spark: SparkSession, folder: str, *, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT) -> None:
        self.spark, self.folder, self.target, self.fanout = spark, folder.rstrip("/"), target_bytes, fanout
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        where = self._path(f"{self.folder}/versions")
        if not self._fs.exists(where):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(where)]
        return sorted(int(x[1:]) for x in names if x.startswith("v"))

    def _pointer(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/versions/v{version:09d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """Rows (file, bytes, rows, tier, merged) of a version, the last by default."""
        at = (self.versions() or [0])[-1] if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/{self._pointer(at)['manifest']}") if at else self.spark.createDataFrame([], MANIFEST)

    def schema(self, version: int | None = None) -> T.StructType | None:
        at = (self.versions() or [0])[-1] if version is None else version
        return T.StructType.fromJson(self._pointer(at)["schema"]) if at else None

    def _commit(self, rows: DataFrame, before: int, schema: T.StructType) -> int:
        """Version before + 1, or an error if another writer has made it meanwhile."""
        name = uuid.uuid4().hex
        rows.coalesce(1).write.parquet(f"{self.folder}/manifest/{name}")
        made, to = self._path(f"{self.folder}/versions/_{name}"), self._path(f"{self.folder}/versions/v{before + 1:09d}")
        stream = self._fs.create(made, False)
        stream.write(bytearray(json.dumps({"manifest": name, "schema": schema.jsonValue()}).encode()))
        stream.close()
        if self._claim(made, to):
            return before + 1
        remove_folder(self.spark, f"{self.folder}/manifest/{name}")
        self._fs.delete(made, False)
        raise RuntimeError(f"version {before + 1} was committed by another writer")

    def _claim(self, made, to) -> bool:
        """Gives a finished file its name unless that is taken, in one step."""
        if self._fs.getUri().getScheme() != "file":
            return self._fs.rename(made, to)
        paths = self._jvm.java.nio.file.Paths
        try:
            self._jvm.java.nio.file.Files.createLink(paths.get(to.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.String, 0)), paths.get(made.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.String, 0)))
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        self._fs.delete(made, False)
        return True

    def _shards_in(self, folder: str, merged: bool) -> DataFrame:
        """The manifest rows of the files in a folder just written."""
        files = self.spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        sized = files.groupBy("file").agg(F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        return sized.select("file", "bytes", "rows", self._tier(F.col("bytes")).alias("tier"), F.lit(merged).alias("merged"))

    def _tier(self, size):
        return F.greatest(F.lit(0), F.floor(F.log(size / F.lit(LEAST_BYTES)) / F.log(F.lit(float(self.fanout))))).cast("int")

    def append(self, rows: DataFrame) -> int:
        """One shard for each of the arrival's partitions that has rows, and a version with them."""
        before = (self.versions() or [0])[-1]
        schema = self.schema(before)
        if schema is not None and schema.simpleString() != rows.schema.simpleString():
            raise ValueError(f"the store's columns are {schema.simpleString()}")
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(folder)
        return self._commit(self.manifest(before).union(self._shards_in(folder, False)), before, schema or rows.schema)

    def plan(self, version: int) -> DataFrame:
        """The manifest's rows and bin: the merge that a shard is part of, or null. The manifest has a row for each shard, which is what the window sorts, tier by tier."""
        small = F.col("bytes") < self.target / 2
        in_tier = Window.partitionBy("group")
        run = in_tier.orderBy("file").rowsBetween(Window.unboundedPreceding, 0)
        held = self.manifest(version).withColumn("small", small).withColumn("group", F.when(small, F.col("tier")).otherwise(-1))
        counted = held.withColumns({"n": F.count(F.lit(1)).over(in_tier), "upto": F.sum("bytes").over(run) - F.col("bytes")})
        bin_ = F.when(F.col("small") & (F.col("n") >= self.fanout), F.concat_ws("-", "group", F.floor(F.col("upto") / F.lit(self.target))))
        return counted.select("file", "bytes", "rows", "tier", "merged", bin_.alias("bin"))

    def compact(self) -> int:
        """Merges until no tier is due, a version each time; returns the last version."""
        while True:
            before = (self.versions() or [0])[-1]
            due = [(r.file, r.bin) for r in self.plan(before).where("bin is not null").collect()]  # a row for each shard, not for rows of data
            if not due:
                return before
            self._merge(before, due)

    def _merge(self, before: int, due: list[tuple[str, str]]) -> int:
        bins = {b: i for i, b in enumerate(sorted({b for _, b in due}))}
        schema = self.schema(before)
        rows = self.spark.read.schema(schema).parquet(*[f for f, _ in due])
        file, bin_ = fresh(rows, "file"), fresh(rows, "bin")
        place = self.spark.createDataFrame([(f, bins[b]) for f, b in due], f"{file} string, {bin_} int")
        placed = rows.withColumn(file, F.col("_metadata.file_path")).join(F.broadcast(place), file)
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        dealt = placed.repartitionById(len(bins), F.col(bin_))
        dealt.select(*[dealt[c] for c in rows.columns]).write.option("compression", "zstd").parquet(folder)
        left = self.manifest(before).join(F.broadcast(place.select(F.col(file).alias("file"))), "file", "left_anti")
        return self._commit(left.union(self._shards_in(folder, True)), before, schema)

    def read(self, version: int | None = None, details: dict[str, str] | None = None) -> DataFrame:
        """The rows of a version, the last by default. details names manifest columns to be added, and as what."""
        if (schema := self.schema(version)) is None:
            raise ValueError("no shard has been committed")
        held = self.manifest(version)
        files = [r.file for r in held.select("file").collect()]
        rows = self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
        if not details:
            return rows
        file = fresh(rows, "file")
        named = held.select(F.col("file").alias(file), *[F.col(c).alias(name) for c, name in details.items()])
        if not files:
            return rows.withColumn(file, F.lit("")).join(named, file).drop(file)
        return rows.withColumn(file, F.col("_metadata.file_path")).join(F.broadcast(named), file).drop(file)  # a row for each shard

    def vacuum(self, keep: int = 1) -> None:
        """Drops the versions before the last keep, their manifests, and the data that only these name."""
        old, new = self.versions()[:-keep], self.versions()[-keep:]
        named = {r.file for v in new for r in self.manifest(v).select("file").collect()}
        for v in old:
            for r in self.manifest(v).select("file").collect():
                if r.file not in named:
                    self._fs.delete(self._path(r.file), False)
            remove_folder(self.spark, f"{self.folder}/manifest/{self._pointer(v)['manifest']}")
            self._fs.delete(self._path(f"{self.folder}/versions/v{v:09d}"), False)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents, with all its columns, as it comes back from the compacted store: its id, the digest and length of its text, whether that is null, a digest of the other columns, and whether its shard is a merged one.

    Documents arrive in ARRIVALS parts, by the hash of their ids.
    """
    store = ShardStore(spark, new_folder(spark, "shards"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == i))
    store.compact()
    text = F.coalesce("text", F.lit(""))
    rest = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "n_chars")]), 256)
    return store.read(details={"merged": "merged"}).select("doc_id", F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.length(text).cast("long").alias("n_chars"), F.col("text").isNull().alias("text_null"), rest.alias("rest_sha256"), "merged")
