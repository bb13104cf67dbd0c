"""Roll-ups kept up to date by batches of changed rows, with retractions of what rows counted for before."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from severa.staging import drop_staged, stage
from severa.streaming.commits import Commits


@dataclass(frozen=True)
class Rollup:
    """Number of rows and sums of values by part and dims, in files by part.

    A batch has rows (key, version, part, dims, values, counts). Of a key's versions the highest holds, whenever it comes:
    older ones that come late change nothing, and of rows that share key and version in a batch the greatest in the order
    of part, dims and values holds. Rows with a null key are left out; `counts` false or null (superseded) takes a row out
    of the sums, but its version is kept. Null parts and dims are groups of their own, null values add nothing.

    What a row counted for before is read from the log of rows, in the buckets of the batch's keys, and taken off its old
    part. Parts of which the batch changes nothing are neither read nor written. One commit names the files of all parts
    and of the log, so a batch that dies leaves the sums before it, and a batch number that is committed is skipped. The
    log is merged when it has `most_logs` layers. Parts are named in the commit: as many as there are months."""

    folder: str
    key: str
    version: str
    part: str
    dims: tuple[str, ...]
    values: tuple[str, ...]
    buckets: int = 64
    most_logs: int = 20

    def _commits(self, spark: SparkSession) -> Commits:
        return Commits(spark, f"{self.folder}/commits")

    def _columns(self) -> list[str]:
        return [self.version, self.part, *self.dims, *self.values, "counts"]

    def _latest(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("bucket", self.key).agg(F.max(F.struct(*self._columns())).alias("row"))

    def _logged(self, spark: SparkSession, layers: list[str], schema: T.StructType, buckets: list[int] | None) -> DataFrame:
        base = f"{self.folder}/rows"
        found = spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/batch={x}" for x in layers])
        return self._latest(found if buckets is None else found.where(F.col("bucket").isin(buckets)))

    def apply(self, batch: DataFrame, number: int) -> list[str]:
        """Take a batch in. -> the names of the parts whose files it wrote anew or removed."""
        spark, token = batch.sparkSession, uuid.uuid4().hex
        commits = self._commits(spark)
        last, entry = commits.last()
        if number <= last:
            return []
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int").alias("bucket")
        counted = batch.where(F.col(self.key).isNotNull()).withColumn("counts", F.coalesce("counts", F.lit(False)))
        new = stage(self._latest(counted.select(bucket, self.key, *self._columns())), "changes")
        schema = T.StructType([new.schema[self.key], *new.schema["row"].dataType.fields, T.StructField("bucket", T.IntegerType())])
        layers = entry.get("rows", [])
        if layers:
            touched = [r[0] for r in new.select("bucket").distinct().collect()]
            old = self._logged(spark, layers, schema, touched).withColumnRenamed("row", "old")
            paired = new.join(old, ["bucket", self.key], "left")
        else:
            paired = new.withColumn("old", F.lit(None).cast(new.schema["row"].dataType))
        taken = stage(paired.where(F.col("old").isNull() | (F.col(f"row.{self.version}") > F.col(f"old.{self.version}"))), "taken")

        name = F.coalesce(F.concat(F.lit("p"), F.hex(F.col(self.part).cast("string"))), F.lit("none")).alias("_p")
        groups = ["_p", self.part, *self.dims]
        signed = taken.select(F.explode(F.array(F.struct(F.lit(1).alias("s"), F.col("row").alias("r")), F.struct(F.lit(-1).alias("s"), F.col("old").alias("r")))).alias("x")).where("x.r.counts")
        flat = signed.select("x.s", "x.r.*").select(name, self.part, *self.dims, F.col("s").cast("long").alias("n"), *[(F.col("s") * F.coalesce(F.col(v).cast("long"), F.lit(0))).alias(v) for v in self.values])
        sums = [F.sum(c).alias(c) for c in ("n", *self.values)]
        changed = " or ".join(f"{c} <> 0" for c in ("n", *self.values))
        delta = stage(flat.groupBy(*groups).agg(*sums).where(changed), "delta")

        parts = dict(entry.get("parts", {}))
        names = [r[0] for r in delta.select("_p").distinct().collect()]
        base = f"{self.folder}/sums"
        known = [f"{base}/batch={parts[p]}/_p={p}" for p in names if p in parts]
        merged = delta
        if known:
            merged = merged.unionByName(spark.read.schema(delta.schema).option("basePath", base).parquet(*known).select(*delta.columns))
        merged.groupBy(*groups).agg(*sums).where("n <> 0").repartition("_p").write.partitionBy("_p").parquet(f"{base}/batch={token}")
        written = {n.removeprefix("_p=") for n in commits.names(f"{base}/batch={token}") if n.startswith("_p=")}
        parts = {p: t for p, t in parts.items() if p not in names} | dict.fromkeys(written, token)

        log = taken.select("bucket", self.key, "row")
        if len(layers) >= self.most_logs:
            layers = []
            log = self._logged(spark, entry["rows"], schema, None).unionByName(log).groupBy("bucket", self.key).agg(F.max("row").alias("row"))
        log.select(self.key, "row.*", "bucket").repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/rows/batch={token}")
        commits.add(number, {"rows": [*layers, token], "parts": parts, "schema": schema.jsonValue()})
        drop_staged(new, taken, delta)
        return sorted(names)

    def read(self, spark: SparkSession) -> DataFrame:
        """part, dims, n, values as the last commit has them."""
        _, entry = self._commits(spark).last()
        if not entry:
            raise FileNotFoundError(f"no batch is committed in {self.folder}")
        held = {f.name: f for f in T.StructType.fromJson(entry["schema"])}
        longs = [T.StructField(c, T.LongType()) for c in ("n", *self.values)]
        schema = T.StructType([held[self.part], *[held[d] for d in self.dims], *longs])
        base = f"{self.folder}/sums"
        paths = [f"{base}/batch={t}/_p={p}" for p, t in entry["parts"].items()]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def clean(self, spark: SparkSession) -> None:
        """Delete files that the last commit doesn't name: of batches that died, and replaced ones. Nobody may read them."""
        commits = self._commits(spark)
        _, entry = commits.last()
        commits.keep_only(f"{self.folder}/rows", {f"batch={t}" for t in entry.get("rows", [])})
        commits.keep_only(f"{self.folder}/sums", {f"batch={t}" for t in entry.get("parts", {}).values()})
