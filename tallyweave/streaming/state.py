"""Tables that micro-batches keep between them.

Both kinds name their current files in one small text file, the pointer, which
is replaced as a whole after everything else of a batch is written. Readers
open the pointer and what it names: no listing of versions, however many there
have been. A batch that is tried again starts from the state before it, which
stays on disk until the next batch has been committed.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write ``text`` beside ``path`` and rename it over it."""
    p, fs = _fs(spark, f"{path}.next")
    out = fs.create(p, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(p, target, how)


def _remove(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


@dataclass(frozen=True)
class StateTable:
    """Rows by key. A batch writes the rows that it changes; every ``every`` batches they are merged into a new base.

    A row with ``_gone`` true takes its key out.
    """

    root: str
    schema: T.StructType
    keys: tuple[str, ...]
    every: int = 16

    def _pointer(self, spark: SparkSession) -> dict:
        text = read_text(spark, f"{self.root}/_current")
        return json.loads(text) if text else {"version": -1, "base": None, "deltas": [], "before": None}

    def _chain(self, spark: SparkSession, before: int | None) -> dict:
        """The base and the deltas that hold the state, without what batch ``before`` or a later one wrote."""
        now = self._pointer(spark)
        if before is not None and now["version"] >= before:
            now = now["before"] or {"base": None, "deltas": []}
        return {"base": now["base"], "deltas": now["deltas"]}

    def _read(self, spark: SparkSession, chain: dict) -> DataFrame:
        stored = T.StructType([*self.schema, T.StructField("_gone", T.BooleanType()), T.StructField("_version", T.LongType())])
        paths = [f"{self.root}/base-{chain['base']}"] * (chain["base"] is not None) + [f"{self.root}/delta-{v}" for v in chain["deltas"]]
        if not paths:
            return spark.createDataFrame([], self.schema)
        rows = spark.read.schema(stored).parquet(*paths)
        names = self.schema.fieldNames()
        if chain["deltas"]:
            last = F.max_by(F.struct(*[c for c in names if c not in self.keys], "_gone"), F.col("_version")).alias("r")
            rows = rows.groupBy(*self.keys).agg(last).select(*self.keys, "r.*")
        return rows.filter("NOT _gone").select(*names)

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The state; with ``before``, as batch ``before`` found it."""
        return self._read(spark, self._chain(spark, before))

    def upsert(self, changes: DataFrame, version: int) -> None:
        """Rows of batch ``version``, at most one per key; those of an earlier try of the batch are replaced."""
        spark, now = changes.sparkSession, self._pointer(changes.sparkSession)
        before = self._chain(spark, version)
        gone = F.coalesce(F.col("_gone"), F.lit(False)) if "_gone" in changes.columns else F.lit(False)
        rows = changes.select(*[F.col(c.name).cast(c.dataType) for c in self.schema], gone.alias("_gone"), F.lit(version).cast("long").alias("_version"))
        rows.write.mode("overwrite").parquet(f"{self.root}/delta-{version}")
        chain = {"base": before["base"], "deltas": [*before["deltas"], version]}
        if len(chain["deltas"]) >= self.every:
            merged = self._read(spark, chain).withColumns({"_gone": F.lit(False), "_version": F.lit(version).cast("long")})
            merged.write.mode("overwrite").parquet(f"{self.root}/base-{version}")
            chain = {"base": version, "deltas": []}
        replace_text(spark, f"{self.root}/_current", json.dumps({"version": version, **chain, "before": before}))
        # What neither this state nor the one before it names is never read again.
        older = now["before"] or {"base": None, "deltas": []}
        kept = {f"base-{x['base']}" for x in (chain, before)} | {f"delta-{v}" for x in (chain, before) for v in x["deltas"]} | {f"delta-{version}"}
        named = {f"base-{x['base']}" for x in (now, older) if x["base"] is not None} | {f"delta-{v}" for x in (now, older) for v in x["deltas"]}
        for name in sorted((named | {f"delta-{now['version']}"}) - kept):
            _remove(spark, f"{self.root}/{name}")


@dataclass(frozen=True)
class BucketTable:
    """Rows in buckets by a hash of their identity. A batch reads and rewrites only the buckets that it touches."""

    root: str
    schema: T.StructType
    identity: Callable[[], list]  # columns that make rows equal
    buckets: int = 64

    def _pointer(self, spark: SparkSession) -> dict:
        text = read_text(spark, f"{self.root}/_current")
        return json.loads(text) if text else {"version": -1, "buckets": {}, "before": {}}

    def _read(self, spark: SparkSession, where: dict[str, int]) -> DataFrame:
        if not where:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[f"{self.root}/v{v}/bucket={b}" for b, v in sorted(where.items())])

    def read(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, self._pointer(spark)["buckets"])

    def merge(self, batch: DataFrame, version: int, combine: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Take in the rows of batch ``version``: ``combine`` makes old and new rows of the touched buckets into the new ones.

        Returns the buckets touched, at most ``buckets`` of them.
        """
        spark = batch.sparkSession
        now = self._pointer(spark)
        before = now["before"] if now["version"] >= version else now["buckets"]
        number = F.pmod(F.xxhash64(*self.identity()), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in batch.select(number.alias("b")).distinct().collect())
        if touched:
            old = self._read(spark, {b: v for b, v in before.items() if int(b) in set(touched)})
            rows = combine(old.unionByName(batch.select(*[F.col(c.name).cast(c.dataType) for c in self.schema])))
            rows.withColumn("bucket", number).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/v{version}")
        after = before | {str(b): version for b in touched}
        replace_text(spark, f"{self.root}/_current", json.dumps({"version": version, "buckets": after, "before": before}))
        keep = {(b, v) for x in (after, before) for b, v in x.items()}
        for b, v in sorted({(b, v) for x in (now["buckets"], now["before"]) for b, v in x.items()} - keep):
            _remove(spark, f"{self.root}/v{v}/bucket={b}")
        return touched


def newest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
