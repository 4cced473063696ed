"""Tables kept on storage in hash partitions of their key: a merge reads and writes only the partitions that its rows touch."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.operators.store import delete_by_key, upsert

#: The column that partitions a stored table; callers never see it.
BUCKET = "_bucket"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in store.listStatus(at)) if store.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def working_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the working folder, read back: what several jobs read is worked out once, and survives a lost executor."""
    path = f"{working_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class StoredTable:
    """Rows of a schema under path, one for each value of keys, in hash partitions by the columns bucketed (keys, unless fewer are named).

    merge, replace and delete read only the partitions of the rows they are given, and overwrite those by Spark's dynamic partition
    overwrite; files of all others stay as they are. What they write depends only on the table and those rows, so a run that failed
    midway is mended by running it again. One writer at a time. Null keys are values like others to the partition, but match nothing,
    as in SQL: such rows are inserted, never replaced.
    """

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = 64
    bucketed: tuple[str, ...] | None = None

    def _columns(self) -> StructType:
        return self.spark.createDataFrame([], self.schema).schema

    def _with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*(self.bucketed or self.keys)), F.lit(self.buckets)).cast("int"))

    def _stored(self) -> DataFrame:
        columns = self._columns().add(BUCKET, "integer")
        # A table that nothing was written to has no folder yet.
        return self.spark.read.schema(columns).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], columns)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def touched(self, rows: DataFrame) -> DataFrame:
        """The stored rows of the partitions that rows fall into. Their numbers, of which there are no more than buckets, go into the scan, which prunes by them."""
        found = [r[0] for r in self._with_bucket(rows.select(*(self.bucketed or self.keys))).select(BUCKET).distinct().collect()]
        return self._stored().where(F.col(BUCKET).isin(found)).drop(BUCKET)

    def _put(self, rows: DataFrame) -> None:
        named = self._with_bucket(rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self._columns())))
        named.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def merge(self, new: DataFrame) -> dict[str, int]:
        """Upserts rows of distinct keys; returns how many were inserted and updated. Of several rows of one key, refuse all."""
        new = new.select(*self._columns().names)
        if new.groupBy(*self.keys).count().where("count > 1").limit(1).count():
            raise ValueError("a merge holds one key twice")
        had = self.touched(new).select(*self.keys)
        updated = new.join(had, list(self.keys), "left_semi").count()
        inserted = new.count() - updated
        self._put(upsert(self.touched(new), new, list(self.keys)).drop("change"))
        return {"inserted": inserted, "updated": updated}

    def replace(self, new: DataFrame, by: tuple[str, ...], of: DataFrame | None = None) -> None:
        """Deletes all rows of every value of by that new, or else of, has, and inserts new. by must hold the bucketed columns, so that those rows lie in the partitions read."""
        if not set(self.bucketed or self.keys) <= set(by):
            raise ValueError(f"{by} does not say which partitions to read")
        new = new.select(*self._columns().names)
        values = new.select(*by) if of is None else of.select(*by).unionByName(new.select(*by))
        self._rewrite(values, delete_by_key(self.touched(values), values, list(by)).unionByName(new))

    def delete(self, gone: DataFrame) -> None:
        """Deletes the rows of the keys, or of the bucketed columns, that gone has; a partition that is left empty is removed."""
        by = list(self.keys if set(self.keys) <= set(gone.columns) else self.bucketed or self.keys)
        self._rewrite(gone, delete_by_key(self.touched(gone), gone, by))

    def _rewrite(self, values: DataFrame, rows: DataFrame) -> None:
        """Writes rows as all that is left of the partitions that values fall into."""
        numbers = lambda df: {r[0] for r in self._with_bucket(df.select(*(self.bucketed or self.keys))).select(BUCKET).distinct().collect()}  # noqa: E731 - no more than buckets
        emptied = numbers(values) - numbers(rows)
        self._put(rows)
        for k in emptied:
            if exists(self.spark, f"{self.path}/{BUCKET}={k}"):
                remove(self.spark, f"{self.path}/{BUCKET}={k}")
