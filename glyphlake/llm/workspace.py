"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one on a single machine; on a cluster an error."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="glyphlake-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


class Workspace:
    """Tables written to cut lineage: a lost executor costs a reread, not a recomputation."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self._count = 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and return the written table."""
        self._count += 1
        path = f"{self.root}/{self._count:03d}-{name}"
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._glyphlake_path = path
        return saved

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._glyphlake_path)
            path.getFileSystem(conf).delete(path, True)

    def clear(self) -> None:
        """Delete all tables written so far; nothing may read them any more."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished jobs now rather than at some later collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
